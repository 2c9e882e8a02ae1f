"""Late fusion: weighted sums of hit lists, and hybrid fusion of candidates from several sources."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .index import Index

NORMALIZERS = ("identity", "negative_distance", "inverse", "inverse_distance", "minmax", "zscore", "rank")


def total_of(gains: Column) -> Column:
    """Aggregate: the sum of few doubles, the same in any order and rounded once (sorted, then compensated as Neumaier does); nulls add nothing, nulls alone are null."""
    step = lambda x, i: x["s"] + i
    lost = lambda x, i: F.when(F.abs(x["s"]) >= F.abs(i), (x["s"] - step(x, i)) + i).otherwise((i - step(x, i)) + x["s"])
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))
    whole = lambda x: F.when(F.abs(x["s"]) < float("inf"), x["s"] + x["c"]).otherwise(x["s"])
    total = F.aggregate(F.sort_array(F.collect_list(gains)), start, lambda x, i: F.struct(step(x, i).alias("s"), (x["c"] + lost(x, i)).alias("c")), whole)
    return F.when(F.count(gains) > 0, total)


def fuse_hits(sources: list[tuple[DataFrame, float | None]], k: int, key: str = "doc_id", digits: int = 6) -> DataFrame:
    """Hit lists (key, score) with weights (null: 1): summed by key, the k best, ties by the key as text."""
    parts = [df.select(key, (F.col("score") * (1.0 if w is None else float(w))).alias("score")) for df, w in sources]
    total = reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.round(total_of(F.col("score")), digits).alias("score"))
    return total.orderBy(F.col("score").desc(), F.col(key).cast("string")).limit(k)


@dataclass(frozen=True)
class FieldQuery:
    """A query to one index in a fusion: a null weight is 1, a field without a name is called by its place, from field_1 on."""

    index: Index
    text: str
    weight: float | None = 1.0
    field: str | None = None


def fuse_queries(queries: list[FieldQuery], k: int, candidate_k: int | None = None, mask: Column | None = None, digits: int = 6) -> DataFrame:
    """(key, score, fields) of the k best: each query's candidate_k best (null: k), weighted and summed by the key that the indexes share.

    mask: a factor of each row's gain in every query. fields: names of the queries that had the row among their candidates, in order."""
    if not queries or k < 1 or (candidate_k is not None and candidate_k < 1):
        raise ValueError("a fusion takes queries and positive limits")
    if len(keys := {q.index.manifest["key"] for q in queries}) > 1:
        raise ValueError("fused indexes share one key")
    names = [(q.field or "").strip() or f"field_{i}" for i, q in enumerate(queries, 1)]
    if len(set(names)) < len(names):
        raise ValueError("two fields have one name")
    weights = [1.0 if q.weight is None else float(q.weight) for q in queries]
    if not all(map(math.isfinite, weights)):
        raise ValueError("weights are finite")
    key = keys.pop()
    found = [q.index.query(q.text, candidate_k or k, mask=mask, digits=digits).select(key, (F.col("score") * w).alias("score"), F.lit(i).alias("_at")) for i, (q, w) in enumerate(zip(queries, weights, strict=True))]
    total = reduce(DataFrame.unionByName, found).groupBy(key).agg(F.round(total_of(F.col("score")), digits).alias("score"), F.sort_array(F.collect_list("_at")).alias("_at"))
    named = F.transform("_at", lambda i: F.array(*map(F.lit, names))[i])
    return total.select(key, "score", named.alias("fields")).orderBy(F.col("score").desc(), F.col(key).cast("string")).limit(k)


def fuse_text(fields: dict[str, tuple[Index, float | None]], text: str, k: int, candidate_k: int | None = None, mask: Column | None = None, digits: int = 6) -> DataFrame:
    """One text asked of several indexes, which are given by field name with their weights."""
    return fuse_queries([FieldQuery(index, text, w, name) for name, (index, w) in fields.items()], k, candidate_k, mask, digits)


def candidates(df: DataFrame, source: str, key: Column, raw: Column, *, rank: Column | None = None, weight: float = 1.0, normalizer: str = "identity", direction: str = "higher") -> DataFrame:
    """Rows of the candidate schema; a blank source is called 'source'."""
    normalizer, direction = normalizer.lower(), direction.lower()
    if normalizer not in NORMALIZERS or direction not in ("higher", "lower"):
        raise ValueError("no such normalizer or direction")
    return df.select(
        F.lit(source.strip() or "source").alias("source_name"),
        key.alias("key"),
        raw.cast("double").alias("raw_value"),
        (F.lit(None) if rank is None else rank).cast("int").alias("source_rank"),
        F.lit(float(weight)).alias("weight"),
        F.lit(normalizer).alias("normalizer"),
        F.lit(direction).alias("direction"),
    )


def hybrid_fuse(cands: DataFrame, k: int = 10, fusion: str = "rrf", rrf_k: float = 60.0, epsilon: float = 1e-6, digits: int = 6) -> DataFrame:
    """Reciprocal-rank ('rrf') or normalised-score ('score') fusion.

    Null or non-finite raw values and null keys drop out; a null or zero rank is computed per source, a negative one drops the row;
    of a key's rows in a source the best weighted one counts, then the best raw one. Sources are named in order."""
    if fusion not in ("rrf", "score"):
        raise ValueError("fusion is rrf or score")
    raw = F.col("raw_value")
    good = cands.filter(F.col("key").isNotNull() & raw.isNotNull() & ~F.isnan(raw) & (F.abs(raw) != float("inf")) & (F.coalesce("source_rank", F.lit(0)) >= 0))
    up = F.when(F.col("direction") == "lower", -raw).otherwise(raw)
    source = Window.partitionBy("source_name")
    low = F.col("direction") == "lower"
    rows = good.withColumns(
        {
            "rank": F.when(F.coalesce("source_rank", F.lit(0)) > 0, F.col("source_rank")).otherwise(F.row_number().over(source.orderBy(F.when(low, 0).otherwise(1), up.desc(), F.col("key").cast("string")))),
            "lo": F.min(raw).over(source),
            "hi": F.max(raw).over(source),
            "mean": F.avg(raw).over(source),
            "sd": F.stddev_pop(raw).over(source),
        }
    )
    n = F.col("normalizer")
    normalised = (
        F.when(n == "negative_distance", -raw)
        .when(n.isin("inverse", "inverse_distance"), 1.0 / F.greatest(F.lit(epsilon), raw + epsilon))
        .when(n == "minmax", F.when(F.col("hi") == F.col("lo"), 1.0).when(low, (F.col("hi") - raw) / (F.col("hi") - F.col("lo"))).otherwise((raw - F.col("lo")) / (F.col("hi") - F.col("lo"))))
        .when(n == "zscore", F.when(F.col("sd") == 0, 0.0).when(low, (F.col("mean") - raw) / F.col("sd")).otherwise((raw - F.col("mean")) / F.col("sd")))
        .when(n == "rank", 1.0 / F.greatest(F.col("rank"), F.lit(1)))
        .otherwise(up)
    )
    share = normalised if fusion == "score" else 1.0 / (F.lit(max(rrf_k, 1e-6)) + F.col("rank"))
    rows = rows.withColumn("normalized", share).withColumn("weighted", F.col("normalized") * F.col("weight"))
    first = Window.partitionBy("source_name", "key").orderBy(F.col("weighted").desc(), up.desc())
    one = rows.withColumn("_turn", F.row_number().over(first)).filter("_turn = 1")
    item = F.struct("source_name", "raw_value", "normalized", "weighted", "rank")
    out = one.groupBy("key").agg(F.round(F.sum("weighted"), digits).alias("score"), F.count(F.lit(1)).alias("source_count"), F.sort_array(F.collect_list(item)).alias("_items"))
    pick = lambda c: F.transform("_items", lambda x: x[c])
    out = out.select("key", "score", "source_count", pick("source_name").alias("source_names"), pick("raw_value").alias("raw_values"), pick("normalized").alias("normalized_scores"), pick("weighted").alias("weighted_scores"), pick("rank").alias("ranks"))
    return out.orderBy(F.col("score").desc(), F.col("key").cast("string")).limit(k)


def vector_distance(vector: Column, query: list[float]) -> Column:
    """Euclidean distance to a query vector, in doubles."""
    want = F.array(*[F.lit(float(x)) for x in query])
    squares = F.zip_with(vector, want, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))
