"""BM25 in five term-frequency and five IDF variants, as Columns; scoring without an index, and top-k.

A query of m distinct terms needs dl and m term counts of each row, which one narrow pass computes without any shuffle, a row's
tokens once; document frequencies are one global aggregate of m numbers, joined back as a single row. Top-k is Spark's bounded
TakeOrderedAndProject. Terms that a prefix begins are a table, joined.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.querylang import Query, match, parse
from . import batch

METHODS = ("robertson", "lucene", "atire", "bm25l", "bm25+")


@dataclass(frozen=True)
class Bm25:
    method: str = "lucene"
    idf_method: str = ""
    k1: float = 1.5
    b: float = 0.75
    delta: float = 0.5

    def __post_init__(self) -> None:
        object.__setattr__(self, "idf_method", self.idf_method or self.method)
        if self.method not in METHODS or self.idf_method not in METHODS:
            raise ValueError(f"method and idf_method are of {METHODS}")
        limit = 3.4028234663852886e38
        if not (0 <= self.k1 <= limit and 0 <= self.b <= 1 and 0 <= self.delta <= limit) or any(map(math.isnan, (self.k1, self.b, self.delta))):
            raise ValueError("k1 and delta are finite and not negative, b is from 0 to 1")

    def tfc(self, tf: Column, dl: Column, avgdl: Column) -> Column:
        norm = F.lit(1 - self.b) + self.b * F.when(avgdl > 0, dl / avgdl).otherwise(0.0)
        k1 = self.k1
        if self.method in ("robertson", "lucene"):
            return F.when(tf > 0, tf / (k1 * norm + tf)).otherwise(0.0)
        if self.method == "atire":
            return F.when(tf > 0, tf * (k1 + 1) / (tf + k1 * norm)).otherwise(0.0)
        if self.method == "bm25l":
            c = F.when(norm > 0, tf / norm).otherwise(0.0)
            return (k1 + 1) * (c + self.delta) / (k1 + c + self.delta)
        return F.when(tf > 0, (k1 + 1) * tf / (k1 * norm + tf)).otherwise(0.0) + self.delta

    def missing(self) -> float:
        """tfc of a term that a document lacks."""
        return {"bm25l": (self.k1 + 1) * self.delta / (self.k1 + self.delta) if self.k1 + self.delta else 0.0, "bm25+": self.delta}.get(self.method, 0.0)

    def idf(self, df: Column, n: Column) -> Column:
        rest = (n - df + 0.5) / (df + 0.5)
        return {
            "robertson": F.log(F.greatest(F.lit(1.0), rest)),
            "lucene": F.log(1 + rest),
            "atire": F.log(n / df),
            "bm25l": F.log((n + 1) / (df + 0.5)),
            "bm25+": F.log((n + 1) / df),
        }[self.idf_method]

    def tfc_of(self, tf: np.ndarray, dl: np.ndarray, avgdl: float) -> np.ndarray:
        """tfc() of numbers, tf above zero."""
        norm = (1 - self.b) + self.b * (dl / avgdl if avgdl > 0 else np.zeros(len(dl)))
        k1 = self.k1
        if self.method in ("robertson", "lucene"):
            return tf / (k1 * norm + tf)
        if self.method == "atire":
            return tf * (k1 + 1) / (tf + k1 * norm)
        if self.method == "bm25l":
            c = np.divide(tf, norm, out=np.zeros(len(tf)), where=norm > 0)
            return (k1 + 1) * (c + self.delta) / (k1 + c + self.delta)
        return (k1 + 1) * tf / (k1 * norm + tf) + self.delta

    def idf_of(self, df: np.ndarray, n: float) -> np.ndarray:
        """idf() of numbers; zero for a term that no row has."""
        known, out = df > 0, np.zeros(len(df))
        x = df[known]
        rest = (n - x + 0.5) / (x + 0.5)
        out[known] = np.log({"robertson": np.maximum(1.0, rest), "lucene": 1 + rest, "atire": n / x, "bm25l": (n + 1) / (x + 0.5), "bm25+": (n + 1) / x}[self.idf_method])
        return out


@dataclass(frozen=True)
class Part:
    """One token stream with its query terms: several of them are fields, which share one length and are scored in one pass."""

    tokens: Column
    weights: dict[str, float]
    factor: float = 1.0


def _count(tokens: Column, term: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t == F.lit(term))).cast("double")


def _counted(docs: DataFrame, parts: list[Part], hit: Callable[[Column], Column] | None) -> DataFrame:
    """docs with _dl, _tfs (term counts of all parts in order) and _hit; a generator computes them once a row, and no filter moves below it."""
    none = F.array().cast("array<string>")

    def numbers(streams: Column) -> Column:
        own = [streams[i] for i in range(len(parts))]
        counts = [_count(t, w) for t, p in zip(own, parts, strict=True) for w in p.weights]
        size = sum((F.size(t) for t in own[1:]), F.size(own[0])).cast("double")
        return F.struct(size.alias("_dl"), F.array(*counts).cast("array<double>").alias("_tfs"), (hit(own[0]) if hit else F.lit(True)).alias("_hit"))

    streams = F.array(F.array(*[F.coalesce(p.tokens, none) for p in parts]))
    return docs.select("*", F.inline(F.transform(streams, numbers)))


def score_parts(docs: DataFrame, parts: list[Part], params: Bm25, *, mask: Column | None = None, corpus: DataFrame | None = None, hit: Callable[[Column], Column] | None = None) -> DataFrame:
    """docs with `score`: over the parts, factor times BM25 with the part's own document frequencies. One scan for the statistics, one for the scores.

    corpus: rows that the statistics come from, by default docs. hit: of the first part's tokens, which rows are kept (statistics stay those of all)."""
    rows = _counted(docs, parts, hit)
    of = rows if corpus is None else _counted(corpus, parts, None)
    m = sum(len(p.weights) for p in parts)
    stats = of.agg(
        F.count(F.lit(1)).cast("double").alias("_n"),
        F.coalesce(F.avg("_dl"), F.lit(0.0)).alias("_avgdl"),
        F.array(*[F.coalesce(F.sum((F.col("_tfs")[i] > 0).cast("double")), F.lit(0.0)) for i in range(m)]).cast("array<double>").alias("_df"),
    )
    rows = rows.filter("_hit").crossJoin(F.broadcast(stats))  # statistics are one row by construction: a global aggregate
    gain, base, i = F.lit(0.0), F.lit(0.0), 0
    for part in parts:
        for w in part.weights.values():
            df = F.col("_df")[i]
            idf = F.when(df > 0, params.idf(df, F.col("_n"))).otherwise(0.0) * float(w * part.factor)
            gain = gain + idf * (params.tfc(F.col("_tfs")[i], F.col("_dl"), F.col("_avgdl")) - params.missing())
            base = base + idf * params.missing()
            i += 1
    return rows.withColumn("score", (gain if mask is None else gain * mask) + base).drop("_dl", "_tfs", "_hit", "_n", "_avgdl", "_df")


def score_rows(docs: DataFrame, tokens: Column, weights: dict[str, float], params: Bm25, *, mask: Column | None = None, corpus: DataFrame | None = None, hit: Callable[[Column], Column] | None = None) -> DataFrame:
    """docs with `score` for weighted terms."""
    return score_parts(docs, [Part(tokens, weights)], params, mask=mask, corpus=corpus, hit=hit)


def rank(docs: DataFrame, tokens: Column, query: str | Query, params: Bm25 | None = None, *, corpus: DataFrame | None = None, mask: Column | None = None, normalize=None, key: str = "doc_id") -> DataFrame:
    """docs that answer the query, with `score`; a query of plain terms keeps documents without a match at score 0.

    A prefix scores as each vocabulary term that it begins, once: those terms are counted and joined as a table, whatever their number.
    Only then is `key` used: it names a row."""
    q = query if isinstance(query, Query) else parse(query, normalize)
    hit = None if q.simple else lambda t: match(q.root, t)
    if q.prefixes:
        return _rank_prefixes(docs, tokens, q, params or Bm25(), corpus, mask, hit, key)
    return score_rows(docs, tokens, dict(Counter(q.terms)), params or Bm25(), mask=mask, corpus=corpus, hit=hit)


def _rank_prefixes(docs: DataFrame, tokens: Column, q: Query, params: Bm25, corpus: DataFrame | None, mask: Column | None, hit, key: str) -> DataFrame:
    """Rows keep the (term, count) pairs that the query touches; document frequencies of these terms are a table that the pairs are joined to."""
    plain = Counter(q.terms)
    none = F.array().cast("array<string>")

    def weight(t: Column) -> Column:
        w = F.lit(0.0)
        for x, n in plain.items():
            w = w + F.when(t == x, float(n)).otherwise(0.0)
        for p in q.prefixes:
            w = w + F.when(t.startswith(p), 1.0).otherwise(0.0)
        return w

    def numbers(t: Column) -> Column:
        return F.struct(F.size(t).cast("double").alias("_dl"), F.array_sort(F.filter(t, lambda x: weight(x) > 0)).alias("_mine"), (hit(t) if hit else F.lit(True)).alias("_hit"))

    counted = lambda df: df.select("*", F.inline(F.transform(F.array(F.coalesce(tokens, none)), numbers)))
    rows = counted(docs)
    of = rows if corpus is None else counted(corpus)
    stats = of.agg(F.count(F.lit(1)).cast("double").alias("_n"), F.coalesce(F.avg("_dl"), F.lit(0.0)).alias("_avgdl"))
    idf = of.select(F.explode(F.array_distinct("_mine")).alias("_term")).groupBy("_term").agg(F.count(F.lit(1)).cast("double").alias("_df")).crossJoin(F.broadcast(stats))
    idf = idf.select("_term", "_avgdl", (params.idf(F.col("_df"), F.col("_n")) * weight(F.col("_term"))).alias("_idf"))
    pairs = rows.select(key, "_dl", F.explode("_mine").alias("_term")).groupBy(key, "_dl", "_term").agg(F.count(F.lit(1)).cast("double").alias("_tf"))
    gain = pairs.join(idf, "_term").groupBy(key).agg(F.sum(F.col("_idf") * (params.tfc(F.col("_tf"), F.col("_dl"), F.col("_avgdl")) - params.missing())).alias("_gain"))
    base = idf.agg(F.coalesce(F.sum("_idf"), F.lit(0.0)).alias("_base"))
    out = rows.filter("_hit").join(gain, key, "left").crossJoin(F.broadcast(base))  # one row
    got = F.coalesce("_gain", F.lit(0.0))
    return out.withColumn("score", (got if mask is None else got * mask) + F.col("_base") * params.missing()).drop("_dl", "_mine", "_hit", "_gain", "_base")


def top_k(scored: DataFrame, key: str, k: int, digits: int | None = None) -> DataFrame:
    """The k best rows, ties by key; k below 1 is an error."""
    if k is None or k < 1:
        raise ValueError("k is positive")
    if digits is not None:
        scored = scored.withColumn("score", F.round("score", digits))
    return scored.orderBy(F.col("score").desc(), F.col(key)).limit(k)


def batch_rank(docs: DataFrame, key: str, tokens: Column, queries: DataFrame, params: Bm25, k: int, digits: int = 6) -> DataFrame:
    """queries (query_id, term): the k best of the documents that hold a term of each, (query_id, key, score, rank).

    Two scans, in which rows meet all queries and only the k best of each leave a task. Too many queries for that, or rows that share a key, go by
    joins: postings of query terms alone are shuffled, after a map-side count; the per-query limit is applied before its exchange."""
    asked = batch.Asked.of(queries, k)
    if asked is not None and not docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():
        return batch.from_rows(docs, key, tokens, asked, params, k, digits)
    rows = docs.select(key, tokens.alias("_t")).withColumn("dl", F.size("_t").cast("double"))
    stats = rows.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("dl").alias("avgdl"))
    terms = queries.select("term").distinct()
    tf = rows.select(key, "dl", F.explode("_t").alias("term")).join(terms, "term", "left_semi").groupBy(key, "dl", "term").agg(F.count(F.lit(1)).cast("double").alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    return score_batch(tf, df.crossJoin(F.broadcast(stats)), key, queries, params, k, digits)  # one row of statistics


def score_batch(tf: DataFrame, df: DataFrame, key: str, queries: DataFrame, params: Bm25, k: int, digits: int = 6) -> DataFrame:
    """tf (key, term, tf, dl), df (term, df, n, avgdl), queries (query_id, term). A document's score has the base of its query's absent terms, too."""
    from pyspark.sql import Window

    wanted = queries.groupBy("query_id", "term").agg(F.count(F.lit(1)).cast("double").alias("w"))
    idf = df.select("term", "avgdl", params.idf(F.col("df"), F.col("n")).alias("idf"))
    impact = tf.join(idf, "term").select(key, "term", (F.col("idf") * (params.tfc(F.col("tf"), F.col("dl"), F.col("avgdl")) - params.missing())).alias("impact"))
    scored = impact.join(wanted, "term").groupBy("query_id", key).agg(F.sum(F.col("impact") * F.col("w")).alias("score"))
    if params.missing():
        base = wanted.join(idf, "term").groupBy("query_id").agg((F.sum(F.col("idf") * F.col("w")) * params.missing()).alias("_base"))
        scored = scored.join(base, "query_id").withColumn("score", F.col("score") + F.col("_base")).drop("_base")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(key))
    return scored.withColumn("score", F.round("score", digits)).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
