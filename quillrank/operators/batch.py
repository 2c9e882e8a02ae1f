"""The k best rows of many queries at once: rows meet all queries in blocks, and a task sends no more than the k best of each query.

Gains of a block's rows by term, times weights of the terms by query, is one product of matrices. Pairs of a row and a query, of which there are
as many as rows times queries, never leave the task and are never sorted whole. Queries up to PAIRS (query, term) pairs, TERMS and QUERIES
go this way; more of them go by joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

if TYPE_CHECKING:
    from .scoring import Bm25

#: Bounds of what a task holds of the queries, cells of a matrix, candidates that wait before they are cut to the k best.
PAIRS, TERMS, QUERIES, CELLS, WAIT = 200_000, 20_000, 20_000, 1_000_000, 200_000


class Asked:
    """Queries on the driver: terms in order, the queries' ids, and weights as (term, query, weight)."""

    def __init__(self, rows: list, id_type: T.DataType) -> None:
        self.terms = list(dict.fromkeys(r[1] for r in rows))
        self.ids = list(dict.fromkeys(r[0] for r in rows))
        at, of = {t: i for i, t in enumerate(self.terms)}, {q: i for i, q in enumerate(self.ids)}
        self.t = np.array([at[r[1]] for r in rows], np.int64)
        self.q = np.array([of[r[0]] for r in rows], np.int64)
        self.w = np.array([r[2] for r in rows], float)
        self.id_type = id_type
        # queries of a matrix of weights, rows of a matrix of gains
        self.step = max(1, CELLS // max(1, len(self.terms)))
        self.rows = max(1, CELLS // max(1, len(self.terms), min(self.step, len(self.ids))))

    @classmethod
    def of(cls, queries: DataFrame, k: int) -> Asked | None:
        """The (query_id, term) rows with repeats as weights; None where they are more than a task should hold."""
        wanted = queries.select("query_id", F.col("term").cast("string").alias("term")).filter("term IS NOT NULL").groupBy("query_id", "term").agg(F.count(F.lit(1)).cast("double").alias("w"))
        rows = wanted.limit(PAIRS + 1).collect()
        got = cls(rows, queries.schema["query_id"].dataType)
        return got if len(rows) <= PAIRS and len(got.terms) <= TERMS and len(got.ids) <= QUERIES and k * len(got.ids) <= 10 * WAIT else None

    def base(self, idf: np.ndarray, missing: float) -> np.ndarray:
        """What a row without any of a query's terms has, which a gain is added to."""
        return np.bincount(self.q, idf[self.t] * self.w, len(self.ids)) * missing


def frequencies(docs: DataFrame, tokens: Column, asked: Asked) -> tuple[float, float, np.ndarray]:
    """Rows, their mean length, and in how many each term stands: one scan, sums of each task."""
    m = len(asked.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(m + 2, np.int64)  # behind the terms' sums the rows and their lengths
        for batch in batches:
            for _, size, row, term in _found(batch, asked):
                sums[:m] += np.bincount(np.unique(row * m + term) % m, minlength=m) if len(term) else 0
                sums[m:] += len(size), size.sum()
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["at", "n"])

    got = np.zeros(m + 2)
    for r in docs.select(_listed(tokens)).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        got[r.at] = r.n
    return got[m], got[m + 1] / got[m] if got[m] else 0.0, got[:m]


def _listed(tokens: Column) -> Column:
    return F.coalesce(tokens, F.array().cast("array<string>")).alias("tokens")


def _found(batch: pa.RecordBatch, asked: Asked) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of rows: the first one's place, all rows' lengths, and (row in the block, term) of each token that is asked for."""
    terms = pa.array(asked.terms, pa.string())
    for a in range(0, batch.num_rows, asked.rows):
        lists = batch.column("tokens").slice(a, asked.rows)
        size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        term = pc.fill_null(pc.index_in(lists.flatten(), terms), -1).to_numpy(zero_copy_only=False)
        kept = term >= 0
        yield a, size, np.repeat(np.arange(len(size)), size)[kept], term[kept].astype(np.int64)


class Best:
    """The k best (score, key) of each query so far, ties by key."""

    def __init__(self, asked: Asked, idf: np.ndarray, missing: float, k: int, digits: int, key: pa.DataType) -> None:
        self.n, self.k, self.scale = len(asked.ids), k, 10.0**digits
        self.base = asked.base(idf, missing)
        # as many queries at a time as CELLS allow
        step = asked.step
        self.blocks = []
        for a in range(0, self.n, step):
            mine = (asked.q >= a) & (asked.q < a + step)
            weight = np.zeros((len(asked.terms), min(step, self.n - a)))
            weight[asked.t[mine], asked.q[mine] - a] = asked.w[mine]
            self.blocks.append((a, weight, (weight > 0).astype(np.float32)))
        self.least = np.full(self.n, -np.inf)
        self.pool, self.wait, self.waiting = None, [], 0
        self.key = key

    def put(self, keys: pa.Array, gains: np.ndarray, has: np.ndarray) -> None:
        """gains: of the rows that have the keys, by term; has: 1 where a row has the term, whatever its gain, else 0."""
        for a, weight, asks in self.blocks:
            score = gains @ weight + self.base[a : a + weight.shape[1]]
            score = np.trunc(score * self.scale + np.copysign(0.5, score)) / self.scale
            row, q = np.nonzero((score >= self.least[a : a + weight.shape[1]]) & (has @ asks > 0))
            if len(row):
                self.wait.append(pa.table([pa.array(q + a), pa.array(score[row, q]), keys.take(pa.array(row))], names=["q", "score", "key"]))
                self.waiting += len(row)
            if self.waiting > WAIT:
                self.cut()

    def cut(self) -> None:
        if not self.wait:
            return
        rows = pa.concat_tables([*([] if self.pool is None else [self.pool]), *self.wait]).combine_chunks()
        rows = rows.take(pc.sort_indices(rows, [("q", "ascending"), ("score", "descending"), ("key", "ascending")], null_placement="at_start"))
        q = rows.column("q").to_numpy()
        count = np.bincount(q, minlength=self.n)
        turn = np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count)
        self.pool, self.wait, self.waiting = rows.filter(pa.array(turn < self.k)), [], 0
        last = turn == self.k - 1
        self.least[q[last]] = rows.column("score").to_numpy()[last]


def _sent(blocks: Callable[[Best, Iterator[pa.RecordBatch]], None], fresh: Callable[[], Best], ids: list, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = fresh()
        blocks(best, batches)
        best.cut()
        if best.pool is not None:
            queries = pa.array(ids, schema.field("query_id").type)
            for part in best.pool.to_batches(max_chunksize=50_000):
                yield pa.RecordBatch.from_arrays([queries.take(part.column("q")), part.column("key").cast(schema.field(1).type), part.column("score")], schema=schema)

    return run


def _ranked(parts: DataFrame, key: str, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(key))
    return parts.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def _kinds(asked: Asked, key: str, kind: T.DataType) -> tuple[T.StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T.StructType([T.StructField("query_id", asked.id_type), T.StructField(key, kind), T.StructField("score", T.DoubleType())])
    return out, to_arrow_schema(out)


def from_rows(docs: DataFrame, key: str, tokens: Column, asked: Asked, params: Bm25, k: int, digits: int) -> DataFrame:
    """(query_id, key, score, rank) over rows with tokens: two scans, no row shuffled."""
    n, avgdl, df = frequencies(docs, tokens, asked)
    idf, missing, m = params.idf_of(df, n), params.missing(), len(asked.terms)
    out, arrow = _kinds(asked, key, docs.schema[key].dataType)
    kind = arrow.field(1).type

    def blocks(best: Best, batches: Iterator[pa.RecordBatch]) -> None:
        for batch in batches:
            for a, size, row, term in _found(batch, asked):
                tf = np.bincount(row * m + term, minlength=len(size) * m)
                at = np.flatnonzero(tf)
                gains = np.zeros(len(tf))
                gains[at] = idf[at % m] * (params.tfc_of(tf[at].astype(float), size[at // m].astype(float), avgdl) - missing)
                best.put(batch.column("key").slice(a, len(size)), gains.reshape(-1, m), (tf > 0).astype(np.float32).reshape(-1, m))

    fresh = lambda: Best(asked, idf, missing, k, digits, kind)
    rows = docs.select(F.col(key).alias("key"), _listed(tokens))
    return _ranked(rows.mapInArrow(_sent(blocks, fresh, asked.ids, arrow), out), key, k)


def from_postings(hits: DataFrame, key: str, df: DataFrame, asked: Asked, n: float, avgdl: float, params: Bm25, k: int, digits: int, parts: int) -> DataFrame:
    """The same over postings (term, key, tf, dl) and (term, df): postings of the asked terms go by key to `parts` tasks, a number for each term."""
    spark = hits.sparkSession
    numbers = spark.createDataFrame([(t, i) for i, t in enumerate(asked.terms)], T.StructType([T.StructField("term", T.StringType()), T.StructField("t", T.IntegerType())]))
    known = np.zeros(len(asked.terms))
    for r in df.join(F.broadcast(numbers), "term").select("t", "df").collect():  # TERMS rows at most
        known[r.t] = r.df
    idf, missing, m = params.idf_of(known, n), params.missing(), len(asked.terms)
    out, arrow = _kinds(asked, key, hits.schema[key].dataType)
    kind = arrow.field(1).type

    def blocks(best: Best, batches: Iterator[pa.RecordBatch]) -> None:
        most = asked.rows

        def whole(rows: pa.Table, start: np.ndarray) -> None:
            """Rows of complete keys, which begin at start."""
            doc = np.repeat(np.arange(len(start)), np.diff(np.append(start, rows.num_rows)))
            x = {c: rows.column(c).to_numpy() for c in ("t", "tf", "dl")}
            gain = idf[x["t"]] * (params.tfc_of(x["tf"].astype(float), x["dl"], avgdl) - missing)
            keys = rows.column("key").combine_chunks().take(pa.array(start))
            for a in range(0, len(start), most):
                mine = (doc >= a) & (doc < a + most)
                size = min(most, len(start) - a)
                at = (doc[mine] - a) * m + x["t"][mine]
                has = np.zeros(size * m, np.float32)
                has[at] = 1
                best.put(keys.slice(a, size), np.bincount(at, gain[mine], size * m).reshape(size, m), has.reshape(size, m))

        left = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if left is None else pa.concat_tables([left, rows])
            keys = rows.column("key").combine_chunks()
            start = np.append(0, 1 + np.flatnonzero(pc.fill_null(pc.not_equal(keys[1:], keys[:-1]), True).to_numpy(zero_copy_only=False)))
            left = rows.slice(int(start[-1]))
            if len(start) > 1:
                whole(rows.slice(0, int(start[-1])), start[:-1])
        if left is not None and left.num_rows:
            whole(left, np.array([0]))

    fresh = lambda: Best(asked, idf, missing, k, digits, kind)
    small = hits.join(F.broadcast(numbers), "term").select(F.col(key).alias("key"), F.col("t"), F.col("tf").cast("int").alias("tf"), F.col("dl"))
    dealt = small.repartition(parts, "key").sortWithinPartitions("key")
    return _ranked(dealt.mapInArrow(_sent(blocks, fresh, asked.ids, arrow), out), key, k)
