"""Exact top-k by inner product: M-trees searched best first.

An extra component sqrt(R^2 - |x|^2), R the largest norm in a tree, turns the largest inner product into the smallest Euclidean
distance, a metric, for which an M-tree is bulk-loaded: a node's rows are dealt to the nearest of up to `FANOUT` routing rows, level
upon level, down to leaf pages of about `LEAF` entries. A node keeps its routing row, covering radius and distance to the parent's
routing row, a leaf per entry the distance to its routing row. Trees are built once and written, a row each; a search reads the pages.

A search keeps a queue of nodes by the best score that their balls allow a small group of queries near each other. Of a node taken from
it, children and entries that the stored parent distances rule out by the triangle inequality are skipped for each query before any
distance is computed; a query whose k-th score is better than a ball allows does not enter it. Scores are integers: products
beyond what doubles hold are added up in limbs of 20 bits, a score that does not fit a long is an error, and bounds carry a margin, so
results are exact at any magnitude.

All candidates are dealt to trees of about `tree_rows` rows by hash, the trees to groups, and queries to blocks of up to `query_rows`. Each
(block, group) is a unit of work that keeps the k best of its queries; a query's lists are merged last. A task holds a block and a tree.

Vectors that are null or hold null or non-finite components take no part; shorter vectors count as padded with zeros;
ties go to the smaller id; rows with a null id take no part; repeated rows are candidates each (a query id that repeats
is answered once per row); other columns are ignored, whatever their names; an empty table gives no rows. How much the
bounds save depends on the data: see `computed` in the tests, which is near all pairs for vectors without clusters.
"""

from __future__ import annotations

import heapq
import itertools
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

K, SCALE, QUERY_MOD = 20, 64, 20
LEAF, FANOUT, GROUP, QUERY_ROWS, TREE_ROWS = 512, 16, 512, 65_536, 16_384
#: Fill up what is found of fewer than k: no score is this low, no id above.
NONE, NONE_ID = -(2**63), 2**63 - 1
LIMB = 20


def nothing(n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.full((n, k), NONE), np.full((n, k), NONE_ID)


def quantize(vectors: list, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as float64 rows, zeros behind shorter vectors; doubles hold these integers exactly."""
    width = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return np.floor(scale * out)


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows of whole doubles, as int64. Only rows with large components take the longer way."""
    out = np.empty((len(a), len(b)), np.int64)
    if not out.size:
        return out
    plain = 2.0 ** ((52 - np.ceil(np.log2(max(1, a.shape[1])))) // 2)
    la, lb = np.abs(a).max(1, initial=0.0) < plain, np.abs(b).max(1, initial=0.0) < plain
    if la.all() and lb.all():
        return (a @ b.T).astype(np.int64)
    out[np.ix_(la, lb)] = (a[la] @ b[lb].T).astype(np.int64)
    for rows, cols in ((~la, np.ones(len(b), bool)), (la, ~lb)):
        if rows.any() and cols.any():
            out[np.ix_(rows, cols)] = _limbs(a[rows], b[cols])
    return out


def _limbs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products modulo 2^64, which are the products themselves where these fit; those that may not are computed one by one."""
    most = np.abs(a) @ np.abs(b).T
    total = np.zeros((len(a), len(b)), np.uint64)
    small_a, small_b = _split(a), _split(b)
    for (i, x), (j, y) in itertools.product(enumerate(small_a), enumerate(small_b)):
        if LIMB * (i + j) < 64:
            for k in range(0, a.shape[1], 4096):  # sums of 4096 products of 40 bits are exact
                part = (x[:, k : k + 4096] @ y[:, k : k + 4096].T).astype(np.int64).view(np.uint64)
                total += part << np.uint64(LIMB * (i + j))
    out = total.view(np.int64)
    for r, c in zip(*np.nonzero(~(most < 2.0**62)), strict=True):
        exact = sum(int(p) * int(q) for p, q in zip(a[r], b[c], strict=True))
        if not NONE < exact <= NONE_ID:
            raise OverflowError("a score does not fit a long")
        out[r, c] = exact
    return out


def _split(a: np.ndarray) -> list[np.ndarray]:
    """Limbs of LIMB bits with the component's sign, the lowest first; what lies above 2^64 does not matter modulo 2^64."""
    sign, rest, out = np.sign(a), np.abs(a), []
    for _ in range(-(-64 // LIMB)):
        high = np.floor(rest / 2.0**LIMB)
        out.append(sign * (rest - high * 2.0**LIMB))
        rest = high
    return out


class Tree:
    """Nodes in arrays: routing row, covering radius, distance to the parent's routing row, and children or entries from `start` to `end`."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        norm = (self.x**2).sum(1)
        self.r2 = float(norm.max(initial=0.0))
        lifted = np.concatenate([self.x, np.sqrt(np.maximum(self.r2 - norm, 0))[:, None]], 1)
        self.pivot, self.radius, self.up, self.leaf, self.start, self.end = [], [], [], [], [], []
        entries, away = [], []
        held = 0
        waiting = []  # (node, its rows, their distances to its routing row)

        def add(pivot: int, up: float, own: np.ndarray, d: np.ndarray) -> None:
            waiting.append((len(self.pivot), own, d))
            for to, v in ((self.pivot, pivot), (self.radius, float(d.max(initial=0.0))), (self.up, up), (self.leaf, True), (self.start, 0), (self.end, 0)):
                to.append(v)

        def distances(own: np.ndarray, pivots: np.ndarray) -> np.ndarray:
            a, b = lifted[own], lifted[pivots]
            return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T, 0))

        if len(ids):
            own = np.arange(len(ids))
            middle = int(distances(own, np.array([0]))[:, 0].argmin())
            add(middle, 0.0, own, distances(own, np.array([middle]))[:, 0])
        for node, own, d in iter(lambda: waiting.pop(0) if waiting else None, None):
            order = np.argsort(d, kind="stable")
            own, d = own[order], d[order]
            parts = []
            if len(own) > leaf and d[-1] > d[0]:
                pivots = own[np.unique(np.linspace(0, len(own) - 1, min(fanout, -(-len(own) // leaf))).astype(int))]
                to = distances(own, pivots)
                near = to.argmin(1)
                parts = [(p, np.flatnonzero(near == k), to[:, k]) for k, p in enumerate(pivots.tolist())]
                parts = [(p, at, t[at]) for p, at, t in parts if len(at)]
            if len(parts) > 1:
                self.leaf[node], self.start[node] = False, len(self.pivot)
                at_of = dict(zip(own.tolist(), d.tolist(), strict=True))
                for p, at, t in parts:
                    add(p, at_of[p], own[at], t)
                self.end[node] = len(self.pivot)
            else:
                self.start[node], self.end[node] = held, held + len(own)
                entries.append(own)
                away.append(d)
                held += len(own)
        self.entries = np.concatenate(entries) if entries else np.zeros(0, int)
        self.away = np.concatenate(away) if away else np.zeros(0)
        self.up, self.radius, self.pivot = np.array(self.up), np.array(self.radius), np.array(self.pivot, int)

    def search(self, q: np.ndarray, qid: np.ndarray, best: tuple[np.ndarray, np.ndarray], group: int = GROUP) -> int:
        """Merge into best = (scores, ids), rows sorted and filled up with NONE, what this tree holds for each query; returns the scores computed."""
        if not len(self.pivot) or not len(q):
            return 0
        width = max(q.shape[1], self.x.shape[1])
        q, self.x = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) if m.shape[1] < width else m for m in (q, self.x))
        # queries near the same routing rows go together
        first = slice(self.start[0], self.end[0]) if not self.leaf[0] else slice(0, 1)
        like = q @ self.x[self.pivot[first]].T
        order = np.lexsort((like.max(1), like.argmax(1)))
        return len(q) * like.shape[1] + sum(self._group(q, qid, best, order[i : i + group]) for i in range(0, len(q), group))

    def _allows(self, q2: np.ndarray, d: np.ndarray) -> np.ndarray:
        """The largest inner product that a distance of at least d allows, with a margin."""
        return (q2 + self.r2 - np.maximum(d, 0) ** 2) / 2 + 1e-6 * (1 + np.abs(q2) + self.r2)

    def _group(self, q: np.ndarray, qid: np.ndarray, best: tuple[np.ndarray, np.ndarray], rows: np.ndarray) -> int:
        k = best[0].shape[1]
        mine = q[rows]
        q2 = (mine**2).sum(1)
        scores, found = best[0][rows], best[1][rows]
        floor = np.where(scores[:, -1] == NONE, -np.inf, scores[:, -1].astype(float))
        d = self._distance(q2, dot(mine, self.x[self.pivot[:1]]))[:, 0]
        bound = self._allows(q2, d - self.radius[0])
        queue = [(-float(bound.max()), 0, d, bound)]
        computed = len(rows)
        while queue:
            _, node, d, bound = heapq.heappop(queue)
            at = np.flatnonzero(bound >= floor)
            if not len(at):
                continue
            s, e = self.start[node], self.end[node]
            # how far from a query what it still wants can be
            need = np.sqrt(np.maximum(q2[at] + self.r2 - 2 * np.maximum(floor[at], -1e300), 0)) * (1 + 1e-9) + 1e-6 * (1 + np.sqrt(q2[at] + self.r2))
            if not self.leaf[node]:
                gap = np.abs(d[at][:, None] - self.up[None, s:e]) - self.radius[None, s:e]
                near = gap <= need[:, None]
                cols = np.flatnonzero(near.any(0))
                who = np.flatnonzero(near[:, cols].any(1))
                if not len(who):
                    continue
                kids = s + cols
                away = self._distance(q2[at[who]][:, None], dot(mine[at[who]], self.x[self.pivot[kids]]))
                computed += away.size
                for j, kid in enumerate(kids.tolist()):
                    dist, top = np.full(len(rows), np.inf), np.full(len(rows), -np.inf)
                    dist[at[who]] = away[:, j]
                    top[at[who]] = np.where(near[who, cols[j]], self._allows(q2[at[who]], away[:, j] - self.radius[kid]), -np.inf)
                    if (top >= floor).any():
                        heapq.heappush(queue, (-float(top.max()), kid, dist, top))
                continue
            own, away = self.entries[s:e], self.away[s:e]
            low, high = np.searchsorted(away, d[at] - need, "left"), np.searchsorted(away, d[at] + need, "right")
            wanted = high > low
            if not wanted.any():
                continue
            at, low, high = at[wanted], low[wanted], high[wanted]
            own = own[low.min() : high.max()]
            got = dot(mine[at], self.x[own])
            computed += got.size
            pick = (got >= floor[at][:, None]) & (self.ids[own][None, :] != qid[rows[at]][:, None])
            open_ = np.flatnonzero(pick.any(1))
            if not len(open_):
                continue
            use = np.flatnonzero(pick[open_].any(0))
            mask = pick[np.ix_(open_, use)]
            them = at[open_]
            more = np.concatenate([scores[them], np.where(mask, got[np.ix_(open_, use)], NONE)], 1)
            names = np.concatenate([found[them], np.where(mask, self.ids[own[use]][None, :], NONE_ID)], 1)
            first = np.lexsort((names, -1 - more))[:, :k]  # the complement turns the order round without overflow
            scores[them], found[them] = np.take_along_axis(more, first, 1), np.take_along_axis(names, first, 1)
            last = scores[them, -1]
            floor[them] = np.where(last == NONE, -np.inf, last.astype(float))
        best[0][rows], best[1][rows] = scores, found
        return computed

    def _distance(self, q2: np.ndarray, score: np.ndarray) -> np.ndarray:
        q2 = q2[:, None] if q2.ndim == 1 else q2
        return np.sqrt(np.maximum(q2 + self.r2 - 2 * score.astype(float), 0))


def valid_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return df.filter(F.col(vec_id).isNotNull() & v.isNotNull() & ~bad).select(F.col(vec_id).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))


def _packed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int16) if np.abs(x).max(initial=0.0) < 2**15 else x


def top_k(spark: SparkSession, candidates: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, tree_rows: int = TREE_ROWS, query_rows: int = QUERY_ROWS, units: int | None = None) -> DataFrame:
    """candidates, queries: (vec_id, v). The k best candidates of each query but the query's own id: (query_id, rank, vec_id, score).

    units: how many (block, group of trees) there are at least where there are as many trees; by default three to a core."""
    n, nq = candidates.count(), queries.count()
    tasks = units or 3 * spark.sparkContext.defaultParallelism
    trees = max(1, -(-n // min(tree_rows, max(1024, n // max(1, tasks)))))
    blocks = max(1, -(-nq // query_rows))
    groups = min(trees, max(1, -(-tasks // blocks)))

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        t = Tree(pdf["vec_id"].to_numpy(np.int64), quantize(pdf["v"].tolist(), scale))
        t.x = _packed(t.x)
        return pd.DataFrame({"at": [int(pdf["tree"].iloc[0])], "body": [pickle.dumps(t)]})

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": [int(pdf["block"].iloc[0])], "body": [pickle.dumps((pdf["vec_id"].to_numpy(np.int64), _packed(quantize(pdf["v"].tolist(), scale))))]})

    deal = lambda name, m: F.pmod(F.xxhash64("vec_id", F.hash("v")), F.lit(m)).cast("int").alias(name)
    held = lambda df, name, m, f: df.select("vec_id", "v", deal(name, m)).groupBy(name).applyInPandas(f, "at int, body binary")
    pages = staged(spark, held(candidates, "tree", trees, tree), "mtree-trees")
    asked = staged(spark, held(queries, "block", blocks, block), "mtree-queries")
    # every block meets every tree: a stated query set against all rows, in blocks
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    rows = asked.select(F.col("at").alias("block"), every(groups).alias("group"), F.lit(-1).alias("tree"), "body")
    rows = rows.unionByName(pages.select(every(blocks).alias("block"), (F.col("at") % groups).alias("group"), F.col("at").alias("tree"), "body"))
    dealt = rows.repartitionById(blocks * groups, F.col("block") * groups + F.col("group")).sortWithinPartitions("block", "group", "tree")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, q, qid, best = None, None, None, None

        def answers() -> Iterator[pa.RecordBatch]:
            for i in range(0, len(qid), 4096):
                there = best[0][i : i + 4096] != NONE
                who = np.nonzero(there)[0] + i
                columns = [pa.array(np.full(len(who), unit[0]), pa.int32()), pa.array(who, pa.int32()), pa.array(qid[who], pa.int64()), pa.array(best[1][i : i + 4096][there], pa.int64()), pa.array(best[0][i : i + 4096][there], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "who", "query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(batch.schema.get_field_index(c))[i].as_py() for c in ("block", "group", "tree", "body")}
                body = pickle.loads(r["body"])
                if r["tree"] < 0:
                    if unit is not None:
                        yield from answers()
                    unit, (qid, q) = (r["block"], r["group"]), body
                    q = q.astype(float)
                    best = nothing(len(qid), k)
                elif unit == (r["block"], r["group"]):
                    body.x = body.x.astype(float)
                    body.search(q, qid, best)
        if unit is not None:
            yield from answers()

    found = dealt.select("block", "group", "tree", "body").mapInArrow(run, "block int, who int, query_id long, vec_id long, score long")
    order = Window.partitionBy("block", "who").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = valid_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(spark, rows, rows.filter(F.col("vec_id") % QUERY_MOD == 0))


ORACLE = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.x::DOUBLE[], c.x::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {QUERY_MOD} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
