"""SimHash near-duplicates: bit-sliced comparison inside banded blocks, then connected components.

Fingerprints are 64 majority bits over the XXH64 hashes of word shingles. Two fingerprints that differ in at most
three of 64 bits agree in two whole bands of five (pigeonhole), so each distinct fingerprint goes to the ten blocks
of its band pairs, and no link is missed. In a block, fingerprints are stored as 64 vertical bit planes; one fingerprint
is held against 64 others a machine word at a time: the planes' differing bits run through carry-save counters that
saturate above the radius, and the comparison stops once all lanes are past it. Links inside a block are united at once, so a
block gives a spanning forest, never its pairs. Blocks above `tile` rows are cut into tiles, and each pair of
tiles is a unit of work: the hot block of a large group of copies is dealt over many tasks, and no pair is lost.

Components: min-label propagation with pointer jumping, each round written to the shared folder; hot vertices
meet only in joins whose large partitions adaptive execution splits, and in partial minima.

A null text has no words: its fingerprint is zero and links like any other. Equal fingerprints are one vertex;
repeated rows each get the component; the component's id is its smallest non-null doc_id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, rows_of, staged, table

SHINGLE, SEED, RADIUS, TILE = 3, 42, 3, 512
#: The five bands of a fingerprint: (shift, bits).
BANDS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
_BITS = np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of one text, as an unsigned integer."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    body = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    if n == 1:
        hashes = [xxhash.xxh64_intdigest(body, seed)]
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
        a, b = start[:n].tolist(), (start + size)[shingle - 1 :].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(body[i:j], seed) for i, j in zip(a, b, strict=True)]
    h = np.array(hashes, np.uint64)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 65_536):
        bits = np.unpackbits(h[k : k + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int((np.uint64(1) << _BITS[counts * 2 > n]).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long; digest adds the md5 of the text."""

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            fp = np.array([fingerprint(x) for x in rows_of(batch, "text")], np.uint64).view(np.int64)
            return {"doc_id": batch.column(0), "fp": fp, "digest": batch.column(batch.num_columns - 1)}

        return run

    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *[F.md5(F.coalesce(text, F.lit(""))).alias("digest")] * digest)
    return map_batches(base, make, "doc_id long, fp long" + ", digest string" * digest)


def planes(fps: np.ndarray) -> np.ndarray:
    """64 bit planes, packed 64 fingerprints to a word: shape (64, words)."""
    pad = -len(fps) % 64
    bits = np.unpackbits(np.concatenate([fps, np.zeros(pad, np.uint64)]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def close(fps: np.ndarray, plane: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each of fps a row of words whose bits tell which lanes of plane differ in at most `radius` bits."""
    one = np.uint64(1)
    digits = [np.zeros((len(fps), plane.shape[1]), np.uint64) for _ in range((radius + 1).bit_length())]
    over = np.zeros_like(digits[0])
    full = ~np.uint64(0)
    for b in range(64):
        # the carry of this plane's differing bits runs through the counter
        carry = plane[b][None, :] ^ (np.uint64(0) - ((fps >> np.uint64(b)) & one))[:, None]
        for d in digits:
            carry, d[...] = d & carry, d ^ carry
        over |= carry
        past = over.copy()  # lanes whose count is above radius
        if b % 8 == 7 and b > radius:
            past |= _above(digits, radius)
            if (past == full).all():
                return np.zeros_like(over)
    return ~(over | _above(digits, radius))


def _above(digits: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is larger than radius."""
    more, equal = np.zeros_like(digits[0]), ~np.zeros_like(digits[0])
    for k in range(len(digits) - 1, -1, -1):
        if radius >> k & 1:
            equal = equal & digits[k]
        else:
            more |= equal & digits[k]
            equal = equal & ~digits[k]
    return more


def forest(fps: np.ndarray, left: int, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links between fps; if 0 < left < len(fps), only links between the first `left` and the rest count."""
    parent = list(range(len(fps)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    split = 0 < left < len(fps)
    rows, lanes, shift = (fps[:left], fps[left:], left) if split else (fps, fps, 0)
    plane, edges = planes(lanes), []
    for k in range(0, len(rows), 256):
        got = close(rows[k : k + 256], plane, radius)
        if not got.any():
            continue
        bits = np.unpackbits(got.view(np.uint8), axis=1, bitorder="little")[:, : len(lanes)]
        for i, j in zip(*map(np.ndarray.tolist, np.nonzero(bits)), strict=True):
            if (a := i + k) != (b := j + shift) and (split or a < b) and (x := find(a)) != (y := find(b)):
                parent[max(x, y)] = min(x, y)
                edges.append((a, b))
    return edges


def _block_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, ti, tj, side, fp) sorted so: edges of each unit of work, units spanning batches included."""
    held: list[pa.RecordBatch] = []

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        unit = np.stack([rows[c].to_numpy() for c in ("block", "ti", "tj")])
        side, fps = rows["side"].to_numpy(), rows["fp"].to_numpy().view(np.uint64)
        cut = np.flatnonzero((unit[:, 1:] != unit[:, :-1]).any(0)) + 1
        starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(fps)]))
        src, dst = [], []
        for s, e in zip(starts[(ends - starts) > 1].tolist(), ends[(ends - starts) > 1].tolist(), strict=True):
            left = int((side[s:e] == 0).sum())
            if unit[1, s] != unit[2, s] and left in (0, e - s):
                continue
            for a, b in forest(fps[s:e], left):
                src.append(s + a)
                dst.append(s + b)
        if src:
            yield pa.RecordBatch.from_arrays([pa.array(fps[src].view(np.int64)), pa.array(fps[dst].view(np.int64))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        last = tuple(batch.column(batch.schema.get_field_index(c))[-1].as_py() for c in ("block", "ti", "tj"))
        unit = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("block", "ti", "tj")])
        open_at = batch.num_rows - int((unit[:, ::-1] == np.array(last)[:, None]).all(0).cumprod().sum())
        if open_at:
            yield from work(pa.Table.from_batches([*held, batch.slice(0, open_at)]))
            held = []
        held.append(batch.slice(open_at))
    if held:
        yield from work(pa.Table.from_batches(held))


def _bands(fp: Column) -> list[Column]:
    part = [F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << b) - 1)) for s, b in BANDS]
    return [(F.lit(t << 26).cast("long") + part[i] * (1 << 13) + part[j]) for t, (i, j) in enumerate(combinations(range(5), 2))]


def link_edges(spark: SparkSession, distinct: DataFrame, tile: int = TILE) -> DataFrame:
    """distinct: a written table of distinct fp. Edges (a, b) that span the components of the links of at most three bits."""
    keys = distinct.select("fp", F.explode(F.array(*_bands(F.col("fp")))).alias("block"))
    counts = keys.groupBy("block").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    large = staged(spark, counts.filter(F.col("n") > tile).select("block", F.ceil(F.col("n") / tile).cast("int").alias("tiles")), "simhash-large")
    own = F.pmod(F.xxhash64("fp"), F.coalesce(F.col("tiles"), F.lit(1))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("tiles"), F.lit(1)) - 1))
    units = (
        keys.join(large, "block", "left")
        .withColumn("own", own)
        .withColumn("other", other)
        .select("block", F.least("own", "other").alias("ti"), F.greatest("own", "other").alias("tj"), (F.col("own") > F.col("other")).cast("int").alias("side"), "fp")
    )
    dealt = units.repartition("block", "ti", "tj").sortWithinPartitions("block", "ti", "tj", "side", "fp")
    return dealt.mapInArrow(_block_edges, "a long, b long").filter("a != b")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """edges (a, b): (v, label) for every vertex, label the smallest vertex of its component."""
    both = staged(spark, edges.union(edges.select("b", "a")).toDF("a", "b").distinct(), "cc-edges")
    labels = staged(spark, both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("label")), "cc-labels")
    while True:
        seen = both.join(labels.select(F.col("v").alias("b"), F.col("label")), "b").select(F.col("a").alias("v"), "label")
        near = staged(spark, seen.union(labels.select("v", "label")).groupBy("v").agg(F.min("label").alias("label")), "cc-near")
        jump = near.join(near.select(F.col("v").alias("label"), F.col("label").alias("root")), "label").select("v", F.least("label", "root").alias("label"))
        after = staged(spark, jump, "cc-labels")
        if after.join(labels.select("v", F.col("label").alias("old")), "v").filter("label != old").limit(1).count() == 0:
            return after
        labels = after


def near_duplicates(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, fp, component_id) of every row; digest adds the md5 of the text and label, which tells components apart that share their smallest doc_id."""
    rows = staged(spark, fingerprints(docs, doc_id, text, digest), "simhash-rows")
    more = ["digest", "label"] * digest
    distinct = staged(spark, rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    edges = staged(spark, link_edges(spark, distinct), "simhash-edges")
    if edges.limit(1).count() == 0:
        return rows.join(distinct, "fp").withColumn("label", F.col("fp")).select("doc_id", "fp", F.col("low").alias("component_id"), *more)
    labels = components(spark, edges)
    known = distinct.join(labels, distinct.fp == labels.v, "left").select("fp", "low", F.coalesce("label", "fp").alias("label"))
    known = staged(spark, known, "simhash-labels")
    lows = staged(spark, known.groupBy("label").agg(F.min("low").alias("component_id")), "simhash-lows")
    of = staged(spark, known.join(lows, "label").select("fp", "component_id", "label"), "simhash-components")
    return rows.join(of, "fp").select("doc_id", "fp", "component_id", *more)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
