"""Byte-balanced sharding of indivisible groups by Karmarkar-Karp differencing.

Rows with equal texts form a group that stays whole. Groups are dealt to chunks by hash; in each chunk the multiway
differencing method keeps a heap of partial partitions (sums of `shards` parts), takes the two with the largest
spread, joins them oppositely ordered, and ends with one partial partition of small spread. The chunks' partial
partitions are dealt to chunks and differenced in the same way, level upon level, until at most `top` are left, which the driver
differences: a chunk has about `chunk_rows` members at every level, whatever the input. Slots are numbered by task and, by the counts
of (shard, task), across tasks, so that no task ever holds a shard.

A group that alone outweighs a shard's part stays whole too, and its shard is then the largest: equal texts are never
parted. A null text has no bytes and groups with the other null texts only; ties fall by group hash, slots in no order that rows
have; repeated rows get a slot each; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, staged, starts, table

SHARDS, CHUNK_ROWS, TOP = 8, 256, 4096


def difference(sums: list[list[int]]) -> list[list[int]]:
    """Karmarkar-Karp over partial partitions (each a list of part sums): for each, the final part of each of its parts."""
    if not sums:
        return []
    k = len(sums[0])
    heap, members = [], {}
    for i, parts in enumerate(sums):
        order = sorted(range(k), key=lambda j: (-parts[j], j))
        low = parts[order[-1]]
        # a node: part sums in falling order; lists of (input, part) for each
        members[i] = [[(i, j)] for j in order]
        heap.append((low - parts[order[0]], i, [parts[j] for j in order]))
    heapq.heapify(heap)
    fresh = len(sums)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        ma, mb = members.pop(a), members.pop(b)
        both = [x[j] + y[k - 1 - j] for j in range(k)]
        order = sorted(range(k), key=lambda j: (-both[j], j))
        joined = []
        for j in order:
            one, two = ma[j], mb[k - 1 - j]
            if len(one) < len(two):
                one, two = two, one
            one.extend(two)
            joined.append(one)
        members[fresh] = joined
        both = [both[j] for j in order]
        heapq.heappush(heap, (both[-1] - both[0], fresh, both))
        fresh += 1
    out = [[0] * k for _ in sums]
    for part, held in enumerate(members[heap[0][1]]):
        for i, j in held:
            out[i][j] = part
    return out


def karmarkar_karp(sizes: list[int], shards: int) -> list[int]:
    """The part of each size."""
    return [x[0] for x in difference([[s] + [0] * (shards - 1) for s in sizes])]


def shard_groups(spark: SparkSession, groups: DataFrame, shards: int = SHARDS, chunk_rows: int = CHUNK_ROWS, top: int = TOP) -> DataFrame:
    """groups (gid text, bytes long), a written table with one row per group; returns (gid, shard)."""
    chunks = max(1, -(-groups.count() // chunk_rows))

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "gid"], ascending=[False, True], kind="stable")
        part = karmarkar_karp(pdf["bytes"].tolist(), shards)
        return pd.DataFrame({"unit": pdf["unit"], "gid": pdf["gid"], "bytes": pdf["bytes"], "part": part})

    dealt = groups.withColumn("unit", F.pmod(F.xxhash64("gid"), F.lit(chunks))).groupBy("unit")
    local = staged(spark, dealt.applyInPandas(deal, "unit long, gid string, bytes long, part int"), "shard-parts")

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        sums: dict[int, list[int]] = {}
        for u, p, b in zip(pdf["unit"], pdf["part"], pdf["bytes"], strict=True):
            sums.setdefault(u, [0] * shards)[p] += b
        units = sorted(sums)
        rows = [(pdf["up"].iloc[0], u, p, to, sums[u][p]) for u, own in zip(units, difference([sums[u] for u in units]), strict=True) for p, to in enumerate(own)]
        return pd.DataFrame(rows, columns=["up", "unit", "part", "up_part", "bytes"])

    levels: list[DataFrame] = []
    while chunks > top:
        chunks = -(-chunks // chunk_rows)
        below = local if not levels else levels[-1].select(F.col("up").alias("unit"), F.col("up_part").alias("part"), "bytes")
        sums = below.groupBy("unit", "part").agg(F.sum("bytes").alias("bytes")).withColumn("up", F.pmod(F.xxhash64("unit", F.lit(len(levels))), F.lit(chunks)))
        levels.append(staged(spark, sums.groupBy("up").applyInPandas(again, "up long, unit long, part int, up_part int, bytes long"), "shard-level"))
    last = local if not levels else levels[-1].select(F.col("up").alias("unit"), F.col("up_part").alias("part"), "bytes")
    sums = {}
    for r in last.groupBy("unit", "part").agg(F.sum("bytes").alias("b")).collect():  # top * shards rows at most
        sums.setdefault(r.unit, [0] * shards)[r.part] = r.b
    ids = sorted(sums)
    final = [(c, j, p) for c, parts in zip(ids, difference([sums[c] for c in ids]), strict=True) for j, p in enumerate(parts)]
    where = spark.createDataFrame(final, "unit long, part int, shard int")
    for level in reversed(levels):
        up = where.select(F.col("unit").alias("up"), F.col("part").alias("up_part"), "shard")
        where = level.join(up, ["up", "up_part"]).select("unit", "part", "shard")
    return local.join(where, ["unit", "part"]).select("gid", "shard")


def shard_documents(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = staged(
        spark,
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.coalesce(F.md5(F.col(text)), F.lit("null")).alias("gid"),
        ),
        "shard-rows",
    )
    groups = staged(spark, rows.groupBy("gid", "size").agg(F.sum("size").alias("bytes")).select(F.concat_ws(":", "gid", "size").alias("gid"), "bytes"), "shard-groups")
    where = staged(spark, shard_groups(spark, groups, shards), "shard-groups-dealt")
    placed = rows.withColumn("gid", F.concat_ws(":", "gid", "size")).join(where, "gid").select("doc_id", "size", "text_crc32", "shard")
    placed = staged(spark, numbered(placed, "shard"), "shard-placed")
    first = staged(spark, starts(placed, "shard"), "shard-starts")
    return placed.join(first, ["shard", "_task"]).select("doc_id", "size", "text_crc32", "shard", (F.col("_first") + F.col("_turn")).cast("long").alias("slot"))


def op4_shard_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
