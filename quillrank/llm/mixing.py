"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

The mix is as large as the corpus. Sources, by code point with null last, weigh 1, 2, 3, repeating; a source's
target stops at `max_repeats` times its size and the excess goes to the others by weight (water filling, in closed
form over the sources sorted by size to weight). Blocks of `block` words are seats: the highest quotients
target / (2k - 1) give each source whole blocks, then in the same way each coarse shard of the source, then each
fine shard of about `shard_rows` documents. In a shard documents stand in seeded hash order, as one ring of blocks; the shard's blocks
are those from a seeded one on, all of them again for each full pass, so that few documents are cut.

An exact apportionment needs no full list of quotients: rounding each of n shares moves the sum of seats by n / 2 at
most, so the divisor lies within n / (2 * seats) of total / seats, and only quotients in that band (about 4 n
of them) are ranked. No window holds more than the sources, the square root of a source's shards, or one shard.

The order is by a hash of doc_id and text, so rows without an id are dealt like others. Rows equal in both are one entry with a count, however
many they are, and are told apart last. Null text has no words; null source is a source of its own, sorted last; repeated rows count
each; of equal quotients the smaller key wins; an empty table gives no rows; other columns pass through `keep`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, quoted, staged, table

BLOCK, SHARD_ROWS, MAX_REPEATS, SEED, WEIGHTS, COPIES = 32, 256, 3, "mix", 3, 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def apportion(df: DataFrame, weight: str, seats: str, key: str, group: list[str], out: str) -> DataFrame:
    """Add column `out`: seats that Sainte-Laguë gives each row among the rows with the same group. Ties go to the smaller key."""
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    w, s = F.col(weight).cast("double"), F.col(seats).cast("double")
    share = F.when((F.col("_w") > 0) & (s > 0), w * s / F.col("_w")).otherwise(0.0)
    slack = F.when(s > 0, F.col("_s") * F.col("_n") / (2.0 * s)).otherwise(0.0)
    names = df.columns
    df = (
        df.withColumns({"_w": F.sum(w).over(whole), "_n": F.count(F.lit(1)).over(whole).cast("double")})
        .withColumn("_s", share)
        .withColumn("_lo", F.greatest(F.lit(0), F.floor(F.col("_s") - slack - 0.5)).cast("long"))
        .withColumn("_hi", F.ceil(F.col("_s") + slack + 0.5).cast("long") + 1)
        .withColumn("_left", F.col(seats) - F.sum("_lo").over(whole))
    )
    ranked = Window.partitionBy(*(group or [F.lit(0)])).orderBy(F.col("_q").desc(), F.col(key), F.col("_k"))
    return (
        df.withColumn("_k", F.explode(F.sequence(F.col("_lo") + 1, F.col("_hi") + 1)))
        .withColumn("_q", w / (2 * F.col("_k") - 1).cast("double"))
        .withColumn("_won", (F.row_number().over(ranked) <= F.col("_left")) & (F.col("_w") > 0))
        .groupBy(*names)
        .agg((F.min("_lo") + F.sum(F.col("_won").cast("long"))).alias(out))
    )


def targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS, weights: int = WEIGHTS) -> DataFrame:
    """sizes (source, source_size, n) with weight and target by water filling; source is null or text."""
    one = Window.partitionBy(F.lit(0))
    by = one.orderBy(F.col("source").isNull(), "source")
    full = one.orderBy(F.lit(max_repeats) * F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    cap = F.lit(max_repeats) * F.col("source_size")
    return (
        sizes.withColumn("weight", (F.row_number().over(by) - 1) % weights + 1)
        .withColumns(
            {
                "total": F.sum("source_size").over(one),
                "capped": F.coalesce(F.sum(cap).over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
                "rest": F.sum("weight").over(full.rowsBetween(0, Window.unboundedFollowing)),
                "turn": F.row_number().over(full),
            }
        )
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("rest"))
        .withColumn("free", cap * F.col("rest") > (F.col("total") - F.col("capped")) * F.col("weight"))
        .withColumn("level", F.min_by("level", F.when(F.col("free"), F.col("turn"))).over(one))
        .withColumn("target", F.least(cap.cast("double"), F.coalesce(F.col("level") * F.col("weight"), cap.cast("double"))))
        .select("source", "source_size", "n", "weight", "total", "target")
    )


def keyed(docs: DataFrame, doc_id: str, text: str, source: str, seed: str) -> DataFrame:
    """docs with _source (null kept apart), _size and the seeded order _h."""
    return docs.withColumns(
        {
            "_source": F.col(source).cast("string"),
            "_size": word_count(F.col(text)),
            "_h": F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit(""))))),
        }
    )


def mix(spark: SparkSession, docs: DataFrame, keep: list[str], *, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, shard_rows: int = SHARD_ROWS, max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """The kept columns of every document with size, source_size, target and taken."""
    rows = keyed(docs, doc_id, text, source, seed)
    narrow = set(keep) <= {doc_id}
    same = [*([doc_id] if narrow else []), "_source", "_size", "_h"]
    # rows equal in all of these are one entry with a count
    base = staged(spark, rows.groupBy(*same).agg(F.count(F.lit(1)).alias("_m")), "mix-rows")
    sizes = base.groupBy(F.col("_source").alias("source")).agg(F.sum(F.col("_size") * F.col("_m")).alias("source_size"), F.sum("_m").alias("n"))
    fine = F.ceil(F.col("n") / F.lit(shard_rows))
    sources = (
        targets(sizes, max_repeats)
        .withColumn("seats", F.round(F.col("total") / F.lit(float(block))).cast("long"))
        .withColumn("coarse", F.ceil(F.sqrt(fine)).cast("long"))
        .withColumn("fine", F.ceil(fine / F.col("coarse")).cast("long"))
    )
    sources = staged(spark, apportion(sources, "target", "seats", "source", [], "blocks"), "mix-sources")
    plan = sources.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_key"), "source_size", "target", "coarse", "fine", "blocks")
    part = lambda at, n: F.conv(F.substring("_h", at, 8), 16, 10).cast("long") % F.col(n)
    placed = lambda df: (
        df.withColumn("_key", F.coalesce(F.concat(F.lit("s"), "_source"), F.lit("n"))).join(plan, "_key").withColumns({"_c": part(1, "coarse"), "_f": part(9, "fine")})
    )
    shards = staged(spark, placed(base).groupBy("_key", "_c", "_f", "blocks").agg(F.sum(F.col("_size") * F.col("_m")).alias("words")), "mix-shards")
    coarse = apportion(shards.groupBy("_key", "_c", "blocks").agg(F.sum("words").alias("words")), "words", "blocks", "_c", ["_key"], "quota")
    renamed = coarse.select(F.col("_key").alias("k"), F.col("_c").alias("c"), "quota")
    inner = shards.select(F.col("_key").alias("k"), F.col("_c").alias("c"), F.col("_f").alias("f"), "words").join(renamed, ["k", "c"])
    inner = apportion(inner, "words", "quota", "f", ["k", "c"], "own").withColumn("out", F.least(F.col("own") * block, F.col("words") * max_repeats))
    inner = staged(spark, inner.select(F.col("k").alias("_key"), F.col("c").alias("_c"), F.col("f").alias("_f"), "words", "out"), "mix-quotas")
    order = Window.partitionBy("_key", "_c", "_f").orderBy("_h", "_size").rowsBetween(Window.unboundedPreceding, -1)
    seat = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "_key", F.col("_c").cast("string"), F.col("_f").cast("string"))), 1, 8), 16, 10).cast("long")
    spans = (
        placed(base)
        .join(inner, ["_key", "_c", "_f"])
        .withColumn("_before", F.coalesce(F.sum(F.col("_size") * F.col("_m")).over(order), F.lit(0)))
        .withColumn("_passes", F.when(F.col("words") > 0, F.floor(F.col("out") / F.col("words"))).otherwise(0).cast("long"))
        .withColumn("_long", F.col("out") - F.col("_passes") * F.col("words"))
        .withColumn("_start", F.lit(block) * (seat % F.greatest(F.lit(1), F.floor(F.col("words") / block))))
        .select(*same, "_m", "source_size", "target", "words", "_before", "_passes", "_long", "_start")
    )
    if narrow:  # nothing else tells equal rows apart: they are made from their count, a bounded array at a time
        pieces = spans.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("_m") - 1) / COPIES))))
        last = F.least(F.col("_m"), (F.col("_piece") + 1) * COPIES) - 1
        each = pieces.withColumn("_j", F.explode(F.sequence(F.col("_piece") * COPIES, last)))
    else:
        # one name for both sides, so that the rows are dealt once for the join and for telling equal ones apart
        name = lambda h, source, size: F.concat_ws(":", h, size, F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))).alias("_k")
        spans = staged(spark, spans.select(name("_h", "_source", "_size"), "_m", F.col("_size").alias("_z"), *spans.columns[len(same) + 1 :]), "mix-spans")
        each = rows.select(*[F.col(quoted(c)) for c in keep], name("_h", "_source", "_size")).join(spans, "_k").withColumnRenamed("_z", "_size")
        each = each.withColumn("_j", F.when(F.col("_m") > 1, F.row_number().over(Window.partitionBy("_k").orderBy("_m")) - 1).otherwise(0))
    at, end = F.col("_at"), F.col("_at") + F.col("_size")
    far = F.col("_start") + F.col("_long")  # where the shard's blocks end, beyond its last word if they go round
    part = F.greatest(F.lit(0), F.least(end, far) - F.greatest(at, F.col("_start"))) + F.greatest(F.lit(0), F.least(end, far - F.col("words")) - at)
    return each.withColumn("_at", F.col("_before") + F.col("_j") * F.col("_size")).select(*[F.col(quoted(c)) for c in keep], F.col("_size").alias("size"), "source_size", "target", (F.col("_passes") * F.col("_size") + part).cast("long").alias("taken"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, table(spark, sf_dir, "documents"), ["doc_id"])


def _seats(inner: str, weight: str, seats: str, key: str, group: str, cols: str, out: str) -> str:
    """DuckDB for apportion(): a subquery with cols, group's columns included, and out."""
    over = f"PARTITION BY {group}" if group else ""
    comma = f"{cols}," if cols else ""
    return f"""(SELECT {comma} min(lo) + sum(CASE WHEN turn <= rest AND w > 0 THEN 1 ELSE 0 END)::BIGINT AS {out} FROM (
      SELECT *, row_number() OVER ({over} ORDER BY {weight}::DOUBLE / (2 * kk - 1)::DOUBLE DESC, {key} NULLS FIRST, kk) AS turn FROM (
        SELECT *, unnest(range(lo + 1, hi + 2)) AS kk FROM (
          SELECT *, {seats} - sum(lo) OVER ({over}) AS rest FROM (
            SELECT *, greatest(0, floor(s - slack - 0.5))::BIGINT AS lo, ceil(s + slack + 0.5)::BIGINT + 1 AS hi FROM (
              SELECT *, CASE WHEN {seats} > 0 THEN s * np / (2.0::DOUBLE * {seats}::DOUBLE) ELSE 0 END AS slack FROM (
                SELECT *, CASE WHEN w > 0 AND {seats} > 0 THEN {weight}::DOUBLE * {seats}::DOUBLE / w ELSE 0 END AS s FROM (
                  SELECT *, sum({weight}::DOUBLE) OVER ({over}) AS w, count(*) OVER ({over})::DOUBLE AS np FROM {inner}))))))) GROUP BY {cols})"""


ORACLE = f"""
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS h FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM base GROUP BY source),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {WEIGHTS} + 1 AS weight FROM sizes),
filled AS (
  SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum({MAX_REPEATS} * source_size) OVER (ORDER BY ({MAX_REPEATS} * source_size)::DOUBLE / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(weight) OVER (ORDER BY ({MAX_REPEATS} * source_size)::DOUBLE / weight::DOUBLE, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
    row_number() OVER (ORDER BY ({MAX_REPEATS} * source_size)::DOUBLE / weight::DOUBLE, source NULLS LAST) AS turn
  FROM weighed),
lev AS (SELECT min_by((total - capped)::DOUBLE / rest::DOUBLE, turn) AS level FROM filled WHERE {MAX_REPEATS} * source_size * rest > (total - capped) * weight),
tgt AS (
  SELECT source, source_size, n, least(({MAX_REPEATS} * source_size)::DOUBLE, coalesce((SELECT level FROM lev) * weight, ({MAX_REPEATS} * source_size)::DOUBLE)) AS target,
    round(total::DOUBLE / {BLOCK}.0::DOUBLE)::BIGINT AS seats, ceil(sqrt(ceil(n::DOUBLE / {SHARD_ROWS})))::BIGINT AS coarse FROM filled),
src AS {_seats("(SELECT source AS src_name, source_size AS ss, n AS rows_n, target AS tt, seats AS st, coarse AS cs, target, seats, source FROM tgt)", "target", "seats", "source", "", "src_name, ss, rows_n, tt, cs", "blocks")},
plan AS (SELECT coalesce('s' || src_name, 'n') AS key, ss AS source_size, tt AS target, cs AS coarse, ceil(ceil(rows_n::DOUBLE / {SHARD_ROWS}) / cs)::BIGINT AS fine, blocks FROM src),
placed AS (
  SELECT doc_id, size, h, p.*, ('0x' || substr(h, 1, 8))::BIGINT % coarse AS c, ('0x' || substr(h, 9, 8))::BIGINT % fine AS f
  FROM base JOIN plan p ON p.key = coalesce('s' || base.source, 'n')),
shards AS (SELECT key, c, f, blocks, sum(size)::BIGINT AS words FROM placed GROUP BY ALL),
cq AS {_seats("(SELECT key, c, blocks, sum(words)::BIGINT AS words FROM shards GROUP BY ALL)", "words", "blocks", "c", "key", "key, c", "quota")},
fq AS {_seats("(SELECT key, c, f, words, quota FROM shards JOIN cq USING (key, c))", "words", "quota", "f", "key, c", "key, c, f, words", "own")},
quotas AS (SELECT key, c, f, words, least(own * {BLOCK}, words * {MAX_REPEATS}) AS out FROM fq),
taking AS (
  SELECT placed.*, words, out, CASE WHEN words > 0 THEN out // words ELSE 0 END AS passes,
    {BLOCK} * (('0x' || substr(md5('{SEED}:' || key || ':' || c || ':' || f), 1, 8))::BIGINT % greatest(1, words // {BLOCK})) AS start,
    coalesce(sum(size) OVER (PARTITION BY key, c, f ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS began
  FROM placed JOIN quotas USING (key, c, f)),
ring AS (SELECT *, start + out - passes * words AS far FROM taking)
SELECT doc_id, size, source_size, target, (passes * size + greatest(0, least(began + size, far) - greatest(began, start)) + greatest(0, least(began + size, far - words) - began))::BIGINT AS taken FROM ring
"""
