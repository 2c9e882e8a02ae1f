"""A corpus pipeline: language ID, toxicity, near-duplicates, source mix, packing; each stage works on what the one before kept.

STAGES are (name, function) with functions of (spark, docs, sf_dir); all but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillrank.llm import langid, mixing, packing, simhash, toxicity
from quillrank.llm.common import mark, quoted, release, staged, table


def whole(docs: DataFrame) -> Column:
    """The row as one struct, so that no column of the input can clash with what an operator adds."""
    return F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("_row")


def ordered(docs: DataFrame) -> Column:
    """A number that orders rows of one id and text by what else they hold, of any type."""
    rest = [F.col(quoted(c)) for c in docs.columns if c not in ("doc_id", "text")]
    return F.xxhash64(F.to_json(F.struct(*rest)) if rest else F.lit("")).alias("_order")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models accept; the stage fits on its own input."""
    return langid.identify(docs, langid.fit(docs), keep=[whole(docs)]).filter("NOT rejected").select("_row.*")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; the lexicon is learned from the labelled rows of the stage's input."""
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, lexicon, keep=[whole(docs)]).filter("predicted = 0").select("_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-copies, that with the smallest doc_id, whatever other groups share that id; rows without an id come last in theirs."""
    found = simhash.near_duplicates(spark, docs, digest=True)
    first = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("_first")).select("_first.*")
    key = lambda digest: F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit(":"), digest).alias("_id")
    stays = staged(spark, first.select(key(F.col("digest"))), "dedup-stays")
    keyed = docs.select(whole(docs), ordered(docs), key(F.md5(F.coalesce("text", F.lit("")))))
    # rows with the same id and text are cut down to one in each task before they are shuffled
    one = Window.partitionBy("_id").orderBy("_order")
    return keyed.withColumn("_turn", F.row_number().over(one)).filter("_turn = 1").join(stays, "_id").select("_row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document is repeated as often as the words taken from it ask for, to the nearest whole copy; one without words stays once.

    Of a source with a target whose documents would all round to none, the one most is taken from stays (of equals, the shortest).
    """
    out = mixing.mix(spark, docs.select(whole(docs), "doc_id", "text", "source"), ["_row"])
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(1).cast("int")
    out = staged(spark, out.withColumn("_copies", copies).withColumn("_n", F.monotonically_increasing_id()), "mix-copies")
    worded = out.filter("size > 0 AND target > 0").groupBy(F.col("_row.source").alias("source"))
    best = F.max(F.struct("taken", (-F.col("size")).alias("short"), F.col("_n")))
    gone = staged(spark, worded.agg(F.max("_copies").alias("most"), best.alias("best")).filter("most = 0").select(F.col("best._n").alias("_n"), F.lit(1).alias("_least")), "mix-least")
    out = out.join(gone, "_n", "left").withColumn("_copies", F.greatest("_copies", "_least"))
    return out.filter("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(spark, docs)


STAGES = [("language ID", language), ("toxicity", toxic), ("near-duplicates", near_dedup), ("source mix", mixed), ("packing", packed)]

#: Models and fingerprints are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    since = mark()
    for name, stage in STAGES[:-1]:
        docs = staged(spark, stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        release(spark, since, keep=1)  # a stage's input and what it wrote on its way
    return STAGES[-1][1](spark, docs, sf_dir)
