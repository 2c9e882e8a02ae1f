"""Relevance metrics of ranked lists against graded judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def metrics(run: DataFrame, qrels: DataFrame, digits: int = 6) -> DataFrame:
    """run (query_id, doc_id, rank), qrels (query_id, doc_id, grade): per judged query NDCG@10, MAP@100, MRR@20, Recall@100 and the candidate upper bound."""
    judged = qrels.filter("grade > 0")
    ideal = Window.partitionBy("query_id").orderBy(F.col("grade").desc(), "doc_id")
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    best = judged.withColumn("p", F.row_number().over(ideal)).groupBy("query_id").agg(F.sum(F.when(F.col("p") <= 10, gain / F.log2(F.col("p") + 1)).otherwise(0.0)).alias("idcg"), F.count(F.lit(1)).alias("relevant"))
    found = run.join(judged, ["query_id", "doc_id"])
    order = Window.partitionBy("query_id").orderBy("rank")
    found = found.withColumn("hits", F.row_number().over(order))
    at = lambda k, x: F.sum(F.when(F.col("rank") <= k, x).otherwise(0.0))
    per = found.groupBy("query_id").agg(
        at(10, gain / F.log2(F.col("rank") + 1)).alias("dcg"),
        at(100, F.col("hits") / F.col("rank")).alias("ap"),
        F.min("rank").alias("first"),
        at(100, F.lit(1.0)).alias("in100"),
        F.count(F.lit(1)).cast("double").alias("in_run"),
    )
    z = lambda c: F.coalesce(c, F.lit(0.0))
    r = lambda c: F.round(z(c), digits)
    return best.join(per, "query_id", "left").select(
        "query_id",
        r(F.col("dcg") / F.col("idcg")).alias("ndcg10"),
        r(F.col("ap") / F.least("relevant", F.lit(100))).alias("map100"),
        r(F.when(F.col("first") <= 20, 1.0 / F.col("first"))).alias("mrr20"),
        r(F.col("in100") / F.col("relevant")).alias("recall100"),
        r(F.col("in_run") / F.col("relevant")).alias("cub"),
    )
