"""Readers: Parquet tables of a data folder, JSON Lines queries, graded judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("query_id string, text string").json(path)


def qrels_json(spark: SparkSession, path: str) -> DataFrame:
    """{query: {doc: grade}} as rows."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,int>>").alias("m"))
    return raw.select(F.explode("m").alias("query_id", "docs")).select("query_id", F.explode("docs").alias("doc_id", "grade"))
