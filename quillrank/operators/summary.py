"""Heavy hitters in bounded memory: weighted counters of the Space-Saving family, and an exact recount of what they leave in question."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SLACK = 1e-9  # of the whole weight, for sums in another order


def _weighted(df: DataFrame, item: str, weight: str) -> DataFrame:
    return df.select(F.col(item).alias("item"), F.coalesce(F.col(weight).cast("double"), F.lit(0.0)).alias("weight"))


def _counters(df: DataFrame, capacity: int) -> DataFrame:
    """(item, weight) of each task's counters, at most `capacity` of them: never above an item's weight in the task, and below it by the task's weight / (capacity + 1) at most."""
    kind = T.StructType([df.schema["item"], T.StructField("weight", T.DoubleType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = arrow.empty_table()
        for batch in batches:
            weights = batch.column(1).to_numpy(zero_copy_only=False)
            if len(weights) and not (np.isfinite(weights).all() and weights.min() >= 0):
                raise ValueError("a weight is negative or not finite")
            both = pa.concat_tables([held, pa.Table.from_batches([batch]).cast(arrow)])
            held = both.group_by("item").aggregate([("weight", "sum")]).select(["item", "weight_sum"]).rename_columns(["item", "weight"]).cast(arrow)
            if len(held) > capacity:  # every counter gives up as much as the first one without a place
                weights = held.column(1).to_numpy()
                left = weights - np.partition(weights, -capacity - 1)[-capacity - 1]
                stays = left > 0
                held = pa.Table.from_arrays([held.column(0).filter(pa.array(stays)), pa.array(left[stays])], schema=arrow)
        yield from held.to_batches()

    return df.mapInArrow(run, kind)


def _total(df: DataFrame) -> DataFrame:
    return df.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("_total"))


def summarize(df: DataFrame, item: str, weight: str, capacity: int) -> DataFrame:
    """(item, low, high): bounds of an item's weight, high - low being the whole weight / (capacity + 1); any item heavier than that is among the rows.

    A task holds `capacity` counters whatever it reads, and only counters are shuffled. A null weight is none, a null item an item; a negative,
    infinite or NaN weight is an error. Which light items remain depends on how rows are dealt to tasks, the bounds hold in any case."""
    if capacity < 1:
        raise ValueError("capacity is at least 1")
    rows = _weighted(df, item, weight)
    low = _counters(rows, capacity).groupBy("item").agg(F.sum("weight").alias("low"))
    return low.join(F.broadcast(_total(rows))).select(F.col("item").alias(item), "low", (F.col("low") + F.col("_total") / (capacity + 1)).alias("high"))


def heavy_hitters(df: DataFrame, item: str, weight: str, share: float) -> DataFrame:
    """(item, weight) of every item with more than `share` of the whole weight, exact: items that counters leave in question are counted again.

    With 2 / share counters a task, an item in question has at least half of the share, so that there are 2 / share of them at most to broadcast."""
    if not 0 < share < 1:
        raise ValueError("share is between 0 and 1")
    capacity = math.ceil(2 / share)
    rows = _weighted(df, item, weight)
    total = _total(rows)
    low = _counters(rows, capacity).groupBy("item").agg(F.sum("weight").alias("low")).join(F.broadcast(total))
    asked = low.filter(F.col("low") >= F.col("_total") * (share - 1 / (capacity + 1) - _SLACK)).select(F.col("item").alias("_item"))
    found = rows.join(F.broadcast(asked), F.col("item").eqNullSafe(F.col("_item"))).groupBy("item").agg(F.sum("weight").alias("weight"))
    return found.join(F.broadcast(total)).filter(F.col("weight") > F.col("_total") * share).select(F.col("item").alias(item), "weight")
