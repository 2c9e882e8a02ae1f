"""Bounded heavy-hitter counters against exact sums."""

import random
from collections import Counter

import pytest
from pyspark.errors import PythonException

from quillrank.operators.summary import heavy_hitters, summarize


def skewed(spark, n=6000, parts=7):
    """One item with a third of the rows, some of middling weight, and many that occur once or twice; nulls of both kinds."""
    r = random.Random(3)
    rows = [("hot", 1.0)] * (n // 3) + [(f"m{r.randrange(12)}", r.randrange(1, 9) / 4) for _ in range(n // 3)] + [(f"r{r.randrange(n)}", 0.5) for _ in range(n // 3)]
    rows += [(None, 2.0)] * 150 + [("never", None), ("zero", 0.0)]
    r.shuffle(rows)
    exact = Counter()
    for item, weight in rows:
        exact[item] += weight or 0.0
    return spark.createDataFrame(rows, "item string, weight double").repartition(parts), exact


@pytest.mark.parametrize("capacity", [1, 20, 200])
def test_bounds_hold(spark, capacity):
    rows, exact = skewed(spark)
    total = sum(exact.values())
    got = {r.item: (r.low, r.high) for r in summarize(rows, "item", "weight", capacity).collect()}
    assert all(low <= exact[item] + 1e-6 and exact[item] <= high + 1e-6 for item, (low, high) in got.items())
    assert all(high - low == pytest.approx(total / (capacity + 1)) for low, high in got.values())
    assert {item for item, w in exact.items() if w > total / (capacity + 1)} <= set(got)
    assert len(got) <= 7 * capacity < len(exact)


def test_counters_stay_bounded_over_many_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        rows, exact = skewed(spark, parts=2)
        got = {r.item: (r.low, r.high) for r in summarize(rows, "item", "weight", 20).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) <= 40 and "hot" in got
    assert all(low <= exact[item] + 1e-6 and exact[item] <= high + 1e-6 for item, (low, high) in got.items())


@pytest.mark.parametrize("share", [0.3, 0.02, 0.004])
def test_heavy_hitters_are_exact(spark, share):
    rows, exact = skewed(spark)
    total = sum(exact.values())
    got = {r.item: r.weight for r in heavy_hitters(rows, "item", "weight", share).collect()}
    assert got == pytest.approx({item: w for item, w in exact.items() if w > total * share})


def test_none_and_wrong_input(spark):
    none = spark.createDataFrame([], "item long, weight double")
    assert summarize(none, "item", "weight", 4).count() == 0 and heavy_hitters(none, "item", "weight", 0.5).count() == 0
    with pytest.raises(ValueError):
        summarize(none, "item", "weight", 0)
    with pytest.raises(ValueError):
        heavy_hitters(none, "item", "weight", 1.0)
    for bad in (-1.0, float("nan"), float("inf")):
        with pytest.raises(PythonException, match="negative or not finite"):
            summarize(spark.createDataFrame([(1, bad)], "item long, weight double"), "item", "weight", 4).collect()
