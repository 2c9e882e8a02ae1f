"""Fusion over indexes by field."""

from itertools import permutations

import pytest
from pyspark.sql import functions as F

from quillrank.operators.fusion import FieldQuery, fuse_hits, fuse_queries, fuse_text
from quillrank.operators.index import Index

ROWS = [(1, "blue bird", "river valley"), (2, "red fox", "blue forest"), (3, "blue fox", "blue river"), (4, None, "")]


@pytest.fixture(scope="module")
def indexes(spark, tmp_path_factory):
    docs = spark.createDataFrame(ROWS, "doc_id long, title string, body string")
    at = tmp_path_factory.mktemp("fused")
    return {c: Index.build(spark, f"{at}/{c}", docs, "doc_id", [c]) for c in ("title", "body")}


def by_hand(indexes, queries, k, candidate_k, **more):
    total = {}
    for name, text, w in queries:
        for r in indexes[name].query(text, candidate_k, **more).collect():
            total[r.doc_id] = total.get(r.doc_id, 0.0) + w * r.score
    return sorted(((round(s, 6), i) for i, s in total.items()), key=lambda x: (-x[0], str(x[1])))[:k]


def same(got, want):
    assert [r.doc_id for r in got] == [i for _, i in want]
    assert [r.score for r in got] == pytest.approx([s for s, _ in want], abs=2e-6)


def test_weighted_sum_of_candidates(indexes):
    queries = [("title", "blue fox", 1.0), ("body", "river", 2.5)]
    for k, candidate_k in ((2, None), (3, 1), (4, 4)):
        got = fuse_queries([FieldQuery(indexes[n], t, None if w == 1 else w, n) for n, t, w in queries], k, candidate_k).collect()
        same(got, by_hand(indexes, queries, k, candidate_k or k))
    assert {r.doc_id: r.fields for r in got}[3] == ["title", "body"]


def test_one_text_mask_and_names(indexes):
    mask = F.when(F.col("doc_id") == 3, 0.25).otherwise(1.0)
    got = fuse_text({"title": (indexes["title"], 1.0), "body": (indexes["body"], 2.0)}, "blue", 3, 4, mask).collect()
    same(got, by_hand(indexes, [("title", "blue", 1.0), ("body", "blue", 2.0)], 3, 4, mask=mask))
    assert fuse_queries([FieldQuery(indexes["title"], "fox"), FieldQuery(indexes["body"], "river", 1.0, " ")], 4).first().fields == ["field_1", "field_2"]


def test_refuses(indexes):
    one = FieldQuery(indexes["title"], "fox", 1.0, "a")
    for queries, k, candidates in (([], 3, None), ([one], 0, None), ([one], 3, 0), ([one, one], 3, None), ([FieldQuery(indexes["title"], "fox", float("nan"))], 3, None)):
        with pytest.raises(ValueError):
            fuse_queries(queries, k, candidates)


def test_sum_does_not_depend_on_order(spark):
    """2 * 1.175241 + 0.5 * 0.539855 + 0.321609 is 2.9420185, half way between two scores; in doubles its last digit hangs on the order of addition."""
    hits = [(spark.createDataFrame([(99, s)], "doc_id long, score double").coalesce(1), w) for s, w in ((1.175241, 2.0), (0.539855, 0.5), (0.321609, None))]
    assert {fuse_hits(list(p), 5).first().score for p in permutations(hits)} == {2.942019}


def test_sum_of_odd_scores(spark):
    inf, nan = float("inf"), float("nan")
    hits = [spark.createDataFrame([(i, s) for i, s in enumerate(x)], "doc_id long, score double") for x in ((1e16, inf, inf, nan, None, None, 1e308), (1.0, 1.0, -inf, 1.0, 2.0, None, 1e308), (-1e16, 2.0, 0.0, 1.0, None, None, 1.0))]
    got = {r.doc_id: r.score for r in fuse_hits([(h, 1.0) for h in hits], 9).collect()}
    assert {i: "nan" if s != s else s for i, s in got.items() if s is not None} == {0: 1.0, 1: inf, 2: "nan", 3: "nan", 4: 2.0, 6: inf}
    assert got[5] is None
