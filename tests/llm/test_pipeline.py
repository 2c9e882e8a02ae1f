"""The stages of the pipeline against brute force, and on odd tables."""

from collections import Counter

import corpus_pipeline as cp
import pytest
from conftest import rows
from test_ops import brute_components, brute_fp

from quillrank.llm import mixing, packing, simhash, toxicity


@pytest.fixture(scope="module")
def sf(spark, docs, labels, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    docs.write.parquet(str(at / "documents.parquet"))
    labels.write.parquet(str(at / "labels.parquet"))
    return str(at)


def test_stage_order():
    assert [f.__name__ for _, f in cp.STAGES] == ["language", "toxic", "near_dedup", "mixed", "packed"]


def test_language_keeps_texts_with_letters(spark, docs, sf):
    got = cp.language(spark, docs, sf)
    assert got.columns == docs.columns
    assert Counter(r.doc_id for r in got.select("doc_id").collect()) == Counter(r[0] for r in rows() if r[0] not in (400, 401, 402, 403))


def test_toxic_follows_the_scores(spark, docs, labels, sf):
    got = cp.toxic(spark, docs, sf)
    lexicon = toxicity.fit(docs, labels)
    import numpy as np

    want = Counter(r[0] for r in rows() if lexicon.score(np.array([lexicon.features(r[1])]))[0] < toxicity.THRESHOLD)
    assert got.columns == docs.columns and Counter(r.doc_id for r in got.select("doc_id").collect()) == want


def test_near_dedup_keeps_one_of_each_group(spark, docs, sf):
    text = {r[0]: r[1] for r in rows()}
    ids = sorted(text)
    want = set(brute_components(ids, [brute_fp(text[i]) for i in ids]))
    got = cp.near_dedup(spark, docs, sf)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(want)


def test_near_dedup_of_rows_that_share_an_id(spark):
    one, two, three = ("".join(f"{w}{k} " for k in range(60)) for w in ("a", "b", "c"))
    some = [(1, one), (1, two), (1, two), (2, one), (None, two), (None, three), (None, three), (5, None), (5, "")]
    got = cp.near_dedup(spark, spark.createDataFrame(some, "doc_id long, text string"), "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, three), (1, one), (1, two), (5, "")]


def test_mixed_repeats_documents(spark, docs, sf):
    got = Counter(r.doc_id for r in cp.mixed(spark, docs, sf).select("doc_id").collect())
    want = Counter()
    for r in mixing.mix(spark, docs, ["doc_id"]).collect():
        want[r.doc_id] += int(r.taken / r["size"] + 0.5) if r["size"] else 1
    assert got == +want


def test_mixed_is_near_its_targets(spark):
    some = [(i, f"w{i} " * (20 + i % 30), f"s{i % 4}" if i % 3 else "s0") for i in range(3000)]
    df = spark.createDataFrame(some, "doc_id long, text string, source string")
    got = Counter()
    for r in cp.mixed(spark, df, "").collect():
        got[r.source] += len(r.text.split())
    for r in mixing.mix(spark, df, ["source"]).groupBy("source", "target").count().collect():
        assert abs(got[r.source] - r.target) <= 0.03 * r.target


def test_near_dedup_of_one_row_many_times(spark):
    df = spark.range(0, 4000, 1, 8).selectExpr("if(id < 3000, 1, id) AS doc_id", "if(id < 3000, 'the same row again and again', concat('text ', id, ' x', id * 31)) AS text", "map('k', 'v') AS m")
    got = cp.near_dedup(spark, df, "")
    assert got.count() == 1001
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan  # repeated rows are cut down before they are shuffled


def test_mixed_keeps_every_source(spark):
    some = [(i, "word " * 400, f"s{i % 3}") for i in range(30)] + [(100, "long " * 40_000, "one"), (101, "few words", "tiny")]
    got = Counter(r.source for r in cp.mixed(spark, spark.createDataFrame(some, "doc_id long, text string, source string"), "").select("source").collect())
    assert set(got) == {"s0", "s1", "s2", "one", "tiny"} and got["one"] == got["tiny"] == 1


def test_run(spark, sf, docs):
    got = cp.run(spark, sf).toPandas()
    assert len(got) and (got.groupby("sequence_id").length.sum() <= packing.SIZE).all()
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert simhash.SHINGLE == 3
