"""What a task holds and what is moved, in plans and files; figures at size are in the README."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrank.operators import batch, index, postings, semantic
from quillrank.operators.index import Index
from quillrank.operators.scoring import Bm25, batch_rank
from quillrank.streaming import mutation


def texts(spark, n=600):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    return spark.createDataFrame([(i, [words[int(x)] for x in rng.zipf(1.3, int(rng.integers(0, 60))) % 400]) for i in range(n)], "doc_id long, tokens array<string>").repartition(4)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_each_slice_is_a_task_of_its_own(spark, tmp_path, monkeypatch):
    docs = texts(spark)
    total = docs.agg(F.sum(F.size("tokens"))).first()[0]
    monkeypatch.setattr(index, "SLICE_TOKENS", total // 24)
    made = Index.build(spark, f"file://{tmp_path}/a", docs, "doc_id", "tokens", buckets=8)
    assert made.manifest["slices"] > 2
    files = list(tmp_path.glob("a/v=*/postings/bucket=*/*.parquet"))
    assert len(files) == 8 * made.manifest["slices"]
    for f in files:
        rows = [(r.term, r.doc_id) for r in spark.read.parquet(f"file://{f}").select("term", "doc_id").collect()]
        assert rows == sorted(rows) and len(set(rows)) == len(rows)
    got = {(r.term, r.doc_id): (r.tf, r.pos) for r in made.table("postings").collect()}
    want = {}
    for r in docs.collect():
        for i, t in enumerate(r.tokens):
            want.setdefault((t, r.doc_id), []).append(i)
    assert got == {k: (len(v), v) for k, v in want.items()}
    assert made.audit().count() == 0


def test_no_token_is_shuffled_alone(spark):
    docs = texts(spark).withColumn("_dl", F.size("tokens").cast("double"))
    made = postings.write_order(docs, "doc_id", F.col("tokens"), 8, 1)
    assert "Aggregate" not in plan(made)
    from pyspark.sql.pandas.types import to_arrow_schema

    packs = 0
    for _ in range(2):
        rows = pa.table({"key": pa.array(range(3000)), "length": pa.array([4.0] * 3000), "slice": pa.array([0] * 3000, pa.int32()), "tokens": pa.array([["a", "b", f"c{i}", "a"] for i in range(3000)])})
        kind = "part int, bucket int, keys array<long>, lengths array<double>, terms array<string>, body binary"
        packs += sum(b.num_rows for b in postings._packer(8, 1, to_arrow_schema(T._parse_datatype_string(kind)))(iter(rows.to_batches())))
    assert packs == 16  # 24,000 tokens in two tasks


def test_odd_rows_of_an_index(spark, tmp_path):
    """Terms and keys that are null, rows without tokens, and rows that share a key: one posting for each term, key and length."""
    rows = [(1, ["b", "a", "b", None]), (2, []), (4, None), (3, ["x"] * 3), (3, ["x", "y", "z"]), (3, ["u", "x"]), (None, ["b"])]
    made = Index.build(spark, f"file://{tmp_path}/c", spark.createDataFrame(rows, "doc_id long, tokens array<string>"), "doc_id", "tokens", buckets=4)
    got = sorted(((r.term or "", r.doc_id or 0, r.tf, r._dl, r.pos) for r in made.table("postings").collect()), key=repr)
    want = [("", 1, 1, 4.0, [3]), ("a", 1, 1, 4.0, [1]), ("b", 0, 1, 1.0, [0]), ("b", 1, 2, 4.0, [0, 2]), ("u", 3, 1, 2.0, [0]), ("x", 3, 1, 2.0, [1]), ("x", 3, 4, 3.0, [0, 0, 1, 2]), ("y", 3, 1, 3.0, [1]), ("z", 3, 1, 3.0, [2])]
    assert got == sorted(want, key=repr)


def asked(spark):
    qs = [(q, t) for q in range(30) for t in (f"w{q}", f"w{q * 7 % 400}", "w1", "w1", "none")] + [(99, "none"), (98, "w2")]
    return spark.createDataFrame(qs, "query_id int, term string")


@pytest.mark.parametrize("method", ["lucene", "robertson", "atire", "bm25l", "bm25+"])
def test_batches_do_not_join_rows_and_queries(spark, tmp_path, monkeypatch, method):
    """Both ways give the same; pairs of a row and a query leave no task."""
    docs, p = texts(spark), Bm25(method)
    monkeypatch.setattr(batch, "CELLS", 3000)  # several blocks of rows and of queries
    made = Index.build(spark, f"file://{tmp_path}/d", docs, "doc_id", "tokens", params=p)
    new, stored = batch_rank(docs, "doc_id", F.col("tokens"), asked(spark), p, 7), made.query_batch(asked(spark), 7)
    assert "Join" not in plan(new)
    assert "query_id" not in "".join(x for x in plan(stored).splitlines() if "Join" in x)
    rows = lambda df: sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())
    a, b = rows(new), rows(stored)
    monkeypatch.setattr(batch, "PAIRS", 0)
    c = rows(batch_rank(docs, "doc_id", F.col("tokens"), asked(spark), p, 7))
    d = rows(made.query_batch(asked(spark), 7))
    assert len(a) == 31 * 7 and a == b == d == c


def test_rows_that_share_a_key_are_summed(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (1, ["a", "a", "b"]), (2, ["a"])], "doc_id long, tokens array<string>")
    got = batch_rank(docs, "doc_id", F.col("tokens"), spark.createDataFrame([(1, "a")], "query_id int, term string"), Bm25("atire", "bm25+"), 5).collect()
    assert [r.doc_id for r in got] == [1, 2]


def test_an_encoder_gets_bounded_pieces(spark):
    class Strict(semantic.HashEncoder):
        def encode(self, texts):
            assert len(texts) <= 256 and (len(texts) == 1 or sum(map(len, texts)) <= 1_000_000)
            return semantic.HashEncoder.encode(self, texts)

    long = "word " * 300_000
    docs = spark.createDataFrame([(i, f"text {i} of a few") for i in range(1500)] + [(1500, long), (1501, None), (1502, long), (1503, "")], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: [(a.atom, a.weight) for a in r.atoms] for r in semantic.encode(docs, "doc_id", "text", Strict()).collect()}
    assert len(got) == 1504 and got[1501] == got[1503] == [] and len(got[1500]) == 1
    one = semantic.HashEncoder().encode(["text 7 of a few"])[0]
    assert got[7] == sorted(one.items())


def test_few_changes_do_not_shuffle_what_they_change(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        base = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
        log = spark.createDataFrame([(1, 3, "delete", None), (2, 5, "upsert", "new")], "seq long, doc_id long, op string, text string")
        now = mutation.live(base, log, "doc_id")
        assert "BroadcastHashJoin" in plan(now) and "SortMergeJoin" not in plan(now)
        assert now.count() == 99
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
