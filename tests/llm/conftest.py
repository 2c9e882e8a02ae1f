import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


def rows():
    """Nulls, empty and long texts, ties, repeated rows."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    out = []
    for i in range(120):
        text = " ".join(words[(i * j + j * j) % len(words)] for j in range(1, 8 + i % 40))
        out.append((i, text, ["en", "fr", None][i % 3], ["a", "b", None, "z"][i % 4], len(text)))
    base = out[5][1]
    out += [(200 + i, base, "en", "hot", len(base)) for i in range(60)]  # exact copies
    out += [(300 + i, out[50][1] + f" tail{i}", "en", "hot", 0) for i in range(30)]  # near copies
    out += [(400, None, None, None, None), (401, "", "en", "a", 0), (402, "  \t\n", "en", "a", 4), (403, "...!!! 123", "en", "a", 10)]
    out += [(404, " ".join(words[k * k % 12] + str(k % 97) for k in range(30_000)), "fr", "long", None)]
    out += [(405, "two  spaces and\n\nlines ", "en", "a", 0), (406, "été \U0001f600 中文 naïve", "fr", "b", 0), (407, "one", None, "a", 3)]
    out += [out[7], out[7]]  # repeated rows
    return out


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with extra columns whose names clash with those the operators use."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long")
    clash = ("size", "score", "shard", "bucket", "fp", "target", "words", "out", "rejected", "predicted", "label", "key", "a", "b", "gid", "length", "host", "tree")
    return df.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(clash)]).repartition(5)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(100)] + [(100, None, None), (None, 1, 1), (3, 0, 1)], "doc_id long, quality int, toxic int")
