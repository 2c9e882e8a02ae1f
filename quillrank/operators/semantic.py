"""Sparse learned retrieval: a pluggable encoder gives (atom, weight) lists that share one accumulator with lexical terms."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and characters that an encoder gets at once.
ROWS, CHARS = 256, 1_000_000
ATOMS = "array<struct<atom:int,weight:double>>"


class Encoder(Protocol):
    """What a model offers; the signature names it, and nothing here stores or compares it yet."""

    signature: str
    dims: int

    def encode(self, texts: list[str]) -> list[dict[int, float]]: ...


class HashEncoder:
    """A deterministic stand-in without weights: an atom per hashed token, weighted by 1 + log of its count."""

    def __init__(self, dims: int = 4096) -> None:
        self.dims, self.signature = dims, f"hash-{dims}"

    def encode(self, texts: list[str]) -> list[dict[int, float]]:
        import math
        import re
        import zlib
        from collections import Counter

        return [{a: 1 + math.log(n) for a, n in Counter(zlib.crc32(w.encode()) % self.dims for w in re.findall(r"\w+", (t or "").lower())).items()} for t in texts]


def encode(docs: DataFrame, key: str, text: str, encoder: Encoder) -> DataFrame:
    """(key, atoms), texts encoded ROWS at a time or fewer with CHARS in all; atoms of weight zero are left out, negative weights and repeated or
    unknown atoms are errors. What is encoded leaves as flat arrays, so that a worker never holds more of it than one such piece."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("atoms", T._parse_datatype_string(ATOMS))])
    arrow = to_arrow_schema(kind)
    of_atom = arrow.field(1).type.value_type

    def lists(texts: list[str]) -> pa.Array:
        ids, weights, ends = array("i"), array("d"), [0]
        for atoms in encoder.encode(texts):
            for a, w in sorted(atoms.items()):
                if w < 0 or not 0 <= a < encoder.dims:
                    raise ValueError("an atom is out of range or has a negative weight")
                if w:
                    ids.append(a)
                    weights.append(w)
            ends.append(len(ids))
        pairs = pa.StructArray.from_arrays([pa.array(np.frombuffer(ids, np.int32)), pa.array(np.frombuffer(weights))], fields=list(of_atom))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs).cast(arrow.field(1).type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.utf8_length(batch.column("t")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at, before = 0, 0
            while at < batch.num_rows:
                to = min(at + ROWS, max(at + 1, int(np.searchsorted(size, before + CHARS, "right"))))
                piece = batch.slice(at, to - at)
                atoms = lists(pc.fill_null(piece.column("t"), "").to_pylist())
                yield pa.RecordBatch.from_arrays([piece.column("k").cast(arrow.field(0).type), atoms], schema=arrow)
                at, before = to, int(size[to - 1])

    return docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, kind)


def quantize_u8(x: Column) -> Column:
    """Impact to a code of 1 to 255, two being the largest impact; halves go up."""
    return F.least(F.lit(255), F.greatest(F.lit(1), F.round(x * 255.0 / 2.0).cast("int")))


def dequantize_u8(code: Column) -> Column:
    return code * 2.0 / 255.0


def alpha_mass(postings: DataFrame, by: list[str], impact: str, atom: str, alpha: float) -> DataFrame:
    """The smallest set of largest impacts of each document that holds alpha of its mass."""
    if not 0.01 <= alpha <= 1:
        raise ValueError("alpha is from 0.01 to 1")
    doc = Window.partitionBy(*by)
    before = doc.orderBy(F.col(impact).desc(), F.col(atom)).rowsBetween(Window.unboundedPreceding, -1)
    kept = postings.withColumns({"_total": F.sum(impact).over(doc), "_before": F.coalesce(F.sum(impact).over(before), F.lit(0))})
    return kept.filter(F.col("_before") < F.col("_total") * alpha).drop("_total", "_before")


def champions(postings: DataFrame, atom: str, impact: str, key: str, n: int = 64) -> DataFrame:
    """The n strongest documents of each atom: candidates for exact rescoring, which is approximate by design."""
    best = Window.partitionBy(atom).orderBy(F.col(impact).desc(), F.col(key))
    return postings.withColumn("_turn", F.row_number().over(best)).filter(F.col("_turn") <= n).drop("_turn")


def calibrate(lexical: DataFrame, semantic: DataFrame, rms: DataFrame, lexical_dims: int, fallback: float, low: float, high: float, multiplier: float = 1.0) -> DataFrame:
    """One query's lexical (atom, weight) and semantic (atom, weight) atoms in one space, semantic ids behind the lexical ones and weights scaled.

    scale = clip(lexical / semantic root-mean-square mass * multiplier, fallback * low, fallback * high)."""
    sem = semantic.select((F.col("atom") + lexical_dims).alias("atom"), "weight")
    mass = lambda df: df.join(rms, "atom").agg(F.sum(F.col("weight") * F.col("rms")).alias("m"))
    a, b = mass(lexical).withColumnRenamed("m", "lex"), mass(sem).withColumnRenamed("m", "sem")
    ratio = F.when(F.coalesce("sem", F.lit(0.0)) > 0, F.coalesce("lex", F.lit(0.0)) / F.col("sem")).otherwise(fallback) * multiplier
    scale = a.join(F.broadcast(b)).select(F.least(F.greatest(ratio, F.lit(fallback * low)), F.lit(fallback * high)).alias("scale"))
    return lexical.select("atom", "weight").unionByName(sem.join(F.broadcast(scale)).select("atom", (F.col("weight") * F.col("scale")).alias("weight")))
