"""Helpers shared by the corpus operators: tables in the shared folder, bounded samples, Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one is made only where it is unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="quillrank-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Folders that staged() has written and nothing has deleted yet, in order.
_written: list[str] = []


def staged(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there and lost executors cost nothing.

    The table stays until release() or the driver's end."""
    path = f"{shared_dir(spark)}/quillrank-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(release, spark, 0)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in time for release()."""
    return len(_written)


def release(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Delete what was staged from `since` on but for the last `keep` tables: whatever was computed from the others has been written."""
    gone = _written[since : len(_written) - keep]
    del _written[since : len(_written) - keep]
    for path in gone:
        with contextlib.suppress(Exception):
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def quoted(name: str) -> str:
    """A column's name for the parser, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def excerpt(text: Column, chars: int, parts: int = 4) -> Column:
    """A text of up to `chars` characters as it is; of a longer one, `parts` pieces evenly spread from its beginning to its end, that long together."""
    size = chars // parts
    step = (F.length(text) - size) / (parts - 1)
    pieces = [text.substr(F.floor(step * i).cast("int") + 1, F.lit(size)) for i in range(parts)]
    return F.when(F.length(text) <= chars, text).otherwise(F.concat_ws(" ", *pieces))


def id_crc32(doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id as text, the contracts' fold; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def seeded(seed: str, *cols: str) -> Column:
    """A hash in [0, 1) of the columns, the same in every run."""
    h = F.xxhash64(F.lit(seed), *[F.col(c).cast("string") for c in cols])
    return F.pmod(h, F.lit(1 << 40)) / F.lit(float(1 << 40))


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict | None]], schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow with state: make() runs once in each task and gives a function from a batch to columns."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None:
                yield pa.RecordBatch.from_arrays([_column(out[x.name], x.type) for x in arrow], schema=arrow)

    return df.mapInArrow(run, kind)


def _column(values, kind: pa.DataType) -> pa.Array:
    return values if isinstance(values, pa.Array) and values.type == kind else pa.array(values, type=kind)


def numbered(df: DataFrame, by: str) -> DataFrame:
    """df with _task and _turn: a row's place (from 0) among the rows of its task with the same whole number in `by`, of which there are few.

    Only what has been written is consistent: a task that runs again may number otherwise, its output replaces the other's."""
    kind = T.StructType([*df.schema.fields, T.StructField("_task", T.IntegerType()), T.StructField("_turn", T.LongType())])

    def make():
        task, seen = TaskContext.get().partitionId(), {}

        def run(batch: pa.RecordBatch) -> dict:
            key = batch.column(batch.schema.get_field_index(by)).to_numpy(zero_copy_only=False)
            turn = np.empty(len(key), np.int64)
            order = np.argsort(key, kind="stable")
            values, start, count = np.unique(key[order], return_index=True, return_counts=True)
            for v, s, n in zip(values.tolist(), start.tolist(), count.tolist(), strict=True):
                turn[order[s : s + n]] = np.arange(n) + seen.get(v, 0)
                seen[v] = seen.get(v, 0) + n
            return {c: batch.column(i) for i, c in enumerate(batch.schema.names)} | {"_task": np.full(len(key), task, np.int32), "_turn": turn}

        return run

    return map_batches(df, make, kind)


def starts(table: DataFrame, by: str) -> DataFrame:
    """For a written table of numbered(): (by, _task, _n, _first), how many rows have the same `by` in the task and in those before."""
    before = Window.partitionBy(by).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    counts = table.groupBy(by, "_task").agg(F.count(F.lit(1)).alias("_n"))
    return counts.select(by, "_task", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))


def rows_of(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()
