"""The change log of an index: appended upserts and deletes, read as a live view, compacted into a new base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sortable(df: DataFrame, order: str | None) -> Column:
    """A whole number, time or text as text that sorts as it does; null, before all, where there is no order."""
    if order is None:
        return F.lit(None).cast("string")
    c, kind = F.col(f"`{order}`"), df.schema[order].dataType
    if isinstance(kind, T.StringType):
        return c
    if isinstance(kind, T.TimestampType):
        c = F.unix_micros(c)
    elif isinstance(kind, T.DateType):
        c = F.unix_date(c)
    elif not isinstance(kind, T.IntegralType):
        raise ValueError("an order is by a whole number, a time or a text")
    # the sign's bit turned over, digits of one length
    return F.lpad(F.hex(c.cast("long").bitwiseXOR(F.lit(-(2**63)).cast("long"))), 16, "0")


def latest(log: DataFrame, key: str, *seq: str) -> DataFrame:
    """The last change of each key by the columns seq; a hot key is reduced before the shuffle. Of equal changes one counts, the same in every run."""
    rest = [c for c in log.columns if c != key]
    plain = [f"`{c}`" for c in rest if not isinstance(log.schema[c].dataType, T.MapType)]
    by = F.struct(*(seq or ("seq",)), F.xxhash64(*plain))
    return log.groupBy(key).agg(F.max_by(F.struct(*[f"`{c}`" for c in rest]), by).alias("_last")).select(key, "_last.*")


#: Keys that a broadcast may hold.
FEW = 500_000


def counted(keys: DataFrame) -> DataFrame:
    """Distinct keys, to be broadcast if they are found to be few. A join that learns this from a running shuffle has by then shuffled the large side, whole rows, too."""
    return F.broadcast(keys) if not keys.isStreaming and keys.limit(FEW + 1).count() <= FEW else keys


def live(base: DataFrame, log: DataFrame, key: str, consistency: str = "realtime") -> DataFrame:
    """The rows that a reader sees: the base alone under manual consistency, else the base with the log applied."""
    if consistency == "manual":
        return base
    last = latest(log, key, "seq")
    kept = base.join(counted(last.select(key)), key, "left_anti")
    new = last.filter("op = 'upsert'")
    return kept.unionByName(new.select(*[c for c in base.columns if c in new.columns]), allowMissingColumns=True).select(*base.columns)


def ingest(stream: DataFrame, to: str, checkpoint: str):
    """Append a stream of changes to the log's folder; exactly once, as the file sink keeps its own commit log."""
    return stream.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def follow(stream: DataFrame, index, checkpoint: str, op: str = "op", order: str = "seq"):
    """Commit a stream of changes (the index's columns, op: upsert or delete, and an order) to the log of an index, a batch in one commit.

    In a batch the last change of a key by `order` counts, across batches the later batch. A commit names the checkpoint and the batch, so a
    batch that is run again, as after a lost driver, is committed once."""

    def append(batch: DataFrame, number: int) -> None:
        index.append(batch, op, order, (checkpoint, number))

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
