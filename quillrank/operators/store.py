"""Small JSON files of an index through Hadoop's API: read, listed, deleted, and created once by one writer among many."""

from __future__ import annotations

import json
import os
import time
import uuid

from pyspark.sql import SparkSession


class Store:
    """One folder in any file system that Spark reaches.

    create() must have one winner: on a local disk a hard link decides, elsewhere a rename that refuses an existing target, as HDFS has it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def at(self, name: str = ""):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def create(self, name: str, body: dict) -> bool:
        """Write a file unless it is there already; whether it was this call that wrote it."""
        fs, final = self.at(name)
        folder = name.rsplit("/", 1)[0]
        _, tmp = self.at(f"{folder}/_{uuid.uuid4().hex}")
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps(body).encode()))
        out.close()
        try:
            if fs.getScheme() == "file":
                os.link(tmp.toUri().getPath(), final.toUri().getPath())
                return True
            return not fs.exists(final) and fs.rename(tmp, final)
        except FileExistsError:
            return False
        finally:
            fs.delete(tmp, False)

    def read(self, name: str) -> dict:
        fs, p = self.at(name)
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        """Names in a folder, in order; those that begin with an underscore are being written."""
        fs, p = self.at(folder)
        return sorted(n for n in (x.getPath().getName() for x in fs.listStatus(p)) if n[0] not in "_.") if fs.exists(p) else []

    def age(self, name: str) -> float:
        """Seconds since a file or folder was changed."""
        fs, p = self.at(name)
        return time.time() - fs.getFileStatus(p).getModificationTime() / 1000.0

    def delete(self, name: str = "") -> None:
        fs, p = self.at(name)
        fs.delete(p, True)
