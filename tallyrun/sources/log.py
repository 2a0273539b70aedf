"""Pushed events: a buffer with arrival time and order, made durable in a folder of Parquet files.

With a folder the buffer is written by flush(), by a push that asks for it, and when it holds `most_held` events.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..model import EventSource
from .files import spark_schema

LSN, NOW_MS, VERSION = "_lsn", "_now_ms", "_version"
_EXTRA = (T.StructField(LSN, T.LongType()), T.StructField(NOW_MS, T.LongType()), T.StructField(VERSION, T.IntegerType()))


class EventLog:
    """One source's events. Without a folder they live in memory only."""

    def __init__(self, spark: SparkSession, source: EventSource, folder: str | None = None, most_held: int = 50_000):
        self.spark, self.source, self.folder, self.most_held = spark, source, folder, most_held
        self.held: list[tuple] = []
        self.schema = spark_schema(source, _EXTRA)

    def append(self, fields: dict[str, Any], lsn: int, now_ms: int, version: int) -> None:
        self.held.append((*(fields.get(k) for k in self.source.schema), lsn, now_ms, version))
        if self.folder and len(self.held) >= self.most_held:
            self.flush()

    def flush(self) -> int:
        """Write what is held to the folder; returns the number of events written."""
        n = len(self.held)
        if self.folder and n:
            self.spark.createDataFrame(self.held, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/{self.source.name}")
            self.held = []
        return n if self.folder else 0

    def rows(self) -> DataFrame:
        parts = [self.spark.createDataFrame(self.held, self.schema)]
        if self.folder and self._exists():
            parts.append(self.spark.read.schema(self.schema).parquet(f"{self.folder}/{self.source.name}"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{self.source.name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    @staticmethod
    def read_text(spark: SparkSession, path: str) -> str | None:
        """A small file in the folder, wherever that is; None if there is none."""
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        return "\n".join(r.value for r in spark.read.text(path).collect()) if fs.exists(p) else None

    @staticmethod
    def write_text(spark: SparkSession, path: str, text: str) -> None:
        """Written beside and then renamed, so that a reader sees the old or the new one."""
        jvm = spark._jvm
        p, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.new")
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        out = fs.create(beside, True)
        out.write(bytearray(text.encode()))
        out.close()
        fs.delete(p, False)
        fs.rename(beside, p)

    def clear(self) -> None:
        self.held = []
        if self.folder and self._exists():
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{self.source.name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
