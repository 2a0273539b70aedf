"""Events from files and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.types import SPARK
from ..model import EventSource


def spark_schema(source: EventSource, extra: tuple[T.StructField, ...] = ()) -> T.StructType:
    return T.StructType([*[T.StructField(k, SPARK[v], True) for k, v in source.schema.items()], *extra])


def read_events(spark: SparkSession, path: str, source: EventSource | None = None, fmt: str = "parquet", **options) -> DataFrame:
    """A batch of events. With a source its declared schema is used, so nothing is inferred."""
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(spark_schema(source)) if source and fmt != "parquet" else reader).load(path)


def stream_events(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", **options) -> DataFrame:
    """A stream of event files (or, by `fmt`, of any source that Spark streams)."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)
