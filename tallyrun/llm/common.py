"""What the training-data operators share: table access, shared storage, Arrow batches."""

from __future__ import annotations

import ctypes
import itertools
import os
import sys
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes of an Arrow batch; rows hold whole texts, so batches are bounded by size and not by number
BATCH_BYTES = 4 << 20
_SHIPPED: set[str] = set()
_TEMP: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that were not started with it on their path, and bound their batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root = str(Path(__file__).resolve().parents[2])
    sc = spark.sparkContext
    on_path = root in os.environ.get("PYTHONPATH", "").split(":")
    if on_path or sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    out = Path(tempfile.mkdtemp(prefix="tallyrun-")) / "tallyrun.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(Path(root, "tallyrun").rglob("*.py")):
            z.write(p, str(p.relative_to(root)))
    sc.addPyFile(str(out))


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and every executor can reach; only a local session without the setting gets its own."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    return _TEMP.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="tallyrun-stash-"))


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyrun/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stash_path = path
    return back


def unstash(df: DataFrame) -> None:
    """Remove a table that stash() wrote, once nothing reads it."""
    path = getattr(df, "_stash_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def map_batches(df: DataFrame, make: Callable[[], Callable], schema) -> DataFrame:
    """mapInArrow with a per-task worker: make() is called once in each task and returns RecordBatch -> RecordBatch(es)."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                yield from work(batch)
        del work
        trim()

    return df.mapInArrow(run, schema)


def trim() -> None:
    """Give free memory back to the system, as a worker waits for its next task with what it has."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


_HELD: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], object]):
    """What an operator keeps in a worker process from task to task; a task of another operator drops it first."""
    if key not in _HELD:
        _HELD.clear()
        trim()
        _HELD[key] = make()
    return _HELD[key]


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(name).cast(pa.binary()).to_pylist()


def strings(batch: pa.RecordBatch, name: str) -> list[str | None]:
    return batch.column(name).to_pylist()


def by_bytes(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows that hold about `limit` bytes each; a longer row stands alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def crc_of_id(col: str = "doc_id") -> Column:
    """Unsigned crc32 of the id as decimal text."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def crc_mod(doc_id: int | None, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def flat(lists):
    return list(itertools.chain.from_iterable(lists))
