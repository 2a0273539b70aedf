"""Power-of-two packing: each document is cut into pieces of binary lengths, and equal lengths share a bucket.

A piece of 2^k tokens is a sequence by itself, so no sequence holds two documents and none is
padded. Sequence ids are grouped by bucket: ids of bucket k lie in one range, so a batch
of equal lengths is a range of ids.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import held, map_batches, tokenizer_path
from .token_units import TextEncoder, library_text_encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"
END_ID = 1
#: bits of a sequence id: bucket, then partition, then place within both
_PLACE_BITS, _PARTITION_BITS = 33, 24


def binary_lengths(tokens: int, longest: int) -> list[int]:
    """Whole pieces of `longest` (a power of two), then the rest's binary digits, largest first."""
    whole, rest = divmod(tokens, longest)
    return [longest] * whole + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def document_encoder(path: str, end_id: int = END_ID) -> TextEncoder:
    """The encoder of a worker process: whole-text ids by the tokenizers library."""
    return held(("documents", path, end_id), lambda: library_text_encoder(path, end_id + 1))


def pack(docs: DataFrame, tokenizer: str | None = None, longest: int = 2048, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece; with `keep_ids` also its ids.

    A null or empty text has just the end id: one piece of length 1. Repeated rows are packed
    each by itself. An empty table gives no rows. Only the id and the text are read, so others may have any name. A long
    text is encoded whole and gives as many pieces as it needs. A retried task sees the same rows in the same order, so
    its sequence ids come out the same.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")

    def make():
        encoder = document_encoder(path)
        partition = TaskContext.get().partitionId()
        if partition >> _PARTITION_BITS:
            raise ValueError("too many partitions for the sequence ids")
        placed = [0] * longest.bit_length()
        names = [f.split(" ")[0] for f in SCHEMA.split(", ")]

        def work(batch):
            ids_of = batch.column("doc_id").to_pylist()
            for first, ids, at in encoder.encode(batch.column("text"), END_ID):
                rows, ids = [], ids.astype("<u4")
                view, at = memoryview(ids).cast("B"), at.tolist()
                for k, (begin, end) in enumerate(zip(at, at[1:], strict=False), first):
                    doc_id, start, total = ids_of[k], 0, end - begin
                    for n in binary_lengths(total, longest):
                        bucket = n.bit_length() - 1
                        sequence = (bucket << _PARTITION_BITS | partition) << _PLACE_BITS | placed[bucket]
                        placed[bucket] += 1
                        rows.append((doc_id, start, n, zlib.crc32(view[4 * (begin + start) : 4 * (begin + start + n)]), total, sequence, 0, bucket))
                        start += n
                arrays = [pa.array(c, pa.int32() if name == "bucket" else pa.int64()) for name, c in zip(names, zip(*rows, strict=True), strict=True)]
                if keep_ids:
                    lengths = [r[2] for r in rows]
                    arrays.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, *(["ids"] if keep_ids else [])])

        return work

    return map_batches(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")), make, SCHEMA + (", ids array<int>" if keep_ids else ""))
