"""Token counts: Arrow functions that return lengths only, batches balanced by bytes, long texts split at safe places."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import held, map_batches, tokenizer_path
from .token_units import column_bytes

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
MARK = "\u2581"
_MARK_END = MARK.encode()


def safe_parts(text: bytes, longest: int) -> list[bytes]:
    """Parts of a UTF-8 text whose token counts add up to the text's, of about `longest` bytes.

    The model writes a blank as a mark that opens a piece, puts one such mark before
    each text, and has no piece in which a mark follows another character. So a text
    may be cut at a blank after a non-blank: the blank itself is dropped, as the next
    part gets its mark by itself. A stretch without such a blank stays whole.
    """
    parts, at = [], 0
    while len(text) - at > longest:
        cut = at + longest
        while True:
            cut = text.find(b" ", cut)
            if cut < 0 or cut + 1 >= len(text):
                cut = -1
                break
            if cut > at and text[cut - 1] != 32 and not text.endswith(_MARK_END, at, cut):
                break
            cut += 1
        if cut < 0:
            break
        parts.append(text[at:cut])
        at = cut + 1
    parts.append(text[at:] if at else text)
    return parts


class PieceCounter:
    """Counts by a sentencepiece model. Texts are split only if the model has what safe_parts() relies on."""

    def __init__(self, path: str, part_bytes: int = 1 << 16, batch_bytes: int = 1 << 20):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.part_bytes, self.batch_bytes = part_bytes, batch_bytes
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        # a mark put before each text, blanks kept as marks, and marks at the front of pieces only
        shown = "".join(self.model.encode("a  b", out_type=str))
        self.splits = shown == f"{MARK}a{MARK}{MARK}b" and not any(MARK in p.lstrip(MARK) for p in pieces)

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """Numbers of tokens; what comes back from the library for a text is one array, of which only the length is kept."""
        totals, parts, owners, size = np.zeros(len(texts), np.int64), [], [], 0

        def flush():
            found = self.model.encode(parts, num_threads=1, return_type="numpy")
            np.add.at(totals, owners, list(map(len, found)))
            parts.clear(), owners.clear()

        for i, text in enumerate(texts):
            for part in safe_parts(text, self.part_bytes) if self.splits else [text]:
                if parts and size + len(part) > self.batch_bytes:
                    flush()
                    size = 0
                parts.append(part)
                owners.append(i)
                size += len(part)
        if parts:
            flush()
        return totals


def count_tokens(docs: DataFrame, model: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every text.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows each give a row, an empty
    table gives none, a null id stays null. Only the id and the text are read, so other
    columns, whatever their names, play no part. A long text goes to the library in parts, or whole if the
    model does not allow that.
    """
    path = model or tokenizer_path("piece_bpe_32k.model")

    def make():
        counter = held(("pieces", path), lambda: PieceCounter(path))

        def work(batch):
            data, at = column_bytes(batch.column("text"))
            view = memoryview(data)
            n = counter.counts([bytes(view[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

        return work

    return map_batches(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")), make, SCHEMA)
