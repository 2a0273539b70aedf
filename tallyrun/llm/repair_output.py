"""Token ids in a grammar-compressed binary format (Re-Pair), with random access by document.

Each shard replaces its frequent id pairs by nonterminals, round after round, until no pair is
frequent enough. A shard file holds the rules, the length each rule expands to, the remaining
symbols and, for each document, where its symbols and its ids start; so one document, or
any stretch of ids in it, is decoded without the rest. No rule crosses a document's end.

File, little-endian: magic "TRRP", width of a symbol in bytes (u16), version (u16), vocabulary (u32),
rules (u32), documents (u32), symbols (u64), ids (u64); then rules (pairs of symbols), lengths (u32),
document ids (i64) and null flags (u8), symbol offsets and id offsets (u64, one more than documents),
symbols, and the crc32 (u32) of all before.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, ship, stash, tokenizer_path
from .packing import END_ID, document_encoder

SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"
HEADER = struct.Struct("<4sHHIIIQQ")


def frequent_pairs(keys: np.ndarray, least: int, most: int) -> np.ndarray:
    """Up to `most` keys that occur at least `least` times, most frequent first, ties by key."""
    if not len(keys):
        return keys[:0]
    ordered = keys  # the caller's own copy
    ordered.sort()
    edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    counts = np.diff(np.append(edge, len(ordered)))
    often = counts >= least
    values, counts = ordered[edge[often]], counts[often]
    return values[np.lexsort((values, -counts))[:most]]


def compress(ids: np.ndarray, ends: np.ndarray, vocab: int, rounds: int | None = None, per_round: int = 2048, least: int = 8, table_bits: int = 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, symbols, kept positions of the first id of each symbol). `ends` marks the last id of each document.

    Rounds go on until no pair is frequent enough, or for `rounds`. Symbols widen once 16 bits may not hold the next round's."""
    width, wide = 16, np.uint32
    seq, last, rules, at = ids.astype(wide), ends.copy(), [], np.arange(len(ids))
    symbol = vocab
    while len(seq) > 1 and rounds != 0:
        rounds = rounds and rounds - 1
        if width == 16 and symbol + per_round > 1 << 16:
            width, wide = 32, np.uint64
            seq = seq.astype(wide)
        keys = seq[:-1] << wide(width) | seq[1:]
        inside = ~last[:-1]
        pairs = frequent_pairs(keys[inside], least, min(per_round, (1 << width) - symbol))
        if not len(pairs):
            break
        # a table by hash finds a chosen pair in one step; of pairs that share a cell it has the most frequent, and the few others are looked for one by one
        slot = lambda k: (k * wide(0x9E3779B1) >> wide(32 - table_bits if width == 16 else 40 - table_bits)) & wide((1 << table_bits) - 1)
        cells, first = np.unique(slot(pairs), return_index=True)
        table = np.zeros(1 << table_bits, np.int32)
        table[cells] = first
        which = table[slot(keys)]
        hits = pairs[which] == keys
        for other in np.setdiff1d(np.arange(len(pairs)), first):
            found = keys == pairs[other]
            which[found] = other
            hits |= found
        hits &= inside
        hits = np.flatnonzero(hits)
        # of hits in a row, every other one is replaced, from the left
        fresh = np.concatenate([[True], np.diff(hits) != 1])
        order = np.arange(len(hits))
        hits = hits[(order - np.maximum.accumulate(np.where(fresh, order, 0))) % 2 == 0]
        used, new = np.unique(which[hits], return_inverse=True)
        rules.append(np.stack([pairs[used] >> wide(width), pairs[used] & wide((1 << width) - 1)], axis=1))
        seq[hits] = (symbol + new).astype(wide)
        last[hits] = last[hits + 1]
        keep = np.ones(len(seq), bool)
        keep[hits + 1] = False
        seq, last, at = seq[keep], last[keep], at[keep]
        symbol += len(used)
    return (np.concatenate(rules) if rules else np.zeros((0, 2), wide)), seq, at


def rule_lengths(rules: np.ndarray, vocab: int) -> np.ndarray:
    lengths = np.ones(vocab + len(rules), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        lengths[vocab + k] = lengths[a] + lengths[b]
    return lengths[vocab:]


def write_shard(doc_ids: list[int | None], parts: list[np.ndarray], vocab: int, **how) -> bytes:
    sizes = np.array([len(p) for p in parts], np.int64)
    ids = np.concatenate(parts)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    ends = np.zeros(len(ids), bool)
    ends[offsets[1:] - 1] = True
    rules, symbols, at = compress(ids, ends, vocab, **how)
    code = "<u2" if vocab + len(rules) <= 1 << 16 else "<u4"
    body = b"".join([
        HEADER.pack(b"TRRP", int(code[2]), 1, vocab, len(rules), len(parts), len(symbols), len(ids)),
        rules.astype(code).tobytes(),
        rule_lengths(rules, vocab).astype("<u4").tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        bytes(d is None for d in doc_ids),
        np.searchsorted(at, offsets).astype("<u8").tobytes(),
        offsets.astype("<u8").tobytes(),
        symbols.astype(code).tobytes(),
    ])
    return body + struct.pack("<I", zlib.crc32(body))


class Shard:
    """Random access to a shard file."""

    def __init__(self, data: bytes):
        magic, width, version, self.vocab, n_rules, self.n_docs, n_symbols, self.n_ids = HEADER.unpack_from(data)
        if magic != b"TRRP" or version != 1 or zlib.crc32(memoryview(data)[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("not a whole shard file")
        at = HEADER.size

        def take(code: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, code, n, at)
            at += out.nbytes
            return out

        self.rules = take(f"<u{width}", 2 * n_rules).reshape(-1, 2)
        lengths = take("<u4", n_rules)
        ids, null = take("<i8", self.n_docs), take("u1", self.n_docs)
        self.doc_ids = [None if x else int(i) for i, x in zip(ids, null, strict=True)]
        self.symbol_at = take("<u8", self.n_docs + 1).astype(np.int64)
        self.id_at = take("<u8", self.n_docs + 1).astype(np.int64)
        self.symbols = take(f"<u{width}", n_symbols)
        self.lengths = np.concatenate([np.ones(self.vocab, np.int64), lengths.astype(np.int64)])
        self.expanded = None

    def _expand(self) -> None:
        """Every symbol's ids in one buffer, with offsets; a rule's ids are those of its two sides."""
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        buffer = np.empty(self.offsets[-1], "<u4")
        buffer[: self.vocab] = np.arange(self.vocab)
        at = self.offsets.tolist()
        for k, (a, b) in enumerate(self.rules.tolist(), self.vocab):
            middle = at[k] + at[a + 1] - at[a]
            buffer[at[k] : middle] = buffer[at[a] : at[a + 1]]
            buffer[middle : at[k + 1]] = buffer[at[b] : at[b + 1]]
        self.expanded = buffer

    def decode(self, symbols: np.ndarray) -> np.ndarray:
        if self.expanded is None:
            self._expand()
        s = symbols.astype(np.int64)
        size = self.lengths[s]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.expanded[np.repeat(self.offsets[s] - (ends - size), size) + np.arange(total)]

    def document(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids of the k-th document, or of a stretch in it: lengths tell which symbols to open."""
        symbols = self.symbols[self.symbol_at[k] : self.symbol_at[k + 1]]
        n = int(self.id_at[k + 1] - self.id_at[k])
        stop = n if stop is None else min(stop, n)
        if start == 0 and stop == n:
            return self.decode(symbols)
        ends = np.cumsum(self.lengths[symbols])
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        skipped = int(ends[a - 1]) if a else 0
        return self.decode(symbols[a:b])[start - skipped : stop - skipped]


def write_ids(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, shard_ids: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard files (part, first_id within the part, n_ids, payload), stored in the shared folder, documents in ascending id order.

    Null ids come first; rows of one id are ordered by their text's hash, and equal rows all stay. A null
    text counts as empty: just the end id. The session's number of shuffle partitions gives the
    parts. A document is never split over shards, so a shard holds `shard_ids` ids and one document more at most.
    """
    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")

    def run(batches):
        from tokenizers import Tokenizer

        encoder = document_encoder(path, end_id)
        vocab = max(end_id + 1, Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True))
        part, first, held, ids, parts = TaskContext.get().partitionId(), 0, 0, [], []

        def flush():
            nonlocal first, held
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([first], pa.int64()), pa.array([held], pa.int64()), pa.array([write_shard(ids, parts, vocab)], pa.binary())], names=["part", "first_id", "n_ids", "payload"])
            first, held = first + held, 0
            ids.clear(), parts.clear()
            return row

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for k, own, at in encoder.encode(batch.column("text"), end_id):
                for doc_id, a, b in zip(doc_ids[k:], at[:-1].tolist(), at[1:].tolist(), strict=False):
                    ids.append(doc_id)
                    parts.append(own[a:b])
                    held += b - a
                    if held >= shard_ids:
                        yield flush()
        if ids:
            yield flush()

    ship(docs.sparkSession)
    return stash(ordered.mapInArrow(run, "part long, first_id long, n_ids long, payload binary"), "shards")


def read_ids(shards: DataFrame, keep_ids: bool = False) -> DataFrame:
    """One row per document from shard files: its place among all ids, its length and the digest of its ids."""
    totals = sorted((r.part, r.n) for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # one row for each part
    base, at = {}, 0
    for part, n in totals:
        base[part], at = at, at + n

    def make():
        def work(batch):
            for part, first, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "first_id", "payload")), strict=True):
                shard = Shard(payload)
                crcs, kept = [], []
                for k in range(shard.n_docs):
                    ids = shard.document(k)
                    crcs.append(zlib.crc32(ids))
                    if keep_ids:
                        kept.append(ids.astype(np.int32))
                starts = shard.id_at[:-1] + (base[part] + first)
                arrays = [pa.array(shard.doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(np.diff(shard.id_at), pa.int64()), pa.array(crcs, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(kept, pa.list_(pa.int32()))] if keep_ids else [])], names=[*names, *(["ids"] if keep_ids else [])])

        return work

    return map_batches(shards.select("part", "first_id", "payload"), make, SCHEMA + (", ids array<int>" if keep_ids else ""))
