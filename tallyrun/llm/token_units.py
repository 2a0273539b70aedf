"""Exact whole-text encoding from independent text units, each encoded once per batch and remembered within bounds.

A unit is a stretch whose ids do not depend on its neighbours. The pre-tokenizers here never join what stands before
white space with that white space, nor an ASCII letter or a letter of Latin-1 with ASCII punctuation behind it, nor such
punctuation with an ASCII letter behind it; only the apostrophe does, as it opens contractions. So texts are cut there,
all of a batch at once over its bytes; Arrow's dictionary finds the distinct units, and ids are gathered by them.
Two kinds of text are cut less: one that may hold a special token only before white space, and one with white space
beyond ASCII, or separators on whose kind libraries differ, not at all.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

from .common import by_bytes

_BLANK, _LETTER, _MARK, _ODD, _LEAD = 1, 2, 4, 8, 16


def _kinds() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    kinds[list(b" \t\n\r\x0b\x0c")] = _BLANK
    kinds[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = _LETTER
    kinds[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and b != 0x27]] = _MARK
    kinds[0x1C:0x20] = _ODD
    kinds[[0xC2, 0xE1, 0xE2, 0xE3]] = _LEAD
    return kinds


_KINDS = _kinds()


def odd_spaces(data: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Places of separators and white space beyond ASCII (the Mongolian vowel separator included) in UTF-8."""
    lead = np.flatnonzero(kinds == _LEAD)
    lead = lead[lead + 1 < len(data)]
    a, b = data[lead], data[lead + 1]
    c = data[np.minimum(lead + 2, len(data) - 1)]
    odd = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    odd |= (a == 0xE1) & ((b == 0x9A) & (c == 0x80) | (b == 0xA0) & (c == 0x8E))
    odd |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
    odd |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
    return np.concatenate([np.flatnonzero(kinds == _ODD), lead[odd]])


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of the units of texts that lie one behind the other; `offsets` has one more entry than texts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kinds = _KINDS[data]
    blank = kinds == _BLANK
    spaced = np.zeros(n, bool)
    spaced[1:] = blank[1:] & ~blank[:-1]
    letter = kinds == _LETTER
    mark = kinds == _MARK
    behind = letter.copy()  # a letter of Latin-1 ends here too
    behind[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    cut = spaced.copy()
    cut[1:] |= mark[1:] & behind[:-1]
    cut[1:] |= letter[1:] & mark[:-1]
    special = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
    for places, left in ((special, spaced), (odd_spaces(data, kinds), None)):
        for k in np.unique(np.searchsorted(offsets, places, "right") - 1).tolist():
            a, b = offsets[k], offsets[k + 1]
            cut[a:b] = False if left is None else left[a:b]
    cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(cut)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of a string column and where each row starts, one more entry than rows; null is empty."""
    filled = column.cast(pa.large_binary()).fill_null(b"")
    if not len(filled):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = filled.buffers()
    offsets = np.frombuffer(places, np.int64)[filled.offset : filled.offset + len(filled) + 1]
    content = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return content[offsets[0] : offsets[-1]], offsets - offsets[0]


def ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches [start, start + size) of an array, one behind the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class UnitCache:
    """Ids of units in one array, bounded in bytes: two generations of half the bound; what the older one still serves moves on.

    `encode` gets distinct units as bytes and gives all their ids and their numbers of ids. A unit of over `longest`
    bytes is not found again.
    """

    #: bytes of an entry besides its key's and its ids'
    ENTRY = 190

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], dtype: str, most_bytes: int = 64 << 20, longest: int = 128):
        self.encode, self.dtype, self.half, self.longest = encode, np.dtype(dtype), most_bytes // 2, longest
        self.older: tuple = ({}, None, None, None)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.starts, self.sizes = np.zeros(1 << 12, self.dtype), np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int32)
        self.held = self.n_ids = self.n = 0

    def _append(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Slots of units whose ids are put behind the others'."""
        for name, used, more in (("flat", self.n_ids, len(ids)), ("starts", self.n, len(sizes)), ("sizes", self.n, len(sizes))):
            old = getattr(self, name)
            if used + more > len(old):
                new = np.zeros(max(2 * len(old), used + more), old.dtype)
                new[:used] = old[:used]
                setattr(self, name, new)
        slots = np.arange(self.n, self.n + len(sizes))
        self.flat[self.n_ids : self.n_ids + len(ids)] = ids
        self.sizes[slots] = sizes
        self.starts[slots] = self.n_ids + np.cumsum(sizes) - sizes
        self.n_ids += len(ids)
        self.n += len(sizes)
        return slots

    def slots(self, units: list[bytes]) -> np.ndarray:
        """Where each of the distinct units has its ids in `flat`, by `starts` and `sizes`, until the next call."""
        if self.held > self.half:
            self.older = (self.known, self.flat, self.starts, self.sizes)
            self._clear()
        at = np.fromiter(map(self.known.get, units, repeat(-1)), np.int64, len(units))
        missing = np.flatnonzero(at < 0)
        if not len(missing):
            return at
        wanted = [units[i] for i in missing.tolist()]
        known, flat, starts, sizes = self.older
        found = np.fromiter(map(known.get, wanted, repeat(-1)), np.int64, len(wanted))
        new = np.flatnonzero(found < 0)
        old = np.flatnonzero(found >= 0)
        before, own = self.n_ids, np.empty(len(wanted), np.int64)
        if len(old):
            own[old] = self._append(ragged(flat, starts[found[old]], sizes[found[old]]), sizes[found[old]])
        if len(new):
            own[new] = self._append(*self.encode([wanted[i] for i in new.tolist()]))
        at[missing] = own
        lengths = list(map(len, wanted))
        if max(lengths) <= self.longest:
            self.known.update(zip(wanted, own.tolist(), strict=True))
        else:
            self.known.update((u, k) for u, k in zip(wanted, own.tolist(), strict=True) if len(u) <= self.longest)
        self.held += self.ENTRY * len(wanted) + sum(lengths) + (self.n_ids - before) * self.dtype.itemsize
        return at


class TextEncoder:
    """Ids of whole texts, a slice of a batch at a time. Without `cut` each text is one unit."""

    def __init__(self, cache: UnitCache, cut: bool = True, slice_bytes: int = 1 << 22):
        self.cache, self.dtype, self.cut, self.slice_bytes = cache, cache.dtype, cut, slice_bytes

    def encode(self, column: pa.Array, end_id: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, where each row's ids start and the last one's end) of slices of the column; each row ends in `end_id`."""
        data, offsets = column_bytes(column)
        end = np.zeros(0, self.dtype) if end_id is None else np.array([end_id], self.dtype)
        for lo, hi in by_bytes(np.diff(offsets).tolist(), self.slice_bytes):
            own, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            starts = unit_starts(own, at) if self.cut else at[:-1][at[:-1] < at[1:]]
            places = np.append(starts, len(own)).astype(np.int32)
            units = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(own)]).dictionary_encode()
            slots = self.cache.slots(units.dictionary.to_numpy(zero_copy_only=False).tolist())
            first, sizes, flat = self.cache.starts[slots], self.cache.sizes[slots].astype(np.int64), self.cache.flat[: self.cache.n_ids]
            which, ends = units.indices.to_numpy(), np.searchsorted(starts, at[1:])
            if end_id is not None:
                flat, first, sizes = np.append(flat, end), np.append(first, len(flat)), np.append(sizes, 1)
                which = np.insert(which, ends, len(slots))
                ends = ends + np.arange(1, len(ends) + 1)
            n = sizes[which]
            upto = np.concatenate([[0], np.cumsum(n)])
            yield lo, ragged(flat, first[which], n), upto[np.concatenate([[0], ends])]


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 is itself, the rest follow from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def plain_words(units: list[bytes], lowered: bool) -> np.ndarray:
    """Which units are letters of the ASCII, Latin-1 and extended Latin blocks (with a blank before them) and so one pre-token.

    Dotted capital I is no such letter where text is lower-cased, as its lower case ends in a mark."""
    data = np.frombuffer(b"".join(units), np.uint8)
    ends = np.cumsum(list(map(len, units)))
    starts = np.concatenate([[0], ends[:-1]])
    lead = (data >= 0xC3) & (data <= 0xC9)
    good = (_KINDS[data] == _LETTER) | lead
    good[1:] |= lead[:-1] & (data[1:] >= 0x80) & (data[1:] < 0xC0) & ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
    if lowered:
        good[1:] &= ~((data[:-1] == 0xC4) & (data[1:] == 0xB0))
    bad = np.concatenate([[0], np.cumsum(~good)])
    head = (data[starts] == 32) | lowered & (data[starts] == 10)
    return (bad[ends] == bad[starts + head]) & (ends - starts > head)


def library_encoder(path: str, dtype: str) -> tuple[Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], bool]:
    """Ids of units by the tokenizers library with their numbers, and whether texts may be cut into units for it.

    A plain word is one pre-token of a byte-level tokenizer, so it goes to the library's model at once (lower-cased
    if the tokenizer lower-cases); any other unit goes through the library's whole chain.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kinds = [k["type"] for k in (spec.get("normalizer") or {}).get("normalizers", [])]
    pre = spec.get("pre_tokenizer") or {}
    byte_level = pre.get("type") == "ByteLevel" and bool(pre.get("use_regex")) and not pre.get("add_prefix_space") and spec.get("normalizer") is None
    lowered = kinds == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"]
    tokenize, stand_in = t.model.tokenize, {b: c for c, b in byte_alphabet().items() if b}

    def encode(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        out: list[list[int] | None] = [None] * len(units)
        plain = plain_words(units, lowered) if byte_level or lowered else np.zeros(len(units), bool)
        if plain.any():
            words = b"\0".join([units[i] for i in np.flatnonzero(plain).tolist()])
            if lowered:  # white space is dropped
                words = words.translate(None, b" \n").decode().lower().encode()
            words = words.decode("latin-1").translate(stand_in).split("\0")
            for i, w in zip(np.flatnonzero(plain).tolist(), words, strict=True):
                out[i] = [x.id for x in tokenize(w)]
        rest = np.flatnonzero(~plain).tolist()
        if rest:
            for i, e in zip(rest, t.encode_batch_fast([units[i].decode("utf-8", "replace") for i in rest], add_special_tokens=False), strict=True):
                out[i] = e.ids
        return np.fromiter(chain.from_iterable(out), dtype), np.array(list(map(len, out)), np.int64)

    return encode, byte_level or lowered


def library_text_encoder(path: str, least_vocab: int = 0) -> TextEncoder:
    """Whole-text ids by the tokenizers library, as 16-bit integers where the vocabulary (or `least_vocab`) allows."""
    from tokenizers import Tokenizer

    dtype = id_dtype(max(least_vocab, Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)))
    encode, cut = library_encoder(path, dtype)
    return TextEncoder(UnitCache(encode, dtype), cut)


def id_dtype(vocab: int) -> str:
    return "<u2" if vocab <= 1 << 16 else "<u4"
