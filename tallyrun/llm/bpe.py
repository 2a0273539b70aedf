"""BPE encoding by backtracking over longest matches, and decoding by an offset table.

Encoding is exact and linear: an Aho-Corasick automaton lists the vocabulary's matches,
the longest at each place is tried first, and a choice stands only if the pair it forms
with the token before it is compatible, that is, if merging both texts by rank would
give just these two tokens. A place from which no token fits is never tried again.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import held, map_batches, tokenizer_path
from .token_units import TextEncoder, UnitCache, byte_alphabet, ragged

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
NEVER = 1 << 60
_LETTERS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+")


class BacktrackingBPE:
    """Tokens are Latin-1 strings (a character a byte) inside; ids outside."""

    def __init__(self, path: str, memo: int = 1 << 20):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = self.back = byte_alphabet()
        plain = {t: "".join(chr(back[c]) for c in t) for t in spec["model"]["vocab"] if all(c in back for c in t)}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.id = {plain[t]: i for t, i in spec["model"]["vocab"].items() if t in plain and t not in self.special}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.rank = {(plain[a], plain[b]): r for r, (a, b) in enumerate(merges)}
        self.parts: dict[str, tuple[str, str]] = {}
        for a, b in self.rank:
            self.parts.setdefault(a + b, (a, b))
        # a token that its own merges do not rebuild can never come out
        self.id = {t: i for t, i in self.id.items() if len(t) == 1 or t in self.parts}
        self.shorter = {t: next((t[:n] for n in range(len(t) - 1, 0, -1) if t[:n] in self.id), None) for t in self.id}
        self.machine = ahocorasick.Automaton()
        for t in self.id:
            self.machine.add_word(t, t)
        self.machine.make_automaton()
        self.spines: tuple[dict, dict] = ({}, {})
        self.compatible: dict[tuple[str, str], bool] = {}
        self.memo = memo
        self.library = Tokenizer.from_file(path)
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = 1 + max([*self.id.values(), *self.special.values()])
        content = [b""] * size
        for t, i in self.id.items():
            content[i] = t.encode("latin-1")
        for t, i in self.special.items():
            content[i] = t.encode()
        self.offsets = np.concatenate([[0], np.cumsum([len(c) for c in content])])
        self.buffer = np.frombuffer(b"".join(content), np.uint8)
        text = [b"%d," % i for i in range(size)]
        self.text_offsets = np.concatenate([[0], np.cumsum([len(t) for t in text])])
        self.text = np.frombuffer(b"".join(text), np.uint8)
        self.units = TextEncoder(UnitCache(self.encode_units, "<u4"))

    def spine(self, token: str, side: int) -> list[tuple[str, int]]:
        """The nodes of a token's merge tree along one edge, from the byte up, each with the rank that absorbs it into the next."""
        known = self.spines[side].get(token)
        if known is not None:
            return known
        down = [token]
        while len(down[-1]) > 1:
            down.append(self.parts[down[-1]][side])
        up = down[::-1]
        made = self.spines[side][token] = [(t, self.rank[self.parts[up[i + 1]]] if i + 1 < len(up) else NEVER) for i, t in enumerate(up)]
        return made

    def pair_ok(self, a: str, b: str) -> bool:
        """Whether merging a + b by rank gives a, b: no merge over the boundary comes before those that build both."""
        known = self.compatible.get((a, b))
        if known is not None:
            return known
        left, right, i, j = self.spine(a, 1), self.spine(b, 0), 0, 0
        ok = True
        while ok:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            over = self.rank.get((x, y), NEVER)
            if over < min(x_ends, y_ends) or over == y_ends != NEVER and y_ends < x_ends:
                ok = False  # at equal rank the leftmost place is merged first
            elif x_ends == y_ends == NEVER:
                break
            elif x_ends <= y_ends:
                i += 1
            else:
                j += 1
        if len(self.compatible) >= self.memo:
            self.compatible.clear()
        self.compatible[a, b] = ok
        return ok

    def encode_piece(self, piece: str) -> list[str]:
        """Tokens of one pre-token (Latin-1)."""
        if piece in self.id:
            return [piece]
        n = len(piece)
        longest: list[str | None] = [None] * n
        for end, token in self.machine.iter(piece):
            at = end + 1 - len(token)
            if longest[at] is None or len(longest[at]) < len(token):
                longest[at] = token
        dead, out, at, token = set(), [], 0, longest[0]
        pair_ok, compatible, shorter = self.pair_ok, self.compatible, self.shorter
        while at < n:
            while token is not None and (at + len(token) in dead or out and not (compatible.get((out[-1], token)) or pair_ok(out[-1], token))):
                token = shorter[token]
            if token is None:
                dead.add(at)
                token = out.pop()
                at -= len(token)
                token = self.shorter[token]
            else:
                out.append(token)
                at += len(token)
                token = longest[at] if at < n else None
        return out

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens as Latin-1 strings; the library's own splitter decides on all but plain words."""
        if _LETTERS.fullmatch(text):
            return [text.encode().decode("latin-1")]
        back = self.back
        return ["".join(chr(back[c]) for c in p) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        marked = self.special_split and self.special_split.search(text)
        for part in self.special_split.split(text) if marked else [text]:
            if marked and part in self.special:
                ids.append(self.special[part])
            elif part:
                for piece in self.pieces(part):
                    ids += [self.id[t] for t in self.encode_piece(piece)]
        return ids

    def encode_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the units, and each one's number of ids."""
        out = [self.encode(u.decode("utf-8", "replace")) for u in units]
        return np.fromiter(chain.from_iterable(out), "<u4"), np.array(list(map(len, out)), np.int64)

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids, copied out of one buffer by the offset table, and where those of each stretch of ids start."""
        ids = ids.astype(np.int64)
        sizes = self.offsets[ids + 1] - self.offsets[ids]
        return ragged(self.buffer, self.offsets[ids], sizes), np.concatenate([[0], np.cumsum(sizes)])[at]

    def decimals(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids as decimal text with commas between those of a stretch, and where each stretch starts."""
        ids = ids.astype(np.int64)
        starts, sizes = self.text_offsets[ids], self.text_offsets[ids + 1] - self.text_offsets[ids]
        sizes[at[1:][at[1:] > at[:-1]] - 1] -= 1  # no comma behind the last
        return ragged(self.text, starts, sizes), np.concatenate([[0], np.cumsum(sizes)])[at]


def encode_decode(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode every whole text, decode the ids again, and return counts and digests (with `keep_ids` also the ids).

    A null text counts as empty: 0 tokens, digests of the empty string. Repeated rows each give
    a row; an empty table gives none; only the id and the text column are read, so others may have any name. A long text
    is encoded whole.
    """
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")

    def make():
        bpe = _worker(path)

        def work(batch):
            for first, ids, at in bpe.units.encode(batch.column("text")):
                counts = np.diff(at)
                text, text_at = bpe.decimals(ids, at)
                decoded, decoded_at = bpe.decode(ids, at)
                columns = [batch.column("doc_id").slice(first, len(counts)), pa.array(counts, pa.int64()), digests(text, text_at), digests(decoded, decoded_at, utf8=True)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(at.astype(np.int32), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

        return work

    return map_batches(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")), make, SCHEMA + (", ids array<int>" if keep_ids else ""))


def digests(data: np.ndarray, at: np.ndarray, utf8: bool = False) -> pa.Array:
    """Hexadecimal sha256 of each stretch of bytes; with `utf8` of it as text, what is not UTF-8 replaced."""
    view, out = memoryview(data), []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        part = view[a:b]
        if utf8:
            try:
                str(part, "utf-8")
            except UnicodeDecodeError:
                part = str(part, "utf-8", "replace").encode()
        out.append(hashlib.sha256(part).hexdigest())
    return pa.array(out, pa.string())


def _worker(path: str) -> BacktrackingBPE:
    """One encoder for each worker process, kept from task to task."""
    return held(("bpe", path), lambda: BacktrackingBPE(path))
