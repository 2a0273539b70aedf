"""Line-first cleaning: rules judge each line, failing lines go, and a document that loses too much text goes too."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, utf8

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_removed_lines long, removed_share double, cleaned string"
SYMBOLS = b"#*$%&|<>"
SEPARATORS = frozenset([b"|", b">", b"\xc2\xbb", b"\xc2\xb7", b"\xe2\x80\xa2", b"/", b"::"])
SPACES = b" \t\n\r\x0b\x0c"
CLOSERS = (".", "!", "?", "…", ":", ";", '"', "”", "’", "»", ")", "。", "！", "？", ".'")
#: fixed phrases of sites, in lower case
BOILERPLATE = (
    b"lorem ipsum",
    b"enable javascript",
    b"javascript is disabled",
    b"javascript is required",
    b"accept cookies",
    b"accept all cookies",
    b"uses cookies",
    b"cookie policy",
    b"privacy policy",
    b"terms of use",
    b"terms of service",
    b"sign up for our newsletter",
    b"click here to",
    b"skip to content",
    b"skip to main content",
)


@dataclass(frozen=True)
class LineRules:
    """A line fails if it is a menu (separators between words), symbol-ridden, shouted, one word
    over and over, a site phrase, or a short stretch without closing punctuation. A document is
    rejected when failing lines hold more than `most_removed` of its words' bytes."""

    separator_share: float = 0.2
    symbol_share: float = 0.3
    shout_share: float = 0.7
    shout_words: int = 5
    same_word_share: float = 0.5
    same_word_words: int = 10
    open_line_words: int = 5
    most_removed: float = 0.3
    least_words: int = 20
    most_repeat_percent: int = 30


def repeat_words(words: list[bytes], width: int = 8) -> int:
    """Words inside windows of `width` words that occur twice or more, the first occurrence included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    if n > 64:  # equal windows have equal rolling hashes, so without a second one there is nothing to confirm
        own = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
        rolled = own[:n].copy()
        for k in range(1, width):
            rolled *= np.uint64(0x9E3779B97F4A7C15)
            rolled += own[k : n + k]
        rolled.sort()
        if (rolled[1:] != rolled[:-1]).all():
            return 0
    windows = list(zip(*(words[k : n + k] for k in range(width)), strict=True))
    if len(set(windows)) == n:
        return 0
    seen: dict[tuple, int] = {}
    again = bytearray(n)
    for i, w in enumerate(windows):
        j = seen.setdefault(w, i)
        if j != i:
            again[i] = again[j] = 1
    covered = upto = 0
    for i in range(n):
        if again[i]:
            covered += i + width - max(i, upto)
            upto = i + width
    return covered


def has_phrase(text: bytes) -> bool:
    low = text.lower()
    return any(p in low for p in BOILERPLATE)


def line_fails(line: bytes, words: list[bytes], rules: LineRules, phrases: bool = True) -> bool:
    """Without `phrases` the text that the line is of is known to hold no fixed phrase."""
    n = len(words)
    marks = len(line) - len(line.translate(None, SYMBOLS))
    if marks and marks >= rules.symbol_share * n:
        return True
    if n >= 3 and not SEPARATORS.isdisjoint(words) and sum(w in SEPARATORS for w in words) >= rules.separator_share * n:
        return True
    text = line.decode("utf-8", "replace")
    if n >= rules.shout_words:
        head = text[:1].lower() + text[1:]
        if not head.islower():  # islower holds for most lines at once; the count is for the rest
            upper = sum(map(str.isupper, text))
            if upper and upper > rules.shout_share * sum(map(str.isalpha, text)):
                return True
    if n >= rules.same_word_words and sum(map(bytes.__eq__, words, words[1:])) > rules.same_word_share * (n - 1):
        return True
    if phrases and has_phrase(line):
        return True
    return n < rules.open_line_words and not text.rstrip().endswith(CLOSERS)


def judge(raw: bytes, rules: LineRules) -> tuple:
    words = raw.split()
    n = len(words)
    # code points in words: all bytes but white space and UTF-8 continuation bytes
    word_chars = len(raw.decode("utf-8", "replace")) - (len(raw) - len(raw.translate(None, SPACES)))
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    repeats, phrases = repeat_words(words), has_phrase(raw)
    seen: set[bytes] = set()
    dup = lines = removed = lost = total = 0
    keep = []
    for line in raw.split(b"\n"):
        own = line.split()
        if not own:
            keep.append(line)
            continue
        lines += 1
        size = sum(map(len, own))
        total += size
        if line in seen:
            dup += 1
        seen.add(line)
        if line_fails(line, own, rules, phrases):
            removed += 1
            lost += size
        else:
            keep.append(line)
    base_failed = n < rules.least_words or 100 * repeats > rules.most_repeat_percent * n
    share = lost / total if total else 0.0
    return n, word_chars, n_symbols, dup, repeats, base_failed, not base_failed and share <= rules.most_removed, lines, removed, share, b"\n".join(keep)


def clean_lines(docs: DataFrame, rules: LineRules | None = None, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Base statistics, the verdict and (with `keep_text`) the cleaned text of every document.

    Words are runs without ASCII white space. A null or blank text has no words: all counts are 0,
    it fails the base test and is not kept. Repeated rows each give a row; only the id and
    the text column are read, so other columns may have any name. An empty table gives no rows. A text is judged
    whole, in memory of some 100 bytes a word.
    """
    rules = rules or LineRules()

    def make():
        def work(batch):
            cols = list(zip(*(judge(raw or b"", rules) for raw in utf8(batch, "text")), strict=True))
            ints = [pa.array(cols[i], pa.int64()) for i in range(5)]
            arrays = [batch.column("doc_id"), *ints, pa.array(cols[5], pa.bool_()), pa.array(cols[6], pa.bool_()), pa.array(cols[7], pa.int64()), pa.array(cols[8], pa.int64()), pa.array(cols[9], pa.float64())]
            arrays.append(pa.array([c.decode("utf-8", "replace") for c in cols[10]] if keep_text else [None] * batch.num_rows, pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names=[f.split(" ")[0] for f in SCHEMA.split(", ")])

        return work

    return map_batches(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")), make, SCHEMA)


def keep_clean(docs: DataFrame, rules: LineRules | None = None, text_col: str = "text") -> DataFrame:
    """The rows that the rules keep, without the lines that fail; all other columns stay unchanged, whatever their names.

    Lines without a word stay where they are, so a text none of whose lines fails comes back as it was. Null and blank
    texts fail the base test and go; repeated rows each get their verdict; an empty table stays empty. A text is judged
    whole, however long, a batch's one behind the other.
    """
    rules = rules or LineRules()
    at = docs.columns.index(text_col)

    def make():
        def work(batch):
            found = [judge(raw or b"", rules) for raw in utf8(batch, text_col)]
            texts = batch.column(at).to_pylist()
            cleaned = pa.array([f[10].decode("utf-8", "replace") if f[6] and f[8] else t for f, t in zip(found, texts, strict=True)], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), cleaned).filter(pa.array([f[6] for f in found], pa.bool_()))

        return work

    return map_batches(docs, make, docs.schema)
