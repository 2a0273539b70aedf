"""Language ID by a linear-chain conditional random field over words.

A word's emission scores sum the weights of its character n-grams (those at its edges, with a mark, are
its affixes) and of its entry in a learned lexicon. Transitions are learned from code-switched
sequences, which are put together from stretches of labelled documents in different languages.
A text's words are labelled by forward-backward; its language is the one with most posterior mass.
"""

from __future__ import annotations

import hashlib
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, crc_mod, crc_of_id, held, map_batches, strings

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
#: ASCII that is no letter separates words
_TO_BLANK = bytes(b if chr(b).isalpha() or b >= 128 else 32 for b in range(256))
UNDETERMINED = "und"


@dataclass(frozen=True)
class Training:
    """Bounds of the training sample and of the fit."""

    docs_per_lang: int = 300
    longest_doc: int = 200_000
    #: characters of all texts that come to the driver, in equal shares of the languages
    most_chars: int = 32_000_000
    words_per_lang: int = 24_000
    sequence: int = 64
    switch_words: int = 16
    lexicon: int = 4000
    slots_bits: int = 15
    steps: int = 40
    rate: float = 0.15
    l2: float = 1e-6


def words_of(text: str) -> list[bytes]:
    """Lower-cased words as UTF-8."""
    return text.lower().encode("utf-8", "replace").translate(_TO_BLANK).split()


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def word_features(words: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams (n = 1 to 4) of marked words: (slot, index of its word), in word order."""
    text = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words), np.uint8).astype(np.uint32)
    sizes = np.array([len(w) + 2 for w in words])
    owner = np.repeat(np.arange(len(words)), sizes)
    end = np.repeat(np.cumsum(sizes), sizes)
    place = np.arange(len(text))
    slots, owners = [], []
    gram = np.zeros(len(text), np.uint32)
    with np.errstate(over="ignore"):
        for n in range(1, 5):
            shifted = np.zeros(len(text), np.uint32)
            shifted[: len(text) - n + 1] = text[n - 1 :]
            gram = gram << np.uint32(8) | shifted
            ok = place + n <= end
            h = (gram[ok] + np.uint32(n * 0x3C6EF372 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            h = h * np.uint32(0x85EBCA77)
            slots.append(h >> np.uint32(32 - bits))
            owners.append(owner[ok])
    return np.concatenate(slots), np.concatenate(owners)


@dataclass
class CRF:
    langs: list[str]
    weights: np.ndarray
    lexicon: dict[bytes, int]
    lexicon_weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray
    bits: int

    def emissions(self, words: list[bytes]) -> np.ndarray:
        slots, owners = word_features(words, self.bits)
        out = np.stack([np.bincount(owners, self.weights[slots, k], len(words)) for k in range(len(self.langs))], axis=1)
        known = np.array([self.lexicon.get(w, 0) for w in words])
        return (out + self.lexicon_weights[known]).astype(np.float32)


def forward_backward(emit: np.ndarray, sizes: np.ndarray, transitions: np.ndarray, start: np.ndarray, chunk: int = 128) -> np.ndarray:
    """Posterior of each label at each word; `emit` holds the words of all texts in a row, `sizes` their numbers.

    Long texts are cut into chunks: a first pass gives each chunk's transfer matrix, a short pass over
    chunks gives the messages at their edges, and a last pass fills them in. All chunks of all
    texts go in step, so a step is one array operation however long a text is. The result is exact.
    """
    n, labels = emit.shape
    x = np.exp(emit - emit.max(axis=1, keepdims=True)).astype(np.float64) + 1e-30
    a = np.exp(transitions - transitions.max())
    first = np.exp(start - start.max())
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    per_text = -(-sizes // chunk)
    text_of = np.repeat(np.arange(len(sizes)), per_text)
    chunk_at = np.concatenate([[0], np.cumsum(per_text)])
    number = np.arange(len(text_of)) - chunk_at[text_of]
    begin = offsets[text_of] + number * chunk
    size = np.minimum(chunk, offsets[text_of + 1] - begin)
    order = np.argsort(-size, kind="stable")
    begin_o, size_o = begin[order], size[order]
    active = np.searchsorted(-size_o, -np.arange(chunk), "left")  # chunks longer than t
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))

    def norm(v):
        return v / v.sum(axis=-1, keepdims=True)

    several = bool((per_text > 1).any())
    inbound = np.tile(norm(first), (len(order), 1))  # message into a chunk's first word, before its emission
    outbound = np.ones((len(order), labels))  # message from behind a chunk's last word
    if several:
        m = np.tile(np.eye(labels), (len(order), 1, 1))  # from a chunk's first word, its emission included, to its last
        for t in range(chunk):
            k = active[t]
            if not k:
                break
            if t:
                m[:k] = (m[:k].reshape(-1, labels) @ a).reshape(k, labels, labels)
            m[:k] *= x[begin_o[:k] + t][:, None, :]
            m[:k] /= m[:k].sum(axis=(1, 2), keepdims=True)
        m = m[back]
        into, out = np.tile(norm(first), (len(order), 1)), np.ones((len(order), labels))
        for i in range(1, int(per_text.max())):
            c = chunk_at[:-1][per_text > i] + i
            into[c] = norm(np.einsum("nl,nlk->nk", into[c - 1], m[c - 1]) @ a)
        for i in range(int(per_text.max()) - 2, -1, -1):
            c = chunk_at[:-1][per_text > i + 1] + i
            out[c] = norm(np.einsum("nlk,nk->nl", m[c + 1], out[c + 1]) @ a.T)
        inbound, outbound = into[order], out[order]
    alpha = np.empty((n, labels))
    message = inbound
    for t in range(chunk):
        k = active[t]
        if not k:
            break
        at = begin_o[:k] + t
        v = message[:k] * x[at]
        v /= v.sum(axis=1, keepdims=True)
        alpha[at] = v
        message = v @ a
    posterior = np.empty((n, labels))
    beta = outbound.copy()
    for t in range(chunk - 1, -1, -1):
        k = active[t]
        if not k:
            continue
        at = begin_o[:k] + t
        p = alpha[at] * beta[:k]
        posterior[at] = p / p.sum(axis=1, keepdims=True)
        b = (x[at] * beta[:k]) @ a.T
        beta[:k] = b / b.sum(axis=1, keepdims=True)
    return posterior


def fit_crf(texts: list[tuple[str, str]], how: Training, seed: int = 11) -> CRF | None:
    """From (language, text) pairs; None without any word. Full-batch Adam on the log likelihood."""
    rng = np.random.default_rng(seed)
    langs = sorted({lang for lang, text in texts if words_of(text)})
    if not langs:
        return None
    pools = []
    for lang in langs:
        own = [w for k, text in texts if k == lang for w in [words_of(text)] if w]
        stretches = []
        for w in own:
            at = 0
            while at < len(w):
                size = 1 + int(rng.geometric(1 / how.switch_words))
                stretches.append(w[at : at + size])
                at += size
        stretches = [stretches[i] for i in rng.permutation(len(stretches))]
        pool, total = [], 0
        for s in stretches:
            if total >= how.words_per_lang:
                break
            pool.append(s)
            total += len(s)
        pools.append(pool)
    # a language stays with probability 1/2 at the end of a stretch, else any follows
    left = [list(p) for p in pools]
    words, labels, k = [], [], 0
    while any(left):
        if not left[k] or rng.random() < 0.5:
            k = int(rng.choice([i for i in range(len(langs)) if left[i]]))
        s = left[k].pop()
        words += s
        labels += [k] * len(s)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    top = sorted((w for w in counts if counts[w] > 1), key=lambda w: (-counts[w], w))[: how.lexicon]
    lexicon = {w: i + 1 for i, w in enumerate(top)}
    types = list(counts)
    type_of = {w: i for i, w in enumerate(types)}
    token = np.array([type_of[w] for w in words])
    truth = np.array(labels)
    slots, owners = word_features(types, how.slots_bits)
    known = np.array([lexicon.get(w, 0) for w in types])
    n, size = len(langs), 1 << how.slots_bits
    params = [np.zeros((size, n)), np.zeros((len(lexicon) + 1, n)), np.zeros((n, n)), np.zeros(n)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    sizes = np.array([min(how.sequence, len(words) - i) for i in range(0, len(words), how.sequence)])
    starts = np.arange(0, len(words), how.sequence)
    inner = np.setdiff1d(np.arange(1, len(words)), starts)
    hot = np.eye(n)[truth]
    for step in range(1, how.steps + 1):
        w, lex, trans, start = params
        of_type = np.stack([np.bincount(owners, w[slots, k], len(types)) for k in range(n)], axis=1) + lex[known]
        emit = of_type[token]
        posterior, pair = expectations(emit, sizes, trans, start, inner)
        gap = hot - posterior
        by_type = np.stack([np.bincount(token, gap[:, k], len(types)) for k in range(n)], axis=1)
        grads = [
            np.stack([np.bincount(slots, by_type[owners, k], size) for k in range(n)], axis=1),
            np.stack([np.bincount(known, by_type[:, k], len(lexicon) + 1) for k in range(n)], axis=1),
            hot[inner - 1].T @ hot[inner] - pair,
            gap[starts].sum(axis=0),
        ]
        grads[1][0] = 0
        for p, g, (m, v) in zip(params, grads, moments, strict=True):
            g = g / len(words) - how.l2 * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += how.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    w, lex, trans, start = params
    return CRF(langs, w.astype(np.float32), lexicon, lex.astype(np.float32), trans, start, how.slots_bits)


def expectations(emit: np.ndarray, sizes: np.ndarray, trans: np.ndarray, start: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of labels, and expected counts of label pairs at the words `inner` and before them."""
    posterior = forward_backward(emit, sizes, trans, start, int(sizes.max()))
    # P(i, j) at (t - 1, t) is alpha(i) a(i, j) x(j) beta(j); both messages come from posteriors and one-sided passes
    x = np.exp(emit - emit.max(axis=1, keepdims=True)) + 1e-30
    a = np.exp(trans - trans.max())
    offsets = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    alpha = np.empty_like(x)
    message = np.tile(np.exp(start - start.max()), (len(sizes), 1))
    for t in range(int(sizes.max())):
        on = np.flatnonzero(sizes > t)
        v = message[on] * x[offsets[on] + t]
        v /= v.sum(axis=1, keepdims=True)
        alpha[offsets[on] + t] = v
        message[on] = v @ a
    # x(j) beta(j) is posterior(j) over the message into t
    into = alpha[inner - 1] @ a
    tail = posterior[inner] / np.maximum(into, 1e-300)
    pair = (alpha[inner - 1].T @ tail) * a
    return posterior, pair


class Labeller:
    """Labels texts; remembers the emissions of words it has met, up to a bound in bytes, which is looked at before each batch."""

    #: bytes of a word held besides its own and its emissions'
    ENTRY = 170

    def __init__(self, model: CRF, most_bytes: int = 48 << 20):
        self.model, self.most_bytes = model, most_bytes
        self._clear()

    def _clear(self):
        self.known: dict[bytes, int] = {}
        self.table = np.zeros((1 << 14, len(self.model.langs)), np.float32)
        self.held = 0

    def emissions(self, words: list[bytes]) -> np.ndarray:
        if self.held > self.most_bytes:
            self._clear()
        at = list(map(self.known.get, words))
        if None in at:
            new = list({w for w, i in zip(words, at, strict=True) if i is None})
            base = len(self.known)
            while base + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            for k in range(0, len(new), 1 << 15):
                self.table[base + k : base + k + (1 << 15)][: len(new) - k] = self.model.emissions(new[k : k + (1 << 15)])
            self.known.update(zip(new, range(base, base + len(new)), strict=True))
            self.held += sum(map(len, new)) + len(new) * (self.ENTRY + 4 * self.table.shape[1])
            at = list(map(self.known.get, words))
        return self.table[np.array(at, np.int64)]

    def label(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Each text's language and its share of the words' posterior mass."""
        return [(lang, share) for lang, share, _ in self.judge(texts)]

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """Each text's language, its share, and the mean over words of the posterior of a word's own best language."""
        out: list[tuple[str, float, float]] = [(UNDETERMINED, 0.0, 0.0)] * len(texts)
        for lo, hi in by_bytes([len(t.encode("utf-8", "replace")) if t else 0 for t in texts], 1 << 20):
            which, words = [], []
            for i in range(lo, hi):
                if has_letter(texts[i]) and (w := words_of(texts[i])):
                    which.append(i)
                    words.append(w)
            if not which:
                continue
            sizes = np.array([len(w) for w in words])
            emit = self.emissions([w for ws in words for w in ws])
            posterior = forward_backward(emit, sizes, self.model.transitions, self.model.start)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            shares = np.add.reduceat(posterior, starts, axis=0) / sizes[:, None]
            sure = np.add.reduceat(posterior.max(axis=1), starts) / sizes
            for i, best, row, s in zip(which, shares.argmax(axis=1), shares, sure, strict=True):
                out[i] = (self.model.langs[best], float(min(1.0, row[best])), float(min(1.0, s)))
        return out

    def spans(self, text: str) -> list[tuple[str, str]]:
        """Each word of a code-switched text with its language."""
        words = words_of(text)
        if not words:
            return []
        p = forward_backward(self.emissions(words), np.array([len(words)]), self.model.transitions, self.model.start)
        return [(w.decode("utf-8", "replace"), self.model.langs[k]) for w, k in zip(words, p.argmax(axis=1), strict=True)]


def draw_bound(wanted: int, n: int) -> int:
    """The greatest of 2^63 hash values up to which about `wanted` of n rows lie; all of them if there are no more."""
    return (1 << 63) * min(wanted, n) // n - 1


def training_sample(docs: DataFrame, how: Training, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """Up to about `docs_per_lang` labelled documents of each language, chosen by a hash of the id, never more than twice as many in all.

    Only rows that can be drawn (with a text of up to `longest_doc` characters) count. Of what is drawn for a language as many
    whole texts as `most_chars` allows each of them come to the driver, one at least."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang")).filter("lang is not null")
    rows = rows.filter(F.length("text") <= how.longest_doc)
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row for each language
    if not sizes:
        return []
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("langid")), 1)
    bound = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, draw_bound(how.docs_per_lang, n))])
    chosen = rows.withColumn("draw", draw).filter(F.col("draw") <= bound[F.col("lang")])
    drawn = chosen.orderBy("draw", "doc_id", "text").limit(2 * how.docs_per_lang * len(sizes)).withColumn("n", F.length("text"))
    before = Window.partitionBy("lang").orderBy("draw", "doc_id", "text")
    shared = drawn.withColumn("sofar", F.sum("n").over(before)).withColumn("place", F.row_number().over(before))
    found = shared.filter((F.col("sofar") <= how.most_chars // len(sizes)) | (F.col("place") == 1)).orderBy("draw", "doc_id", "text").collect()
    return [(r.lang, r.text) for r in found]


def _labeller(packed: bytes) -> Labeller | None:
    """One labeller for each worker process and model, kept from task to task."""

    def make():
        model = pickle.loads(packed)
        return Labeller(model) if model else None

    return held(("crf", hashlib.sha256(packed).digest()), make)


def predict(docs: DataFrame, model: CRF | None, folds: int = 4, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    packed = pickle.dumps(model)

    def make():
        labeller = _labeller(packed)

        def work(batch):
            texts = strings(batch, "text")
            found = labeller.label(texts) if labeller else [(UNDETERMINED, 0.0)] * len(texts)
            out = [crc_mod(i, folds) == held_out if i is not None else None for i in batch.column("doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.bool_()), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

        return work

    return map_batches(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")), make, SCHEMA)


def keep_identified(docs: DataFrame, model: CRF | None, least: float = 0.4, text_col: str = "text") -> DataFrame:
    """The rows, all columns unchanged, whose text is identified: its words' best posteriors have a mean of at least `least`.

    How many languages a text switches between does not matter. Null, empty and letterless texts go, as do all without a
    model. Repeated rows each get their verdict, an empty table stays empty, and a text is read whole, in memory of
    some 100 bytes a word. Other columns may have any name."""
    packed = pickle.dumps(model)

    def make():
        labeller = _labeller(packed)

        def work(batch):
            found = labeller.judge(strings(batch, text_col)) if labeller else [(UNDETERMINED, 0.0, 0.0)] * batch.num_rows
            yield batch.filter(pa.array([lang != UNDETERMINED and sure >= least for lang, _, sure in found], pa.bool_()))

        return work

    return map_batches(docs, make, docs.schema)


def train(docs: DataFrame, folds: int = 4, held_out: int = 2, how: Training | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> CRF | None:
    """A model from the labelled rows outside the held-out fold; None if these have no word.

    Rows with a null id, text or language are not learned from, nor are texts over `longest_doc`. Repeated rows
    count each, and ties of the draw are taken in order of id and text.
    """
    how = how or Training()
    return fit_crf(training_sample(docs.filter(crc_of_id(id_col) % folds != held_out), how, id_col, text_col, lang_col), how)


def identify(docs: DataFrame, folds: int = 4, held_out: int = 2, how: Training | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Language of every document, learned from labelled documents outside the held-out fold.

    A null text and one without a letter get `und` and score 0, as do all texts if nothing is labelled.
    Rows with a null id are labelled but not learned from; their held_out is null. Repeated rows each give a row.
    Only the id, text and language columns are read. An empty table gives no rows; a text is read whole.
    """
    return predict(docs, train(docs, folds, held_out, how, id_col, text_col, lang_col), folds, held_out, id_col, text_col)
