"""Encoding, counting, packing and storing against the libraries themselves."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyrun.llm.bpe import BacktrackingBPE, encode_decode
from tallyrun.llm.common import held, tokenizer_path
from tallyrun.llm.packing import binary_lengths, pack
from tallyrun.llm.repair_output import Shard, read_ids, write_ids, write_shard
from tallyrun.llm.token_counts import PieceCounter, count_tokens, safe_parts
from tallyrun.llm.token_units import TextEncoder, UnitCache, library_encoder, library_text_encoder, unit_starts

from .conftest import EDGE_TEXTS

#: characters whose lower case has another length or is no letter, separators, marks that compose, and what cuts or must not
ALPHABET = st.lists(st.sampled_from(["İ", "İ.", "ŉ", "ǰ", "ẞ", "Σ", "ΑΣ", "K", "H\u0331", "<\u0338", "=\u0338", "\u0307", "\xa0", "\u2003", "\u180e", "\x1c", "\x85", "\u2028", "\0", "Ġ", "×", "÷", "A.", "a,b", "é!", "»a", "<|", "|>", "(a", "-", "\r\n", "2.5", "'ll", "O'", " ", "  ", "\n", "a", "e", "th", "ing", " the", "é", "ß", "1", "'s", "'", ".", ",", "!!", "***", "\t", "　", "日", "🙂", "́", "▁", "<|endoftext|>", "aaaa"]), max_size=30).map("".join)


@pytest.fixture(scope="module")
def bpe():
    return BacktrackingBPE(tokenizer_path("byte_bpe_50k.json"))


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


@settings(max_examples=500, deadline=None)
@given(texts=st.lists(ALPHABET, max_size=4))
def test_backtracking_is_exact(bpe, texts):
    want = [bpe.library.encode(t, add_special_tokens=False).ids for t in texts]
    for _, ids, at in bpe.units.encode(pa.array(texts, pa.string())):
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == want
        decoded, where = bpe.decode(ids, at)
        back = [decoded[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(where, where[1:], strict=False)]
        assert back == [bpe.library.decode(w, skip_special_tokens=False) for w in want]
        text, where = bpe.decimals(ids, at)
        assert [text[a:b].tobytes().decode() for a, b in zip(where, where[1:], strict=False)] == [",".join(map(str, w)) for w in want]


def test_pair_table_agrees_with_merging(bpe):
    rng = np.random.default_rng(0)
    tokens = sorted(bpe.id, key=bpe.id.get)[:3000]
    rank = bpe.rank

    def merge(s):
        parts = list(s)
        while len(parts) > 1:
            r, i = min((rank.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if r == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    for _ in range(2000):
        a, b = (tokens[k] for k in rng.integers(0, len(tokens), 2))
        assert bpe.pair_ok(a, b) == (merge(a + b) == [a, b])


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_units_add_up(name):
    """Also where the cache turns over all the time and slices end within a batch."""
    encode = library(name)
    units, cut = library_encoder(tokenizer_path(name), "<u2")
    assert cut
    small = TextEncoder(UnitCache(units, "<u2", most_bytes=2000, longest=6), slice_bytes=20)
    for encoder in (small, library_text_encoder(tokenizer_path(name))):

        @settings(max_examples=400, deadline=None)
        @given(texts=st.lists(ALPHABET, max_size=6))
        def check(texts):
            for end in (None, 1):
                got = [ids[a:b].tolist() for _, ids, at in encoder.encode(pa.array([None, *texts], pa.string()), end) for a, b in zip(at, at[1:], strict=False)]
                assert got == [encode(t) + [1] * (end is not None) for t in ["", *texts]]

        check()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_every_character_beside_every_kind(name):
    """Each character of the first planes that may change in lower-casing or be white space, at the edges of units."""
    encode, encoder = library(name), library_text_encoder(tokenizer_path(name))
    odd = [chr(c) for c in range(0x3100) if len(chr(c).lower()) != 1 or not chr(c).lower().isalpha() and chr(c).isalpha() or chr(c).isspace() or c < 0x250]
    texts = [f"Ab{c}. {c}a {c} x{c}{c}y!{c}'s ({c}){c}" for c in odd] + ["ANKARALİ. evet"]
    got = [ids[a:b].tolist() for _, ids, at in encoder.encode(pa.array(texts, pa.string())) for a, b in zip(at, at[1:], strict=False)]
    assert got == [encode(t) for t in texts]


def test_cache_is_bounded_in_bytes():
    """Long units and many of them: what is held stays near the bound, and one operator's state goes when another's task comes."""
    cache = UnitCache(lambda units: (np.zeros(sum(map(len, units)), np.uint16), np.array(list(map(len, units)))), "<u2", most_bytes=1 << 20, longest=128)
    for k in range(60):
        units = [b"%d-%d" % (k, i) + b"x" * 100 for i in range(500)] + [b"y" * 50_000 + b"%d" % k]
        slots = cache.slots(units)
        assert cache.sizes[slots].tolist() == list(map(len, units))
        held_now = sum(len(u) + UnitCache.ENTRY for g in (cache.known, cache.older[0]) for u in g) + 2 * cache.n_ids
        assert held_now < (1 << 20) + 2 * (500 * 600 + 150_000)
        assert not any(len(u) > 128 for u in cache.known)
    a = held(("test", 1), lambda: [1])
    assert held(("test", 1), lambda: [2]) is a
    held(("test", 2), lambda: [3])
    assert held(("test", 1), lambda: [4]) == [4]


def test_cuts():
    data = np.frombuffer("ab cd,e\n\nf é. <|x|> a\u3000b".encode(), np.uint8)
    assert unit_starts(data, np.array([0, 13, len(data)])).tolist()[:7] == [0, 2, 5, 6, 7, 10, 13]


@settings(max_examples=200, deadline=None)
@given(text=ALPHABET, longest=st.integers(1, 12))
def test_parts_count_as_the_whole(text, longest):
    model = _counter().model
    parts = safe_parts(text.encode(), longest)
    assert sum(len(model.encode(p)) for p in parts) == len(model.encode(text)) and b" ".join(parts) == text.encode()


_COUNTERS = []


def _counter():
    if not _COUNTERS:
        _COUNTERS.append(PieceCounter(tokenizer_path("piece_bpe_32k.model")))
    return _COUNTERS[0]


def test_encode_decode(make_docs):
    encode = library("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in encode_decode(make_docs(EDGE_TEXTS)).collect()}
    for i, text in enumerate(EDGE_TEXTS):
        ids = encode(text)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_count_tokens(make_docs):
    model = _counter().model
    got = {r.doc_id: r for r in count_tokens(make_docs(EDGE_TEXTS), limit=100).collect()}
    for i, text in enumerate(EDGE_TEXTS):
        n = len(model.encode(text or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 100)


def test_batches_by_bytes_and_models_that_cannot_be_split():
    counter = PieceCounter(tokenizer_path("piece_bpe_32k.model"), part_bytes=50, batch_bytes=200)
    assert counter.splits
    texts = [t.encode() for t in EDGE_TEXTS if t] + [b"", "日本 ".encode() * 400]
    want = [len(counter.model.encode(t.decode())) for t in texts]
    assert counter.counts(texts).tolist() == want
    sent, encode = [], counter.model.encode

    class Model:
        def encode(self, parts, **how):
            sent.append(list(parts))
            return encode(parts, **how)

    counter.model = Model()
    assert counter.counts(texts).tolist() == want
    assert all(sum(map(len, p)) <= 200 or len(p) == 1 for p in sent) and sum(map(len, sent)) > len(texts)
    counter.splits = False
    sent.clear()
    assert counter.counts(texts).tolist() == want and sum(map(len, sent)) == len(texts)


def test_splitting_needs_marks_at_the_front(monkeypatch):
    """A model with a mark inside a piece, or without one before a text, counts whole texts."""
    import sentencepiece

    for pieces, shown in ((["a", "b\u2581c"], ["\u2581a", "\u2581", "\u2581b"]), (["a"], ["a", "\u2581", "\u2581b"]), (["a"], ["\u2581a", "\u2581b"])):
        fake = type("Fake", (), {"__init__": lambda self, model_file: None, "get_piece_size": lambda self, p=pieces: len(p), "id_to_piece": lambda self, i, p=pieces: p[i], "encode": lambda self, t, s=shown, **how: s})
        monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", fake)
        assert not PieceCounter("x").splits


def test_binary_lengths():
    for n in [1, 2, 3, 2047, 2048, 2049, 4097, 10_000]:
        parts = binary_lengths(n, 2048)
        assert sum(parts) == n and all(p & (p - 1) == 0 and p <= 2048 for p in parts) and len(parts) <= n // 2048 + 11
    with pytest.raises(ValueError):
        pack(None, longest=1000)


def test_pack(make_docs):
    encode = library("byte_bpe_50k.json")
    rows = pack(make_docs(EDGE_TEXTS), keep_ids=True).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert [r.bucket for r in sorted(rows, key=lambda r: r.sequence_id)] == sorted(r.bucket for r in rows)
    for i, text in enumerate(EDGE_TEXTS):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        ids = [x for r in own for x in r.ids]
        assert ids == [*encode(text), 1] and all(r.offset == 0 and r.length == 1 << r.bucket and r.doc_tokens == len(ids) for r in own)
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4")) for r in own)


def test_shards_round_trip():
    rng = np.random.default_rng(1)
    parts = [rng.choice([5, 6, 7, 7, 7, 9], size=n).astype("<u2") for n in (1, 400, 3, 2000, 1)]
    data = write_shard([3, None, 5, 8, 8], parts, 16, least=3)
    s = Shard(data)
    assert s.doc_ids == [3, None, 5, 8, 8] and len(s.rules) > 3 and len(s.symbols) < sum(map(len, parts)) / 2
    for k, p in enumerate(parts):
        assert s.document(k).tolist() == p.tolist()
        for a, b in ((0, 1), (len(p) // 3, len(p) // 2), (len(p) - 1, len(p))):
            assert s.document(k, a, b).tolist() == p[a:b].tolist()
    with pytest.raises(ValueError):
        Shard(data[:-5] + bytes([data[-5] ^ 1]) + data[-4:])


@pytest.mark.parametrize("vocab, per_round, table_bits", [(300, 64, 18), (300, 64, 4), ((1 << 16) - 100, 64, 18)])
def test_rounds_go_on_until_no_pair_is_frequent(vocab, per_round, table_bits):
    """Also where pairs share cells of the hash table, and where symbols outgrow 16 bits on the way."""
    rng = np.random.default_rng(2)
    stock = [rng.integers(0, 300, size=40) for _ in range(60)]
    parts = [np.concatenate([stock[k] for k in rng.integers(0, 60, size=n)]).astype("<u4") for n in (3, 200, 500, 1)]
    s = Shard(write_shard(list(range(4)), parts, vocab, per_round=per_round, table_bits=table_bits))
    assert all(s.document(k).tolist() == p.tolist() for k, p in enumerate(parts))
    left = Counter()
    for a, b in zip(s.symbol_at[:-1], s.symbol_at[1:], strict=True):
        left.update(zip(s.symbols[a : b - 1].tolist(), s.symbols[a + 1 : b].tolist(), strict=True))
    assert max(left.values()) < 8


def test_wide_symbols():
    ids = np.tile(np.array([70_000, 70_001, 3], "<u4"), 200)
    assert Shard(write_shard([1], [ids], 80_000)).document(0).tolist() == ids.tolist()


def test_ids_in_order(make_docs):
    encode = library("word_bpe_49k.json")
    rows = [(i * 7 % 15, t) for i, t in enumerate(EDGE_TEXTS)] + [(None, "no id"), (4, "a second row"), (4, "a second row")]
    got = sorted(read_ids(write_ids(make_docs(rows), shard_ids=500), keep_ids=True).collect(), key=lambda r: r.start)
    assert [-1 if r.doc_id is None else r.doc_id for r in got] == sorted(-1 if r[0] is None else r[0] for r in rows)
    at = 0
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append([*encode(t), 1])
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids in texts[r.doc_id] and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4"))
        at += r.n_tokens


def test_empty_tables(make_docs):
    none = make_docs(["x"]).limit(0)
    assert encode_decode(none).count() == count_tokens(none).count() == pack(none).count() == read_ids(write_ids(none)).count() == 0


def test_clashing_columns(make_docs, spark):
    from pyspark.sql import functions as F

    docs = make_docs(["some text"]).withColumn("n_tokens", F.lit("x")).withColumn("start", F.lit(1)).withColumn("tie", F.lit(2)).withColumn("ids", F.lit(None))
    assert encode_decode(docs).first().n_tokens == count_tokens(docs).first().n_tokens == 2
    assert pack(docs).count() == 2 and read_ids(write_ids(docs)).first().n_tokens == 3
