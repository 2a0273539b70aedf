"""Line rules, language ID, quality, media and HTML."""

import hashlib
import itertools
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyrun.llm.html_extract import best_path, extract, host_of, main_text, score, text_under
from tallyrun.llm.langid_crf import CRF, Labeller, Training, draw_bound, expectations, fit_crf, forward_backward, identify, keep_identified, training_sample
from tallyrun.llm.line_rules import LineRules, clean_lines, judge, keep_clean, repeat_words
from tallyrun.llm.media_iso import MediaError, box, describe, full, media_columns, pad_payload, parse_media, read_media, read_samples, write_media
from tallyrun.llm.quality_qda import STATISTICS, document_statistics, fit, fit_moments, quality, statistics

from .conftest import EDGE_TEXTS

PROSE = "The committee met again on Tuesday to review the plans for the harbour.\nMost members agreed that the old wall should stay where it is.\nA second report will follow in the spring, once the figures are known."


# line rules


@settings(max_examples=200, deadline=None)
@given(words=st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60))
def test_repeat_words(words):
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    marked = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    assert repeat_words(words) == len(marked)


def test_line_statistics(make_docs):
    got = {r.doc_id: r for r in clean_lines(make_docs(EDGE_TEXTS)).collect()}
    for i, text in enumerate(EDGE_TEXTS):
        words = (text or "").encode().split()
        r = got[i]
        assert r.n_words == len(words) and r.word_chars == sum(len(w.decode()) for w in words)
        assert r.n_symbols == sum((text or "").count(c) for c in "#*$%&|<>")
        assert r.base_failed == (len(words) < 20 or 100 * r.n_repeat_words > 30 * len(words)) and not (r.base_failed and r.kept)


def test_rules_drop_lines_and_documents():
    menu = "Home | News | Sport | Weather | Contact | About | Help"
    more = "Nobody expects the works to start before the autumn, and several shops have asked for a quieter route past the market."
    text = f"{menu}\n{PROSE}\n{more}\nPlease accept cookies to go on.\nRead more"
    out = judge(text.encode(), LineRules())
    assert out[6] and out[8] == 3 and out[10].decode() == f"{PROSE}\n{more}"
    assert not judge((menu + "\n" + menu.replace("Home", "Start") + "\n" + PROSE.split("\n")[0]).encode(), LineRules())[6]
    for junk in ("word*** other$$$ thing### more&&& " * 10, "SHOUT!! LOUD!! NOISE!! MORE!! " * 3 + "END!! NOW!! HERE!! THERE!! WHY!! HOW!! WHO!! WHEN!!", "again " * 25):
        assert not judge(junk.encode(), LineRules())[6]
    assert judge((PROSE + "\n" + "Über Straßen und Wege läuft ein langer Weg, der nirgends endet.").encode(), LineRules())[6]
    assert judge(b"a b\na b\n\na b\nc", LineRules())[3] == 2


def test_keep_clean_keeps_columns(make_docs):
    docs = make_docs([PROSE, "junk", None])
    kept = keep_clean(docs)
    assert kept.columns == docs.columns and [r.text for r in kept.collect()] == [PROSE]


# language ID

LANGS = {"en": "the cat and the dog went to the house with a friend of mine", "de": "der hund und die katze gingen mit einem freund in das haus", "fr": "le chat et le chien sont dans la maison avec un ami de moi"}


def test_forward_backward_is_exact():
    rng = np.random.default_rng(3)
    sizes = np.array([4, 1, 300, 17])
    emit, trans, start = rng.normal(size=(sizes.sum(), 3)) * 2, rng.normal(size=(3, 3)), rng.normal(size=3)
    at = 0
    want = []
    for n in sizes:
        x, a = np.exp(emit[at : at + n]), np.exp(trans)
        alpha, beta = [np.exp(start) * x[0]], [np.ones(3)]
        for t in range(1, n):
            alpha.append((alpha[-1] / alpha[-1].sum()) @ a * x[t])
        for t in range(n - 1, 0, -1):
            b = a @ (x[t] * beta[-1])
            beta.append(b / b.sum())
        p = np.array(alpha) * np.array(beta[::-1])
        want.append(p / p.sum(axis=1, keepdims=True))
        at += n
    for chunk in (1, 5, 64, 1000):
        assert np.allclose(forward_backward(emit, sizes, trans, start, chunk), np.concatenate(want), atol=1e-12)


def test_code_switching():
    model = fit_crf([(k, v) for k, v in LANGS.items() for _ in range(20)], Training(steps=25))
    spans = Labeller(model).spans("the dog went to das haus und die katze avec le chien")
    assert [k for _, k in spans] == ["en"] * 4 + ["de"] * 5 + ["fr"] * 3
    assert model.transitions.diagonal().min() > model.transitions[~np.eye(3, dtype=bool)].max()
    small = Labeller(model, limit=3)  # a cache that starts again gives the same
    assert small.label(list(LANGS.values())) == Labeller(model).label(list(LANGS.values()))


def test_identify(make_docs):
    rows = [(i, f"{v} {i}", k) for i, (k, v) in enumerate(list(LANGS.items()) * 12)]
    rows += [(1000 + i, t, None) for i, t in enumerate([None, "", "123 !?", "der hund und die katze", "日本語"])]
    rows += [(None, "the dog and the cat", "en"), (1003, "der hund und die katze", None)]
    got = [(r.doc_id, r.lang_pred, r.score, r.held_out) for r in identify(make_docs(rows)).collect()]
    assert len(got) == len(rows)
    pred = {i: p for i, p, _, _ in got}
    assert all(pred[i] == k for i, _, k in rows[:36]) and pred[1003] == "de" and pred[None] == "en"
    assert [pred[1000 + i] for i in range(3)] == ["und"] * 3
    assert all(0 <= s <= 1 for _, _, s, _ in got)
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _, h in got if i is not None)
    nothing = identify(make_docs([(1, "no labels here")])).first()
    assert (nothing.lang_pred, nothing.score) == ("und", 0.0)
    assert identify(make_docs(rows).limit(0)).count() == 0


def test_gradient_of_the_chain():
    """Expected counts of labels and of label pairs are the derivatives of the log partition function."""
    rng = np.random.default_rng(5)
    sizes, labels = np.array([4, 1, 3]), 3
    emit, trans, start = rng.normal(size=(8, labels)), rng.normal(size=(labels, labels)), rng.normal(size=labels)

    def log_z(emit, trans, start):
        total, at = 0.0, 0
        for n in sizes:
            total += np.log(sum(np.exp(start[p[0]] + sum(emit[at + k, p[k]] for k in range(n)) + sum(trans[p[k - 1], p[k]] for k in range(1, n))) for p in itertools.product(range(labels), repeat=int(n))))
            at += n
        return total

    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    inner = np.setdiff1d(np.arange(8), starts)
    posterior, pair = expectations(emit, sizes, trans, start, inner)
    for what, expected in ((emit, posterior), (trans, pair), (start, posterior[starts].sum(axis=0))):
        for at in np.ndindex(what.shape):
            what[at] += 1e-5
            up = log_z(emit, trans, start)
            what[at] -= 2e-5
            down = log_z(emit, trans, start)
            what[at] += 1e-5
            assert abs((up - down) / 2e-5 - expected[at]) < 1e-6


def test_threshold_rejects_words_of_no_language(make_docs):
    """Words without any learned feature are as likely in each of four languages, so their best posterior is a quarter."""
    lexicon = {w: i + 1 for i, w in enumerate([b"the", b"der", b"le", b"el"])}
    weights = np.vstack([np.zeros(4), 9 * np.eye(4)]).astype(np.float32)
    model = CRF(list("abcd"), np.zeros((1 << 15, 4), np.float32), lexicon, weights, np.zeros((4, 4)), np.zeros(4), 15)
    docs = make_docs([(1, "the the the the"), (2, "xx yy zz xx"), (3, "the der le el"), (4, "the xx yy zz"), (5, "the der xx yy")])
    assert [round(s, 2) for _, _, s in Labeller(model).judge(["the the", "xx yy", "the xx yy zz"])] == [1.0, 0.25, 0.44]
    assert sorted(r.doc_id for r in keep_identified(docs, model).collect()) == [1, 3, 4, 5]
    assert sorted(r.doc_id for r in keep_identified(docs, model, least=0.5).collect()) == [1, 3, 5]


def test_training_texts_are_bounded_over_languages(make_docs):
    docs = make_docs([(i, f"{'wort ' * 20}{i}", f"l{i % 5}") for i in range(100)])
    found = training_sample(docs, Training(docs_per_lang=20, most_chars=5 * 350), "doc_id", "text", "lang")
    sizes = {lang: sum(len(t) for k, t in found if k == lang) for lang, _ in found}
    assert len(sizes) == 5 and all(100 < n <= 350 for n in sizes.values())
    assert len(training_sample(docs, Training(docs_per_lang=20, most_chars=5), "doc_id", "text", "lang")) == 5


def test_clashing_columns_and_empty_tables(make_docs, spark):
    """Columns with the operators' own names play no part and come through; empty tables give none or stay empty."""
    names = ["n_words", "kept", "held_out", "lang_pred", "score", "predicted", "x", "k", "v", "n_bytes", "feature", "codec", "error", "cleaned", "draw", "y", "id", "data"]
    docs = make_docs([(1, PROSE, "en"), (2, PROSE.replace("the", "der"), "de"), (3, None, "en")]).withColumns({n: F.lit(n) for n in names})
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int").withColumn("x", F.lit("x")).withColumn("score", F.lit("y"))
    assert clean_lines(docs).count() == media_columns(docs).count() == identify(docs).count() == quality(docs, labels).count() == 3
    model = fit_crf([("en", PROSE)], Training(steps=2))
    for kept in (keep_clean(docs), keep_identified(docs, model)):
        assert kept.columns == docs.columns and all(r[n] == n for r in kept.collect() for n in names)
    none = docs.limit(0)
    for empty in (clean_lines(none), keep_clean(none), keep_identified(none, model), identify(none), quality(none, labels), quality(none, labels.limit(0)), media_columns(none), parse_media(none.select(F.col("doc_id").alias("id"), F.lit(b"x").alias("data")))):
        assert empty.count() == 0
    files = spark.createDataFrame([(1, write_media(pad_payload(b"x")))] * 2, "id long, data binary").withColumn("codec", F.lit("mine"))
    assert [r.codec for r in parse_media(files).collect()] == ["raw ", "raw "]


def test_failing_lines_leave_the_text(make_docs):
    text = PROSE + "\n\nHome | News | Contact | About\nclick here to subscribe to it all"
    docs = make_docs([(1, text), (2, PROSE)]).withColumn("removed_share", F.lit("mine"))
    got = {r.doc_id: r for r in keep_clean(docs).collect()}
    assert got[1].text == PROSE + "\n" and got[2].text == PROSE and got[1].removed_share == "mine"


def test_quality_sums_over_rows(make_docs, spark):
    """The sums that Spark makes over all partitions are those of the labelled rows outside the held-out fold."""
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(["the", "Word", "a1", "##", "ünd", "end."], size=rng.integers(1, 60)))) for i in range(120)]
    stats = document_statistics(make_docs(rows))
    labels = spark.createDataFrame([(i, i % 2 if i % 7 else None) for i in range(0, 120, 2)] + [(i, i % 3 % 2) for i in range(1, 120, 2)], "doc_id long, quality int").filter("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    model = fit(stats, labels)
    known = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    x = {k: np.array([statistics(t.encode()) for i, t in rows if known.get(i) == k]) for k in (0, 1)}
    want = fit_moments(np.array([len(x[0]), len(x[1])], float), np.stack([x[k].sum(axis=0) for k in (0, 1)]), np.stack([x[k].T @ x[k] for k in (0, 1)]))
    assert np.allclose(model.means, want.means) and np.allclose(model.factors, want.factors, atol=1e-6) and np.allclose(model.log_priors, want.log_priors)
    assert np.allclose(model.inverses @ model.factors, np.eye(model.factors.shape[1]))


def test_training_sample(make_docs):
    """Rows that cannot be drawn do not count; the share drawn is never none, whatever the number of rows."""
    rows = [(i, None if i % 10 else f"der hund {i}", "de") for i in range(4000)] + [(5000 + i, "the " * 100 if i % 10 else f"the dog {i}", "en") for i in range(4000)]
    got = training_sample(make_docs(rows), Training(docs_per_lang=200, longest_doc=100), "doc_id", "text", "lang")
    assert all(150 < sum(lang == k for lang, _ in got) < 250 for k in ("de", "en"))
    for n in (1, 299, 300, 301, 10**6, 300_000_001, 10**12):
        assert draw_bound(300, n) < 1 << 63 and abs((draw_bound(300, n) + 1) / 2**63 * n - min(300, n)) < 1e-3


def test_keep_identified(make_docs):
    model = fit_crf([(k, v) for k, v in LANGS.items() for _ in range(20)], Training(steps=25))
    docs = make_docs([LANGS["en"], "123", None])
    assert [r.text for r in keep_identified(docs, model).collect()] == [LANGS["en"]]


def test_keep_texts_in_several_languages(make_docs):
    """A text that switches evenly between three languages has no share of 0.4, yet each of its words is identified."""
    model = fit_crf([(k, v) for k, v in LANGS.items() for _ in range(20)], Training(steps=25))
    text = " ".join([LANGS["en"].rsplit(" ", 1)[0], LANGS["de"], LANGS["fr"].rsplit(" ", 1)[0]] * 4)
    (lang, share), (_, _, sure) = Labeller(model).label([text])[0], Labeller(model).judge([text])[0]
    assert lang in LANGS and share < 0.4 and sure > 0.8
    assert [r.text for r in keep_identified(make_docs([text, "123"]), model).collect()] == [text]


# quality


def test_moments_are_those_of_the_rows():
    rng = np.random.default_rng(0)
    x = [rng.normal(0, 1, (300, 3)), rng.normal(2, 0.5, (500, 3))]
    m = fit_moments(np.array([300.0, 500.0]), np.stack([a.sum(axis=0) for a in x]), np.stack([a.T @ a for a in x]), to_pooled=0.0, to_identity=0.0, temperature=1.0)
    for k in (0, 1):
        assert np.allclose(m.factors[k] @ m.factors[k].T, np.cov(x[k].T))
    z = np.concatenate(x)
    log = [-0.5 * np.einsum("ij,jk,ik->i", z - m.means[k], np.linalg.inv(np.cov(x[k].T)), z - m.means[k]) - 0.5 * np.linalg.slogdet(np.cov(x[k].T))[1] + np.log([300, 500][k] / 800) for k in (0, 1)]
    assert np.allclose(m.scores(z), 1 / (1 + np.exp(log[0] - log[1])))
    assert fit_moments(np.array([0.0, 5.0]), np.zeros((2, 3)), np.zeros((2, 3, 3))) is None


def test_quality(make_docs, spark):
    rng = np.random.default_rng(4)
    words = ["harbour", "wall", "the", "of", "report", "member", "spring", "figure", "plan", "old"]
    good = [" ".join(rng.choice(words, 40)).capitalize() + "." for _ in range(60)]
    bad = [" ".join(w + "***" for w in rng.choice(words, 40)) for _ in range(60)]
    docs = make_docs([*good, *bad, None, "", "x" * 50_000])
    labels = spark.createDataFrame([*((i, 1, 0) for i in range(60)), *((i, 0, 0) for i in range(60, 120)), (5, None, 0), (None, 1, 0), (121, 7, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality(docs, labels).collect()}
    assert len(got) == 123 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    held = [r for r in got.values() if r.held_out and r.doc_id < 120]
    assert held and all(r.predicted == (r.doc_id < 60) for r in held)
    assert got[120].score == got[121].score
    assert {r.score for r in quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality(docs.limit(0), labels).count() == 0
    assert len(statistics(None)) == len(STATISTICS) and np.isfinite([statistics((t or "").encode()) for t in EDGE_TEXTS]).all()


# media


@settings(max_examples=60, deadline=None)
@given(raw=st.binary(max_size=20_000))
def test_media_round_trip(raw):
    media = write_media(pad_payload(raw))
    d = describe(media)
    assert read_samples(media, d["track"]) == pad_payload(raw)
    n = len(pad_payload(raw)) // 192
    assert (d["n_samples"], d["n_keyframes"], len(d["ranges"])) == (n, -(-n // 16), -(-n // 16))
    assert sum(b - a for a, b in d["ranges"]) == n * 192 and d["codec"] == "raw "


def test_media_tables_in_other_forms():
    table = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), box(b"avc1", bytes(78))),
        full(b"stts", struct.pack(">IIIII", 2, 2, 10, 2, 20)),
        full(b"stsz", struct.pack(">IIIIII", 0, 4, 3, 4, 5, 6)),
        full(b"stsc", struct.pack(">IIIIIII", 2, 1, 1, 1, 2, 3, 1)),
        full(b"co64", struct.pack(">IQQ", 2, 1000, 2000)),
        full(b"stss", struct.pack(">III", 2, 1, 3)),
    )
    media = box(b"mdia", full(b"mdhd", struct.pack(">QQIQI", 0, 0, 30, 60, 0), version=1), full(b"hdlr", struct.pack(">I4s12x", 0, b"vide"), b"\0"), box(b"minf", table))
    body = box(b"moov", box(b"trak", media))
    wide = struct.pack(">I4sQ", 1, b"free", 20) + bytes(4)
    d = describe(wide + body + struct.pack(">I4s", 0, b"mdat") + b"payload")
    assert (d["codec"], d["duration_ms"], d["n_samples"], d["n_keyframes"]) == ("avc1", 2000, 4, 2)
    assert d["ranges"] == [(1000, 1003), (2000, 2004), (2004, 2015)]
    for bad in (b"\0\0\0\x04moov", body[:-3], struct.pack(">I4s", 1, b"moov")):
        with pytest.raises(MediaError):
            describe(bad)
    assert read_media(b"") == []


def nested(kind: bytes, inner: bytes, depth: int) -> bytes:
    return b"".join(struct.pack(">I4s", len(inner) + 8 * (depth - k), kind) for k in range(depth)) + inner


def test_hostile_containers():
    """What a file says neither ends the task nor fills its memory."""
    track = lambda *t: box(b"moov", box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", *t)))))
    for bad in (track(box(b"mdhd")), track(box(b"hdlr")), track(box(b"tkhd")), track(full(b"stsz", struct.pack(">II", 0, 1 << 31))), track(full(b"stsz", struct.pack(">II", 9, 4_000_000_000))), track(full(b"stss", struct.pack(">II", 1, 5)))):
        with pytest.raises(MediaError):
            describe(bad)
    many = track(full(b"stsz", struct.pack(">II", 9, 4_000_000_000)), full(b"stsc", struct.pack(">IIII", 1, 1, 4_000_000_000, 1)), full(b"stco", struct.pack(">II", 1, 100)))
    d = describe(many)
    assert (d["n_samples"], d["n_keyframes"], d["ranges"]) == (4_000_000_000, 4_000_000_000, [(100, 100 + 36_000_000_000)])
    with pytest.raises(MediaError):
        read_samples(many, d["track"])
    assert read_media(nested(b"moov", b"", 50_000)) == []
    with pytest.raises(MediaError):
        read_media(nested(b"moov", b"1234567", 50) + b"\0\0\0\x07moov")


def test_damaged_containers():
    """Cut and changed files give their columns or a MediaError, nothing else."""
    rng = np.random.default_rng(3)
    whole = write_media(pad_payload(b"text " * 2000))
    for cut in [*range(0, 700, 3), len(whole) - 1]:
        try:
            describe(whole[:cut])
        except MediaError:
            pass
    for _ in range(3000):
        bad = bytearray(whole)
        for at in rng.integers(0, 700, rng.integers(1, 6)):
            bad[at] = rng.choice([0, 1, 255, rng.integers(0, 256)])
        try:
            read_samples(bytes(bad), describe(bytes(bad))["track"])
        except MediaError:
            pass


def test_fragments():
    """Samples of movie fragments, by their own sizes and by defaults, key frames by flags, places from the fragment's start."""
    media = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 10, 0, 0, 0)), full(b"hdlr", struct.pack(">I4s12x", 0, b"vide"), b"\0"), box(b"minf", box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"avc1", bytes(78))), full(b"stsz", struct.pack(">II", 0, 0)))))
    head = box(b"moov", box(b"trak", full(b"tkhd", struct.pack(">IIIII", 0, 0, 7, 0, 0)), media), box(b"mvex", full(b"trex", struct.pack(">5I", 7, 1, 2, 5, 0x10000))))
    def first(offset):
        return box(b"moof", full(b"mfhd", struct.pack(">I", 1)), box(b"traf", full(b"tfhd", struct.pack(">I", 7), flags=0x20000), full(b"trun", struct.pack(">Ii", 3, offset), *(struct.pack(">III", 2, size, key) for size, key in ((4, 0), (3, 0x10000), (5, 0))), flags=0x701)))
    one = first(len(first(0)) + 8) + box(b"mdat", b"abcd" + b"efg" + b"hijkl")
    def second(offset):
        return box(b"moof", box(b"traf", full(b"tfhd", struct.pack(">II", 7, 2), flags=0x20010), full(b"trun", struct.pack(">IiI", 3, offset, 0), flags=5)))
    two = second(len(second(0)) + 8) + box(b"mdat", b"mnopqr")
    data = head + one + two
    d = describe(data)
    a, b = data.index(b"abcd"), data.index(b"mnopqr")
    assert (d["codec"], d["n_samples"], d["n_keyframes"], d["duration_ms"]) == ("avc1", 6, 3, 1200)
    assert d["ranges"] == [(a, a + 7), (a + 7, a + 12), (b, b + 6)]
    assert read_samples(data, d["track"]) == b"abcdefghijklmnopqr"


def test_media_columns(make_docs, spark):
    rows = {r.doc_id: r for r in media_columns(make_docs(EDGE_TEXTS), keep_media=True).collect()}
    for i, text in enumerate(EDGE_TEXTS):
        payload = pad_payload((text or "").encode())
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest() and payload in bytes(r.media)
    assert rows[10][1:] == rows[11][1:] and rows[0][1:] == rows[1][1:]
    files = spark.createDataFrame([(1, bytes(rows[4].media)), (2, b"junk junk junk"), (3, None)], "id long, data binary")
    got = {r.id: r for r in parse_media(files).collect()}
    assert got[1].codec == "raw " and got[1].error is None and got[2].error and got[3].error
    assert media_columns(make_docs(["x"]).limit(0)).count() == 0


# HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head>
<body><nav><ul><li><a href="/a">Menu item</a></li></ul></nav><div class="ad">Buy this</div><div class="cookie-notice"><p>We use cookies, really many cookies, everywhere, all the time.</p></div>
<article class="post-12"><header>By someone</header><h1>Title &amp; more</h1><p>First  paragraph,
with <b>bold</b> and <a href="x">a link</a> &lt;here&gt;.<p>Second &eacute;t&#233; paragraph.<br>
<ul><li>One<li>Two</ul><aside>Aside</aside><form><input><p>Form</p></form><!-- <p>gone</p> --><div class="comments"><p>A reader's comment that goes on for long, longer than the text itself, on and on and on.</p></div></article>
<div class="sidebar"><p>Side</p></div><footer>&copy; Foot</footer>"""


def text_of(page):
    found = score(page)
    return text_under(found, best_path(found))


def test_main_text():
    assert text_of(PAGE) == "Title & more\nFirst paragraph, with bold and a link <here>.\nSecond été paragraph.\nOne\nTwo"


@pytest.mark.parametrize("page, want", [("", ""), ("plain text", "plain text"), ("<p>a</p>b", "a\nb"), ("<body><div>x < y and <3</div>", "x < y and <3"), ("<article><p>cut &am", "cut &am"), ("<article><h1>T</h1><p><b>T more.<br><p>Rest.</article><footer>f</footer>", "T\nT more.\nRest."), ("<div><p>one</div></p><p>two", "one\ntwo"), ("<article><script>never ends", ""), ("<article><p>a<!-- never ends", "a")])
def test_broken_pages(page, want):
    assert text_of(page) == want


LONG = "A long paragraph about the harbour and its old wall, which the members want to keep."


@pytest.mark.parametrize("wrapper", ["class='content with-sidebar'", "class='has-sidebar'", "class='no-sidebar'", "class='col side-by-side'", "id='page-header-fixed'", "class='x widget'", "id='header'"])
@pytest.mark.parametrize("inner", ["<article><h1>Title</h1><p>{0}</p></article>", "<h1>Title</h1><p>{0}</p>"])
def test_layout_wrappers_are_read(wrapper, inner):
    page = f"<body><div class='site-footer'><p>Foot</p></div><div {wrapper}>{inner.format(LONG)}<div class='main-sidebar'><p>Side</p></div><div class='related-posts'><article><p>Teaser</p></article></div></div>"
    assert text_of(page) == f"Title\n{LONG}"


def test_named_regions_stay_out():
    """However long, comments and notices beside the text are no text."""
    for region in ("cookie-notice", "comments", "post-comments", "site-footer", "ad-300", "sidebar"):
        assert text_of(f"<body><article><p>{LONG}</p></article><div class='{region}'><p>{LONG * 5}</p></div>") == LONG
    assert text_of(f"<body><div class='post'><p>{LONG}</p></div><div class='comments'><p>{LONG * 5}</p></div>") == LONG


def test_text_around_the_container():
    """Title, lead and text between parts belong to the text; link lists and other containers further up do not."""
    body = f"<p>{LONG}</p>" * 8
    want = "\n".join(["Title", "Lead."] + [LONG] * 8)
    assert text_of(f"<body><div class='post'><h1>Title</h1><p>Lead.</p><div class='body'>{body}</div></div>") == want
    assert text_of(f"<body><h1>Title</h1><p>Lead.</p><div class='body'>{body}</div><div class='x'><p>Other.</p></div>") == want
    assert text_of(f"<body><div class='all'><h1>Title</h1><div class='post'><p>Lead.</p><div class='body'>{body}</div></div><div class='x'><p>Other.</p></div></div>") == want
    assert text_of(f"<body><div class='post'><h1>Title</h1><p>Lead.</p><div class='body'>{body}</div><div class='tags'>{'<a>one tag of many</a> ' * 9}</div></div>") == want
    parts = "".join(f"<div class='part'>{body}</div><p>Between {i}.</p>" for i in range(3))
    assert text_of(f"<body><div class='post'>{parts}</div>") == "\n".join(["\n".join([LONG] * 8 + [f"Between {i}."]) for i in range(3)])


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p title=\"abc>hello world</p>", "hello world"),
        ("<p title='abc>hello</p><a href='x'>link</a><p>it's more</p>", "hello\nlink\nit's more"),
        ("<p title=\"a > b\" class=x>hello</p>", "hello"),
        ("<p data='<b>'>hello</p>", "hello"),
        ("<p a=b\"c>hello</p>", "hello"),
        ("<p>hello</p><a href=\"http://cut", "hello"),
        ("<p>a&#" + "1" * 5000 + ";b&#x" + "0" * 5000 + "41;</p>", "a\ufffdbA"),
        ("<p =a==b / c>hello</p/ x>", "hello"),
    ],
)
def test_tags_with_broken_attributes(page, want):
    assert text_of(page) == want


@pytest.mark.parametrize("unit", ["<a ", "<div>", "<div>x", "<p title=\"abc>hello ", "<p a='\">b ", "<b><div>x</b>", "<ul><li>x", "<li>x", "<!--", "<title>a</titl", "&#1", "<a href='", "< <3 "])
def test_long_pages_take_linear_time(unit):
    import time

    def seconds(size):
        page = unit * (size // len(unit))
        began = time.process_time()
        main_text(score(page), None)
        return time.process_time() - began

    seconds(50_000)
    assert seconds(1_000_000) < 12 * max(seconds(200_000), 0.1)


def test_random_pages():
    """Trees of random containers around a known text, with regions that are none: the text comes out, and nothing else."""
    import random

    for seed in range(150):
        rng = random.Random(seed)
        word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
        prose = lambda n: " ".join(word() for _ in range(n)) + "."
        junk = lambda: rng.choice([
            f"<nav><ul>{''.join(f'<li><a href=x>{word()}</a>' for _ in range(5))}</ul></nav>", f"<div class='sidebar'><p>{prose(20)}</p></div>", f"<div class=\"cookie-notice\"><p>{prose(15)}</p></div>",
            f"<form><input name=a><p>{prose(5)}</p></form>", f"<script>var a='<p>{word()}</p>';</script>", f"<div class='ad-{rng.randrange(99)}'>{prose(6)}</div>", f"<div id=comments><p>{prose(40)}</p></div>", "<!-- <p>no</p> -->", f"<aside>{prose(9)}</aside>", f"<style>p{{}}</style><footer>{prose(4)}</footer>",
        ])
        blocks, want = [], []
        for _ in range(rng.randint(3, 9)):
            text = prose(rng.randint(15, 50))
            tag = rng.choice(["p", "p", "p", "h2", "blockquote", "li"])
            inner = text.replace(" ", rng.choice([" ", "\n  ", "&#32;", "  "]), 3)
            if rng.random() < 0.5:
                first, rest = inner.split(maxsplit=1)
                inner = f"<b class='x{rng.randrange(9)}'>{first}</b> {rest}"
            blocks.append(f"<ul><li>{inner}</ul>" if tag == "li" else f"<{tag}>{inner}" + ("" if tag == "p" and rng.random() < 0.3 else f"</{tag}>"))
            want.append(text)
            if rng.random() < 0.3:
                blocks.append(junk())
        body = "".join(blocks)
        for _ in range(rng.randint(1, 5)):
            body = f"<{(t := rng.choice(['div', 'section', 'div', 'article', 'main']))} class='{word()}-{rng.randrange(99)}'>{body}</{t}>"
            if rng.random() < 0.5:
                body = junk() + body
            if rng.random() < 0.5:
                body += junk()
        page = f"<!DOCTYPE html><html><head><title>T</title></head><body>{junk()}{body}{junk()}</body></html>"
        assert text_of(page) == "\n".join(want), seed


def test_two_layouts_on_a_host(spark):
    """A page with one short line under the host's path is read by its own container."""
    usual = f"<body><div class='a'><p>{LONG}</p></div>"
    other = f"<body><div class='a'><p>By Ann.</p></div><div class='b'>{f'<p>{LONG}</p>' * 20}</div>"
    rows = [(i, f"http://h.example/{i}", usual) for i in range(5)] + [(5, "http://h.example/5", other)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: LONG for i in range(5)} | {5: "\n".join([LONG] * 20)}


def test_consensus(spark):
    """A page whose own best container is another than its host's is read by the host's path."""
    usual = "<body><div class='c1'><p>{0} words of the main text, as on all pages here.</p></div><div class='x'><p>{0} short</p></div>"
    odd = "<body><div class='c2'><p>Body text.</p></div><div class='x'><p>A very long block that is not the main text of this page at all, and yet longer.</p></div>"
    rows = [(i, f"http://h.example/{i}", usual.format(i)) for i in range(8)] + [(8, "http://h.example/8", odd), (9, None, "<p>lonely</p>"), (10, "http://h.example/n", None), (11, "http://other.example", "<div class='z'><p>other</p></div>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("path", F.lit(1))
    got = {r.page_id: r for r in extract(pages).collect()}
    assert len(got) == 12 and got[8].text == "Body text." and got[9].text == "lonely" and got[10].text == "" and got[11].text == "other"
    assert all(r.n_chars == len(r.text) for r in got.values())
    joined = {r.page_id: r.text for r in extract(pages, broadcast_hosts=0).collect()}
    assert joined == {k: r.text for k, r in got.items()}
    assert extract(pages.limit(0)).count() == 0


def test_hosts():
    assert [host_of(u) for u in (None, "x", "http://A.b/c", "//h:80/", "https://u@h.x?q")] == ["", "", "a.b", "h", "h.x"]
