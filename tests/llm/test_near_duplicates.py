"""HyperMinHash near-duplicates against all pairs, and the pipeline against a plain version."""

import random
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from pyspark.sql import functions as F
from tallyrun.llm.hyperminhash import NearDupes, Shingler, Signer, chance_equal, estimate, keep_one, keys_of, mix, near_duplicates
from tallyrun.llm.common import tokenizer_path
from tallyrun.llm.langid_crf import Labeller, train
from tallyrun.llm.line_rules import LineRules, judge
from tallyrun.llm.packing import binary_lengths

from .conftest import EDGE_TEXTS


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """Least reachable id of each row, by all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return [(d, len(sets[i]), min(least[find(i)])) for i, (d, _) in enumerate(rows)]


def corpus(seed):
    """Copies, near copies at all distances, chains, and texts that share a long passage."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    passage = [word() for _ in range(60)]
    texts = list(EDGE_TEXTS)
    for _ in range(12):
        base = [word() for _ in range(rng.choice([4, 5, 6, 12, 40, 150]))]
        texts += [" ".join(base)] * rng.randint(1, 4) + [" ".join(base).upper().replace(" ", "\n ")]
        chain = list(base)
        for _ in range(6):
            chain[rng.randrange(len(chain))] = word()
            texts.append(" ".join(chain))
    for _ in range(60):
        own = [word() for _ in range(rng.choice([5, 15, 25, 60]))]
        texts.append(" ".join(own + passage if rng.random() < 0.5 else passage + own))
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i, texts[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize("seed, block", [(1, 128), (2, 3)])
def test_components(make_docs, seed, block):
    rows = corpus(seed)
    got = sorted(tuple(r)[:4] for r in near_duplicates(make_docs(rows), NearDupes(block=block)).collect())
    assert got == sorted((d, n, c, d == c) for d, n, c in brute(rows))


def test_links_that_stars_miss(make_docs):
    """With one band the leader of a bucket may link to none; the blocks must find what is left."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(6):
            w[rng.randrange(200)] = f"x{rng.random()}"
        rows.append((i, " ".join(w)))
    how = NearDupes(registers=128, band=1, block=8)
    got = sorted(tuple(r)[:3] for r in near_duplicates(make_docs(rows), how).collect())
    assert got == sorted(brute(rows))


def test_edges(make_docs):
    one = near_duplicates(make_docs([(5, None), (3, ""), (9, " \n"), (7, "a b"), (2, "A  B"), (None, "lone words only here")])).collect()
    by = {r.doc_id: r for r in one}
    assert all(by[i].component_id == i and by[i].kept and by[i].n_shingles == 0 for i in (3, 5, 9))
    assert (by[7].component_id, by[7].kept, by[2].kept, by[2].n_shingles) == (2, False, True, 1)
    assert by[None].component_id is None and by[None].kept
    assert near_duplicates(make_docs(["x"]).limit(0)).count() == 0


def test_keep_one(make_docs):
    rows = [(1, "alpha beta gamma delta"), (1, "alpha beta gamma delta"), (2, "ALPHA beta gamma delta"), (3, None), (None, "something else"), (4, "")]
    docs = make_docs(rows)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, rows[0][1]), (3, None), (None, "something else"), (4, "")], key=str)


def test_keep_one_with_null_and_repeated_ids(make_docs):
    """The verdict is a row's, not its id's: null ids and ids with several texts keep one row of each component."""
    rng = random.Random(21)

    def near(base):
        w = list(base)
        w[rng.randrange(len(w))] = f"x{rng.random()}"
        return " ".join(w)

    a, b, c, d = ([f"{k}{i}" for i in range(120)] for k in "abcd")
    rows = [(3, " ".join(a)), (7, near(a)), (7, " ".join(b)), (None, near(a)), (None, " ".join(a))]  # 7 is rejected in one component and stays in another
    rows += [(None, " ".join(c)), (None, " ".join(c).upper()), (None, " ".join(c)), (None, near(c)), (None, near(c))]
    rows += [(9, " ".join(d)), (9, near(d)), (9, " ".join(d).upper())]
    sets = {"a": [0], "b": [2], "c": range(5, 10), "d": range(10, 13)}
    got = [(r.doc_id, r.text) for r in keep_one(make_docs(rows)).collect()]
    assert len(got) == 4 and all(sum(g == rows[i] for g in got for i in {rows[k]: k for k in own}.values()) == 1 for own in sets.values())
    verdict = near_duplicates(make_docs(rows)).collect()
    assert sorted(((r.doc_id, r.component_id) for r in verdict if r.kept and r.doc_id != 9), key=str) == [(3, 3), (7, 7), (None, None)]


def test_signatures():
    signer, shingler = Signer(128, 10), Shingler(5)
    rng = np.random.default_rng(0)
    x = mix(rng.integers(0, 1 << 63, 4000).astype(np.uint64))
    for share in (0.0, 0.4, 0.75, 1.0):
        k = int(round(3000 * 2 * share / (1 + share)))
        a, b = np.sort(x[:3000]), np.sort(np.concatenate([x[:k], mix(rng.integers(0, 1 << 63, 3000 - k).astype(np.uint64))]))
        equal = np.array([(signer.sign(a) == signer.sign(b)).sum()])
        assert abs(estimate(equal, 128, np.array([3000]), np.array([3000]), 10)[0] - share) < 0.16
    sig = signer.sign(x[:1])
    bucket = int(x[0]) >> 57
    for k, least in ((bucket, (int(x[0]) << 7) % (1 << 64)), (bucket - 1, (int(x[0]) * int(signer.factors[bucket - 1]) + int(signer.shifts[bucket - 1])) % (1 << 64))):
        zeros = 64 - least.bit_length()
        behind = (least << (zeros + 1)) % (1 << 64)
        assert sig[k] == zeros << 10 | behind >> 54
    assert 0 < chance_equal(1000, 1000, 10) < 2e-3
    assert len(shingler.shingles(b"a b c d e f")) == 2 and len(shingler.shingles(b"q " * 100_000)) == 1
    assert (shingler.shingles(b"A\tb\n c d e") == shingler.shingles(b"a b c d e")).all()


@pytest.mark.parametrize("size", [4, 8, 20, 60, 128, 400, 3000])
def test_pairs_at_the_threshold_share_a_key(size):
    """Registers agree as often as sets are similar, however short the texts, so recall at 0.75 holds at all sizes."""
    rng = np.random.default_rng(size)
    signer, shares, caught, tries = Signer(128, 10), [], 0, 400
    common = round(size * 6 / 7)
    own = size - common
    for _ in range(tries):
        h = mix(rng.integers(0, 1 << 63, common + 2 * own).astype(np.uint64))
        sigs = np.stack([signer.sign(np.sort(h[: common + own])), signer.sign(np.sort(np.concatenate([h[:common], h[common + own :]])))])
        shares.append((sigs[0] == sigs[1]).mean())
        keys = keys_of(sigs, 4)
        caught += bool((keys[0] == keys[1]).any())
    assert abs(np.mean(shares) - common / (common + 2 * own)) < 0.02
    assert caught >= tries - 1 if common / (common + 2 * own) >= 0.75 else caught > 0.95 * tries


def test_keep_one_with_clashing_columns(make_docs):
    from pyspark.sql import functions as F

    own = {"__text": F.lit("mine"), "__n": F.lit(7), "__kept": F.col("doc_id") * 2, "row": F.lit("r"), "key": F.lit(1), "id": F.lit(2), "fp": F.lit(3), "component_id": F.lit(4), "node": F.lit(5), "c0": F.lit(6)}
    docs = make_docs([(1, "alpha beta gamma delta"), (5, "alpha beta gamma delta"), (5, "another text altogether here")]).withColumns(own)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text, r["__text"], r["__n"], r["__kept"], r["row"], r["c0"]) for r in kept.collect()) == [(1, "alpha beta gamma delta", "mine", 7, 2, "r", 6), (5, "another text altogether here", "mine", 7, 10, "r", 6)]
    assert near_duplicates(docs).count() == 3
    assert keep_one(docs.limit(0)).columns == docs.columns and keep_one(docs.limit(0)).count() == 0


def test_hot_null_ids_do_not_multiply(make_docs):
    """Many rows without an id, of several near texts: classes are found by text, not by the null id alone."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(40):
        w = list(base)
        w[rng.randrange(80)] = f"x{i}"
        rows += [(None, " ".join(w))] * 5
    got = near_duplicates(make_docs(rows)).collect()
    assert len(got) == 200 and sum(r.kept for r in got) == 1 and all(r.component_id is None for r in got)


def test_intermediate_tables_go(make_docs, spark):
    import os

    from tallyrun.llm.common import shared_dir

    near_duplicates(make_docs(["a b c d e f g", "a b c d e f g h", "other"])).collect()
    left = {n.rsplit("-", 1)[0] for n in os.listdir(f"{shared_dir(spark).removeprefix('file://')}/tallyrun")}
    assert not left & {"rows", "classes", "stars", "shared", "candidates", "sets", "confirmed", "members", "mixed", "more", "least", "step"}


def test_pipeline(make_docs, spark, tmp_path):
    rng = random.Random(3)
    vocab = {"en": "the of and harbour wall report spring member plan figure old new".split(), "de": "der die das und hafen mauer bericht plan alt neu mitglied".split()}

    def prose(lang):
        return "\n".join(" ".join(rng.choice(vocab[lang]) + str(rng.randrange(60)) * (rng.random() < 0.3) for _ in range(12)).capitalize() + "." for _ in range(6))

    rows = [(i, prose("en" if i % 2 else "de"), "en" if i % 2 else "de") for i in range(40)]
    rows += [(100 + i, rows[i][1], rows[i][2]) for i in range(5)] + [(200, "12 34 " * 20, None), (201, None, None), (202, "junk*** words### " * 20, "en"), (203, "", "en")]
    # a line that the second stage takes out
    rows += [(205, prose("en") + "\nHome | News | Contact | About", "en")]
    make_docs(rows).withColumn("row", F.lit("clash")).withColumn("key", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    documents = spark.read.parquet(str(tmp_path / "documents.parquet"))
    labeller = Labeller(train(documents))
    sure = {r[0]: f[2] for r, f in zip(rows, labeller.judge([r[1] for r in rows]), strict=True)}
    assert sure[200] < 0.4 < sure[205] and sure[0] > 0.9
    judged = [(r[0], judge(r[1].encode(), LineRules())) for r in rows if sure[r[0]] >= 0.4]
    kept = [(d, j[10].decode()) for d, j in judged if j[6]]
    least = {d: c for d, _, c in brute(kept)}
    want = {d for d in least if least[d] == d}
    assert {r.doc_id for r in got} == want == {*range(40), 205}
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")).encode
    texts = dict(kept)
    assert "Home" not in texts[205]
    for d in want:
        own = sorted((r for r in got if r.doc_id == d), key=lambda r: r.start)
        assert [i for r in own for i in r.ids] == [*encode(texts[d], add_special_tokens=False).ids, 1]
        assert [r.length for r in own] == binary_lengths(own[0].doc_tokens, 2048)
    make_docs(rows).limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_duplicates", "packing"]
