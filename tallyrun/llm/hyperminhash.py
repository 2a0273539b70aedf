"""Near-duplicate classes by HyperMinHash signatures, confirmed on full shingle sets.

1. Each text's distinct shingles are hashed; equal sets form one class, so copies, however
   many, go on as one row.
2. A class gets a HyperMinHash signature: one hash of each shingle deals it to one of `registers` buckets, and
   a bucket keeps the number of leading zeros and the next mantissa bits of its least value. A bucket that a short
   text leaves empty takes the least of all its shingles rehashed with the bucket's number, so two sets agree in any
   register with the probability of their similarity. Bands of registers are bucket keys of the search.
3. Among the classes of a key one, another one for each key, is compared with the others: a star,
   not all pairs. The compressed registers give a collision-corrected estimate; pairs that
   may reach the threshold are confirmed on full sets, and links are joined into components.
4. Keys that still hold several components are compared in blocks: classes outside a key's largest component with
   all classes of other components, so a link that no star has found is found there. Its members get a longer
   signature, as in a group of near copies most pairs lie close below the threshold. A pair comes out of the first
   key it shares only, and what the estimates let through is confirmed in the same way.

With 128 registers in bands of four, a pair at similarity 0.75 misses all keys with
probability (1 - 0.75^4)^32 = 5e-6; both estimates keep margins of over four deviations, which is as rare.

Keys of many rows: a key that holds over one in MOST_HOT of all rows is joined by broadcast (there are MOST_HOT of them
at most), others by shuffle. A leader's pairs are confirmed in blocks, each of which gets the leader's set once.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, ship, stash, unstash, utf8

SCHEMA = "doc_id long, n_shingles long, component_id long, kept boolean"
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: keys with over one in so many of all rows are hot; so this is also the most that a broadcast may hold
MOST_HOT = 10_000


@dataclass(frozen=True)
class NearDupes:
    words: int = 5
    #: intersection over union, in percent, from which documents are linked
    percent: int = 75
    #: a power of two, as the registers of the longer signature
    registers: int = 128
    band: int = 4
    mantissa: int = 10
    #: estimates below this are not confirmed
    estimate: float = 0.58
    #: partners whose sets are confirmed with one copy of a leader's
    partners: int = 64
    #: members of a block in step 4, registers of their longer signature (a byte each) and its least estimate
    block: int = 512
    fine_registers: int = 1024
    fine_estimate: float = 0.69


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and of its inverse."""
    with np.errstate(over="ignore"):
        inverse = pow(int(_BASE), -1, 1 << 64)
        up = np.full(n, _BASE, np.uint64)
        down = np.full(n, np.uint64(inverse), np.uint64)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Shingler:
    def __init__(self, words: int):
        self.words = words
        self.up, self.down = _powers(1 << 16)

    def shingles(self, raw: bytes | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of a text's word shingles: of the bytes from a first to a last word, one blank between words."""
        words = (raw or b"").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        text = np.frombuffer(b" ".join(words), np.uint8)
        n = len(text)
        up, down = (self.up, self.down) if n < len(self.up) else _powers(n + 1)  # those of a long text are not kept
        with np.errstate(over="ignore"):
            prefix = np.zeros(n + 1, np.uint64)
            np.add(text, np.uint64(1), out=prefix[1:], dtype=np.uint64)
            prefix[1:] *= up[:n]
            np.cumsum(prefix[1:], out=prefix[1:])
            blanks = np.flatnonzero(text == 32)
            starts = np.concatenate([[0], blanks + 1])
            ends = np.concatenate([blanks, [n]])
            if len(words) > self.words:
                starts, ends = starts[: len(words) - self.words + 1], ends[self.words - 1 :]
            else:
                starts, ends = starts[:1], ends[-1:]
            return np.unique(mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64)))


class Signer:
    """HyperMinHash registers of 16 bits: leading zeros (6 bits) above mantissa bits of the least value in each bucket."""

    def __init__(self, registers: int, mantissa: int, seed: int = 5):
        if registers < 2 or registers & (registers - 1):
            raise ValueError("registers must be a power of two")
        self.mantissa, self.bits = mantissa, registers.bit_length() - 1
        self.edges = np.arange(registers, dtype=np.uint64) << np.uint64(64 - self.bits)
        rng = np.random.default_rng(seed)
        # for buckets that stay empty
        self.factors = rng.integers(0, 1 << 63, registers, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
        self.shifts = rng.integers(0, 1 << 63, registers, dtype=np.uint64)

    def least(self, shingles: np.ndarray, step: int = 2048) -> np.ndarray:
        """The least value of each bucket; the top bits of a hash are the bucket, and hashes are sorted, so it is a bucket's first."""
        with np.errstate(over="ignore"):
            first = np.searchsorted(shingles, self.edges)
            empty = np.append(first[1:], len(shingles)) == first
            out = shingles[np.minimum(first, len(shingles) - 1)] << np.uint64(self.bits)
            where = np.flatnonzero(empty)
            if len(where):
                rehashed = np.full(len(where), np.iinfo(np.uint64).max, np.uint64)
                for k in range(0, len(shingles), step):
                    part = shingles[k : k + step][None, :] * self.factors[where][:, None] + self.shifts[where][:, None]
                    np.minimum(rehashed, part.min(axis=1), out=rehashed)
                out[where] = rehashed
            return out

    def sign(self, shingles: np.ndarray) -> np.ndarray:
        """Registers of a set's sorted distinct hashes, of which there is one at least."""
        least = self.least(shingles)
        with np.errstate(over="ignore"):
            # frexp gives the place of the first one; the bits behind it are the mantissa
            exponent = np.frexp(least.astype(np.float64))[1].astype(np.int64)
            exponent -= (least < (np.uint64(1) << np.maximum(exponent - 1, 0).astype(np.uint64))) & (exponent > 0)
            zeros = np.minimum(64 - np.minimum(exponent, 64), 63).astype(np.uint64)
            behind = least << (zeros + np.uint64(1))
            behind[zeros == 63] = 0
            return (zeros << np.uint64(self.mantissa) | behind >> np.uint64(64 - self.mantissa)).astype("<u2")


def chance_equal(n: float, m: float, mantissa: int) -> float:
    """Probability that registers of disjoint sets of n and m items agree, by the exponential limit of least values.

    With leading zeros z and mantissa cell c, a least value lies in a cell of width 2^-(z+1+mantissa) at
    2^-(z+1) (1 + c / 2^mantissa); the cell's probabilities under both sizes are multiplied and summed."""
    z = np.arange(0, 40)[:, None]
    cells = 1 << min(mantissa, 6)
    low = 2.0 ** -(z + 1) * (1 + np.arange(cells)[None, :] / cells)
    width = 2.0 ** -(z + 1) / cells
    a = np.exp(-n * low) - np.exp(-n * (low + width))
    b = np.exp(-m * low) - np.exp(-m * (low + width))
    return float((a * b).sum()) / (1 << max(0, mantissa - 6))


def estimate(equal: np.ndarray, registers: int, n: np.ndarray, m: np.ndarray, mantissa: int) -> np.ndarray:
    """Jaccard estimate from agreeing registers, corrected for chance agreement in buckets of the sets' mean sizes."""
    bins = {}
    chance = np.empty(len(equal))
    for i, key in enumerate(zip(np.log2(np.maximum(n, 1)).astype(int).tolist(), np.log2(np.maximum(m, 1)).astype(int).tolist(), strict=True)):
        if key not in bins:
            bins[key] = chance_equal(*(max(1.0, 2.0**k / registers) for k in key), mantissa)
        chance[i] = bins[key]
    share = equal / registers
    return np.clip((share - chance) / (1 - chance), 0, 1)


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def _row_key(doc_id: Column, text: Column) -> dict[str, Column]:
    """What tells rows apart up to equal ids and texts, by plain equality: null ids are marked, texts hashed twice."""
    return {"id": F.coalesce(doc_id, F.lit(0)), "no_id": doc_id.isNull(), "key": F.xxhash64(text), "key2": F.xxhash64(F.lit("text"), text)}


def signatures(docs: DataFrame, how: NearDupes) -> DataFrame:
    """doc_id, text keys, n_shingles, fp (128-bit digest of the set; null if it is empty), sig."""

    def make():
        shingler, signer = Shingler(how.words), Signer(how.registers, how.mantissa)

        def work(batch):
            sizes, fps, sigs, known = [], [], [], {}
            for raw in utf8(batch, "text"):
                s = shingler.shingles(raw)
                sizes.append(len(s))
                if not len(s):
                    fps.append(None)
                    sigs.append(None)
                    continue
                fp = hashlib.blake2b(s, digest_size=16).digest()
                if fp not in known:
                    known[fp] = signer.sign(s).tobytes()
                fps.append(fp)
                sigs.append(known[fp])
            own = [batch.column(c) for c in ("doc_id", "text_key", "text_key2")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sizes, pa.int64()), pa.array(fps, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "text_key", "text_key2", "n_shingles", "fp", "sig"])

        return work

    key = _row_key(docs["doc_id"], docs["text"])
    return map_batches(docs.select("doc_id", "text", key["key"].alias("text_key"), key["key2"].alias("text_key2")), make, "doc_id long, text_key long, text_key2 long, n_shingles long, fp binary, sig binary")


def keys_of(sig: np.ndarray, band: int) -> np.ndarray:
    """Bucket keys (rows, bands) of signatures."""
    bands = sig.shape[1] // band
    key = np.zeros((len(sig), bands), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(band):
            key = mix(key * np.uint64(0x100000001B3) + sig[:, k : bands * band : band].astype(np.uint64) + np.uint64(1))
        return mix(key + np.arange(bands, dtype=np.uint64)[None, :] * _BASE).view(np.int64)


def band_keys(classes: DataFrame, how: NearDupes) -> DataFrame:
    """(key, node) for each band of each class."""

    def make():
        def work(batch):
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u2").reshape(-1, how.registers)
            keys = keys_of(sig, how.band)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column("node").to_numpy(), keys.shape[1]))], names=["key", "node"])

        return work

    return map_batches(classes.select("node", "sig"), make, "key long, node long")


def fine_signatures(sets: DataFrame, how: NearDupes) -> DataFrame:
    """(node, fine): more registers, each cut to a byte of its hash, from full sets."""

    def make():
        signer = Signer(how.fine_registers, how.mantissa, seed=17)

        def work(batch):
            values, ends = batch.column("shingles").flatten().to_numpy().view(np.uint64), np.cumsum(batch.column("shingles").value_lengths().to_numpy())
            fine = [(mix(signer.sign(part).astype(np.uint64)) >> np.uint64(56)).astype(np.uint8).tobytes() for part in np.split(values, ends[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(fine, pa.binary())], names=["node", "fine"])

        return work

    return map_batches(sets.select("node", "shingles"), make, "node long, fine binary")


def likely(pairs: DataFrame, how: NearDupes) -> DataFrame:
    """Pairs (a, b, m) whose estimate may reach the threshold, from pairs with n_a, n_b, sig_a and sig_b."""

    def make():
        def work(batch):
            n, m = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, how.registers) for c in ("sig_a", "sig_b"))
            near = estimate((x == y).sum(axis=1), how.registers, n, m, how.mantissa) >= how.estimate
            yield batch.select(["a", "b", "m"]).filter(pa.array(near))

        return work

    sized = pairs.filter(100 * F.least("n_a", "n_b") >= how.percent * F.greatest("n_a", "n_b"))
    return map_batches(sized.select("a", "b", "m", "n_a", "n_b", "sig_a", "sig_b"), make, "a long, b long, m long")


def shingle_sets(docs: DataFrame, nodes: DataFrame, how: NearDupes) -> DataFrame:
    """(node, shingles) of the given classes, each from the text of its first row. Equal rows are combined before they are dealt."""

    def make():
        shingler = Shingler(how.words)

        def work(batch):
            rows = [shingler.shingles(raw).view(np.int64) for raw in utf8(batch, "text")]
            ends = np.concatenate([[0], np.cumsum(list(map(len, rows)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(rows)))], names=["node", "shingles"])

        return work

    keys = ["id", "no_id", "key", "key2"]
    rows = docs.select("text", *(c.alias(k) for k, c in _row_key(docs["doc_id"], docs["text"]).items())).groupBy(*keys).agg(F.first("text").alias("text"))
    named = nodes.select("node", F.coalesce("rep", F.lit(0)).alias("id"), F.col("rep").isNull().alias("no_id"), F.col("text_key").alias("key"), F.col("text_key2").alias("key2"))
    return map_batches(rows.join(named, keys).select("node", "text"), make, "node long, shingles array<long>")


def grouped(batches, names: list[str]):
    """Runs of rows with equal values of the (integer) columns, from batches that are sorted by them: (first of its group, slice)."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy() for c in names]
        edge = np.flatnonzero(np.any([np.diff(c) != 0 for c in cols], axis=0)) + 1
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), batch.num_rows], strict=True):
            key = tuple(c[a] for c in cols)
            yield key != last, batch.slice(a, b - a)
            last = key


def confirm(pairs: DataFrame, sets: DataFrame, how: NearDupes) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold, from pairs (a, b, m) of which a has about m.

    A block holds a's set, which comes first, and the sets of some of its partners, which pass one behind the other.
    """
    blocks = F.ceil(F.col("m") / how.partners).cast("int")
    placed = pairs.select("a", "b", F.pmod(F.xxhash64("b"), blocks).cast("int").alias("block"))
    own = placed.select("a", "block").distinct().join(sets.withColumnRenamed("node", "a"), "a").select("a", "block", F.lit(-1).cast("long").alias("b"), "shingles")
    theirs = placed.join(sets.withColumnRenamed("node", "b"), "b").select("a", "block", "b", "shingles")
    unit = own.unionByName(theirs).repartition("a", "block").sortWithinPartitions("a", "block", "b")

    def run(batches):
        mine = None
        for first, part in grouped(batches, ["a", "block"]):
            shingles = part.column("shingles")
            if first:
                mine = np.array(shingles[0].values.to_numpy())
                part, shingles = part.slice(1), shingles.slice(1)
            if not part.num_rows:
                continue
            values, sizes = shingles.flatten().to_numpy(), shingles.value_lengths().to_numpy().astype(np.int64)
            # hashes are stored as signed numbers but sorted as unsigned ones
            at = np.minimum(np.searchsorted(mine.view(np.uint64), values.view(np.uint64)), len(mine) - 1)
            common = np.add.reduceat(mine[at] == values, np.cumsum(sizes) - sizes, dtype=np.int64)
            linked = 100 * common >= how.percent * (len(mine) + sizes - common)
            yield part.select(["a", "b"]).filter(pa.array(linked))

    ship(pairs.sparkSession)
    return unit.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label): nodes joined by links share a label.

    Each round takes every node to its least neighbour, one step further to that one's own, and contracts the
    links to what still joins different nodes. Links shrink to less than half in a round, so a few rounds do.
    """
    links = stash(links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    labels = None
    while True:
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label"))
        least = stash(least, "least")
        step = stash(least.join(least.select(F.col("node").alias("label"), F.col("label").alias("further")), "label").select("node", F.least("label", "further").alias("label")), "step")
        if labels is None:
            known = step
        else:
            moved = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
            known = stash(labels.join(moved, "label", "left").select("node", F.coalesce("further", "label").alias("label")), "labels")
        at = [step.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label")) for c in ("u", "v")]
        left = links.join(at[0], "u").join(at[1], "v").filter("u_label <> v_label")
        left = stash(left.select(F.least("u_label", "v_label").alias("u"), F.greatest("u_label", "v_label").alias("v")).distinct(), "links")
        done = left.limit(1).count() == 0
        for old in (links, least, *([labels, step] if labels is not None else [])):
            unstash(old)
        links, labels = left, known
        if done:
            return labels


def join_hot(rows: DataFrame, keys: DataFrame, total: int, on: str = "key") -> DataFrame:
    """Rows joined with a stored table of one row a key, m being the number of a key's rows, which are `total` in all."""
    most = total / MOST_HOT
    hot, cold = keys.filter(F.col("m") > most), keys.filter(F.col("m") <= most)
    met = rows.join(F.broadcast(hot), on)
    others = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(cold, on)
    return met.unionByName(others)


def blocked_pairs(members: DataFrame, how: NearDupes) -> DataFrame:
    """Likely pairs (a, b, m) over different components in each key, from members (key, node, label, m, major, minor,
    n_shingles, sig, fine): m is a key's number of members, `major` its largest component, `minor` how many are outside it.

    Classes outside the largest component are probes, all classes are targets. A block of probes meets a block of
    targets as a unit of its own, so no key is gathered whole, and work grows with probes times members. Only pairs of
    different components that pass sizes and both estimates come out, and of the keys that a pair shares only the
    first one lets it out.
    """
    spread = F.xxhash64("node")
    of = lambda c: F.ceil(F.col(c) / how.block).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), of(c) - 1))
    keep = ["key", "m", "node", "label", "major", "n_shingles", "sig", "fine"]
    targets = members.select(*keep, F.lit(False).alias("probe"), F.pmod(spread, of("m")).cast("int").alias("i"), every("minor").alias("j"))
    probes = members.filter("label <> major").select(*keep, F.lit(True).alias("probe"), F.pmod(spread, of("minor")).cast("int").alias("j"), every("m").alias("i"))
    unit = targets.unionByName(probes).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    bands = how.registers // how.band

    def pairs(group: list[pa.RecordBatch]):
        t = pa.Table.from_batches(group)
        probe, node, label, n = (t.column(c).to_numpy() for c in ("probe", "node", "label", "n_shingles"))
        if probe.all() or not probe.any():
            return None
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u2").reshape(-1, how.registers)
        fine = np.frombuffer(b"".join(t.column("fine").to_pylist()), np.uint8).reshape(-1, how.fine_registers)
        band = int(np.flatnonzero(keys_of(sig[:1], how.band)[0] == t.column("key")[0].as_py())[0])
        major = t.column("major")[0].as_py()
        found = []
        for k in np.flatnonzero(probe):
            # two probes meet twice, as either is the other's target; the smaller one's counts
            at = np.flatnonzero(~probe & (label != label[k]) & ((label == major) | (node > node[k])) & (100 * np.minimum(n, n[k]) >= how.percent * np.maximum(n, n[k])))
            equal = sig[at] == sig[k]
            near = equal.sum(axis=1) >= how.estimate * how.registers  # chance agreement only lowers an estimate
            at, equal = at[near], equal[near]
            if not len(at):
                continue
            first = equal[:, : bands * how.band].reshape(len(at), bands, how.band).all(axis=2).argmax(axis=1)
            at = at[first == band]
            share = (fine[at] == fine[k]).mean(axis=1)
            at = at[(share - 1 / 256) / (1 - 1 / 256) >= how.fine_estimate]
            found += [(int(node[k]), int(x)) for x in node[at]]
        if not found:
            return None
        a, b = np.array(found, np.int64).T
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), t.column("m")[0].as_py()))], names=["a", "b", "m"])

    def run(batches):
        held = []
        for first, part in grouped(batches, ["key", "i", "j"]):
            if first and held:
                if (out := pairs(held)) is not None:
                    yield out
                held = []
            held.append(part)
        if held and (out := pairs(held)) is not None:
            yield out

    ship(members.sparkSession)
    return unit.mapInArrow(run, "a long, b long, m long")


def verdicts(docs: DataFrame, how: NearDupes) -> DataFrame:
    """Each row (doc_id, text) with its text keys, n_shingles, fp, component_id and kept, as a stored table.

    One class of each component stays: the one with the least id, and of several such (an id with several near
    texts, or classes of null ids alone) the one with the least fp. Of it the rows with that id stay, or, as null
    ids name no document, a single row.
    """
    rows = stash(signatures(docs, how).withColumn("row", F.monotonically_increasing_id()), "rows")
    least = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key", "text_key2", "row")
    firsts = rows.filter("fp is not null").groupBy("fp", "n_shingles").agg(F.min(least).alias("least"), F.max("sig").alias("sig"))
    firsts = firsts.select("fp", "n_shingles", "sig", F.col("least.doc_id").alias("rep"), "least.text_key", "least.text_key2", F.col("least.row").alias("first"))
    classes = stash(firsts.withColumn("node", F.monotonically_increasing_id()), "classes")
    n_classes = classes.count()
    total = n_classes * (how.registers // how.band)

    keyed = band_keys(classes, how)
    # the leader of a key: least after an exclusive or with a value of the key, so another one for each key
    salt = F.xxhash64("key")
    stars = stash(keyed.groupBy("key").agg(F.min(F.col("node").bitwiseXOR(salt)).alias("x"), F.count("*").alias("m")).filter("m > 1").select("key", "m", F.col("x").bitwiseXOR(salt).alias("leader")), "stars")
    shared = stash(join_hot(keyed, stars, total), "shared")

    described = classes.select("node", "n_shingles", "sig")
    left = described.select(F.col("node").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sig").alias("sig_a"))
    right = described.select(F.col("node").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sig").alias("sig_b"))
    met = shared.filter("node <> leader").groupBy(F.least("node", "leader").alias("lo"), F.greatest("node", "leader").alias("hi")).agg(F.min("leader").alias("a"), F.max("m").alias("m"))
    star_pairs = met.select("a", F.when(F.col("a") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("b"), "m")
    candidates = stash(likely(star_pairs.join(left, "a").join(right, "b"), how), "candidates")
    sets = stash(shingle_sets(docs, classes.join(shared.select("node").distinct(), "node", "left_semi"), how), "sets")
    links = stash(confirm(candidates, sets, how), "confirmed")
    labels = components(links)

    open_members = shared.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    parts = open_members.groupBy("key", "label").agg(F.count("*").alias("n"))
    largest = parts.groupBy("key").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("m"))
    mixed = stash(largest.select("key", "m", F.col("most.label").alias("major"), (F.col("m") - F.col("most.n")).alias("minor")).filter("minor > 0"), "mixed")
    members = stash(join_hot(open_members, mixed, total), "members")
    fine = fine_signatures(sets.join(members.select("node").distinct(), "node", "left_semi"), how)
    rest = blocked_pairs(members.join(described.join(fine, "node"), "node"), how)
    known = [F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")]
    rest = stash(rest.select("*", *known).join(candidates.select(*known), ["lo", "hi"], "left_anti").select("a", "b", "m"), "rest")  # read twice
    more = stash(confirm(rest, sets, how), "more")
    of = labels.select(F.col("node").alias("a"), F.col("label").alias("a_label"))
    to = labels.select(F.col("node").alias("b"), F.col("label").alias("b_label"))
    between = more.join(of, "a", "left").join(to, "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    joined = components(between)  # links between components, which are few
    named = classes.join(labels, "node", "left").select("fp", "n_shingles", "rep", "first", F.coalesce("label", "node").alias("label"))
    further = joined.select(F.col("node").alias("label"), F.col("label").alias("further"))
    named = stash(named.join(further, "label", "left").select("fp", "n_shingles", "rep", "first", F.coalesce("further", "label").alias("label")), "named")
    least = named.groupBy("label").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "fp")).alias("least"), F.count("*").alias("m"))
    least = stash(least.select("label", "m", F.col("least.rep").alias("component_id"), F.col("least.fp").alias("best")), "leasts")
    of_fp = join_hot(named, least, n_classes, "label").select("fp", "n_shingles", "component_id", F.when(F.col("fp") == F.col("best"), F.col("first")).alias("first"))
    result = rows.drop("sig").join(of_fp, ["fp", "n_shingles"], "left")
    stays = F.col("first").isNotNull() & F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull() & (F.col("row") == F.col("first")))
    result = result.select("doc_id", "text_key", "text_key2", "n_shingles", "fp", F.coalesce("component_id", "doc_id").alias("component_id"), (F.col("fp").isNull() | stays).alias("kept"))
    result = stash(result, "verdicts")
    for old in (rows, classes, stars, shared, candidates, sets, links, labels, mixed, members, rest, more, joined, named, least):
        unstash(old)
    return result


def near_duplicates(docs: DataFrame, how: NearDupes | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Component of each document and whether it is the one that stays.

    Null and blank texts have no shingles and are linked with nothing, each being its own component. Texts
    with fewer words than a shingle have one shingle of them all. Repeated rows each give a row; rows of one id
    and set are copies of each other and share the verdict. A null id takes part, but names a component only if no
    other id does; of a component of null ids alone one row stays. An empty table gives no rows. Only the id and the
    text are read, so other columns may have any name. A text is hashed whole, in memory of some 40 bytes a byte of it.
    """
    return verdicts(_documents(docs, id_col, text_col), how or NearDupes()).select("doc_id", "n_shingles", "component_id", "kept")


def keep_one(docs: DataFrame, how: NearDupes | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, all columns unchanged whatever their names, of one document of each component.

    Of rows with equal id and text one stays, with any of their other values. Null and blank texts, which are linked
    with nothing, stay, as does one row of a component of null ids alone. An empty table stays empty.
    """
    found = verdicts(_documents(docs, id_col, text_col), how or NearDupes()).filter("kept")
    # a kept id may have several texts of one set, of which one stays; texts without a set are each their own
    alone = F.when(F.col("fp").isNull(), F.struct("text_key", "text_key2"))
    one = found.groupBy("doc_id", "fp", alone.alias("alone")).agg(F.min(F.struct("text_key", "text_key2")).alias("k"))
    keys = ["id", "no_id", "key", "key2"]
    kept = one.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), F.col("k.text_key").alias("key"), F.col("k.text_key2").alias("key2"))
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names that clash with none of ours
    at = {c: plain.columns[docs.columns.index(c)] for c in (id_col, text_col)}
    key = _row_key(plain[at[id_col]].cast("long"), plain[at[text_col]].cast("string"))
    # equal rows are combined before they are dealt; the join goes by the same keys
    single = plain.select(F.struct(*plain.columns).alias("row"), *(c.alias(k) for k, c in key.items())).groupBy(*keys).agg(F.first("row").alias("row"))
    return single.join(kept, keys, "left_semi").select("row.*").toDF(*docs.columns)
