"""Quality by regularised quadratic discriminant analysis of transformed document statistics.

Both classes are Gaussians over a few statistics (shares under square roots, counts under
logarithms). Counts, sums and cross products of all labelled rows are summed in Spark, so nothing
is sampled. Each covariance is shrunk towards the pooled one and towards a multiple of the identity;
its Cholesky factor is computed once and gives a text's Mahalanobis distance and log density.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, map_batches, stash, utf8

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
_SYMBOLS = b"#*$%&|<>"
_DIGITS = b"0123456789"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_STOPS = b".,;:?"
_HIGH = bytes(range(128, 256))
_BLANKS = b" \t\n\r\x0b\x0c"
STATISTICS = ("words", "word_bytes", "symbols", "upper", "digits", "stops", "calls", "high_bytes", "distinct_words", "same_word", "compression", "line_words", "closed_lines", "repeated_lines", "entropy")


def statistics(raw: bytes | None) -> list[float]:
    """Transformed statistics of one text; null and empty texts share one fixed vector."""
    raw = raw or b""
    n = len(raw)
    words = raw.split()
    m = len(words)

    def count(kind: bytes) -> int:
        return n - len(raw.translate(None, kind))

    letters_up, letters = count(_UPPER), 0
    letters = letters_up + count(_LOWER)
    size = max(n, 1)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    k = max(len(lines), 1)
    cells = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if n else np.zeros(256)
    p = cells[cells > 0] / size
    # shares are drawn to a prior of a few cases, so that short texts stay near the middle
    return [
        np.log1p(m),
        np.log1p((n - count(_BLANKS)) / max(m, 1)),
        np.sqrt(count(_SYMBOLS) / size),
        np.sqrt((letters_up + 0.5) / (letters + 20)),
        np.sqrt(count(_DIGITS) / size),
        np.sqrt(count(_STOPS) / size),
        np.sqrt(raw.count(b"!") / size),
        np.sqrt(count(_HIGH) / size),
        np.log((len(set(words)) + 5) / (m + 5)),
        np.sqrt(sum(map(bytes.__eq__, words, words[1:])) / max(m, 1)),
        np.log((len(zlib.compress(raw, 1)) + 200) / (n + 400)),
        np.log1p(m / k),
        np.sqrt((sum(x.endswith((b".", b"!", b"?")) for x in lines) + 1) / (k + 2)),
        np.sqrt((len(lines) - len(set(lines))) / k),
        float(-(p * np.log2(p)).sum()),
    ]


@dataclass(frozen=True)
class QDA:
    """Class means, Cholesky factors of the shrunk covariances, and their inverses, all made once when fitted.

    `temperature` divides the difference of log densities: the statistics are not independent given the class, so
    that a Gaussian's densities overstate it, and divided scores stay away from 0 and 1.
    """

    means: np.ndarray
    factors: np.ndarray
    inverses: np.ndarray
    log_dets: np.ndarray
    log_priors: np.ndarray
    temperature: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1, from the difference of the log densities."""
        log = []
        for k in (0, 1):
            z = self.inverses[k] @ (x - self.means[k]).T
            log.append(self.log_priors[k] - 0.5 * self.log_dets[k] - 0.5 * (z**2).sum(axis=0))
        return 1 / (1 + np.exp(-np.clip((log[1] - log[0]) / self.temperature, -500, 500)))


def fit_moments(n: np.ndarray, total: np.ndarray, cross: np.ndarray, to_pooled: float = 0.2, to_identity: float = 0.02, temperature: float = 4.0) -> QDA | None:
    """From counts (2), sums (2, d) and cross products (2, d, d); None unless both classes have rows."""
    if min(n) < 1:
        return None
    means = total / n[:, None]
    scatter = np.stack([cross[k] - n[k] * np.outer(means[k], means[k]) for k in (0, 1)])
    d = total.shape[1]
    pooled = scatter.sum(axis=0) / max(n.sum() - 2, 1)
    factors, inverses, dets = [], [], []
    for k in (0, 1):
        own = scatter[k] / max(n[k] - 1, 1)
        s = (1 - to_pooled) * own + to_pooled * pooled
        s = (1 - to_identity) * s + to_identity * max(np.trace(s) / d, 1e-6) * np.eye(d)
        chol = np.linalg.cholesky((s + s.T) / 2)
        factors.append(chol)
        inverses.append(np.linalg.solve(chol, np.eye(d)))
        dets.append(2 * np.log(np.diag(chol)).sum())
    return QDA(means, np.stack(factors), np.stack(inverses), np.array(dets), np.log(n / n.sum()), temperature)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics of each row, stored so that fitting and scoring read the text once."""

    def make():
        def work(batch):
            x = [np.array(statistics(raw)) for raw in utf8(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

        return work

    return stash(map_batches(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")), make, "doc_id long, x array<double>"), "statistics")


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", **how) -> QDA | None:
    """All labelled rows take part. Null labels and labels other than 0 and 1 are passed over."""
    d = len(STATISTICS)
    known = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("y")).filter("y in (0, 1)")

    def run(batches):
        n, total, cross = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, d)
            y = batch.column("y").to_numpy()
            for k in (0, 1):
                own = x[y == k]
                n[k] += len(own)
                total[k] += own.sum(axis=0)
                cross[k] += own.T @ own
        flat = np.concatenate([n, total.ravel(), cross.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["k", "v"])

    sums = stats.join(known, "doc_id").select("x", "y").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()  # 2 + 2d + 2d^2 rows
    flat = np.zeros(2 + 2 * d + 2 * d * d)
    for r in sums:
        flat[r.k] = r.v
    return fit_moments(flat[:2], flat[2 : 2 + 2 * d].reshape(2, d), flat[2 + 2 * d :].reshape(2, d, d), **how)


def score(stats: DataFrame, model: QDA | None, folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """Without a model (a class has no labels) every score is 0.5."""

    def make():
        def work(batch):
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            s = model.scores(x) if model else np.full(batch.num_rows, 0.5)
            held = [crc_mod(i, folds) == 0 if i is not None else None for i in batch.column("doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(held, pa.bool_()), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

        return work

    return map_batches(stats, make, SCHEMA)


def quality(docs: DataFrame, labels: DataFrame, folds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every document; rows whose id's crc32 leaves 0 modulo `folds` are held out of fitting.

    Null and empty texts get the score of the empty text. Rows with a null id are scored, held_out is null
    and they have no label. Repeated rows each give a row, an empty table gives none; labels of an id that several rows
    have count for each of them. Without labels of both classes every score is 0.5. Only id, text and label columns
    are read, so others may have any name. A text is read whole, in memory of a few times its size.
    """
    stats = document_statistics(docs, id_col, text_col)
    crc = F.crc32(labels[id_col].cast("string").cast("binary"))
    return score(stats, fit(stats, labels.filter(crc % folds != 0)), folds)
