"""Quality by a regularised quadratic discriminant over document statistics (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.columns import slices, sums, utf8, word_codes
from lakeweave.llm.labelled import sample
from lakeweave.llm.rules import covered, repeats
from lakeweave.llm.toxicity import logistic

#: Labelled documents that the model is fitted on at most.
FIT_DOCS = 20_000
PART = 4 << 20
#: Shrinkage of a class's covariance to the pooled one and to its own mean variance that are tried.
GRID = [(a, b) for a in (0.0, 0.1, 0.4) for b in (0.01, 0.05, 0.2)]
#: Bytes counted as shares of the text.
KINDS = {"symbols": b"#*$&", "percent": b"%", "bars": b"|<>", "upper": bytes(range(65, 91)), "digits": bytes(range(48, 58)), "stops": b".?", "commas": b",;:", "shouts": b"!", "lines": b"\n"}
NAMES = ["words", "word_length", "variety", "top_word", "stutter", "repeated", "same_lines", *KINDS]


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of transformed statistics (NAMES) per text: logs of sizes and of shares. Null and blank texts have zero words."""
    texts = pc.fill_null(texts, "")
    values, codes, offsets = word_codes(texts)
    n = np.diff(offsets)
    size = np.maximum(n, 1)
    chars = pc.utf8_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(n)), n)
    pairs, times = np.unique(doc * (len(values) + 1) + codes, return_counts=True)
    owner = pairs // (len(values) + 1)
    distinct = np.bincount(owner, minlength=len(n))
    top = np.zeros(len(n), np.int64)
    np.maximum.at(top, owner, times)
    same = np.concatenate([[False], (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])]) if len(codes) else np.zeros(0, bool)
    again = covered(repeats(codes, offsets), 5)
    data, at = utf8(texts)
    length = np.maximum(np.diff(at), 1)

    lines = pc.split_pattern(texts, "\n")
    line_at = lines.offsets.to_numpy().astype(np.int64)
    coded = lines.flatten().dictionary_encode()
    line_doc = np.repeat(np.arange(len(n)), np.diff(line_at))
    kinds = np.bincount(np.unique(line_doc * (len(coded.dictionary) + 1) + coded.indices.to_numpy(zero_copy_only=False)) // (len(coded.dictionary) + 1), minlength=len(n))
    n_lines = np.maximum(np.diff(line_at), 1)

    share = lambda x: np.log(x + 0.002)
    out = [np.log1p(n), np.log1p(sums(chars[codes], offsets) / size), np.log((distinct + 1) / (n + 1)), share(top / size), share(sums(same.astype(np.int64), offsets) / size), share(sums(again.astype(np.int64), offsets) / size), share(1 - kinds / n_lines)]
    for members in KINDS.values():
        is_one = np.zeros(256, bool)
        is_one[list(members)] = True
        out.append(share(sums(is_one[data].astype(np.int64), at) / length))
    return np.stack(out, axis=1)


@dataclass
class Discriminant:
    """Two Gaussian classes with shrunken covariances; their Cholesky factors are computed once and kept."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: list[np.ndarray]
    offsets: np.ndarray
    link: np.ndarray

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, priors included."""
        x = (x - self.centre) / self.scale
        logs = []
        for mean, inverse, offset in zip(self.means, self.factors, self.offsets):
            logs.append(offset - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1))
        return logs[1] - logs[0]

    def features(self, x: np.ndarray) -> np.ndarray:
        d = self.difference(x)
        return np.stack([np.ones(len(d)), np.sign(d) * np.log1p(np.abs(d))], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(x) @ self.link, -30, 30)))


def _classes(x: np.ndarray, y: np.ndarray, pooled: float, round_: float) -> Discriminant:
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = (x - centre) / scale
    groups = [z[y == k] for k in (0, 1)]
    cov = [np.cov(g, rowvar=False, bias=True) if len(g) > 1 else np.eye(x.shape[1]) for g in groups]
    both = sum(len(g) * c for g, c in zip(groups, cov)) / len(z)
    factors, offsets = [], []
    for g, c in zip(groups, cov):
        c = (1 - pooled) * c + pooled * both
        c = (1 - round_) * c + round_ * max(np.trace(c) / len(c), 1e-3) * np.eye(len(c))
        lower = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(lower))
        offsets.append(np.log(len(g) / len(z)) - np.log(np.diag(lower)).sum())
    return Discriminant(centre, scale, np.stack([g.mean(axis=0) for g in groups]), factors, np.array(offsets), np.array([0.0, 1.0]))


def fit(x: np.ndarray, y: np.ndarray) -> Discriminant:
    """Chooses the shrinkage on a fifth of the rows, fits all, and fits the score to the labels.

    Without two rows of either label the score is the labels' mean.
    """
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        k = len(NAMES)
        return Discriminant(np.zeros(k), np.ones(k), np.zeros((2, k)), [np.eye(k)] * 2, np.zeros(2), np.array([np.log(share / (1 - share)), 0.0]))
    test = np.arange(len(y)) % 5 == 0

    def loss(shrink: tuple[float, float]) -> float:
        if min((y[~test] == 0).sum(), (y[~test] == 1).sum()) < 2:
            return 0.0
        m = _classes(x[~test], y[~test], *shrink)
        m.link = logistic(m.features(x[~test]), y[~test])
        p = np.clip(m.score(x[test]), 1e-6, 1 - 1e-6)
        return float(-(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)).mean())

    best = _classes(x, y, *min(GRID, key=loss))
    best.link = logistic(best.features(x), y)
    return best


def _mapped(docs: DataFrame, key: str, text: str, names: str, make) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART):
                yield make(part)

    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, {names}").withColumnRenamed("id", key)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_DOCS) -> Discriminant:
    """Fits on the statistics of at most `rows` labelled documents outside the held-out fifth."""
    chosen = sample(docs, labels, label, rows, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART):
                x = statistics(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(list(x))], ["k", "y", "x"])

    got = chosen.mapInArrow(run, f"k {docs.schema[key].dataType.simpleString()}, y double, x array<double>").toPandas().sort_values("k", kind="stable")
    return fit(np.array(got["x"].tolist()).reshape(-1, len(NAMES)), got["y"].to_numpy())


def score(docs: DataFrame, model: Discriminant, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, score (0 to 1) and log_ratio (of the classes' densities, priors included).

    Null, empty and blank texts have the statistics of no words and are scored by them. Repeated rows score alike, null
    keys stay, long texts are read whole.
    """

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        x = statistics(part.column(1))
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(x)), pa.array(model.difference(x))], ["id", "score", "log_ratio"])

    return _mapped(docs, key, text, "score double, log_ratio double", make)
