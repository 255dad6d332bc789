"""Toxicity by a linear-chain conditional random field over words (operator 1)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.columns import slices, sums, word_codes
from lakeweave.llm.labelled import sample

#: Labelled documents that the model is fitted on at most; of them, documents whose chains the field is fitted on.
FIT_DOCS, CHAIN_DOCS = 6_000, 1_500
#: A word gets a weight if so many sampled documents have it. A toxic word's documents are toxic with this probability.
LEAST_DOCS, TOXIC = 3, 0.95
#: A word's features are itself and its first letters, so many of them.
STEMS = (3, 4, 5, 6)
STEPS, RATE, RIDGE = 40, 0.3, 1e-3
PART = 4 << 20
EDGES = "".join(chr(i) for i in range(33, 127) if not chr(i).isalpha())
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(words: pa.Array) -> pa.Array:
    """Words in lower case without ASCII signs and digits at their ends."""
    return pc.utf8_trim(pc.utf8_lower(words), EDGES)


def features(words: pa.Array) -> list[pa.Array]:
    """The plain words themselves, and for each length of STEMS their first letters and a star; null for shorter words."""
    own = plain(words)
    length = pc.utf8_length(own)
    return [own] + [pc.if_else(pc.greater_equal(length, k), pc.binary_join_element_wise(pc.utf8_slice_codeunits(own, 0, k), "*", ""), pa.scalar(None, pa.string())) for k in STEMS]


def chains(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Words by number, and the offsets of the lines (the chains) and of the texts among them."""
    lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    at = lines.offsets.to_numpy().astype(np.int64)
    values, codes, offsets = word_codes(lines.flatten())
    return values, codes, offsets, offsets[at - at[0]]


def marginals(odds: np.ndarray, offsets: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over all chains side by side, two states, as ratios of toxic to clean.

    odds: each word's emission ratio; move[i, j]: weight of a step from state i to j. Returns each word's forward and
    backward ratio and its marginal probability of being toxic.
    """
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = offsets[:-1][order], lengths[order]
    live = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1 if len(lengths) else 1), side="right")
    forward, backward = np.empty(len(odds)), np.empty(len(odds))
    ratio = np.ones(0)
    for t, n in enumerate(live):
        at = starts[:n] + t
        into = (move[0, 1] + move[1, 1] * ratio[:n]) / (move[0, 0] + move[1, 0] * ratio[:n]) if t else np.full(n, move[0, 1] / move[0, 0])
        forward[at] = ratio = odds[at] * into
    beyond = np.ones(len(lengths))
    for t in range(len(live) - 1, -1, -1):
        n = live[t]
        at = starts[:n] + t
        after = at + 1
        inner = lengths[:n] > t + 1
        ahead = np.where(inner, odds[np.where(inner, after, 0)] * np.where(inner, backward[np.where(inner, after, 0)], 0), 0)
        backward[at] = np.where(inner, (move[1, 0] + move[1, 1] * ahead) / (move[0, 0] + move[0, 1] * ahead), beyond[:n])
    both = forward * backward
    return forward, backward, both / (1 + both)


@dataclass
class Model:
    """words and their weights, the weight of any word, the steps' weights, and how a document's marginals make a score."""

    words: pa.Array
    weights: np.ndarray
    bias: float
    move: np.ndarray
    document: np.ndarray

    def tokens(self, values: pa.Array, codes: np.ndarray, lines: np.ndarray) -> np.ndarray:
        weights, total = np.append(self.weights, 0.0), np.full(len(values), self.bias)
        for feature in features(values):
            total += weights[pc.index_in(feature, self.words, skip_nulls=True).fill_null(len(self.weights)).to_numpy(zero_copy_only=False)]
        odds = np.exp(np.clip(total, -30, 30))
        return marginals(odds[codes], lines, self.move)[2]

    def features(self, p: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """For each document 1, the log of one plus its expected toxic words, and its largest marginal."""
        most = np.zeros(len(docs) - 1)
        full = np.flatnonzero(np.diff(docs))
        if len(full):
            most[full] = np.maximum.reduceat(p, docs[full])
        return np.stack([np.ones(len(most)), np.log1p(sums(p, docs)), most], axis=1)

    def score(self, p: np.ndarray, docs: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(p, docs) @ self.document, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the first column's weight is not shrunk."""
    w, shrink = np.zeros(x.shape[1]), np.diag([0.0] + [ridge * len(x)] * (x.shape[1] - 1)) / 100
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + shrink + 1e-9 * np.eye(len(w)), x.T @ (y - p) - shrink @ w)
        w = w + np.clip(step, -4, 4)
    return w


def toxic_kind(n: np.ndarray, toxic: np.ndarray, share: float) -> np.ndarray:
    """For features of n documents, `toxic` of them toxic: the probability of being of the toxic kind, not of any kind.

    Two binomials are mixed; how many features are of the toxic kind is estimated from the counts themselves.
    """
    high = max(TOXIC, (1 + share) / 2)
    gain = toxic * np.log(high / share) + (n - toxic) * np.log((1 - high) / (1 - share))
    prior, own = 1e-3, gain[n > 0]
    for _ in range(30):
        prior = float(np.clip((1 / (1 + np.exp(np.clip(-own - np.log(prior / (1 - prior)), -50, 50)))).mean(), 1e-5, 1e-2)) if len(own) else prior
    return 1 / (1 + np.exp(np.clip(-gain - np.log(prior / (1 - prior)), -50, 50)))


def fit(texts: list[str] | pa.Array, labels: np.ndarray) -> Model:
    """Labels tokens, fits the field to them, and the documents' scores to the documents' labels.

    A token of a toxic document is toxic with the probability that its word, or its first letters, is of the toxic kind;
    few labels give weak evidence, not none. Without both kinds of label, the score is the share of toxic documents.
    """
    y = np.asarray(labels, float)
    share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.01
    flat = Model(pa.array([], pa.string()), np.zeros(0), -6.0, np.array([[1.0, 0.1], [0.9, 0.1]]), np.array([np.log(share / (1 - share)), 0.0, 0.0]))
    if not len(y) or y.min() == y.max():
        return flat
    values, codes, lines, docs = chains(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
    named = [f.cast(pa.string()) for f in features(values)]
    names = pa.chunked_array(named).combine_chunks().dictionary_encode()
    none = len(names.dictionary)
    own = names.indices.fill_null(none).to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(named), -1).T  # the features of each word
    doc = np.repeat(np.arange(len(y)), np.diff(docs))
    met = np.unique(doc * (len(values) + 1) + codes)
    met_doc, met_word = met // (len(values) + 1), met % (len(values) + 1)
    n, toxic = np.zeros(none + 1, np.int64), np.zeros(none + 1)
    for kind in own.T:  # words and first letters of each length are different features, so each kind is counted alone
        pairs = np.unique(met_doc * (none + 1) + kind[met_word])
        n += np.bincount(pairs % (none + 1), minlength=none + 1)
        toxic += np.bincount(pairs % (none + 1), y[pairs // (none + 1)], minlength=none + 1)
    del met, met_doc, met_word, pairs
    lean = toxic_kind(n, toxic, share)
    lean[none] = 0
    marks = lean[own].max(axis=1)
    known = np.flatnonzero(n[:none] >= LEAST_DOCS)

    rank = np.random.default_rng(11).permutation(len(y))
    chosen = np.zeros(len(y), bool)
    for kind in (0, 1):
        chosen[rank[y[rank] == kind][: CHAIN_DOCS // 2]] = True
    line_doc = np.searchsorted(docs, lines[:-1], side="right") - 1
    pick = np.flatnonzero(chosen[np.minimum(line_doc, len(y) - 1)] & (np.diff(lines) > 0))
    n_line = np.diff(lines)[pick]
    offsets = np.concatenate([[0], np.cumsum(n_line)])
    at = np.repeat(lines[pick] - offsets[:-1], n_line) + np.arange(offsets[-1])
    index = np.full(none + 1, len(known))
    index[known] = np.arange(len(known))
    x, truth = [index[kind].astype(np.int32)[codes[at]] for kind in own.T], marks[codes[at]] * y[doc[at]]
    first = np.zeros(len(at), bool)
    first[offsets[:-1]] = True
    seen = np.zeros((2, 2))  # steps between labelled neighbours
    before, after = truth[:-1][~first[1:]], truth[1:][~first[1:]]
    seen += [[((1 - before) * (1 - after)).sum(), ((1 - before) * after).sum()], [(before * (1 - after)).sum(), (before * after).sum()]]

    theta = np.zeros(len(known) + 1 + 3)  # words, bias, and the steps' log weights (clean to clean is 0)
    theta[len(known)] = -4.0
    m = v = np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        move = np.exp(np.array([[0.0, theta[-3]], [theta[-2], theta[-1]]]))
        weights = np.append(theta[: len(known)], 0.0)
        odds = np.exp(np.clip(sum(weights[c] for c in x) + theta[len(known)], -30, 30))
        forward, backward, p = marginals(odds, offsets, move)
        grad = np.zeros_like(theta)
        gap = truth - p
        grad[: len(known) + 1] = sum(np.bincount(c, gap, minlength=len(known) + 1) for c in x)
        grad[len(known)] = gap.sum()
        inner = np.flatnonzero(~first[1:])
        a, b = forward[inner], odds[inner + 1] * backward[inner + 1]
        joint = np.stack([np.full(len(a), move[0, 0]), move[0, 1] * b, move[1, 0] * a, move[1, 1] * a * b])
        joint = (joint / joint.sum(axis=0)).sum(axis=1)
        grad[-3:] = seen.ravel()[1:] - joint[1:]
        grad = grad / max(1.0, truth.sum()) - RIDGE * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weight = theta[: len(known)]
    far = np.abs(weight) > 0.05
    move = np.exp(np.array([[0.0, theta[-3]], [theta[-2], theta[-1]]]))
    model = Model(names.dictionary.take(pa.array(known[far])), weight[far], float(theta[len(known)]), move, np.zeros(3))
    p = model.tokens(values, codes, lines)
    model.document = logistic(model.features(p, docs), y)
    return model


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = FIT_DOCS) -> Model:
    """Fits a model on at most `rows` labelled documents outside the held-out fifth."""
    got = sample(docs, labels, label, rows, key, text).toArrow().sort_by("k")
    return fit(pa.concat_arrays(got["text"].chunks or [pa.array([], pa.string())]), got["y"].to_numpy())


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, score (0 to 1) and spans (start, end in code points, p) of words likelier toxic than not.

    Null, empty and blank texts have no words and get the score of no evidence. Repeated rows score alike, null keys
    stay. Texts are read whole, in parts of several megabytes; a chain is a line of any length.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART):
                values, codes, lines, at = chains(part.column(1))
                p = model.tokens(values, codes, lines)
                spans: list[list] = [[] for _ in range(part.num_rows)]
                hot = np.flatnonzero(p > 0.5)
                owner = np.searchsorted(at, hot, side="right") - 1
                for d in np.unique(owner):
                    found = list(WORD.finditer(part.column(1)[int(d)].as_py()))
                    spans[d] = [{"start": found[i - at[d]].start(), "end": found[i - at[d]].end(), "p": float(p[i])} for i in hot[owner == d]]
                kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(p, at)), pa.array(spans, kinds)], ["id", "score", "spans"])

    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, score double, spans array<struct<start: int, end: int, p: double>>").withColumnRenamed("id", key)
