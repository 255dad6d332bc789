"""Periodic runs of words by the Gusfield-Stoye tandem-repeat method (operator 13).

A suffix array with its common prefixes stands for the suffix tree: a node is an interval of neighbouring suffixes. The
Lempel-Ziv blocks give a set of squares that covers the leftmost ones; walks along suffix links (drop the first word,
look whether it can follow at the end) complete the vocabulary of squares; the intervals of its words locate all squares,
and squares of one period at neighbouring words merge into runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.columns import give_back, slices, word_codes, words
from lakeweave.llm.rules import common_prefixes, suffix_ranks

#: Words of a run at least (and two periods).
LEAST = 12
#: Bytes of text whose suffixes are sorted together; a longer single text is sorted alone.
PART = 1 << 20
SCHEMA = "{id}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each of the stretches of these lengths."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def previous_factors(suffixes: list[int], lcp: list[int]) -> list[int]:
    """For each position of one document how many words from it on also start at an earlier position.

    Positions leave the suffix array from the last one on, so a position's neighbours are always earlier ones.
    """
    n = len(suffixes)
    rank = [0] * n
    for r, i in enumerate(suffixes):
        rank[i] = r
    before, after = list(range(-1, n)), list(range(1, n + 2))
    shared = [0, *lcp[1:], 0]
    out = [0] * n
    for i in range(n - 1, -1, -1):
        r = rank[i]
        p, q = before[r], after[r]
        a, b = shared[r], shared[q]
        out[i], shared[q] = (a, b) if a > b else (b, a)
        after[p], before[q] = q, p
    return out


def blocks(factors: list[int]) -> list[int]:
    """Starts of the Lempel-Ziv blocks: each is the longest stretch that an earlier position starts too, or one new word."""
    out, i = [], 0
    while i < len(factors):
        out.append(i)
        i += factors[i] or 1
    return out


class Words:
    """Documents' words as numbers, with what is asked of their suffix tree. Positions count over all documents."""

    def __init__(self, codes: np.ndarray, offsets: np.ndarray):
        self.codes, self.offsets = codes, offsets
        self.suffixes, self.levels = suffix_ranks(codes, offsets)
        self.lcp = common_prefixes(self.suffixes, self.levels, offsets)
        self.rank = np.empty(len(codes), np.int64)
        self.rank[self.suffixes] = np.arange(len(codes))
        lengths = np.diff(offsets)
        self.begin, self.end = np.repeat(offsets[:-1], lengths), np.repeat(offsets[1:], lengths)
        self.least = [self.lcp.astype(np.int32)]  # least common prefix of 1, 2, 4, ... neighbours from each on
        while len(self.least[-1]) > (h := 1 << len(self.least) - 1) and self.least[-1].max() > 0:
            self.least.append(np.minimum(self.least[-1][:-h], self.least[-1][h:]))

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a and from b (later, same document) on are the same."""
        a, b, end = a.copy(), b.copy(), self.end[a]
        first = a.copy()
        for h, rank in reversed(self.levels):
            fits = np.flatnonzero(b + h <= end)
            hit = fits[rank[a[fits]] == rank[b[fits]]]
            a[hit] += h
            b[hit] += h
        return a - first

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before a and before b (later, same document) are the same."""
        begin = self.begin[np.minimum(a, len(self.codes) - 1)]
        a, b = a.copy(), b.copy()
        last = a.copy()
        for h, rank in reversed(self.levels):
            fits = np.flatnonzero(a - h >= begin)
            hit = fits[rank[a[fits] - h] == rank[b[fits] - h]]
            a[hit] -= h
            b[hit] -= h
        return last - a

    def node(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval [low, high) of suffixes that begin with the n words from `at` on."""
        low = self.rank[at]
        high = low + 1
        for i in range(len(self.least) - 1, -1, -1):
            least, h = self.least[i], 1 << i
            at_low = low - h + 1  # the prefixes shared by the h pairs down from low
            ok = np.flatnonzero((at_low >= 0) & (high > 0))
            ok = ok[least[at_low[ok]] >= n[ok]]
            low[ok] -= h
            ok = np.flatnonzero(high + h <= len(self.lcp))
            ok = ok[least[high[ok]] >= n[ok]]
            high[ok] += h
        return low, high

    def child(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray, word: np.ndarray) -> np.ndarray:
        """A position in each interval of suffixes that share `depth` words whose next word is `word`; -1 if there is none."""
        top = high.copy()
        low = low.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            less = self._next(middle, depth[open_]) < word[open_]
            low[open_[less]] = middle[less] + 1
            high = high.copy()
            high[open_[~less]] = middle[~less]
        found = np.flatnonzero(low < top)
        out = np.full(len(low), -1)
        hit = found[self._next(low[found], depth[found]) == word[found]]
        out[hit] = self.suffixes[low[hit]]
        return out

    def _next(self, rank: np.ndarray, depth: np.ndarray) -> np.ndarray:
        at = self.suffixes[rank] + depth
        inside = at < self.end[self.suffixes[rank]]
        return np.where(inside, self.codes[np.minimum(at, len(self.codes) - 1)], -1)

    def widened(self, at: np.ndarray, period: np.ndarray) -> np.ndarray:
        """(start, end, period) rows, distinct: the longest stretches with these periods around these squares."""
        rows = np.stack([at - self.behind(at, at + period), at + period + self.ahead(at, at + period), period], axis=1)
        return np.unique(rows, axis=0) if len(rows) else rows

    def primitive(self, runs: np.ndarray) -> np.ndarray:
        """The runs whose period is no multiple of a smaller one."""
        left = runs[:, 2].copy()
        whole = np.ones(len(runs), bool)
        prime = 2
        while (left > 1).any():
            prime = prime if prime * prime <= left.max() else int(left[left > 1].min())
            of = np.flatnonzero(left % prime == 0)
            of = of[left[of] > 1]
            if len(of):
                start, end, period = runs[of].T
                shorter = period // prime
                whole[of[self.ahead(start, start + shorter) >= end - start - shorter]] = False
                while len(of := of[left[of] % prime == 0]):
                    left[of] //= prime
            prime += 1
        return runs[whole]


def covering_squares(tree: Words, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) of squares that cover all leftmost ones: by each block's end and start, as both its lemmas tell."""
    starts, ends, nexts = [], [], []
    for d in docs:
        a, b = tree.offsets[d], tree.offsets[d + 1]
        own = [*blocks(previous_factors((tree.suffixes[a:b] - a).tolist(), tree.lcp[a:b].tolist())), int(b - a)]
        edge = np.array([*own, own[-1]], np.int64) + a
        starts.append(edge[:-2])
        ends.append(edge[1:-1])
        nexts.append(edge[2:])
    start, end, after = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends, nexts))
    # Squares over a block's right end, with their middle inside it: the period is at most the block.
    inner = np.flatnonzero(after > end)
    n = (end - start)[inner]
    right, k1 = np.repeat(end[inner], n), _within(n) + 1
    hit = tree.codes[right] == tree.codes[right - k1]
    right, k1 = right[hit], k1[hit]
    # Squares over its left end: the period is at most the block and the next one.
    inner = np.flatnonzero(start > tree.begin[start]) if len(start) else start
    n = np.minimum(after[inner], tree.end[start[inner]]) - start[inner]
    left, k2 = np.repeat(start[inner], n), _within(n) + 1
    hit = tree.codes[left - 1] == tree.codes[left - 1 + k2]
    left, k2 = left[hit], k2[hit]
    at, k = np.concatenate([right - k1, left - 1]), np.concatenate([k1, k2])
    forward, back = tree.ahead(at, at + k), tree.behind(at, at + k)
    square = forward + back >= k
    at, k, back = at[square], k[square], back[square]
    return np.maximum(at - back, at - k + 1), k


def runs_of(codes: np.ndarray, offsets: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(start, end, period) of all runs of at least `least` words and two smallest periods, by start and period."""
    none = np.zeros((0, 3), np.int64)
    if not len(codes):
        return none
    tree = Words(codes, offsets)
    full = np.flatnonzero(np.diff(offsets))
    # Of a run of length l and period p, l - p words, at least half of `least`, come again p words later.
    docs = full[np.maximum.reduceat(tree.lcp, offsets[full]) >= (least + 1) // 2]
    known = none
    fresh = tree.primitive(tree.widened(*covering_squares(tree, docs)))
    while len(fresh):
        known = np.concatenate([known, fresh])
        start, end, period = fresh.T
        n = np.minimum(end - start - 2 * period + 1, period)  # squares of different words in the run
        # Suffix links: past the run's last square its first word is dropped and asked for at the end.
        part = n < period
        at, p = end[part] - 2 * period[part], period[part]
        turned = tree.child(*tree.node(at + 1, 2 * p - 1), 2 * p - 1, tree.codes[at])
        # All places of all squares of the run.
        square, q = np.repeat(start, n) + _within(n), np.repeat(period, n)
        low, high = tree.node(square, 2 * q)
        places = tree.suffixes[np.repeat(low, high - low) + _within(high - low)]
        q = np.concatenate([np.repeat(q, high - low), p[turned >= 0]])
        places = np.concatenate([places, turned[turned >= 0]])
        order = np.lexsort((places, q))
        places, q = places[order], q[order]
        first = np.concatenate([[True], (q[1:] != q[:-1]) | (places[1:] > places[:-1] + 1)])
        found = tree.widened(places[first], q[first])
        # Those that are not yet known.
        both, count = np.unique(np.concatenate([known, known, found]), axis=0, return_counts=True)
        fresh = both[count == 1]
    known = known[known[:, 1] - known[:, 0] >= np.maximum(least, 2 * known[:, 2])]
    return known[np.lexsort((known[:, 2], known[:, 0]))]


def _collapsed(part: pa.RecordBatch, least: int) -> pa.RecordBatch:
    values, codes, offsets = word_codes(part.column("text"))
    found = runs_of(codes, offsets, least)
    n = len(codes)
    inside = np.cumsum(np.bincount(found[:, 0] + found[:, 2], minlength=n + 1) - np.bincount(found[:, 1], minlength=n + 1))[:n] > 0
    kept = np.flatnonzero(~inside)
    texts = pa.ListArray.from_arrays(pa.array(np.searchsorted(kept, offsets).astype(np.int32)), values.take(pa.array(codes[kept])))
    doc = np.searchsorted(offsets, found[:, 0], side="right") - 1
    lists = pa.StructArray.from_arrays([pa.array(found[:, 0] - offsets[doc]), pa.array(found[:, 1] - found[:, 0]), pa.array(found[:, 2])], ["start", "length", "period"])
    runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(offsets))).astype(np.int32)), lists)
    return pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), runs, pc.binary_join(texts, " ").cast(pa.string())], [part.schema.names[0], "n_words", "runs", "collapsed"])


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """One row per row of docs: key, n_words, its runs by start and period, and the text with each run cut to its first period.

    A run is a longest stretch of words, `least` or more and two periods at least, in which words one period apart are the
    same; period is the smallest such number. collapsed: the words that are in no run after its first period, joined by one
    space. Words are what ASCII white space parts. Null, empty and blank texts have no words, no runs and the empty text.
    Runs that overlap or lie in each other are all listed. Repeated rows are read one by one, null keys stay, a text is taken
    whole, whatever its length (its suffixes are sorted in one array of some times its size). An empty table gives no rows.
    Other columns of docs are not read, so their names cannot clash. There is no shuffle.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART):
                yield _collapsed(part, least)
        give_back()

    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA.format(id=f"id {kind}")).withColumnRenamed("id", key)


def repeated_tails(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text): a tenth of the texts, by the key's hash, with their last words replaced by repeats of the first of these.

    h is the crc32 of the key as text and g = h div 10. If h % 10 is 0 and there are n > 0 words, each word i from a = g % n
    on becomes word a + (i - a) % p, with p = 1 + (n - a) div (3 + g % 8); the words are then joined by one space. Other
    rows, and those with null keys, keep their texts.
    """
    one = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).withColumn("h", F.crc32(F.col("id").cast("string")))
    one = one.withColumn("w", F.when(F.col("h") % 10 == 0, words(F.col("text")))).withColumn("n", F.size("w").cast("long"))
    one = one.withColumn("a", F.expr("IF(n > 0, (h div 10) % n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + (h div 10) % 8)"))
    turned = "concat_ws(' ', transform(w, (x, i) -> IF(i < a, x, get(w, CAST(a + (i - a) % p AS INT)))))"
    return one.select(F.col("id").alias(key), F.expr(f"IF(n > 0, {turned}, text)").alias("text"))
