"""Removal of passages that earlier documents hold, by a run-length Burrows-Wheeler index (operator 6).

Every 50-byte window has an anchor: the 12-byte string of least hash inside it, so equal windows have equal anchors.
Neighbouring windows with one anchor make a piece. Pieces are dealt out by their anchor, so all copies of a window meet
in one task. There a run-length index is built over the pieces that may be the earlier ones, and the later ones are
streamed against it: their matching statistics tell which windows an earlier document has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from math import ceil

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.llm.columns import cut, give_back, shuffle_width, slices, utf8

#: Bytes of a window and of an anchor; windows that can share an anchor; a piece's bytes at most, in whole 8-byte words.
WINDOW, ANCHOR = 50, 12
SPREAD = WINDOW - ANCHOR + 1
LONGEST = WINDOW + SPREAD - 1
WIDTH = -(-LONGEST // 8) * 8
#: Of a window's other 38 bytes, 19 or more are on one side of the anchor.
SIDE = (WINDOW - ANCHOR) // 2
#: Bytes of text whose pieces are packed together, and whose windows are worked on at once.
PART, STRETCH = 4 << 20, 1 << 19
#: Bytes of all texts for each group of anchors (of which a task works on one at a time) and bucket of documents; tasks at most.
SHARE, TASKS = 8 << 20, 20_000
#: Pieces whose anchors, windows and index are worked on at once in a task.
GROUP = 6_000
NONE = np.iinfo(np.int64).max
#: Pieces whose repeats are folded at once before that, and spans that are sent off together.
CHUNK, READY = 15_000, 100_000
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX[3]
    return x ^ (x >> np.uint64(29))


def _hash_rows(rows: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows of whole 8-byte words."""
    h = np.full(len(rows), MIX[1])
    for lane in np.ascontiguousarray(rows).view("<u8").T:
        h = _mix((h ^ lane) * MIX[0] + MIX[2])
    return h


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, first window, number of windows, anchor's place, anchor's hash) of each piece of these texts.

    Found stretch by stretch; a window's anchor depends on the window alone, so a stretch's end at most splits a piece.
    """
    got = []
    for a in range(0, max(len(data) - WINDOW + 1, 1), STRETCH):
        b = min(a + STRETCH + WINDOW - 1, len(data))
        doc, start, count, place, h = _stretch(data[a:b], np.clip(offsets, a, b) - a)
        got.append((doc, start + a, count, place + a, h))
    return tuple(np.concatenate(x) for x in zip(*got))


def _stretch(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    n = len(data)
    if n < WINDOW:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.ndarray((n,), "<u8", padded.data, strides=(1,))
    h = _mix(word[: n - ANCHOR + 1] * MIX[0] + _mix(word[ANCHOR - 8 : n - 7] * MIX[1]))
    low = np.uint64((1 << 24) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span * 2 <= SPREAD:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: len(least) - (SPREAD - span)], least[SPREAD - span :])
    anchor = (least & low).astype(np.int64)  # of the window that begins at each byte
    windows = np.maximum(np.diff(offsets) - WINDOW + 1, 0)
    doc = np.repeat(np.arange(len(windows)), windows)
    start = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(offsets[:-1], windows)
    own = anchor[start]
    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])])) if len(own) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(own)))
    return doc[first], start[first], count, own[first], h[own[first]]


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=0).astype("<i8")


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(a.tobytes() for a in arrays), 3)


def _unpack(blob: bytes, n: int, bare: bool = False) -> tuple[np.ndarray, ...]:
    """(rows, lengths, places, starts, documents, their text numbers) of a packed part; bare: no rows are made."""
    data = zstandard.decompress(blob)
    length, place, step, new = (np.frombuffer(data, k, n, at * n) for k, at in (("u1", 0), ("u1", 1), ("<i4", 2), ("u1", 6)))
    first, at = np.flatnonzero(new), 7 * n
    ids, at = np.cumsum(np.frombuffer(data, "<i8", len(first), at)), at + 8 * len(first)
    hashes, at = np.frombuffer(data, "<i4", len(first), at), at + 4 * len(first)
    rows = np.zeros((0 if bare else n, WIDTH), np.uint8)
    if not bare:
        rows[np.arange(WIDTH) < length[:, None]] = np.frombuffer(data, np.uint8, -1, at)
    group, walked = np.cumsum(new) - 1, np.cumsum(step.astype(np.int64))
    start = walked - (walked[first] - step[first])[group]
    return rows, length, place, start, ids[group], hashes[group]


class RunIndex:
    """A run-length Burrows-Wheeler transform of pieces, sampled at the ends of its runs.

    Kept are, for each run, its first row, its symbol and the number of equal symbols before it; the text positions of
    the suffixes in its first and in its last row; and for each text position the least document of all suffixes that
    agree with it for a whole window.
    """

    def __init__(self, rows: np.ndarray, lengths: np.ndarray, least: np.ndarray):
        ends = np.cumsum(lengths + 1)
        n = int(ends[-1])
        self.left = np.repeat(ends, lengths + 1) - np.arange(n) - 1  # bytes up to the piece's end
        text = np.zeros(n + WIDTH, np.uint8)
        text[np.flatnonzero(self.left)] = rows[np.arange(rows.shape[1]) < lengths[:, None]]
        self.words = np.ndarray((n + WIDTH - 7,), "<u8", text.data, strides=(1,)).copy()
        symbols = np.where(self.left > 0, text[:n].astype(np.int64) + 1, 0)

        def later(x: np.ndarray, by: int) -> np.ndarray:
            out = np.zeros(n, np.int64)
            out[: max(n - by, 0)] = x[by:]
            out[self.left < by] = 0
            return out

        def ranked(x: np.ndarray) -> np.ndarray:
            order = np.argsort(x)
            out = np.empty(n, np.int64)
            out[order] = np.concatenate([[1], 1 + np.cumsum(x[order][1:] != x[order][:-1])])
            return out

        packed = np.zeros(n, np.int64)
        for i in range(7):
            packed = packed * 512 + later(symbols, i)
        ranks, depth = {7: ranked(packed)}, 7
        del packed
        while depth < LONGEST + 1:
            ranks[2 * depth] = ranked(ranks[depth] * (n + 2) + later(ranks[depth], depth))
            depth *= 2
        order = np.argsort(ranks[depth] * n + np.arange(n))  # equal suffixes: by place, as those that begin one byte before
        bwt = np.concatenate([[0], symbols[:-1]])[order]
        self.head = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        self.symbol = bwt[self.head]
        tail = np.append(self.head[1:], n) - 1
        self.at_head, self.at_tail, self.top = order[self.head], order[tail], order[0]
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=258))])  # suffixes with a lesser first symbol
        by_symbol = np.argsort(self.symbol, kind="stable")
        self.keys = self.symbol[by_symbol] * len(self.head) + by_symbol
        lengths_so_far = np.cumsum((tail - self.head + 1)[by_symbol]) - (tail - self.head + 1)[by_symbol]
        first_of = np.searchsorted(self.symbol[by_symbol], self.symbol[by_symbol])
        self.before = np.empty(len(self.head), np.int64)
        self.before[by_symbol] = lengths_so_far - lengths_so_far[first_of]

        windows = np.stack([ranks[28], later(ranks[14], 28), later(ranks[7], 42), later(symbols, 49)])[:, order]
        starts = np.flatnonzero(np.concatenate([[True], (windows[:, 1:] != windows[:, :-1]).any(axis=0)]))
        lows = np.minimum.reduceat(np.repeat(least, lengths + 1)[order], starts)
        self.low_at = np.empty(n, np.int64)
        self.low_at[order] = np.repeat(lows, np.diff(np.append(starts, n)))

    def _common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Bytes that the text has in common from positions a and b on, up to `most` and within the piece of b."""
        most = np.minimum(most, self.left[b])
        out = np.zeros(len(a), np.int64)
        on = np.flatnonzero(most > 0)
        while len(on):
            differ = self.words[a[on] + out[on]] ^ self.words[b[on] + out[on]]
            out[on] += np.where(differ == 0, 8, np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) >> 3).astype(np.int64)
            on = on[(differ == 0) & (out[on] < most[on])]
        return np.minimum(out, most)

    def _jump(self, run: np.ndarray, symbol: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """The nearest run of the wanted symbol, above or below, whose sampled end agrees longer: its run, row, place, length.

        A length of -1: the index has no such symbol.
        """
        k = np.searchsorted(self.keys, symbol * len(self.head) + run)
        above, below = np.maximum(k - 1, 0), np.minimum(k, len(self.keys) - 1)
        runs = self.keys % len(self.head)
        up, down = runs[above], runs[below]
        has_up, has_down = (k > 0) & (self.symbol[up] == symbol), (k < len(self.keys)) & (self.symbol[down] == symbol)
        size_up = np.where(has_up, self._common(at, self.at_tail[up], size), -1)
        size_down = np.where(has_down, self._common(at, self.at_head[down], size), -1)
        rise = size_up >= size_down
        last = np.append(self.head[1:], len(self.left))[up] - 1
        return np.where(rise, up, down), np.where(rise, last, self.head[down]), np.where(rise, self.at_tail[up], self.at_head[down]), np.maximum(size_up, size_down)

    def stream(self, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(piece, window) -> the least document of the index that has that window, NONE without one.

        All pieces are read from their ends backwards, side by side. Of each, the longest match of what was read last is
        known by its row, its place in the indexed text and its length: the matching statistics. A symbol that
        continues the match is one step of the runs' mapping; another one jumps to a sampled run end first.
        """
        out = np.full((len(rows), SPREAD), NONE)
        row, at, size = np.zeros(len(rows), np.int64), np.full(len(rows), self.top), np.zeros(len(rows), np.int64)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            on = np.flatnonzero(lengths >= back)
            symbol = rows[on, lengths[on] - back].astype(np.int64) + 1
            r, a, m = row[on], at[on], size[on]
            run = np.searchsorted(self.head, r, side="right") - 1
            other = np.flatnonzero(self.symbol[run] != symbol)
            if len(other):
                run[other], r[other], a[other], m[other] = self._jump(run[other], symbol[other], a[other], m[other])
            gone = m < 0
            row[on] = np.where(gone, 0, self.smaller[symbol] + self.before[run] + r - self.head[run])
            at[on], size[on] = np.where(gone, self.top, a - 1), m + 1
            if back >= WINDOW:
                hit = np.flatnonzero(m + 1 >= WINDOW)
                out[on[hit], lengths[on[hit]] - back] = self.low_at[a[hit] - 1]
        return out


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    return order, np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])) if len(key) else np.zeros(0, np.int64)


def _families(keys: np.ndarray, there: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of `there` and rows of the same key, each with documents from low to high: which may be earlier, which later than another."""
    earlier, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    at = np.flatnonzero(there)
    if len(at):
        order, starts = _groups(keys[at])
        of = at[order]
        n = np.diff(np.append(starts, len(at)))
        earlier[of] = low[of] < np.repeat(np.maximum.reduceat(high[of], starts), n)
        later[of] = high[of] > np.repeat(np.minimum.reduceat(low[of], starts), n)
    return earlier, later


def _side_keys(rows: np.ndarray, lengths: np.ndarray, place: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the anchor with 19 bytes before it and with 19 after it, and which pieces have them."""
    out = []
    wide = np.concatenate([rows, np.zeros((len(rows), 64), np.uint8)], axis=1)
    flat = np.lib.stride_tricks.as_strided(wide, (wide.size - 39, 40), (1, 1))
    for first, there in ((place - SIDE, place >= SIDE), (place, lengths - place - ANCHOR >= SIDE)):
        got = flat[np.arange(len(rows)) * wide.shape[1] + np.maximum(first, 0)].copy()
        got[:, ANCHOR + SIDE :] = 0
        out.append((_hash_rows(got), there))
    return out


def _distinct(rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the pieces by their bytes, where each distinct one begins in it, and each piece's number among them."""
    hashed = _hash_rows(rows)
    order, _ = _groups(hashed)
    same = (hashed[order][1:] == hashed[order][:-1]) & (lengths[order][1:] == lengths[order][:-1]) & (rows[order][1:] == rows[order][:-1]).all(axis=1)
    starts = np.flatnonzero(np.concatenate([[True], ~same]))
    number = np.empty(len(order), np.int64)
    number[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
    return order, starts, number


def _marked(rows: np.ndarray, lengths: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece, least): for pieces of the documents from low to high, the least document of each window, if high is beyond any.

    Equal windows agree on 19 bytes before or after their anchor. Pieces that have a partner by these keys are indexed if
    some of its documents are later than their own least, and streamed if some are earlier than their own last one.
    """
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros((0, SPREAD), np.int64)
    order, starts, number = _distinct(rows, lengths)
    one = order[starts]
    rows, lengths, low, last = rows[one], lengths[one], np.minimum.reduceat(low[order], starts), np.maximum.reduceat(high[order], starts)
    sides = [_families(k, there, low, last) for k, there in _side_keys(rows, lengths, place[one])]
    earlier, later = (np.flatnonzero(sides[0][i] | sides[1][i]) for i in (0, 1))
    if not len(later):
        return np.zeros(0, np.int64), np.zeros((0, SPREAD), np.int64)
    index = RunIndex(rows[earlier], lengths[earlier], low[earlier])
    least = index.stream(rows[later], lengths[later])
    slot = np.full(len(one), -1)
    slot[later] = np.arange(len(later))
    some = np.flatnonzero(slot[number] >= 0)
    some = some[least.min(axis=1)[slot[number[some]]] < high[some]]
    return some, least[slot[number[some]]]


def _spans(held: list[tuple[int, bytes]]) -> Iterator[np.ndarray]:
    """Packed parts of whole anchors -> rows of (document, text number, first, end) that earlier documents have.

    The parts stay packed. They are opened twice, some CHUNK pieces at a time: first to keep each chunk's distinct pieces
    with their range of documents, which alone are indexed; then to hold the pieces against the documents found.
    """
    chunks: list[list[tuple[int, bytes]]] = [[]]
    for n, blob in held:
        if sum(m for m, _ in chunks[-1]) >= CHUNK:
            chunks.append([])
        chunks[-1].append((n, blob))
    kept: list[list[np.ndarray]] = [[], [], [], [], []]
    numbers, base = [], 0
    for chunk in chunks:
        got = [_unpack(blob, n) for n, blob in chunk if n]
        if not got:
            numbers.append(np.zeros(0, np.int32))
            continue
        rows, length, place, ids = (np.concatenate([x[i] for x in got]) for i in (0, 1, 2, 4))
        del got
        order, starts, number = _distinct(rows, length)
        one = order[starts]
        for into, x in zip(kept, (rows[one], length[one], place[one], np.minimum.reduceat(ids[order], starts), np.maximum.reduceat(ids[order], starts))):
            into.append(x)
        numbers.append((number + base).astype(np.int32))
        base += len(one)
    if not base:
        return
    rows, length, place, low, high = (np.concatenate(x) for x in kept)
    del kept
    groups = -(-base // GROUP)
    own = (_anchor_hash(rows, place) >> np.uint64(20)) % np.uint64(groups)  # equal anchors stay together
    slot, least, found = np.full(base, -1, np.int32), [], 0
    for g in range(groups):
        part = np.flatnonzero(own == g)
        hit, lows = _marked(rows[part], length[part].astype(np.int64), place[part].astype(np.int64), low[part], high[part])
        slot[part[hit]] = np.arange(found, found + len(hit))
        found += len(hit)
        least.append(lows)
    del rows, place, low, high, own
    least = np.concatenate(least)
    for chunk, number in zip(chunks, numbers):
        at = 0
        for n, blob in chunk:
            _, length, _, start, ids, hashes = _unpack(blob, n, bare=True)
            mine = slot[number[at : at + n]]
            at += n
            some = np.flatnonzero(mine >= 0)
            got = []
            for a in range(0, len(some), GROUP):
                p = some[a : a + GROUP]
                piece, window = np.nonzero((least[mine[p]] < ids[p][:, None]) & (np.arange(SPREAD) < (length[p].astype(np.int64) - WINDOW + 1)[:, None]))
                got.append(_joined(ids[p[piece]], hashes[p[piece]].astype(np.int64), start[p[piece]] + window))
            if got:
                yield np.concatenate(got)


def _joined(ids: np.ndarray, hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Windows' documents, text numbers and first bytes -> (document, text number, first, end) of the stretches they cover."""
    order = np.lexsort((begin, hashes, ids))
    ids, hashes, begin = ids[order], hashes[order], begin[order]
    if not len(ids):
        return np.zeros((0, 4), np.int64)
    first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1]) | (begin[1:] > begin[:-1] + WINDOW)]))
    last = np.append(first[1:], len(begin)) - 1
    return np.stack([ids[first], hashes[first], begin[first], begin[last] + WINDOW], axis=1)


def _dealt(docs: DataFrame, groups: int) -> DataFrame:
    """docs (id, nth, text) -> one row per part of the input and group of anchors: its pieces, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART):
                data, offsets = utf8(part.column(2))
                doc, start, count, place, h = _pieces(data, offsets)
                if not len(doc):
                    continue
                padded = np.concatenate([data, np.zeros(WIDTH, np.uint8)])
                target = (h % np.uint64(groups)).astype(np.int64)
                order = np.argsort(target, kind="stable")
                ids, hashes = (part.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
                cuts = np.searchsorted(target[order], np.arange(groups + 1))
                out: list[list] = [[], [], []]
                for t in np.flatnonzero(np.diff(cuts)):
                    at = order[cuts[t] : cuts[t + 1]]
                    length = count[at] + WINDOW - 1
                    rows = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[start[at]]
                    d = doc[at]
                    new = np.concatenate([[True], d[1:] != d[:-1]])
                    local = start[at] - offsets[d]
                    step = np.where(new, local, np.diff(local, prepend=0))
                    blob = _pack(length.astype("u1"), (place[at] - start[at]).astype("u1"), step.astype("<i4"), new.astype("u1"), _steps(ids[d[new]]), hashes[d[new]].astype("<i4"), rows[np.arange(WIDTH) < length[:, None]])
                    out[0].append(t), out[1].append(len(at)), out[2].append(blob)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], ["target", "n", "pieces"])
        give_back()

    return docs.mapInArrow(run, "target int, n int, pieces binary")


def _anchor_hash(rows: np.ndarray, place: np.ndarray) -> np.ndarray:
    flat = np.lib.stride_tricks.as_strided(rows, (rows.size - ANCHOR + 1, ANCHOR), (1, 1))
    got = np.zeros((len(rows), 16), np.uint8)
    got[:, :ANCHOR] = flat[np.arange(len(rows)) * WIDTH + place]
    return _hash_rows(got)


def _one_by_one(rows: DataFrame, by: str, width: int, more: str) -> DataFrame:
    """rows dealt by the number `by`, each task's in its order, so that a task holds one number's rows at a time."""
    dealt = rows.withColumn("__to", F.expr(f"CAST({by} % {width} AS INT)")).repartitionById(width, F.col("__to"))
    return dealt.drop("__to").sortWithinPartitions(by, more)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """(number, rows of it) of rows that are sorted by their first column."""
    return groupby((row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))), key=lambda row: row[0])


def _matched(dealt: DataFrame, groups: int, width: int) -> DataFrame:
    """(bucket, kind 0, spans): per task and bucket of documents, the spans that earlier documents have, as far as its anchors show."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(spans: np.ndarray) -> pa.RecordBatch:
            bucket = _bucket(spans[:, 0], groups)
            order = np.argsort(bucket, kind="stable")
            some, first = np.unique(bucket[order], return_index=True)
            blobs = [_pack(np.ascontiguousarray(spans[order[a:b]].T).astype("<i8")) for a, b in zip(first, np.append(first[1:], len(order)))]
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.zeros(len(some), np.int32)), pa.array(blobs, pa.binary())], ["bucket", "kind", "data"])

        ready: list[np.ndarray] = []
        for _, held in _runs(batches):
            for spans in _spans([(n, blob) for _, n, blob in held]):
                ready.append(spans)
                if sum(len(x) for x in ready) >= READY:
                    yield out(np.concatenate(ready))
                    ready = []
        if any(len(x) for x in ready):
            yield out(np.concatenate(ready))
        give_back()

    return _one_by_one(dealt, "target", width, "n").mapInArrow(run, "bucket int, kind int, data binary")


def _bucket(ids: np.ndarray, width: int) -> np.ndarray:
    return (_mix(ids.astype(np.int64).view(np.uint64) * MIX[0]) % np.uint64(width)).astype(np.int64)


def _measured(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """(docs with id and nth first, bytes): nth numbers the different texts of one key (0 but for repeated keys).

    Both come from one count over all rows. Texts of one key are told apart by 64 bits.
    """
    own = docs.select(F.col(key).cast("long").alias("__id"), F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("__th"), F.octet_length(text).alias("n"))
    each = own.groupBy("__id").agg(F.min("__th").alias("a"), F.max("__th").alias("b"), F.sum("n").alias("n"))
    total, many = each.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.expr("__id IS NOT NULL AND a <> b"))).first()
    rows = docs.select(F.col(key).cast("long").alias("__id"), *[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)])
    if not many:
        return rows.select("__id", F.lit(0).alias("__nth"), *rows.columns[1:]), total
    again = own.join(each.where("a <> b").select("__id"), "__id", "left_semi").select("__id", "__th").distinct()
    again = cut(again.withColumn("__nth", F.row_number().over(Window.partitionBy("__id").orderBy("__th")))).withColumnsRenamed({"__id": "__of", "__th": "__oth"})
    at = f"c{docs.columns.index(text)}"
    rows = rows.join(again, (F.col("__id") == F.col("__of")) & (F.xxhash64(F.coalesce(at, F.lit(""))) == F.col("__oth")), "left")
    return rows.select("__id", F.coalesce("__nth", F.lit(0)).alias("__nth"), *rows.columns[1 : 1 + len(docs.columns)]), total


def _rows_by_bucket(docs: DataFrame, groups: int) -> DataFrame:
    """(bucket, 1, data): docs' rows, whose first two columns are key and text number, dealt by key and compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = _bucket(batch.column(0).to_numpy(zero_copy_only=False), groups)
            order = np.argsort(bucket, kind="stable")
            some, first = np.unique(bucket[order], return_index=True)
            blobs = []
            for a, b in zip(first, np.append(first[1:], len(order))):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as out:
                    out.write_batch(batch.take(pa.array(order[a:b])))
                blobs.append(zstandard.compress(sink.getvalue(), 3))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.ones(len(some), np.int32)), pa.array(blobs, pa.binary())], ["bucket", "kind", "data"])

    return docs.mapInArrow(run, "bucket int, kind int, data binary")


def _with_spans(docs: DataFrame, key: str, text: str, make, schema) -> DataFrame:
    """Rows of docs (all columns) meet their merged spans; make(batch, spans) gives the rows of `schema`.

    Texts are dealt once, by key, in compressed parts; each task opens one bucket's parts at a time, after its spans.
    The numbers of groups and tasks follow the bytes of all texts. Rows with a null key have no spans and stay where they are.
    """
    whole, total = _measured(docs, key, text)
    width = max(shuffle_width(docs.sparkSession), min(ceil(total / SHARE), TASKS))
    groups = max(width, min(ceil(total / SHARE), 1 << 20))
    known, at = whole.where("__id IS NOT NULL"), f"c{docs.columns.index(text)}"
    spans = _matched(_dealt(known.where(f"octet_length({at}) >= {WINDOW}").select("__id", "__nth", F.col(at).alias("text")), groups), groups, width)
    both = _rows_by_bucket(known, groups).unionByName(spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _runs(batches):
            found: dict[tuple[int, int], list] = {}
            for _, kind, data in parts:  # a bucket's spans come first
                if not kind:
                    for i, nth, a, b in np.frombuffer(zstandard.decompress(data), "<i8").reshape(4, -1).T.tolist():
                        found.setdefault((i, nth), []).append((a, b))
                    continue
                for batch in pa.ipc.open_stream(zstandard.decompress(data)):
                    own = [_merged(found.get(k, ())) for k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
                    yield make(pa.RecordBatch.from_arrays(batch.columns[2:], names=batch.schema.names[2:]), own)
        give_back()

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield make(batch, [[]] * batch.num_rows)

    loose = whole.where("__id IS NULL").drop("__id", "__nth").mapInArrow(untouched, schema)
    return _one_by_one(both, "bucket", width, "kind").mapInArrow(run, schema).unionByName(loose)


def _merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _rest(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]])


def strip(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, n_bytes, n_removed, n_spans, kept_sha256 and spans (first, end in bytes).

    Removed is each byte inside a 50-byte string that also occurs in a document of lesser key (a long); all strings are
    judged on the input. Null texts are empty, texts under 50 bytes lose nothing. Rows with a null key neither lose nor
    cause anything. Repeated rows lose the same; rows of one key with other texts are judged apart, and not against
    each other. Other columns are not read.
    """

    def make(batch: pa.RecordBatch, own: list[list[tuple[int, int]]]) -> pa.RecordBatch:
        out = []
        for t, spans in zip(batch.column(1).to_pylist(), own):
            data = (t or "").encode()
            out.append((len(data), sum(b - a for a, b in spans), len(spans), hashlib.sha256(_rest(data, spans)).hexdigest(), [{"first": a, "end": b} for a, b in spans]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))]
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(zip(*out), kinds)]], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    schema = f"id {docs.schema[key].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<first: long, end: long>>"
    return _with_spans(docs.select(key, text), key, text, make, schema).withColumnRenamed("id", key)


def keep(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of docs, each text without its removed bytes; a character of which a byte goes, goes.

    Null texts stay null; a text that repeats earlier ones from end to end becomes empty and its row stays.
    """
    at = docs.columns.index(text)

    def make(batch: pa.RecordBatch, own: list[list[tuple[int, int]]]) -> pa.RecordBatch:
        texts = [t if not s else _rest(t.encode(), s).decode("utf-8", "ignore") for t, s in zip(batch.column(at).to_pylist(), own)]
        columns = [pa.array(texts, batch.schema.types[at]) if i == at else c for i, c in enumerate(batch.columns)]
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    return _with_spans(docs, key, text, make, schema).toDF(*docs.columns)
