"""SimHash near-duplicate groups by deletion-variant signatures (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm import minhash
from lakeweave.llm.columns import cut, shingle_hashes, shuffle_width, words
from lakeweave.llm.components import components

#: A fingerprint's 64 bits are cut into two halves: of 3 differing bits, one half holds at most one.
HALF, MOST_BITS = 32, 3
#: Halves shared by more distinct fingerprints than this are indexed one level deeper.
HEAVY = 20_000
#: Shingles whose bits are counted at once (64 bytes each).
PART = 1 << 18


def _bits(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Majority bits of each stretch of hashes, as signed 64-bit fingerprints; no hashes give zero."""
    n = np.diff(offsets)
    ones = np.zeros((len(n), 64), np.int64)
    full = np.flatnonzero(n)
    for a in range(0, len(hashes), PART):
        b = min(a + PART, len(hashes))
        bits = np.unpackbits(hashes[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = full[(offsets[full + 1] > a) & (offsets[full] < b)]
        ones[own] += np.add.reduceat(bits, np.maximum(offsets[own], a) - a, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<i8").ravel()


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """(key, fp): the 64-bit SimHash of each row's word shingles, repeats included, A-Z lower-cased.

    A bit is set if it is set in over half the shingles' XXH64 hashes. Fewer words than `size` make one shingle; null,
    empty and blank texts have fingerprint zero. One row per row; other columns of docs are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    hashed = docs.select(F.col(key).alias("id"), words(F.col(text), lower=True).alias("w")).select("id", shingle_hashes("w", size).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                h = batch.column(1)
                offsets = h.offsets.to_numpy().astype(np.int64)
                fp = _bits(h.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["id", "fp"])

    return hashed.mapInArrow(run, f"id {kind}, fp long").withColumnRenamed("id", key)


def _variants(fps: DataFrame) -> DataFrame:
    """64 rows a fingerprint: each half with each of its bits made a wildcard, as one long key."""
    masked = f"((shiftrightunsigned(fp, {HALF} * (j div {HALF}))) & 4294967295L) & ~shiftleft(1L, j % {HALF})"
    return fps.select("fp", F.explode(F.expr("sequence(0, 63)")).alias("j")).select("fp", F.expr(f"shiftleft(CAST(j AS BIGINT), {HALF}) | ({masked})").alias("k"))


def _deeper(heavy: DataFrame) -> DataFrame:
    """32 rows a fingerprint in a heavy bucket: the other half's two quarters, each with each bit made a wildcard.

    Rows of one such bucket agree on 46 of 64 bits, so it can hold no more than 2^18 distinct fingerprints.
    """
    quarter = f"shiftrightunsigned(shiftrightunsigned(fp, {HALF} * (1 - (shiftrightunsigned(k, {HALF}) div {HALF}))) & 4294967295L, 16 * (i div 16)) & 65535L & ~shiftleft(1L, i % 16)"
    quarter = quarter.replace(f"{HALF} * (1 - (shiftrightunsigned(k, {HALF}) div {HALF}))", f"CAST({HALF} * (1 - (shiftrightunsigned(k, {HALF}) div {HALF})) AS INT)")
    return heavy.select("fp", "k", F.explode(F.expr("sequence(0, 31)")).alias("i")).select("fp", "k", F.expr(f"i * 65536L + ({quarter})").alias("q"))


def _owner(x: np.ndarray) -> np.ndarray:
    """The one variant (0 to 63) at which a pair with these differing bits is looked at; -1: no such pair."""
    low, high = x & np.uint64(0xFFFFFFFF), x >> np.uint64(HALF)
    in_low = np.bitwise_count(low) <= 1
    half = np.where(in_low, low, high)
    few = np.bitwise_count(half) <= 1
    place = np.bitwise_count(half - (half > 0)).astype(np.int64) * (half > 0)  # position of the single differing bit
    return np.where(few & (np.bitwise_count(x) <= MOST_BITS), place + np.where(in_low, 0, HALF), -1)


def _linked(key: np.ndarray, fp: np.ndarray, runs: np.ndarray, variant: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links inside runs of equal keys: short runs compare all pairs, long ones grow trees, at most one link a member."""
    lengths = np.diff(runs)
    row_end = np.repeat(runs[1:], lengths)
    short = np.repeat(lengths <= 64, lengths)
    at = np.flatnonzero(short)
    for d in range(1, int(lengths[lengths <= 64].max(initial=1))):
        at = at[at + d < row_end[at]]
        hit = at[_owner(fp[at] ^ fp[at + d]) == variant[at]]
        yield fp[hit], fp[hit + d]
    for a, b in zip(runs[:-1][lengths > 64], runs[1:][lengths > 64]):
        left = fp[a:b]
        while len(left):
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                one = queue.pop()
                near = _owner(left ^ one) == variant[a]
                if near.any():
                    found, left = left[near], left[~near]
                    yield np.full(len(found), one), found
                    queue.extend(found)


def _links(keyed: DataFrame, keys: list[str]) -> DataFrame:
    """(u, v) pairs of fingerprints within 3 bits, from rows that share all `keys`; enough of them to join each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(fp: np.ndarray, ks: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if len(fp):
                change = np.any([k[1:] != k[:-1] for k in ks], axis=0)
                runs = np.concatenate([[0], np.flatnonzero(change) + 1, [len(fp)]])
                for u, v in _linked(ks[0], fp, runs, ks[0] >> HALF):
                    if len(u):
                        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        fp, ks = np.zeros(0, np.uint64), [np.zeros(0, np.int64) for _ in keys]
        for batch in batches:
            fp = np.concatenate([fp, batch.column(0).to_numpy().view(np.uint64)])
            ks = [np.concatenate([k, batch.column(i + 1).to_numpy()]) for i, k in enumerate(ks)]
            if not len(fp):
                continue
            last = np.flatnonzero(np.any([k != k[-1] for k in ks], axis=0))  # the last key's run may go on
            n = last[-1] + 1 if len(last) else 0
            yield from out(fp[:n], [k[:n] for k in ks])
            fp, ks = fp[n:], [k[n:] for k in ks]
        yield from out(fp, ks)

    return keyed.select("fp", *keys).repartition(shuffle_width(keyed.sparkSession), *keys).sortWithinPartitions(*keys, "fp").mapInArrow(run, "u long, v long")


def near_links(fps: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """fps (fp: distinct longs) -> links (u, v) that join all fingerprints with a chain of steps of 3 or fewer bits.

    Every pair within 3 bits is compared at exactly one variant. A half that more than `heavy` fingerprints share is
    found by a count over all of them, and its buckets are cut again by the other half, so no bucket is unbounded.
    """
    halves = fps.select(F.explode(F.expr(f"array(fp & 4294967295L, shiftrightunsigned(fp, {HALF}) | {1 << 40}L)")).alias("half"))
    many = cut(halves.groupBy("half").count().where(F.col("count") > heavy))
    variants = _variants(fps)
    if many.isEmpty():
        return _links(variants, ["k"])
    seg, value = f"CAST(shiftrightunsigned(half, 40) AS INT)", "half & 4294967295L"
    keys = many.select(F.explode(F.expr(f"transform(sequence(0, {HALF - 1}), w -> shiftleft(CAST({seg} * {HALF} + w AS BIGINT), {HALF}) | (({value}) & ~shiftleft(1L, w)))")).alias("k")).distinct()
    deep = _deeper(variants.join(keys, "k", "left_semi"))
    return _links(variants.join(keys, "k", "left_anti"), ["k"]).unionByName(_links(deep, ["k", "q"]))


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, heavy: int = HEAVY) -> DataFrame:
    """(key, fp, component): the least key among all rows that a chain of links of 3 or fewer differing bits reaches.

    Rows with equal fingerprints are one node, so exact copies cost one row each and no pairs. Null, empty and blank
    texts share fingerprint zero and link like any other. Repeated rows keep their rows. Null keys are never the least
    of a group with other keys; a group of null keys only has a null component. An empty table gives no rows.
    """
    own = cut(fingerprints(docs, key, text, size))
    distinct = cut(own.groupBy("fp").agg(F.min(key).alias("least")))
    nodes = components(near_links(distinct.select("fp"), heavy)).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    rooted = cut(distinct.join(nodes, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    low = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(low, "root").select("fp", "component")
    return own.join(named, "fp", "left").select(key, "fp", "component")


def keep(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that near-copy removal keeps, see minhash.keep.

    Rows whose SimHash fingerprints a chain of steps of 3 or fewer bits joins are one group (near_groups, all rows), each text under the
    number that minhash.keep knows it by. These groups are joined further by pairs with a Jaccard similarity of 0.8, which 64 bits
    cannot tell.
    """
    near = near_groups(docs.select(minhash.node_of(docs[text]).alias("node"), docs[text].alias("text")), "node", "text")
    known = cut(near.where("node <> component").select(F.col("component").alias("u"), F.col("node").alias("v")).distinct())
    return minhash.keep(docs, key, text, known)
