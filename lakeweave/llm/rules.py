"""Quality rules with suffix-array repetition (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.columns import give_back, slices, sums, utf8, word_codes

#: A repeat counts towards the covered share from so many words on; the share of a text's words, in hundredths, that such
#: repeats may cover. Both are the published limits of repeated 8-grams in web text.
MIN_REPEAT, MAX_COVERED = 8, 12
#: The longest repeat may have one word in so many of the text's, but always up to the first and never over the second number.
LONGEST_SHARE, LONGEST_RANGE = 20, (8, 100)
SYMBOLS = b"#*$%&|<>"
#: Bytes of text whose suffixes are sorted together; a longer single text is sorted alone.
PART = 1 << 20
SCHEMA = "{id}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered_words long, longest_repeat long, repeat_spans array<struct<first: int, words: int>>, base_failed boolean, too_covered boolean, too_long boolean, kept boolean"


def suffix_ranks(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffix array of all documents' word sequences, by prefix doubling; a suffix ends with its document.

    Returns the suffixes in order and, for each doubling, the depth h and the rank of each position's first h words
    (equal within a document exactly where those words are equal).
    """
    n = len(codes)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    ends = np.repeat(offsets[1:], np.diff(offsets))
    _, inverse, counts = np.unique(doc * (codes.max(initial=0) + 1) + codes, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - counts)[inverse]
    levels, h, active = [(1, rank.astype(np.int32))], 1, np.flatnonzero(counts[inverse] > 1)
    while len(active):
        after = active + h
        inside = after < ends[active]
        second = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        first = rank[active]
        order = np.argsort(first * (n + 2) + second, kind="stable")
        active, first, second = active[order], first[order], second[order]
        new_group = np.concatenate([[True], first[1:] != first[:-1]])
        new_rank = new_group | np.concatenate([[True], second[1:] != second[:-1]])
        at = np.arange(len(active))
        group_at = np.maximum.accumulate(np.where(new_group, at, 0))
        own_at = np.maximum.accumulate(np.where(new_rank, at, 0))
        rank = rank.copy()
        rank[active] = first + own_at - group_at
        h *= 2
        levels.append((h, rank.astype(np.int32)))
        alone = new_rank & np.concatenate([new_rank[1:], [True]])
        active = active[~alone]
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    return suffixes, levels


def common_prefixes(suffixes: np.ndarray, levels: list[tuple[int, np.ndarray]], offsets: np.ndarray) -> np.ndarray:
    """Words that each suffix shares with the one before it in the suffix array; 0 across documents."""
    n = len(suffixes)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    out = np.zeros(n, np.int64)
    a, b = suffixes[1:].copy(), suffixes[:-1].copy()
    end_a, end_b = ends[a], ends[b]
    same = np.flatnonzero(end_a == end_b)
    a, b, end = a[same], b[same], end_a[same]
    shared = np.zeros(len(a), np.int64)
    for h, rank in reversed(levels):
        fits = np.flatnonzero((a + h <= end) & (b + h <= end))
        hit = fits[rank[a[fits]] == rank[b[fits]]]
        shared[hit] += h
        a[hit] += h
        b[hit] += h
    out[same + 1] = shared
    return out


def repeats(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each word, how many words from it on occur elsewhere in its document too (the longest such run)."""
    if not len(codes):
        return np.zeros(0, np.int64)
    suffixes, levels = suffix_ranks(codes, offsets)
    lcp = common_prefixes(suffixes, levels, offsets)
    out = np.empty(len(codes), np.int64)
    out[suffixes] = np.maximum(lcp, np.append(lcp[1:], 0))
    return out


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """True for words inside a repeated run of `least` words or more."""
    start = np.flatnonzero(longest >= least)
    edges = np.bincount(start, minlength=len(longest) + 1) - np.bincount(start + longest[start], minlength=len(longest) + 1)
    return np.cumsum(edges[: len(longest)]) > 0


def verdicts(n: np.ndarray, again: np.ndarray, inside: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, ...]:
    """(base_failed, too_covered, too_long, kept) of texts of n words, by their repeated words and longest repeats."""
    base = (n < 10) | (100 * again > 20 * n)
    too_covered = 100 * inside > MAX_COVERED * n
    too_long = most > np.clip(n // LONGEST_SHARE, *LONGEST_RANGE)
    return base, too_covered, too_long, ~(base | too_covered | too_long)


def _statistics(part: pa.RecordBatch, min_repeat: int) -> pa.RecordBatch:
    texts = pc.fill_null(part.column("text"), "")
    values, codes, offsets = word_codes(texts)
    chars = pc.utf8_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
    data, at = utf8(texts)
    is_symbol = np.zeros(256, bool)
    is_symbol[list(SYMBOLS)] = True
    longest = repeats(codes, offsets)
    inside = covered(longest, min_repeat)
    lengths = np.diff(offsets)

    lines = pc.split_pattern(texts, "\n")
    line_at = lines.offsets.to_numpy().astype(np.int64)
    line_at -= line_at[0]
    coded = lines.flatten().dictionary_encode()
    blank = pc.equal(pc.binary_length(pc.ascii_trim_whitespace(coded.dictionary)), 0).to_numpy(zero_copy_only=False)
    of_line = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(line_at))
    doc, of_line = doc[~blank[of_line]], of_line[~blank[of_line]]
    distinct = np.unique(doc * (len(blank) + 1) + of_line) // (len(blank) + 1)
    n_dup = np.bincount(doc, minlength=len(texts)) - np.bincount(distinct, minlength=len(texts))

    most = np.zeros(len(texts), np.int64)
    full = np.flatnonzero(lengths > 0)
    if len(full):
        most[full] = np.maximum.reduceat(longest, offsets[full])
    owner = np.repeat(np.arange(len(texts)), lengths)
    first = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1] & (owner[1:] == owner[:-1])])) if len(inside) else np.zeros(0, np.int64)
    last = np.flatnonzero(inside & ~np.concatenate([inside[1:] & (owner[1:] == owner[:-1]), [False]])) if len(inside) else first
    spans = pa.StructArray.from_arrays([pa.array((first - offsets[owner[first]]).astype(np.int32)), pa.array((last - first + 1).astype(np.int32))], ["first", "words"])
    span_at = np.concatenate([[0], np.cumsum(np.bincount(owner[first], minlength=len(texts)))]).astype(np.int32)
    again, within = sums(covered(longest, 5).astype(np.int64), offsets), sums(inside.astype(np.int64), offsets)
    counts = [lengths, sums(chars[codes], offsets), sums(is_symbol[data].astype(np.int64), at), n_dup, again, within, most]
    columns = [part.column(0), *(pa.array(x.astype(np.int64)) for x in counts), pa.ListArray.from_arrays(pa.array(span_at), spans), *map(pa.array, verdicts(lengths, again, within, most))]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat", "repeat_spans", "base_failed", "too_covered", "too_long", "kept"]
    return pa.RecordBatch.from_arrays(columns, [part.schema.names[0], *names])


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", min_repeat: int = MIN_REPEAT) -> DataFrame:
    """One row per row of docs: its counts, its repeated spans and the verdict.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word that equal an earlier line),
    n_repeat_words (words in 5-word windows found twice or more), n_covered_words (words in the union of repeated runs
    of min_repeat words or more), longest_repeat (words) and repeat_spans (that union, by word number); base_failed (too
    few words, or too many in repeated windows), too_covered and too_long (the limits on the covered share and on the
    longest repeat), kept (none of the three).

    Null and blank texts have zero words and counts of 0, so the base rule fails them. Repeated rows are measured one by
    one; a null key stays null. Long texts are taken whole: their suffixes are sorted in one array of a few times the
    text's size. Other columns of docs are not read, so their names cannot clash.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART):
                yield _statistics(part, min_repeat)
        give_back()

    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA.format(id=f"id {kind}")).withColumnRenamed("id", key)


def keep(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text is kept by the verdict of judge. No join and no shuffle: judged where read.

    Nulls in other columns, and null keys, pass through. A null or empty text has no words and goes.
    """
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, PART):
                bare = pa.RecordBatch.from_arrays([pa.array(np.arange(part.num_rows)), part.column(text)], ["id", "text"])
                yield part.filter(_statistics(bare, MIN_REPEAT).column("kept"))
        give_back()

    return docs.mapInArrow(run, schema)
