"""Shared helpers: words and shingles as Spark columns, words of an Arrow column as numpy arrays."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.operators.cut import cut as cut

# White space is ASCII only: 0x20 and 0x09 to 0x0D.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = "\t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def give_back() -> None:
    """Returns freed memory to the system at a task's end, as Python workers live on for tasks of other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def words(text: Column, lower: bool = False) -> Column:
    """The runs of bytes outside ASCII white space; with lower, A-Z become a-z first. Null or blank: an empty array."""
    frm, to = SPACES + (UPPER if lower else ""), " " * len(SPACES) + (LOWER if lower else "")
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), frm, to), " "), lambda w: w != "")


def shingle_hashes(words_col: str, size: int) -> Column:
    """XXH64 (seed 42) of every run of `size` words joined by one space; fewer words make one shingle, none make none.

    Words are fetched one by one, which takes as long for a word of a long text as of a short one (a slice does not).
    """
    run = ", ".join(f"get({words_col}, i + {j})" for j in range(size))
    return F.expr(f"IF(size({words_col}) = 0, CAST(array() AS ARRAY<BIGINT>), transform(sequence(0, greatest(size({words_col}) - {size}, 0)), i -> xxhash64(concat_ws(' ', {run}))))")


def slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about most_bytes of text each; one longer text is a part of its own."""
    if not batch.num_rows:
        return
    at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    part = at // most_bytes
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def word_codes(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words, each word's number among them in text order, and the offsets of the texts. Null: no words."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    there = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))]).astype(np.int64)
    coded = flat.filter(full).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), there[offsets - offsets[0]]


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between neighbouring offsets; an empty stretch gives 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each text begins; the last offset is the end. Null: no bytes."""
    texts = pc.fill_null(texts, "")
    offsets = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)])
    if not offsets[-1]:
        return np.zeros(0, np.uint8), offsets
    start = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset]
    return np.frombuffer(texts.buffers()[2], np.uint8)[start : start + offsets[-1]], offsets
