"""Bounded samples of labelled rows, the only rows that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of all texts of a sample, at most.
MOST_BYTES = 64 << 20


def held_out(key: Column) -> Column:
    """True for a fifth of the rows, whose labels are never learned: crc32 of the key as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, key: str = "doc_id", text: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """(k, text, y) of at most `rows` labelled keys outside the held-out fifth, chosen by the key's hash, one row a key.

    Null labels and keys are left out; of several labels of one key the largest counts, of several rows of one key one whose
    text has the least hash. The chosen labels are `rows` at most, so they are broadcast to the documents; repeated rows are
    put down to one where they are read. Texts beyond `most_bytes` in all, in that order, are left out too.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(key).agg(F.max(label).cast("double").alias("y"))
    chosen = known.orderBy(F.xxhash64(key), key).limit(rows).select(F.col(key).alias("__key"), "y")
    met = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("k") == F.col("__key"))
    one = met.groupBy("k").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("y").alias("y"))
    sofar = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("k"), "k").rowsBetween(Window.unboundedPreceding, 0))  # over `rows` rows at most
    return one.withColumn("__sofar", sofar).where(F.col("__sofar") <= most_bytes).select("k", "text", "y")
