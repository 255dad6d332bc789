"""Exact distinct counts at several grains from bitmaps that are made once and merged upwards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """(keys, bucket, bits): the numbers (from 1 up) that occur with each key, 32,768 to a bitmap. Null numbers are left out.

    Rows are first put down to distinct (key, number), mostly where they are read; a bitmap has 4 kB, however many rows are in it.
    """
    one = df.where(F.col(number).isNotNull()).select(*keys, (F.col(number).cast("long") + 1).alias("__n")).distinct()
    return one.groupBy(*keys, F.bitmap_bucket_number("__n").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__n")).alias("bits"))


def merged(maps: DataFrame, keys: list[str]) -> DataFrame:
    """The same for coarser keys: bitmaps of one key and bucket laid over each other, first where they are read."""
    return maps.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def counted(maps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): how many different numbers each key has."""
    return maps.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias("n"))
