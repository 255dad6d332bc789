"""DML-shaped operators as DataFrame algebra: upsert, late-arrival merge, slowly changing dimension, erasure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first in `order`; adds rn (always 1)."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rn = 1")


def upsert(target: DataFrame, source: DataFrame, keys: list[str], update: list[str], newer: str | None = None) -> DataFrame:
    """target with source merged in: matched rows take `update` columns (only where source's `newer` is later), new keys come in.

    Keys are unique on both sides (see latest). Target rows without a match stay as they are.
    """
    t, s = target.alias("t"), source.withColumn("__there", F.lit(True)).alias("s")
    joined = t.join(s, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys], "full")
    new = F.coalesce(*[F.col(f"t.{k}").isNull() for k in keys])
    take = F.col("s.__there").isNotNull() & (F.col(f"s.{newer}") > F.col(f"t.{newer}") if newer else F.lit(True))
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.coalesce(F.col(f"t.{c}"), F.col(f"s.{c}")).alias(c))
        elif c in source.columns:
            out.append(F.when(new, F.col(f"s.{c}")).when(take & F.lit(c in update), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
        else:
            out.append(F.col(f"t.{c}").alias(c))
    return joined.select(*out)


def scd2(history: DataFrame, staged: DataFrame, key: str, tracked: list[str], on: Column) -> DataFrame:
    """history (key, tracked, valid_from, valid_to, is_current) after staged rows came in at date `on`.

    Current rows whose tracked columns changed are closed; each staged key without a current row left gets a new one.
    """
    s = staged.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in tracked])
    changed = F.col("__key").isNotNull() & F.col("is_current")
    differs = F.lit(False)
    for c in tracked:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    seen = history.join(s, F.col(key) == F.col("__key"), "left").withColumn("__close", changed & differs)
    closed = seen.select(key, *tracked, "valid_from", F.when(F.col("__close"), on).otherwise(F.col("valid_to")).alias("valid_to"), (F.col("is_current") & ~F.col("__close")).alias("is_current"))
    still = closed.where("is_current").select(F.col(key).alias("__key"))
    fresh = staged.join(still, F.col(key) == F.col("__key"), "left_anti").select(key, *tracked, on.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.lit(True).alias("is_current"))
    return closed.unionByName(fresh)


def erase(df: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """df without the rows whose key is asked to be erased."""
    return df.join(requests.select(key).distinct(), key, "left_anti")
