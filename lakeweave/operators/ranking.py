"""Row numbers, running sums and tiles over whole tables or a few large groups, without one task that sorts a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Value ranges an octave. Amounts of up to 18 digits before the point fall into fewer than 8,000 ranges a group.
RANGES = 64


def ranked(df: DataFrame, value: str, tie: str, groups: list[str] | None = None) -> DataFrame:
    """df with rn (1 for the largest value of its group), n_group, running and total: sums of value up to the row and over the group.

    Equal values are ordered by `tie`. Rows are dealt by group and value range; what the ranges above a row hold is
    looked up in a table with one row a range, whose size depends on the span of the values and not on the rows. Null
    values come last and add nothing.
    """
    groups = groups or []
    amount = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    octave = F.floor(F.log2(F.abs(amount) + 1) * RANGES)
    df = df.withColumn("__range", F.when(F.col(value).isNotNull(), F.when(amount < 0, -octave - 1).otherwise(octave)))
    per = df.groupBy(*groups, "__range").agg(F.count("*").alias("__n"), F.coalesce(F.sum(value), F.lit(0)).alias("__sum"))
    inside = Window.partitionBy(*groups)
    above = inside.orderBy(F.col("__range").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        *[F.col(g).alias(f"__{g}") for g in groups], F.col("__range").alias("__at"), F.coalesce(F.sum("__n").over(above), F.lit(0)).alias("__before"), F.coalesce(F.sum("__sum").over(above), F.lit(0)).alias("__held"),
        F.sum("__n").over(inside).alias("n_group"), F.sum("__sum").over(inside).alias("total"),
    )
    met = df.join(per, [F.col("__range").eqNullSafe(F.col("__at")), *[F.col(g).eqNullSafe(F.col(f"__{g}")) for g in groups]])
    near = Window.partitionBy(*groups, "__range").orderBy(F.col(value).desc_nulls_last(), tie)
    met = met.withColumn("rn", F.col("__before") + F.row_number().over(near))
    met = met.withColumn("running", F.col("__held") + F.coalesce(F.sum(value).over(near.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    return met.select(*[c for c in df.columns if c != "__range"], "rn", "n_group", "running", "total")


def tile(rn: Column, n: Column, tiles: int) -> Column:
    """The tile (1 to tiles) of row rn of n, as NTILE numbers them: the first n % tiles tiles have one row more."""
    small, more = F.floor(n / tiles), n % tiles
    wide = more * (small + 1)
    return F.when(rn <= wide, F.floor((rn - 1) / (small + 1)) + 1).otherwise(more + F.floor((rn - 1 - wide) / F.greatest(small, F.lit(1))) + 1).cast("int")
