"""Numbering rows of a whole table in order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.operators.cut import cut


def numbered(df: DataFrame, order: list[Column], name: str = "id") -> DataFrame:
    """df with a column `name`: 0, 1, 2, ... by `order`, which should tell all rows apart for the same numbers each time.

    Rows are dealt out by ranges, written once, and numbered inside each; how many rows stand before a range is looked up
    in a table of one row a shuffle partition.
    """
    width = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut(df.repartitionByRange(width, *order).withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))  # at most one row a partition
    inside = Window.partitionBy("__part").orderBy(*order)
    return dealt.join(F.broadcast(sizes), "__part").withColumn(name, F.col("__before") + F.row_number().over(inside) - 1).drop("__part", "__before")
