"""A partitioned table as a merge's target: only partitions that the changes touch are read and written again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.operators.cut import cut
from lakeweave.operators.merge import upsert


def create(df: DataFrame, folder: str, partition: str) -> None:
    """Writes df as a table of one folder a value of `partition`."""
    df.repartition(partition).write.partitionBy(partition).parquet(folder)


def read(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The table with its columns' kinds as they were written (a partition's value is else guessed from its folder's name)."""
    return spark.read.schema(schema).parquet(folder)


def _drop(spark: SparkSession, folder: str, partition: str, values: list) -> None:
    """Deletes the partitions of these values: a null has Spark's own name."""
    for v in values:
        name = "__HIVE_DEFAULT_PARTITION__" if v is None else spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(str(v))
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{partition}={name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def merge_into(spark: SparkSession, folder: str, schema, changes: DataFrame, keys: list[str], partition: str, newer: str | None = None, gone: DataFrame | None = None) -> int:
    """Merges changes into the table and gives the number of partitions that were written or deleted.

    Rows of `changes` (all columns of the table, keys unique) replace those of equal keys, where `newer` is later if it is
    given, and new keys come in; a replaced row may move to another partition. Rows whose keys are in `gone` (keys) are deleted.
    Doing the same again changes nothing, so a run that broke off is simply repeated.

    Touched are the partitions that changed rows come from or go to: the first are found by the table's keys alone, without
    its other columns. Their rows are merged and written to the checkpoint folder first, then over their partitions only
    (dynamic overwrite); partitions left without rows are deleted. Partition values go to the driver only for deleted ones.
    """
    table = read(spark, folder, schema)
    columns = [f.name for f in schema.fields]
    changes = cut(changes.select(*columns))
    away = changes.select(*keys) if gone is None else changes.select(*keys).unionByName(gone.select(*keys)).distinct()
    mine = table.select(*keys, partition).join(away, keys, "left_semi").select(partition).distinct()
    touched = cut(mine.unionByName(changes.select(partition)).distinct().withColumnRenamed(partition, "__touched"))
    old = table.join(F.broadcast(touched), table[partition].eqNullSafe(F.col("__touched")), "left_semi") if touched.count() <= 10_000 else table.join(touched, table[partition].eqNullSafe(F.col("__touched")), "left_semi")
    merged = upsert(old, changes, keys, [c for c in columns if c not in keys], newer)
    if gone is not None:
        merged = merged.join(gone.select(*keys).distinct(), keys, "left_anti")
    merged = cut(merged.select(*columns))
    empty = touched.join(merged.select(partition).distinct(), F.col("__touched").eqNullSafe(F.col(partition)), "left_anti")
    merged.repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(folder)
    _drop(spark, folder, partition, [r[0] for r in empty.collect()])  # at most the partitions there are
    return touched.count()
