"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import gc
import time

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the session's ``spark.checkpoint.dir``, beside the warehouse only where one machine does all."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        home = spark.conf.get("spark.checkpoint.dir", None)
        if not home and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(home or spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints")
    return context.getCheckpointDir()


#: Seconds from one call of `free` that does anything to the next.
PAUSE = 2.0
_freed = [0.0]


def free(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files and checkpoints that nothing refers to any more.

    It notices that only when the driver collects its garbage, which a job of many short steps may not bring about for minutes.
    """
    if time.monotonic() - _freed[0] >= PAUSE:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _freed[0] = time.monotonic()


def cut(df: DataFrame) -> DataFrame:
    """Computes df once into the shared folder, so that later steps and lost executors read it from there.

    Spark deletes these files when the session has spark.cleaner.referenceTracking.cleanCheckpoints; else they stay.
    """
    shared_folder(df.sparkSession)
    done = df.checkpoint(eager=True)
    free(df.sparkSession)
    return done


def dealt(df: DataFrame) -> DataFrame:
    """As cut, but later joins know by which columns df's last shuffle dealt its rows, and do not shuffle them again.

    Spark forgets this of plans that it may change while they run, so df is planned without that.
    """
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return cut(df.select("*"))
    finally:
        conf.set(name, before)


def width(spark: SparkSession) -> int:
    """Partitions that a shuffle deals its rows into."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
