"""Sessions over a stream of events: the twin of the batch pattern, with late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """events (actor, ts) -> (actor, n, started, ended): an actor's events of which none is `gap` or more after the last one.

    Rows without an actor or a time are left out. Rows up to `late` behind the latest one still count.
    """
    known = events.where("actor IS NOT NULL AND ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp"))
    held = known.withWatermark("ts", late).groupBy("actor", F.session_window("ts", gap).alias("__span"))
    return held.agg(F.count("*").alias("n"), F.min("ts").alias("started"), F.max("ts").alias("ended")).drop("__span")
