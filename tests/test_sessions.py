from datetime import datetime, timedelta

from lakeweave.streaming.sessions import sessions


def test_stream_gives_the_sessions_of_the_batch(spark, tmp_path):
    begun = datetime(2024, 1, 1)
    minutes = {"a": [0, 10, 29, 60, 200], "b": [5, 300], None: [1]}
    rows = [(actor, begun + timedelta(minutes=m)) for actor, ms in minutes.items() for m in ms]
    spark.createDataFrame(rows, "actor string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    end = spark.createDataFrame([("z", begun + timedelta(days=2))], "actor string, ts timestamp")  # moves the watermark on
    end.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("actor string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = sessions(stream).writeStream.format("memory").queryName("found").outputMode("complete").trigger(availableNow=True).start()
    assert out.awaitTermination(120)
    got = sorted((r.actor, r.n) for r in spark.table("found").collect() if r.actor != "z")
    assert got == [("a", 1), ("a", 1), ("a", 3), ("b", 1), ("b", 1)]
    batch = sorted((r.actor, r.n) for r in sessions(spark.read.parquet(f"{tmp_path}/in")).collect() if r.actor != "z")
    assert batch == got
