import time

from lakeweave.llm import components
from lakeweave.operators import cut


def test_shuffle_files_of_earlier_rounds_are_deleted(spark, monkeypatch):
    monkeypatch.setattr(cut, "PAUSE", 0.0)
    jvm = spark.sparkContext._jvm
    lying = lambda: jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    rows = cut.cut(spark.range(20_000).selectExpr("id", "id % 7 AS n"))
    time.sleep(1)
    before = lying()
    for i in range(12):
        rows = cut.cut(rows.groupBy("id").agg({"n": "sum"}).toDF("id", "n").repartition(8, "n"))
    time.sleep(2)  # the cleaner runs beside
    assert lying() - before < 12 * 8  # each round writes two files or more for each of eight tasks, twice


def test_stars_take_no_round_and_chains_are_whole(spark, monkeypatch):
    done, whole = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df: (done.append(1), whole(df))[1])
    stars = [(10 * s, 10 * s + i) for s in range(5) for i in range(1, 6)]
    got = components.components(spark.createDataFrame(stars + [(3, 3), (None, 4), (12, 10)], "u long, v long"))
    assert {(r.node, r.component) for r in got.collect()} == {(v, u) for u, v in stars} | {(u, u) for u, _ in stars}
    assert len(done) == 1
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1002, 1001), (1002, 1003)]
    got = components.components(spark.createDataFrame(chain, "u long, v long"))
    assert sorted((r.node, r.component) for r in got.collect()) == [(i, 0) for i in range(301)] + [(1000 + i, 1000) for i in range(4)]
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0
