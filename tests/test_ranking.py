import random

from pyspark.sql import functions as F

from lakeweave.operators.ranking import ranked, tile


def test_ranks_and_tiles_by_group(spark):
    rng = random.Random(3)
    rows = [(g, i, rng.choice([None, 0, -7, 5, rng.randrange(-10**6, 10**9)])) for g in ("a", "b", None) for i in range(rng.randrange(3, 300))]
    df = ranked(spark.createDataFrame(rows, "g string, i int, v long"), "v", "i", ["g"]).withColumn("tile", tile(F.col("rn"), F.col("n_group"), 10))
    got = {(r.g, r.i): (r.rn, r.n_group, r.running, r.total, r.tile) for r in df.collect()}
    assert len(got) == len(rows)
    for g in ("a", "b", None):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2] is None, -(r[2] or 0), r[1]))
        total, running = sum(r[2] or 0 for r in mine), 0
        sizes = [len(mine) // 10 + (k < len(mine) % 10) for k in range(10)]
        tiles = [k + 1 for k, n in enumerate(sizes) for _ in range(n)]
        for at, r in enumerate(mine):
            running += r[2] or 0
            assert got[g, r[1]] == (at + 1, len(mine), running, total, tiles[at])


def test_an_empty_table_has_no_ranks(spark):
    assert ranked(spark.createDataFrame([], "i int, v long"), "v", "i").count() == 0
