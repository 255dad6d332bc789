import random

import pytest

from lakeweave.operators import bitmaps, temporal
from lakeweave.plans import temporal_joins


def brute(left, right, side):
    """left: (key, at, id); right: (key, at, tie, name)."""
    out = []
    for k, at, i in left:
        own = [] if k is None or at is None else [r for r in right if r[0] == k and r[1] is not None]
        back = max((r for r in own if r[1] <= at), key=lambda r: (r[1], r[2]), default=None)
        first = min((r[1] for r in own if r[1] >= at), default=None)
        ahead = max((r for r in own if r[1] == first), key=lambda r: r[2], default=None)
        met = {"backward": back, "forward": ahead, "nearest": back if ahead is None or back is not None and at - back[1] <= ahead[1] - at else ahead}[side]
        out.append((k, at, i, met and met[3]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("side", temporal.SIDES)
def test_as_of_with_a_hot_key(spark, side):
    rng = random.Random(4)
    key = lambda: rng.choice(["hot", "hot", "hot", "cold", "left only", None])
    left = [(key(), rng.choice([None, rng.randrange(-300, 300)]), i) for i in range(300)]
    right = [(k if k != "left only" else "right only", at, t, f"r{i}") for i in range(150) for k, at, t in [(key(), rng.choice([None, rng.randrange(-300, 300), rng.randrange(100, 110)]), i)]]
    a = spark.createDataFrame(left, "k string, at int, id int")
    b = spark.createDataFrame(right, "k string, place int, tie int, name string")
    for width in (7, 1000):
        got = temporal.as_of(a, b, ["k"], ("at", "place"), width, ["name"], side, "tie")
        assert got.columns == ["k", "at", "id", "name"] and sorted(map(tuple, got.collect()), key=repr) == brute(left, right, side)


def test_as_of_without_right_rows_and_with_bad_names(spark):
    a, b = spark.createDataFrame([("x", 1)], "k string, at int"), spark.createDataFrame([], "k string, place int, name string")
    assert [tuple(r) for r in temporal.as_of(a, b, ["k"], ("at", "place"), 5, ["name"], "nearest").collect()] == [("x", 1, None)]
    with pytest.raises(ValueError):
        temporal.as_of(a, a, ["k"], ("at", "at"), 5, ["at"])


def test_band_join_of_all_lengths(spark):
    rng = random.Random(6)
    spans = [(rng.choice(["a", "b", None]), lo, lo + rng.choice([0, 1, 2, 3, 10, 500, 5000]), i) for i in range(200) for lo in [rng.randrange(-3000, 3000)]] + [("a", None, 5, -1), ("a", -10_000, 10_000, -2)]
    points = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(-3500, 3500)]), i) for i in range(200)]
    want = sorted((p[2], s[3]) for p in points for s in spans if p[0] is not None and p[0] == s[0] and None not in (p[1], s[1]) and s[1] <= p[1] < s[2])
    got = temporal.band_join(spark.createDataFrame(points, "k string, at long, point int"), spark.createDataFrame(spans, "k string, low long, high long, span int"), "at", "low", "high", ["k"])
    assert got.columns == ["k", "at", "point", "low", "high", "span"] and sorted((r.point, r.span) for r in got.collect()) == want


def test_sessions_of_a_hot_actor(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["hot"] * 4 + ["cold", None]), rng.choice([None] + [rng.randrange(0, 40_000)] * 9)) for _ in range(1500)]
    want = {}
    for actor in ("hot", "cold"):
        session, last = 0, None
        for t in sorted(t for a, t in rows if a == actor and t is not None):
            session += last is None or t - last > 30
            n, first = want.get((actor, session), (0, t))[:2]
            want[actor, session] = (n + 1, first, t)
            last = t
    events = spark.createDataFrame(rows, "who string, s long").selectExpr("who", "timestamp_seconds(s) AS ts")
    for width in (10, 60, 100_000):
        got = temporal.sessions(events, "who", "ts", 30, width).selectExpr("actor", "session", "n", "unix_seconds(started) AS a", "unix_seconds(ended) AS b").collect()
        assert {(r.actor, r.session): (r.n, r.a, r.b) for r in got} == want and len(got) == len(want)


def test_bitmaps_of_large_numbers(spark):
    rows = [("x", 0), ("x", 0), ("x", 32_767), ("x", 32_768), ("y", 10**12), ("y", None), ("z", None)]
    maps = bitmaps.daily(spark.createDataFrame(rows, "k string, n long"), ["k"], "n")
    assert {r.k: r.n for r in bitmaps.counted(maps, ["k"]).collect()} == {"x": 3, "y": 1}
    assert bitmaps.counted(bitmaps.merged(maps, []), []).first().n == 4


def test_orders_with_the_same_ends_meet_the_days_once(spark, tmp_path, monkeypatch):
    spark.range(3000).selectExpr("id AS o_orderkey", "timestamp_seconds(86400 * (id % 3)) AS o_orderdate", "id % 5 + 0.2D AS o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(3000).selectExpr("id AS l_orderkey", "timestamp_seconds(86400 * (id % 3 + id % 2 + 1)) AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    met = []
    joined = temporal.band_join
    monkeypatch.setattr(temporal, "band_join", lambda *args: met.append(joined(*args)) or met[-1])
    got = {r.day.day: (r.n_open, r.price) for r in temporal_joins.band_open_orders(spark, str(tmp_path)).collect()}
    rows = [(i % 3, i % 3 + i % 2 + 1, i % 5) for i in range(3000)]
    open_on = {day: [p for low, high, p in rows if low <= day < high] for day in range(1, 5)}
    assert sorted(got.values()) == sorted((len(ps), sum(ps)) for ps in open_on.values() if ps)
    assert met[0].count() < 20
