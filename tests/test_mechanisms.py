import random
from pathlib import Path

import pytest

from lakeweave.operators import allocation, textsearch
from lakeweave.sources import sink


@pytest.mark.parametrize("part", [2, 100])
def test_allocation_against_plain_rounds(spark, part):
    rng = random.Random(1)
    nodes = [f"n{i}" for i in range(12)]
    shares = [("n0", t, 3, 100) for t in nodes] + [(rng.choice(nodes), rng.choice(nodes), rng.randrange(1, 9), 40) for _ in range(40)] + [(None, "n1", 1, 2), ("n1", "n2", 1, 0)]
    amounts = {n: rng.randrange(0, 10**6) for n in nodes[:5]}
    want, now = [], amounts
    for k in range(1, 9):
        new = {}
        for s, t, w, total in shares:
            if s and total and now.get(s, 0) > 50:
                new[t] = new.get(t, 0) + now[s] * w // total
        now = {n: a for n, a in new.items() if a > 0}
        want += [(k, n, a) for n, a in now.items()]
    a = spark.createDataFrame(list(amounts.items()), "node string, amount long")
    s = spark.createDataFrame(shares, "source string, target string, weight long, total long")
    assert sorted(map(tuple, allocation.allocate(a, s, 50, 8, part).collect())) == sorted(want)
    assert allocation.allocate(a.limit(0), s).collect() == []


def files(folder, value):
    return {p.name for p in Path(folder, f"day={value}").glob("part-*")}


def test_merge_rewrites_only_touched_partitions(spark, tmp_path):
    folder, schema = f"{tmp_path}/t", "id long, v string, at int, day string"
    rows = [(i, "old", 0, f"d{i % 4}") for i in range(40)] + [(90, "only one", 0, "d9"), (91, "x", 0, None), (92, "y", 0, "a/b")]
    table = spark.createDataFrame(rows, schema)
    sink.create(table, folder, "day")
    before = {d: files(folder, d) for d in ("d0", "d1", "d2", "d3")}
    changes = spark.createDataFrame([(0, "new", 1, "d0"), (4, "late", -1, "d0"), (90, "moved", 1, "d1"), (100, "came", 1, "d7")], schema)
    gone = spark.createDataFrame([(92,), (12345,)], "id long")
    want = {r[0]: r for r in rows} | {0: (0, "new", 1, "d0"), 90: (90, "moved", 1, "d1"), 100: (100, "came", 1, "d7")}
    del want[92]
    for turn in range(2):
        n = sink.merge_into(spark, folder, table.schema, changes, ["id"], "day", newer="at", gone=gone)
        assert n == (5 if turn == 0 else 3)  # d0, d1, d7, and once d9 and a/b
        got = sink.read(spark, folder, table.schema).collect()
        assert {r.id: tuple(r) for r in got} == want and len(got) == len(want)
    assert all((files(folder, d) == before[d]) == (d in ("d2", "d3")) for d in before)
    assert not files(folder, "d9") and not Path(folder, "day=d9").exists()


def test_text_search_against_plain_search(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcÄé_%") for _ in range(n))
    texts = [(i, word(rng.randrange(0, 40))) for i in range(150)] + [(150, None), (151, "")]
    needles = [word(n) for n in (1, 1, 2, 2, 3, 3, 4, 4, 5, 6) for _ in range(4)] + ["ABC", "", None, "a" * 50]
    df = spark.createDataFrame(texts, "k int, t string")
    got = textsearch.search(df, textsearch.index(df, "k", "t"), spark.createDataFrame([(n,) for n in needles], "needle string"), "k", "t").collect()
    want = {(n, k) for n in needles if n for k, t in texts if t and n.lower() in t.lower()}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_text_search_meets_equal_texts_and_needles_of_one_form_once(spark):
    rows = [(i, f"insert into mart.t{1000 + i % 300}") for i in range(600)] + [(900, "Ünï😀cødé mart.t1001"), (901, "mart.t1001 mart.t1001")]
    df = spark.createDataFrame(rows, "k long, t string")
    needles = [f"Mart.T{1000 + i}" for i in range(300)] + ["😀CØ", "cødé m", "into"]
    postings = textsearch.index(df, "k", "t")
    assert postings.select("id").distinct().count() == 302
    got = textsearch.search(df, postings, spark.createDataFrame([(n,) for n in needles], "needle string"), "k", "t").collect()
    assert sorted((r.needle, r.id) for r in got) == sorted((n, k) for n in needles for k, t in rows if n.lower() in t.lower())


def test_allocation_does_not_shuffle_the_shares_again(spark, capsys):
    shares = spark.range(50_000).selectExpr("id % 500 AS source", "id AS target", "1L AS weight", "200L AS total")
    amounts = spark.range(500).selectExpr("id AS node", "1000L AS amount")
    written, real = [], allocation.cut
    allocation.cut = lambda df: written.append(df) or real(df)
    try:
        assert allocation.allocate(amounts, shares, 0, 1).count() == 50_000
    finally:
        allocation.cut = real
    written[-1].explain()
    plan = capsys.readouterr().out
    join = plan.splitlines()
    at = next(i for i, line in enumerate(join) if "ShuffledHashJoin" in line)
    assert not any("Exchange hashpartitioning(source" in line for line in join[at:])
