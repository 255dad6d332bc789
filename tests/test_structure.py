import random
from collections import deque

import pytest

from lakeweave.operators import graph, reachability, structure
from lakeweave.operators.cut import dealt


def walked(arcs, root):
    depth, queue = {root: 0}, deque([root])
    while queue:
        u = queue.popleft()
        for a, b in arcs:
            if a == u and b not in depth:
                depth[b] = depth[u] + 1
                queue.append(b)
    return depth


GRAPHS = {
    "random": lambda rng: {(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(70)},
    "dense": lambda rng: {(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(60)},
    "hub": lambda rng: {("hub", f"n{i}") for i in range(40)} | {(f"n{i}", f"n{i + 1}") for i in range(0, 39, 3)} | {("n39", "hub")},
    "chain": lambda rng: {(f"n{i:02d}", f"n{i + 1:02d}") for i in range(18)} | {("n05", "n09")},
    "rings": lambda rng: {(f"a{i}", f"a{(i + 1) % 7}") for i in range(7)} | {(f"b{i}", f"b{(i + 1) % 3}") for i in range(3)} | {("a2", "b1"), ("x", "a0"), ("b2", "y"), ("y", "z"), ("l", "l")},
}


@pytest.mark.parametrize("kind", ["random", "hub"])
def test_index_against_walks(spark, kind):
    arcs = GRAPHS[kind](random.Random(7))
    nodes = sorted({x for a in arcs for x in a})
    links = spark.createDataFrame(sorted(arcs) * 2 + [(None, "n0"), ("n0", None)], "src string, dst string")
    found = reachability.index(links, 20)
    roots = spark.createDataFrame([(n,) for n in nodes] + [("unknown",)], "root string")
    down = {(r.root, r.node_id): r.depth for r in found.reach(roots).collect()}
    want = {(a, b): n for a in nodes for b, n in walked(arcs, a).items() if n}
    assert down == want
    assert {(r.node_id, r.root): r.depth for r in found.reach(roots, upstream=True).collect()} == want
    pairs = spark.createDataFrame([(a, b) for a in nodes[:9] for b in [*nodes, "unknown"]], "src string, dst string")
    assert {(r.src, r.dst): r.distance for r in found.distances(pairs).collect()} == {(a, b): 0 if a == b else want.get((a, b)) for a in nodes[:9] for b in [*nodes, "unknown"]}


def test_index_up_to_a_depth(spark):
    links = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(9)], "src string, dst string")
    found = reachability.index(links, 3).reach(spark.createDataFrame([("n0",)], "root string"))
    assert {r.node_id: r.depth for r in found.collect()} == {"n1": 1, "n2": 2, "n3": 3}
    with pytest.raises(ValueError):
        reachability.index(links, 0)


@pytest.mark.parametrize("kind", ["dense", "chain", "rings"])
def test_components_and_levels(spark, kind):
    arcs = GRAPHS[kind](random.Random(3))
    nodes = sorted({x for a in arcs for x in a})
    links = spark.createDataFrame(sorted(arcs), "src string, dst string")
    to = {a: set(walked(arcs, a)) for a in nodes}
    mine = {a: [b for b in nodes if b in to[a] and a in to[b]] for a in nodes}
    assert {r.node: (r.component, r.n_nodes) for r in structure.strong_components(links).collect()} == {a: (m[0], len(m)) for a, m in mine.items()}
    bad = {a for a in nodes if len(mine[a]) > 1 or (a, a) in arcs}
    bad |= {b for a in bad for b in to[a]}
    longest = lambda b: max((longest(a) + 1 for a, x in arcs if x == b), default=0)
    assert {r.node: r.level for r in structure.levels(links).collect()} == {a: None if a in bad else longest(a) for a in nodes}


def test_empty_graph(spark):
    none = spark.createDataFrame([], "src string, dst string")
    assert structure.strong_components(none).collect() == [] and structure.levels(none).collect() == []
    assert reachability.index(none).reach(spark.createDataFrame([("a",)], "root string")).collect() == []


def test_dealt_rows_are_not_shuffled_again(spark, capsys):
    a = dealt(spark.range(100).selectExpr("id % 7 AS k", "id").repartition(8, "k"))
    b = dealt(a.groupBy("k").count())
    a.join(b.hint("shuffle_hash"), "k").explain()
    assert "Exchange" not in capsys.readouterr().out
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_two_graphs_are_peeled_together(spark):
    chain = [(f"n{i:02d}", f"n{i + 1:02d}", 3) for i in range(18)] + [("n05", "n09", 3), ("n05", "n09", 1), (None, "n01", 3)]
    links = spark.createDataFrame(chain + [("n09", "n05", 2), ("x", "n17", 2)], "src string, dst string, mask int")
    found = {r.node: (r.own, r.a, r.b) for r in structure.levels_of(links, ["a", "b"]).collect()}
    whole = {f"n{i:02d}": i for i in range(19)}
    assert found == {n: (3, i, i if i < 5 else None) for n, i in whole.items()} | {"x": (2, None, 0)}
    assert graph.have_cycles(links, 2, small=0) == graph.have_cycles(links, 2) == [False, True]
