import pytest

from lakeweave.operators import graph

SAMPLE = [("ingest", None, "raw.orders"), ("transform", "ingest", None), ("report_a", "transform", None), ("report_b", "transform", None)]


def links(spark, rows):
    return graph.edges(spark.createDataFrame(rows, "task_id string, depends_on_task_id string, depends_on_table string"))


def depths(df):
    return {r.node_id: r.depth for r in df.collect()}


def test_downstream_depths(spark):
    assert depths(graph.blast_radius(links(spark, SAMPLE), "dataset:raw.orders")) == {"ingest": 1, "transform": 2, "report_a": 3, "report_b": 3}


def test_upstream_depths(spark):
    found = graph.root_causes(links(spark, SAMPLE), "report_a")
    assert depths(found) == {"transform": 1, "ingest": 2, "dataset:raw.orders": 3}
    assert [r.is_dataset for r in found.collect()] == [False, False, True]


def test_cutoff_and_unknown_root(spark):
    e = links(spark, SAMPLE)
    assert depths(graph.blast_radius(e, "dataset:raw.orders", 1)) == {"ingest": 1}
    assert depths(graph.blast_radius(e, "nothing")) == {}
    with pytest.raises(ValueError):
        graph.blast_radius(e, "ingest", 0)


def test_diamond_takes_the_shortest_way(spark):
    rows = [("b", "a", None), ("c", "a", None), ("d", "b", None), ("d", "c", None), ("e", "a", None), ("f", "e", None), ("d", "f", None)]
    assert depths(graph.blast_radius(links(spark, rows), "a")) == {"b": 1, "c": 1, "e": 1, "d": 2, "f": 2}


def test_cycles_end_and_are_found(spark):
    loop = links(spark, [("y", "x", None), ("x", "y", None)])
    assert depths(graph.blast_radius(loop, "x")) == {"y": 1}
    assert graph.has_cycle(loop)
    assert not graph.has_cycle(links(spark, SAMPLE))


def test_fan_out_and_several_roots(spark):
    wide = links(spark, [(f"t{i}", "hub", None) for i in range(20)])
    assert set(depths(graph.blast_radius(wide, "hub")).values()) == {1}
    assert depths(graph.impact_of_many(links(spark, SAMPLE), ["dataset:raw.orders", "transform"])) == {"ingest": 1, "transform": 2, "report_a": 1, "report_b": 1}


def test_depths_are_given_once_for_all_ways(spark):
    rows = [(f"{a}{i}", f"{b}{i + 1}") for i in range(12) for a in "xy" for b in "xy"]  # 2 to the 12th ways
    found = graph.depths(spark.createDataFrame(rows + [("x12", "x0")], "src string, dst string"), ["x0"], 14).collect()
    assert sorted((r.depth, r.node_id) for r in found) == sorted([(i, f"{a}{i}") for i in range(1, 13) for a in "xy"] + [(13, "x0"), (14, "x1"), (14, "y1")])
