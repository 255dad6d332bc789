"""Graph queries that never walk in the driver: by an index of two-hop labels, by joins, by components and layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.operators import graph, reachability, structure
from lakeweave.plans import lineage_graph as lg
from lakeweave.sources.tables import table

ROOTS = [lg.ROOT, "dataset:seg.MACHINERY", lg.TASK]


def _reached(spark: SparkSession, d: str, roots: list[str], upstream: bool = False) -> DataFrame:
    named = spark.createDataFrame([(r,) for r in roots], "root string")
    found = reachability.index(lg.graph_edges(spark, d), lg.DEPTH).reach(named, upstream)
    return found.groupBy("node_id", "is_dataset").agg(F.min("depth").alias("depth")).select("node_id", "depth", "is_dataset")


def graph_blast_radius_index(spark: SparkSession, d: str) -> DataFrame:
    return _reached(spark, d, [lg.ROOT])


def graph_root_causes_index(spark: SparkSession, d: str) -> DataFrame:
    return _reached(spark, d, [lg.TASK], upstream=True)


def graph_many_roots_index(spark: SparkSession, d: str) -> DataFrame:
    return _reached(spark, d, ROOTS)


def graph_distances(spark: SparkSession, d: str) -> DataFrame:
    """How many steps the order of each customer's latest day is behind the first one, within ten: all pairs in one join."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(*[f("o_orderkey", F.struct("o_orderdate", "o_orderkey")).cast("string").alias(n) for f, n in ((F.min_by, "src"), (F.max_by, "dst"))])
    return reachability.index(lg.graph_edges(spark, d), lg.DEPTH).distances(o)


def graph_blast_radius_joins(spark: SparkSession, d: str) -> DataFrame:
    return graph.blast_radius(lg._edges(spark, d), lg.ROOT, lg.DEPTH, small=0)


def graph_root_causes_joins(spark: SparkSession, d: str) -> DataFrame:
    return graph.root_causes(lg._edges(spark, d), lg.TASK, lg.DEPTH, small=0)


def graph_has_cycle_joins(spark: SparkSession, d: str) -> DataFrame:
    return lg.has_cycles(spark, d, small=0)


def graph_components(spark: SparkSession, d: str) -> DataFrame:
    """Each node of the graph that was bent back, with the least node on a cycle with it and the size of that component."""
    return structure.strong_components(lg._bent(spark, d)).withColumnsRenamed({"node": "node_id"})


def graph_levels(spark: SparkSession, d: str) -> DataFrame:
    """Each node's layer: the longest way to it. In the graph that was bent back, nodes on or behind cycles have none."""
    found = structure.levels_of(lg._both(spark, d), ["layer", "bent_layer"])
    return found.where("own = 3").select(F.col("node").alias("node_id"), "layer", "bent_layer")


QUERIES = {f.__name__: f for f in (graph_blast_radius_index, graph_root_causes_index, graph_many_roots_index, graph_distances, graph_blast_radius_joins, graph_root_causes_joins, graph_has_cycle_joins, graph_components, graph_levels)}
_BENT = f"""{lg._EDGES}, ends AS (SELECT arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS a, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS z FROM orders WHERE o_custkey % 100 = 1 GROUP BY o_custkey),
g AS (SELECT src, dst FROM e UNION SELECT CAST(z AS VARCHAR), CAST(a AS VARCHAR) FROM ends WHERE a <> z),
c AS (SELECT src, dst FROM g UNION SELECT c.src, g.dst FROM c JOIN g ON g.src = c.dst),
nodes AS (SELECT src AS node_id FROM g UNION SELECT dst FROM g)"""
SQL = {
    "graph_blast_radius_index": lg.SQL["graph_blast_radius"],
    "graph_root_causes_index": lg.SQL["graph_root_causes"],
    "graph_many_roots_index": lg.SQL["graph_many_roots"],
    "graph_distances": f"""{lg._EDGES}, p AS (SELECT CAST(arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS VARCHAR) AS src, CAST(arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS VARCHAR) AS dst FROM orders GROUP BY o_custkey),
r AS (SELECT src, src AS node_id, 0 AS depth FROM p UNION SELECT r.src, e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node_id WHERE r.depth < {lg.DEPTH})
SELECT p.src, p.dst, CAST(min(r.depth) AS INTEGER) AS distance FROM p LEFT JOIN r ON r.src = p.src AND r.node_id = p.dst GROUP BY p.src, p.dst""",
    "graph_blast_radius_joins": lg.SQL["graph_blast_radius"],
    "graph_root_causes_joins": lg.SQL["graph_root_causes"],
    "graph_has_cycle_joins": lg.SQL["graph_has_cycle"],
    "graph_components": f"""{_BENT}, m AS (SELECT a.src AS node_id, least(a.src, min(a.dst)) AS component FROM c a JOIN c b ON b.src = a.dst AND b.dst = a.src GROUP BY a.src),
k AS (SELECT node_id, coalesce(component, node_id) AS component FROM nodes LEFT JOIN m USING (node_id)) SELECT node_id, component, count(*) OVER (PARTITION BY component) AS n_nodes FROM k""",
    "graph_levels": f"""{_BENT}, w AS (SELECT node_id, 0 AS depth FROM nodes WHERE node_id NOT IN (SELECT dst FROM e) UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node_id),
ring AS (SELECT DISTINCT a.src AS node_id FROM c a WHERE a.src = a.dst), bad AS (SELECT node_id FROM ring UNION SELECT c.dst FROM c JOIN ring ON c.src = ring.node_id),
l AS (SELECT node_id, CAST(max(depth) AS INTEGER) AS layer FROM w GROUP BY node_id)
SELECT node_id, layer, CASE WHEN node_id NOT IN (SELECT node_id FROM bad) THEN layer END AS bent_layer FROM l""",
}
