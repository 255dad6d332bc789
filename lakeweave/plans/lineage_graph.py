"""Queries over the dependency graph derived from orders: each order depends on its customer's order before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeweave.operators import graph
from lakeweave.sources.tables import table

ROOT, TASK, DEPTH = "dataset:seg.BUILDING", "6", 10


def dependencies(spark: SparkSession, d: str) -> DataFrame:
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    o = o.withColumns({"prev": F.lag("o_orderkey").over(by), "prev2": F.lag("o_orderkey", 2).over(by)})
    o = o.join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.withColumn("other", F.expr("explode(IF(o_orderkey % 7 = 0 AND prev2 IS NOT NULL, array(prev, prev2), array(prev)))"))
    return o.selectExpr("CAST(o_orderkey AS STRING) AS task_id", "CAST(other AS STRING) AS depends_on_task_id", "IF(other IS NULL, concat('seg.', c_mktsegment), NULL) AS depends_on_table")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.cut(graph.edges(dependencies(spark, d)))


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges(dependencies(spark, d))


def graph_blast_radius(spark: SparkSession, d: str) -> DataFrame:
    return graph.blast_radius(_edges(spark, d), ROOT, DEPTH)


def graph_root_causes(spark: SparkSession, d: str) -> DataFrame:
    return graph.root_causes(_edges(spark, d), TASK, DEPTH)


def graph_many_roots(spark: SparkSession, d: str) -> DataFrame:
    return graph.impact_of_many(_edges(spark, d), [ROOT, "dataset:seg.MACHINERY", TASK], DEPTH)


def graph_layers(spark: SparkSession, d: str) -> DataFrame:
    return graph.layers(graph.reach(_edges(spark, d), [ROOT], DEPTH))


def _back(spark: SparkSession, d: str) -> DataFrame:
    """Edges from the last order of every hundredth customer back to the first: cycles."""
    o = table(spark, d, "orders").where("o_custkey % 100 = 1").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last"))
    return o.where("first <> last").select(F.col("last").cast("string").alias("src"), F.col("first").cast("string").alias("dst"))


def _bent(spark: SparkSession, d: str) -> DataFrame:
    """The edges, and those back."""
    return graph_edges(spark, d).unionByName(_back(spark, d))


def _both(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, mask) of two graphs: bit 0 the edges, bit 1 with those back."""
    return graph_edges(spark, d).withColumn("mask", F.lit(3)).unionByName(_back(spark, d).withColumn("mask", F.lit(2)))


def has_cycles(spark: SparkSession, d: str, small: int = graph.SMALL) -> DataFrame:
    whole, bent = graph.have_cycles(_both(spark, d), 2, small)
    return spark.range(1).select(F.explode(F.create_map(F.lit("as it is"), F.lit(whole), F.lit("bent back"), F.lit(bent))).alias("graph", "has_cycle"))


def graph_has_cycle(spark: SparkSession, d: str) -> DataFrame:
    """Whether the graph, and one that was bent back on purpose, have a cycle."""
    return has_cycles(spark, d)


def downstream(links: DataFrame, root: str, max_depth: int) -> DataFrame:
    """(node_id, depth) by recursive SQL over paths: one row for each distinct depth at which a node is met.

    It walks every path, as the statement it stands for does; `reach` is the way for wide graphs.
    """
    text = "WITH RECURSIVE r(node_id, depth) AS (SELECT :root, 0 UNION ALL SELECT e.dst, r.depth + 1 FROM r JOIN {links} e ON e.src = r.node_id WHERE r.depth < :most) SELECT DISTINCT node_id, depth FROM r WHERE depth > 0"
    return links.sparkSession.sql(text, args={"root": root, "most": max_depth}, links=links)


def graph_downstream_paths(spark: SparkSession, d: str) -> DataFrame:
    return graph.depths(_edges(spark, d), [ROOT], DEPTH)


def graph_upstream_paths(spark: SparkSession, d: str) -> DataFrame:
    return graph.depths(graph.reversed_links(_edges(spark, d).where("NOT startswith(src, 'dataset:')")), [TASK], DEPTH)


_EDGES = """WITH RECURSIVE o AS (SELECT o_orderkey, c_mktsegment, lag(o_orderkey) OVER w AS prev, lag(o_orderkey, 2) OVER w AS prev2 FROM orders JOIN customer ON o_custkey = c_custkey WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
e AS (SELECT DISTINCT coalesce(CAST(prev AS VARCHAR), 'dataset:seg.' || c_mktsegment) AS src, CAST(o_orderkey AS VARCHAR) AS dst FROM o UNION SELECT CAST(prev2 AS VARCHAR), CAST(o_orderkey AS VARCHAR) FROM o WHERE o_orderkey % 7 = 0 AND prev2 IS NOT NULL)"""


def _walk(root: str, a: str = "src", b: str = "dst", source: str = "e") -> str:
    return f"{_EDGES}, r AS (SELECT {root} AS node_id, 0 AS depth UNION ALL SELECT x.{b}, r.depth + 1 FROM r JOIN {source} x ON x.{a} = r.node_id WHERE r.depth < {DEPTH})"


_LEAST = "SELECT node_id, CAST(min(depth) AS INTEGER) AS depth, starts_with(node_id, 'dataset:') AS is_dataset FROM r WHERE depth > 0 GROUP BY node_id"
QUERIES = {f.__name__: f for f in (graph_edges, graph_blast_radius, graph_root_causes, graph_many_roots, graph_layers, graph_has_cycle, graph_downstream_paths, graph_upstream_paths)}
SQL = {
    "graph_edges": f"{_EDGES} SELECT src, dst FROM e",
    "graph_blast_radius": f"{_walk(repr(ROOT))} {_LEAST}",
    "graph_root_causes": f"{_walk(repr(TASK), 'dst', 'src')} {_LEAST}",
    "graph_many_roots": f"{_walk(f'unnest([{ROOT!r}, {"dataset:seg.MACHINERY"!r}, {TASK!r}])')} {_LEAST}",
    "graph_layers": f"{_walk(repr(ROOT))}, m AS ({_LEAST}) SELECT depth, count(*) AS n_nodes, count(*) FILTER (WHERE is_dataset) AS n_datasets FROM m GROUP BY depth",
    "graph_has_cycle": f"""{_EDGES}, ends AS (SELECT arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS a, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS z FROM orders WHERE o_custkey % 100 = 1 GROUP BY o_custkey),
g AS (SELECT 'as it is' AS graph, src, dst FROM e UNION ALL SELECT 'bent back', src, dst FROM e UNION ALL SELECT 'bent back', CAST(z AS VARCHAR), CAST(a AS VARCHAR) FROM ends WHERE a <> z),
c AS (SELECT graph, src, dst FROM g UNION SELECT c.graph, c.src, g.dst FROM c JOIN g ON g.src = c.dst AND g.graph = c.graph) SELECT graph, bool_or(src = dst) AS has_cycle FROM c GROUP BY graph""",
    "graph_downstream_paths": f"{_walk(repr(ROOT))} SELECT DISTINCT node_id, CAST(depth AS INTEGER) AS depth FROM r WHERE depth > 0",
    "graph_upstream_paths": f"{_walk(repr(TASK), 'dst', 'src', chr(40) + 'SELECT * FROM e WHERE NOT starts_with(src, ' + repr('dataset:') + ')' + chr(41))} SELECT DISTINCT node_id, CAST(depth AS INTEGER) AS depth FROM r WHERE depth > 0",
}
