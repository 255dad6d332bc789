"""Shortest distances in a directed graph from an index of two-hop labels, so that a walk of any depth is one join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.operators.cut import cut, dealt, width
from lakeweave.operators.numbering import numbered

IN, OUT = "in", "out"
#: Levels of labels that are joined anew each time before they are written together.
STACKED = 3


@dataclass(frozen=True)
class Index:
    """nodes: (node_id, id); labels: (way, id, hub, distance), where way tells whether the hub leads to the node (in) or the node to the hub (out)."""

    nodes: DataFrame
    labels: DataFrame
    max_depth: int

    def _named(self, names: DataFrame, way: str) -> DataFrame:
        """names (root) -> (root, hub, near): their labels of one way."""
        ids = names.select("root").distinct().join(self.nodes, F.col("root") == F.col("node_id")).select("root", "id")
        return ids.join(self.labels.where(F.col("way") == way), "id").select("root", "hub", F.col("distance").alias("near"))

    def reach(self, roots: DataFrame, upstream: bool = False) -> DataFrame:
        """roots (root) -> (root, node_id, depth, is_dataset): all that a root reaches, or with upstream all that reach it, by shortest depth."""
        near = self._named(roots, IN if upstream else OUT)
        far = self.labels.where(F.col("way") == (OUT if upstream else IN)).select("id", "hub", "distance")
        met = near.join(far, "hub").groupBy("root", "id").agg(F.min(F.col("near") + F.col("distance")).alias("depth"))
        met = met.where(F.col("depth").between(1, self.max_depth)).join(self.nodes, "id")
        return met.select("root", "node_id", F.col("depth").cast("int"), F.col("node_id").startswith("dataset:").alias("is_dataset"))

    def distances(self, pairs: DataFrame) -> DataFrame:
        """pairs (src, dst) -> (src, dst, distance): 0 to itself, null where dst is not reached within max_depth or a name is unknown. Distinct pairs."""
        asked = cut(pairs.select("src", "dst").distinct())
        a = self._named(asked.select(F.col("src").alias("root")), OUT)
        b = self._named(asked.select(F.col("dst").alias("root")), IN)
        via = asked.join(a.select(F.col("root").alias("src"), "hub", F.col("near").alias("x")), "src").join(b.select(F.col("root").alias("dst"), "hub", F.col("near").alias("y")), ["dst", "hub"])
        found = via.groupBy("src", "dst").agg(F.min(F.col("x") + F.col("y")).alias("distance")).where(F.col("distance") <= self.max_depth)
        return asked.join(found, ["src", "dst"], "left").select("src", "dst", F.col("distance").cast("int"))


def index(links: DataFrame, max_depth: int = 50) -> Index:
    """links (src, dst) -> the labels of all nodes for distances up to max_depth.

    Nodes are numbered by their number of links, the most linked first. A node's labels are those hubs of a smaller number
    that are the smallest on all shortest ways between the two. Labels of distance d come from the neighbours' labels of
    distance d - 1 and are dropped if two shorter labels already join the two as shortly, all nodes at once; levels end with the
    longest shortest way. Links with a null end are dropped; loops and repeated links add nothing; cycles are harmless.

    A node's labels of both ways are one row of arrays of codes (twice the hub's number, plus 1 for out) and distances. Arcs and
    labels are dealt out once by node; only what is sent along arcs is shuffled, and labels with a hub of a smaller number, which
    alone can make a new one needless, are looked up at the new one's hub.
    """
    if not 1 <= max_depth <= 100:
        raise ValueError("max_depth is from 1 to 100")
    links = cut(links.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    ends = links.select(F.col("src").alias("node_id")).unionByName(links.select(F.col("dst").alias("node_id")))
    degrees = ends.groupBy("node_id").agg(F.count("*").alias("n"))
    nodes = cut(numbered(degrees, [F.col("n").desc(), F.xxhash64("node_id").asc(), F.col("node_id").asc()]).select("node_id", "id"))
    arcs = links.where("src <> dst").join(nodes.select(F.col("node_id").alias("src"), F.col("id").alias("u")), "src").join(nodes.select(F.col("node_id").alias("dst"), F.col("id").alias("v")), "dst")
    arcs = arcs.select(F.explode(F.expr("array(struct(u AS from, v AS to, 0 AS out), struct(v AS from, u AS to, 1 AS out))")).alias("a")).select("a.*")
    parts = width(links.sparkSession)
    arcs = dealt(arcs.repartition(parts, "from"))
    fresh = dealt(nodes.select("id", F.expr("array(2 * id, 2 * id + 1)").alias("new")).repartition(parts, "id"))
    labels = dealt(fresh.select("id", F.expr("CAST(array() AS ARRAY<BIGINT>)").alias("codes"), F.expr("CAST(array() AS ARRAY<INT>)").alias("at")))
    for depth in range(1, max_depth + 1):
        # Few rows a node meet its many arcs: they are held, the arcs stream by.
        sent = fresh.hint("shuffle_hash").join(arcs, fresh["id"] == arcs["from"]).select(F.col("to").alias("id"), F.explode(F.expr("filter(new, c -> c % 2 = out AND c div 2 < to)")).alias("c"))
        ahead = sent.repartition(parts, "id").groupBy("id").agg(F.collect_set("c").alias("new"))
        ahead = dealt(labels.join(ahead.hint("shuffle_hash"), "id").withColumn("new", F.array_except("new", "codes")).where("size(new) > 0"))
        if ahead.isEmpty():
            break
        doubted = ahead.select("id", "codes", "at", F.explode("new").alias("c")).select("id", "c", F.expr("filter(arrays_zip(codes, at), l -> l.codes % 2 = c % 2 AND l.codes < c)").alias("via")).where("size(via) > 0")
        doubted = dealt(doubted.withColumn("hub", F.expr("c div 2")).repartition(parts, "hub"))
        fresh = ahead.select("id", "new")
        if not doubted.isEmpty():
            theirs = labels.select(F.col("id").alias("hub"), F.expr("map_from_arrays(transform(codes, c -> c ^ 1), at)").alias("theirs"))
            short = doubted.join(theirs, "hub").where(f"exists(via, l -> l.at + element_at(theirs, l.codes) <= {depth})")
            short = short.repartition(parts, "id").groupBy("id").agg(F.collect_set("c").alias("short"))
            fresh = fresh.join(short.hint("shuffle_hash"), "id", "left").select("id", F.expr("IF(short IS NULL, new, array_except(new, short))").alias("new"))
        fresh = dealt(fresh.where("size(new) > 0"))
        if fresh.isEmpty():
            break
        labels = labels.join(fresh.hint("shuffle_hash"), "id", "left").select("id", F.expr("IF(new IS NULL, codes, concat(codes, new))").alias("codes"), F.expr(f"IF(new IS NULL, at, concat(at, array_repeat({depth}, size(new))))").alias("at"))
        if depth % STACKED == 0:
            labels = dealt(labels)
    labels = dealt(labels)
    way = F.expr(f"IF(code % 2 = 0, '{IN}', '{OUT}')").alias("way")
    own = labels.select("id", F.inline(F.arrays_zip(F.expr("concat(codes, array(2 * id, 2 * id + 1))").alias("code"), F.expr("concat(at, array(0, 0))").alias("distance"))).alias("code", "distance"))
    return Index(nodes, own.select(way, "id", F.expr("code div 2").alias("hub"), "distance"), max_depth)
