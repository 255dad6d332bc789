"""What a directed graph is made of: strongly connected components and layers of longest ways."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.operators.cut import cut, dealt, width

#: Steps that are planned together before their rows are written and counted; rounds of peeling after which used links go.
STEPS = 4


def _nodes(links: DataFrame, name: str) -> DataFrame:
    return links.select(F.col("src").alias(name)).unionByName(links.select(F.col("dst").alias(name))).distinct()


def peel(links: DataFrame, graphs: int = 1, steps: int = STEPS) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """links (src, dst, mask) -> nodes (node, own), what each round frees (node, freed), what is never freed (node, need_0, need_1, ...).

    Bit i of a mask tells that something is of graph i, so graphs that have most links in common are peeled together. A
    node is freed when all nodes with a link to it are: a round's nodes send word along their links, once a link in all, and
    each node counts down the links that it waits for. Links and nodes are dealt out once, by src and by node, so only
    these words are shuffled; nodes that wait are written each round, links not yet used every `steps` rounds.
    """
    n = range(graphs)
    bit = lambda mask, i: F.shiftrightunsigned(mask, i).bitwiseAND(1).cast("long")
    free = lambda of: sum((F.when(of(i), 1 << i).otherwise(0) for i in n[1:]), F.when(of(0), 1).otherwise(0)).cast("int")
    links = links.where("src IS NOT NULL AND dst IS NOT NULL").groupBy("src", "dst").agg(F.bit_or(F.col("mask").cast("int")).alias("mask"))
    arcs = dealt(links.repartition(width(links.sparkSession), "src"))
    ends = arcs.select(F.col("dst").alias("node"), "mask", *[bit("mask", i).alias(f"need_{i}") for i in n]).unionByName(arcs.select(F.col("src").alias("node"), "mask", *[F.lit(0).cast("long").alias(f"need_{i}") for i in n]))
    state = ends.groupBy("node").agg(F.bit_or("mask").alias("own"), *[F.sum(f"need_{i}").alias(f"need_{i}") for i in n])
    state = dealt(state.withColumn("freed", free(lambda i: (bit("own", i) == 1) & (F.col(f"need_{i}") == 0))))
    nodes, rounds = state.select("node", "own"), []
    waits = " OR ".join(f"need_{i} > 0" for i in n)
    while not (heads := state.where("freed <> 0").select("node", "freed")).isEmpty():
        rounds.append(heads)
        if len(rounds) % steps == 0:
            arcs = dealt(arcs.join(state.select("node").hint("shuffle_hash"), arcs["src"] == state["node"], "left_semi"))
        sent = heads.hint("shuffle_hash").join(arcs, heads["node"] == arcs["src"]).select(F.col("dst").alias("node"), F.col("mask").bitwiseAND(F.col("freed")).alias("mask")).where("mask <> 0")
        got = sent.groupBy("node").agg(*[F.sum(bit("mask", i)).alias(f"got_{i}") for i in n])
        waiting = state.where(waits).drop("freed").join(got.hint("shuffle_hash"), "node", "left").select("node", *[(F.col(f"need_{i}") - F.coalesce(f"got_{i}", F.lit(0))).alias(f"need_{i}") for i in n], *[f"got_{i}" for i in n])
        state = dealt(waiting.select("node", *[f"need_{i}" for i in n], free(lambda i: (F.col(f"got_{i}") > 0) & (F.col(f"need_{i}") == 0)).alias("freed")))
    return nodes, rounds, state.drop("freed")


def _trimmed(links: DataFrame, steps: int) -> DataFrame:
    """The links left when those that nothing leads to, or that lead to nothing, go again and again."""
    for end, other in (("src", "dst"), ("dst", "src")):
        left = peel(links.select(F.col(end).alias("src"), F.col(other).alias("dst"), F.lit(1).alias("mask")), 1, steps)[2].select(F.col("node").alias(end))
        links = cut(links.join(left, end, "left_semi").select("src", "dst"))
    return links


def _coloured(links: DataFrame, steps: int) -> DataFrame:
    """(node, colour): the largest node that leads to each node, itself included."""
    now = _nodes(links, "node").withColumn("colour", F.col("node"))
    while True:
        start = now = cut(now)
        for _ in range(steps):
            sent = now.join(links, now["node"] == links["src"]).select(F.col("dst").alias("node"), "colour")
            now = now.unionByName(sent).groupBy("node").agg(F.max("colour").alias("colour"))
        now = cut(now)
        if now.join(start, ["node", "colour"], "left_anti").isEmpty():
            return now


def _backward(links: DataFrame, coloured: DataFrame, steps: int) -> DataFrame:
    """(node, colour): of each colour the nodes that lead to the node it is named by."""
    met = frontier = cut(coloured.where("node = colour"))
    while True:
        new = None
        for _ in range(steps):
            back = frontier.join(links, frontier["node"] == links["dst"]).select(F.col("src").alias("node"), "colour").distinct()
            frontier = back.join(met, ["node", "colour"], "left_anti")
            if new is not None:
                frontier = frontier.join(new, ["node", "colour"], "left_anti")
            new = frontier if new is None else new.unionByName(frontier)
        new = cut(new)
        if new.isEmpty():
            return met
        met, frontier = cut(met.unionByName(new)), new


def strong_components(links: DataFrame, steps: int = STEPS) -> DataFrame:
    """links (src, dst) -> (node, component, n_nodes): for each node the least node on a cycle with it, itself if there is none.

    Rounds: links on no cycle at their ends are trimmed; each node takes the largest node that leads to it as its colour;
    the nodes of a colour that lead back to its namesake are one component; links between colours, and of nodes that are
    placed, go. `steps` joins are planned together before rows are written. Links with a null end are dropped, loops and
    repeated links change nothing, an empty table gives no rows.
    """
    links = cut(links.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    nodes = _nodes(links, "node")
    left = _trimmed(cut(links.where("src <> dst")), steps)
    placed = None
    while not left.isEmpty():
        coloured = _coloured(left, steps)
        one = left.join(coloured.select(F.col("node").alias("src"), F.col("colour").alias("a")), "src").join(coloured.select(F.col("node").alias("dst"), F.col("colour").alias("b")), "dst")
        inner = cut(one.where("a = b").select("src", "dst"))
        found = _backward(inner, coloured, steps)
        placed = found if placed is None else cut(placed.unionByName(found))
        gone = found.select("node")
        rest = inner.join(gone, inner["src"] == gone["node"], "left_anti").join(gone, inner["dst"] == gone["node"], "left_anti")
        left = _trimmed(cut(rest), steps)
    if placed is None:
        return nodes.select("node", F.col("node").alias("component"), F.lit(1).cast("long").alias("n_nodes"))
    sizes = placed.groupBy("colour").agg(F.min("node").alias("component"), F.count("*").alias("n_nodes"))
    named = placed.join(sizes, "colour").select("node", "component", "n_nodes")
    return nodes.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"), F.coalesce("n_nodes", F.lit(1)).alias("n_nodes"))


def levels(links: DataFrame, steps: int = STEPS) -> DataFrame:
    """links (src, dst) -> (node, level): the number of links on the longest way to each node; null on cycles and after them.

    Links with a null end are dropped, repeated links change nothing, a loop is a cycle, an empty table gives no rows.
    """
    return levels_of(links.select("src", "dst", F.lit(1).alias("mask")), ["level"], steps).drop("own")


def levels_of(links: DataFrame, names: list[str], steps: int = STEPS) -> DataFrame:
    """links (src, dst, mask) -> (node, own, a column of levels a name): as levels, for several graphs at once.

    Bit i of mask: the link is in graph i, whose levels names[i] has; bit i of own: the node is. Nodes that no link is left to are
    peeled off level by level, see peel.
    """
    nodes, rounds, _ = peel(links, len(names), steps)
    out = nodes.select("node", "own", F.lit(0).alias("freed"), F.lit(None).cast("int").alias("level"))
    for level, freed in enumerate(rounds):
        out = out.unionByName(freed.select("node", F.lit(0).alias("own"), "freed", F.lit(level).alias("level")))
    return out.groupBy("node").agg(F.max("own").alias("own"), *[F.max(F.when(F.col("freed").bitwiseAND(1 << i) != 0, F.col("level"))).alias(name) for i, name in enumerate(names)])
