"""Dependency graphs: edges, downstream impact, root causes, layers and cycles, as joins of a frontier with the edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.operators import structure
from lakeweave.operators.cut import cut as cut

#: Edges (of two names each) of a graph that is walked in the driver, at most, and roots walked there one by one.
SMALL, FEW = 200_000, 100


def edges(dependencies: DataFrame) -> DataFrame:
    """(task_id, depends_on_task_id, depends_on_table) -> distinct (src, dst); a table is the node dataset:<table>."""
    upstream = F.coalesce(F.nullif(F.col("depends_on_task_id"), F.lit("")), F.concat(F.lit("dataset:"), "depends_on_table"))
    return dependencies.select(upstream.alias("src"), F.col("task_id").alias("dst")).where("src IS NOT NULL").distinct()


def reversed_links(links: DataFrame) -> DataFrame:
    return links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _walk_small(found: pa.Table, roots: list[str], max_depth: int) -> pa.Table:
    """(root, node_id, depth) over edges in memory, level by level."""
    names = pa.chunked_array([*found["src"].chunks, *found["dst"].chunks, pa.array(roots, pa.string())]).combine_chunks().dictionary_encode()
    codes, n = names.indices.to_numpy(), len(found)
    src, dst = codes[:n], codes[n : 2 * n]
    order = np.argsort(src, kind="stable")
    dst, starts = dst[order], np.searchsorted(src[order], np.arange(len(names.dictionary) + 1))
    out: list[list[np.ndarray]] = [[], [], []]
    for root in codes[2 * n :]:
        met = np.zeros(len(names.dictionary), bool)
        met[root] = True
        frontier = np.array([root])
        for depth in range(1, max_depth + 1):
            count = starts[frontier + 1] - starts[frontier]
            at = np.repeat(starts[frontier] - np.cumsum(count) + count, count) + np.arange(count.sum())
            frontier = np.unique(dst[at])
            frontier = frontier[~met[frontier]]
            if not len(frontier):
                break
            met[frontier] = True
            for into, x in zip(out, (np.full(len(frontier), root), frontier, np.full(len(frontier), depth, np.int32))):
                into.append(x)
    root, node, depth = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in out)
    return pa.table({"root": names.dictionary.take(pa.array(root)).cast(pa.string()), "node_id": names.dictionary.take(pa.array(node)).cast(pa.string()), "depth": pa.array(depth, pa.int32())})


def reach(links: DataFrame, roots: list[str] | DataFrame, max_depth: int, small: int = SMALL) -> DataFrame:
    """(root, node_id, depth, is_dataset): shortest depth of each node that a root reaches along links, roots left out.

    roots: names, or a table with a column root. Unknown roots reach nothing; cycles end, as each node is met once.
    A graph of at most `small` edges, by a count of all, with few roots by name is walked in the driver. In others each
    level joins the frontier with the edges and drops what was met before; what was met so far is written to the checkpoint
    folder, so plans stay short.
    """
    if not 1 <= max_depth <= 100:
        raise ValueError("max_depth is from 1 to 100")
    spark = links.sparkSession
    named = isinstance(roots, list)
    if named and len(set(roots)) <= FEW and links.count() <= small:
        walked = _walk_small(links.select("src", "dst").toArrow(), sorted(set(roots)), max_depth)
        met = spark.createDataFrame(walked)
        return met.withColumn("is_dataset", F.col("node_id").startswith("dataset:"))
    start = spark.range(1).select(F.explode(F.array(*[F.lit(r) for r in sorted(set(roots))])).alias("root")) if named else roots.select("root").distinct()
    met = start.select("root", F.col("root").alias("node_id"), F.lit(0).alias("depth"))
    frontier = met
    for depth in range(1, max_depth + 1):
        ahead = frontier.join(links, frontier["node_id"] == links["src"]).select("root", F.col("dst").alias("node_id")).distinct()
        frontier = cut(ahead.join(met, ["root", "node_id"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        met = met.unionByName(frontier)
    return met.where("depth > 0").withColumn("is_dataset", F.col("node_id").startswith("dataset:"))


def depths(links: DataFrame, roots: list[str], max_depth: int) -> DataFrame:
    """(node_id, depth): every depth up to max_depth at which a way from a root meets a node, once each; also on cycles.

    Ways are not told apart: a level is the distinct nodes after those of the level before, so it has a row a node at most,
    however many ways lead there, and is written before the next one.
    """
    spark = links.sparkSession
    level = spark.range(1).select(F.explode(F.array(*[F.lit(r) for r in sorted(set(roots))])).alias("node_id"))
    out = None
    for depth in range(1, max_depth + 1):
        level = cut(level.join(links, level["node_id"] == links["src"]).select(F.col("dst").alias("node_id")).distinct())
        own = level.select("node_id", F.lit(depth).alias("depth"))
        out = own if out is None else out.unionByName(own)
        if level.isEmpty():
            break
    return out


def blast_radius(links: DataFrame, root: str, max_depth: int = 50, small: int = SMALL) -> DataFrame:
    """(node_id, depth, is_dataset) of all that depends on root, by depth and id."""
    return reach(links, [root], max_depth, small).drop("root").orderBy("depth", "node_id")


def root_causes(links: DataFrame, root: str, max_depth: int = 50, small: int = SMALL) -> DataFrame:
    """(node_id, depth, is_dataset) of all that root depends on, by depth and id."""
    return blast_radius(reversed_links(links), root, max_depth, small)


def impact(links: DataFrame, roots: list[str] | DataFrame, max_depth: int = 10, small: int = SMALL) -> DataFrame:
    """(node_id, depth, is_dataset) over several roots: the least depth from any of them; a root may be met from another."""
    return reach(links, roots, max_depth, small).groupBy("node_id", "is_dataset").agg(F.min("depth").alias("depth")).select("node_id", "depth", "is_dataset")


impact_of_many = impact


def layers(reached: DataFrame) -> DataFrame:
    """(depth, n_nodes, n_datasets) of a reach."""
    return reached.groupBy("depth").agg(F.count("*").alias("n_nodes"), F.count_if("is_dataset").alias("n_datasets"))


def _peeled_small(found: pa.Table) -> bool:
    names = pa.chunked_array([*found["src"].chunks, *found["dst"].chunks]).combine_chunks().dictionary_encode()
    src, dst = names.indices.to_numpy()[: len(found)], names.indices.to_numpy()[len(found) :]
    while len(src):
        stay = np.isin(src, dst) & np.isin(dst, src)
        if stay.all():
            return True
        src, dst = src[stay], dst[stay]
    return False


def has_cycle(links: DataFrame, small: int = SMALL) -> bool:
    """True if edges remain after those that nothing leads to were peeled off again and again.

    A graph of at most `small` edges, by a count of all, is peeled in the driver.
    """
    return have_cycles(links.select("src", "dst", F.lit(1).alias("mask")), 1, small)[0]


def have_cycles(links: DataFrame, graphs: int, small: int = SMALL) -> list[bool]:
    """links (src, dst, mask; bit i: in graph i) -> for each of so many graphs whether it has a cycle; all are peeled together."""
    links = cut(links.where("src IS NOT NULL AND dst IS NOT NULL").groupBy("src", "dst").agg(F.bit_or("mask").alias("mask")))
    if links.count() <= small:
        return [_peeled_small(links.where(F.col("mask").bitwiseAND(1 << i) != 0).select("src", "dst").toArrow()) for i in range(graphs)]
    left = structure.peel(links, graphs)[2]
    return [not left.where(f"need_{i} > 0").isEmpty() for i in range(graphs)]
