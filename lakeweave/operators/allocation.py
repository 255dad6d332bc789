"""Reciprocal allocation over a large sparse matrix of shares, in rounds of blocked products with an amounts vector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.operators.cut import cut, dealt, width

#: Targets of a source that are joined together; a source with more is cut into parts.
PART = 100_000


def allocate(amounts: DataFrame, shares: DataFrame, least: int = 0, max_rounds: int = 20, part: int = PART) -> DataFrame:
    """(round_no, node, amount): what each node gets in each round, from 1, in whole units.

    amounts (node, amount): what is there first; shares (source, target, weight, total): a source passes weight / total of
    each amount of over `least` on to a target, rounded down; all of these are whole numbers, none negative. Several shares
    of one pair add up after rounding. What is received in a round is passed on in the next one, until a count finds nothing
    over `least` or max_rounds have been. Rows with nulls or a total of 0 pass nothing.

    Shares are dealt out once, by source and, for sources of more than `part` targets (found by a count), by parts of these, so a hot
    source is shared out; those of a source and part are one row of arrays, and only amounts are shuffled in a round, summed before
    that. A round's amounts are written before the next one.
    """
    known = cut(shares.where("source IS NOT NULL AND target IS NOT NULL AND weight > 0 AND total > 0").select("source", "target", "weight", "total"))
    sizes = known.groupBy("source").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    large = cut(sizes.where("parts > 1"))
    cells = known.join(large, "source", "left").withColumn("part", F.expr("pmod(xxhash64(target), coalesce(parts, 1))")).drop("parts")
    cells = cells.repartition(width(shares.sparkSession), "source", "part").groupBy("source", "part", "total").agg(F.collect_list(F.struct("target", "weight")).alias("row"))
    cells = dealt(cells.select("source", "part", "total", F.col("row.target").alias("targets"), F.col("row.weight").alias("weights")))
    now, out = amounts.select("node", F.col("amount").cast("long").alias("amount")), None
    for k in range(1, max_rounds + 1):
        over = now.where(F.col("node").isNotNull() & (F.col("amount") > least)).join(large.withColumnRenamed("source", "node"), "node", "left")
        over = over.select("node", "amount", F.explode(F.expr("sequence(0L, coalesce(parts, 1) - 1L)")).alias("part"))
        moved = over.hint("shuffle_hash").join(cells, (over["node"] == cells["source"]) & (over["part"] == cells["part"]))
        moved = moved.select("amount", "total", F.inline(F.arrays_zip(F.col("targets").alias("target"), F.col("weights").alias("weight"))).alias("target", "weight"))
        now = cut(moved.groupBy(F.col("target").alias("node")).agg(F.sum(F.expr("amount * weight div total")).alias("amount")).where("amount > 0"))
        if now.isEmpty():
            break
        own = now.select(F.lit(k).alias("round_no"), "node", "amount")
        out = own if out is None else out.unionByName(own)
    return out if out is not None else now.select(F.lit(0).alias("round_no"), "node", "amount")
