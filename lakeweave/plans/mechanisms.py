"""Queries over the library's larger mechanisms: allocation over a large matrix, a merged table, text search by an index."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.operators import allocation, textsearch
from lakeweave.operators.cut import cut, shared_folder
from lakeweave.operators.merge import latest
from lakeweave.plans import catalogue
from lakeweave.sources import metadata as M
from lakeweave.sources import sink
from lakeweave.sources.tables import table

#: Cents up to which nothing is passed on, rounds, and tenths of an amount that are passed on.
LEAST, ROUNDS, PASSED = 100, 6, 7
NEW = 1_000_000_000


def allocate_suppliers_and_parts(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' balances go round: seven tenths to the parts they ship, by price, and from parts back to suppliers, by quantity."""
    # Nodes are numbers until the end: twice a supplier's key, twice a part's key and 1.
    lines = table(spark, d, "lineitem").select((F.col("l_suppkey") * 2).alias("s"), (F.col("l_partkey") * 2 + 1).alias("p"), F.round("l_extendedprice").cast("long").alias("price"), F.round("l_quantity").cast("long").alias("quantity"))
    pairs = cut(lines.groupBy("s", "p").agg(F.sum("price").alias("price"), F.sum("quantity").alias("quantity")))
    shares = None
    for a, b, weight in (("s", "p", "price"), ("p", "s", "quantity")):
        totals = pairs.groupBy(a).agg((10 * F.sum(weight)).alias("total"))
        own = pairs.join(totals, a).select(F.col(a).alias("source"), F.col(b).alias("target"), (PASSED * F.col(weight)).alias("weight"), "total")
        shares = own if shares is None else shares.unionByName(own)
    pools = table(spark, d, "supplier").where("s_acctbal > 0").select((F.col("s_suppkey") * 2).alias("node"), F.round(F.col("s_acctbal") * 100).cast("long").alias("amount"))
    found = allocation.allocate(pools, shares, LEAST, ROUNDS, part=1_000)
    return found.select("round_no", F.expr("concat(IF(node & 1 = 0, 's', 'p'), shiftright(node, 1))").alias("node"), "amount")


def sink_merge_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a table by year; changes that move, replace, add and delete rows are merged twice over, and the table is read."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.round("o_totalprice").cast("long").alias("price"), "o_orderdate", F.year("o_orderdate").alias("year"))
    orders = latest(orders, ["o_orderkey"], [F.col("o_orderdate").desc(), F.col("price").desc()]).drop("rn")
    folder = f"{shared_folder(spark)}/merged-{uuid.uuid4().hex}"
    sink.create(orders, folder, "year")
    late = orders.where("year >= 1996")
    changes = late.where("o_orderkey % 10 = 0").withColumns({"price": F.col("price") * 2, "year": F.expr("IF(o_orderkey % 20 = 0, year - 1, year)")})
    changes = changes.unionByName(late.where("o_orderkey % 25 = 0").withColumn("o_orderkey", F.col("o_orderkey") + NEW))
    gone = orders.where("year >= 1996 AND o_orderkey % 33 = 1").select("o_orderkey")
    for _ in range(2):
        sink.merge_into(spark, folder, orders.schema, changes, ["o_orderkey"], "year", gone=gone)
    return sink.read(spark, folder, orders.schema)


def search_task_sources(spark: SparkSession, d: str) -> DataFrame:
    """Which tasks' sources name which of the tables that tasks write or read."""
    tasks = M.tasks(spark, d)
    needles = tasks.select(F.concat(F.lit("Mart.T"), F.regexp_extract("task_id", "([0-9]+)$", 1)).alias("needle")).unionByName(M.dependencies(spark, d).where("depends_on_table IS NOT NULL").select(F.col("depends_on_table").alias("needle")))
    postings = textsearch.index(tasks, "task_id", "source_code")
    return textsearch.search(tasks, postings, needles, "task_id", "source_code").withColumnRenamed("id", "task_id")


def search_part_names(spark: SparkSession, d: str) -> DataFrame:
    """How many parts have in their names each word that stands last in another part's name, and each ending of two letters."""
    parts = table(spark, d, "part").select("p_partkey", "p_name")
    needles = parts.select(F.explode(F.expr("array(element_at(split(p_name, ' '), -1), right(p_name, 2))")).alias("needle"))
    found = textsearch.search(parts, textsearch.index(parts, "p_partkey", "p_name"), needles, "p_partkey", "p_name")
    return found.groupBy("needle").agg(F.count("*").alias("n"), F.min("id").alias("least"))


QUERIES = {f.__name__: f for f in (allocate_suppliers_and_parts, sink_merge_orders, search_task_sources, search_part_names)}


def _rounds_sql() -> str:
    rounds = [f"r{k} AS (SELECT target AS node, CAST(sum(amount * weight // total) AS BIGINT) AS amount FROM r{k - 1} JOIN shares ON source = node WHERE amount > {LEAST} GROUP BY target HAVING sum(amount * weight // total) > 0)" for k in range(1, ROUNDS + 1)]
    return f"""WITH b AS (SELECT 's' || l_suppkey AS s, 'p' || l_partkey AS p, CAST(round(l_extendedprice) AS BIGINT) AS price, CAST(round(l_quantity) AS BIGINT) AS quantity FROM lineitem),
pairs AS (SELECT source, target, CAST(sum(weight) AS BIGINT) AS weight FROM (SELECT s AS source, p AS target, price AS weight FROM b UNION ALL SELECT p, s, quantity FROM b) GROUP BY 1, 2),
shares AS (SELECT source, target, {PASSED} * weight AS weight, CAST(10 * sum(weight) OVER (PARTITION BY source) AS BIGINT) AS total FROM pairs),
r0 AS (SELECT 's' || s_suppkey AS node, CAST(round(s_acctbal * 100) AS BIGINT) AS amount FROM supplier WHERE s_acctbal > 0),
{", ".join(rounds)} {" UNION ALL ".join(f"SELECT {k} AS round_no, node, amount FROM r{k}" for k in range(1, ROUNDS + 1))}"""


SQL = {
    "allocate_suppliers_and_parts": _rounds_sql(),
    "sink_merge_orders": f"""WITH o AS (SELECT o_orderkey, o_custkey, CAST(round(o_totalprice) AS BIGINT) AS price, o_orderdate, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY o_orderdate DESC, o_totalprice DESC) = 1)
SELECT o_orderkey, o_custkey, CASE WHEN year >= 1996 AND o_orderkey % 10 = 0 THEN 2 * price ELSE price END AS price, o_orderdate, CASE WHEN year >= 1996 AND o_orderkey % 20 = 0 THEN year - 1 ELSE year END AS year FROM o WHERE NOT (year >= 1996 AND o_orderkey % 33 = 1)
UNION ALL SELECT o_orderkey + {NEW}, o_custkey, price, o_orderdate, year FROM o WHERE year >= 1996 AND o_orderkey % 25 = 0""",
    "search_task_sources": f"""{catalogue._WITH}, n AS (SELECT 'Mart.T' || s_suppkey AS needle FROM supplier UNION SELECT depends_on_table FROM dep WHERE depends_on_table IS NOT NULL) SELECT needle, task_id FROM n JOIN task ON contains(lower(source_code), lower(needle))""",
    "search_part_names": """WITH n AS (SELECT string_split(p_name, ' ')[-1] AS needle FROM part UNION SELECT right(p_name, 2) FROM part) SELECT needle, count(*) AS n, min(p_partkey) AS least FROM n JOIN part ON contains(lower(p_name), lower(needle)) WHERE needle <> '' GROUP BY needle""",
}
