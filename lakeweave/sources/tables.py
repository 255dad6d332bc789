"""Reading the input tables, and the views derived from them that the library's queries work on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Domain:
    """A business domain: where its fact and dimension rows come from, in Spark and as text of DuckDB CTEs."""

    name: str
    source: str
    fact_columns: dict[str, str]
    dim: str
    steps: tuple[str, str, str]
    gap_seconds: int

    def fact(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """(id, actor, amount, ts, status, category)"""
        return table(spark, sf_dir, self.source).selectExpr(*[f"{e} AS {c}" for c, e in self.fact_columns.items()])

    def actors(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """(actor, actor_name, region)"""
        nation = table(spark, sf_dir, "nation")
        if self.dim == "customer":
            return table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).selectExpr("c_custkey AS actor", "c_name AS actor_name", "n_name AS region")
        if self.dim == "supplier":
            return table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).selectExpr("s_suppkey AS actor", "s_name AS actor_name", "n_name AS region")
        return table(spark, sf_dir, "events").select(F.col("user_id").alias("actor")).distinct().selectExpr("actor", "concat('User#', actor) AS actor_name", "concat('NATION_', actor % 25) AS region")

    def sql(self) -> str:
        """DuckDB CTEs fact, actors and anchor."""
        dims = {
            "customer": "SELECT c_custkey AS actor, c_name AS actor_name, n_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey",
            "supplier": "SELECT s_suppkey AS actor, s_name AS actor_name, n_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey",
            "user": "SELECT DISTINCT user_id AS actor, 'User#' || user_id AS actor_name, 'NATION_' || (user_id % 25) AS region FROM events",
        }
        columns = ", ".join(f"{e} AS {c}" for c, e in self.fact_columns.items())
        return f"WITH RECURSIVE fact AS (SELECT {columns} FROM {self.source}), actors AS ({dims[self.dim]}), anchor AS (SELECT max(ts) AS now FROM fact)"


DOMAINS = {
    d.name: d
    for d in (
        Domain("orders", "orders", {"id": "o_orderkey", "actor": "o_custkey", "amount": f"CAST(o_totalprice AS {MONEY})", "ts": "o_orderdate", "status": "o_orderstatus", "category": "o_orderpriority"}, "customer", ("O", "P", "F"), 30 * 86400),
        Domain("shipments", "lineitem", {"id": "l_orderkey * 10 + l_linenumber", "actor": "l_suppkey", "amount": f"CAST(l_extendedprice AS {MONEY})", "ts": "l_shipdate", "status": "l_returnflag", "category": "l_linestatus"}, "supplier", ("N", "A", "R"), 7 * 86400),
        Domain("events", "events", {"id": "event_id", "actor": "user_id", "amount": f"CAST(value AS {MONEY})", "ts": "ts", "status": "event_type", "category": "event_type"}, "user", ("view", "click", "purchase"), 1800),
        Domain("marketing", "orders", {"id": "o_orderkey", "actor": "o_custkey", "amount": f"CAST(o_totalprice AS {MONEY})", "ts": "o_orderdate", "status": "o_orderpriority", "category": "o_orderstatus"}, "customer", ("1-URGENT", "2-HIGH", "3-MEDIUM"), 14 * 86400),
        Domain("ledger", "lineitem", {"id": "l_orderkey * 10 + l_linenumber", "actor": "l_suppkey", "amount": f"CAST(l_extendedprice AS {MONEY})", "ts": "l_shipdate", "status": "l_linestatus", "category": "l_returnflag"}, "supplier", ("O", "F", "P"), 3 * 86400),
        Domain("payroll", "lineitem", {"id": "l_orderkey * 10 + l_linenumber", "actor": "l_suppkey", "amount": f"CAST(l_quantity AS {MONEY})", "ts": "l_shipdate", "status": "l_returnflag", "category": "CAST(l_linenumber AS STRING)"}, "supplier", ("R", "A", "N"), 5 * 86400),
        Domain("tickets", "events", {"id": "event_id", "actor": "user_id", "amount": f"CAST(value AS {MONEY})", "ts": "ts", "status": "event_type", "category": "CAST(user_id % 4 AS STRING)"}, "user", ("signup", "error", "click"), 3600),
        Domain("sensors", "events", {"id": "event_id", "actor": "user_id", "amount": f"CAST(value AS {MONEY})", "ts": "ts", "status": "CASE WHEN value > 10 THEN 'HOT' ELSE 'OK' END", "category": "event_type"}, "user", ("OK", "HOT", "OFF"), 7200),
    )
}
