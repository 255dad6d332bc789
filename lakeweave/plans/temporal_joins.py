"""Queries along time over large tables: as-of and nearest joins, intervals, sessions of hot actors, distinct counts by bitmaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.operators import bitmaps, temporal
from lakeweave.sources.tables import DOMAINS, table

DAY = 86_400_000_000


def _purchases(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, d, "events")
    left = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts", "value")
    right = events.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("clicked"))
    return left, right


def asof_click_of_purchase(spark: SparkSession, d: str) -> DataFrame:
    """Each purchase with its user's last click at or before it."""
    left, right = _purchases(spark, d)
    return temporal.as_of(left, right, ["user_id"], ("ts", "clicked"), 2 * DAY, ["click_id", "clicked"], tie="click_id")


def asof_next_click(spark: SparkSession, d: str) -> DataFrame:
    """Each purchase with its user's first click at or after it."""
    left, right = _purchases(spark, d)
    return temporal.as_of(left, right, ["user_id"], ("ts", "clicked"), 2 * DAY, ["click_id", "clicked"], "forward", "click_id")


def _by_nation(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation")), "o_custkey")
    lines = table(spark, d, "lineitem").join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation")), "l_suppkey")
    lines = lines.where("l_returnflag = 'R' AND l_linenumber = 1").select("nation", F.col("l_shipdate").alias("shipped"), F.col("l_orderkey").alias("line_order"))
    return orders.select("o_orderkey", "nation", "o_orderdate"), lines


def nearest_shipment_of_nation(spark: SparkSession, d: str) -> DataFrame:
    """Each order with the shipment from its customer's nation that is nearest in time, the earlier of two: 25 keys, all of them hot."""
    orders, lines = _by_nation(spark, d)
    return temporal.as_of(orders, lines, ["nation"], ("o_orderdate", "shipped"), 30 * DAY, ["line_order", "shipped"], "nearest", "line_order")


def band_open_orders(spark: SparkSession, d: str) -> DataFrame:
    """For each day on which something is shipped, the orders that are placed by then and not yet shipped whole.

    Orders with the same two ends are added up before they meet the days, so there are pairs of a day and two ends, however many orders.
    """
    lines = table(spark, d, "lineitem")
    ends = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("ended"))
    spans = table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.round("o_totalprice").cast("long").alias("price")).join(ends, "o_orderkey")
    spans = spans.groupBy("o_orderdate", "ended").agg(F.count("*").alias("n"), F.sum("price").alias("price"))
    days = lines.select(F.col("l_shipdate").alias("day")).distinct()
    return temporal.band_join(days, spans, "day", "o_orderdate", "ended").groupBy("day").agg(F.sum("n").alias("n_open"), F.sum("price").alias("price"))


def band_purchases_after_click(spark: SparkSession, d: str) -> DataFrame:
    """For each click how many purchases its user makes within the hours that the click's value names."""
    left, right = _purchases(spark, d)
    spans = table(spark, d, "events").where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("low"), F.expr("timestampadd(HOUR, CAST(1 + floor(abs(value)) AS INT), ts)").alias("high"))
    return temporal.band_join(left, spans, "ts", "low", "high", ["user_id"]).groupBy("click_id").agg(F.count("*").alias("n"), F.min("event_id").alias("least_event"))


def _split(domain: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        dom = DOMAINS[domain]
        return temporal.sessions(dom.fact(spark, d), "actor", "ts", dom.gap_seconds, 20 * dom.gap_seconds)

    return run


def sessions_split_hot_actor(spark: SparkSession, d: str) -> DataFrame:
    """Sessions with two minutes' gap where one actor has a third of all events."""
    events = table(spark, d, "events").withColumn("actor", F.expr("IF(user_id % 3 = 0, 0, user_id)"))
    return temporal.sessions(events, "actor", "ts", 120, 6 * 3600)


def distinct_users_by_grain(spark: SparkSession, d: str) -> DataFrame:
    """Exact numbers of users by day, week and month and kind of event, all from one bitmap a day and kind."""
    daily = bitmaps.daily(table(spark, d, "events").withColumn("day", F.to_date("ts")), ["event_type", "day"], "user_id")
    out = None
    for grain in ("day", "week", "month"):
        at = F.col("day") if grain == "day" else F.to_date(F.date_trunc(grain, "day"))
        one = bitmaps.counted(bitmaps.merged(daily.withColumn("start", at), ["event_type", "start"]), ["event_type", "start"]).withColumn("grain", F.lit(grain))
        out = one if out is None else out.unionByName(one)
    return out.select("grain", "start", "event_type", F.col("n").alias("n_users"))


QUERIES = {f.__name__: f for f in (asof_click_of_purchase, asof_next_click, nearest_shipment_of_nation, band_open_orders, band_purchases_after_click, sessions_split_hot_actor, distinct_users_by_grain)}
QUERIES |= {f"sessions_split_{n}": _split(n) for n in ("events", "shipments", "orders")}

_P = "WITH l AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts AS clicked, max(event_id) AS click_id FROM events WHERE event_type = 'click' GROUP BY 1, 2)"
_HOT = """WITH f AS (SELECT CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END AS actor, ts FROM events),
g AS (SELECT actor, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY actor ORDER BY ts) <= INTERVAL 120 SECOND THEN 0 ELSE 1 END AS is_new FROM f),
s AS (SELECT actor, ts, CAST(sum(is_new) OVER (PARTITION BY actor ORDER BY ts) AS BIGINT) AS session FROM g) SELECT actor, session, count(*) AS n, min(ts) AS started, max(ts) AS ended FROM s GROUP BY 1, 2"""


def _sessions_sql(name: str) -> str:
    dom = DOMAINS[name]
    return f"""{dom.sql()}, g AS (SELECT actor, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY actor ORDER BY ts) <= INTERVAL {dom.gap_seconds} SECOND THEN 0 ELSE 1 END AS is_new FROM fact),
s AS (SELECT actor, ts, CAST(sum(is_new) OVER (PARTITION BY actor ORDER BY ts) AS BIGINT) AS session FROM g) SELECT actor, session, count(*) AS n, min(ts) AS started, max(ts) AS ended FROM s GROUP BY 1, 2"""


SQL = {
    "asof_click_of_purchase": f"{_P} SELECT l.*, r.click_id, r.clicked FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.clicked",
    "asof_next_click": f"{_P} SELECT l.*, r.click_id, r.clicked FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts <= r.clicked",
    "nearest_shipment_of_nation": """WITH l AS (SELECT o_orderkey, c_nationkey AS nation, o_orderdate FROM orders JOIN customer ON c_custkey = o_custkey),
r AS (SELECT s_nationkey AS nation, l_shipdate AS shipped, max(l_orderkey) AS line_order FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'R' AND l_linenumber = 1 GROUP BY 1, 2),
b AS (SELECT l.*, r.line_order AS b_order, r.shipped AS b_at FROM l ASOF LEFT JOIN r ON l.nation = r.nation AND l.o_orderdate >= r.shipped),
n AS (SELECT b.*, r.line_order AS n_order, r.shipped AS n_at FROM b ASOF LEFT JOIN r ON b.nation = r.nation AND b.o_orderdate <= r.shipped)
SELECT o_orderkey, nation, o_orderdate, CASE WHEN n_at IS NULL OR o_orderdate - b_at <= n_at - o_orderdate THEN b_order ELSE n_order END AS line_order, CASE WHEN n_at IS NULL OR o_orderdate - b_at <= n_at - o_orderdate THEN b_at ELSE n_at END AS shipped FROM n""",
    "band_open_orders": """WITH e AS (SELECT l_orderkey, max(l_shipdate) AS ended FROM lineitem GROUP BY 1), d AS (SELECT DISTINCT l_shipdate AS day FROM lineitem)
SELECT day, count(*) AS n_open, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS price FROM d JOIN (orders JOIN e ON l_orderkey = o_orderkey) ON o_orderdate <= day AND day < ended GROUP BY day""",
    "band_purchases_after_click": """WITH c AS (SELECT user_id, event_id AS click_id, ts AS low, ts + to_hours(CAST(1 + floor(abs(value)) AS INTEGER)) AS high FROM events WHERE event_type = 'click')
SELECT click_id, count(*) AS n, min(event_id) AS least_event FROM c JOIN events e ON e.user_id = c.user_id AND e.event_type = 'purchase' AND e.ts >= low AND e.ts < high GROUP BY click_id""",
    "sessions_split_hot_actor": _HOT,
    "distinct_users_by_grain": " UNION ALL ".join(f"SELECT '{g}' AS grain, CAST(date_trunc('{g}', ts) AS DATE) AS start, event_type, count(DISTINCT user_id) AS n_users FROM events GROUP BY 2, 3" for g in ("day", "week", "month")),
    **{f"sessions_split_{n}": _sessions_sql(n) for n in ("events", "shipments", "orders")},
}
