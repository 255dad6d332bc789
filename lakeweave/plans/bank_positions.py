"""Bank-finance statements on positions at a date: loans, their interest, deposit credit, relationships, and a report.

They join histories that hold from one date to another, with an open end: product spreads, account dimensions and plans.
Each is written twice: with the DataFrame API, and as DuckDB SQL. Accounts of loans are suppliers; an account's balance of
a day is the sum of its lines of that day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeweave.functions.columns import FOREVER, valid_on
from lakeweave.operators.cut import cut
from lakeweave.plans.bank import _rows, _values
from lakeweave.sources.tables import MONEY, table

# Spreads of products (product, index, basis points, from, to or none), indexes (index, rate in 1995, change a
# year), day-count bases, curve points (product of the curve, months, rate), report lines by class of part.
SPREADS = [(0, "LIBID", 150, "1995-01-01", "1996-12-31"), (0, "LIBID", 175, "1997-01-01", None), (1, "BASE", 200, "1995-01-01", "1998-06-30"), (1, "BASE", 225, "1998-07-01", "1999-12-31"), (2, "BASE", 125, "1996-01-01", None)]
INDEXES = [("LIBID", 0.03, 0.001), ("BASE", 0.04, -0.002)]
BASES = [(0, 365), (1, 360), (2, 360), (3, 365)]
POINTS = [(p, m, round(0.01 + 0.0005 * m + 0.001 * p, 6)) for p in range(1, 6) for m in (1, 3, 6, 12)]
REPORT = [("ECONOMY", "1.a", "Construction"), ("STANDARD", "2", "Depository institutions"), ("PROMO", "4", "Commercial"), ("SMALL", "6", "Individuals"), ("LARGE", "9", "Other")]
DAYS, OVERDUE, FOREIGN, LEVELS = 30, 90, 5, 8
QUERIES, SQL = {}, {}


def _history(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


_BALANCE = "b AS (SELECT l_suppkey AS account, CAST(l_shipdate AS DATE) AS day, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS principal, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(28,4)) AS accrued, max(CASE WHEN l_returnflag = 'R' THEN CAST(l_partkey % 120 AS INTEGER) ELSE 0 END) AS overdue FROM lineitem GROUP BY 1, 2)"
_ACCOUNT = "a AS (SELECT s_suppkey AS account, CAST(s_suppkey % 4 AS INTEGER) AS product, CAST(s_nationkey AS INTEGER) AS branch, CASE WHEN s_suppkey % 7 = 0 THEN CAST(DATE '1996-01-01' + to_months(CAST(s_suppkey % 60 AS INTEGER)) AS DATE) END AS closed, CAST(3 + s_suppkey % 10 AS INTEGER) AS every, CAST(0.05 + CAST(s_suppkey % 5 AS DOUBLE) / 100 AS DOUBLE) AS rate FROM supplier)"
_POSITION = f"""WITH {_BALANCE}, {_ACCOUNT}, h AS (SELECT *, sum(principal) OVER w AS s30, count(*) OVER w AS n30 FROM b WINDOW w AS (PARTITION BY account ORDER BY day ROWS BETWEEN {DAYS - 1} PRECEDING AND CURRENT ROW)),
p AS (SELECT day, h.account, product, branch, principal, CAST(s30 AS DOUBLE) / n30 AS average, accrued, overdue, CASE WHEN overdue >= {OVERDUE} THEN 'NONACCRUAL' ELSE 'ACCRUING' END AS status, CAST(day + to_months(every) AS DATE) AS reprice, rate FROM h JOIN a ON a.account = h.account WHERE closed IS NULL OR closed > day)"""


def _add(sql: str):
    def keep(f):
        QUERIES[f"bank_{f.__name__}"], SQL[f"bank_{f.__name__}"] = f, sql
        return f

    return keep


def positions(spark: SparkSession, d: str) -> DataFrame:
    """(day, account, product, branch, principal, average, accrued, overdue, status, reprice, rate) of accounts open on the day."""
    price = F.col("l_extendedprice").cast(MONEY)
    late = F.when(F.col("l_returnflag") == "R", (F.col("l_partkey") % 120).cast("int")).otherwise(0)
    b = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("account"), F.col("l_shipdate").cast("date").alias("day"))
    b = b.agg(F.sum(price).cast("decimal(28,2)").alias("principal"), F.sum(price * F.col("l_discount").cast("decimal(4,2)")).cast("decimal(28,4)").alias("accrued"), F.max(late).alias("overdue"))
    s = F.col("s_suppkey")
    a = table(spark, d, "supplier").select(
        s.alias("owner"), (s % 4).cast("int").alias("product"), F.col("s_nationkey").cast("int").alias("branch"), F.when(s % 7 == 0, F.add_months(F.lit("1996-01-01").cast("date"), (s % 60).cast("int"))).alias("closed"),
        (3 + s % 10).cast("int").alias("every"), (0.05 + (s % 5).cast("double") / 100).alias("rate"),
    )
    by = Window.partitionBy("account").orderBy("day").rowsBetween(-(DAYS - 1), 0)
    h = b.withColumn("average", F.sum("principal").over(by).cast("double") / F.count("*").over(by)).join(a, F.col("account") == F.col("owner"))
    h = h.where(F.col("closed").isNull() | (F.col("closed") > F.col("day")))
    status = F.when(F.col("overdue") >= OVERDUE, "NONACCRUAL").otherwise("ACCRUING")
    return h.select("day", "account", "product", "branch", "principal", "average", "accrued", "overdue", status.alias("status"), F.add_months("day", F.col("every")).alias("reprice"), "rate")


@_add(f"{_POSITION} SELECT day AS as_of_date, account AS account_sk, product AS product_sk, branch AS branch_sk, CAST(principal AS DOUBLE) AS outstanding_principal, average AS average_daily_balance, CAST(accrued AS DOUBLE) AS accrued_interest, overdue AS days_past_due, status AS accrual_status, reprice AS next_reprice_date, rate AS contractual_rate FROM p")
def loan_position(spark: SparkSession, d: str) -> DataFrame:
    """Each open loan's position on each day: its mean over 30 rows, days past due, status and next repricing."""
    x = lambda c, to: F.col(c).cast("double").alias(to)
    return positions(spark, d).select(
        F.col("day").alias("as_of_date"), F.col("account").alias("account_sk"), F.col("product").alias("product_sk"), F.col("branch").alias("branch_sk"), x("principal", "outstanding_principal"), x("average", "average_daily_balance"), x("accrued", "accrued_interest"),
        F.col("overdue").alias("days_past_due"), F.col("status").alias("accrual_status"), F.col("reprice").alias("next_reprice_date"), F.col("rate").alias("contractual_rate"),
    )


@_add(f"{_POSITION} SELECT day AS as_of_date, branch AS branch_sk, count(*) AS n_accounts, CAST(sum(principal) AS DOUBLE) AS outstanding_principal, count(*) FILTER (WHERE status = 'NONACCRUAL') AS n_nonaccrual FROM p WHERE day = CAST(date_trunc('month', day) + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) GROUP BY 1, 2")
def month_end_position(spark: SparkSession, d: str) -> DataFrame:
    """The positions of the last days of months, by branch."""
    p = positions(spark, d).where(F.col("day") == F.last_day("day"))
    return p.groupBy(F.col("day").alias("as_of_date"), F.col("branch").alias("branch_sk")).agg(F.count("*").alias("n_accounts"), F.sum("principal").cast("double").alias("outstanding_principal"), F.count_if(F.col("status") == "NONACCRUAL").alias("n_nonaccrual"))


@_add(f"""{_POSITION}, s(product, index_code, bps, start, until) AS (VALUES {_history(SPREADS)}), i(index_code, opened, change) AS (VALUES {_values(INDEXES)}), c(product, basis) AS (VALUES {_values(BASES)}),
k AS (SELECT *, lag(status) OVER (PARTITION BY account ORDER BY day) AS before FROM p),
e AS (SELECT k.*, basis, coalesce(opened + change * (year(day) - 1995) + bps / 10000.0::DOUBLE, rate) AS effective FROM k JOIN c USING (product) LEFT JOIN s ON s.product = k.product AND day BETWEEN CAST(start AS DATE) AND coalesce(CAST(until AS DATE), DATE '{FOREVER}') LEFT JOIN i ON i.index_code = s.index_code)
SELECT day AS as_of_date, account AS account_sk, product AS product_sk, CASE WHEN status = 'ACCRUING' THEN average ELSE 0 END AS accruable_balance, effective AS effective_rate, CASE WHEN status = 'ACCRUING' THEN average * effective / basis ELSE 0 END AS interest_income,
CAST(CASE WHEN status = 'NONACCRUAL' AND before = 'ACCRUING' THEN accrued ELSE 0 END AS DOUBLE) AS reversal_amount FROM e""")
def loan_income(spark: SparkSession, d: str) -> DataFrame:
    """Interest at the index and the spread valid on the day, or else at the contract's rate; none while not accruing, and a
    reversal when that begins."""
    s = _rows(spark, SPREADS, "of int, index_code string, bps int, start string, until string").withColumns({"start": F.col("start").cast("date"), "until": F.col("until").cast("date")})
    p = positions(spark, d).withColumn("before", F.lag("status").over(Window.partitionBy("account").orderBy("day")))
    p = p.join(_rows(spark, BASES, "product int, basis int"), "product").join(F.broadcast(s), (F.col("product") == F.col("of")) & valid_on(F.col("day"), "start", "until"), "left")
    p = p.join(_rows(spark, INDEXES, "index_code string, opened double, change double"), "index_code", "left")
    index = F.col("opened") + F.col("change") * (F.year("day") - 1995) + F.col("bps") / F.lit(10000.0)
    p = p.withColumn("effective", F.coalesce(index, F.col("rate")))
    accruing = F.col("status") == "ACCRUING"
    return p.select(
        F.col("day").alias("as_of_date"), F.col("account").alias("account_sk"), F.col("product").alias("product_sk"), F.when(accruing, F.col("average")).otherwise(0.0).alias("accruable_balance"), F.col("effective").alias("effective_rate"),
        F.when(accruing, F.col("average") * F.col("effective") / F.col("basis")).otherwise(0.0).alias("interest_income"), F.when(~accruing & (F.col("before") == "ACCRUING"), F.col("accrued")).otherwise(0).cast("double").alias("reversal_amount"),
    )


_FUND = "f AS (SELECT CAST(o_orderdate AS DATE) AS day, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_custkey AS account, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS product, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS balance FROM orders GROUP BY ALL)"


def _funds(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").selectExpr("CAST(o_orderdate AS DATE) AS day", "trunc(CAST(o_orderdate AS DATE), 'month') AS month", "o_custkey AS account", "CAST(substr(o_orderpriority, 1, 1) AS INT) AS product", f"CAST(o_totalprice AS {MONEY}) AS x")
    return o.groupBy("day", "month", "account", "product").agg(F.sum("x").cast("decimal(28,2)").alias("balance"))


@_add(f"""WITH {_FUND}, life AS (SELECT product, month, 6 AS months FROM (SELECT DISTINCT product, month FROM f) WHERE product % 2 = 1 AND month(month) % 3 = 0), c(curve, months, rate) AS (VALUES {_values(POINTS)}), t AS (SELECT f.*, coalesce(months, CASE f.product WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 6 WHEN 4 THEN 12 ELSE 24 END) AS tenor FROM f LEFT JOIN life ON life.product = f.product AND life.month = f.month)
SELECT day AS as_of_date, account AS account_sk, 'DEPOSIT' AS instrument_type, CAST(tenor AS INTEGER) AS assigned_tenor_months, rate AS ftp_rate, CAST(balance AS DOUBLE) * rate / 365 AS ftp_amount, curve AS curve_id FROM t JOIN c ON c.curve = t.product AND c.months = t.tenor""")
def funds_credit(spark: SparkSession, d: str) -> DataFrame:
    """Deposits are credited at the curve's point of their behavioural life, or else of their contract's term; a term without
    a point gets none."""
    f = _funds(spark, d)
    life = f.where("product % 2 = 1 AND month(month) % 3 = 0").select("product", "month").distinct().withColumn("months", F.lit(6))
    term = F.when(F.col("product") == 1, 1).when(F.col("product") == 2, 3).when(F.col("product") == 3, 6).when(F.col("product") == 4, 12).otherwise(24)
    t = f.join(life, ["product", "month"], "left").withColumn("tenor", F.coalesce("months", term)).drop("months")
    t = t.join(_rows(spark, POINTS, "curve int, point int, rate double"), (F.col("curve") == F.col("product")) & (F.col("point") == F.col("tenor")))
    return t.select(F.col("day").alias("as_of_date"), F.col("account").alias("account_sk"), F.lit("DEPOSIT").alias("instrument_type"), F.col("tenor").alias("assigned_tenor_months"), F.col("rate").alias("ftp_rate"), (F.col("balance").cast("double") * F.col("rate") / 365).alias("ftp_amount"), F.col("curve").alias("curve_id"))


@_add(f"""WITH {_FUND}, h AS (SELECT c_custkey AS account, c_custkey - c_custkey % 100 AS parent FROM customer WHERE c_custkey % 10 = 3), t AS (SELECT c_custkey AS account, coalesce(parent, c_custkey) AS parent, c_mktsegment AS segment FROM customer LEFT JOIN h ON h.account = c_custkey)
SELECT month AS as_of_month, parent AS ultimate_parent_id, segment AS segment_code, count(DISTINCT f.account) AS account_count, CAST(sum(balance) AS DOUBLE) AS total_balance, CAST(sum(balance * product) AS DOUBLE) / 100 / nullif(CAST(sum(balance) AS DOUBLE), 0) AS weighted_avg_rate,
CAST(sum(CASE WHEN product <= 2 THEN balance ELSE 0 END) AS DOUBLE) AS demand_balance, CAST(sum(CASE WHEN product = 3 THEN balance ELSE 0 END) AS DOUBLE) AS term_balance FROM f JOIN t ON t.account = f.account GROUP BY 1, 2, 3""")
def relationship(spark: SparkSession, d: str) -> DataFrame:
    """Balances of a group of customers under its parent, or of a customer without one, with demand and term parts."""
    h = table(spark, d, "customer").where("c_custkey % 10 = 3").selectExpr("c_custkey AS child", "c_custkey - c_custkey % 100 AS parent")
    t = table(spark, d, "customer").join(h, F.col("c_custkey") == F.col("child"), "left").select(F.col("c_custkey").alias("account"), F.coalesce("parent", "c_custkey").alias("ultimate_parent_id"), F.col("c_mktsegment").alias("segment_code"))
    part = lambda c: F.sum(F.when(c, F.col("balance")).otherwise(0)).cast("double")
    weighted = F.sum(F.col("balance") * F.col("product")).cast("double") / 100 / F.nullif(F.sum("balance").cast("double"), F.lit(0.0))
    return _funds(spark, d).join(t, "account").groupBy(F.col("month").alias("as_of_month"), "ultimate_parent_id", "segment_code").agg(
        F.countDistinct("account").alias("account_count"), F.sum("balance").cast("double").alias("total_balance"), weighted.alias("weighted_avg_rate"), part(F.col("product") <= 2).alias("demand_balance"), part(F.col("product") == 3).alias("term_balance"),
    )


@_add(f"""WITH m(class, line_item, line_description) AS (VALUES {_values(REPORT)}), l AS (SELECT CAST(l_shipdate AS DATE) AS day, l_orderkey AS loan, CAST(l_extendedprice AS DECIMAL(18,2)) AS principal, split_part(p_type, ' ', 1) AS class, s_nationkey < {FOREIGN} AS domestic FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE date_trunc('month', l_shipdate) = (SELECT date_trunc('month', max(l_shipdate)) FROM lineitem))
SELECT line_item, line_description, CAST(sum(CASE WHEN domestic THEN principal ELSE 0 END) AS DOUBLE) AS domestic_amount, CAST(sum(CASE WHEN NOT domestic THEN principal ELSE 0 END) AS DOUBLE) AS foreign_amount, CAST(sum(principal) AS DOUBLE) AS total_amount, count(DISTINCT loan) AS loan_count FROM l JOIN m USING (class) GROUP BY 1, 2""")
def call_report(spark: SparkSession, d: str) -> DataFrame:
    """The last month's loans by line of the report, domestic and foreign."""
    l = table(spark, d, "lineitem")  # noqa: E741
    last = F.broadcast(l.agg(F.date_trunc("month", F.max("l_shipdate")).alias("last")))  # one row
    l = l.crossJoin(last).where(F.date_trunc("month", "l_shipdate") == F.col("last"))  # noqa: E741
    l = l.join(table(spark, d, "part").select("p_partkey", F.split_part("p_type", F.lit(" "), F.lit(1)).alias("class")), F.col("l_partkey") == F.col("p_partkey"))  # noqa: E741
    l = l.join(table(spark, d, "supplier").select("s_suppkey", (F.col("s_nationkey") < FOREIGN).alias("domestic")), F.col("l_suppkey") == F.col("s_suppkey"))  # noqa: E741
    l = l.join(_rows(spark, REPORT, "class string, line_item string, line_description string"), "class").withColumn("principal", F.col("l_extendedprice").cast(MONEY))  # noqa: E741
    part = lambda c: F.sum(F.when(c, F.col("principal")).otherwise(0)).cast("double")
    return l.groupBy("line_item", "line_description").agg(part(F.col("domestic")).alias("domestic_amount"), part(~F.col("domestic")).alias("foreign_amount"), F.sum("principal").cast("double").alias("total_amount"), F.countDistinct("l_orderkey").alias("loan_count"))


@_add("""WITH RECURSIVE node AS (SELECT 'r' || r_regionkey AS id, NULL::VARCHAR AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
tree AS (SELECT id, id AS root, 0 AS level FROM node WHERE parent IS NULL UNION ALL SELECT n.id, tree.root, tree.level + 1 FROM tree JOIN node n ON n.parent = tree.id WHERE tree.level + 1 < 8),
direct AS (SELECT 's' || l_suppkey AS id, sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2))) AS revenue FROM lineitem GROUP BY 1),
x AS (SELECT tree.*, revenue FROM tree LEFT JOIN direct USING (id))
SELECT a.id AS node_id, a.root AS root_id, CAST(a.level AS INTEGER) AS node_level, CAST(max(a.revenue) AS DOUBLE) AS direct_revenue, CAST(coalesce(sum(b.revenue), 0) AS DOUBLE) AS rolled_revenue FROM x a JOIN x b ON b.root = a.root AND b.level >= a.level GROUP BY 1, 2, 3""")
def segment_rollup(spark: SparkSession, d: str) -> DataFrame:
    """A walk down the organisation, eight levels at most; each node rolls up all of its root's nodes from its level down.

    Nodes pair with sums by root and level, not with each other, so that a wide level does not multiply.
    """
    node = lambda name, mark, key, up, parent: table(spark, d, name).select(F.concat(F.lit(mark), F.col(key).cast("string")).alias("id"), (F.concat(F.lit(up), F.col(parent).cast("string")) if parent else F.lit(None).cast("string")).alias("parent"))
    nodes = node("region", "r", "r_regionkey", "", "").unionByName(node("nation", "n", "n_nationkey", "r", "n_regionkey")).unionByName(node("supplier", "s", "s_suppkey", "n", "s_nationkey"))
    frontier = nodes.where("parent IS NULL").select("id", F.col("id").alias("root"), F.lit(0).alias("level"))
    tree = frontier
    for level in range(1, LEVELS):
        frontier = cut(nodes.join(frontier.select(F.col("id").alias("parent"), "root"), "parent").select("id", "root", F.lit(level).alias("level")))
        if frontier.isEmpty():
            break
        tree = tree.unionByName(frontier)
    direct = table(spark, d, "lineitem").groupBy(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("id")).agg(F.sum(F.col("l_extendedprice").cast(MONEY) * F.col("l_discount").cast("decimal(4,2)")).alias("revenue"))
    x = tree.join(direct, "id", "left")
    held = x.groupBy("root", "level").agg(F.sum("revenue").alias("held"))  # levels by roots
    below = held.alias("a").join(held.alias("b"), (F.col("a.root") == F.col("b.root")) & (F.col("b.level") >= F.col("a.level"))).groupBy("a.root", "a.level").agg(F.sum("b.held").alias("rolled"))
    return x.join(F.broadcast(below), ["root", "level"]).select(F.col("id").alias("node_id"), F.col("root").alias("root_id"), F.col("level").alias("node_level"), F.col("revenue").cast("double").alias("direct_revenue"), F.coalesce("rolled", F.lit(0)).cast("double").alias("rolled_revenue"))
