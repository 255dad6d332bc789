"""Bank-finance statements over deposits, loans and cost centres derived from orders, lineitem, customer and supplier.

Each is written twice: with the DataFrame API, and as DuckDB SQL. Money is summed as decimals; results are doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeweave.operators.merge import upsert
from lakeweave.operators.ranking import ranked, tile
from lakeweave.sources.tables import MONEY, table

# Balance tiers (from, to, yearly rate), curve points (months, rate), gap buckets (from day, to day), shocks.
TIERS = [(1, 0.0, 50000.0, 0.01), (2, 50000.0, 150000.0, 0.015), (3, 150000.0, 1e15, 0.02)]
CURVE = [(1, 0.01), (3, 0.0125), (6, 0.015), (12, 0.02)]
BUCKETS = [("0-15", 0, 15), ("16-30", 16, 30), ("31-60", 31, 60), ("61-", 61, 100000)]
SHOCKS = [("base", 0.0), ("down", -0.01), ("up", 0.02)]
DECAY, FLOOR, MONTHS = 0.97, 1000.0, 120


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))  # a few fixed rows


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(repr(x) if isinstance(x, str) else f"CAST({x} AS DOUBLE)" if isinstance(x, float) else str(x) for x in r) + ")" for r in rows)


def _double(name: str, as_: str | None = None, digits: int = 4) -> F.Column:
    return F.round(F.col(name).cast("double"), digits).alias(as_ or name)


def _share(a: F.Column, b: F.Column) -> F.Column:
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def deposits(spark: SparkSession, d: str) -> DataFrame:
    """(account, day, balance)"""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("account"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").cast(MONEY).alias("x"))
    return o.groupBy("account", "day").agg(F.sum("x").cast(MONEY).alias("balance"))


def accounts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("account"), F.col("c_mktsegment").alias("segment"))


def loans(spark: SparkSession, d: str) -> DataFrame:
    """(loan, line, centre, day, due, principal, income, lost)"""
    return table(spark, d, "lineitem").selectExpr(
        "l_orderkey AS loan", "l_linenumber AS line", "l_suppkey AS centre", "CAST(l_shipdate AS DATE) AS day", "CAST(l_shipdate AS DATE) + CAST(l_partkey % 120 AS INT) AS due", f"CAST(l_extendedprice AS {MONEY}) AS principal",
        f"CAST(l_extendedprice AS {MONEY}) * CAST(l_discount AS DECIMAL(4,2)) AS income", "l_returnflag = 'R' AS lost",
    )


_DEP = "dep AS (SELECT o_custkey AS account, CAST(o_orderdate AS DATE) AS day, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS balance FROM orders GROUP BY 1, 2), acc AS (SELECT c_custkey AS account, c_mktsegment AS segment FROM customer)"
_LOAN = "loan AS (SELECT l_orderkey AS loan, l_linenumber AS line, l_suppkey AS centre, CAST(l_shipdate AS DATE) AS day, CAST(l_shipdate AS DATE) + CAST(l_partkey % 120 AS INTEGER) AS due, CAST(l_extendedprice AS DECIMAL(18,2)) AS principal, CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS income, l_returnflag = 'R' AS lost FROM lineitem)"
_MONTH = "CAST(date_trunc('month', day) AS DATE)"
QUERIES, SQL = {}, {}


def _add(sql: str):
    def keep(f):
        QUERIES[f"bank_{f.__name__}"], SQL[f"bank_{f.__name__}"] = f, sql
        return f

    return keep


@_add(f"""WITH {_DEP}, w AS (SELECT account, day, balance, sum(balance) OVER r30 AS s, count(*) OVER r30 AS n, min(balance) OVER r90 AS trough FROM dep
WINDOW r30 AS (PARTITION BY account ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), r90 AS (PARTITION BY account ORDER BY day ROWS BETWEEN 89 PRECEDING AND CURRENT ROW))
SELECT account, day, CAST(balance AS DOUBLE) AS balance, CAST(s AS DOUBLE) / n AS average, CAST(least(trough, balance) AS DOUBLE) AS core, CAST(greatest(balance - trough, 0) AS DOUBLE) AS volatile FROM w""")
def deposit_position(spark: SparkSession, d: str) -> DataFrame:
    """Each account's balance, its mean over 30 rows, and its core and volatile parts by the trough of 90 rows."""
    by = Window.partitionBy("account").orderBy("day")
    w = deposits(spark, d).withColumns({"s": F.sum("balance").over(by.rowsBetween(-29, 0)), "n": F.count("*").over(by.rowsBetween(-29, 0)), "trough": F.min("balance").over(by.rowsBetween(-89, 0))})
    return w.select("account", "day", F.col("balance").cast("double"), (F.col("s").cast("double") / F.col("n")).alias("average"), F.least("trough", "balance").cast("double").alias("core"), F.greatest(F.col("balance") - F.col("trough"), F.lit(0)).cast("double").alias("volatile"))


@_add(f"""WITH {_DEP}, t(tier, low, high, rate) AS (VALUES {_values(TIERS)})
SELECT account, day, tier, round(least(CAST(balance AS DOUBLE), high) - low, 4) AS slice, round((least(CAST(balance AS DOUBLE), high) - low) * rate / 365, 6) AS interest FROM dep, t WHERE CAST(balance AS DOUBLE) > low""")
def tiered_interest(spark: SparkSession, d: str) -> DataFrame:
    """The slice of each balance that falls into each tier, with a day's interest; empty slices go."""
    tiers = _rows(spark, TIERS, "tier int, low double, high double, rate double")
    cut = deposits(spark, d).crossJoin(tiers).withColumn("slice", F.greatest(F.least(F.col("balance").cast("double"), "high") - F.col("low"), F.lit(0.0))).where("slice > 0")
    return cut.select("account", "day", "tier", F.round("slice", 4).alias("slice"), F.round(F.col("slice") * F.col("rate") / 365, 6).alias("interest"))


@_add(f"""WITH {_DEP}, m AS (SELECT account, {_MONTH} AS month, arg_min(balance, day) AS opened, arg_max(balance, day) AS closed FROM dep GROUP BY 1, 2),
s AS (SELECT segment, month, sum(opened) AS opened, sum(closed) AS closed, count(*) AS n FROM m JOIN acc USING (account) GROUP BY 1, 2),
r AS (SELECT segment, month, n, CAST(opened AS DOUBLE) AS opened, CAST(closed AS DOUBLE) AS closed, (CAST(opened AS DOUBLE) - CAST(closed AS DOUBLE)) / nullif(CAST(opened AS DOUBLE), 0) AS runoff FROM s)
SELECT *, CASE WHEN runoff > 0.02 THEN 'HIGH' WHEN runoff > 0 THEN 'LOW' WHEN runoff = 0 THEN 'NONE' ELSE 'GROWTH' END AS flag FROM r""")
def attrition(spark: SparkSession, d: str) -> DataFrame:
    """First and last balances of each month by segment, and the part that ran off."""
    by = Window.partitionBy("account", "month").orderBy("day")
    w = deposits(spark, d).withColumn("month", F.trunc("day", "month"))
    w = w.select("account", "month", F.first("balance").over(by).alias("opened"), F.last("balance").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("closed")).distinct()
    s = w.join(accounts(spark, d), "account").groupBy("segment", "month").agg(F.count("*").alias("n"), F.sum("opened").cast("double").alias("opened"), F.sum("closed").cast("double").alias("closed"))
    s = s.withColumn("runoff", _share(F.col("opened") - F.col("closed"), F.col("opened")))
    return s.withColumn("flag", F.when(F.col("runoff") > 0.02, "HIGH").when(F.col("runoff") > 0, "LOW").when(F.col("runoff") == 0, "NONE").otherwise("GROWTH"))


@_add(f"""WITH {_DEP}, t AS (SELECT account, sum(balance) AS balance FROM dep GROUP BY 1),
r AS (SELECT account, balance, row_number() OVER w AS rn, sum(balance) OVER (ORDER BY balance DESC, account ROWS UNBOUNDED PRECEDING) AS running, sum(balance) OVER () AS total FROM t WINDOW w AS (ORDER BY balance DESC, account))
SELECT account, CAST(balance AS DOUBLE) AS balance, rn AS position, CAST(balance AS DOUBLE) / CAST(total AS DOUBLE) AS share, CAST(running AS DOUBLE) / CAST(total AS DOUBLE) AS cumulative, rn <= 20 AS is_top FROM r""")
def concentration(spark: SparkSession, d: str) -> DataFrame:
    """Accounts by balance, with their share of the total and the cumulative share."""
    totals = deposits(spark, d).groupBy("account").agg(F.sum("balance").alias("balance"))
    return ranked(totals, "balance", "account").select("account", F.col("balance").cast("double"), F.col("rn").alias("position"), _share(F.col("balance"), F.col("total")).alias("share"), _share(F.col("running"), F.col("total")).alias("cumulative"), (F.col("rn") <= 20).alias("is_top"))


@_add(f"""WITH {_DEP}, s AS (SELECT segment, {_MONTH} AS month, CAST(sum(balance) AS DOUBLE) / count(*) AS mean FROM dep JOIN acc USING (account) GROUP BY 1, 2),
b AS (SELECT {_MONTH} AS month, CAST(sum(balance) AS DOUBLE) / count(*) AS bench FROM dep GROUP BY 1),
l AS (SELECT segment, month, mean, bench, mean - lag(mean) OVER (PARTITION BY segment ORDER BY month) AS moved, bench - lag(bench) OVER (PARTITION BY segment ORDER BY month) AS bench_moved FROM s JOIN b USING (month))
SELECT segment, month, mean, bench, round(moved / nullif(bench_moved, 0), 4) AS beta FROM l""")
def deposit_beta(spark: SparkSession, d: str) -> DataFrame:
    """How far a segment's monthly mean moves with the mean of all."""
    dep = deposits(spark, d).withColumn("month", F.trunc("day", "month"))
    mean = F.sum("balance").cast("double") / F.count("*")
    s = dep.join(accounts(spark, d), "account").groupBy("segment", "month").agg(mean.alias("mean")).join(dep.groupBy("month").agg(mean.alias("bench")), "month")
    by = Window.partitionBy("segment").orderBy("month")
    moved = lambda c: F.col(c) - F.lag(c).over(by)
    return s.select("segment", "month", "mean", "bench", F.round(moved("mean") / F.nullif(moved("bench"), F.lit(0.0)), 4).alias("beta"))


_BANDS = "CASE WHEN dpd < 30 THEN 'CURRENT' WHEN dpd < 60 THEN '30' WHEN dpd < 90 THEN '60' ELSE '90+' END"


@_add(f"""WITH {_LOAN}, m AS (SELECT centre, {_MONTH} AS month, max(due - day) AS dpd FROM loan GROUP BY 1, 2), b AS (SELECT centre, month, {_BANDS} AS band FROM m),
l AS (SELECT lag(band) OVER (PARTITION BY centre ORDER BY month) AS before, band FROM b), c AS (SELECT before, band, count(*) AS n FROM l WHERE before IS NOT NULL GROUP BY 1, 2)
SELECT before, band, n, CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY before) AS DOUBLE) AS rate FROM c""")
def roll_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often a borrower moves from one overdue band to another from month to month."""
    m = loans(spark, d).groupBy("centre", F.trunc("day", "month").alias("month")).agg(F.max(F.datediff("due", "day")).alias("dpd"))
    m = m.withColumn("band", F.when(F.col("dpd") < 30, "CURRENT").when(F.col("dpd") < 60, "30").when(F.col("dpd") < 90, "60").otherwise("90+"))
    m = m.withColumn("before", F.lag("band").over(Window.partitionBy("centre").orderBy("month"))).where("before IS NOT NULL")
    c = m.groupBy("before", "band").agg(F.count("*").alias("n"))
    return c.withColumn("rate", _share(F.col("n"), F.sum("n").over(Window.partitionBy("before"))))


@_add(f"""WITH {_LOAN}, c(tenor, rate) AS (VALUES {_values(CURVE)}), x AS (SELECT row_number() OVER () AS id, loan, line, principal, greatest(CAST(ceil((due - day) / 30.0) AS INTEGER), 1) AS months FROM loan),
k AS (SELECT x.*, tenor, rate, row_number() OVER (PARTITION BY id ORDER BY abs(tenor - months), tenor) AS rn FROM x, c)
SELECT loan, line, months, tenor, round(-CAST(principal AS DOUBLE) * rate / 365, 6) AS charge FROM k WHERE rn = 1""")
def funds_charge(spark: SparkSession, d: str) -> DataFrame:
    """Each loan is charged at the nearest point of the curve, the shorter of two equally near."""
    months = F.greatest(F.ceil(F.datediff("due", "day") / 30.0).cast("int"), F.lit(1))
    near = F.array_min(F.array(*[F.struct(F.abs(F.lit(t) - F.col("months")).alias("far"), F.lit(t).alias("tenor"), F.lit(r).alias("rate")) for t, r in CURVE]))
    x = loans(spark, d).withColumn("months", months).withColumn("near", near)
    return x.select("loan", "line", "months", F.col("near.tenor").alias("tenor"), F.round(-F.col("principal").cast("double") * F.col("near.rate") / 365, 6).alias("charge"))


@_add(f"""WITH {_LOAN}, f AS (SELECT centre, min({_MONTH}) AS cohort FROM loan GROUP BY 1),
a AS (SELECT cohort, (year(day) * 12 + month(day)) - (year(cohort) * 12 + month(cohort)) AS age, sum(principal) AS lent, coalesce(sum(CASE WHEN lost THEN principal END), 0) AS lost FROM loan JOIN f USING (centre) GROUP BY 1, 2)
SELECT x.cohort, CAST(x.age AS INTEGER) AS age, CAST(max(x.lent) AS DOUBLE) AS lent, CAST(sum(y.lost) AS DOUBLE) AS lost_so_far FROM a x JOIN a y ON y.cohort = x.cohort AND y.age <= x.age GROUP BY 1, 2""")
def vintages(spark: SparkSession, d: str) -> DataFrame:
    """Money lent and cumulative losses by cohort and months on book."""
    l = loans(spark, d).withColumn("month", F.trunc("day", "month"))  # noqa: E741
    age = (F.year("month") * 12 + F.month("month") - F.year("cohort") * 12 - F.month("cohort")).alias("age")
    a = l.join(l.groupBy("centre").agg(F.min("month").alias("cohort")), "centre").groupBy("cohort", age).agg(F.sum("principal").alias("lent"), F.coalesce(F.sum(F.when(F.col("lost"), F.col("principal"))), F.lit(0)).alias("lost"))
    return a.select("cohort", "age", F.col("lent").cast("double"), F.sum("lost").over(Window.partitionBy("cohort").orderBy("age").rowsBetween(Window.unboundedPreceding, 0)).cast("double").alias("lost_so_far"))


@_add(f"""WITH {_DEP}, {_LOAN}, i AS (SELECT day, sum(income) AS income FROM loan GROUP BY 1), e AS (SELECT day, sum(balance) AS funding FROM dep GROUP BY 1)
SELECT coalesce(i.day, e.day) AS day, round(CAST(coalesce(income, 0) AS DOUBLE), 4) AS income, round(CAST(coalesce(funding, 0) AS DOUBLE) * 0.02 / 365, 4) AS expense, round(CAST(coalesce(income, 0) AS DOUBLE) - CAST(coalesce(funding, 0) AS DOUBLE) * 0.02 / 365, 4) AS net FROM i FULL JOIN e ON i.day = e.day""")
def net_interest(spark: SparkSession, d: str) -> DataFrame:
    """Income of loans less cost of deposits by day, days of either side kept."""
    i = loans(spark, d).groupBy("day").agg(F.sum("income").cast("double").alias("i"))
    e = deposits(spark, d).groupBy("day").agg(F.sum("balance").cast("double").alias("e"))
    income, expense = F.coalesce("i", F.lit(0.0)), F.coalesce("e", F.lit(0.0)) * 0.02 / 365
    return i.join(e, "day", "full").select("day", F.round(income, 4).alias("income"), F.round(expense, 4).alias("expense"), F.round(income - expense, 4).alias("net"))


@_add(f"""WITH RECURSIVE {_LOAN}, node AS (SELECT 'r' || r_regionkey AS id, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
up AS (SELECT id AS leaf, id AS here, parent FROM node UNION ALL SELECT up.leaf, n.id, n.parent FROM up JOIN node n ON n.id = up.parent), direct AS (SELECT 's' || centre AS leaf, sum(income) AS income FROM loan GROUP BY 1)
SELECT here AS node, round(CAST(sum(income) AS DOUBLE), 4) AS rolled, count(*) AS n_leaves FROM up JOIN direct USING (leaf) GROUP BY 1""")
def organisation(spark: SparkSession, d: str) -> DataFrame:
    """Income rolled up the tree of regions, nations and suppliers: sums of sums, level by level."""
    leaf = loans(spark, d).groupBy("centre").agg(F.sum("income").alias("income")).withColumn("n", F.lit(1).cast("long"))
    leaf = leaf.join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("centre") == F.col("s_suppkey"))
    up = lambda df, key: df.groupBy(key).agg(F.sum("income").alias("income"), F.sum("n").alias("n"))
    nations = up(leaf, "s_nationkey").join(table(spark, d, "nation").select("n_nationkey", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey"))
    levels = [(leaf, "s", "centre"), (nations, "n", "n_nationkey"), (up(nations, "n_regionkey"), "r", "n_regionkey")]
    first, *rest = [df.select(F.concat(F.lit(mark), F.col(key).cast("string")).alias("node"), _double("income", "rolled"), F.col("n").alias("n_leaves")) for df, mark, key in levels]
    for df in rest:
        first = first.unionByName(df)
    return first


@_add(f"""WITH {_LOAN}, m AS (SELECT {_MONTH} AS month, sum(income) AS income, sum(principal) AS principal FROM loan GROUP BY 1)
SELECT month, CAST(income AS DOUBLE) / nullif(CAST(principal AS DOUBLE), 0) AS ratio, round(CAST(income AS DOUBLE) / nullif(CAST(lag(income, 12) OVER (ORDER BY month) AS DOUBLE), 0) - 1, 6) AS growth FROM m""")
def efficiency(spark: SparkSession, d: str) -> DataFrame:
    """Monthly income to principal, and growth over the month twelve rows before (one row a month in one window)."""
    m = loans(spark, d).groupBy(F.trunc("day", "month").alias("month")).agg(F.sum("income").cast("double").alias("income"), F.sum("principal").cast("double").alias("principal"))
    last = F.lag("income", 12).over(Window.orderBy("month"))
    return m.select("month", _share(F.col("income"), F.col("principal")).alias("ratio"), F.round(F.col("income") / F.nullif(last, F.lit(0.0)) - 1, 6).alias("growth"))


@_add(f"""WITH {_LOAN}, s AS (SELECT n_name AS nation, centre, sum(income) AS income FROM loan JOIN supplier ON s_suppkey = centre JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2)
SELECT nation, centre, round(CAST(income AS DOUBLE), 4) AS income, CAST(income AS DOUBLE) / CAST(sum(income) OVER (PARTITION BY nation) AS DOUBLE) AS share FROM s""")
def cost_shares(spark: SparkSession, d: str) -> DataFrame:
    """Each centre's share of its nation's sum: a window sum over sums."""
    places = table(spark, d, "supplier").select("s_suppkey", "s_nationkey").join(F.broadcast(table(spark, d, "nation").select("n_nationkey", "n_name")), F.col("s_nationkey") == F.col("n_nationkey"))
    s = loans(spark, d).groupBy("centre").agg(F.sum("income").alias("income")).join(places, F.col("centre") == F.col("s_suppkey"))
    held = s.groupBy("n_name").agg(F.sum("income").alias("held"))  # one row a nation
    return s.join(F.broadcast(held), "n_name").select(F.col("n_name").alias("nation"), "centre", _double("income"), _share(F.col("income"), F.col("held")).alias("share"))


@_add(f"""WITH {_DEP}, p AS (SELECT segment, account, sum(balance) AS profit FROM dep JOIN acc USING (account) GROUP BY 1, 2)
SELECT segment, account, CAST(profit AS DOUBLE) AS profit, CAST(ntile(10) OVER (PARTITION BY segment ORDER BY profit DESC, account) AS INTEGER) AS decile FROM p""")
def customer_deciles(spark: SparkSession, d: str) -> DataFrame:
    """Deciles of accounts within their segment by profit."""
    p = deposits(spark, d).groupBy("account").agg(F.sum("balance").alias("profit")).join(accounts(spark, d), "account")
    return ranked(p, "profit", "account", ["segment"]).select("segment", "account", F.col("profit").cast("double"), tile(F.col("rn"), F.col("n_group"), 10).alias("decile"))


_METRICS = "m AS (SELECT year(day) AS year, sum(income) AS income, sum(principal) AS principal, coalesce(sum(CASE WHEN lost THEN principal END), 0) AS losses FROM loan GROUP BY 1)"


@_add(f"""WITH {_LOAN}, {_METRICS}, u AS (SELECT year, 'income' AS metric, CAST(income AS DOUBLE) AS amount FROM m UNION ALL SELECT year, 'principal', CAST(principal AS DOUBLE) FROM m UNION ALL SELECT year, 'losses', CAST(losses AS DOUBLE) FROM m)
SELECT CAST(u.year AS INTEGER) AS year, u.metric, round(u.amount, 4) AS amount, round(u.amount - p.amount, 4) AS variance, CASE WHEN p.amount IS NULL THEN 'NEW' WHEN abs(u.amount - p.amount) > 0.1 * p.amount THEN 'BREACH' ELSE 'WITHIN' END AS flag FROM u LEFT JOIN u p ON p.metric = u.metric AND p.year = u.year - 1""")
def variance(spark: SparkSession, d: str) -> DataFrame:
    """Three measures a year as rows, against the year before, flagged beyond a tenth."""
    m = loans(spark, d).groupBy(F.year("day").alias("year")).agg(F.sum("income").cast("double").alias("income"), F.sum("principal").cast("double").alias("principal"), F.coalesce(F.sum(F.when(F.col("lost"), F.col("principal"))), F.lit(0)).cast("double").alias("losses"))
    u = m.unpivot("year", ["income", "principal", "losses"], "metric", "amount")
    p = u.select((F.col("year") + 1).alias("year"), "metric", F.col("amount").alias("before"))
    gap = F.col("amount") - F.col("before")
    flag = F.when(F.col("before").isNull(), "NEW").when(F.abs(gap) > 0.1 * F.col("before"), "BREACH").otherwise("WITHIN")
    return u.join(p, ["year", "metric"], "left").select("year", "metric", F.round("amount", 4).alias("amount"), F.round(gap, 4).alias("variance"), flag.alias("flag"))


@_add(f"""WITH {_LOAN}, m AS (SELECT centre, {_MONTH} AS month, sum(principal) AS amount FROM loan GROUP BY 1, 2), a AS (SELECT centre, {_MONTH} AS month, sum(CASE WHEN lost THEN -principal ELSE 0 END) AS adjusted FROM loan GROUP BY 1, 2 HAVING sum(CASE WHEN lost THEN 1 ELSE 0 END) > 0)
SELECT m.centre, m.month, CAST(amount + coalesce(adjusted, 0) AS DOUBLE) AS amount, CASE WHEN adjusted IS NULL THEN 'OPEN' ELSE 'CLOSED' END AS close_status FROM m LEFT JOIN a ON a.centre = m.centre AND a.month = m.month""")
def month_close(spark: SparkSession, d: str) -> DataFrame:
    """Month-end merge on centre and month: months with losses are adjusted and closed."""
    l = loans(spark, d).withColumn("month", F.trunc("day", "month"))  # noqa: E741
    m = l.groupBy("centre", "month").agg(F.sum("principal").alias("amount"), F.sum(F.when(F.col("lost"), F.col("principal"))).alias("gone"))
    source = m.where("gone IS NOT NULL").select("centre", "month", (F.col("amount") - F.col("gone")).cast("double").alias("amount"), F.lit("CLOSED").alias("close_status"))
    target = m.select("centre", "month", F.col("amount").cast("double").alias("amount"), F.lit("OPEN").alias("close_status"))
    return upsert(target, source, ["centre", "month"], ["amount", "close_status"])


@_add(f"""WITH {_DEP}, {_LOAN}, b(bucket, low, high) AS (VALUES {_values(BUCKETS)}), a AS (SELECT bucket, min(low) AS low, sum(principal) AS assets FROM loan JOIN b ON due - day BETWEEN low AND high GROUP BY 1),
l AS (SELECT bucket, min(low) AS low, sum(balance) AS liabilities FROM dep JOIN b ON account % 120 BETWEEN low AND high GROUP BY 1),
g AS (SELECT coalesce(a.bucket, l.bucket) AS bucket, coalesce(a.low, l.low) AS low, coalesce(assets, 0) AS assets, coalesce(liabilities, 0) AS liabilities FROM a FULL JOIN l ON a.bucket = l.bucket)
SELECT bucket, CAST(assets AS DOUBLE) AS assets, CAST(liabilities AS DOUBLE) AS liabilities, CAST(sum(assets - liabilities) OVER (ORDER BY low ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS cumulative_gap FROM g""")
def repricing_gap(spark: SparkSession, d: str) -> DataFrame:
    """Assets and liabilities by days to reprice (a band join with fixed buckets), and the cumulative gap."""
    b = _rows(spark, BUCKETS, "bucket string, low int, high int")
    a = loans(spark, d).join(b, F.datediff("due", "day").between(F.col("low"), F.col("high"))).groupBy("bucket", "low").agg(F.sum("principal").alias("a"))
    l = deposits(spark, d).join(b, (F.col("account") % 120).between(F.col("low"), F.col("high"))).groupBy("bucket", "low").agg(F.sum("balance").alias("l"))  # noqa: E741
    g = a.join(l, ["bucket", "low"], "full").withColumns({"a": F.coalesce("a", F.lit(0)), "l": F.coalesce("l", F.lit(0))})
    gap = F.sum(F.col("a") - F.col("l")).over(Window.orderBy("low").rowsBetween(Window.unboundedPreceding, 0))  # one row a bucket
    return g.select("bucket", F.col("a").cast("double").alias("assets"), F.col("l").cast("double").alias("liabilities"), gap.cast("double").alias("cumulative_gap"))


@_add(f"""WITH {_DEP}, s AS (SELECT segment, CAST(sum(balance) AS DOUBLE) / 1000 AS opening FROM dep JOIN acc USING (account) GROUP BY 1), k AS (SELECT segment, opening, CAST(unnest(range(0, {MONTHS})) AS INTEGER) AS month FROM s)
SELECT segment, month, round(opening * pow({DECAY}, month), 2) AS balance, round(opening * pow({DECAY}, month) / pow(1 + 0.02 / 12, month), 2) AS present FROM k WHERE month = 0 OR opening * pow({DECAY}, month - 1) > {FLOOR}""")
def runoff_projection(spark: SparkSession, d: str) -> DataFrame:
    """Balances that decay month by month while above the floor, and their present value; in closed form, as each month's is the last one's times a constant."""
    s = deposits(spark, d).join(accounts(spark, d), "account").groupBy("segment").agg((F.sum("balance").cast("double") / 1000).alias("opening"))
    k = s.withColumn("month", F.explode(F.sequence(F.lit(0), F.lit(MONTHS - 1)))).where((F.col("month") == 0) | (F.col("opening") * F.pow(F.lit(DECAY), F.col("month") - 1) > FLOOR))
    left = F.col("opening") * F.pow(F.lit(DECAY), "month")
    return k.select("segment", "month", F.round(left, 2).alias("balance"), F.round(left / F.pow(F.lit(1 + 0.02 / 12), "month"), 2).alias("present"))


@_add(f"""WITH {_LOAN}, x(scenario, shock) AS (VALUES {_values(SHOCKS)}), y AS (SELECT year(day) AS year, sum(principal) AS principal FROM loan GROUP BY 1)
SELECT scenario, CAST(year AS INTEGER) AS year, round(CAST(principal AS DOUBLE) / (1 + 0.03 + shock), 2) AS present, round(CAST(principal AS DOUBLE) / (1 + 0.03 + shock) - CAST(principal AS DOUBLE) / 1.03, 2) AS change FROM y, x""")
def shocked_value(spark: SparkSession, d: str) -> DataFrame:
    """Present value of a year's loans under each shock of the rate, and its change from the base."""
    y = loans(spark, d).groupBy(F.year("day").alias("year")).agg(F.sum("principal").cast("double").alias("p"))
    v = F.col("p") / (F.lit(1 + 0.03) + F.col("shock"))
    return y.crossJoin(_rows(spark, SHOCKS, "scenario string, shock double")).select("scenario", "year", F.round(v, 2).alias("present"), F.round(v - F.col("p") / 1.03, 2).alias("change"))


@_add(f"""WITH {_LOAN}, q AS (SELECT CAST(date_trunc('quarter', day) AS DATE) AS quarter, sum(income) AS income, coalesce(sum(CASE WHEN lost THEN income END), 0) AS eliminated, count(DISTINCT centre) AS centres FROM loan GROUP BY 1)
SELECT quarter, centres, round(CAST(income - eliminated AS DOUBLE), 4) AS net, round(CAST((income - eliminated) - lag(income - eliminated) OVER (ORDER BY quarter) AS DOUBLE), 4) AS change FROM q""")
def quarter_report(spark: SparkSession, d: str) -> DataFrame:
    """Income of a quarter net of eliminations, against the quarter before (one row a quarter in one window)."""
    q = loans(spark, d).groupBy(F.trunc("day", "quarter").alias("quarter")).agg(F.sum("income").alias("income"), F.coalesce(F.sum(F.when(F.col("lost"), F.col("income"))), F.lit(0)).alias("out"), F.countDistinct("centre").alias("centres"))
    q = q.withColumn("net", F.col("income") - F.col("out"))
    return q.select("quarter", "centres", _double("net"), F.round((F.col("net") - F.lag("net").over(Window.orderBy("quarter"))).cast("double"), 4).alias("change"))
