"""Ten more bank-finance statements with their full column lists: deposits, credit risk, fees, revenue, capital, liquidity.

Deposit accounts are a customer's orders of one priority, loans are suppliers' lines (`bank_positions.positions`), and what the
inputs lack (plans, tiers, risk profiles, collateral) is derived from keys by fixed rules. Every statement covers all days.
Each is written twice: with the DataFrame API, and as DuckDB SQL. Amounts are summed as decimals or whole cents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeweave.functions.columns import FOREVER, valid_on
from lakeweave.plans.bank import _rows, _values
from lakeweave.plans.bank_positions import _POSITION, BASES, _history, positions
from lakeweave.sources.tables import MONEY, table

# Plans (plan, rate, from, to or none), tiers (plan, tier, from, up to, rate), facilities (type, conversion in
# hundredths), losses (product, base, floor, in hundredths), horizons in months, haircuts of collateral in hundredths, classes
# of exposure by product, risk weights (class, rating, hundredths), run-off (segment or any, insured, hundredths), inflow rates.
PLANS = [(1, 0.02, "1992-01-01", None), (2, 0.025, "1992-01-01", "1995-12-31"), (2, 0.0275, "1996-01-01", None), (3, 0.03, "1992-01-01", "1997-06-30"), (3, 0.035, "1997-07-01", "1997-12-31"), (4, 0.01, "1994-01-01", None), (5, 0.005, "1992-01-01", None)]
TIERS = [(p, t, lo, hi, round(0.004 * t + 0.002 * p, 6)) for p in range(1, 6) for t, lo, hi in ((1, 0, 50_000), (2, 50_000, 150_000), (3, 150_000, 10**12))]
FACILITIES = [(0, 50), (1, 20), (2, 100)]
LOSSES = [(0, 45, 10), (1, 40, 5), (2, 75, 25), (3, 35, 10)]
HORIZONS = [6, 12, 24, 36]
COLLATERAL = [("CASH", 0, True), ("PROPERTY", 40, True), ("GOODS", 65, False)]
CLASSES = [(0, "RETAIL"), (1, "CORPORATE"), (2, "CORPORATE"), (3, "MORTGAGE")]
WEIGHTS = [("RETAIL", "UNRATED", 75), ("RETAIL", "A", 75), ("RETAIL", "B", 75), ("CORPORATE", "A", 50), ("CORPORATE", "B", 100), ("CORPORATE", "UNRATED", 100), ("MORTGAGE", "A", 35), ("MORTGAGE", "B", 35), ("MORTGAGE", "UNRATED", 50)]
RUNOFF = [("BUILDING", True, 3), ("BUILDING", False, 10), ("AUTOMOBILE", True, 5), ("AUTOMOBILE", False, 20), ("MACHINERY", True, 5), ("MACHINERY", False, 40), ("HOUSEHOLD", True, 3), ("HOUSEHOLD", False, 10), ("FURNITURE", True, 5), ("FURNITURE", False, 40)]
LEVELS = [("A", "LEVEL_1", 0), ("N", "LEVEL_2A", 15), ("R", "LEVEL_2B", 50)]
INFLOWS = [(0, 50), (1, 100), (2, 50), (3, 100)]
MEAN, TROUGH, OVERDUE, LATE, DOUBLED = 30, 90, 90, 30, 2
MINIMUM, CONSERVATION, COVERAGE = 0.045, 0.025, 1.0
ORIGIN = "1992-01-01"
QUERIES, SQL = {}, {}


def _add(sql: str):
    def keep(f):
        QUERIES[f"bank_{f.__name__}"], SQL[f"bank_{f.__name__}"] = f, sql
        return f

    return keep


def _real(x: Column | str, name: str | None = None) -> Column:
    out = (F.col(x) if isinstance(x, str) else x).cast("double")
    return out.alias(name or x)


def _cents(x: str) -> Column:
    """An amount of money in whole cents."""
    return F.round(F.col(x) * 100).cast("long")


def deposits(spark: SparkSession, d: str) -> DataFrame:
    """(day, account, customer, plan, branch, currency, segment, balance, average, trough) of accounts that are open on the day."""
    o = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day"), F.col("o_custkey").alias("customer"), F.expr("CAST(left(o_orderpriority, 1) AS INT)").alias("plan"), F.col("o_totalprice").cast(MONEY).alias("x"))
    h = o.withColumn("account", F.col("customer") * 10 + F.col("plan")).groupBy("account", "customer", "plan", "day").agg(F.sum("x").cast("decimal(28,2)").alias("balance"))
    along = Window.partitionBy("account").orderBy("day")
    last = lambda n: along.rowsBetween(1 - n, 0)
    h = h.withColumns({"average": F.sum("balance").over(last(MEAN)).cast("double") / F.count("*").over(last(MEAN)), "trough": F.min("balance").over(last(TROUGH))})
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_nationkey").cast("int").alias("branch"), F.col("c_mktsegment").alias("segment"))
    k = F.col("customer")
    h = h.join(c, "customer").withColumns({"currency": F.when(F.col("branch") % 4 == 0, "EUR").otherwise("USD"), "closed": F.when(k % 11 == 0, F.add_months(F.lit("1996-01-01").cast("date"), (k % 30).cast("int")))})
    return h.where(F.col("closed").isNull() | (F.col("closed") > F.col("day"))).drop("closed")


_DEPOSIT = f"""h AS (SELECT o_custkey AS customer, CAST(o_orderpriority[1] AS INTEGER) AS plan, CAST(o_orderdate AS DATE) AS day, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS balance FROM orders GROUP BY ALL),
v AS (SELECT *, CAST(sum(balance) OVER (x ROWS BETWEEN {MEAN - 1} PRECEDING AND CURRENT ROW) AS DOUBLE) / count(*) OVER (x ROWS BETWEEN {MEAN - 1} PRECEDING AND CURRENT ROW) AS average, min(balance) OVER (x ROWS BETWEEN {TROUGH - 1} PRECEDING AND CURRENT ROW) AS trough FROM h WINDOW x AS (PARTITION BY customer, plan ORDER BY day)),
deposit AS (SELECT day, customer * 10 + plan AS account, customer, plan, CAST(c_nationkey AS INTEGER) AS branch, CASE WHEN c_nationkey % 4 = 0 THEN 'EUR' ELSE 'USD' END AS currency, c_mktsegment AS segment, balance, average, trough FROM v JOIN customer ON c_custkey = customer
WHERE customer % 11 <> 0 OR CAST(DATE '1996-01-01' + to_months(CAST(customer % 30 AS INTEGER)) AS DATE) > day)"""


@_add(f"""WITH {_DEPOSIT}, r(plan, rate, start, until) AS (VALUES {_history(PLANS)})
SELECT day AS as_of_date, account AS account_sk, customer AS customer_sk, d.plan AS product_sk, branch AS branch_sk, currency AS currency_code, CAST(balance AS DOUBLE) AS eod_balance, average AS average_daily_balance, CAST(least(trough, balance) AS DOUBLE) AS core_balance,
CAST(greatest(balance - trough, 0) AS DOUBLE) AS volatile_balance, CAST(rate AS DOUBLE) AS contractual_rate FROM deposit d JOIN r ON r.plan = d.plan AND day >= CAST(start AS DATE) AND day <= coalesce(CAST(until AS DATE), DATE '{FOREVER}')""")
def deposit_balance_daily(spark: SparkSession, d: str) -> DataFrame:
    """Each open account's balance, mean of 30 rows, core and volatile parts, and the rate its plan has on the day; none without a rate."""
    r = _rows(spark, PLANS, "of int, rate double, start string, until string").withColumns({c: F.col(c).cast("date") for c in ("start", "until")})
    h = deposits(spark, d).join(F.broadcast(r), (F.col("plan") == F.col("of")) & valid_on(F.col("day"), "start", "until"))
    return h.select(
        F.col("day").alias("as_of_date"), F.col("account").alias("account_sk"), F.col("customer").alias("customer_sk"), F.col("plan").alias("product_sk"), F.col("branch").alias("branch_sk"), F.col("currency").alias("currency_code"), _real("balance", "eod_balance"),
        F.col("average").alias("average_daily_balance"), _real(F.least("trough", "balance"), "core_balance"), _real(F.greatest(F.col("balance") - F.col("trough"), F.lit(0)), "volatile_balance"), F.col("rate").alias("contractual_rate"),
    )


@_add(f"""WITH {_DEPOSIT}, t(plan, tier, lower, upper, rate) AS (VALUES {_values(TIERS)}), b(product, basis) AS (VALUES {_values(BASES)}), x AS (SELECT d.*, tier, rate, least(average, upper) - lower AS part FROM deposit d JOIN t ON t.plan = d.plan AND average > lower)
SELECT day AS as_of_date, account AS account_sk, plan AS product_sk, CAST(tier AS INTEGER) AS tier_id, part AS tier_balance, rate AS tier_rate, part * rate / basis AS interest_expense FROM x JOIN b ON product = plan % 4""")
def deposit_interest_expense(spark: SparkSession, d: str) -> DataFrame:
    """The part of each account's mean balance that falls into each tier of its plan, and a day's interest on it by the product's basis."""
    t = _rows(spark, TIERS, "plan int, tier_id int, lower long, upper long, tier_rate double")
    b = _rows(spark, BASES, "product int, basis int")
    x = deposits(spark, d).join(t, "plan").where("average > lower").withColumn("tier_balance", F.least(F.col("average"), F.col("upper").cast("double")) - F.col("lower"))
    x = x.join(b, F.col("product") == F.col("plan") % 4)
    return x.select(F.col("day").alias("as_of_date"), F.col("account").alias("account_sk"), F.col("plan").alias("product_sk"), "tier_id", "tier_balance", "tier_rate", (F.col("tier_balance") * F.col("tier_rate") / F.col("basis")).alias("interest_expense"))


def staged(spark: SparkSession, d: str) -> DataFrame:
    """Loan positions with first and present default rates, their ratio, stage and what set it off."""
    k, n = F.col("account"), F.datediff("day", F.lit(ORIGIN).cast("date"))
    p = positions(spark, d).withColumns({"first": F.when(k % 13 != 0, (1 + k % 9).cast("double") / 100), "now": F.when(k % 17 != 0, (1 + (k * 31 + n) % 25).cast("double") / 100)})
    p = p.withColumn("ratio", F.col("now") / F.col("first"))
    causes = [("DEFAULT", 3, (F.col("overdue") >= OVERDUE) | (F.col("status") == "NONACCRUAL")), ("DPD_BACKSTOP", 2, F.col("overdue") >= LATE), ("SICR_PD_DOUBLING", 2, F.col("ratio") >= DOUBLED), ("WATCHLIST", 2, k % 50 == 3)]
    hits = F.coalesce(*[F.when(c, F.struct(F.lit(s).alias("stage"), F.lit(name).alias("cause"))) for name, s, c in causes], F.struct(F.lit(1).alias("stage"), F.lit("PERFORMING").alias("cause")))
    return p.withColumn("hit", hits).withColumns({"stage": F.col("hit.stage"), "cause": F.col("hit.cause")}).drop("hit")


_STAGED = f"""{_POSITION}, pd AS (SELECT *, CASE WHEN account % 13 <> 0 THEN CAST(1 + account % 9 AS DOUBLE) / 100 END AS first, CASE WHEN account % 17 <> 0 THEN CAST(1 + (account * 31 + (day - DATE '{ORIGIN}')) % 25 AS DOUBLE) / 100 END AS now FROM p),
staged AS (SELECT *, now / first AS ratio, CASE WHEN overdue >= {OVERDUE} OR status = 'NONACCRUAL' THEN 'DEFAULT' WHEN overdue >= {LATE} THEN 'DPD_BACKSTOP' WHEN now / first >= {DOUBLED} THEN 'SICR_PD_DOUBLING' WHEN account % 50 = 3 THEN 'WATCHLIST' ELSE 'PERFORMING' END AS cause FROM pd),
graded AS (SELECT *, CAST(CASE cause WHEN 'DEFAULT' THEN 3 WHEN 'PERFORMING' THEN 1 ELSE 2 END AS INTEGER) AS stage FROM staged)"""


@_add(f"{_STAGED} SELECT day AS as_of_date, account AS account_sk, account AS customer_sk, first AS origination_pd, now AS current_pd, ratio AS pd_ratio, overdue AS days_past_due, stage AS ifrs9_stage, cause AS stage_trigger FROM graded")
def ecl_staging(spark: SparkSession, d: str) -> DataFrame:
    """The impairment stage of each loan on each day, and what set it off."""
    names = {"day": "as_of_date", "account": "account_sk", "first": "origination_pd", "now": "current_pd", "ratio": "pd_ratio", "overdue": "days_past_due", "stage": "ifrs9_stage", "cause": "stage_trigger"}
    return staged(spark, d).select(*[F.col(c).alias(n) for c, n in names.items()], F.col("account").alias("customer_sk"))


def _undrawn(spark: SparkSession) -> DataFrame:
    return _rows(spark, FACILITIES, "facility int, conversion int")


def _exposed(df: DataFrame, spark: SparkSession) -> DataFrame:
    """df (account) with `off`: the part of its undrawn commitment that counts, 0 without one. Every third account has none."""
    k = F.col("account")
    df = df.withColumns({"facility": F.when(k % 3 != 0, (k % 2).cast("int")), "undrawn": (1000 * (k % 20)).cast("decimal(18,2)")})
    return df.join(_undrawn(spark), "facility", "left").withColumn("off", F.coalesce(F.col("undrawn") * F.col("conversion") / 100, F.lit(0)).cast("decimal(28,2)")).drop("facility", "undrawn", "conversion")


_OFF = f"CAST(CASE WHEN account % 3 <> 0 THEN CAST(1000 * (account % 20) AS DECIMAL(18,2)) * CASE account % 2 WHEN 0 THEN {FACILITIES[0][1]} ELSE {FACILITIES[1][1]} END / 100 ELSE 0 END AS DECIMAL(28,2))"


@_add(f"""{_STAGED}, l(product, base, least_loss) AS (VALUES {_values(LOSSES)}), m AS (SELECT unnest([{", ".join(map(str, HORIZONS))}]) AS months),
e AS (SELECT g.*, CAST(principal + accrued + {_OFF} AS DOUBLE) AS ead, base / 100.0::DOUBLE AS base, least_loss / 100.0::DOUBLE AS least_loss, CASE WHEN account % 4 <> 0 THEN CAST(5000 * (1 + account % 7) AS DOUBLE) * 0.9 END AS held FROM graded g JOIN l USING (product)),
k AS (SELECT e.*, CASE WHEN held IS NULL THEN base ELSE greatest(base * (1 - held / nullif(ead, 0)), least_loss) END AS lgd FROM e), x AS (SELECT k.*, months, ead * (months * (1 + account % 5) / 1500.0::DOUBLE) * lgd AS loss FROM k, m WHERE stage > 1 OR months <= 12)
SELECT day AS as_of_date, account AS account_sk, stage AS ifrs9_stage, ead AS exposure_at_default, lgd AS lgd_rate, CAST(months AS INTEGER) AS horizon_months, loss AS undiscounted_ecl, round(loss / power(1 + rate / 12, months), 6) AS discounted_ecl FROM x""")
def ecl_provision(spark: SparkSession, d: str) -> DataFrame:
    """Expected loss by horizon: exposure with undrawn parts, loss rate after collateral, default rate of the horizon, discounted. Stage 1 looks twelve months ahead."""
    k = F.col("account")
    e = _exposed(staged(spark, d), spark).join(_rows(spark, LOSSES, "product int, base int, least_loss int"), "product")
    e = e.withColumn("exposure_at_default", _real(F.col("principal") + F.col("accrued") + F.col("off"), "x"))
    # Two pieces of collateral an account, at 60 and 30 hundredths of one value; every fourth account has none.
    held = F.when(k % 4 != 0, (5000 * (1 + k % 7)).cast("double") * 0.9)
    base, least = F.col("base") / F.lit(100.0), F.col("least_loss") / F.lit(100.0)
    e = e.withColumn("lgd_rate", F.coalesce(F.greatest(base * (1 - held / F.nullif(F.col("exposure_at_default"), F.lit(0.0))), F.when(held.isNotNull(), least)), base))
    e = e.withColumn("horizon_months", F.explode(F.array(*map(F.lit, HORIZONS)))).where("stage > 1 OR horizon_months <= 12")
    loss = F.col("exposure_at_default") * (F.col("horizon_months") * (1 + k % 5) / F.lit(1500.0)) * F.col("lgd_rate")
    return e.select(
        F.col("day").alias("as_of_date"), k.alias("account_sk"), F.col("stage").alias("ifrs9_stage"), "exposure_at_default", "lgd_rate", "horizon_months", loss.alias("undiscounted_ecl"),
        F.round(loss / F.pow(1 + F.col("rate") / 12, F.col("horizon_months")), 6).alias("discounted_ecl"),
    )


def fees(spark: SparkSession, d: str) -> DataFrame:
    """(day, customer, product, branch, category, gross, waived, reversed) in cents: four sources, less what was waived and reversed."""
    o = table(spark, d, "orders").withColumns({"day": F.col("o_orderdate").cast("date"), "customer": F.col("o_custkey"), "product": F.expr("CAST(left(o_orderpriority, 1) AS INT)")})
    lines = table(spark, d, "lineitem").join(o.select(F.col("o_orderkey").alias("l_orderkey"), "customer", "product"), "l_orderkey").withColumn("day", F.col("l_shipdate").cast("date"))
    e = table(spark, d, "events").withColumns({"day": F.col("ts").cast("date"), "customer": F.col("user_id"), "product": F.lit(9)})
    parts = [
        (lines, "CARD_INTERCHANGE", F.round("l_extendedprice").cast("long") % 50), (o, "PAYMENT_FEE", 100 + F.col("o_orderkey") % 300),
        (o.where("o_totalprice > 150000"), "WEALTH_ADVISORY", F.round(F.col("o_totalprice") / 100).cast("long")), (e.where("event_type = 'purchase'"), "SERVICE_CHARGE", 10 + F.col("event_id") % 90),
    ]
    key = ["day", "customer", "product", "category"]
    gross = None
    for df, name, fee in parts:
        one = df.select("day", "customer", "product", F.lit(name).alias("category"), fee.alias("fee"))
        gross = one if gross is None else gross.unionByName(one)
    gross = gross.groupBy(*key).agg(F.sum("fee").alias("gross"))
    waived = o.where("o_orderkey % 4 = 0").groupBy("day", "customer", "product").agg((25 * F.count("*")).alias("waived")).withColumn("category", F.lit("PAYMENT_FEE"))
    back = lines.where("l_returnflag = 'R'").groupBy("day", "customer", "product").agg((5 * F.count("*")).alias("reversed")).withColumn("category", F.lit("CARD_INTERCHANGE"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_nationkey").cast("int").alias("branch"))
    return gross.join(c, "customer").join(waived, key, "left").join(back, key, "left").fillna(0, ["waived", "reversed"])


_FEES = """o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_custkey AS customer, CAST(o_orderpriority[1] AS INTEGER) AS product, o_totalprice FROM orders),
li AS (SELECT l_extendedprice, l_returnflag, CAST(l_shipdate AS DATE) AS day, customer, product FROM lineitem JOIN o ON o_orderkey = l_orderkey),
raw AS (SELECT day, customer, product, 'CARD_INTERCHANGE' AS category, CAST(round(l_extendedprice) AS BIGINT) % 50 AS fee FROM li UNION ALL SELECT day, customer, product, 'PAYMENT_FEE', 100 + o_orderkey % 300 FROM o
UNION ALL SELECT day, customer, product, 'WEALTH_ADVISORY', CAST(round(o_totalprice / 100) AS BIGINT) FROM o WHERE o_totalprice > 150000 UNION ALL SELECT CAST(ts AS DATE), user_id, 9, 'SERVICE_CHARGE', 10 + event_id % 90 FROM events WHERE event_type = 'purchase'),
wv AS (SELECT day, customer, product, 'PAYMENT_FEE' AS category, 25 * count(*) AS waived FROM o WHERE o_orderkey % 4 = 0 GROUP BY ALL), rv AS (SELECT day, customer, product, 'CARD_INTERCHANGE' AS category, 5 * count(*) AS reversed FROM li WHERE l_returnflag = 'R' GROUP BY ALL),
g AS (SELECT day, customer, product, category, CAST(sum(fee) AS BIGINT) AS gross FROM raw GROUP BY ALL),
fee AS (SELECT g.*, CAST(c_nationkey AS INTEGER) AS branch, coalesce(waived, 0) AS waived, coalesce(reversed, 0) AS reversed FROM g JOIN customer ON c_custkey = customer LEFT JOIN wv USING (day, customer, product, category) LEFT JOIN rv USING (day, customer, product, category))"""


@_add(f"WITH {_FEES} SELECT day AS as_of_date, customer AS customer_sk, product AS product_sk, branch AS branch_sk, category AS fee_category, gross AS gross_fee, waived AS waived_fee, reversed AS reversed_fee, gross - waived - reversed AS net_fee FROM fee")
def fee_income_daily(spark: SparkSession, d: str) -> DataFrame:
    """Fees of a day by customer, product and kind, in cents: gross, waived, reversed and net."""
    f = fees(spark, d)
    return f.select(
        F.col("day").alias("as_of_date"), F.col("customer").alias("customer_sk"), F.col("product").alias("product_sk"), F.col("branch").alias("branch_sk"), F.col("category").alias("fee_category"), F.col("gross").alias("gross_fee"), F.col("waived").alias("waived_fee"),
        F.col("reversed").alias("reversed_fee"), (F.col("gross") - F.col("waived") - F.col("reversed")).alias("net_fee"),
    )


@_add(f"""WITH {_DEPOSIT}, {_FEES}, last AS (SELECT CAST(date_trunc('month', max(o_orderdate)) AS DATE) AS month FROM orders),
dr AS (SELECT customer, CAST(sum(CAST(round(balance) AS BIGINT) * plan) AS BIGINT) AS rev, count(DISTINCT plan) AS n FROM deposit, last WHERE date_trunc('month', day) = month GROUP BY 1), lr AS (SELECT customer, CAST(sum(CAST(round(l_extendedprice) AS BIGINT) * 3) AS BIGINT) AS rev, count(DISTINCT product) AS n FROM li, last WHERE date_trunc('month', day) = month GROUP BY 1),
fr AS (SELECT customer, CAST(sum(gross - waived - reversed) AS BIGINT) AS rev FROM fee, last WHERE date_trunc('month', day) = month GROUP BY 1), begun AS (SELECT customer, min(day) AS start FROM o GROUP BY 1)
SELECT month AS as_of_month, c_custkey AS customer_sk, c_mktsegment AS segment_code, CAST(((year(month) - year(start)) * 12 + month(month) - month(start)) % 12 AS INTEGER) AS tenure_months, coalesce(dr.n, 0) + coalesce(lr.n, 0) AS product_holdings, coalesce(dr.rev, 0) AS deposit_revenue,
coalesce(lr.rev, 0) AS loan_revenue, coalesce(fr.rev, 0) AS fee_revenue, coalesce(dr.rev, 0) + coalesce(lr.rev, 0) + coalesce(fr.rev, 0) AS total_revenue
FROM customer CROSS JOIN last LEFT JOIN begun ON begun.customer = c_custkey LEFT JOIN dr ON dr.customer = c_custkey LEFT JOIN lr ON lr.customer = c_custkey LEFT JOIN fr ON fr.customer = c_custkey""")
def customer_revenue_monthly(spark: SparkSession, d: str) -> DataFrame:
    """The last month's revenue of each customer from deposits, loans and fees, with the number of products held and the months part of the tenure."""
    o = table(spark, d, "orders")
    last = F.broadcast(o.agg(F.trunc(F.max("o_orderdate").cast("date"), "month").alias("month")))  # one row
    of_month = lambda df: df.crossJoin(last).where(F.trunc("day", "month") == F.col("month"))
    dr = of_month(deposits(spark, d)).groupBy("customer").agg(F.sum(F.round("balance").cast("long") * F.col("plan")).alias("deposit_revenue"), F.countDistinct("plan").alias("deposits"))
    lines = table(spark, d, "lineitem").join(o.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("customer"), F.left("o_orderpriority", F.lit(1)).alias("product")), "l_orderkey").withColumn("day", F.col("l_shipdate").cast("date"))
    lr = of_month(lines).groupBy("customer").agg((3 * F.sum(F.round("l_extendedprice").cast("long"))).alias("loan_revenue"), F.countDistinct("product").alias("loans"))
    fr = of_month(fees(spark, d)).groupBy("customer").agg(F.sum(F.col("gross") - F.col("waived") - F.col("reversed")).alias("fee_revenue"))
    begun = o.groupBy(F.col("o_custkey").alias("customer")).agg(F.min("o_orderdate").alias("start"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_mktsegment").alias("segment_code")).crossJoin(last)
    for other in (begun, dr, lr, fr):
        c = c.join(other, "customer", "left")
    c = c.fillna(0, ["deposit_revenue", "loan_revenue", "fee_revenue", "deposits", "loans"])
    months = (F.year("month") - F.year("start")) * 12 + F.month("month") - F.month("start")
    return c.select(
        F.col("month").alias("as_of_month"), F.col("customer").alias("customer_sk"), "segment_code", (months % 12).cast("int").alias("tenure_months"), (F.col("deposits") + F.col("loans")).alias("product_holdings"), "deposit_revenue", "loan_revenue", "fee_revenue",
        (F.col("deposit_revenue") + F.col("loan_revenue") + F.col("fee_revenue")).alias("total_revenue"),
    )


def weighted(spark: SparkSession, d: str) -> DataFrame:
    """Loan positions with class, rating, exposures, eligible collateral, net exposure and weight (in hundredths)."""
    k = F.col("account")
    p = _exposed(positions(spark, d), spark).join(_rows(spark, CLASSES, "product int, class string"), "product")
    p = p.withColumns({"rating": F.when(k % 5 < 3, F.when(k % 2 == 0, "A").otherwise("B")), "kind": F.when(k % 4 == 0, "CASH").when(k % 4 == 1, "PROPERTY").when(k % 4 == 2, "GOODS"), "on": F.col("principal") + F.col("accrued")})
    held = _rows(spark, [x[:2] for x in COLLATERAL if x[2]], "kind string, haircut int")
    p = p.join(held, "kind", "left").withColumn("eligible", F.coalesce((5000 * (1 + k % 7)).cast("decimal(18,2)") * (100 - F.col("haircut")) / 100, F.lit(0)).cast("decimal(28,2)"))
    p = p.withColumns({"net": F.greatest(F.col("on") + F.col("off") - F.col("eligible"), F.lit(0)).cast("decimal(30,4)"), "bucket": F.coalesce("rating", F.lit("UNRATED"))})
    return p.join(_rows(spark, WEIGHTS, "class string, bucket string, weight int"), ["class", "bucket"])


_HELD = f"CASE account % 4 WHEN 0 THEN 100 - {COLLATERAL[0][1]} WHEN 1 THEN 100 - {COLLATERAL[1][1]} END"
_WEIGHTED = f"""{_POSITION}, cl(product, class) AS (VALUES {_values(CLASSES)}), wt(class, bucket, weight) AS (VALUES {_values(WEIGHTS)}),
x AS (SELECT p.*, class, CASE WHEN account % 5 < 3 THEN CASE WHEN account % 2 = 0 THEN 'A' ELSE 'B' END END AS rating, principal + accrued AS on_bal, {_OFF} AS off_bal, CAST(coalesce(CAST(5000 * (1 + account % 7) AS DECIMAL(18,2)) * {_HELD} / 100, 0) AS DECIMAL(28,2)) AS eligible FROM p JOIN cl USING (product)),
weighted AS (SELECT x.*, CAST(greatest(on_bal + off_bal - eligible, 0) AS DECIMAL(30,4)) AS net, weight FROM x JOIN wt ON wt.class = x.class AND bucket = coalesce(rating, 'UNRATED'))"""


@_add(f"""{_WEIGHTED} SELECT day AS as_of_date, account AS account_sk, class AS exposure_class, rating AS external_rating, CAST(on_bal AS DOUBLE) AS on_balance_exposure, CAST(off_bal AS DOUBLE) AS off_balance_exposure, CAST(eligible AS DOUBLE) AS eligible_collateral, CAST(net AS DOUBLE) AS net_exposure,
weight / 100.0::DOUBLE AS risk_weight, CAST(net AS DOUBLE) * weight / 100 AS risk_weighted_assets FROM weighted""")
def rwa_credit(spark: SparkSession, d: str) -> DataFrame:
    """Each loan's exposure after eligible collateral, weighted by class and rating; without a rating by the class's own weight."""
    w = weighted(spark, d)
    return w.select(
        F.col("day").alias("as_of_date"), F.col("account").alias("account_sk"), F.col("class").alias("exposure_class"), F.col("rating").alias("external_rating"), _real("on", "on_balance_exposure"), _real("off", "off_balance_exposure"), _real("eligible", "eligible_collateral"),
        _real("net", "net_exposure"), (F.col("weight") / F.lit(100.0)).alias("risk_weight"), (F.col("net").cast("double") * F.col("weight") / 100).alias("risk_weighted_assets"),
    )


@_add(f"""{_WEIGHTED}, rw AS (SELECT day, sum(net * CAST(weight AS INTEGER)) AS credit FROM weighted GROUP BY 1), orw AS (SELECT CAST(l_shipdate AS DATE) AS day, sum(CAST(round(l_quantity) AS BIGINT)) * 1000 AS other FROM lineitem WHERE l_linenumber = 1 GROUP BY 1),
st AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(CASE WHEN o_orderstatus = 'F' THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END) AS core, sum(CASE WHEN o_orderstatus = 'O' THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END) AS more, sum(CASE WHEN o_orderstatus = 'P' THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END) AS second FROM orders GROUP BY 1),
dd AS (SELECT CAST(l_shipdate AS DATE) AS day, sum(CAST(round(l_extendedprice) AS BIGINT)) AS off FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
k AS (SELECT st.day, CAST(core - coalesce(off, 0) AS DOUBLE) / 100 AS c, CAST(more AS DOUBLE) / 100 AS m, CAST(second AS DOUBLE) / 100 AS s, CAST(credit AS DOUBLE) / 100 + coalesce(CAST(other AS DOUBLE), 0) AS w FROM st JOIN rw USING (day) LEFT JOIN orw USING (day) LEFT JOIN dd USING (day))
SELECT day AS as_of_date, c AS cet1_capital, c + m AS tier1_capital, c + m + s AS total_capital, w AS total_rwa, c / nullif(w, 0) AS cet1_ratio, (c + m) / nullif(w, 0) AS tier1_ratio, (c + m + s) / nullif(w, 0) AS total_capital_ratio, CAST({MINIMUM} AS DOUBLE) + CAST({CONSERVATION} AS DOUBLE) AS minimum_requirement,
c / nullif(w, 0) - (CAST({MINIMUM} AS DOUBLE) + CAST({CONSERVATION} AS DOUBLE)) AS buffer_surplus FROM k""")
def capital_adequacy_daily(spark: SparkSession, d: str) -> DataFrame:
    """Each day's capital by quality, after deductions, over its weighted assets, and what the first ratio leaves above the minimum and buffer."""
    o = table(spark, d, "orders").withColumn("cents", _cents("o_totalprice"))
    of = lambda s: F.sum(F.when(F.col("o_orderstatus") == s, F.col("cents")).otherwise(0))
    st = o.groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(of("F").alias("core"), of("O").alias("more"), of("P").alias("second"))
    by_day = table(spark, d, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("day"))
    amounts = by_day.agg(F.sum(F.when(F.col("l_linenumber") == 1, F.round("l_quantity").cast("long"))).alias("other"), F.sum(F.when(F.col("l_returnflag") == "R", F.round("l_extendedprice").cast("long"))).alias("taken"))
    rw = weighted(spark, d).groupBy("day").agg(F.sum(F.col("net") * F.col("weight")).alias("credit"))
    k = st.join(rw, "day").join(amounts, "day", "left")
    k = k.select("day", (F.col("core") - F.coalesce("taken", F.lit(0))).cast("double").alias("c"), F.col("more").cast("double").alias("m"), F.col("second").cast("double").alias("s"), (F.col("credit").cast("double") / 100 + F.coalesce((F.col("other") * 1000).cast("double"), F.lit(0.0))).alias("total_rwa"))
    k = k.select("day", "total_rwa", (F.col("c") / 100).alias("cet1_capital"), (F.col("c") / 100 + F.col("m") / 100).alias("tier1_capital"), (F.col("c") / 100 + F.col("m") / 100 + F.col("s") / 100).alias("total_capital"))
    for name, part in (("cet1_ratio", "cet1_capital"), ("tier1_ratio", "tier1_capital"), ("total_capital_ratio", "total_capital")):
        k = k.withColumn(name, F.col(part) / F.nullif(F.col("total_rwa"), F.lit(0.0)))
    return k.withColumnRenamed("day", "as_of_date").withColumns({"minimum_requirement": F.lit(MINIMUM) + F.lit(CONSERVATION), "buffer_surplus": F.col("cet1_ratio") - (F.lit(MINIMUM) + F.lit(CONSERVATION))})


@_add(f"""WITH {_DEPOSIT}, lv(flag, level, haircut) AS (VALUES {_values(LEVELS)}), ro(segment, insured, rate) AS (VALUES {_values(RUNOFF)}), ir(product, rate) AS (VALUES {_values(INFLOWS)}),
hq AS (SELECT CAST(l_shipdate AS DATE) AS day, level, sum(CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - haircut)) AS v FROM lineitem JOIN lv ON flag = l_returnflag WHERE l_linestatus = 'O' GROUP BY 1, 2),
st AS (SELECT day, CAST(coalesce(sum(v) FILTER (WHERE level = 'LEVEL_1'), 0) AS DOUBLE) / 10000 AS a, CAST(coalesce(sum(v) FILTER (WHERE level = 'LEVEL_2A'), 0) AS DOUBLE) / 10000 AS b, CAST(coalesce(sum(v) FILTER (WHERE level = 'LEVEL_2B'), 0) AS DOUBLE) / 10000 AS c FROM hq GROUP BY 1),
ot AS (SELECT day, CAST(sum(balance * rate) AS DOUBLE) / 100 AS o FROM deposit d JOIN ro ON ro.segment = d.segment AND ro.insured = (plan <= 3) GROUP BY 1),
inn AS (SELECT CAST(l_shipdate AS DATE) AS day, sum(least(CAST(round(l_extendedprice * 100) AS BIGINT) // 10 + 5000, CAST(round(l_extendedprice * 100) AS BIGINT)) * rate) AS i FROM lineitem JOIN ir ON product = l_suppkey % 4 WHERE l_partkey % 120 <= 30 GROUP BY 1),
k AS (SELECT day, a, least(b, (a + b) * 0.4::DOUBLE) AS b, least(c, (a + b + c) * 0.15::DOUBLE) AS c, o, least(coalesce(CAST(i AS DOUBLE) / 10000, 0), o * 0.75::DOUBLE) AS i FROM st JOIN ot USING (day) LEFT JOIN inn USING (day))
SELECT day AS as_of_date, a AS level1_hqla, b AS level2a_hqla, c AS level2b_hqla, a + b + c AS total_hqla, o AS stressed_outflows, i AS stressed_inflows, o - i AS net_cash_outflows, (a + b) / nullif(o - i, 0) AS lcr_ratio, (a + b) / nullif(o - i, 0) - {COVERAGE}::DOUBLE AS lcr_surplus FROM k""")
def liquidity_coverage_daily(spark: SparkSession, d: str) -> DataFrame:
    """Each day's liquid assets after haircuts and caps, over what runs off less what comes in, at most three quarters of it."""
    lines = table(spark, d, "lineitem").withColumns({"day": F.col("l_shipdate").cast("date"), "cents": _cents("l_extendedprice")})
    held = lines.where("l_linestatus = 'O'").join(_rows(spark, LEVELS, "l_returnflag string, level string, haircut int"), "l_returnflag")
    level = lambda n: F.coalesce(F.sum(F.when(F.col("level") == n, F.col("cents") * (100 - F.col("haircut")))), F.lit(0)).cast("double") / 10000
    st = held.groupBy("day").agg(level("LEVEL_1").alias("a"), level("LEVEL_2A").alias("b"), level("LEVEL_2B").alias("c"))
    gone = deposits(spark, d).withColumn("insured", F.col("plan") <= 3).join(_rows(spark, RUNOFF, "segment string, insured boolean, rate int"), ["segment", "insured"])
    gone = gone.groupBy("day").agg((F.sum(F.col("balance") * F.col("rate")).cast("double") / 100).alias("o"))
    come = lines.where("l_partkey % 120 <= 30").withColumn("product", (F.col("l_suppkey") % 4).cast("int")).join(_rows(spark, INFLOWS, "product int, rate int"), "product")
    come = come.groupBy("day").agg((F.sum(F.least(F.expr("cents div 10 + 5000"), F.col("cents")) * F.col("rate")).cast("double") / 10000).alias("i"))
    k = st.join(gone, "day").join(come, "day", "left")
    b, c = F.least(F.col("b"), (F.col("a") + F.col("b")) * 0.4), F.least(F.col("c"), (F.col("a") + F.col("b") + F.col("c")) * 0.15)
    k = k.select("day", "a", b.alias("b"), c.alias("c"), "o", F.least(F.coalesce("i", F.lit(0.0)), F.col("o") * 0.75).alias("i")).withColumn("net", F.col("o") - F.col("i"))
    ratio = (F.col("a") + F.col("b")) / F.nullif(F.col("net"), F.lit(0.0))
    return k.select(
        F.col("day").alias("as_of_date"), F.col("a").alias("level1_hqla"), F.col("b").alias("level2a_hqla"), F.col("c").alias("level2b_hqla"), (F.col("a") + F.col("b") + F.col("c")).alias("total_hqla"), F.col("o").alias("stressed_outflows"),
        F.col("i").alias("stressed_inflows"), F.col("net").alias("net_cash_outflows"), ratio.alias("lcr_ratio"), (ratio - COVERAGE).alias("lcr_surplus"),
    )
