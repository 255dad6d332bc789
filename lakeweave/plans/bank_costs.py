"""Bank-finance statements on cost allocation, provisions, capital and liquidity, over the tables of `bank`.

Each is written twice: with the DataFrame API, and as DuckDB SQL. Nations are cost centres; the first five are service
centres, which customers use by the remainder of their key. Money is summed as decimals; results are rounded doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeweave.operators.cut import cut
from lakeweave.plans.bank import _DEP, _LOAN, _MONTH, SHOCKS, _rows, _share, _values, accounts, deposits, loans
from lakeweave.sources.tables import MONEY, table

# Service centres, rounds and least amount of the reciprocal method; weights, haircuts and fees by class.
SERVICES, ROUNDS, LEAST = 5, 10, 1.0
WEIGHTS = [("AUTOMOBILE", 0.75), ("BUILDING", 0.5), ("FURNITURE", 1.0), ("MACHINERY", 1.0)]
UNRATED = 1.5
SENSITIVITY = [("AUTOMOBILE", 0.4), ("BUILDING", 0.6), ("FURNITURE", 0.3), ("HOUSEHOLD", 0.5), ("MACHINERY", 0.2)]
FEES = [("F", 3), ("O", 5), ("P", 4)]
QUERIES, SQL = {}, {}


def _add(sql: str):
    def keep(f):
        QUERIES[f"bank_{f.__name__}"], SQL[f"bank_{f.__name__}"] = f, sql
        return f

    return keep


def _pools(spark: SparkSession, d: str) -> DataFrame:
    """(source, amount): what each service centre costs."""
    return loans(spark, d).groupBy((F.col("centre") % SERVICES).cast("int").alias("source")).agg(F.sum("income").cast("double").alias("amount"))


def _drivers(spark: SparkSession, d: str) -> DataFrame:
    """(source, target, share): how much of a service centre each other centre uses; at most 5 x 25 rows."""
    use = table(spark, d, "customer").select((F.col("c_custkey") % SERVICES).cast("int").alias("source"), F.col("c_nationkey").cast("int").alias("target")).where("source <> target")
    use = use.groupBy("source", "target").agg(F.count("*").alias("n"))
    return use.select("source", "target", _share(F.col("n"), F.sum("n").over(Window.partitionBy("source"))).alias("share"))


_POOL = f"pool AS (SELECT CAST(centre % {SERVICES} AS INTEGER) AS source, CAST(sum(income) AS DOUBLE) AS amount FROM loan GROUP BY 1)"
_DRIVER = f"""used AS (SELECT CAST(c_custkey % {SERVICES} AS INTEGER) AS source, CAST(c_nationkey AS INTEGER) AS target, count(*) AS n FROM customer WHERE c_custkey % {SERVICES} <> c_nationkey GROUP BY 1, 2),
driver AS (SELECT source, target, CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY source) AS DOUBLE) AS share FROM used)"""


@_add(f"WITH {_LOAN}, {_POOL}, {_DRIVER} SELECT source, target, round(amount * share, 2) AS amount FROM pool JOIN driver USING (source)")
def driver_allocation(spark: SparkSession, d: str) -> DataFrame:
    """Each service centre's cost over the other centres by their use of it."""
    return _pools(spark, d).join(F.broadcast(_drivers(spark, d)), "source").select("source", "target", F.round(F.col("amount") * F.col("share"), 2).alias("amount"))


def _step_sql() -> str:
    flows = [f"f0 AS (SELECT 1 AS step, source, target, amount * share AS amount FROM pool JOIN driver USING (source) WHERE source = 0)"]
    for k in range(1, SERVICES):
        flows.append(f"f{k} AS (SELECT {k + 1} AS step, source, target, (amount + coalesce((SELECT sum(amount) FROM f{k - 1} WHERE target = {k}), 0)) * share AS amount FROM pool JOIN driver USING (source) WHERE source = {k})")
    union = " UNION ALL ".join(f"SELECT step, source, target, round(amount, 2) AS amount FROM f{k}" for k in range(SERVICES))
    return f"WITH {_LOAN}, {_POOL}, {_DRIVER}, {', '.join(flows)} {union}"


@_add(_step_sql())
def step_down(spark: SparkSession, d: str) -> DataFrame:
    """Service centres pass their cost on in order of rank, each with what the step just before gave it."""
    pools, drivers = cut(_pools(spark, d)), cut(_drivers(spark, d))
    flows, out = None, None
    for k in range(SERVICES):
        step = pools.where(F.col("source") == k)
        if flows is not None:
            got = flows.where(F.col("target") == k).agg(F.sum("amount").alias("got"))
            step = step.crossJoin(F.broadcast(got)).select("source", (F.col("amount") + F.coalesce("got", F.lit(0.0))).alias("amount"))
        flows = step.join(drivers, "source").select(F.lit(k + 1).alias("step"), "source", "target", (F.col("amount") * F.col("share")).alias("amount"))
        out = flows if out is None else out.unionByName(flows)
    return out.select("step", "source", "target", F.round("amount", 2).alias("amount"))


def _round_sql() -> str:
    rounds = ["r0 AS (SELECT 0 AS round_no, source AS centre, amount FROM pool)"]
    rounds += [f"r{k} AS (SELECT {k} AS round_no, target AS centre, sum(amount * share) AS amount FROM r{k - 1} JOIN driver ON source = centre WHERE abs(amount) > {LEAST} GROUP BY target)" for k in range(1, ROUNDS + 1)]
    union = " UNION ALL ".join(f"SELECT * FROM r{k}" for k in range(1, ROUNDS + 1))
    return f"""WITH {_LOAN}, {_POOL}, {_DRIVER}, {', '.join(rounds)}, u AS ({union})
SELECT round_no, centre, round(amount, 2) AS amount, round(sum(amount) OVER (PARTITION BY centre ORDER BY round_no ROWS UNBOUNDED PRECEDING), 2) AS cumulative FROM u"""


@_add(_round_sql())
def reciprocal(spark: SparkSession, d: str) -> DataFrame:
    """Service centres serve each other: costs go round until a centre's part is at most 1, ten rounds at most."""
    drivers = cut(_drivers(spark, d))
    now, out = _pools(spark, d).select(F.col("source").alias("centre"), "amount"), None
    for k in range(1, ROUNDS + 1):
        moved = now.where(F.abs("amount") > LEAST).join(F.broadcast(drivers), F.col("source") == F.col("centre"))  # 125 rows at most
        now = cut(moved.groupBy(F.col("target").alias("centre")).agg(F.sum(F.col("amount") * F.col("share")).alias("amount")))
        named = now.select(F.lit(k).alias("round_no"), "centre", "amount")
        out = named if out is None else out.unionByName(named)
    sofar = Window.partitionBy("centre").orderBy("round_no").rowsBetween(Window.unboundedPreceding, 0)
    return out.select("round_no", "centre", F.round("amount", 2).alias("amount"), F.round(F.sum("amount").over(sofar), 2).alias("cumulative"))


@_add(f"""WITH {_LOAN}, {_POOL}, {_DRIVER}, a AS (SELECT source, sum(amount * share) AS allocated FROM pool JOIN driver USING (source) GROUP BY 1)
SELECT source, round(amount, 2) AS pool, round(coalesce(allocated, 0), 2) AS allocated, CASE WHEN abs(amount - coalesce(allocated, 0)) <= 1 THEN 'TIED' WHEN allocated IS NULL THEN 'MISSING' ELSE 'OPEN' END AS status FROM pool LEFT JOIN a USING (source)""")
def tie_out(spark: SparkSession, d: str) -> DataFrame:
    """Whether each pool was given out whole, within one unit."""
    pools = _pools(spark, d)
    given = pools.join(F.broadcast(_drivers(spark, d)), "source").groupBy("source").agg(F.sum(F.col("amount") * F.col("share")).alias("allocated"))
    far = F.abs(F.col("amount") - F.coalesce("allocated", F.lit(0.0)))
    status = F.when(far <= 1, "TIED").when(F.col("allocated").isNull(), "MISSING").otherwise("OPEN")
    return pools.join(given, "source", "left").select("source", F.round("amount", 2).alias("pool"), F.round(F.coalesce("allocated", F.lit(0.0)), 2).alias("allocated"), status.alias("status"))


@_add(f"""WITH {_LOAN}, s AS (SELECT centre, {_MONTH} AS month, sum(principal) AS cost, count(DISTINCT loan) AS n FROM loan GROUP BY 1, 2)
SELECT centre, month, CAST(cost AS DOUBLE) AS cost, CAST(cost AS DOUBLE) / CAST(sum(cost) OVER (PARTITION BY month) AS DOUBLE) AS share, CAST(cost AS DOUBLE) / nullif(n, 0) AS per_head FROM s""")
def personnel_cost(spark: SparkSession, d: str) -> DataFrame:
    """A centre's cost by month, its share of the month and its cost a head. Months are joined, as one may hold all centres."""
    s = loans(spark, d).groupBy("centre", F.trunc("day", "month").alias("month")).agg(F.sum("principal").alias("cost"), F.countDistinct("loan").alias("n"))
    s = s.join(s.groupBy("month").agg(F.sum("cost").alias("total")), "month")
    return s.select("centre", "month", F.col("cost").cast("double"), _share(F.col("cost"), F.col("total")).alias("share"), _share(F.col("cost"), F.col("n")).alias("per_head"))


_STAGE = """g AS (SELECT loan, line, centre, day, principal, income, CASE WHEN lost OR due - day >= 90 THEN 3 WHEN due - day >= 30 OR income * 100 >= principal * 9 OR loan % 50 = 0 THEN 2 ELSE 1 END AS stage,
CASE WHEN lost THEN 'LOSS' WHEN due - day >= 90 THEN 'DPD90' WHEN due - day >= 30 THEN 'DPD30' WHEN income * 100 >= principal * 9 THEN 'PD' WHEN loan % 50 = 0 THEN 'WATCH' ELSE 'NONE' END AS cause FROM loan)"""


def _staged(spark: SparkSession, d: str) -> DataFrame:
    """loans with stage (1 to 3) and the first cause that holds."""
    days, dear, watched = F.datediff("due", "day"), F.col("income") * 100 >= F.col("principal") * 9, F.col("loan") % 50 == 0
    stage = F.when(F.col("lost") | (days >= 90), 3).when((days >= 30) | dear | watched, 2).otherwise(1)
    cause = F.when(F.col("lost"), "LOSS").when(days >= 90, "DPD90").when(days >= 30, "DPD30").when(dear, "PD").when(watched, "WATCH").otherwise("NONE")
    return loans(spark, d).withColumn("stage", stage).withColumn("cause", cause)


@_add(f"WITH {_LOAN}, {_STAGE} SELECT stage, cause, count(*) AS n, CAST(sum(principal) AS DOUBLE) AS principal FROM g GROUP BY 1, 2")
def loss_stages(spark: SparkSession, d: str) -> DataFrame:
    """Loans by stage and by the cause that put them there."""
    return _staged(spark, d).groupBy("stage", "cause").agg(F.count("*").alias("n"), F.sum("principal").cast("double").alias("principal"))


@_add(f"""WITH {_LOAN}, {_STAGE}, e AS (SELECT stage, {_MONTH} AS month, CAST(sum(principal) AS DOUBLE) AS drawn, CAST(sum(income) AS DOUBLE) AS undrawn FROM g GROUP BY 1, 2),
x AS (SELECT stage, month, drawn + 0.4 * undrawn AS exposure, CASE stage WHEN 1 THEN 0.01 WHEN 2 THEN 0.08 ELSE 1.0 END AS pd, greatest(0.45 - undrawn / nullif(drawn, 0), 0.1) AS lgd, CASE stage WHEN 1 THEN 12 ELSE 36 END AS horizon FROM e)
SELECT stage, month, round(exposure, 6) AS exposure, round(exposure * pd * lgd / power(1 + 0.03 / 12, horizon), 6) AS provision FROM x""")
def provision(spark: SparkSession, d: str) -> DataFrame:
    """Exposure times probability times loss, discounted over 12 months in stage 1 and 36 in the others."""
    e = _staged(spark, d).groupBy("stage", F.trunc("day", "month").alias("month")).agg(F.sum("principal").cast("double").alias("drawn"), F.sum("income").cast("double").alias("undrawn"))
    exposure, pd = F.col("drawn") + 0.4 * F.col("undrawn"), F.when(F.col("stage") == 1, 0.01).when(F.col("stage") == 2, 0.08).otherwise(1.0)
    lgd = F.greatest(0.45 - _share(F.col("undrawn"), F.col("drawn")), F.lit(0.1))
    loss = exposure * pd * lgd / F.pow(F.lit(1 + 0.03 / 12), F.when(F.col("stage") == 1, 12).otherwise(36))
    return e.select("stage", "month", F.round(exposure, 6).alias("exposure"), F.round(loss, 6).alias("provision"))


@_add(f"""WITH {_LOAN}, {_STAGE}, m AS (SELECT centre, {_MONTH} AS month, max(stage) AS stage, sum(principal) AS amount FROM g GROUP BY 1, 2),
l AS (SELECT *, lag(stage) OVER (PARTITION BY centre ORDER BY month) AS before FROM m)
SELECT month, stage, count(CASE WHEN before IS NULL THEN 1 END) AS fresh, count(CASE WHEN before < stage THEN 1 END) AS worse, count(CASE WHEN before > stage THEN 1 END) AS better, CAST(sum(amount) AS DOUBLE) AS amount FROM l GROUP BY 1, 2""")
def stage_movement(spark: SparkSession, d: str) -> DataFrame:
    """How many borrowers came new, got worse or got better, by month and stage."""
    m = _staged(spark, d).groupBy("centre", F.trunc("day", "month").alias("month")).agg(F.max("stage").alias("stage"), F.sum("principal").alias("amount"))
    m = m.withColumn("before", F.lag("stage").over(Window.partitionBy("centre").orderBy("month")))
    return m.groupBy("month", "stage").agg(F.count_if(F.col("before").isNull()).alias("fresh"), F.count_if(F.col("before") < F.col("stage")).alias("worse"), F.count_if(F.col("before") > F.col("stage")).alias("better"), F.sum("amount").cast("double").alias("amount"))


_FEE = f"""f(status, fee) AS (VALUES {_values(FEES)}), charged AS (SELECT o_custkey AS account, 'order' AS kind, fee FROM orders JOIN f ON status = o_orderstatus
UNION ALL SELECT o_custkey, 'return', 2 FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'
UNION ALL SELECT o_custkey, 'urgent', 7 FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT c_custkey, 'low balance', 12 FROM customer WHERE c_acctbal < 0)"""


def _fees(spark: SparkSession, d: str) -> DataFrame:
    """(account, kind, fee) of four sources."""
    orders = table(spark, d, "orders")
    shape = lambda df, key, kind, fee: df.select(F.col(key).alias("account"), F.lit(kind).alias("kind"), fee.alias("fee"))
    out = shape(orders.join(_rows(spark, FEES, "status string, fee int"), F.col("status") == F.col("o_orderstatus")), "o_custkey", "order", F.col("fee"))
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    out = out.unionByName(shape(returned, "o_custkey", "return", F.lit(2))).unionByName(shape(orders.where("o_orderpriority = '1-URGENT'"), "o_custkey", "urgent", F.lit(7)))
    return out.unionByName(shape(table(spark, d, "customer").where("c_acctbal < 0"), "c_custkey", "low balance", F.lit(12)))


@_add(f"""WITH {_FEE} SELECT kind, count(*) AS n, CAST(sum(fee) AS BIGINT) AS charged, CAST(sum(CASE WHEN account % 10 = 0 THEN fee ELSE 0 END) AS BIGINT) AS waived, CAST(sum(CASE WHEN account % 10 = 0 THEN 0 ELSE fee END) AS BIGINT) AS income FROM charged GROUP BY 1""")
def fee_income(spark: SparkSession, d: str) -> DataFrame:
    """Fees of four sources, less what is waived for every tenth account."""
    waived = F.when(F.col("account") % 10 == 0, F.col("fee")).otherwise(0)
    return _fees(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.sum("fee").alias("charged"), F.sum(waived).alias("waived"), F.sum(F.col("fee") - waived).alias("income"))


@_add(f"""WITH {_DEP}, {_LOAN}, {_FEE}, p AS (SELECT account, sum(balance) AS balance FROM dep GROUP BY 1), q AS (SELECT o_custkey AS account, sum(income) AS income, count(DISTINCT centre) AS products FROM loan JOIN orders ON o_orderkey = loan GROUP BY 1), r AS (SELECT account, sum(fee) AS fees FROM charged GROUP BY 1)
SELECT account, segment, round(coalesce(CAST(p.balance AS DOUBLE), 0) * 0.01, 6) AS deposit_revenue, round(coalesce(CAST(q.income AS DOUBLE), 0), 4) AS loan_revenue, CAST(coalesce(r.fees, 0) AS BIGINT) AS fees, coalesce(q.products, 0) AS products
FROM acc LEFT JOIN p USING (account) LEFT JOIN q USING (account) LEFT JOIN r USING (account)""")
def customer_revenue(spark: SparkSession, d: str) -> DataFrame:
    """A customer's revenue from deposits, loans and fees, and from how many centres they borrow."""
    owner = table(spark, d, "orders").select(F.col("o_orderkey").alias("loan"), F.col("o_custkey").alias("account"))
    held = deposits(spark, d).groupBy("account").agg(F.sum("balance").cast("double").alias("balance"))
    lent = loans(spark, d).join(owner, "loan").groupBy("account").agg(F.sum("income").cast("double").alias("income"), F.countDistinct("centre").alias("products"))
    paid = _fees(spark, d).groupBy("account").agg(F.sum("fee").alias("fees"))
    all_ = accounts(spark, d).join(held, "account", "left").join(lent, "account", "left").join(paid, "account", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return all_.select("account", "segment", F.round(zero("balance") * 0.01, 6).alias("deposit_revenue"), F.round(zero("income"), 4).alias("loan_revenue"), zero("fees").cast("long").alias("fees"), zero("products").cast("long").alias("products"))


_NET = f"x AS (SELECT segment, greatest(balance - CAST(c_acctbal AS DECIMAL(18,2)), 0) AS net FROM (SELECT account, sum(balance) AS balance FROM dep GROUP BY 1) JOIN acc USING (account) JOIN customer ON c_custkey = account), w(segment, weight) AS (VALUES {_values(WEIGHTS)})"


def _net(spark: SparkSession, d: str) -> DataFrame:
    """(segment, net): each account's exposure less its collateral, not under zero."""
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("account"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").cast(MONEY).alias("collateral"))
    held = deposits(spark, d).groupBy("account").agg(F.sum("balance").alias("balance")).join(customer, "account")
    return held.select("segment", F.greatest(F.col("balance") - F.col("collateral"), F.lit(0)).alias("net"))


@_add(f"""WITH {_DEP}, {_NET} SELECT x.segment, CAST(sum(net) AS DOUBLE) AS net, coalesce(min(weight), {UNRATED}) AS weight, round(CAST(sum(net) AS DOUBLE) * coalesce(min(weight), {UNRATED}), 6) AS weighted FROM x LEFT JOIN w ON w.segment = x.segment GROUP BY 1""")
def weighted_assets(spark: SparkSession, d: str) -> DataFrame:
    """Exposures net of collateral, times the weight of their class; classes without one get that of the unrated."""
    per = _net(spark, d).groupBy("segment").agg(F.sum("net").cast("double").alias("net")).join(_rows(spark, WEIGHTS, "segment string, weight double"), "segment", "left")
    weight = F.coalesce("weight", F.lit(UNRATED))
    return per.select("segment", "net", weight.alias("weight"), F.round(F.col("net") * weight, 6).alias("weighted"))


@_add(f"""WITH {_DEP}, {_LOAN}, {_NET}, a AS (SELECT sum(n * coalesce(weight, {UNRATED})) AS weighted FROM (SELECT segment, CAST(sum(net) AS DOUBLE) AS n FROM x GROUP BY 1) y LEFT JOIN w USING (segment)),
c AS (SELECT CAST(sum(CASE WHEN NOT lost THEN income ELSE 0 END) AS DOUBLE) AS first, CAST(sum(CASE WHEN lost THEN income ELSE 0 END) AS DOUBLE) AS second FROM loan)
SELECT round(first / nullif(weighted, 0), 6) AS core_ratio, round((first + second) / nullif(weighted, 0), 6) AS total_ratio, round((first + second) / nullif(weighted, 0) - 0.105, 6) AS surplus FROM c, a""")
def capital_adequacy(spark: SparkSession, d: str) -> DataFrame:
    """Core and total capital over weighted assets, and what is left above the least total ratio; one row."""
    weight = F.coalesce("weight", F.lit(UNRATED))
    per = _net(spark, d).groupBy("segment").agg(F.sum("net").cast("double").alias("net")).join(_rows(spark, WEIGHTS, "segment string, weight double"), "segment", "left")
    assets = per.agg(F.sum(F.col("net") * weight).alias("weighted"))
    own = loans(spark, d).agg(F.sum(F.when(~F.col("lost"), F.col("income")).otherwise(0)).cast("double").alias("first"), F.sum(F.when(F.col("lost"), F.col("income")).otherwise(0)).cast("double").alias("second"))
    total = _share(F.col("first") + F.col("second"), F.col("weighted"))
    return own.crossJoin(F.broadcast(assets)).select(F.round(_share(F.col("first"), F.col("weighted")), 6).alias("core_ratio"), F.round(total, 6).alias("total_ratio"), F.round(total - 0.105, 6).alias("surplus"))


@_add(f"""WITH {_LOAN}, {_DEP}, h AS (SELECT CAST(coalesce(sum(CASE WHEN line = 1 THEN principal END), 0) AS DOUBLE) AS l1, CAST(coalesce(sum(CASE WHEN line = 2 THEN principal END), 0) AS DOUBLE) * 0.85 AS l2a, CAST(coalesce(sum(CASE WHEN line = 3 THEN principal END), 0) AS DOUBLE) * 0.5 AS l2b, CAST(coalesce(sum(CASE WHEN line > 3 THEN income END), 0) AS DOUBLE) AS inflow FROM loan),
o AS (SELECT CAST(sum(balance) AS DOUBLE) * 0.1 AS outflow FROM dep), k AS (SELECT l1, least(l2a, l1 * 2 / 3) AS l2a, least(l2b, l1 * 15 / 85) AS l2b, outflow - least(inflow, outflow * 0.75) AS net FROM h, o)
SELECT round(l1 + l2a + l2b, 6) AS total_assets, round(net, 6) AS net_outflow, round((l1 + l2a) / nullif(net, 0), 6) AS ratio FROM k""")
def liquidity_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Liquid assets after haircuts and caps over net outflow, inflow counted to three quarters at most; one row.

    The total has level 2B, the ratio's numerator has not.
    """
    part = lambda cond, c: F.coalesce(F.sum(F.when(F.expr(cond), F.col(c))), F.lit(0)).cast("double")
    h = loans(spark, d).agg(part("line = 1", "principal").alias("l1"), (part("line = 2", "principal") * 0.85).alias("a"), (part("line = 3", "principal") * 0.5).alias("b"), part("line > 3", "income").alias("inflow"))
    o = deposits(spark, d).agg((F.sum("balance").cast("double") * 0.1).alias("outflow"))
    a, b, net = F.least("a", F.col("l1") * 2 / 3), F.least("b", F.col("l1") * 15 / 85), F.col("outflow") - F.least("inflow", F.col("outflow") * 0.75)
    return h.crossJoin(F.broadcast(o)).select(F.round(F.col("l1") + a + b, 6).alias("total_assets"), F.round(net, 6).alias("net_outflow"), F.round(_share(F.col("l1") + a, net), 6).alias("ratio"))


@_add(f"""WITH {_DEP}, x(scenario, shock) AS (VALUES {_values(SHOCKS)}), v(segment, beta) AS (VALUES {_values(SENSITIVITY)}), q AS (SELECT segment, CAST(year(day) AS INTEGER) AS year, CAST(sum(balance) AS DOUBLE) AS balance FROM dep JOIN acc USING (account) GROUP BY 1, 2)
SELECT scenario, segment, year, round(balance * 0.02, 6) AS base, round(balance * (0.02 + shock * beta), 6) AS stressed FROM q JOIN v USING (segment), x WHERE year = (SELECT max(year) FROM q)""")
def stressed_income(spark: SparkSession, d: str) -> DataFrame:
    """The last year's income by segment under each scenario."""
    q = deposits(spark, d).join(accounts(spark, d), "account").groupBy("segment", F.year("day").alias("year")).agg(F.sum("balance").cast("double").alias("balance"))
    q = q.join(F.broadcast(q.agg(F.max("year").alias("year"))), "year").join(_rows(spark, SENSITIVITY, "segment string, beta double"), "segment")
    return q.crossJoin(_rows(spark, SHOCKS, "scenario string, shock double")).select("scenario", "segment", "year", F.round(F.col("balance") * 0.02, 6).alias("base"), F.round(F.col("balance") * (0.02 + F.col("shock") * F.col("beta")), 6).alias("stressed"))


@_add("""WITH k AS (SELECT CAST(l_linenumber AS INTEGER) AS tenor, CAST(l_shipdate AS DATE) AS day, l_discount AS quote, row_number() OVER (PARTITION BY l_linenumber, CAST(l_shipdate AS DATE) ORDER BY l_suppkey, l_orderkey, l_discount) AS rn FROM lineitem),
b AS (SELECT tenor, day, CASE WHEN quote < 0.02 THEN NULL ELSE quote END AS quote FROM k WHERE rn = 1), f AS (SELECT tenor, day, coalesce(quote, lag(quote) OVER (PARTITION BY day ORDER BY tenor), 0) AS quote FROM b)
SELECT tenor, day, round(quote, 4) AS rate, round(quote + 0.001 * tenor, 4) AS with_premium, round(1 / power(1 + quote, tenor / 12.0), 6) AS discount FROM f""")
def funds_curve(spark: SparkSession, d: str) -> DataFrame:
    """A day's curve: the quote of the first source of each tenor, gaps filled from the tenor before."""
    q = table(spark, d, "lineitem").select(F.col("l_linenumber").cast("int").alias("tenor"), F.col("l_shipdate").cast("date").alias("day"), F.struct("l_suppkey", "l_orderkey", "l_discount").alias("q"))
    b = q.groupBy("tenor", "day").agg(F.min("q").getField("l_discount").alias("quote")).withColumn("quote", F.when(F.col("quote") >= 0.02, F.col("quote")))
    f = b.withColumn("quote", F.coalesce("quote", F.lag("quote").over(Window.partitionBy("day").orderBy("tenor")), F.lit(0.0)))
    return f.select("tenor", "day", F.round("quote", 4).alias("rate"), F.round(F.col("quote") + 0.001 * F.col("tenor"), 4).alias("with_premium"), F.round(1 / F.pow(1 + F.col("quote"), F.col("tenor") / 12.0), 6).alias("discount"))


@_add(f"""WITH {_LOAN}, e AS (SELECT CAST(sum(principal) AS DOUBLE) AS booked, greatest(CAST(sum(CASE WHEN lost THEN -income ELSE income END) AS DOUBLE), 0) AS derived, CAST(sum(income) AS DOUBLE) AS own FROM loan)
SELECT round(booked + 1.4 * derived, 6) AS exposure, round(own / nullif(booked + 1.4 * derived, 0), 6) AS ratio FROM e""")
def leverage(spark: SparkSession, d: str) -> DataFrame:
    """Own funds over booked and derived exposure; one row."""
    sign = F.when(F.col("lost"), -F.col("income")).otherwise(F.col("income"))
    e = loans(spark, d).agg(F.sum("principal").cast("double").alias("booked"), F.greatest(F.sum(sign).cast("double"), F.lit(0.0)).alias("derived"), F.sum("income").cast("double").alias("own"))
    exposure = F.col("booked") + 1.4 * F.col("derived")
    return e.select(F.round(exposure, 6).alias("exposure"), F.round(_share(F.col("own"), exposure), 6).alias("ratio"))


@_add(f"""WITH {_DEP}, t AS (SELECT segment, account, sum(balance) AS balance FROM dep JOIN acc USING (account) GROUP BY 1, 2), s AS (SELECT segment, sum(balance) AS held FROM t GROUP BY 1), a AS (SELECT sum(balance) AS total FROM t)
SELECT account, segment, CAST(balance AS DOUBLE) AS balance, CASE WHEN CAST(balance AS DOUBLE) > 0.001 * CAST(total AS DOUBLE) THEN 'NAME' WHEN CAST(held AS DOUBLE) > 0.2 * CAST(total AS DOUBLE) THEN 'SECTOR' ELSE 'NONE' END AS breach FROM t JOIN s USING (segment), a""")
def limit_breaches(spark: SparkSession, d: str) -> DataFrame:
    """Accounts over the limit for one name, or in a segment over the limit for a sector."""
    t = deposits(spark, d).groupBy("account").agg(F.sum("balance").alias("balance")).join(accounts(spark, d), "account")
    s = t.groupBy("segment").agg(F.sum("balance").alias("held"))
    all_ = t.join(s, "segment").crossJoin(F.broadcast(s.agg(F.sum("held").alias("total"))))
    of = lambda share: share * F.col("total").cast("double")
    breach = F.when(F.col("balance").cast("double") > of(0.001), "NAME").when(F.col("held").cast("double") > of(0.2), "SECTOR").otherwise("NONE")
    return all_.select("account", "segment", F.col("balance").cast("double"), breach.alias("breach"))
