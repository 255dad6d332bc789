"""Bank-finance statements from interest to profit: attribution, margin, expenses, pools, results, capital and return.

All stand on two tables of lines derived from lineitem and orders. Each is written twice: with the DataFrame API, and as
DuckDB SQL. Nations are cost centres and branches, regions lines of business. Each month is one accounting period. Money
is summed as decimals of four places; only shares and rates are computed as doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeweave.operators.ranking import ranked, tile
from lakeweave.plans.bank import _rows, _values
from lakeweave.sources.tables import MONEY, table

# Products (number, name, segment), expense accounts and their category, cost pools by type of centre
# (type, pool, basis, part that is retained in hundredths), tax by year, capital multipliers, hurdle rates by region.
PRODUCTS = [(1, "CURRENT", "RETAIL"), (2, "SAVINGS", "RETAIL"), (3, "TERM", "PRIVATE"), (4, "TRADE", "CORPORATE"), (5, "PROJECT", "CORPORATE")]
ACCOUNTS = [(1, "STAFF"), (2, "OCCUPANCY"), (3, "TECHNOLOGY"), (4, "OCCUPANCY"), (5, "MARKETING")]
POOLS = [(0, "SUPPORT", "P-SUP", "HEADCOUNT", 0.0), (1, "OVERHEAD", "P-OVH", "BLENDED", 0.125), (2, "TECHNOLOGY", "P-TEC", "USAGE", 0.0)]
TAX, RECEIVER = 0.25, 3
CREDIT, MARKET, OPERATIONAL = 0.08, 0.03, 0.15
REGIONS = [(0, 0.75, 0.10), (1, 0.8, 0.11), (2, 0.85, 0.12), (3, 0.7, 0.09), (4, 0.9, 0.13)]
UNIT_COST = [("click", 2), ("view", 1), ("purchase", 5), ("signup", 4), ("error", 3)]
EXACT = "decimal(32,4)"
QUERIES, SQL = {}, {}

_CTES = {
    "ln": (
        [], f"SELECT CAST(l_shipdate AS DATE) AS day, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, CAST((l_linenumber - 1) % 5 + 1 AS INTEGER) AS product, CAST(s_nationkey AS INTEGER) AS nation, l_suppkey AS supplier, l_orderkey AS loan, CAST(l_linenumber AS INTEGER) AS line, l_linestatus AS posted, l_returnflag AS flag, CAST(l_quantity AS BIGINT) AS quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS principal, CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS income, CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)) AS fee, CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(0.02 AS DECIMAL(4,2)) AS provision FROM lineitem JOIN supplier ON s_suppkey = l_suppkey",
    ),
    "dp": (
        [], "SELECT CAST(o_orderdate AS DATE) AS day, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS product, CAST(c_nationkey AS INTEGER) AS nation, o_custkey AS account, CAST(o_totalprice AS DECIMAL(18,2)) AS balance, CAST(o_totalprice AS DECIMAL(18,2)) * CAST(CAST(substr(o_orderpriority, 1, 1) AS INTEGER) * 0.01 AS DECIMAL(4,2)) AS expense FROM orders JOIN customer ON c_custkey = o_custkey",
    ),
    "place": ([], "SELECT CAST(n_nationkey AS INTEGER) AS nation, n_name AS name, CAST(n_regionkey AS INTEGER) AS lob, CAST(n_nationkey % 4 AS INTEGER) AS kind FROM nation"),
    "nii": (
        ["ln", "dp"],
        """SELECT coalesce(a.day, b.day) AS day, coalesce(a.month, b.month) AS month, coalesce(a.product, b.product) AS product, coalesce(a.nation, b.nation) AS nation, coalesce(assets, 0) AS assets, coalesce(income, 0) AS income, coalesce(liabilities, 0) AS liabilities, coalesce(expense, 0) AS expense
FROM (SELECT day, month, product, nation, sum(principal) AS assets, sum(income) AS income FROM ln GROUP BY ALL) a FULL JOIN (SELECT day, month, product, nation, sum(balance) AS liabilities, sum(expense) AS expense FROM dp GROUP BY ALL) b ON a.day = b.day AND a.product = b.product AND a.nation = b.nation""",
    ),
    "fees": (["ln"], "SELECT month, product, nation, sum(CASE WHEN flag = 'A' THEN 0 ELSE fee END) AS fee FROM ln GROUP BY ALL"),
    "monthly": (["nii"], "SELECT month, product, CAST(sum(assets) AS DOUBLE) / count(*) AS balance, sum(income) - sum(expense) AS nii FROM nii GROUP BY ALL"),
    "revenue": (
        ["monthly", "fees"],
        "SELECT coalesce(m.month, f.month) AS month, coalesce(m.product, f.product) AS product, coalesce(nii, 0) AS nii, coalesce(fee, 0) AS fee, balance FROM monthly m FULL JOIN (SELECT month, product, sum(fee) AS fee FROM fees GROUP BY ALL) f ON f.month = m.month AND f.product = m.product",
    ),
    "posted": (["ln"], "SELECT month, nation, line, sum(income - CASE WHEN flag = 'A' THEN fee ELSE 0 END) AS net FROM ln WHERE posted = 'F' AND line <= 5 GROUP BY ALL"),
    "struck": (["ln"], "SELECT month, nation, line, sum(income) AS struck FROM ln WHERE flag = 'N' AND line IN (2, 4) GROUP BY ALL"),
    "direct": (["posted", "struck"], f"SELECT p.month, p.nation, p.line, category, net, coalesce(struck, 0) AS struck, net - coalesce(struck, 0) AS direct FROM posted p JOIN (VALUES {_values(ACCOUNTS)}) a(line, category) ON a.line = p.line LEFT JOIN struck s ON s.month = p.month AND s.nation = p.nation AND s.line = p.line"),
    "staff": (["dp"], "SELECT month, nation, count(DISTINCT account) AS fte, count(*) * 1500 AS cost FROM dp GROUP BY ALL"),
    "invoiced": (["ln"], "SELECT month, supplier, sum(fee) AS invoiced FROM ln WHERE line >= 6 GROUP BY ALL"),
    "prepaid": (["ln"], "SELECT m.month, s_suppkey AS supplier, 100 + s_suppkey % 50 AS part FROM supplier JOIN (SELECT DISTINCT month FROM ln) m ON m.month >= CAST(DATE '1995-01-01' + to_months(CAST(s_suppkey % 24 AS INTEGER)) AS DATE) AND m.month <= CAST(DATE '1995-01-01' + to_months(CAST(s_suppkey % 24 AS INTEGER) + 35) AS DATE) WHERE s_suppkey % 3 = 0"),
    "accrued": (["invoiced"], "SELECT CAST(month + INTERVAL 1 MONTH AS DATE) AS month, supplier, invoiced AS accrued FROM invoiced WHERE supplier % 4 = 0"),
    "vendor": (
        ["invoiced", "prepaid", "accrued"],
        """SELECT month, supplier, CAST(s_nationkey AS INTEGER) AS nation, coalesce(invoiced, 0) AS invoiced, coalesce(part, 0) AS prepaid, -coalesce(accrued, 0) AS trueup, coalesce(invoiced, 0) + coalesce(part, 0) - coalesce(accrued, 0) AS recognised
FROM invoiced FULL JOIN prepaid USING (month, supplier) FULL JOIN accrued USING (month, supplier) JOIN supplier ON s_suppkey = supplier""",
    ),
    "pools": (
        ["direct", "staff", "vendor", "place"],
        f"""SELECT month, nation, type, pool, basis, retained, sum(amount) AS amount FROM (SELECT month, nation, sum(direct) AS amount FROM direct GROUP BY ALL UNION ALL SELECT month, nation, CAST(cost AS DECIMAL(32,4)) FROM staff UNION ALL SELECT month, nation, sum(recognised) FROM vendor GROUP BY ALL)
JOIN place USING (nation) JOIN (VALUES {_values(POOLS)}) k(kind, type, pool, basis, retained) USING (kind) GROUP BY ALL""",
    ),
    "alloc": (
        ["pools", "staff", "place"],
        f"""SELECT p.month, s.nation, CAST(round(CAST(p.amount AS DOUBLE) * s.fte / s.total, 2) AS DECIMAL(18,2)) AS allocated FROM (SELECT month, sum(amount) AS amount FROM pools WHERE type = 'SUPPORT' GROUP BY ALL) p
JOIN (SELECT month, nation, fte, sum(fte) OVER (PARTITION BY month) AS total FROM staff JOIN place USING (nation) WHERE kind = {RECEIVER}) s ON s.month = p.month""",
    ),
    "risk": (["ln"], "SELECT month, product, nation, sum(CASE WHEN flag = 'R' THEN provision ELSE 0 END) AS provision, sum(principal) AS principal FROM ln GROUP BY ALL"),
    "pnl": (
        ["nii", "fees", "direct", "alloc", "risk", "place"],
        f"""SELECT *, nii + fee AS revenue, direct + allocated AS expenses, nii + fee - direct - allocated AS before_provision, nii + fee - direct - allocated - provision AS before_tax FROM (
SELECT month, lob, n.nii, coalesce(fee, 0) AS fee, coalesce(direct, 0) AS direct, coalesce(allocated, 0) AS allocated, coalesce(provision, 0) AS provision FROM (SELECT month, lob, sum(income - expense) AS nii FROM nii JOIN place USING (nation) GROUP BY ALL) n
LEFT JOIN (SELECT month, lob, sum(fee) AS fee FROM fees JOIN place USING (nation) GROUP BY ALL) f USING (month, lob) LEFT JOIN (SELECT month, lob, sum(direct) AS direct FROM direct JOIN place USING (nation) GROUP BY ALL) d USING (month, lob)
LEFT JOIN (SELECT month, lob, sum(allocated) AS allocated FROM alloc JOIN place USING (nation) GROUP BY ALL) a USING (month, lob) LEFT JOIN (SELECT month, lob, sum(provision) AS provision FROM risk JOIN place USING (nation) GROUP BY ALL) r USING (month, lob))""",
    ),
    "products": ([], f"SELECT * FROM (VALUES {_values(PRODUCTS)}) p(product, name, segment)"),
    "product_pnl": (
        ["revenue", "products", "direct", "alloc", "risk"],
        """SELECT month, product, name, balance, nii, fee, coalesce(direct, 0) AS direct, coalesce(allocated, 0) AS allocated, coalesce(provision, 0) AS provision FROM revenue JOIN products USING (product)
LEFT JOIN (SELECT month, product, sum(direct * ((nation + product) % 3)) AS direct FROM direct, (SELECT product FROM products) GROUP BY ALL) d USING (month, product)
LEFT JOIN (SELECT month, product, sum(allocated * ((nation + product) % 3)) AS allocated FROM alloc, (SELECT product FROM products) GROUP BY ALL) a USING (month, product) LEFT JOIN (SELECT month, product, sum(provision) AS provision FROM risk GROUP BY ALL) r USING (month, product)""",
    ),
    "capital": (
        ["risk", "dp", "fees", "nii", "place"],
        f"""SELECT month, lob, CAST(principal AS DOUBLE) * {CREDIT} AS credit, coalesce(CAST(balance AS DOUBLE), 0) * {MARKET} AS market, coalesce(CAST(fee AS DOUBLE), 0) * {OPERATIONAL} AS operational, coalesce(abs(CAST(gap AS DOUBLE)), 0) AS irrbb FROM (SELECT month, lob, sum(principal) AS principal FROM risk JOIN place USING (nation) GROUP BY ALL) c
LEFT JOIN (SELECT month, lob, sum(balance) AS balance FROM dp JOIN place USING (nation) GROUP BY ALL) m USING (month, lob) LEFT JOIN (SELECT month, lob, sum(fee) AS fee FROM fees JOIN place USING (nation) GROUP BY ALL) o USING (month, lob)
LEFT JOIN (SELECT month, lob, sum(income - expense) AS gap FROM nii JOIN place USING (nation) GROUP BY ALL) i USING (month, lob)""",
    ),
}


def _with(*names: str) -> str:
    """The text of the named CTEs and of those they stand on, in order."""
    seen: list[str] = []

    def visit(name: str) -> None:
        for other in _CTES[name][0]:
            visit(other)
        if name not in seen:
            seen.append(name)

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({_CTES[n][1]})" for n in seen)


def _add(names: str, sql: str):
    def keep(f):
        QUERIES[f"bank_{f.__name__}"], SQL[f"bank_{f.__name__}"] = f, f"{_with(*names.split())}\n{sql}"
        return f

    return keep


def _sum(name: str, condition: Column | None = None) -> Column:
    one = F.col(name) if condition is None else F.when(condition, F.col(name)).otherwise(F.lit(0))
    return F.sum(one).cast(EXACT)


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast(EXACT)


def _out(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("double")


def _ratio(a: Column | str, b: Column | str) -> Column:
    return (F.col(a) if isinstance(a, str) else a).cast("double") / F.nullif((F.col(b) if isinstance(b, str) else b).cast("double"), F.lit(0.0))


def _left(df: DataFrame, other: DataFrame, by: list[str], *amounts: str) -> DataFrame:
    return df.join(other, by, "left").withColumns({a: _zero(a) for a in amounts})


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Loan lines: (day, month, product, nation, supplier, loan, line, posted, flag, quantity, principal, income, fee, provision)"""
    principal = f"CAST(l_extendedprice AS {MONEY})"
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("int").alias("nation"))
    bare = table(spark, d, "lineitem").selectExpr(
        "CAST(l_shipdate AS DATE) AS day", "trunc(CAST(l_shipdate AS DATE), 'month') AS month", "CAST((l_linenumber - 1) % 5 + 1 AS INT) AS product", "l_suppkey AS supplier", "l_orderkey AS loan", "CAST(l_linenumber AS INT) AS line", "l_linestatus AS posted", "l_returnflag AS flag",
        "CAST(l_quantity AS LONG) AS quantity", f"{principal} AS principal", f"{principal} * CAST(l_discount AS DECIMAL(4,2)) AS income", f"{principal} * CAST(l_tax AS DECIMAL(4,2)) AS fee", f"{principal} * CAST(0.02 AS DECIMAL(4,2)) AS provision",
    )
    return bare.join(s, F.col("supplier") == F.col("s_suppkey")).drop("s_suppkey")


def funds(spark: SparkSession, d: str) -> DataFrame:
    """Deposit lines: (day, month, product, nation, account, balance, expense)"""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("int").alias("nation"))
    bare = table(spark, d, "orders").selectExpr("CAST(o_orderdate AS DATE) AS day", "trunc(CAST(o_orderdate AS DATE), 'month') AS month", "CAST(substr(o_orderpriority, 1, 1) AS INT) AS product", "o_custkey AS account", f"CAST(o_totalprice AS {MONEY}) AS balance")
    bare = bare.withColumn("expense", F.expr("balance * CAST(product * 0.01 AS DECIMAL(4,2))"))
    return bare.join(c, F.col("account") == F.col("c_custkey")).drop("c_custkey")


def places(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").selectExpr("CAST(n_nationkey AS INT) AS nation", "n_name AS name", "CAST(n_regionkey AS INT) AS lob", "CAST(n_nationkey % 4 AS INT) AS kind")
    return F.broadcast(n)  # 25 nations


def _products(spark: SparkSession) -> DataFrame:
    return _rows(spark, PRODUCTS, "product int, name string, segment string")


def _by_lob(df: DataFrame, spark: SparkSession, d: str, *amounts: str) -> DataFrame:
    return df.join(places(spark, d), "nation").groupBy("month", "lob").agg(*[_sum(a).alias(a) for a in amounts])


def nii_daily(spark: SparkSession, d: str) -> DataFrame:
    by = ["day", "month", "product", "nation"]
    a = lines(spark, d).groupBy(*by).agg(_sum("principal").alias("assets"), _sum("income").alias("income"))
    b = funds(spark, d).groupBy(*by).agg(_sum("balance").alias("liabilities"), _sum("expense").alias("expense"))
    return a.join(b, by, "full").select(*by, *[_zero(c).alias(c) for c in ("assets", "income", "liabilities", "expense")]).withColumn("nii", (F.col("income") - F.col("expense")).cast(EXACT))


def fees(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).groupBy("month", "product", "nation").agg(_sum("fee", F.col("flag") != "A").alias("fee"))


def _monthly(spark: SparkSession, d: str) -> DataFrame:
    return nii_daily(spark, d).groupBy("month", "product").agg((F.sum("assets").cast("double") / F.count("*")).alias("balance"), _sum("nii").alias("nii"))


def _revenue(spark: SparkSession, d: str) -> DataFrame:
    f = fees(spark, d).groupBy("month", "product").agg(_sum("fee").alias("fee"))
    return _monthly(spark, d).join(f, ["month", "product"], "full").withColumns({"nii": _zero("nii"), "fee": _zero("fee")})


def _direct(spark: SparkSession, d: str) -> DataFrame:
    l = lines(spark, d)  # noqa: E741
    by = ["month", "nation", "line"]
    net = l.where("posted = 'F' AND line <= 5").groupBy(*by).agg((_sum("income") - _sum("fee", F.col("flag") == "A")).cast(EXACT).alias("net"))
    struck = l.where("flag = 'N' AND line IN (2, 4)").groupBy(*by).agg(_sum("income").alias("struck"))
    named = net.join(_rows(spark, ACCOUNTS, "line int, category string"), "line")
    return _left(named, struck, by, "struck").withColumn("direct", (F.col("net") - F.col("struck")).cast(EXACT))


def _staff(spark: SparkSession, d: str) -> DataFrame:
    return funds(spark, d).groupBy("month", "nation").agg(F.countDistinct("account").alias("fte"), (F.count("*") * 1500).alias("cost"))


def _vendor(spark: SparkSession, d: str) -> DataFrame:
    l = lines(spark, d)  # noqa: E741
    invoiced = l.where("line >= 6").groupBy("month", "supplier").agg(_sum("fee").alias("invoiced"))
    start = F.add_months(F.lit("1995-01-01").cast("date"), (F.col("s_suppkey") % 24).cast("int"))
    terms = table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("supplier"), start.alias("start"), (100 + F.col("s_suppkey") % 50).alias("part"))
    months = l.select("month").distinct()
    prepaid = terms.join(F.broadcast(months), (F.col("month") >= F.col("start")) & (F.col("month") <= F.add_months("start", 35))).select("month", "supplier", "part")  # a row a month
    accrued = invoiced.where("supplier % 4 = 0").select(F.add_months("month", 1).alias("month"), "supplier", F.col("invoiced").alias("accrued"))
    both = invoiced.join(prepaid, ["month", "supplier"], "full").join(accrued, ["month", "supplier"], "full")
    both = both.withColumns({c: _zero(c) for c in ("invoiced", "part", "accrued")}).withColumn("recognised", (F.col("invoiced") + F.col("part") - F.col("accrued")).cast(EXACT))
    return both.join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("supplier"), F.col("s_nationkey").cast("int").alias("nation")), "supplier")


def _pooled(spark: SparkSession, d: str) -> DataFrame:
    direct = _direct(spark, d).groupBy("month", "nation").agg(_sum("direct").alias("amount"))
    vendor = _vendor(spark, d).groupBy("month", "nation").agg(_sum("recognised").alias("amount"))
    every = direct.unionByName(_staff(spark, d).select("month", "nation", F.col("cost").cast(EXACT).alias("amount"))).unionByName(vendor)
    kinds = _rows(spark, POOLS, "kind int, type string, pool string, basis string, retained double")
    return every.join(places(spark, d), "nation").join(kinds, "kind").groupBy("month", "nation", "type", "pool", "basis", "retained").agg(_sum("amount").alias("amount"))


def _allocated(spark: SparkSession, d: str) -> DataFrame:
    pool = _pooled(spark, d).where("type = 'SUPPORT'").groupBy("month").agg(_sum("amount").cast("double").alias("amount"))
    users = _staff(spark, d).join(places(spark, d), "nation").where(F.col("kind") == RECEIVER).withColumn("total", F.sum("fte").over(Window.partitionBy("month")))
    return users.join(pool, "month").select("month", "nation", F.round(F.col("amount") * F.col("fte") / F.col("total"), 2).cast("decimal(18,2)").alias("allocated"))


def _risk(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).groupBy("month", "product", "nation").agg(_sum("provision", F.col("flag") == "R").alias("provision"), _sum("principal").alias("principal"))


def _pnl(spark: SparkSession, d: str) -> DataFrame:
    p = _by_lob(nii_daily(spark, d), spark, d, "nii")
    for other, amount in ((fees, "fee"), (_direct, "direct"), (_allocated, "allocated"), (_risk, "provision")):
        p = _left(p, _by_lob(other(spark, d), spark, d, amount), ["month", "lob"], amount)
    p = p.withColumn("revenue", (F.col("nii") + F.col("fee")).cast(EXACT)).withColumn("expenses", (F.col("direct") + F.col("allocated")).cast(EXACT))
    p = p.withColumn("before_provision", (F.col("revenue") - F.col("expenses")).cast(EXACT))
    return p.withColumn("before_tax", (F.col("before_provision") - F.col("provision")).cast(EXACT))


def _spread(df: DataFrame, spark: SparkSession, amount: str) -> DataFrame:
    """A centre's amounts over products by whole weights that follow both numbers."""
    each = df.crossJoin(_products(spark).select("product"))
    return each.groupBy("month", "product").agg(F.sum(F.col(amount) * ((F.col("nation") + F.col("product")) % 3)).cast(EXACT).alias(amount))


def _product_pnl(spark: SparkSession, d: str) -> DataFrame:
    p = _revenue(spark, d).join(_products(spark), "product")
    p = _left(p, _spread(_direct(spark, d), spark, "direct"), ["month", "product"], "direct")
    p = _left(p, _spread(_allocated(spark, d), spark, "allocated"), ["month", "product"], "allocated")
    return _left(p, _risk(spark, d).groupBy("month", "product").agg(_sum("provision").alias("provision")), ["month", "product"], "provision")


def _capital(spark: SparkSession, d: str) -> DataFrame:
    c = _by_lob(_risk(spark, d), spark, d, "principal")
    for other, amount in ((funds, "balance"), (fees, "fee"), (nii_daily, "nii")):
        c = _left(c, _by_lob(other(spark, d), spark, d, amount), ["month", "lob"], amount)
    x = lambda a: F.col(a).cast("double")
    return c.select("month", "lob", (x("principal") * CREDIT).alias("credit"), (x("balance") * MARKET).alias("market"), (x("fee") * OPERATIONAL).alias("operational"), F.abs(x("nii")).alias("irrbb"))


@_add("monthly", """SELECT as_of_month, product_sk, prior_balance AS prior_balance, current_balance AS current_balance, prior_yield AS prior_yield, current_yield AS current_yield, ((current_balance - prior_balance) * prior_yield / 12) AS volume_variance,
((current_yield - prior_yield) * prior_balance / 12) AS rate_variance, ((current_balance - prior_balance) * (current_yield - prior_yield) / 12) AS mix_variance, (current_nii - prior_nii) AS total_variance FROM (SELECT month AS as_of_month, product AS product_sk, balance AS current_balance, lag(balance) OVER w AS prior_balance,
CAST(nii AS DOUBLE) / nullif(balance, 0) * 12 AS current_yield, lag(CAST(nii AS DOUBLE) / nullif(balance, 0) * 12) OVER w AS prior_yield, CAST(nii AS DOUBLE) AS current_nii, lag(CAST(nii AS DOUBLE)) OVER w AS prior_nii FROM monthly WINDOW w AS (PARTITION BY product ORDER BY month)) WHERE prior_balance IS NOT NULL""")
def nii_attribution(spark: SparkSession, d: str) -> DataFrame:
    """A product's change of net interest from month to month, by volume, rate and mix."""
    m = _monthly(spark, d).select(F.col("month").alias("as_of_month"), F.col("product").alias("product_sk"), F.col("balance").alias("current_balance"), F.col("nii").cast("double").alias("current_nii"), (_ratio("nii", "balance") * 12).alias("current_yield"))
    by = Window.partitionBy("product_sk").orderBy("as_of_month")  # a row a month
    m = m.withColumns({f"prior_{c}": F.lag(f"current_{c}").over(by) for c in ("balance", "nii", "yield")}).where("prior_balance IS NOT NULL")
    volume, rate = F.col("current_balance") - F.col("prior_balance"), F.col("current_yield") - F.col("prior_yield")
    return m.select(
        "as_of_month", "product_sk", _out("prior_balance").alias("prior_balance"), _out("current_balance").alias("current_balance"), _out("prior_yield").alias("prior_yield"), _out("current_yield").alias("current_yield"),
        _out(volume * F.col("prior_yield") / 12).alias("volume_variance"), _out(rate * F.col("prior_balance") / 12).alias("rate_variance"), _out(volume * rate / 12).alias("mix_variance"), _out(F.col("current_nii") - F.col("prior_nii")).alias("total_variance"),
    )


@_add("revenue products", """SELECT month AS as_of_month, product AS product_sk, segment AS segment_code, CAST(nii AS DOUBLE) AS net_interest_income, CAST(fee AS DOUBLE) AS fee_income, CAST(nii + fee AS DOUBLE) AS total_revenue, coalesce(balance, 0) AS avg_earning_assets,
(CAST(nii + fee AS DOUBLE) / nullif(balance, 0) * 12) AS revenue_yield FROM revenue JOIN products USING (product)""")
def revenue_summary(spark: SparkSession, d: str) -> DataFrame:
    """Net interest and fees of each product and month, either of which may be missing."""
    r = _revenue(spark, d).join(_products(spark), "product").withColumn("total", F.col("nii") + F.col("fee"))
    return r.select(F.col("month").alias("as_of_month"), F.col("product").alias("product_sk"), F.col("segment").alias("segment_code"), _out("nii").alias("net_interest_income"), _out("fee").alias("fee_income"), _out("total").alias("total_revenue"), _out(F.coalesce("balance", F.lit(0.0))).alias("avg_earning_assets"), _out(_ratio("total", "balance") * 12).alias("revenue_yield"))


@_add("nii place products", """SELECT month AS as_of_month, segment_code, lob_code, assets AS avg_earning_assets, liabilities AS avg_interest_bearing_liabilities, CAST(income - expense AS DOUBLE) AS net_interest_income, (CAST(income - expense AS DOUBLE) / nullif(assets, 0) * 12) AS net_interest_margin,
((CAST(income AS DOUBLE) / nullif(assets, 0) - CAST(expense AS DOUBLE) / nullif(liabilities, 0)) * 12) AS interest_spread, ((assets - liabilities) * (CAST(income AS DOUBLE) / nullif(assets, 0)) * 12) AS free_funds_benefit
FROM (SELECT month, segment AS segment_code, lob AS lob_code, CAST(sum(assets) AS DOUBLE) / count(*) AS assets, CAST(sum(liabilities) AS DOUBLE) / count(*) AS liabilities, sum(income) AS income, sum(expense) AS expense FROM nii JOIN place USING (nation) JOIN products USING (product) GROUP BY ALL)""")
def interest_margin(spark: SparkSession, d: str) -> DataFrame:
    """Margin, spread and the use of free funds by segment and line of business."""
    r = nii_daily(spark, d).join(places(spark, d), "nation").join(_products(spark), "product").groupBy("month", "segment", "lob")
    r = r.agg((F.sum("assets").cast("double") / F.count("*")).alias("a"), (F.sum("liabilities").cast("double") / F.count("*")).alias("l"), _sum("income").alias("income"), _sum("expense").alias("expense"))
    net = F.col("income") - F.col("expense")
    return r.select(
        F.col("month").alias("as_of_month"), F.col("segment").alias("segment_code"), F.col("lob").alias("lob_code"), _out("a").alias("avg_earning_assets"), _out("l").alias("avg_interest_bearing_liabilities"), _out(net).alias("net_interest_income"), _out(_ratio(net, "a") * 12).alias("net_interest_margin"),
        _out((_ratio("income", "a") - _ratio("expense", "l")) * 12).alias("interest_spread"), _out((F.col("a") - F.col("l")) * _ratio("income", "a") * 12).alias("free_funds_benefit"),
    )


@_add("ln products", """, m AS (SELECT DISTINCT month FROM ln), p AS (SELECT month, product, sum(provision) AS provision, sum(CASE WHEN flag = 'R' THEN income ELSE 0 END) AS gone FROM ln GROUP BY ALL),
b AS (SELECT CAST(date_trunc('month', day + 60) AS DATE) AS month, product, sum(CASE WHEN flag = 'R' THEN fee ELSE 0 END) AS back FROM ln GROUP BY ALL),
f AS (SELECT m.month, product, coalesce(provision, 0) AS provision, coalesce(gone, 0) AS gone, coalesce(back, 0) AS back FROM m CROSS JOIN products LEFT JOIN p USING (month, product) LEFT JOIN b USING (month, product)),
c AS (SELECT *, sum(provision - gone + back) OVER (PARTITION BY product ORDER BY month ROWS UNBOUNDED PRECEDING) AS closing FROM f)
SELECT month AS as_of_month, product AS product_sk, CAST(closing - (provision - gone + back) AS DOUBLE) AS opening_allowance, CAST(provision AS DOUBLE) AS provision_expense, CAST(gone AS DOUBLE) AS gross_chargeoffs, CAST(back AS DOUBLE) AS recoveries, CAST(gone - back AS DOUBLE) AS net_chargeoffs, CAST(closing AS DOUBLE) AS closing_allowance FROM c""")
def allowance_rollforward(spark: SparkSession, d: str) -> DataFrame:
    """Each product's allowance from month to month; a month opens with what the one before closed with."""
    l = lines(spark, d)  # noqa: E741
    lost = F.col("flag") == "R"
    moved = l.groupBy("month", "product").agg(_sum("provision").alias("provision"), _sum("income", lost).alias("gone"))
    back = l.groupBy(F.trunc(F.date_add("day", 60), "month").alias("month"), "product").agg(_sum("fee", lost).alias("back"))
    spine = l.select("month").distinct().crossJoin(_products(spark).select("product"))
    f = _left(_left(spine, moved, ["month", "product"], "provision", "gone"), back, ["month", "product"], "back")
    f = f.withColumn("change", (F.col("provision") - F.col("gone") + F.col("back")).cast(EXACT))
    f = f.withColumn("closing", F.sum("change").over(Window.partitionBy("product").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)))  # a row a month
    return f.select(
        F.col("month").alias("as_of_month"), F.col("product").alias("product_sk"), _out(F.col("closing") - F.col("change")).alias("opening_allowance"), _out("provision").alias("provision_expense"), _out("gone").alias("gross_chargeoffs"), _out("back").alias("recoveries"), _out(F.col("gone") - F.col("back")).alias("net_chargeoffs"), _out("closing").alias("closing_allowance"),
    )


@_add("direct", "SELECT month AS accounting_period, nation AS cost_center_sk, line AS gl_account_sk, category AS expense_category, CAST(net AS DOUBLE) AS gross_amount, CAST(struck AS DOUBLE) AS elimination_amount, CAST(direct AS DOUBLE) AS direct_expense FROM direct")
def direct_expense(spark: SparkSession, d: str) -> DataFrame:
    """Posted expense of each centre and account, less what is eliminated between companies."""
    return _direct(spark, d).select(F.col("month").alias("accounting_period"), F.col("nation").alias("cost_center_sk"), F.col("line").alias("gl_account_sk"), F.col("category").alias("expense_category"), _out("net").alias("gross_amount"), _out("struck").alias("elimination_amount"), _out("direct").alias("direct_expense"))


@_add("vendor", "SELECT month AS accounting_period, nation AS cost_center_sk, supplier AS vendor_id, CAST(invoiced AS DOUBLE) AS invoiced_amount, CAST(prepaid AS DOUBLE) AS prepaid_amortisation, CAST(trueup AS DOUBLE) AS accrual_truup, CAST(recognised AS DOUBLE) AS recognised_expense FROM vendor")
def vendor_expense(spark: SparkSession, d: str) -> DataFrame:
    """Invoices, prepaid parts and the reversal of last month's accruals, of which any may be missing."""
    return _vendor(spark, d).select(F.col("month").alias("accounting_period"), F.col("nation").alias("cost_center_sk"), F.col("supplier").alias("vendor_id"), _out("invoiced").alias("invoiced_amount"), F.col("part").cast("double").alias("prepaid_amortisation"), _out(-F.col("accrued")).alias("accrual_truup"), _out("recognised").alias("recognised_expense"))


@_add("pools", "SELECT month AS accounting_period, pool AS pool_id, nation AS cost_center_sk, type AS pool_type, basis AS allocation_basis, CAST(amount AS DOUBLE) AS pool_amount FROM pools")
def cost_pools(spark: SparkSession, d: str) -> DataFrame:
    """Direct, staff and vendor cost of the centres that serve others, by pool."""
    return _pooled(spark, d).select(F.col("month").alias("accounting_period"), F.col("pool").alias("pool_id"), F.col("nation").alias("cost_center_sk"), F.col("type").alias("pool_type"), F.col("basis").alias("allocation_basis"), _out("amount").alias("pool_amount"))


@_add("direct", """, a AS (SELECT month, nation, category, sum(direct) AS actual FROM direct GROUP BY ALL), plan AS (SELECT CAST(month + INTERVAL 12 MONTH AS DATE) AS month, nation, category, actual AS amount, CASE WHEN nation % 6 = 0 THEN 'DRAFT' ELSE 'APPROVED' END AS version FROM a),
seen AS (SELECT CAST(month + to_months(k) AS DATE) AS month, nation, category, k AS cycle, actual AS amount FROM a, (VALUES (1), (2)) c(k) WHERE nation % 5 <> 0),
b AS (SELECT month, nation, category, sum(amount) AS budget FROM plan WHERE version = 'APPROVED' GROUP BY ALL), f AS (SELECT month, nation, category, sum(amount) AS forecast FROM seen WHERE cycle = (SELECT max(cycle) FROM seen) GROUP BY ALL)
SELECT month AS accounting_period, nation AS cost_center_sk, category AS expense_category, CAST(actual AS DOUBLE) AS actual_amount, CAST(coalesce(budget, 0) AS DOUBLE) AS budget_amount, CAST(coalesce(forecast, 0) AS DOUBLE) AS forecast_amount, CAST(actual - coalesce(budget, 0) AS DOUBLE) AS budget_variance,
CAST(actual - coalesce(budget, 0) AS DOUBLE) / nullif(CAST(budget AS DOUBLE), 0) AS budget_variance_pct, CASE WHEN CAST(actual - coalesce(budget, 0) AS DOUBLE) / nullif(CAST(budget AS DOUBLE), 0) > 0.1 THEN 'OVER_BUDGET' WHEN CAST(actual - coalesce(budget, 0) AS DOUBLE) / nullif(CAST(budget AS DOUBLE), 0) < -0.1 THEN 'UNDER_BUDGET' ELSE 'ON_TRACK' END AS variance_flag
FROM a LEFT JOIN b USING (month, nation, category) LEFT JOIN f USING (month, nation, category)""")
def expense_variance(spark: SparkSession, d: str) -> DataFrame:
    """Expense against the approved budget (last year's) and the latest forecast, flagged beyond a tenth of the budget."""
    by = ["month", "nation", "category"]
    a = _direct(spark, d).groupBy(*by).agg(_sum("direct").alias("actual"))
    plan = a.select(F.add_months("month", 12).alias("month"), "nation", "category", "actual", F.when(F.col("nation") % 6 == 0, "DRAFT").otherwise("APPROVED").alias("version"))
    seen = a.where("nation % 5 <> 0").crossJoin(_rows(spark, [(1,), (2,)], "cycle int")).select(F.add_months("month", F.col("cycle")).alias("month"), "nation", "category", "cycle", "actual")
    b = plan.where("version = 'APPROVED'").groupBy(*by).agg(_sum("actual").alias("budget"))
    last = F.broadcast(seen.agg(F.max("cycle").alias("last")))  # one row
    f = seen.crossJoin(last).where("cycle = last").groupBy(*by).agg(_sum("actual").alias("forecast"))
    v = a.join(b, by, "left").join(f, by, "left")
    gap = F.col("actual") - _zero("budget")
    part = _ratio(gap, "budget")
    flag = F.when(part > 0.1, "OVER_BUDGET").when(part < -0.1, "UNDER_BUDGET").otherwise("ON_TRACK")
    return v.select(F.col("month").alias("accounting_period"), F.col("nation").alias("cost_center_sk"), F.col("category").alias("expense_category"), _out("actual").alias("actual_amount"), _out(_zero("budget")).alias("budget_amount"), _out(_zero("forecast")).alias("forecast_amount"), _out(gap).alias("budget_variance"), _out(part).alias("budget_variance_pct"), flag.alias("variance_flag"))


@_add("pools nii fees staff place", """, o AS (SELECT month, CAST(sum(amount) AS DOUBLE) AS total, CAST(sum(amount * CAST(retained AS DECIMAL(4,3))) AS DOUBLE) AS held FROM pools WHERE type = 'OVERHEAD' GROUP BY ALL),
r AS (SELECT month, lob, sum(income - expense) AS nii FROM nii JOIN place USING (nation) GROUP BY ALL), f AS (SELECT month, lob, sum(fee) AS fee FROM fees JOIN place USING (nation) GROUP BY ALL), h AS (SELECT month, lob, sum(fte) AS fte FROM staff JOIN place USING (nation) GROUP BY ALL),
s AS (SELECT month, lob, CAST(nii + coalesce(fee, 0) AS DOUBLE) / nullif(CAST(sum(nii + coalesce(fee, 0)) OVER w AS DOUBLE), 0) AS by_revenue, CAST(fte AS DOUBLE) / nullif(CAST(sum(fte) OVER w AS DOUBLE), 0) AS by_head FROM r JOIN h USING (month, lob) LEFT JOIN f USING (month, lob) WINDOW w AS (PARTITION BY month))
SELECT month AS accounting_period, lob AS lob_code, total AS overhead_pool, by_revenue AS revenue_share, by_head AS headcount_share, (0.6 * by_revenue + 0.4 * by_head) AS blended_share, ((total - held) * (0.6 * by_revenue + 0.4 * by_head)) AS allocated_overhead, held AS corporate_retained FROM s JOIN o USING (month)""")
def overhead_allocation(spark: SparkSession, d: str) -> DataFrame:
    """The overhead pool over lines of business by revenue and heads, but for the part that is retained."""
    o = _pooled(spark, d).where("type = 'OVERHEAD'").groupBy("month").agg(_sum("amount").cast("double").alias("total"), F.sum(F.col("amount") * F.col("retained").cast("decimal(4,3)")).cast("double").alias("held"))
    r = _left(_by_lob(nii_daily(spark, d), spark, d, "nii"), _by_lob(fees(spark, d), spark, d, "fee"), ["month", "lob"], "fee")
    h = _staff(spark, d).join(places(spark, d), "nation").groupBy("month", "lob").agg(F.sum("fte").alias("fte"))
    s = r.join(h, ["month", "lob"]).withColumn("revenue", (F.col("nii") + F.col("fee")).cast(EXACT))
    by = Window.partitionBy("month")  # five lines of business
    s = s.join(o, "month").withColumns({"r": _ratio(F.col("revenue"), F.sum("revenue").over(by)), "h": _ratio(F.col("fte"), F.sum("fte").over(by))})
    blend = 0.6 * F.col("r") + 0.4 * F.col("h")
    return s.select(F.col("month").alias("accounting_period"), F.col("lob").alias("lob_code"), _out("total").alias("overhead_pool"), _out("r").alias("revenue_share"), _out("h").alias("headcount_share"), _out(blend).alias("blended_share"), _out((F.col("total") - F.col("held")) * blend).alias("allocated_overhead"), _out("held").alias("corporate_retained"))


@_add("pools ln place", """, c AS (SELECT month, nation AS app, CAST(sum(amount) AS DOUBLE) AS cost FROM pools WHERE type = 'TECHNOLOGY' GROUP BY ALL), u AS (SELECT month, CAST(4 * (supplier % 6) + 2 AS INTEGER) AS app, lob, sum(quantity) AS compute, count(*) AS storage, sum(line) AS calls FROM ln JOIN place USING (nation) GROUP BY ALL),
w AS (SELECT *, CAST(compute * (1 + app % 3) + storage * 5 + calls * 2 AS DOUBLE) AS weighted FROM u), t AS (SELECT month, app, sum(weighted) AS total FROM w GROUP BY ALL)
SELECT month AS accounting_period, 'APP-' || app AS application_id, lob AS lob_code, CAST(compute AS BIGINT) AS compute_units, storage AS storage_units, CAST(calls AS BIGINT) AS transaction_units, weighted AS weighted_consumption, (weighted / nullif(total, 0)) AS consumption_share, (cost * weighted / nullif(total, 0)) AS allocated_cost FROM w JOIN t USING (month, app) JOIN c USING (month, app)""")
def technology_allocation(spark: SparkSession, d: str) -> DataFrame:
    """Each application's cost over its users by metered and weighted use."""
    c = _pooled(spark, d).where("type = 'TECHNOLOGY'").groupBy("month", F.col("nation").alias("app")).agg(_sum("amount").cast("double").alias("cost"))
    u = lines(spark, d).join(places(spark, d), "nation").groupBy("month", (4 * (F.col("supplier") % 6) + 2).cast("int").alias("app"), "lob").agg(F.sum("quantity").alias("compute"), F.count("*").alias("storage"), F.sum("line").alias("calls"))
    w = u.withColumn("weighted", (F.col("compute") * (1 + F.col("app") % 3) + F.col("storage") * 5 + F.col("calls") * 2).cast("double"))
    w = w.withColumn("total", F.sum("weighted").over(Window.partitionBy("month", "app"))).join(c, ["month", "app"])
    return w.select(
        F.col("month").alias("accounting_period"), F.concat(F.lit("APP-"), F.col("app").cast("string")).alias("application_id"), F.col("lob").alias("lob_code"), F.col("compute").alias("compute_units"), F.col("storage").alias("storage_units"), F.col("calls").alias("transaction_units"), F.col("weighted").alias("weighted_consumption"),
        _out(_ratio("weighted", "total")).alias("consumption_share"), _out(F.col("cost") * F.col("weighted") / F.nullif(F.col("total"), F.lit(0.0))).alias("allocated_cost"),
    )


@_add("pnl", f"""SELECT month AS accounting_period, lob AS lob_code, CAST(nii AS DOUBLE) AS net_interest_income, CAST(fee AS DOUBLE) AS fee_income, CAST(revenue AS DOUBLE) AS total_revenue, CAST(direct AS DOUBLE) AS direct_expense, CAST(allocated AS DOUBLE) AS allocated_expense, CAST(expenses AS DOUBLE) AS total_expense,
CAST(before_provision AS DOUBLE) AS pre_provision_profit, CAST(provision AS DOUBLE) AS credit_provision, CAST(before_tax AS DOUBLE) AS pre_tax_profit, CAST(before_tax AS DOUBLE) * {TAX} AS tax_expense, CAST(before_tax AS DOUBLE) * (1 - {TAX}) AS net_income FROM pnl""")
def profit_and_loss(spark: SparkSession, d: str) -> DataFrame:
    """From revenue over expense, provision and tax to net income, by line of business."""
    tax = F.col("before_tax").cast("double")
    return _pnl(spark, d).select(
        F.col("month").alias("accounting_period"), F.col("lob").alias("lob_code"), _out("nii").alias("net_interest_income"), _out("fee").alias("fee_income"), _out("revenue").alias("total_revenue"), _out("direct").alias("direct_expense"), _out("allocated").alias("allocated_expense"), _out("expenses").alias("total_expense"),
        _out("before_provision").alias("pre_provision_profit"), _out("provision").alias("credit_provision"), _out("before_tax").alias("pre_tax_profit"), (tax * TAX).alias("tax_expense"), (tax * (1 - TAX)).alias("net_income"),
    )


@_add("product_pnl", """SELECT month AS accounting_period, product AS product_sk, name AS product_name, balance AS avg_balance, CAST(nii AS DOUBLE) AS net_interest_income, CAST(fee AS DOUBLE) AS fee_income, CAST(direct AS DOUBLE) AS direct_cost, CAST(allocated AS DOUBLE) AS allocated_cost, CAST(provision AS DOUBLE) AS credit_cost,
CAST(nii + fee - direct - allocated - provision AS DOUBLE) AS net_contribution, (CAST(nii + fee - direct - allocated - provision AS DOUBLE) / nullif(balance, 0) * 12) AS return_on_assets FROM product_pnl""")
def product_result(spark: SparkSession, d: str) -> DataFrame:
    """A product's contribution after its direct, allocated and credit cost, and the return on its assets."""
    net = F.col("nii") + F.col("fee") - F.col("direct") - F.col("allocated") - F.col("provision")
    return _product_pnl(spark, d).select(
        F.col("month").alias("accounting_period"), F.col("product").alias("product_sk"), F.col("name").alias("product_name"), _out("balance").alias("avg_balance"), _out("nii").alias("net_interest_income"), _out("fee").alias("fee_income"), _out("direct").alias("direct_cost"), _out("allocated").alias("allocated_cost"),
        _out("provision").alias("credit_cost"), _out(net).alias("net_contribution"), _out(_ratio(net, "balance") * 12).alias("return_on_assets"),
    )


@_add("nii fees staff direct alloc place", """, b AS (SELECT month, nation, sum(income - expense) AS nii FROM nii GROUP BY ALL), f AS (SELECT month, nation, sum(fee) AS fee FROM fees GROUP BY ALL), o AS (SELECT month, nation, sum(direct) AS occupancy FROM direct WHERE category = 'OCCUPANCY' GROUP BY ALL),
j AS (SELECT month, nation, name, lob, nii + coalesce(fee, 0) AS revenue, coalesce(cost, 0) AS cost, fte, coalesce(occupancy, 0) AS occupancy, coalesce(allocated, 0) AS allocated FROM b JOIN place USING (nation) LEFT JOIN f USING (month, nation) LEFT JOIN staff USING (month, nation) LEFT JOIN o USING (month, nation) LEFT JOIN alloc USING (month, nation))
SELECT month AS accounting_period, nation AS branch_sk, name AS branch_name, lob AS region_code, CAST(revenue AS DOUBLE) AS total_revenue, CAST(cost AS DOUBLE) AS staffing_cost, CAST(occupancy AS DOUBLE) AS occupancy_cost, CAST(allocated AS DOUBLE) AS allocated_cost, CAST(revenue - cost - occupancy - allocated AS DOUBLE) AS net_contribution,
CAST(revenue AS DOUBLE) / nullif(fte, 0) AS revenue_per_fte, CAST(revenue AS DOUBLE) / (1000 + 100 * nation) AS revenue_per_sqft FROM j""")
def branch_result(spark: SparkSession, d: str) -> DataFrame:
    """A branch's revenue after staff, occupancy and allocated cost, by head and by area."""
    by = ["month", "nation"]
    b = nii_daily(spark, d).groupBy(*by).agg(_sum("nii").alias("nii")).join(places(spark, d), "nation")
    b = _left(b, fees(spark, d).groupBy(*by).agg(_sum("fee").alias("fee")), by, "fee")
    b = _left(b, _staff(spark, d), by, "cost")
    b = _left(b, _direct(spark, d).where("category = 'OCCUPANCY'").groupBy(*by).agg(_sum("direct").alias("occupancy")), by, "occupancy")
    b = _left(b, _allocated(spark, d), by, "allocated").withColumn("revenue", (F.col("nii") + F.col("fee")).cast(EXACT))
    return b.select(
        F.col("month").alias("accounting_period"), F.col("nation").alias("branch_sk"), F.col("name").alias("branch_name"), F.col("lob").alias("region_code"), _out("revenue").alias("total_revenue"), F.col("cost").cast("double").alias("staffing_cost"), _out("occupancy").alias("occupancy_cost"), F.col("allocated").cast("double").alias("allocated_cost"),
        _out(F.col("revenue") - F.col("cost") - F.col("occupancy") - F.col("allocated")).alias("net_contribution"), _out(_ratio("revenue", "fte")).alias("revenue_per_fte"), _out(F.col("revenue").cast("double") / (1000 + 100 * F.col("nation"))).alias("revenue_per_sqft"),
    )


@_add("dp ln", f""", r AS (SELECT account, c_mktsegment AS segment, sum(expense) AS revenue FROM dp JOIN customer ON c_custkey = account GROUP BY ALL), e AS (SELECT user_id AS account, CAST(sum(unit) AS BIGINT) AS serve FROM events JOIN (VALUES {_values(UNIT_COST)}) u(event_type, unit) USING (event_type) GROUP BY ALL),
c AS (SELECT o_custkey AS account, sum(provision) AS credit FROM ln JOIN orders ON o_orderkey = loan WHERE flag = 'R' GROUP BY ALL), a AS (SELECT account, segment, revenue, coalesce(serve, 0) AS serve, coalesce(credit, 0) AS credit, revenue - coalesce(serve, 0) - coalesce(credit, 0) AS profit FROM r LEFT JOIN e USING (account) LEFT JOIN c USING (account))
SELECT account AS customer_sk, segment AS segment_code, CAST(revenue AS DOUBLE) AS total_revenue, CAST(serve AS DOUBLE) AS cost_to_serve, CAST(credit AS DOUBLE) AS credit_cost, CAST(profit AS DOUBLE) AS net_profit, CAST(profit AS DOUBLE) / nullif(CAST(revenue AS DOUBLE), 0) AS profit_margin,
CAST(ntile(10) OVER (PARTITION BY segment ORDER BY profit DESC, account) AS INTEGER) AS profitability_decile FROM a""")
def customer_result(spark: SparkSession, d: str) -> DataFrame:
    """A customer's revenue after the cost to serve and the credit cost, and the decile within the segment."""
    segments = table(spark, d, "customer").select(F.col("c_custkey").alias("account"), F.col("c_mktsegment").alias("segment"))
    r = funds(spark, d).groupBy("account").agg(_sum("expense").alias("revenue")).join(segments, "account")
    e = table(spark, d, "events").join(_rows(spark, UNIT_COST, "event_type string, unit int"), "event_type").groupBy(F.col("user_id").alias("account")).agg(F.sum("unit").alias("serve"))
    owners = table(spark, d, "orders").select(F.col("o_orderkey").alias("loan"), F.col("o_custkey").alias("account"))
    c = lines(spark, d).where("flag = 'R'").join(owners, "loan").groupBy("account").agg(_sum("provision").alias("credit"))
    a = _left(_left(r, e, ["account"], "serve"), c, ["account"], "credit").withColumn("profit", (F.col("revenue") - F.col("serve") - F.col("credit")).cast(EXACT))
    return ranked(a, "profit", "account", ["segment"]).select(
        F.col("account").alias("customer_sk"), F.col("segment").alias("segment_code"), _out("revenue").alias("total_revenue"), F.col("serve").cast("double").alias("cost_to_serve"), _out("credit").alias("credit_cost"), _out("profit").alias("net_profit"), _out(_ratio("profit", "revenue")).alias("profit_margin"),
        tile(F.col("rn"), F.col("n_group"), 10).alias("profitability_decile"),
    )


@_add("pnl", f""", a AS (SELECT month, lob, 'TOTAL_REVENUE' AS metric, CAST(revenue AS DOUBLE) AS amount FROM pnl UNION ALL SELECT month, lob, 'TOTAL_EXPENSE', CAST(expenses AS DOUBLE) FROM pnl UNION ALL SELECT month, lob, 'CREDIT_PROVISION', CAST(provision AS DOUBLE) FROM pnl UNION ALL SELECT month, lob, 'NET_INCOME', CAST(before_tax AS DOUBLE) * (1 - {TAX}) FROM pnl),
b AS (SELECT CAST(month + INTERVAL 6 MONTH AS DATE) AS month, lob, metric, amount AS budget FROM a WHERE lob <> 4), y AS (SELECT CAST(month + INTERVAL 12 MONTH AS DATE) AS month, lob, metric, amount AS before FROM a WHERE metric = 'NET_INCOME')
SELECT month AS accounting_period, lob AS lob_code, metric AS metric_name, amount AS actual_amount, coalesce(budget, 0) AS budget_amount, coalesce(before, 0) AS prior_year_amount, (amount - coalesce(budget, 0)) AS budget_variance, ((amount - coalesce(budget, 0)) / nullif(budget, 0)) AS budget_variance_pct,
(amount - coalesce(before, 0)) AS yoy_variance, ((amount - coalesce(before, 0)) / nullif(before, 0)) AS yoy_variance_pct FROM a LEFT JOIN b USING (month, lob, metric) LEFT JOIN y USING (month, lob, metric)""")
def result_variance(spark: SparkSession, d: str) -> DataFrame:
    """Four measures as rows against budget (half a year before), net income also against the year before."""
    p = _pnl(spark, d).select("month", "lob", F.col("revenue").cast("double").alias("TOTAL_REVENUE"), F.col("expenses").cast("double").alias("TOTAL_EXPENSE"), F.col("provision").cast("double").alias("CREDIT_PROVISION"), (F.col("before_tax").cast("double") * (1 - TAX)).alias("NET_INCOME"))
    a = p.unpivot(["month", "lob"], ["TOTAL_REVENUE", "TOTAL_EXPENSE", "CREDIT_PROVISION", "NET_INCOME"], "metric", "amount")
    b = a.where("lob <> 4").select(F.add_months("month", 6).alias("month"), "lob", "metric", F.col("amount").alias("budget"))
    y = a.where("metric = 'NET_INCOME'").select(F.add_months("month", 12).alias("month"), "lob", "metric", F.col("amount").alias("before"))
    v = a.join(b, ["month", "lob", "metric"], "left").join(y, ["month", "lob", "metric"], "left")
    gap = lambda c: F.col("amount") - F.coalesce(F.col(c), F.lit(0.0))
    return v.select(
        F.col("month").alias("accounting_period"), F.col("lob").alias("lob_code"), F.col("metric").alias("metric_name"), _out("amount").alias("actual_amount"), _out(F.coalesce("budget", F.lit(0.0))).alias("budget_amount"), _out(F.coalesce("before", F.lit(0.0))).alias("prior_year_amount"),
        _out(gap("budget")).alias("budget_variance"), _out(_ratio(gap("budget"), "budget")).alias("budget_variance_pct"), _out(gap("before")).alias("yoy_variance"), _out(_ratio(gap("before"), "before")).alias("yoy_variance_pct"),
    )


_REGION_SQL = f"(VALUES {_values(REGIONS)}) g(lob, factor, hurdle)"


@_add("capital", f""", t AS (SELECT *, credit + market + operational + irrbb AS total FROM capital JOIN {_REGION_SQL} USING (lob)) SELECT month AS as_of_month, lob AS lob_code, credit AS credit_capital, market AS market_capital, operational AS operational_capital, irrbb AS irrbb_capital, total AS undiversified_capital,
(total * (1 - factor)) AS diversification_benefit, (total * factor) AS diversified_capital FROM t""")
def economic_capital(spark: SparkSession, d: str) -> DataFrame:
    """Capital for four kinds of risk by line of business, and what diversification saves."""
    t = _capital(spark, d).join(_rows(spark, REGIONS, "lob int, factor double, hurdle double"), "lob").withColumn("total", F.col("credit") + F.col("market") + F.col("operational") + F.col("irrbb"))
    named = [_out(c).alias(f"{c}_capital") for c in ("credit", "market", "operational", "irrbb")]
    return t.select(F.col("month").alias("as_of_month"), F.col("lob").alias("lob_code"), *named, _out("total").alias("undiversified_capital"), _out(F.col("total") * (1 - F.col("factor"))).alias("diversification_benefit"), _out(F.col("total") * F.col("factor")).alias("diversified_capital"))


@_add("capital product_pnl", f""", k AS (SELECT month, lob, hurdle, (credit + market + operational + irrbb) * factor AS capital FROM capital JOIN {_REGION_SQL} USING (lob)), q AS (SELECT month, product, lob, hurdle, capital, CAST(nii + fee AS DOUBLE) AS revenue, CAST(provision AS DOUBLE) AS loss, CAST(direct + allocated AS DOUBLE) AS cost, CAST(nii + fee - provision - direct - allocated AS DOUBLE) AS net FROM product_pnl JOIN k USING (month))
SELECT month AS accounting_period, lob AS lob_code, product AS product_sk, revenue AS risk_adjusted_revenue, loss AS expected_loss, cost AS operating_cost, capital AS allocated_capital, (net * 12 / nullif(capital, 0)) AS raroc, hurdle AS hurdle_rate, (net * 12 - capital * hurdle) AS economic_profit FROM q""")
def risk_adjusted_return(spark: SparkSession, d: str) -> DataFrame:
    """A product's yearly result after expected loss and cost on the capital of each line of business, against the hurdle."""
    k = _capital(spark, d).join(_rows(spark, REGIONS, "lob int, factor double, hurdle double"), "lob").select("month", "lob", "hurdle", ((F.col("credit") + F.col("market") + F.col("operational") + F.col("irrbb")) * F.col("factor")).alias("capital"))
    q = _product_pnl(spark, d).join(k, "month").withColumn("net", (F.col("nii") + F.col("fee") - F.col("provision") - F.col("direct") - F.col("allocated")).cast("double"))
    return q.select(
        F.col("month").alias("accounting_period"), F.col("lob").alias("lob_code"), F.col("product").alias("product_sk"), _out(F.col("nii") + F.col("fee")).alias("risk_adjusted_revenue"), _out("provision").alias("expected_loss"), _out(F.col("direct") + F.col("allocated")).alias("operating_cost"),
        _out("capital").alias("allocated_capital"), _out(_ratio(F.col("net") * 12, "capital")).alias("raroc"), F.col("hurdle").alias("hurdle_rate"), _out(F.col("net") * 12 - F.col("capital") * F.col("hurdle")).alias("economic_profit"),
    )
