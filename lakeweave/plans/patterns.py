"""Fifteen warehouse patterns, each over any domain, with DuckDB counterparts written apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeweave.operators.merge import erase, latest, scd2, upsert
from lakeweave.sources.tables import DOMAINS, Domain

NEW_KEYS = 1_000_000_000
#: Standard deviations beyond which a row is an outlier. The pattern's usual 3 finds nothing in these evenly spread amounts.
OUTLIER = 1.6
RATES = "CASE WHEN category LIKE '1%' OR category IN ('O', 'purchase') THEN 1.25 WHEN category LIKE '2%' OR category = 'click' THEN 1.10 ELSE 0.95 END"
ORDER = ["ts", "amount", "actor", "status", "category"]


def _unique(fact: DataFrame) -> DataFrame:
    return latest(fact, ["id"], [F.col(c).desc() for c in ORDER])


def _staged(fact: DataFrame) -> DataFrame:
    """A tenth of the keys a day later at 1.1 times the amount, and some new keys."""
    rows = _unique(fact).drop("rn")
    old = rows.where("id % 10 = 0").selectExpr("id", "actor", "CAST(amount * 1.1 AS decimal(18,2)) AS amount", "ts + INTERVAL 1 DAY AS ts", "'STAGED' AS status", "category")
    return old.unionByName(rows.where("id % 25 = 0").withColumn("id", F.col("id") + NEW_KEYS))


_UNIQUE_SQL = "u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, amount DESC, actor DESC, status DESC, category DESC) AS rn FROM fact) WHERE rn = 1)"
_STAGED_SQL = f"{_UNIQUE_SQL}, s AS (SELECT id, actor, CAST(amount * 1.1 AS DECIMAL(18,2)) AS amount, ts + INTERVAL 1 DAY AS ts, 'STAGED' AS status, category FROM u WHERE id % 10 = 0 UNION ALL SELECT id + {NEW_KEYS}, actor, amount, ts, status, category FROM u WHERE id % 25 = 0)"


def _anchor(fact: DataFrame) -> DataFrame:
    return F.broadcast(fact.agg(F.max("ts").alias("now")))  # one row


def incremental_upsert(spark: SparkSession, d: str, dom: Domain) -> DataFrame:
    fact = dom.fact(spark, d)
    return upsert(_unique(fact).drop("rn"), _staged(fact), ["id"], ["amount", "status", "ts"], newer="ts").select("id", "amount", "status", "ts")


def late_arriving_merge(spark: SparkSession, d: str, dom: Domain) -> DataFrame:
    fact = dom.fact(spark, d)
    late = _staged(fact).crossJoin(_anchor(fact)).where("ts < now - INTERVAL 1 DAY").drop("now")
    return upsert(_unique(fact).drop("rn"), late, ["id"], ["amount", "status"]).select("id", "amount", "status", "ts")


def _dim_history(actors: DataFrame) -> DataFrame:
    return actors.selectExpr("actor", "actor_name", "region", "DATE '1990-01-01' AS valid_from", "CAST(NULL AS DATE) AS valid_to", "true AS is_current")


def _dim_staged(actors: DataFrame) -> DataFrame:
    moved = actors.where("actor % 7 = 0").selectExpr("actor", "actor_name", "IF(actor % 2 = 0, 'MOVED', region) AS region")
    return moved.unionByName(actors.where("actor % 40 = 0").selectExpr(f"actor + {NEW_KEYS} AS actor", "actor_name", "region"))


def scd2_merge(spark: SparkSession, d: str, dom: Domain) -> DataFrame:
    actors = dom.actors(spark, d)
    return scd2(_dim_history(actors), _dim_staged(actors), "actor", ["actor_name", "region"], F.lit("2002-01-01").cast("date"))


def dedup_latest(spark: SparkSession, d: str, dom: Domain) -> DataFrame:
    return _unique(dom.fact(spark, d))


def null_check(spark: SparkSession, d: str, dom: Domain) -> DataFrame:
    bad = F.col("actor").isNull() | F.col("amount").isNull() | (F.col("status").isNull())
    return dom.fact(spark, d).agg(F.lit("required_columns").alias("check_name"), F.lit(dom.source).alias("table_name"), F.max("ts").alias("checked_at"), F.count_if(bad).alias("failing_rows"))


def referential_check(spark: SparkSession, d: str, dom: Domain) -> DataFrame:
    known = dom.actors(spark, d).where("actor % 11 <> 0")
    return dom.fact(spark, d).join(known, "actor", "left_anti").select("id", "actor", "amount", "ts")


def daily_rollup(spark: SparkSession, d: str, dom: Domain) -> DataFrame:
    fact = dom.fact(spark, d)
    last = fact.crossJoin(_anchor(fact)).where("ts >= date_trunc('DAY', now) - INTERVAL 1 DAY")
    return last.groupBy(F.date_trunc("day", "ts").alias("day"), "category").agg(F.sum("amount").cast("double").alias("total"), F.count("*").alias("n"))


def top_n(spark: SparkSession, d: str, dom: Domain) -> DataFrame:
    totals = dom.fact(spark, d).groupBy("category", "actor").agg(F.sum("amount").alias("sum_amount"))
    ranked = totals.withColumn("rnk", F.rank().over(Window.partitionBy("category").orderBy(F.col("sum_amount").desc()))).where("rnk <= 5")
    return ranked.join(dom.actors(spark, d), "actor").select("category", "actor", "actor_name", F.col("sum_amount").cast("double").alias("total"), "rnk").orderBy("category", "rnk", "actor")


def funnel(spark: SparkSession, d: str, dom: Domain) -> DataFrame:
    fact = dom.fact(spark, d)
    recent = fact.crossJoin(_anchor(fact)).where("ts >= now - INTERVAL 30 DAYS")
    flags = recent.groupBy("actor").agg(*[F.max(F.when(F.col("status") == s, 1).otherwise(0)).alias(f"s{i}") for i, s in enumerate(dom.steps, 1)])
    sums = flags.agg(*[F.coalesce(F.sum(f"s{i}"), F.lit(0)).alias(f"step_{i}") for i in (1, 2, 3)])
    share = lambda a, b: F.round(F.col(b).cast("double") * 100 / F.nullif(F.col(a), F.lit(0)), 2)
    return sums.select("step_1", "step_2", "step_3", share("step_1", "step_2").alias("rate_1_2"), share("step_2", "step_3").alias("rate_2_3"))


def cohort(spark: SparkSession, d: str, dom: Domain) -> DataFrame:
    months = dom.fact(spark, d).select("actor", F.date_trunc("month", "ts").alias("month")).distinct()
    first = months.groupBy("actor").agg(F.min("month").alias("cohort_month"))
    since = (F.year("month") * 12 + F.month("month")) - (F.year("cohort_month") * 12 + F.month("cohort_month"))
    return months.join(first, "actor").groupBy("cohort_month", since.alias("months_since_start")).agg(F.countDistinct("actor").alias("active_actors"))


def gap_fill(spark: SparkSession, d: str, dom: Domain) -> DataFrame:
    daily = dom.fact(spark, d).groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.sum("amount").alias("total"), F.count("*").alias("n"))
    spine = daily.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.expr("sequence(a, b, INTERVAL 1 DAY)")).alias("day"))
    return spine.join(daily, "day", "left").select("day", F.coalesce("total", F.lit(0)).cast("double").alias("total"), F.coalesce("n", F.lit(0)).alias("n"))


def rate_normalization(spark: SparkSession, d: str, dom: Domain) -> DataFrame:
    fact = dom.fact(spark, d).withColumn("rate", F.expr(f"CAST({RATES} AS decimal(4,2))"))
    return fact.selectExpr("id", "actor", "ts", "category", "CAST(amount AS DOUBLE) AS amount", "CAST(amount * rate AS DOUBLE) AS normalized")


def sessionize(spark: SparkSession, d: str, dom: Domain) -> DataFrame:
    by = Window.partitionBy("actor").orderBy("ts")
    gap = F.when(F.lag("ts").over(by).isNull() | (F.col("ts") - F.lag("ts").over(by) > F.expr(f"INTERVAL {dom.gap_seconds} SECOND")), 1).otherwise(0)
    # The default frame: rows of equal time share the running sum.
    return dom.fact(spark, d).withColumn("is_new", gap).withColumn("session", F.sum("is_new").over(by)).groupBy("actor", "session").agg(F.count("*").alias("n"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


def anomaly_zscore(spark: SparkSession, d: str, dom: Domain) -> DataFrame:
    fact = dom.fact(spark, d)
    recent = fact.crossJoin(_anchor(fact)).where("ts >= now - INTERVAL 90 DAYS")
    stats = recent.agg(F.avg(F.col("amount").cast("double")).alias("mean"), F.stddev_samp(F.col("amount").cast("double")).alias("sd"))
    z = F.round((F.col("amount").cast("double") - F.col("mean")) / F.nullif(F.col("sd"), F.lit(0.0)), 4)
    return fact.crossJoin(F.broadcast(stats)).withColumn("z", z).where(F.abs("z") > OUTLIER).select("id", "actor", "ts", F.col("amount").cast("double").alias("amount"), "z")


def gdpr_erasure(spark: SparkSession, d: str, dom: Domain) -> DataFrame:
    requests = dom.actors(spark, d).where("actor % 50 = 0").select("actor")
    facts = erase(dom.fact(spark, d), requests, "actor").agg(F.lit("fact").alias("kind"), F.count("*").alias("n"), F.sum("amount").cast("double").alias("amount"))
    people = erase(dom.actors(spark, d), requests, "actor").agg(F.lit("actor").alias("kind"), F.count("*").alias("n"), F.lit(None).cast("double").alias("amount"))
    done = requests.withColumn("state", F.when(F.col("actor").isNotNull(), "COMPLETED")).groupBy(F.concat(F.lit("request "), "state").alias("kind")).agg(F.count("*").alias("n"), F.lit(None).cast("double").alias("amount"))
    return facts.unionByName(people).unionByName(done)


def _sql(dom: Domain) -> dict[str, str]:
    w = dom.sql()
    s1, s2, s3 = dom.steps
    return {
        "incremental_upsert": f"{w}, {_STAGED_SQL} SELECT coalesce(u.id, s.id) AS id, CASE WHEN u.id IS NULL OR s.ts > u.ts THEN s.amount ELSE u.amount END AS amount, CASE WHEN u.id IS NULL OR s.ts > u.ts THEN s.status ELSE u.status END AS status, CASE WHEN u.id IS NULL OR s.ts > u.ts THEN s.ts ELSE u.ts END AS ts FROM u FULL JOIN s ON u.id = s.id",
        "late_arriving_merge": f"{w}, {_STAGED_SQL}, l AS (SELECT s.* FROM s, anchor WHERE s.ts < now - INTERVAL 1 DAY) SELECT coalesce(u.id, l.id) AS id, coalesce(l.amount, u.amount) AS amount, coalesce(l.status, u.status) AS status, coalesce(u.ts, l.ts) AS ts FROM u FULL JOIN l ON u.id = l.id",
        "scd2_merge": f"{w}, s AS (SELECT actor, actor_name, CASE WHEN actor % 2 = 0 THEN 'MOVED' ELSE region END AS region FROM actors WHERE actor % 7 = 0 UNION ALL SELECT actor + {NEW_KEYS}, actor_name, region FROM actors WHERE actor % 40 = 0), c AS (SELECT a.*, s.actor IS NOT NULL AND s.region <> a.region AS closed FROM actors a LEFT JOIN s ON s.actor = a.actor) SELECT actor, actor_name, region, DATE '1990-01-01' AS valid_from, CASE WHEN closed THEN DATE '2002-01-01' END AS valid_to, NOT closed AS is_current FROM c UNION ALL SELECT actor, actor_name, region, DATE '2002-01-01', NULL, TRUE FROM s WHERE actor NOT IN (SELECT actor FROM c WHERE NOT closed)",
        "dedup_latest": f"{w}, {_UNIQUE_SQL} SELECT id, actor, amount, ts, status, category, CAST(rn AS INTEGER) AS rn FROM u",
        "null_check": f"{w} SELECT 'required_columns' AS check_name, '{dom.source}' AS table_name, max(ts) AS checked_at, count(*) FILTER (WHERE actor IS NULL OR amount IS NULL OR status IS NULL) AS failing_rows FROM fact",
        "referential_check": f"{w} SELECT f.id, f.actor, f.amount, f.ts FROM fact f LEFT JOIN (SELECT * FROM actors WHERE actor % 11 <> 0) a ON a.actor = f.actor WHERE a.actor IS NULL",
        "daily_rollup": f"{w} SELECT date_trunc('day', ts) AS day, category, CAST(sum(amount) AS DOUBLE) AS total, count(*) AS n FROM fact, anchor WHERE ts >= date_trunc('day', now) - INTERVAL 1 DAY GROUP BY 1, 2",
        "top_n": f"{w}, t AS (SELECT category, actor, sum(amount) AS total FROM fact GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY category ORDER BY total DESC) AS rnk FROM t) SELECT category, r.actor, actor_name, CAST(total AS DOUBLE) AS total, CAST(rnk AS INTEGER) AS rnk FROM r JOIN actors a ON a.actor = r.actor WHERE rnk <= 5",
        "funnel": f"{w}, p AS (SELECT actor, max(CASE WHEN status = '{s1}' THEN 1 ELSE 0 END) AS a, max(CASE WHEN status = '{s2}' THEN 1 ELSE 0 END) AS b, max(CASE WHEN status = '{s3}' THEN 1 ELSE 0 END) AS c FROM fact, anchor WHERE ts >= now - INTERVAL 30 DAY GROUP BY actor), t AS (SELECT CAST(coalesce(sum(a), 0) AS BIGINT) AS a, CAST(coalesce(sum(b), 0) AS BIGINT) AS b, CAST(coalesce(sum(c), 0) AS BIGINT) AS c FROM p) SELECT a AS step_1, b AS step_2, c AS step_3, round(CAST(b AS DOUBLE) * 100 / nullif(a, 0), 2) AS rate_1_2, round(CAST(c AS DOUBLE) * 100 / nullif(b, 0), 2) AS rate_2_3 FROM t",
        "cohort": f"{w}, c AS (SELECT actor, min(date_trunc('month', ts)) AS cohort_month FROM fact GROUP BY actor) SELECT CAST(cohort_month AS TIMESTAMP) AS cohort_month, CAST(datediff('month', cohort_month, date_trunc('month', ts)) AS INTEGER) AS months_since_start, count(DISTINCT f.actor) AS active_actors FROM fact f JOIN c ON c.actor = f.actor GROUP BY 1, 2",
        "gap_fill": f"{w}, b AS (SELECT min(date_trunc('day', ts)) AS a, max(date_trunc('day', ts)) AS z FROM fact), days AS (SELECT CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS TIMESTAMP) AS day FROM b) SELECT d.day, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS total, count(f.id) AS n FROM days d LEFT JOIN fact f ON date_trunc('day', f.ts) = d.day GROUP BY d.day",
        "rate_normalization": f"{w} SELECT id, actor, ts, category, CAST(amount AS DOUBLE) AS amount, CAST(amount * CAST({RATES} AS DECIMAL(4,2)) AS DOUBLE) AS normalized FROM fact",
        "sessionize": f"{w}, g AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY actor ORDER BY ts) IS NULL OR ts - lag(ts) OVER (PARTITION BY actor ORDER BY ts) > INTERVAL {dom.gap_seconds} SECOND THEN 1 ELSE 0 END AS is_new FROM fact), s AS (SELECT *, CAST(sum(is_new) OVER (PARTITION BY actor ORDER BY ts) AS BIGINT) AS session FROM g) SELECT actor, session, count(*) AS n, min(ts) AS started, max(ts) AS ended FROM s GROUP BY 1, 2",
        "anomaly_zscore": f"{w}, s AS (SELECT avg(CAST(amount AS DOUBLE)) AS mean, stddev_samp(CAST(amount AS DOUBLE)) AS sd FROM fact, anchor WHERE ts >= now - INTERVAL 90 DAY), z AS (SELECT id, actor, ts, CAST(amount AS DOUBLE) AS amount, round((CAST(amount AS DOUBLE) - mean) / nullif(sd, 0), 4) AS z FROM fact, s) SELECT * FROM z WHERE abs(z) > {OUTLIER}",
        "gdpr_erasure": f"{w}, r AS (SELECT actor FROM actors WHERE actor % 50 = 0) SELECT 'fact' AS kind, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount FROM fact WHERE actor NOT IN (SELECT actor FROM r) UNION ALL SELECT 'actor', count(*), NULL FROM actors WHERE actor NOT IN (SELECT actor FROM r) UNION ALL SELECT 'request COMPLETED', count(*), NULL FROM r HAVING count(*) > 0",
    }


PATTERNS = [incremental_upsert, late_arriving_merge, scd2_merge, dedup_latest, null_check, referential_check, daily_rollup, top_n, funnel, cohort, gap_fill, rate_normalization, sessionize, anomaly_zscore, gdpr_erasure]
QUERIES = {f"{p.__name__}_{n}": (lambda spark, d, p=p, dom=dom: p(spark, d, dom)) for n, dom in DOMAINS.items() for p in PATTERNS}
SQL = {f"{k}_{n}": q for n, dom in DOMAINS.items() for k, q in _sql(dom).items()}
