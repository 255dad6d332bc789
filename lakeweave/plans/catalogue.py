"""Reads over pipeline metadata: lookups, listings, search, health, counts, impact of jobs, and tables that tasks touch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeweave.functions.columns import contains, like
from lakeweave.operators import graph
from lakeweave.operators.cut import cut
from lakeweave.sources import metadata as M

# What the registered queries ask for.
WORKFLOW, JOB, TASK, NEEDLE, SOURCE, RUNS, PAGE, SHOWN, DEPTH = "wf-1", "job-7", "task-6", "st_na_ion_1", "src_3", 50, 10, 2, 10
HEALTH_RUNS = 20
QUERIES, SQL = {}, {}

_META = {
    "wf": "SELECT 'wf-' || r_regionkey AS workflow_id, 'platform_' || lower(r_name) AS name, 'team-' || r_regionkey AS owner_team, 'team-' || r_regionkey || '@example.org' AS owner_email, CAST(30 + 15 * r_regionkey AS INTEGER) AS sla_minutes FROM region",
    "job": "SELECT 'job-' || n_nationkey AS job_id, 'wf-' || n_regionkey AS workflow_id, CASE WHEN n_nationkey % 2 = 0 THEN 'ingest_' ELSE 'report_' END || lower(n_name) AS name, CASE WHEN n_nationkey % 5 <> 0 THEN '0 ' || n_nationkey % 24 || ' * * *' END AS cron_expression, CAST(n_nationkey % 4 AS INTEGER) AS max_retries, n_nationkey % 6 <> 1 AS is_active FROM nation",
    "num": "SELECT s_suppkey, s_nationkey, row_number() OVER w - 1 AS ord, lag(s_suppkey) OVER w AS before FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)",
    "task": """SELECT 'task-' || s_suppkey AS task_id, 'job-' || s_nationkey AS job_id, 'step_' || s_suppkey AS name, CAST(ord AS INTEGER) AS task_order, ['SQL', 'PYSPARK', 'PYTHON', 'NOTEBOOK'][s_suppkey % 4 + 1] AS exec_type,
CASE WHEN s_suppkey % 9 = 0 THEN NULL WHEN s_suppkey % 4 = 0 THEN 'INSERT INTO mart.t' || s_suppkey || ' SELECT * FROM raw.src_' || s_suppkey % 10 ELSE 'df = spark.table("raw.src_' || s_suppkey % 7 || '")' END AS source_code,
CASE WHEN s_suppkey % 8 <> 4 THEN 'c' || s_suppkey % 3 END AS category, CASE WHEN s_suppkey % 8 <> 4 THEN 'd' || s_nationkey % 5 END AS domain FROM num""",
    "dep": "SELECT 'task-' || s_suppkey AS task_id, 'TASK' AS depends_on_kind, 'task-' || before AS depends_on_task_id, CAST(NULL AS VARCHAR) AS depends_on_table FROM num WHERE before IS NOT NULL UNION ALL SELECT 'task-' || s_suppkey, 'DATASET', NULL, 'raw.src_' || s_suppkey % 10 FROM num WHERE s_suppkey % 3 = 0 OR before IS NULL",
    "run": "SELECT 'run-' || event_id AS audit_id, 'job-' || user_id % 25 AS job_id, CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'RUNNING' WHEN 'click' THEN 'SKIPPED' ELSE 'SUCCESS' END AS status, ts AS started_at, CASE WHEN event_type <> 'signup' THEN ts + to_minutes(CAST(event_id % 50 AS INTEGER)) END AS ended_at, event_id FROM events",
    "alert": "SELECT 'job-' || n_nationkey AS job_id, unnest((['SLA_BREACH', 'FAILURE', 'DATA_DRIFT', 'RETRY_EXHAUSTED'])[n_nationkey % 4 + 1 : n_nationkey % 4 + 2]) AS alert_type, n_nationkey % 3 <> 0 AS is_active FROM nation",
}
_WITH = "WITH RECURSIVE " + ",\n".join(f"{k} AS ({v})" for k, v in _META.items())


def _add(sql: str):
    def keep(f):
        QUERIES[f"meta_{f.__name__}"], SQL[f"meta_{f.__name__}"] = f, f"{_WITH}\n{sql}"
        return f

    return keep


@_add("SELECT * FROM wf")
def workflows(spark: SparkSession, d: str) -> DataFrame:
    """All workflows."""
    return M.workflows(spark, d).select("workflow_id", "name", "owner_team", "owner_email", "sla_minutes")


@_add(f"SELECT * FROM wf WHERE workflow_id = '{WORKFLOW}'")
def workflow(spark: SparkSession, d: str) -> DataFrame:
    """One workflow by its key."""
    return M.by_key(workflows(spark, d), "workflow_id", WORKFLOW)


def jobs_of(jobs: DataFrame, workflow_id: str | None = None) -> DataFrame:
    """All jobs, or those of one workflow."""
    return jobs.where(F.col("workflow_id") == workflow_id) if workflow_id else jobs


@_add(f"SELECT * FROM job WHERE workflow_id = '{WORKFLOW}'")
def jobs(spark: SparkSession, d: str) -> DataFrame:
    """The jobs of a workflow."""
    return jobs_of(M.jobs(spark, d), WORKFLOW).select("job_id", "workflow_id", "name", "cron_expression", "max_retries", "is_active")


@_add(f"SELECT task_id, name, task_order, exec_type FROM task WHERE job_id = '{JOB}' ORDER BY task_order")
def tasks_of_job(spark: SparkSession, d: str) -> DataFrame:
    """A job's tasks in their order."""
    return M.tasks(spark, d).where(F.col("job_id") == JOB).select("task_id", "name", "task_order", "exec_type").orderBy("task_order")


@_add(f"SELECT audit_id, status, started_at, ended_at FROM run WHERE job_id = '{JOB}' ORDER BY started_at DESC, audit_id LIMIT {RUNS}")
def runs_of_job(spark: SparkSession, d: str) -> DataFrame:
    """A job's latest runs: a listing of RUNS rows."""
    return M.audits(spark, d).where(F.col("job_id") == JOB).orderBy(F.col("started_at").desc(), "audit_id").limit(RUNS).select("audit_id", "status", "started_at", "ended_at")


@_add(f"SELECT depends_on_kind, depends_on_task_id, depends_on_table FROM dep WHERE task_id = '{TASK}'")
def dependencies_of_task(spark: SparkSession, d: str) -> DataFrame:
    """What a task waits for."""
    return M.dependencies(spark, d).where(F.col("task_id") == TASK).select("depends_on_kind", "depends_on_task_id", "depends_on_table")


@_add(f"SELECT * FROM alert WHERE job_id = '{JOB}'")
def alerts_of_job(spark: SparkSession, d: str) -> DataFrame:
    """A job's alerts."""
    return M.alerts(spark, d).where(F.col("job_id") == JOB).select("job_id", "alert_type", "is_active")


@_add("SELECT * FROM (SELECT job_id, workflow_id, name, max_retries, is_active FROM job UNION ALL SELECT 'job-new', 'wf-0', 'made_here', 0, TRUE)")
def insert_job(spark: SparkSession, d: str) -> DataFrame:
    """The jobs after one came in that names few of its columns; the others have their defaults."""
    columns = ["job_id", "workflow_id", "name", "max_retries", "is_active"]
    made = M.new_rows(spark, "job_definition", [{"job_id": "job-new", "workflow_id": "wf-0", "name": "made_here"}])
    return M.jobs(spark, d).select(*columns).unionByName(made.select(*columns))


def _examples(spark: SparkSession, d: str) -> DataFrame:
    t = M.tasks(spark, d).where("exec_type = 'SQL' AND source_code IS NOT NULL")
    t = t.select("task_id", F.col("name").alias("task_name"), F.col("environment.category").alias("category"), F.col("environment.domain").alias("domain"), F.col("source_code").alias("sql"), "job_id", "task_order")
    j = M.jobs(spark, d).select("job_id", F.col("name").alias("job_name"), "workflow_id")
    w = M.workflows(spark, d).select("workflow_id", F.col("name").alias("workflow_name"), "owner_team")
    return t.join(F.broadcast(j), "job_id").join(F.broadcast(w), "workflow_id")  # 25 jobs, 5 workflows


_EXAMPLES = "SELECT task_id, t.name AS task_name, category, domain, source_code AS sql, j.job_id, j.name AS job_name, w.workflow_id, w.name AS workflow_name, owner_team, task_order FROM task t JOIN job j ON j.job_id = t.job_id JOIN wf w ON w.workflow_id = j.workflow_id WHERE exec_type = 'SQL' AND source_code IS NOT NULL"
_ORDER = ["workflow_name", "job_name", "task_order"]


@_add(f"SELECT * FROM ({_EXAMPLES}) ORDER BY workflow_name, job_name, task_order")
def sql_examples(spark: SparkSession, d: str) -> DataFrame:
    """All tasks of SQL with their job, workflow, category and domain."""
    return _examples(spark, d).orderBy(*_ORDER)


@_add(f"SELECT * FROM ({_EXAMPLES}) ORDER BY workflow_name, job_name, task_order LIMIT {PAGE} OFFSET least({PAGE * (SHOWN - 1)}, greatest((SELECT count(*) - 1 FROM ({_EXAMPLES})) // {PAGE} * {PAGE}, 0))")
def sql_examples_page(spark: SparkSession, d: str) -> DataFrame:
    """One page of the examples; a page beyond the last one shows the last."""
    rows = _examples(spark, d)
    pages = max(-(-rows.count() // PAGE), 1)
    return rows.orderBy(*_ORDER).offset(PAGE * (min(max(SHOWN, 1), pages) - 1)).limit(PAGE)


@_add(f"SELECT * FROM ({_EXAMPLES}) WHERE (contains(lower(task_name), 'src_') OR contains(lower(sql), 'src_') OR contains(lower(job_name), 'src_')) AND domain = 'd1'")
def search_examples(spark: SparkSession, d: str) -> DataFrame:
    """Examples of one domain that have a text in their name, job or SQL."""
    return _examples(spark, d).where(contains("SRC_", "task_name", "sql", "job_name") & (F.col("domain") == "d1"))


def find_job(jobs: DataFrame, needle: str) -> DataFrame:
    """The first job, by name and key, whose name has the needle in it; _ and % in it stand for any letter and any letters."""
    return jobs.where(like(needle, "name")).orderBy("name", "job_id").limit(1)


@_add(f"SELECT job_id, name FROM job WHERE name ILIKE '%{NEEDLE}%' ORDER BY name, job_id LIMIT 1")
def first_job(spark: SparkSession, d: str) -> DataFrame:
    """The first job whose name is like the needle."""
    return find_job(M.jobs(spark, d), NEEDLE).select("job_id", "name")


def health(audits: DataFrame, runs: int = HEALTH_RUNS) -> DataFrame:
    """(job_id, runs_considered, success_rate, avg_duration_seconds, last_status, last_run_at) over each job's latest runs."""
    by = Window.partitionBy("job_id").orderBy(F.col("started_at").desc(), "audit_id")
    last = audits.withColumn("at", F.row_number().over(by)).where(F.col("at") <= runs)
    took = F.unix_micros(F.col("ended_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    return last.groupBy("job_id").agg(
        F.count("*").alias("runs_considered"), (F.count_if(F.col("status") == "SUCCESS") / F.count("*")).alias("success_rate"), (F.sum(took).cast("double") / F.count(took) / 1000000).alias("avg_duration_seconds"),
        F.max(F.when(F.col("at") == 1, F.col("status"))).alias("last_status"), F.max(F.when(F.col("at") == 1, F.col("started_at"))).alias("last_run_at"),
    )


@_add(f"""SELECT job_id, count(*) AS runs_considered, CAST(count(*) FILTER (WHERE status = 'SUCCESS') AS DOUBLE) / count(*) AS success_rate, CAST(sum(epoch_us(ended_at) - epoch_us(started_at)) AS DOUBLE) / count(ended_at) / 1000000 AS avg_duration_seconds, max(CASE WHEN rn = 1 THEN status END) AS last_status, max(CASE WHEN rn = 1 THEN started_at END) AS last_run_at
FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY started_at DESC, audit_id) AS rn FROM run) WHERE rn <= {HEALTH_RUNS} GROUP BY job_id""")
def job_health(spark: SparkSession, d: str) -> DataFrame:
    """Each job's health over its latest runs."""
    return health(M.audits(spark, d))


@_add("SELECT w.name, CAST(count(DISTINCT j.job_id) AS BIGINT) AS n_jobs, count(DISTINCT j.job_id) FILTER (WHERE is_active) AS n_active, count(task_id) AS n_tasks, count(DISTINCT exec_type) AS n_kinds FROM wf w LEFT JOIN job j ON j.workflow_id = w.workflow_id LEFT JOIN task t ON t.job_id = j.job_id GROUP BY 1")
def workflow_counts(spark: SparkSession, d: str) -> DataFrame:
    """Jobs, active jobs, tasks and kinds of task by workflow."""
    w, j, t = M.workflows(spark, d), M.jobs(spark, d), M.tasks(spark, d)
    joined = w.select("workflow_id", F.col("name").alias("title")).join(j.select("workflow_id", "job_id", "is_active"), "workflow_id", "left").join(t.select("job_id", "task_id", "exec_type"), "job_id", "left")
    return spark.sql("SELECT title AS name, count(DISTINCT job_id) AS n_jobs, count(DISTINCT CASE WHEN is_active THEN job_id END) AS n_active, count(task_id) AS n_tasks, count(DISTINCT exec_type) AS n_kinds FROM {joined} GROUP BY 1", joined=joined)


@_add("SELECT 'missing_job' AS check_name, count(*) AS n FROM task WHERE job_id NOT IN (SELECT job_id FROM job) UNION ALL SELECT 'bad_exec_type', count(*) FROM task WHERE exec_type NOT IN ('SQL', 'PYSPARK', 'PYTHON', 'NOTEBOOK') UNION ALL SELECT 'bad_sla', count(*) FROM wf WHERE sla_minutes <= 0 UNION ALL SELECT 'same_order', count(*) FROM (SELECT 1 FROM task GROUP BY job_id, task_order HAVING count(*) > 1) UNION ALL SELECT 'no_source', count(*) FROM task WHERE source_code IS NULL")
def quality(spark: SparkSession, d: str) -> DataFrame:
    """How many rows break each rule of the metadata."""
    t, j, w = M.tasks(spark, d), M.jobs(spark, d), M.workflows(spark, d)
    broken = {
        "missing_job": t.join(j.select("job_id"), "job_id", "left_anti"), "bad_exec_type": t.where(~F.col("exec_type").isin(*M.EXEC_TYPES)), "bad_sla": w.where("sla_minutes <= 0"),
        "same_order": t.groupBy("job_id", "task_order").count().where("count > 1"), "no_source": t.where("source_code IS NULL"),
    }
    first, *rest = [df.agg(F.lit(name).alias("check_name"), F.count("*").alias("n")) for name, df in broken.items()]
    for df in rest:
        first = first.unionByName(df)
    return first


def touching(tasks: DataFrame, jobs: DataFrame, dependencies: DataFrame, name: str, exec_type: str = "") -> DataFrame:
    """(task_id, job_name, task_name, exec_type, declared): tasks that declare a table like `name`, then those whose source
    has it in it; a task that does both is listed once, as the first."""
    t = tasks.where(F.col("exec_type") == exec_type) if exec_type else tasks
    declared = t.join(dependencies.where(like(name, "depends_on_table")).select("task_id").distinct(), "task_id", "left_semi").withColumn("declared", F.lit(True))
    both = declared.unionByName(t.where(like(name, "source_code")).withColumn("declared", F.lit(False)))
    first = Window.partitionBy("task_id").orderBy(F.col("declared").desc())  # two rows at most
    both = both.withColumn("rn", F.row_number().over(first)).where("rn = 1")
    return both.join(F.broadcast(jobs.select("job_id", F.col("name").alias("job_name"))), "job_id").select("task_id", "job_name", F.col("name").alias("task_name"), "exec_type", "declared")


@_add(f"""SELECT task_id, j.name AS job_name, t.name AS task_name, exec_type, bool_or(said) AS declared FROM (SELECT task_id, TRUE AS said FROM dep WHERE depends_on_table ILIKE '%{SOURCE}%' UNION ALL SELECT task_id, FALSE FROM task WHERE source_code ILIKE '%{SOURCE}%') JOIN task t USING (task_id) JOIN job j ON j.job_id = t.job_id GROUP BY ALL""")
def jobs_touching_table(spark: SparkSession, d: str) -> DataFrame:
    """Tasks that read a table, by what they declare or by their source."""
    return touching(M.tasks(spark, d), M.jobs(spark, d), M.dependencies(spark, d), SOURCE)


@_add("""SELECT task_id, list_sort(list_distinct(list_concat(declared, named))) AS tables, list_sort(list_filter(declared, lambda x: NOT list_contains(named, x))) AS undeclared_reads FROM
(SELECT t.task_id, coalesce(list(DISTINCT depends_on_table) FILTER (WHERE depends_on_table IS NOT NULL), []) AS declared, coalesce(any_value(regexp_extract_all(source_code, 'raw[.]src_[0-9]+')), []) AS named FROM task t LEFT JOIN dep ON dep.task_id = t.task_id GROUP BY t.task_id)""")
def task_tables(spark: SparkSession, d: str) -> DataFrame:
    """The union of the tables that a task declares and those that its source names, and those only declared."""
    said = M.dependencies(spark, d).where("depends_on_table IS NOT NULL").groupBy("task_id").agg(F.collect_set("depends_on_table").alias("declared"))
    t = M.tasks(spark, d).join(said, "task_id", "left")
    none = F.expr("CAST(array() AS ARRAY<STRING>)")
    declared, named = F.coalesce("declared", none), F.coalesce(F.regexp_extract_all("source_code", F.lit("raw[.]src_[0-9]+"), F.lit(0)), none)
    return t.select("task_id", F.array_sort(F.array_union(declared, named)).alias("tables"), F.array_sort(F.array_except(declared, named)).alias("undeclared_reads"))


def links(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst) of the metadata's dependencies."""
    return cut(graph.edges(M.dependencies(spark, d)))


def task_ids(tasks: DataFrame, job_id: str) -> DataFrame:
    return tasks.where(F.col("job_id") == job_id).select(F.col("task_id").alias("root"))


_GRAPH = "e AS (SELECT DISTINCT coalesce(depends_on_task_id, 'dataset:' || depends_on_table) AS src, task_id AS dst FROM dep)"


def _impact_sql(root: str, a: str, b: str) -> str:
    return f", {_GRAPH}, r AS (SELECT root, root AS node_id, 0 AS depth FROM ({root}) UNION SELECT r.root, e.{b}, depth + 1 FROM r JOIN e ON e.{a} = r.node_id WHERE depth < {DEPTH}) SELECT node_id, CAST(min(depth) AS INTEGER) AS depth, starts_with(node_id, 'dataset:') AS is_dataset FROM r WHERE depth > 0 AND node_id <> root GROUP BY node_id"


@_add(_impact_sql(f"SELECT task_id AS root FROM task WHERE job_id = '{JOB}' UNION ALL SELECT 'dataset:raw.{SOURCE}'", "src", "dst"))
def impact_of_job(spark: SparkSession, d: str) -> DataFrame:
    """All that fails with a job or a table, at the least depth from any of its tasks."""
    roots = task_ids(M.tasks(spark, d), JOB).unionByName(spark.range(1).select(F.lit(f"dataset:raw.{SOURCE}").alias("root")))
    return graph.impact(links(spark, d), roots, DEPTH)


@_add(_impact_sql(f"SELECT task_id AS root FROM task WHERE job_id = '{JOB}'", "dst", "src"))
def causes_of_job(spark: SparkSession, d: str) -> DataFrame:
    """All that may have made a job fail, at the least depth from any of its tasks."""
    return graph.impact(graph.reversed_links(links(spark, d)), task_ids(M.tasks(spark, d), JOB), DEPTH)
