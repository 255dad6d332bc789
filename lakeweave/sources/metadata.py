"""Pipeline metadata: the tables' schemas, their derivation from the inputs, and loading, inserting and looking rows up.

Regions are workflows, nations jobs, suppliers tasks and events runs. Keys are made from the inputs' keys, so that every
run gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeweave.sources.tables import table

EXEC_TYPES = ("SQL", "PYSPARK", "PYTHON", "NOTEBOOK")
STATUSES = ("PENDING", "RUNNING", "SUCCESS", "FAILED", "SKIPPED", "CANCELLED")
KINDS = ("TASK", "DATASET")
ALERTS = ("SLA_BREACH", "FAILURE", "DATA_DRIFT", "RETRY_EXHAUSTED")
#: table -> its columns as DDL; key first.
SCHEMAS = {
    "workflow_definition": "workflow_id string, name string, owner_team string, owner_email string, sla_minutes int, description string, tags map<string,string>, created_at timestamp",
    "job_definition": "job_id string, workflow_id string, name string, cron_expression string, max_retries int, retry_delay_seconds int, max_concurrency int, is_active boolean, created_at timestamp",
    "job_dag": "dag_edge_id string, workflow_id string, upstream_job_id string, downstream_job_id string, external_trigger string",
    "task_definition": "task_id string, job_id string, name string, task_order int, exec_type string, script_path string, source_code string, environment struct<category: string, domain: string>",
    "job_audit": "audit_id string, job_id string, run_id string, status string, started_at timestamp, ended_at timestamp, rows_processed bigint, cost_usd decimal(12,4), error_message string",
    "job_dependency": "dependency_id string, task_id string, depends_on_kind string, depends_on_task_id string, depends_on_table string",
    "job_alert": "alert_id string, job_id string, alert_type string, distribution_list array<string>, is_active boolean",
}
#: What an inserted row has where it names no value, by table and column; other columns are null.
DEFAULTS = {
    "job_definition": {"max_retries": 0, "retry_delay_seconds": 60, "max_concurrency": 1, "is_active": True},
    "task_definition": {"task_order": 0},
    "job_alert": {"is_active": True, "distribution_list": []},
    "workflow_definition": {"tags": {}},
}
BEGUN = "TIMESTAMP'2024-01-01 00:00:00'"


def workflows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "region").selectExpr("concat('wf-', r_regionkey) AS workflow_id", "concat('platform_', lower(r_name)) AS name", "concat('team-', r_regionkey) AS owner_team", "concat('team-', r_regionkey, '@example.org') AS owner_email", "CAST(30 + 15 * r_regionkey AS INT) AS sla_minutes", "IF(r_regionkey % 2 = 0, concat('Pipelines of ', r_name), NULL) AS description", "map('tier', CAST(r_regionkey % 3 AS STRING)) AS tags", f"{BEGUN} AS created_at")


def jobs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").selectExpr(
        "concat('job-', n_nationkey) AS job_id", "concat('wf-', n_regionkey) AS workflow_id", "concat(IF(n_nationkey % 2 = 0, 'ingest_', 'report_'), lower(n_name)) AS name", "IF(n_nationkey % 5 = 0, NULL, concat('0 ', n_nationkey % 24, ' * * *')) AS cron_expression", "CAST(n_nationkey % 4 AS INT) AS max_retries",
        "60 AS retry_delay_seconds", "1 AS max_concurrency", "n_nationkey % 6 <> 1 AS is_active", f"{BEGUN} AS created_at",
    )


def job_dag(spark: SparkSession, d: str) -> DataFrame:
    """Jobs of a workflow in a row; the first one waits for a trigger from outside."""
    by = Window.partitionBy("n_regionkey").orderBy("n_nationkey")  # a few nations a region
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey", F.lag("n_nationkey").over(by).alias("before"))
    return n.selectExpr("concat('edge-', n_nationkey) AS dag_edge_id", "concat('wf-', n_regionkey) AS workflow_id", "IF(before IS NULL, NULL, concat('job-', before)) AS upstream_job_id", "concat('job-', n_nationkey) AS downstream_job_id", "IF(before IS NULL, concat('landing/', n_nationkey), NULL) AS external_trigger")


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    by = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    return s.withColumns({"at": F.row_number().over(by) - 1, "before": F.lag("s_suppkey").over(by)})


def tasks(spark: SparkSession, d: str) -> DataFrame:
    kind = "CASE s_suppkey % 4 WHEN 0 THEN 'SQL' WHEN 1 THEN 'PYSPARK' WHEN 2 THEN 'PYTHON' ELSE 'NOTEBOOK' END"
    source = "CASE WHEN s_suppkey % 9 = 0 THEN NULL WHEN s_suppkey % 4 = 0 THEN concat('INSERT INTO mart.t', s_suppkey, ' SELECT * FROM raw.src_', s_suppkey % 10) ELSE concat('df = spark.table(\"raw.src_', s_suppkey % 7, '\")') END"
    return _numbered(spark, d).selectExpr(
        "concat('task-', s_suppkey) AS task_id", "concat('job-', s_nationkey) AS job_id", "concat('step_', s_suppkey) AS name", "CAST(at AS INT) AS task_order", f"{kind} AS exec_type", "IF(s_suppkey % 4 = 0, NULL, concat('jobs/', s_suppkey, '.py')) AS script_path", f"{source} AS source_code",
        "IF(s_suppkey % 8 = 4, NULL, named_struct('category', concat('c', s_suppkey % 3), 'domain', concat('d', s_nationkey % 5))) AS environment",
    )


def dependencies(spark: SparkSession, d: str) -> DataFrame:
    """A job's tasks wait for each other in their order; every third task, and each first one, reads a raw table too."""
    n = _numbered(spark, d)
    a = n.where("before IS NOT NULL").selectExpr("concat('dep-', s_suppkey, '-t') AS dependency_id", "concat('task-', s_suppkey) AS task_id", "'TASK' AS depends_on_kind", "concat('task-', before) AS depends_on_task_id", "CAST(NULL AS STRING) AS depends_on_table")
    return a.unionByName(n.where("s_suppkey % 3 = 0 OR before IS NULL").selectExpr("concat('dep-', s_suppkey, '-d') AS dependency_id", "concat('task-', s_suppkey) AS task_id", "'DATASET' AS depends_on_kind", "CAST(NULL AS STRING) AS depends_on_task_id", "concat('raw.src_', s_suppkey % 10) AS depends_on_table"))


def audits(spark: SparkSession, d: str) -> DataFrame:
    status = "CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'RUNNING' WHEN 'click' THEN 'SKIPPED' ELSE 'SUCCESS' END"
    e = table(spark, d, "events").selectExpr("event_id", "user_id % 25 AS job", "ts", "value", f"{status} AS status")
    return e.selectExpr(
        "concat('run-', event_id) AS audit_id", "concat('job-', job) AS job_id", "concat('r', event_id) AS run_id", "status", "ts AS started_at", "IF(status = 'RUNNING', NULL, ts + make_dt_interval(0, 0, CAST(event_id % 50 AS INT), 0)) AS ended_at",
        "IF(status = 'SUCCESS', event_id * 10, NULL) AS rows_processed", "CAST(value AS DECIMAL(12,4)) AS cost_usd", "IF(status = 'FAILED', 'failed', NULL) AS error_message",
    )


def alerts(spark: SparkSession, d: str) -> DataFrame:
    kinds = "array('SLA_BREACH', 'FAILURE', 'DATA_DRIFT', 'RETRY_EXHAUSTED')"
    n = table(spark, d, "nation").select("n_nationkey", F.explode(F.expr(f"slice({kinds}, 1 + n_nationkey % 4, 2)")).alias("alert_type"))
    return n.selectExpr("concat('alert-', n_nationkey, '-', lower(alert_type)) AS alert_id", "concat('job-', n_nationkey) AS job_id", "alert_type", "array(concat('team-', n_nationkey % 5, '@example.org')) AS distribution_list", "n_nationkey % 3 <> 0 AS is_active")


TABLES = {"workflow_definition": workflows, "job_definition": jobs, "job_dag": job_dag, "task_definition": tasks, "job_audit": audits, "job_dependency": dependencies, "job_alert": alerts}


def create(spark: SparkSession, folder: str) -> None:
    """Empty tables where there are none yet."""
    for name, columns in SCHEMAS.items():
        spark.createDataFrame([], columns).write.mode("ignore").parquet(f"{folder}/{name}")


def seed(spark: SparkSession, d: str, folder: str) -> int:
    """Loads all tables from the inputs into folder, unless it has a workflow already; the number of workflows loaded."""
    found = spark.read.schema(SCHEMAS["workflow_definition"]).option("pathGlobFilter", "*.parquet")
    try:
        if not found.parquet(f"{folder}/workflow_definition").isEmpty():
            return 0
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    for name, rows in TABLES.items():
        rows(spark, d).write.mode("overwrite").parquet(f"{folder}/{name}")
    return workflows(spark, d).count()


def new_rows(spark: SparkSession, name: str, rows: list[dict]) -> DataFrame:
    """rows in the table's columns, with its defaults; a row that breaks a rule raises ValueError."""
    for row in rows:
        check(name, row)
    full = [DEFAULTS.get(name, {}) | row for row in rows]
    columns = spark.createDataFrame([], SCHEMAS[name]).columns
    if unknown := {c for r in rows for c in r} - set(columns):
        raise ValueError(f"{name} has no {', '.join(sorted(unknown))}")
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in full], SCHEMAS[name])


def check(name: str, row: dict) -> None:
    """Raises ValueError for a row that the table may not hold."""
    wrong = None
    if name == "workflow_definition" and (row.get("sla_minutes") or 0) <= 0:
        wrong = "sla_minutes is above 0"
    elif name == "workflow_definition" and "@" not in (row.get("owner_email") or ""):
        wrong = "owner_email is an address"
    elif name == "task_definition" and row.get("exec_type") not in EXEC_TYPES:
        wrong = f"exec_type is one of {EXEC_TYPES}"
    elif name == "job_audit" and row.get("status") not in STATUSES:
        wrong = f"status is one of {STATUSES}"
    elif name == "job_alert" and row.get("alert_type") not in ALERTS:
        wrong = f"alert_type is one of {ALERTS}"
    elif name == "job_dependency" and not (row.get("depends_on_kind") == "TASK" and row.get("depends_on_task_id") or row.get("depends_on_kind") == "DATASET" and row.get("depends_on_table")):
        wrong = "a dependency names a task or a table, as its kind says"
    elif name == "job_dag" and not (row.get("upstream_job_id") or row.get("external_trigger")):
        wrong = "an edge has an upstream job or a trigger"
    if wrong:
        raise ValueError(f"{name}: {wrong}")


def insert(spark: SparkSession, folder: str, name: str, rows: list[dict]) -> DataFrame:
    """Appends rows with their defaults and returns them."""
    made = new_rows(spark, name, rows)
    append(made, f"{folder}/{name}")
    return made


def append(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Adds the rows of df, in the declared columns, to the table at path."""
    (df.select(*columns) if columns else df).write.mode("append").parquet(path)


def by_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """The row of that key; KeyError where there is none."""
    found = df.where(F.col(key) == value).limit(1)
    if found.isEmpty():
        raise KeyError(f"no {key} {value}")
    return found
