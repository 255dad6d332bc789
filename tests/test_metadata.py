import pytest

from lakeweave.functions.columns import contains
from lakeweave.operators import graph
from lakeweave.plans import catalogue, questions
from lakeweave.sources import metadata


def test_seeding_twice_loads_once(spark, tiny, tmp_path):
    folder = str(tmp_path / "meta")
    assert metadata.seed(spark, tiny, folder) == 5 and metadata.seed(spark, tiny, folder) == 0
    jobs = spark.read.parquet(f"{folder}/job_definition")
    assert jobs.count() == 25 and metadata.by_key(jobs, "job_id", "job-3").first()["workflow_id"]
    with pytest.raises(KeyError):
        metadata.by_key(jobs, "job_id", "job-99")


def test_tables_have_their_declared_columns(spark, tiny, tmp_path):
    metadata.create(spark, str(tmp_path))
    for name, made in metadata.TABLES.items():
        empty = spark.read.parquet(f"{tmp_path}/{name}")
        assert empty.isEmpty() and made(spark, tiny).columns == empty.columns, name


def test_inserted_rows_have_defaults_and_are_checked(spark, tmp_path):
    metadata.create(spark, str(tmp_path))
    [row] = metadata.insert(spark, str(tmp_path), "job_definition", [{"job_id": "j", "workflow_id": "w", "name": "n"}]).collect()
    assert (row.max_retries, row.retry_delay_seconds, row.max_concurrency, row.is_active, row.cron_expression) == (0, 60, 1, True, None)
    assert spark.read.parquet(f"{tmp_path}/job_definition").count() == 1
    bad = [
        ("workflow_definition", {"name": "w", "sla_minutes": 0, "owner_email": "a@b"}), ("workflow_definition", {"name": "w", "sla_minutes": 5, "owner_email": "nobody"}), ("task_definition", {"exec_type": "JAVA"}), ("job_audit", {"status": "OK"}),
        ("job_alert", {"alert_type": "x"}), ("job_dependency", {"depends_on_kind": "TASK", "depends_on_table": "t"}), ("job_dag", {"downstream_job_id": "j"}), ("job_definition", {"colour": "red"}),
    ]
    for name, row in bad:
        with pytest.raises(ValueError):
            metadata.new_rows(spark, name, [row])


def test_patterns_and_plain_needles_differ(spark):
    jobs = spark.createDataFrame([("1", "daily_load"), ("2", "dailyXload"), ("3", "other")], "job_id string, name string")
    assert catalogue.find_job(jobs, "DAILY_L").first()["job_id"] == "2"  # _ is any letter
    assert [r.job_id for r in jobs.where(contains("LY_L", "name")).collect()] == ["1"]


def test_health_looks_at_the_latest_runs(spark):
    rows = [("j", f"a{i}", "SUCCESS" if i % 2 else "FAILED", f"2024-01-01 00:{i:02d}:00", None if i == 29 else f"2024-01-01 00:{i:02d}:30") for i in range(30)]
    runs = spark.createDataFrame(rows, "job_id string, audit_id string, status string, s string, e string").selectExpr("job_id", "audit_id", "status", "CAST(s AS TIMESTAMP) AS started_at", "CAST(e AS TIMESTAMP) AS ended_at")
    [r] = catalogue.health(runs).collect()
    assert (r.runs_considered, r.success_rate, r.avg_duration_seconds, r.last_status) == (20, 0.5, 30.0, "SUCCESS")


def test_intents():
    assert questions.intent("What happens if the ingest_x job fails?") == ("get_blast_radius", {"job_name": "ingest_x"})
    assert questions.intent("Why did load job break") == ("get_rca", {"job_name": "load"})
    assert questions.intent("SQL jobs that touched the raw.orders table this week") == ("find_jobs_touching_table", {"table_name": "raw.orders", "exec_type": "SQL", "lookback_days": 7})
    assert questions.intent("jobs that touched orders table")[1] == {"table_name": "orders", "exec_type": "", "lookback_days": 30}
    assert questions.intent("health of the load job") == ("get_job_health_summary", {"job_name": "load"}) and questions.intent("hello") is None


@pytest.mark.parametrize(
    "question, tool, arguments",
    [
        ("If etl-main job fails?", "get_blast_radius", {"job_name": "etl-main"}),
        ("and what if The Load job FAILS", "get_blast_radius", {"job_name": "Load"}),
        ("root cause of the x_1 job, please", "get_rca", {"job_name": "x_1"}),
        ("rca for x job; health of the y job", "get_rca", {"job_name": "x"}),
        ("if the a job fails, why did the b job?", "get_blast_radius", {"job_name": "a"}),
        ("which notebook job that touched raw.a-b table.", "find_jobs_touching_table", {"table_name": "raw.a-b", "exec_type": "NOTEBOOK", "lookback_days": 30}),
        ("scala jobs that touched the t table", "find_jobs_touching_table", {"table_name": "t", "exec_type": "", "lookback_days": 30}),
        ("This week: python jobs that touched the the table", "find_jobs_touching_table", {"table_name": "the", "exec_type": "PYTHON", "lookback_days": 7}),
        ("status of load job", "get_job_health_summary", {"job_name": "load"}),
        ("SLA of the load job", "get_job_health_summary", {"job_name": "load"}),
    ],
)
def test_forms_of_questions(question, tool, arguments):
    assert questions.intent(question) == (tool, arguments)


@pytest.mark.parametrize("question", ["", "if job fails", "health of load", "jobs that touched table", "why did it fail"])
def test_what_fits_no_form(question):
    assert questions.intent(question) is None


def test_answers(spark, tiny):
    said = questions.answer(spark, tiny, "What if the report_nation_1 job fails?")
    assert said["tool_calls"][0]["result"]["root_job"].endswith("nation_1") and said["answer"]
    touched = questions.answer(spark, tiny, "jobs that touched raw.src_1 table")
    result = touched["tool_calls"][0]["result"]
    assert result["jobs"] and result["total"] == len(result["jobs"]) and "touch raw.src_1: " in touched["answer"]
    assert questions.answer(spark, tiny, "health of the nation_2 job")["tool_calls"][0]["result"]["runs_considered"] == 20
    assert questions.answer(spark, tiny, "rca for nothing job")["tool_calls"][0]["result"] == {"job": None, "root_cause_candidates": [], "total": 0}
    assert questions.answer(spark, tiny, "status of nothing job")["answer"] == "There is no job like nothing."
    assert questions.answer(spark, tiny, "hello")["tool_calls"] == [] and questions.ask(spark, tiny, "hello") is None
    ran = {f"job-{r.user_id % 25}" for r in spark.read.parquet(f"{tiny}/events.parquet").collect()}
    names = {r["name"] for r in metadata.jobs(spark, tiny).collect() if r["job_id"] in ran}
    since, every = (sorted(map(tuple, questions.find_jobs_touching_table(spark, tiny, "src_", lookback_days=1000, ran_since=x).collect())) for x in (True, False))
    assert since == [j for j in every if j[0] in names] and since


def test_small_and_large_graphs_are_walked_alike(spark, tiny):
    edges = catalogue.links(spark, tiny)
    for roots in (["dataset:raw.src_1"], ["task-0", "task-3", "nothing"]):
        a, b = (sorted(map(tuple, graph.reach(edges, roots, 10, small).collect())) for small in (10**6, 0))
        assert a == b
    loop = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    assert graph.has_cycle(loop) and graph.has_cycle(loop, 0) and not graph.has_cycle(edges, 0)
    small, large = (sorted(r.node_id + str(r.depth) for r in graph.impact(loop, ["a", "b"], 5, n).collect()) for n in (10, 0))
    assert small == large == ["a1", "b1", "c1"]
