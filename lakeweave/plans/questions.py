"""Questions in plain words about jobs and tables, answered by the reads of `catalogue`; no language model takes part.

A question is read as words. A form is a row of what must stand side by side in it: a set of words, an optional word, or a
place whose word is taken as an argument. Every tool gives a table of all it finds; only a sentence's few rows are collected.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.operators import graph
from lakeweave.plans import catalogue
from lakeweave.sources import metadata as M

#: Names and numbers in a question: letters, digits, - and . inside a word.
WORD = re.compile(r"\w+(?:[.\-]+\w+)*")
# The tools' and arguments' names, the order in which they are tried, and the days that a look back covers.
BLAST, CAUSES, TOUCHING, HEALTH = "get_blast_radius", "get_rca", "find_jobs_touching_table", "get_job_health_summary"
WEEK, MONTH = 7, 30
#: Rows that an answer names, and that its result lists, at most; the number of all is always given.
NAMED, LISTED = 10, 1_000


@dataclass(frozen=True)
class Take:
    """A place of a form whose word is an argument; with `among` only these words fit, and the place may be left out."""

    name: str
    among: frozenset[str] | None = None


def _form(text: str) -> list:
    """A form from its words: a|b one of several, (a) may be left out, <name> an argument."""
    out: list = []
    for part in text.split():
        if part.startswith("<"):
            out.append(Take(part[1:-1]))
        elif part.startswith("("):
            out.append((frozenset(part[1:-1].split("|")), False))
        else:
            out.append((frozenset(part.split("|")), True))
    return out


KINDS = Take("exec_type", frozenset(k.lower() for k in M.EXEC_TYPES))
FORMS = [
    (BLAST, _form("if (the) <job_name> job fails")),
    *((CAUSES, _form(f"{asked} (the) <job_name> job")) for asked in ("why did", "root cause of", "rca for")),
    (TOUCHING, [KINDS, *_form("job|jobs that touched (the) <table_name> table")]),
    (HEALTH, _form("health|status|sla of (the) <job_name> job")),
]


def _fits(words: list[str], form: list) -> dict[str, str] | None:
    """The arguments, if the words begin with the form."""
    if not form:
        return {}
    part, rest = form[0], form[1:]
    low = words[0].lower() if words else ""
    if isinstance(part, Take):
        fits, needed = bool(words) and (part.among is None or low in part.among), part.among is None
    else:
        fits, needed = low in part[0], part[1]
    if fits and (found := _fits(words[1:], rest)) is not None:
        return {part.name: words[0], **found} if isinstance(part, Take) else found
    return None if needed else _fits(words, rest)


def intent(question: str) -> tuple[str, dict] | None:
    """The first tool one of whose forms stands in the question, and its arguments."""
    words = WORD.findall(question)
    for tool, form in FORMS:
        for at in range(len(words)):
            found = _fits(words[at:], form)
            if found is None:
                continue
            if tool == TOUCHING:
                recent = any(pair == ("this", "week") for pair in zip(map(str.lower, words), map(str.lower, words[1:])))
                found = {"table_name": found["table_name"], "exec_type": found.get("exec_type", "").upper(), "lookback_days": WEEK if recent else MONTH}
            return tool, found
    return None


def _job(spark: SparkSession, d: str, name: str) -> DataFrame:
    """(job_id, job_name) of the job that a name stands for: one row at most."""
    return catalogue.find_job(M.jobs(spark, d), name).select("job_id", F.col("name").alias("job_name"))


def _walk(spark: SparkSession, d: str, job_name: str, table_name: str, max_depth: int, upstream: bool) -> DataFrame:
    roots = M.tasks(spark, d).join(F.broadcast(_job(spark, d, job_name)), "job_id").select(F.col("task_id").alias("root"), "job_name") if job_name else None
    if table_name:
        own = spark.range(1).select(F.lit(f"dataset:{table_name}").alias("root"), F.lit(None).cast("string").alias("job_name"))
        roots = own if roots is None else roots.unionByName(own)
    if roots is None:
        return spark.createDataFrame([], "job_name string, node_id string, depth int")
    links = catalogue.links(spark, d)
    found = graph.impact(graph.reversed_links(links) if upstream else links, roots.select("root"), max_depth)
    name = roots.agg(F.max("job_name").alias("job_name"))  # one row
    return found.crossJoin(F.broadcast(name)).select("job_name", "node_id", "depth")


def get_blast_radius(spark: SparkSession, d: str, job_name: str = "", table_name: str = "", max_depth: int = 10) -> DataFrame:
    """(job_name, node_id, depth): what is hit if a job, or a table, fails, by least depth from any task of the job or the table."""
    return _walk(spark, d, job_name, table_name, max_depth, False)


def get_rca(spark: SparkSession, d: str, job_name: str = "", max_depth: int = 10) -> DataFrame:
    """(job_name, node_id, depth): what may have made a job fail."""
    return _walk(spark, d, job_name, "", max_depth, True)


def find_jobs_touching_table(spark: SparkSession, d: str, table_name: str, exec_type: str = "", lookback_days: int = WEEK, ran_since: bool = False) -> DataFrame:
    """(job_name, task_name, exec_type, declared): tasks that touch a table; with ran_since only those of jobs that ran in the days before the last run of all."""
    jobs = M.jobs(spark, d)
    found = catalogue.touching(M.tasks(spark, d), jobs, M.dependencies(spark, d), table_name, exec_type)
    if ran_since:
        runs = M.audits(spark, d)
        last = F.broadcast(runs.agg(F.max("started_at").alias("last")))  # one row
        ran = runs.crossJoin(last).where(F.col("started_at") >= F.col("last") - F.make_dt_interval(F.lit(lookback_days))).select("job_id").distinct()
        found = found.join(jobs.join(ran, "job_id", "left_semi").select(F.col("name").alias("job_name")), "job_name", "left_semi")
    return found.select("job_name", "task_name", "exec_type", "declared")


def get_job_health_summary(spark: SparkSession, d: str, job_name: str) -> DataFrame:
    """(job_name, runs_considered, success_rate, avg_duration_seconds, last_status, last_run_at) of the job's latest runs: no row if there is no such job."""
    job = F.broadcast(_job(spark, d, job_name))
    health = catalogue.health(M.audits(spark, d).join(job.select("job_id"), "job_id", "left_semi"))
    return job.join(health, "job_id", "left").select("job_name", F.coalesce("runs_considered", F.lit(0)).alias("runs_considered"), "success_rate", "avg_duration_seconds", "last_status", "last_run_at")


TOOLS = {f.__name__: f for f in (get_blast_radius, get_rca, find_jobs_touching_table, get_job_health_summary)}
ORDER = {BLAST: "depth, node_id", CAUSES: "depth, node_id", TOUCHING: "NOT declared, job_name, task_name", HEALTH: "job_name"}
#: What is said of nothing and of something: {n} rows, {of} what was asked for, {names} of the first rows.
SAID = {
    BLAST: ("Nothing depends on {of}.", "{n} node(s) depend on {of}: {names}"),
    CAUSES: ("{of} depends on nothing that is known.", "{of} depends on {n} node(s): {names}"),
    TOUCHING: ("No task touches {of}.", "{n} task(s) touch {of}: {names}"),
    HEALTH: ("There is no job like {of}.", "{names}"),
}


def ask(spark: SparkSession, d: str, question: str) -> DataFrame | None:
    """All rows that answer a question; None if it fits no form."""
    asked = intent(question)
    return TOOLS[asked[0]](spark, d, **asked[1]) if asked else None


def _name(tool: str, row: dict) -> str:
    if tool == TOUCHING:
        return f"{row['job_name']}/{row['task_name']}"
    if tool == HEALTH:
        good = "no run has ended" if row["success_rate"] is None else f"{row['success_rate']:.0%} of {row['runs_considered']} runs went well"
        return f"{row['job_name']}: {good}, the last one is {row['last_status']}."
    return row["node_id"]


# The keys of a tool's result.
def _result(tool: str, arguments: dict, rows: list[dict], n: int, job: str | None) -> dict:
    nodes = [{"id": r["node_id"], "depth": r["depth"]} for r in rows] if tool in (BLAST, CAUSES) else []
    if tool == BLAST:
        return {"root_job": job, "root_table": arguments.get("table_name"), "impacted_nodes": nodes, "total": n}
    if tool == CAUSES:
        return {"job": job, "root_cause_candidates": nodes, "total": n}
    if tool == TOUCHING:
        return {"table": arguments["table_name"], "lookback_days": arguments["lookback_days"], "jobs": [{k: r[k] for k in ("job_name", "task_name", "exec_type")} for r in rows], "total": n}
    return rows[0] if rows else {"error": SAID[HEALTH][0].format(of=arguments["job_name"])}


def answer(spark: SparkSession, d: str, question: str) -> dict:
    """{"answer", "tool_calls"} for a question; one that fits no form gets no call. Results list the first LISTED rows and the number of all."""
    asked = intent(question)
    if not asked:
        return {"answer": "This question is not about impact, causes, a table's jobs or a job's health. Try other words.", "tool_calls": []}
    tool, arguments = asked
    table = TOOLS[tool](spark, d, **arguments)
    rows = [r.asDict() for r in table.orderBy(*map(F.expr, ORDER[tool].split(", "))).limit(LISTED).collect()]
    n = len(rows) if len(rows) < LISTED else table.count()
    names = ", ".join(_name(tool, r) for r in rows[:NAMED]) + (" ..." if n > NAMED else "")
    named = _job(spark, d, arguments["job_name"]).first() if tool in (BLAST, CAUSES) else None
    job = named["job_name"] if named else None
    of = job or arguments.get("job_name") or arguments["table_name"]
    return {"answer": SAID[tool][bool(rows)].format(n=n, of=of, names=names), "tool_calls": [{"name": tool, "input": arguments, "result": _result(tool, arguments, rows, n, job)}]}


ASKED = {
    "ask_impact": "What happens if the nation_1 job fails?",
    "ask_causes": "why did the nation_1 job break",
    "ask_touching": "sql jobs that touched the src_4 table this week",
    "ask_health": "What is the health of the nation_2 job?",
}


def _job_sql(name: str) -> str:
    return f"SELECT job_id, name FROM job WHERE name ILIKE '%{name}%' ORDER BY name, job_id LIMIT 1"


def _walk_sql(name: str, a: str, b: str) -> str:
    return f"""{catalogue._WITH}, {catalogue._GRAPH}, own AS ({_job_sql(name)}), r AS (SELECT task_id AS root, task_id AS node_id, 0 AS depth FROM task WHERE job_id = (SELECT job_id FROM own)
UNION SELECT r.root, e.{b}, depth + 1 FROM r JOIN e ON e.{a} = r.node_id WHERE depth < 10) SELECT (SELECT name FROM own) AS job_name, node_id, CAST(min(depth) AS INTEGER) AS depth FROM r WHERE depth > 0 AND node_id <> root GROUP BY node_id"""


QUERIES = {name: (lambda spark, d, question=question: ask(spark, d, question)) for name, question in ASKED.items()}
SQL = {
    "ask_impact": _walk_sql("nation_1", "src", "dst"),
    "ask_causes": _walk_sql("nation_1", "dst", "src"),
    "ask_touching": f"""{catalogue._WITH} SELECT j.name AS job_name, t.name AS task_name, exec_type, bool_or(said) AS declared FROM (SELECT task_id, TRUE AS said FROM dep WHERE depends_on_table ILIKE '%src_4%' UNION ALL SELECT task_id, FALSE FROM task WHERE source_code ILIKE '%src_4%')
JOIN task t USING (task_id) JOIN job j ON j.job_id = t.job_id WHERE exec_type = 'SQL' GROUP BY task_id, j.name, t.name, exec_type""",
    "ask_health": f"""{catalogue._WITH}, own AS ({_job_sql("nation_2")}), h AS (SELECT *, row_number() OVER (ORDER BY started_at DESC, audit_id) AS rn FROM run WHERE job_id = (SELECT job_id FROM own)), k AS (SELECT * FROM h WHERE rn <= {catalogue.HEALTH_RUNS})
SELECT own.name AS job_name, (SELECT count(*) FROM k) AS runs_considered, (SELECT CAST(count(*) FILTER (WHERE status = 'SUCCESS') AS DOUBLE) / count(*) FROM k) AS success_rate, (SELECT CAST(sum(epoch_us(ended_at) - epoch_us(started_at)) AS DOUBLE) / count(ended_at) / 1000000 FROM k) AS avg_duration_seconds,
(SELECT status FROM k WHERE rn = 1) AS last_status, (SELECT started_at FROM k WHERE rn = 1) AS last_run_at FROM own""",
}
