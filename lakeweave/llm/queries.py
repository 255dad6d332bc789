"""The registered queries of this subpackage, one per operator, each over its whole table, and DuckDB SQL where it can tell."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.llm import decontaminate, html, packing, passages, periodic, quality, rules, sharding, simhash, toxicity, urls, variants, winnowing
from lakeweave.llm.columns import table
from lakeweave.llm.labelled import held_out

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: One run in so many loses a letter in op12, as its contract says.
ERRATA = 199
SHARDS = [f"shard-{i:02d}" for i in range(64)]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "log_ratio")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(table(spark, sf_dir, "pages"), html.train(), keep=["url"])
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.strip(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], SHARDS)


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.compared(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.expr(winnowing.digest_sql("picks")).alias("fingerprint"),
        F.expr(winnowing.digest_sql("edited_picks")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"), errata=ERRATA)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.runs(periodic.repeated_tails(table(spark, sf_dir, "documents")))
    found = found.withColumn("top", F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.period")).alias("period"),
        F.expr("1000 * top.length div -top.period").alias("exponent_milli"),
        F.expr(r"sha2(array_join(transform(runs, r -> concat(concat_ws(',', r.start, r.length, r.period), '\n')), ''), 256)").alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_quality, op3_simhash, op4_urls, op5_html, op6_passages, op7_decontaminate, op8_packing, op9_sharding, op10_rules, op11_winnowing, op12_spelling_variants, op13_periodic_runs)}

_SPACE_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_BENCH_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP6_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
stretches AS (SELECT doc_id, 500 * k AS start, substr(h, 1000 * k + 1, 1098) AS part FROM (SELECT doc_id, h, unnest(range(0, length(h) // 1000 + 1)) AS k FROM d)),
windows AS (SELECT doc_id, start + p AS p, substr(part, 2 * p + 1, 100) AS s FROM (SELECT doc_id, start, part, unnest(range(0, greatest(least(length(part) // 2 - 49, 500), 0))) AS p FROM stretches)),
firsts AS (SELECT s, min(doc_id) AS low FROM windows GROUP BY s HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT w.doc_id, w.p, lag(w.p) OVER (PARTITION BY w.doc_id ORDER BY w.p) AS before FROM windows w JOIN firsts f ON w.s = f.s WHERE f.low < w.doc_id),
marked AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM hits),
spans AS (SELECT doc_id, span, min(p) AS a, max(p) + 50 AS b FROM marked GROUP BY doc_id, span),
gaps AS (SELECT s.doc_id, s.span, s.b - s.a AS n, substr(d.h, 2 * coalesce(lag(s.b) OVER (PARTITION BY s.doc_id ORDER BY s.span), 0) + 1, 2 * (s.a - coalesce(lag(s.b) OVER (PARTITION BY s.doc_id ORDER BY s.span), 0))) AS kept FROM spans s JOIN d ON d.doc_id = s.doc_id),
cut AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(kept, '' ORDER BY span) AS kept FROM gaps GROUP BY doc_id),
ends AS (SELECT doc_id, max(b) AS b FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, coalesce(c.n_removed, 0) AS n_removed, coalesce(c.n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN c.doc_id IS NULL THEN d.h ELSE c.kept || substr(d.h, 2 * e.b + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut c ON c.doc_id = d.doc_id LEFT JOIN ends e ON e.doc_id = d.doc_id
"""

OP7_SQL = f"""
WITH items AS (SELECT item_id, {_BENCH_WORDS} AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
d AS (SELECT doc_id, {_BENCH_WORDS} AS w FROM documents),
placed AS (SELECT d.doc_id, l.n, i, array_to_string(list_slice(d.w, i, i + l.n - 1), ' ') AS s FROM d, (SELECT DISTINCT n FROM wins) l, LATERAL (SELECT unnest(range(1, len(d.w) - l.n + 2)) AS i)),
hits AS (SELECT a.doc_id, a.i, a.n, w.item_id FROM placed a JOIN wins w ON w.n = a.n AND w.s = a.s),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
who AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(o.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(o.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words h ON h.doc_id = d.doc_id LEFT JOIN who o ON o.doc_id = d.doc_id
"""


def _window(n: int) -> str:
    return f"CASE WHEN count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) = {n} THEN string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) END"


def _again(n: int) -> str:
    return f"CASE WHEN w{n} IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w{n}) > 1 THEN 1 ELSE 0 END"


def _inside(n: int) -> str:
    return f"max(a{n}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_LOW, _HIGH = rules.LONGEST_RANGE
OP10_SQL = rf"""
WITH d AS (SELECT doc_id, text, {_SPACE_WORDS} AS w FROM documents),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
grams AS (SELECT doc_id, i, length(word) AS n, {_window(5)} AS w5, {_window(rules.MIN_REPEAT)} AS w{rules.MIN_REPEAT} FROM each),
again AS (SELECT doc_id, i, n, {_again(5)} AS a5, {_again(rules.MIN_REPEAT)} AS a{rules.MIN_REPEAT} FROM grams),
inside AS (SELECT doc_id, n, {_inside(5)} AS r5, {_inside(rules.MIN_REPEAT)} AS covered FROM again),
words AS (SELECT doc_id, sum(n) AS word_chars, sum(r5) AS n_repeat_words, sum(covered) AS covered FROM inside GROUP BY doc_id),
sized AS (SELECT doc_id, w, least(greatest(len(w) // {rules.LONGEST_SHARE}, {_LOW}), {_HIGH}) + 1 AS size FROM d),
runs AS (SELECT doc_id, array_to_string(list_slice(w, i, i + size - 1), ' ') AS run FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM sized)),
long AS (SELECT DISTINCT doc_id FROM (SELECT doc_id FROM runs GROUP BY doc_id, run HAVING count(*) > 1)),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
counts AS (SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(w.word_chars, 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(coalesce(d.text, ''), '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(coalesce(l.n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(w.n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(w.covered, 0) AS covered, g.doc_id IS NOT NULL AS too_long
  FROM d LEFT JOIN words w ON w.doc_id = d.doc_id LEFT JOIN lines l ON l.doc_id = d.doc_id LEFT JOIN long g ON g.doc_id = d.doc_id),
base AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * covered <= {rules.MAX_COVERED} * n_words AND NOT too_long AS kept FROM base
"""


def op9_sql() -> str:
    numbers = ",".join(map(str, sharding.lookup(SHARDS)))
    return f"""
WITH t AS (SELECT string_split('{numbers}', ',') AS own),
d AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '\\N')), 1, 12) AS BIGINT) % {sharding.SLOTS} AS INTEGER) AS slot FROM documents)
SELECT doc_id, slot, 'shard-' || lpad(t.own[slot + 1], 2, '0') AS shard FROM d, t
"""


SQL = {"op6_passages": OP6_SQL, "op7_decontaminate": OP7_SQL, "op9_sharding": op9_sql(), "op10_rules": OP10_SQL}
