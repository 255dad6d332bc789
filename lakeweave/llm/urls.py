"""URL rules and gradient-boosted trees on lexical features (operator 4), in DataFrame and Spark ML operations only."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.columns import LOWER, UPPER, cut

#: (verdict, host, path): a rule fits its host and all subdomains if the url's path starts with the rule's.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Labelled urls that the trees are fitted on, at most; chosen by the urls' hashes.
FIT_ROWS = 50_000
TREES, DEPTH = 20, 4
#: Suffixes, domains and first path parts are counted in so many hashed buckets each, so that table has a fixed size at most.
BUCKETS = 1 << 16
#: A labelled row's shares of blocked rows come from the domains of the other folds; so many rows of either kind are added.
FOLDS, PRIOR = 5, 2.0
LEXICAL = ["f_length", "f_host_length", "f_path_length", "f_depth", "f_labels", "f_digits", "f_entropy", "f_params", "f_fragment", "f_hyphens", "f_extension"]
COUNTED = ["suffix", "domain", "head"]
FEATURES = [*LEXICAL, "f_suffix_rows", "f_suffix_share", "f_domain_rows", "f_head_rows", "f_head_share"]


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; null and urls without :// have both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.substring(rest, F.length(host) + 1, F.greatest(F.length(rest), F.lit(1)))
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(F.regexp_extract(after, r"^[^?#]*", 0), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null where none fits."""
    rule = verdict = None
    for says, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return (rule, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def _entropy(text: str) -> Column:
    """Bits a character."""
    return F.expr(
        f"IF(length({text}) = 0, 0D, aggregate(array_distinct(split({text}, '')), 0D, "
        f"(a, c) -> IF(c = '', a, a - ((length({text}) - length(replace({text}, c, ''))) / length({text})) * log2((length({text}) - length(replace({text}, c, ''))) / length({text})))))"
    )


def features(pages: DataFrame, key: str, url: str, rules: list[tuple[str, str, str]]) -> DataFrame:
    """id, host, path, rule, ruled, label (1 block, 0 allow, null without a rule), fold, the buckets and the lexical features."""
    host, path = parts(F.col("u"))
    df = pages.select(F.col(key).alias("id"), F.col(url).alias("u")).withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    labels = F.split("host", r"\.")
    df = df.withColumns({"rule": rule, "ruled": verdict, "text": F.coalesce("u", F.lit("")), "suffix": F.element_at(labels, -1), "domain": F.array_join(F.slice(F.reverse(labels), 1, 2), "."), "head": F.regexp_extract("path", r"^/[^/]*", 0)})
    df = df.withColumns({
        "label": F.when(F.col("ruled") == "block", 1.0).when(F.col("ruled") == "allow", 0.0), "fold": F.expr(f"pmod(xxhash64(domain), {FOLDS})"), "order": F.xxhash64("text"),
        **{c: F.expr(f"CAST(pmod(xxhash64('{c}', {c}), {BUCKETS}) AS INT)") for c in COUNTED},
        "f_length": F.length("text"), "f_host_length": F.length("host"), "f_path_length": F.length("path"), "f_depth": F.expr("length(path) - length(replace(path, '/', ''))"), "f_labels": F.size(labels),
        "f_digits": F.length(F.regexp_replace("text", r"[^0-9]", "")) / F.greatest(F.length("text"), F.lit(1)), "f_entropy": _entropy("text"),
        "f_params": F.expr("IF(instr(text, '?') > 0, 1 + length(text) - length(replace(text, '&', '')), 0)"), "f_fragment": F.expr("int(instr(text, '#') > 0)"),
        "f_hyphens": F.expr("length(host) - length(replace(host, '-', ''))"), "f_extension": F.expr("int(path RLIKE '[.][a-zA-Z0-9]+$')"),
    })
    return df.select("id", "host", "path", "rule", "ruled", "label", "fold", "order", *COUNTED, *[F.col(c).cast("float").alias(c) for c in LEXICAL])


def with_statistics(df: DataFrame) -> DataFrame:
    """Adds for suffix, domain and head the log of their rows, and for suffix and head the share of blocked rows among labelled ones.

    One count over all rows, in at most BUCKETS buckets each, which are broadcast. A labelled row's share leaves out the
    domains of its own fold, its own label with them.
    """
    kinds = F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.col(c).alias("bucket")) for i, c in enumerate(COUNTED)]))
    each = df.select("fold", "label", kinds.alias("s")).groupBy("s.kind", "s.bucket", "fold").agg(F.count("*").alias("n"), F.count("label").alias("known"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("blocked"))
    table = each.groupBy("kind", "bucket").agg(F.sum("n").alias("n"), F.sum("known").alias("known"), F.sum("blocked").alias("blocked"), F.map_from_entries(F.collect_list(F.struct("fold", F.struct("known", "blocked")))).alias("own"))
    for i, c in enumerate(COUNTED):
        one = F.broadcast(table.where(F.col("kind") == i).select(F.col("bucket").alias("__bucket"), F.struct("n", "known", "blocked", "own").alias("__s")))
        less = lambda name: F.col(f"__s.{name}") - F.when(F.col("label").isNotNull(), F.coalesce(F.col("__s.own")[F.col("fold")][name], F.lit(0.0))).otherwise(0.0)
        df = df.join(one, F.col(c) == F.col("__bucket"), "left").withColumns({f"f_{c}_rows": F.log1p("__s.n"), f"f_{c}_share": (less("blocked") + PRIOR) / (less("known") + 2 * PRIOR)}).drop("__bucket", "__s")
    return df.withColumns({c: F.col(c).cast("double") for c in FEATURES})


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules: list[tuple[str, str, str]] = RULES, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per row of pages: key, host, path, rule, verdict and score (the trees' probability of block).

    The labelled urls are those a rule decides; the trees learn block against allow from at most fit_rows of them and
    decide the rest, both kinds with equal weight in total. With labels of one kind only, or none, the rest is allowed
    (score 0) or takes that one kind. Null urls and urls without :// have an empty host and path, fit no rule and are
    judged by the trees like any other, as are very long ones. Repeated rows are judged one by one; null keys stay null;
    other columns are not read, so their names cannot clash. An empty table gives no rows.
    """
    df = with_statistics(cut(features(pages, key, url, rules)))
    kinds = {r["label"]: r["count"] for r in df.where("label IS NOT NULL").groupBy("label").count().collect()}  # two at most
    if len(kinds) == 2:
        assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
        known = df.where("label IS NOT NULL").select("label", "order", *FEATURES).orderBy("order", *FEATURES).limit(fit_rows)
        known = known.withColumn("weight", F.when(F.col("label") == 1.0, sum(kinds.values()) / (2 * kinds[1.0])).otherwise(sum(kinds.values()) / (2 * kinds[0.0])))
        trees = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, minInstancesPerNode=5, stepSize=0.15, subsamplingRate=0.7, featureSubsetStrategy="0.5", seed=7)
        model = trees.fit(assembler.transform(known).select("label", "weight", "features"))
        df = model.transform(assembler.transform(df)).withColumn("score", F.element_at(vector_to_array("probability"), 2))
    else:
        df = df.withColumn("score", F.lit(next(iter(kinds), 0.0)))
    return df.select(F.col("id").alias(key), "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
