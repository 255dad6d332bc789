"""Benchmark decontamination by prefix-filtered set join (operator 7), in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.columns import LOWER, UPPER, cut, shingle_hashes

#: Words of a window, and of the shingles that stand for it in the join.
WINDOW, SHINGLE = 10, 3
#: A side is broadcast only if it was counted and has at most so many rows (of some tens of bytes).
BROADCAST_ROWS = 500_000


def bench_words(text: Column) -> Column:
    """Runs of digits, letters a-z (A-Z lower-cased) and non-ASCII characters. Null: an empty array."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def windows(items: DataFrame, key: str, text: str, width: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(wid, words) of all distinct windows and (wid, item) of the items that have them.

    A window is `width` consecutive words of an item; an item of fewer words, but not none, is one window.
    """
    w = items.select(F.col(key).alias("item"), bench_words(F.col(text)).alias("w")).where("size(w) > 0")
    each = w.select("item", F.explode(F.expr(f"transform(sequence(0, greatest(size(w) - {width}, 0)), i -> transform(sequence(i, least(i + {width}, size(w)) - 1), j -> get(w, j)))")).alias("words")).distinct()
    each = each.select(F.sha2(F.array_join("words", " "), 256).alias("wid"), "words", "item")
    return each.select("wid", "words").distinct(), each.select("wid", "item")


def occurrences(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", width: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(base, found): one row (id, th, n_words) per row of docs, and (id, th, spans, items) for the texts with a hit.

    th is the text's hash, which tells rows of one id with different texts apart. Steps: (1) all item shingles, by hash,
    meet all document shingles with their positions; (2) counted over all documents, each window keeps its rarest
    shingle, the only prefix token that exact containment needs, and windows with an absent shingle go; (3) length and
    position bounds drop starts outside the text; (4) the words of the remaining starts are compared one by one.
    """
    spark = docs.sparkSession
    wins, owners = windows(items, item_key, item_text, width)
    wins, owners = cut(wins), cut(owners)
    parts = wins.select("wid", F.size("words").alias("len"), F.posexplode(shingle_hashes("words", SHINGLE)).alias("off", "h"))
    parts = cut(parts)
    tokens = parts.select("h").distinct().withColumn("known", F.lit(True))
    sizes = sorted(r[0] for r in parts.select(F.least("len", F.lit(SHINGLE)).alias("s")).distinct().collect())  # at most SHINGLE values

    tokenised = docs.select(F.col(doc_key).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), bench_words(F.col(text)).alias("w"))
    # Every row keeps its first position, whether it matches or not, as the row that stands for the document.
    arrays = [shingle_hashes("w", SHINGLE)]
    for s in sizes:
        if s < SHINGLE:  # only an item of fewer words than a shingle needs shorter ones
            arrays.append(F.when(F.size("w") > s, shingle_hashes("w", s)).otherwise(F.expr("CAST(array() AS ARRAY<BIGINT>)")))
    hashed = tokenised.select("id", "th", F.size("w").alias("n_words"), *[a.alias(f"h{i}") for i, a in enumerate(arrays)])
    # Outer explodes, as a plain one gets a filter on its array that is computed from the text again for every word.
    spread = None
    for i in range(len(arrays)):
        one = hashed.select("id", "th", "n_words", F.lit(i == 0).alias("main"), F.posexplode_outer(f"h{i}").alias("pos", "h"))
        spread = one if spread is None else spread.unionByName(one)
    met = spread.join(_small(tokens, tokens.count()), "h", "left").where("known OR (main AND coalesce(pos, 0) = 0)")
    met = cut(met.select("id", "th", "n_words", "main", "pos", "h", "known"))

    counts = met.where("known").groupBy("h").agg(F.count("*").alias("n"))
    ranked = parts.join(counts, "h", "left").groupBy("wid", "len").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "h")).alias("rarest"))
    prefix = cut(ranked.where("rarest.n > 0").select("wid", "len", "rarest.off", "rarest.h"))
    n_prefix = prefix.count()

    starts = met.where("known").join(_small(prefix, n_prefix), "h").where("pos >= off AND pos - off + len <= n_words")
    starts = starts.select("id", "th", (F.col("pos") - F.col("off")).alias("start"), "wid").distinct()
    wanted = wins.join(_small(prefix.select("wid"), n_prefix), "wid", "left_semi")  # one row a wid, so n_prefix at most
    named = starts.join(_small(wanted, n_prefix), "wid")
    listed = cut(named.groupBy("id", "th").agg(F.collect_list(F.struct("start", "wid", "words")).alias("starts")))
    sought = listed.select("id", "th")
    texts = tokenised.join(_small(sought, sought.count()), (tokenised["id"].eqNullSafe(sought["id"])) & (tokenised["th"] == sought["th"]), "left_semi").dropDuplicates(["id", "th"])
    checked = texts.alias("t").join(listed.alias("l"), F.col("t.id").eqNullSafe(F.col("l.id")) & (F.col("t.th") == F.col("l.th")))
    checked = checked.select("t.id", "t.th", F.expr("filter(starts, s -> forall(sequence(0, size(s.words) - 1), j -> get(w, s.start + j) = s.words[j]))").alias("hits")).where("size(hits) > 0")
    checked = cut(checked.select("id", "th", F.expr("transform(hits, s -> named_struct('start', s.start, 'len', size(s.words)))").alias("spans"), F.expr("array_distinct(transform(hits, s -> s.wid))").alias("wids")))

    held = checked.select("id", "th", F.explode("wids").alias("wid")).join(_small(owners, owners.count()), "wid")
    held = held.groupBy("id", "th").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    found = checked.alias("c").join(held.alias("o"), F.col("c.id").eqNullSafe(F.col("o.id")) & (F.col("c.th") == F.col("o.th")), "left")
    found = found.select("c.id", "c.th", "spans", F.coalesce("items", F.expr("CAST(array() AS ARRAY<STRING>)")).alias("items"))
    base = met.where("main AND coalesce(pos, 0) = 0").select("id", "th", "n_words")
    return base, found


def contamination(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", width: int = WINDOW) -> DataFrame:
    """One row per row of docs: its words, the words inside any occurrence of an item window, and those items.

    Columns: the key, n_words, n_hit, items (item keys as strings, sorted) and spans (start, len in words, overlapping).
    Null and wordless texts have no words and no hits; null and wordless items have no windows; null item keys are not
    listed. Repeated rows and items count once each as rows, repeated windows once. Other columns are not read.
    """
    base, found = occurrences(docs, items, doc_key, text, item_key, item_text, width)
    hit = "size(array_distinct(flatten(transform(spans, s -> sequence(s.start, s.start + s.len - 1)))))"
    found = found.select("id", "th", F.expr(f"CAST({hit} AS BIGINT)").alias("n_hit"), "items", "spans")
    out = base.alias("b").join(found.alias("f"), F.col("b.id").eqNullSafe(F.col("f.id")) & (F.col("b.th") == F.col("f.th")), "left")
    return out.select(
        F.col("b.id").alias(doc_key), F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.expr("CAST(array() AS ARRAY<STRING>)")).alias("items"), "spans",
    )


def keep(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text holds no item window. Rows without words stay."""
    _, found = occurrences(docs, items, key, text)
    dirty = found.select(F.col("id").alias("__id"), F.col("th").alias("__th"))
    return docs.join(_small(dirty, dirty.count()), docs[key].eqNullSafe(dirty["__id"]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == dirty["__th"]), "left_anti")
