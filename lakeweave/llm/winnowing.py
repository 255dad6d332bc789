"""Document fingerprints by winnowing (operator 11), in SQL expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.llm.columns import cut, shuffle_width

#: Code points of a gram, and grams of a window. Any stretch of GRAM + WINDOW - 1 code points that two texts share is found.
GRAM, WINDOW = 12, 16
REACH = GRAM + WINDOW - 1
#: Windows whose grams are held at once (a gram's place among them must fit the 12 low bits of its number).
STRETCH = 1024
#: Low bits of neighbouring keys that are kept together, the block of rows without a key, and hashes by which these are dealt.
BLOCK_BITS, NO_KEY, SPREAD = 8, -(1 << 60), 1 << 16


def _windows(n: str) -> str:
    """SQL for the number of windows of n code points: at least one, unless there are none."""
    return f"IF({n} = 0, 0, greatest({n} - {REACH - 1}, 1))"


def _let(name: str, value: str, body: str) -> str:
    """SQL that evaluates the array `body` with `name` bound to `value`, which is computed once."""
    return f"flatten(transform(array({value}), {name} -> {body}))"


def picks_sql(text: str) -> str:
    """SQL for the winnowed grams of a text: array of (a: first window that picks it, pos: code point, hash), by position.

    A gram's hash is the upper 52 bits of the XXH64 of its code points as UTF-32; a shorter text is one gram. Of each
    window of WINDOW grams (or all, if there are fewer) the one of least hash is picked, of equal ones the rightmost:
    the 12 low bits of the compared number count down along the text. Least values of 2, 4, 8, ... neighbours are made
    one from the other. Long texts are worked on in stretches, so only what is picked is held for a whole text.
    """
    grams = f"greatest(length(e) div 4 - {GRAM - 1}, 1)"
    steps, reach = [], 1
    while reach < WINDOW:
        step = min(reach, WINDOW - reach)
        steps.append(step)
        reach += step
    last = f"m{len(steps)}"
    place = f"s * {STRETCH} + 4095 - CAST({{}} & 4095L AS INT)"
    # Numbers tell their places, so equal ones are one gram. A smaller one came in on the right, a larger one was left over.
    first = f"IF(j = 0, s * {STRETCH}, IF(x < get(d, j - 1), {place.format('x')} - {WINDOW - 1}, {place.format('get(d, j - 1)')} + 1))"
    body = _let("d", f"array_distinct(slice({last}, 1, least({STRETCH}, n - s * {STRETCH})))", f"transform(d, (x, j) -> named_struct('a', {first}, 'pos', {place.format('x')}, 'hash', shiftright(x, 12)))")
    for i in range(len(steps), 0, -1):
        body = _let(f"m{i}", f"transform(m{i - 1}, (x, j) -> least(x, get(m{i - 1}, j + {steps[i - 1]})))", body)
    hashed = f"transform(sequence(4 * s * {STRETCH} + 1, 4 * least({grams}, s * {STRETCH} + {STRETCH + WINDOW - 1}) - 3, 4), (i, j) -> (xxhash64(substring(e, i, {4 * GRAM})) & -4096L) | (4095 - j))"
    each = f"flatten(transform(sequence(0, (n - 1) div {STRETCH}), s -> {_let('m0', hashed, body)}))"
    none = "CAST(array() AS ARRAY<STRUCT<a: INT, pos: INT, hash: BIGINT>>)"
    whole = _let("e", f"encode({text}, 'UTF-32')", _let("n", f"CAST({_windows('(length(e) div 4)')} AS INT)", f"IF(n = 0, {none}, {each})"))
    return _once(whole)


def _once(picks: str) -> str:
    """Picks without those that the pick before them repeats, as happens where stretches meet."""
    return _let("p", picks, "filter(p, (x, i) -> i = 0 OR x.pos <> get(p, i - 1).pos)")


def likeness_sql(a: str, b: str) -> str:
    """SQL for the Jaccard similarity of two texts' sets of picked hashes; 1 if both are empty."""
    return f"(size(array_intersect({a}.hash, {b}.hash)) + IF(size({a}) + size({b}) = 0, 1, 0)) / greatest(size(array_union({a}.hash, {b}.hash)), 1)"


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, picks): each text's winnowed grams, as `picks_sql` tells. Map only.

    Null and empty texts have no grams. Repeated rows are read one by one, null keys stay; other columns are not read.
    """
    one = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    return one.select(key, F.length("__text").cast("long").alias("n_chars"), F.expr(picks_sql("__text")).alias("picks"))


def _next_blocks(blocks: DataFrame) -> DataFrame:
    """blocks (b, c: distinct) -> (b, c, nb, nc): the one after it in order, the first one after the last.

    Blocks are dealt out by ranges; what joins the ranges is one row for each of them.
    """
    ranged = cut(blocks.repartitionByRange(shuffle_width(blocks.sparkSession), "b", "c").withColumn("part", F.spark_partition_id()))
    inside = ranged.withColumn("next", F.lead(F.struct("b", "c")).over(Window.partitionBy("part").orderBy("b", "c")))
    parts = ranged.groupBy("part").agg(F.min_by(F.struct("b", "c"), F.struct("b", "c")).alias("first"))  # at most one row for each shuffle partition
    ring = Window.orderBy("part")
    parts = parts.select("part", F.coalesce(F.lead("first").over(ring), F.first("first").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("then"))
    joined = inside.join(F.broadcast(parts), "part").withColumn("next", F.coalesce("next", "then"))
    return joined.select("b", "c", F.col("next.b").alias("nb"), F.col("next.c").alias("nc"))


def compared(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, n_chars, edited, picks, edited_picks, near_edited and near_next.

    edited: the text with its last half (rounded down) replaced by as many code points, or all, of the start of the next
    text by ascending key (an integer; rows without a key come first, by their text's hash; rows of one key go by their
    text; after the last row comes the first). picks are those of the text, edited_picks those of `edited`, put together
    from the text's own picks, the next text's and the few windows over the seam. near_edited, near_next: the likeness
    of the text's picks to those of `edited` and of the next text.

    Null texts are empty; an empty text has no picks, and a single row is its own next one. An empty table gives no rows.
    Other columns are not read, so their names cannot clash. Texts are shuffled once, by blocks of neighbouring keys, and
    of each block the first text once more; rows that repeat one key stand in one block.
    """
    kind = docs.schema[key].dataType
    own = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    # Not nullable, so that the dealt texts serve both uses below.
    own = own.withColumns({"b": F.expr(f"coalesce(shiftright(id, {BLOCK_BITS}), {NO_KEY})"), "c": F.when(F.col("id").isNull(), F.coalesce(F.pmod(F.xxhash64("t"), F.lit(SPREAD)), F.lit(0))).otherwise(0)})
    chain = _next_blocks(own.select("b", "c").distinct())
    dealt = own.repartition(shuffle_width(docs.sparkSession), "b", "c")
    inside = Window.partitionBy("b", "c").orderBy("id", "t")
    marked = dealt.sortWithinPartitions("b", "c", "id", "t").select("b", "c", "id", "t", F.length("t").alias("n"), F.expr(picks_sql("t")).alias("p"))
    marked = marked.withColumn("then", F.lead(F.struct("t", "n", "p")).over(inside))
    firsts = dealt.groupBy("b", "c").agg(F.min_by("t", F.struct("id", "t")).alias("t"))
    firsts = firsts.select(F.col("b").alias("nb"), F.col("c").alias("nc"), F.struct("t", F.length("t").alias("n"), F.expr(picks_sql("t")).alias("p")).alias("other"))
    heads = chain.join(firsts, ["nb", "nc"]).select(F.col("b").alias("ob"), F.col("c").alias("oc"), "other")
    met = marked.join(heads, (F.col("b") == F.col("ob")) & (F.col("c") == F.col("oc")) & F.col("then").isNull(), "left")
    met = met.select("id", "t", "n", "p", F.coalesce("then", "other").alias("o"))
    met = met.withColumns({"h": F.expr("n - n div 2"), "m": F.expr("least(n div 2, o.n)")})
    edited = "concat(substring(t, 1, h), substring(o.t, 1, m))"
    # Windows before `a` lie in the text's own part, those from h on in the other's; the rest lie over the seam.
    a = f"greatest(h - {REACH - 1}, 0)"
    over = f"IF({a} < least(h, {_windows('(h + m)')}), substring({edited}, {a} + 1, least(h + m, h + {REACH - 1}) - {a}), '')"
    parts = f"""concat(filter(p, x -> x.a < {a}),
      transform({picks_sql(over)}, x -> named_struct('a', x.a + {a}, 'pos', x.pos + {a}, 'hash', x.hash)),
      transform(filter(o.p, x -> x.a <= m - {REACH}), x -> named_struct('a', x.a + h, 'pos', x.pos + h, 'hash', x.hash)))"""
    met = met.withColumn("q", F.explode(F.array(F.expr(_once(parts)))))  # a generator, so that it is computed once
    return met.select(
        F.col("id").cast(kind).alias(key), F.col("n").cast("long").alias("n_chars"), F.expr(edited).alias("edited"), F.col("p").alias("picks"), F.col("q").alias("edited_picks"),
        F.expr(likeness_sql("p", "q")).alias("near_edited"), F.expr(likeness_sql("p", "o.p")).alias("near_next"),
    )


def digest_sql(picks: str) -> str:
    """SQL for a fingerprint as one string: the SHA-256 of its positions and hashes."""
    return f"sha2(array_join(transform({picks}, x -> concat(x.pos, ':', hex(x.hash))), ' '), 256)"
