"""Grouping of spelling variants by errata tries (operator 12)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.columns import LOWER, UPPER, cut, give_back, shuffle_width

#: Letters of a word at least, and how often it occurs at least; how many times as often its form occurs at least.
LETTERS, OFTEN, TIMES = 6, 5, 5
#: Words of a group, whose trie is built in one task, at most; larger groups are cut again.
HEAVY = 20_000
FREE = 1 << 20
RUN = "[a-zÀ-ÿ]+"


class Trie:
    """A node: the nodes after it by letter, the word that ends here (-1: none) and how many words are below."""

    __slots__ = ("after", "word", "size")

    def __init__(self) -> None:
        self.after: dict[str, Trie] = {}
        self.word, self.size = -1, 0

    def add(self, letters: str, word: int) -> None:
        node = self
        node.size += 1
        for c in letters:
            node = node.after.setdefault(c, Trie())
            node.size += 1
        node.word = word


def _coincide(small: Trie, large: Trie, pairs: list[tuple[int, int]]) -> None:
    """Pairs of words that end at the same place below both; takes no longer than `small` has nodes."""
    both = [(small, large)]
    while both:
        a, b = both.pop()
        if a.word >= 0 and b.word >= 0:
            pairs.append((a.word, b.word))
        for c, x in a.after.items():
            if y := b.after.get(c):
                both.append((x, y))


def _merge(light: Trie, errata: dict, deep: int, pairs: list[tuple[int, int]]) -> None:
    """Lays a light child over those merged before it, whatever their letter: words that end at one place, `deep` letters on at most, are pairs."""
    both, ends = [(light, errata, 0)], []
    while both:
        a, e, depth = both.pop()
        if a.word >= 0:
            pairs.extend((a.word, other) for other in e.get("", ()))
            ends.append((e, a.word))
        if depth < deep:
            for c, x in a.after.items():
                both.append((x, e.setdefault(c, {}), depth + 1))
    for e, word in ends:
        e.setdefault("", []).append(word)


def near_pairs(words: list[str], length: int, most: int = FREE) -> list[tuple[int, int]]:
    """Pairs of distinct words (of `length` or one more letters) that one letter replaced, or dropped from the longer, makes equal.

    Both of a replaced pair have `length` letters. A pair is found where its words part in the trie, which must be at a depth
    below `most`. There the heavy child, the one with most words below, stays as it is and the light ones are merged into
    it and into each other with one letter replaced or skipped, so a word is touched log2 times its number of letters.
    """
    root = Trie()
    for i, w in enumerate(words):
        root.add(w, i)
    pairs: list[tuple[int, int]] = []
    todo = [(root, 0)]
    while todo:
        node, depth = todo.pop()
        if depth >= most:
            continue
        after = node.after
        if node.word >= 0:
            pairs.extend((node.word, x.word) for x in after.values() if x.word >= 0)
        if len(after) > 1:
            heavy = max(after.values(), key=lambda x: x.size)
            errata: dict = {}
            deep = length - depth - 1  # letters after the replaced one
            for c, light in after.items():
                if light is heavy:
                    continue
                if len(after) > 2 and deep >= 0:
                    _merge(light, errata, deep, pairs)
                # One letter replaced: the light child laid over the heavy one.
                both = [(light, heavy, 0)] if deep >= 0 else []
                while both:
                    a, b, d = both.pop()
                    if a.word >= 0 and b.word >= 0:
                        pairs.append((a.word, b.word))
                    if d < deep:
                        for x, y in a.after.items():
                            if z := b.after.get(x):
                                both.append((y, z, d + 1))
                # The light child's letter skipped: what follows it laid over its sisters.
                for x, y in light.after.items():
                    if x != c and (z := after.get(x)):
                        _coincide(y, z, pairs)
                # The heavy child's letter skipped.
                if z := heavy.after.get(c):
                    _coincide(light, z, pairs)
        todo.extend((x, depth + 1) for x in after.values() if x.size > 1)
    return pairs


def occurrences(docs: DataFrame, key: str = "doc_id", text: str = "text", letters: int = LETTERS, errata: int | None = None) -> DataFrame:
    """(word, n): how often each word of at least `letters` letters occurs in all texts; map-side sums, then one shuffle.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased. With errata, a run of length l loses
    its letter h % l (from 0) where errata divides h, the crc32 of `<key>:<run>` (a null key counts as empty).
    Null texts have no words.
    """
    runs = F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), F.lit(RUN), F.lit(0))
    one = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.explode(F.filter(runs, lambda w: F.length(w) >= letters)).alias("word"))
    if errata:
        one = one.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "word")))
        one = one.withColumn("word", F.expr(f"IF(h % {errata} = 0, concat(left(word, CAST(h % length(word) AS INT)), substring(word, CAST(h % length(word) AS INT) + 2)), word)"))
    return one.groupBy("word").agg(F.count("*").alias("n")).where(F.length("word") >= letters)


def _halves(rows: DataFrame) -> DataFrame:
    """Rows (group, rest, t, most, word, n) under two keys each: the first half of the rest, and the other half.

    Two rests of t or t + 1 letters that differ by one letter share the first p = t div 2 letters or the last t - p ones.
    Pairs that share the first ones are those of the first key; under the other key words must part before p.
    """
    head = "named_struct('group', concat(group, '<', left(rest, p)), 'rest', substring(rest, p + 1), 't', t - p, 'most', most - p)"
    tail = "named_struct('group', concat(group, '>', right(rest, t - p)), 'rest', left(rest, length(rest) - t + p), 't', p, 'most', least(most, p))"
    both = rows.withColumn("p", F.expr("CAST(t div 2 AS INT)")).select(F.explode(F.expr(f"array({head}, {tail})")).alias("x"), "word", "n")
    return both.select("x.*", "word", "n").where("most > 0")


def groups(vocabulary: DataFrame, heavy: int = HEAVY) -> list[DataFrame]:
    """vocabulary (word, n) -> rows (group, rest, t, most, word, n): any two words one letter apart share exactly one group.

    t: letters of the shorter rest. Groups of over `heavy` words, found by a count of all, are cut again by halves of
    what is left of their words; one letter is left at last, so a group is bounded by the alphabet then.
    """
    rows = vocabulary.where("word <> ''").select(F.explode(F.expr("array(length(word), length(word) - 1)")).alias("t"), "word", "n")
    rows = _halves(rows.select(F.col("t").cast("string").alias("group"), F.col("word").alias("rest"), "t", F.lit(FREE).alias("most"), "word", "n"))
    done = []
    while True:
        many = cut(rows.where("t > 1").groupBy("group").count().where(F.col("count") > heavy).select("group"))
        if many.isEmpty():
            return [*done, rows]
        done.append(rows.join(many, "group", "left_anti"))
        rows = cut(_halves(rows.join(many, "group", "left_semi")))


def _counted(rows: DataFrame) -> DataFrame:
    """(word, n_near, best): within each group how many near words a word has, and the one with most occurrences."""

    def out(rest: list[str], t: int, most: int, words: list[str], n: list[int]) -> tuple[list, list, list, list]:
        if len(words) < 2:
            return [], [], [], []
        order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))  # a smaller number is a better form
        near, best = [0] * len(order), [len(order)] * len(order)
        for a, b in near_pairs([rest[i] for i in order], t, most):
            near[a] += 1
            near[b] += 1
            if b < best[a]:
                best[a] = b
            if a < best[b]:
                best[b] = a
        met = [i for i, c in enumerate(near) if c]
        return [words[order[i]] for i in met], [near[i] for i in met], [n[order[best[i]]] for i in met], [words[order[best[i]]] for i in met]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[] for _ in range(6)]
        for batch in batches:
            columns = [old + new.to_pylist() for old, new in zip(columns, batch.columns)]
            keys, start, found = columns[0], 0, ([], [], [], [])
            for i in range(1, len(keys)):
                if keys[i] != keys[start]:
                    if i > start + 1:
                        for into, new in zip(found, out(columns[1][start:i], columns[2][start], columns[3][start], columns[4][start:i], columns[5][start:i])):
                            into.extend(new)
                    start = i
            columns = [c[start:] for c in columns]  # the last group may go on
            yield _batch(found)
        if columns[0]:
            yield _batch(out(columns[1], columns[2][0], columns[3][0], columns[4], columns[5]))
        give_back()

    def _batch(found: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "n_near", "best_n", "best"])

    dealt = rows.select("group", "rest", "t", "most", "word", "n").repartition(shuffle_width(rows.sparkSession), "group").sortWithinPartitions("group")
    return dealt.mapInArrow(run, "word string, n_near long, best_n long, best string")


def _roots(forms: DataFrame) -> DataFrame:
    """forms (word, form) -> (word, root): forms are followed to the last; each round doubles the steps taken."""
    ways = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = ways.select(F.col("word").alias("at"), F.col("root").alias("further"))
        ways = cut(ways.join(ahead, F.col("root") == F.col("at"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if ways.where("moved").isEmpty():
            return ways.select("word", "root")
        ways = ways.drop("moved")


def variants(vocabulary: DataFrame, times: int = TIMES, heavy: int = HEAVY) -> DataFrame:
    """vocabulary (word, n) -> one row per word: word, form, root, n, n_near, form_n.

    n_near: words that differ by exactly one inserted, deleted or replaced code point. form: of these the one with the
    largest n (of equal ones the smallest), if it has `times` or more times the word's n, else null; form_n is its n. root:
    the last form that forms lead to, the word itself if it has none.

    Words are distinct and not null; the empty word is near none. Each pair meets in one task, in a group of at most
    `heavy` words, and is counted there, so no pairs are shuffled. An empty vocabulary gives no rows.
    """
    words = cut(vocabulary.select("word", F.col("n").cast("long").alias("n")))
    parts = [_counted(rows) for rows in groups(words, heavy)]
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    best = found.groupBy(F.col("word").alias("w")).agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best"))).alias("top"))
    joined = words.join(best, F.col("word") == F.col("w"), "left")
    strong = -F.col("top.less") >= times * F.col("n")
    judged = cut(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("top.best")).alias("form"), F.when(strong, -F.col("top.less")).alias("form_n")))
    roots = _roots(judged.where("form IS NOT NULL")).withColumnRenamed("word", "w")
    return judged.join(roots, F.col("word") == F.col("w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", letters: int = LETTERS, often: int = OFTEN, errata: int | None = None) -> DataFrame:
    """The variants among the words of all texts that occur `often` times or more, see `occurrences` and `variants`.

    Null, empty and wordless texts add nothing; repeated rows count each time; very long texts and runs are taken whole; other
    columns are not read, so their names cannot clash; an empty table gives no rows.
    """
    return variants(occurrences(docs, key, text, letters, errata).where(F.col("n") >= often))
