import random
import re
import zlib
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from lakeweave.llm import queries, variants


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, times=variants.TIMES):
    """{word: (form, root, n, n_near, form_n)}; candidates share a text that is left when one letter goes from each, or from one."""
    near, left = defaultdict(set), defaultdict(set)
    for w in counts:
        for x in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            left[x].add(w)
    for some in left.values():
        for a in some:
            near[a].update(b for b in some if a != b and b not in near[a] and one_apart(a, b))
    form = {}
    for w, n in counts.items():
        top = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = top if top is not None and counts[top] >= times * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), counts.get(form[w]))
    return out


def rows(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abc", min_size=3, max_size=4), max_size=60), st.sampled_from([1, 2, variants.FREE]))
def test_near_pairs(words, most):
    words = sorted(words)
    got = [tuple(sorted((words[a], words[b]))) for a, b in variants.near_pairs(words, 3, most)]
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), 3)
    want = [(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if one_apart(a, b) and min(len(a), len(b)) == 3 and common(a, b) < most]
    assert sorted(got) == sorted(want)


def test_random_words_in_groups_of_all_sizes(spark):
    rng = random.Random(2)
    counts = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 9))): rng.choice([1, 2, 5, 6, 30, 150, 800]) for _ in range(1500)}
    vocabulary = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = brute(counts)
    assert len({v[1] for v in want.values()}) > 10 and any(v[0] and v[0] != v[1] for v in want.values())
    for heavy in (variants.HEAVY, 40, 3):
        assert rows(variants.variants(vocabulary, heavy=heavy)) == want


def test_given_documents(spark, tiny):
    counts = Counter()
    for r in spark.read.parquet(f"{tiny}/documents.parquet").collect():
        for w in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{r.doc_id}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    got = queries.op12_spelling_variants(spark, tiny)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert len(counts) > 500 and rows(got) == brute(counts)


def test_nulls_repeated_rows_and_long_runs(spark):
    long = "z" * 50_000
    text = "Shipping shiping SHIPPING shipping; shipping shipping"
    rows_ = [(1, None, "x"), (None, text, "x"), (2, text, "x"), (2, text, "x"), (3, "", "x"), (4, f"{long} {long} {long} {long} {long} {long}b", "x")]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, word string").withColumn("n", variants.F.lit(0))
    assert rows(variants.spelling_variants(docs, often=3)) == {"shipping": (None, "shipping", 15, 1, None), "shiping": ("shipping", "shipping", 3, 1, 15), long: (None, long, 5, 0, None)}
    assert rows(variants.spelling_variants(docs.limit(0))) == {}
    assert rows(variants.variants(spark.createDataFrame([("", 5), ("a", 9), ("ab", 1)], "word string, n long"))) == {"": (None, "", 5, 0, None), "a": (None, "a", 9, 1, None), "ab": ("a", "a", 1, 1, 9)}
