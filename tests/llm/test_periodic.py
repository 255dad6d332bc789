import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeweave.llm import periodic, queries


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least):
    """All (start, length, period): every stretch whose words come again q words later, if no smaller period fits it."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] == words[i + q]:
                j = i
                while j + q < n and words[j] == words[j + q]:
                    j += 1
                whole = words[i : j + q]
                if len(whole) >= max(least, 2 * q) and not any(whole[r:] == whole[:-r] for r in range(1, q)):
                    out.append((i, len(whole), q))
                i = j
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def edited(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def expected(doc_id, text):
    words = edited(doc_id, text)
    runs = brute(words, periodic.LEAST)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), min_size=1, max_size=4), st.sampled_from([2, 5, 12]))
def test_runs_of_small_alphabets(docs, least):
    offsets = np.cumsum([0, *map(len, docs)])
    got = periodic.runs_of(np.array([x for d in docs for x in d], np.int64), offsets, least)
    want = [(o + s, o + s + n, q) for o, d in zip(offsets, docs) for s, n, q in brute(d, least)]
    assert [tuple(r) for r in got.tolist()] == want


@pytest.mark.parametrize("words", [["a"] * 3000, ["a", "b"] * 1500 + ["c"] + ["a", "b"] * 700, [w for i in range(40) for w in ["x", "y", f"z{i % 2}"] * 5]])
def test_runs_of_long_repetition(words):
    codes = np.unique(words, return_inverse=True)[1].astype(np.int64)
    got = periodic.runs_of(codes, np.array([0, len(codes)]))
    assert [(s, e - s, q) for s, e, q in got.tolist()] == brute(words, periodic.LEAST)


def test_fibonacci_words():
    x, y = "b", "a"
    for _ in range(12):
        x, y = y, y + x
    codes = np.frombuffer(y.encode(), np.uint8).astype(np.int64)
    got = periodic.runs_of(codes, np.array([0, len(codes)]))
    assert [(s, e - s, q) for s, e, q in got.tolist()] == brute(list(y), periodic.LEAST)


def test_query_on_the_given_documents(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()
    got = {tuple(r) for r in queries.op13_periodic_runs(spark, tiny).collect()}
    some = [d for d in docs if len(WORD.findall(d.text or "")) < 1500]
    assert len(some) > 150 and {expected(d.doc_id, d.text) for d in some} <= got and len(got) == len(docs)


def test_nulls_ties_and_clashing_names(spark):
    many = "a b c d " * 5
    rows = [(1, None, 0), (2, "", 1), (3, " \n ", 2), (None, many, 3), (4, many, 4), (4, many, 5), (5, "one", 6), (6, "w " * 200_000, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = periodic.runs(docs).collect()
    by = lambda i: [(r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got if r.doc_id == i]
    assert by(1) == by(2) == by(3) == [(0, [], "")]
    assert by(None) == by(4)[:1] and by(4) == [(20, [(0, 20, 4)], "a b c d")] * 2
    assert by(5) == [(1, [], "one")] and by(6) == [(200_000, [(0, 200_000, 1)], "w")]
    assert periodic.runs(docs.limit(0)).collect() == [] and got[0].asDict().keys() == {"doc_id", "n_words", "runs", "collapsed"}
    assert {r.doc_id for r in periodic.repeated_tails(docs).collect()} == {1, 2, 3, 4, 5, 6, None}
