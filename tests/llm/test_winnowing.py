import hashlib
import random

import xxhash

from lakeweave.llm import queries, winnowing
from lakeweave.llm.winnowing import GRAM, WINDOW


def brute(text):
    """[(pos, hash)]: of every window the gram of least hash, the rightmost of equal ones."""
    grams = [text[i : i + GRAM] for i in range(max(len(text) - GRAM + 1, 1))] if text else []
    hashes = []
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode("utf-32-be"), 42)
        hashes.append((h - (1 << 64) if h >> 63 else h) >> 12)
    picked = set()
    for i in range(max(len(grams) - WINDOW + 1, 1) if grams else 0):
        picked.add(min(range(i, min(i + WINDOW, len(grams))), key=lambda j: (hashes[j], -j)))
    return [(i, hashes[i]) for i in sorted(picked)]


def likeness(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(docs):
    """{key: row} of (key, text) in order."""
    out = {}
    for i, (key, text) in enumerate(docs):
        other = docs[(i + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        own = brute(text)
        out[key] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), own, brute(edited), likeness(own, brute(edited)), likeness(own, brute(other)))
    return out


def got(df):
    pairs = lambda picks: [(x.pos, x.hash) for x in picks]
    return {r.doc_id: (r.n_chars, hashlib.sha256(r.edited.encode()).hexdigest(), pairs(r.picks), pairs(r.edited_picks), r.near_edited, r.near_next) for r in df.collect()}


def test_given_documents(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    want = expected(sorted((d.doc_id, d.text or "") for d in docs.collect()))
    assert got(winnowing.compared(docs)) == want
    rows = queries.op11_winnowing(spark, tiny).collect()
    assert {(r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in rows} == {(k, w[0], w[1], w[4], w[5]) for k, w in want.items()}
    prints = {}
    for r in rows:
        assert prints.setdefault(tuple(want[r.doc_id][2]), r.fingerprint) == r.fingerprint and (r.fingerprint == r.edited_fingerprint) == (want[r.doc_id][2] == want[r.doc_id][3])
    assert len(set(prints.values())) == len(prints)


def test_short_texts_ties_and_stretches(spark):
    rng = random.Random(3)
    sizes = [0, 1, 2, 3, GRAM - 1, GRAM, GRAM + 1, GRAM + WINDOW - 2, GRAM + WINDOW - 1, GRAM + WINDOW, 40, 60, 100, 1000, 1023, 1024, 1050, 1051, 2074, 2500, 5000]
    texts = ["".join(rng.choice(letters) for _ in range(n)) for n in sizes * 2 for letters in ("a", "ab", "abcdefghijé😀 ")]
    rng.shuffle(texts)
    keys = sorted(rng.sample(range(-2000, 100_000), len(texts)))
    docs = list(zip(keys, texts))
    assert got(winnowing.compared(spark.createDataFrame(rng.sample(docs, len(docs)), "doc_id long, text string"))) == expected(docs)


def test_a_shared_stretch_is_found(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    shared = word(winnowing.REACH)
    texts = [word(rng.randrange(50, 300)) + shared + word(rng.randrange(50, 300)) for _ in range(40)]
    rows = winnowing.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    inside = [{x.hash for x in r.picks if 0 <= x.pos - texts[r.doc_id].index(shared) <= WINDOW - 1} for r in rows]
    assert set.intersection(*inside)


def test_nulls_repeated_rows_and_clashing_names(spark):
    rows = [(None, "no key", 0), (None, None, 1), (5, None, 2), (5, "five " * 20, 3), (5, "five " * 20, 4), (7, "", 5)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, b int").withColumn("c", winnowing.F.lit(1)).withColumn("n_chars", winnowing.F.lit("x"))
    out = winnowing.compared(docs)
    assert dict(out.dtypes)["doc_id"] == "int" and sorted((r.doc_id or 0, r.n_chars) for r in out.collect()) == [(0, 0), (0, 6), (5, 0), (5, 100), (5, 100), (7, 0)]
    last = {(r.doc_id, r.n_chars): r for r in out.collect()}[(7, 0)]
    assert last.edited == "" and last.picks == [] and last.near_edited == 1.0
    assert winnowing.compared(docs.limit(0)).collect() == []
    alone = winnowing.compared(docs.where("text = 'no key'")).collect()
    assert [(r.edited, r.near_next) for r in alone] == [("no no ", 1.0)]
