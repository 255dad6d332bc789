"""Models and tables against plain loops, and rows that are odd in ways the other tests leave out."""

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from lakeweave.llm import packing, passages, quality, sharding, toxicity


def test_log_density_difference_is_that_of_two_gaussians():
    rng = np.random.default_rng(4)
    y = np.repeat([0.0, 1.0], 200)
    x = rng.normal(0, 1, (400, 4)) * np.where(y == 1, 2.0, 1.0)[:, None] + y[:, None] * [1, 0, -1, 2]
    pooled, round_ = 0.4, 0.05
    got = quality._classes(x, y, pooled, round_).difference(x)
    z = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-3)
    groups = [z[y == k] for k in (0, 1)]
    cov = [sum(np.outer(r - g.mean(axis=0), r - g.mean(axis=0)) for r in g) / len(g) for g in groups]
    both = (200 * cov[0] + 200 * cov[1]) / 400
    logs = []
    for g, c in zip(groups, cov):
        c = (1 - pooled) * c + pooled * both
        c = (1 - round_) * c + round_ * np.trace(c) / 4 * np.eye(4)
        logs.append(np.array([-0.5 * (r - g.mean(axis=0)) @ np.linalg.solve(c, r - g.mean(axis=0)) - 0.5 * np.log(np.linalg.det(2 * np.pi * c)) + np.log(0.5) for r in z]))
    assert np.allclose(got, logs[1] - logs[0])


def test_quality_with_labels_of_one_kind_or_none(spark):
    docs = spark.createDataFrame([(i, "some words of a text " * (i + 1)) for i in range(12)] + [(None, "x"), (12, None)], "doc_id long, text string")
    for labels, want in (([(i, 1) for i in range(12)], 0.99), ([], 0.5)):
        model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        got = quality.score(docs, model).collect()
        assert len(got) == 14 and all(abs(r.score - want) < 1e-9 for r in got)


def test_toxic_scores_follow_from_all_paths():
    """Words' odds, their marginals over all labellings of a line, and the document's score, each by a plain loop."""
    words = ["bad", "fine", "awful", "day"]
    move = np.array([[1.0, 0.4], [0.6, 1.5]])
    model = toxicity.Model(pa.array(["bad", "awf*", "day"]), np.array([2.0, 1.5, -1.0]), -1.0, move, np.array([-2.0, 1.0, 3.0]))
    odds = np.exp([-1 + 2.0, -1, -1 + 1.5, -1 - 1.0])  # awful has the first letters awf*
    total, on = 0.0, np.zeros(4)
    for path in range(16):
        s = [0] + [path >> i & 1 for i in range(4)]
        w = np.prod([odds[i] if s[i + 1] else 1.0 for i in range(4)]) * np.prod([move[a, b] for a, b in zip(s, s[1:])])
        total, on = total + w, on + w * np.array(s[1:])
    p = on / total
    values, codes, lines, docs = toxicity.chains(pa.array([" ".join(words), None]))
    got = model.tokens(values, codes, lines)
    assert np.allclose(got, p)
    want = 1 / (1 + np.exp(-(-2 + np.log1p(p.sum()) + 3 * p.max())))
    assert np.allclose(model.score(got, docs), [want, 1 / (1 + np.exp(2.0))])


def test_lookup_table_is_filled_in_turns():
    names, slots = [f"n{i}" for i in range(7)], 101
    number = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:12], 16)
    orders = [[(number(f"{s}/offset") + k * (number(f"{s}/skip") % (slots - 1) + 1)) % slots for k in range(slots)] for s in names]
    table, turn = {}, 0
    while len(table) < slots:
        slot = next(x for x in orders[turn % 7] if x not in table)
        table[slot] = turn % 7
        turn += 1
    assert sharding.lookup(names, slots) == [table[i] for i in range(slots)]
    with pytest.raises(ValueError):
        sharding.lookup(names, 100)


def test_packing_keeps_repeated_rows_and_null_keys(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(8, "twice the same"), (8, "twice the same"), (None, "no key"), (None, None), (9, "")], "doc_id long, text string").coalesce(1)
    got = packing.pack(docs, path).collect()
    assert sorted((r.doc_id or 0, r.length == r.doc_tokens) for r in got) == [(0, True), (0, True), (8, True), (8, True), (9, True)]
    assert len({r.ids for r in got if r.doc_id == 8}) == 1 and len({(r.sequence_id, r.offset) for r in got}) == 5


def test_tokens_are_the_same_after_forgetting(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = pa.array(["some words here", "other words there now", None, "some words again"])
    want = [x.tolist() for x in packing.Tokens(path).of(texts)]
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    small = packing.Tokens(path)
    for _ in range(2):
        assert [x.tolist() for x in small.of(texts)] == want


@pytest.mark.parametrize("seed", range(3))
def test_matching_statistics_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    base = [bytes(rng.integers(0, 3, 300, dtype=np.uint8)) for _ in range(4)]

    def pieces(n):
        out = []
        for _ in range(n):
            size = int(rng.integers(passages.WINDOW, passages.LONGEST + 1))
            at = int(rng.integers(0, 300 - size))
            one = bytearray(base[rng.integers(4)][at : at + size])
            if rng.random() < 0.6:
                one[rng.integers(size)] = int(rng.integers(0, 5))
            out.append(bytes(one))
        return out

    def table(each):
        rows, lengths = np.zeros((len(each), passages.WIDTH), np.uint8), np.array([len(x) for x in each])
        for row, x in zip(rows, each):
            row[: len(x)] = np.frombuffer(x, np.uint8)
        return rows, lengths

    held, asked = pieces(40), pieces(60)
    least = rng.integers(0, 100, 40)
    index = passages.RunIndex(*table(held), least)
    assert len(index.head) < len(index.left)  # runs are fewer than bytes
    got = index.stream(*table(asked))
    for q, x in enumerate(asked):
        for w in range(passages.SPREAD):
            found = [int(d) for y, d in zip(held, least) if w + 50 <= len(x) and x[w : w + 50] in y]
            assert got[q, w] == (min(found) if found else passages.NONE)


def test_nothing_is_marked_without_the_index(spark, tiny, monkeypatch):
    docs = [(1, "a passage of more than fifty bytes that two documents hold in full"), (2, "a passage of more than fifty bytes that two documents hold in full, and more")]
    part = passages._dealt(spark.createDataFrame(docs, "id long, text string").selectExpr("id", "0 AS nth", "text"), 1).collect()
    held = [(r.n, r.pieces) for r in part]
    assert sum(len(x) for x in passages._spans(held)) > 0
    monkeypatch.setattr(passages.RunIndex, "stream", lambda self, rows, lengths: np.full((len(rows), passages.SPREAD), passages.NONE))
    assert sum(len(x) for x in passages._spans(held)) == 0


def test_texts_of_one_key_are_told_apart(spark):
    shared = "this sentence is longer than fifty bytes and stands in many of the rows"
    docs = spark.createDataFrame([(1, shared), (5, shared + " five"), (5, "nothing in common with any other row of this small table"), (5, shared + " five"), (None, shared)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_bytes, r.n_removed) for r in passages.strip(docs).collect()))
    assert got == [(0, 71, 0), (1, 71, 0), (5, 56, 0), (5, 76, 71), (5, 76, 71)]


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    home = str(tmp_path_factory.mktemp("odd"))
    text = lambda k: " ".join(f"{k}w{i}" for i in range(30))
    rows = [(1, text("a")), (1, text("a")), (2, text("b")), (None, text("c")), (None, text("c")), (None, text("d")), (3, None), (4, ""), (5, text("a"))]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, None, None, None) for i, t in rows], columns).write.parquet(f"{home}/full/documents.parquet")
    spark.createDataFrame([], columns).write.parquet(f"{home}/none/documents.parquet")
    for kind in ("full", "none"):
        spark.createDataFrame([(None, None), (1, "x y z")], "item_id long, text string").write.parquet(f"{home}/{kind}/benchmark.parquet")
    return home


def test_pipeline_on_repeated_rows_null_keys_and_no_rows(spark, odd_tables):
    full = corpus_pipeline.run(spark, f"{odd_tables}/full").collect()
    assert sorted(str(r.doc_id) for r in full) == ["1", "1", "2", "None", "None"]
    assert corpus_pipeline.run(spark, f"{odd_tables}/none").collect() == []


def test_pipeline_packs_what_the_stages_before_it_left(spark, odd_tables):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{odd_tables}/full/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"{odd_tables}/full").cache()
    want = sorted((str(r.doc_id), tuple(plain.encode(r.text, add_special_tokens=False).ids + [2])) for r in docs.collect())
    by = {}
    for r in corpus_pipeline.run(spark, f"{odd_tables}/full").collect():
        by.setdefault((str(r.doc_id), r.sequence_id, r.offset), []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert sorted((k[0], tuple(v)) for k, v in by.items()) == want
