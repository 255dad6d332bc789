"""Each operator against brute force, and on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash

from pyspark.sql import functions as F

from lakeweave.llm import decontaminate, html, packing, passages, quality, rules, sharding, simhash, toxicity, urls
from lakeweave.llm.labelled import held_out

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
LONG = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
SAME = "the same sentence of more than fifty bytes stands in several documents here"
ODD = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "a"), (2, None, "b"), (3, "", None), (4, " \t\n\x0b\x0c\r ", "d"), (5, "one", "e"), (6, f"{SAME} and one", "f"),
    (7, f"{SAME} and two", None), (8, f"{SAME} and two", "h"), (8, f"{SAME} and two", "h"), (9, LONG, "i"), (10, LONG + " end", "j"), (None, SAME, "k"), (11, "É\x85ü 漢字 " * 30, "l"), (12, "<|endoftext|> it's 12 #$%", "m"),
]
SCHEMA = "doc_id long, text string, id string"


@pytest.fixture(scope="module")
def odd(spark):
    """Columns named like the operators' own."""
    df = spark.createDataFrame(ODD, SCHEMA)
    return df.selectExpr("*", "id AS fp", "id AS n_words", "id AS score", "id AS shard", "id AS th", "id AS h")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_rules(spark, odd, none):
    def brute(text):
        w, lines = SPACE.findall(text or ""), [x for x in (text or "").split("\n") if SPACE.search(x)]
        inside, grams = set(), {}
        for i in range(len(w) - 4):
            grams.setdefault(tuple(w[i : i + 5]), []).append(i)
        for at in grams.values():
            if len(at) > 1:
                inside.update(i + k for i in at for k in range(5))
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)

    texts = [t for _, t, _ in ODD] + ["a b c d e f " * 9, "x y z\nx y z\n\nx y z", "The " * 500, "p q r s t u v w p q r s t u v w z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in rules.judge(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), t[:50] if t else t
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
    assert got[len(ODD) + 2].longest_repeat == 499
    assert len(rows(rules.judge(odd))) == len(ODD) and rows(rules.judge(none)) == []
    kept = rules.keep(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {1, 6, 9} and rows(rules.keep(none)) == []


def test_each_limit_of_the_rules_rejects_alone(spark):
    p, q = lambda n: [f"p{i}" for i in range(n)], lambda n: [f"q{i}" for i in range(n)]
    lines = [[f"r{k}x{i}" for i in range(9)] for k in range(3)]
    texts = {
        "long": p(150) + q(2800) + p(150), "long for its size": p(22) + q(370) + p(22), "covered": sum((x + q(330)[30 * k : 30 * k + 30] + x for k, x in enumerate(lines)), q(250)[100:]),
        "clean": p(8) + q(400) + p(8), "base": p(30) + q(100) + p(30), "once": q(500),
    }
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id string, text string")
    got = {r.doc_id: (r.base_failed, r.too_covered, r.too_long, r.kept) for r in rules.judge(df).collect()}
    assert got["long"] == got["long for its size"] == (False, False, True, False)
    assert got["covered"] == (False, True, False, False) and got["base"][0] and not got["base"][3]
    assert got["clean"] == got["once"] == (False, False, False, True)
    assert {r.doc_id for r in rules.keep(df).collect()} == {"clean", "once"}


def test_the_rules_reject_rows_of_the_tables(spark, tiny):
    judged = rules.judge(spark.read.parquet(f"{tiny.replace('0.001', '0.01')}/documents.parquet")).where("NOT base_failed").toPandas()
    assert judged.too_covered.sum() > 0 and judged.too_long.sum() > 0 and judged.kept.mean() > 0.97


def fingerprint(text):
    w = SPACE.findall((text or "").translate(LOWER))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("heavy", [20_000, 2])
def test_simhash(spark, tiny, odd, none, heavy):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    f = {i: fingerprint(t) for i, t in docs}
    low = {i: i for i in f}
    for _ in range(len(f)):
        new = {i: min(low[j] for j in f if (f[i] ^ f[j]).bit_count() <= 3) for i in f}
        if new == low:
            break
        low = new
    got = {r.doc_id: (r.fp % 2**64, r.component) for r in simhash.near_groups(spark.createDataFrame(docs, "doc_id long, text string"), heavy=heavy).collect()}
    assert got == {i: (f[i], low[i]) for i in f}
    found = simhash.near_groups(odd, heavy=heavy).collect()
    assert len(found) == len(ODD) and {r.component for r in found if r.doc_id in (2, 3, 4)} == {2} and {r.component for r in found if r.doc_id in (7, 8)} <= {6, 7}
    assert rows(simhash.near_groups(none)) == [] and simhash.keep(odd).columns == odd.columns


def test_simhash_random_fingerprints(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    f = np.unique(np.concatenate([base] + [base ^ np.bitwise_or.reduce([np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64) for _ in range(k)]) for k in (1, 2, 3, 4, 5)]))
    df = spark.createDataFrame([(int(x.view(np.int64)),) for x in f], "fp long")
    for heavy in (20_000, 1):
        got = {frozenset((r.u % 2**64, r.v % 2**64)) for r in simhash.near_links(df, heavy).collect()}
        assert got == {frozenset((int(a), int(b))) for i, a in enumerate(f) for b in f[i + 1 :] if int(a ^ b).bit_count() <= 3}


def removed(docs):
    first, out = {}, []
    for i, t in sorted(((i, (t or "").encode()) for i, t in docs), key=lambda x: x[0]):
        mask = np.zeros(len(t), bool)
        for k in range(len(t) - 49):
            if first.setdefault(t[k : k + 50], i) < i:
                mask[k : k + 50] = True
        kept = np.frombuffer(t, np.uint8)[~mask].tobytes()
        out.append((i, len(t), int(mask.sum()), int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_passages(spark, tiny, odd, none):
    rng = np.random.default_rng(1)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    pool = ["".join(rng.choice(list("ab\0é"), 49)) for _ in range(6)] + ["ab" * 60, "x" * 200]
    docs += [(10_000 + i, "".join(rng.choice(pool, 4))) for i in range(40)]
    got = passages.strip(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(rows(got.drop("spans"))) == removed(docs)
    by = {}
    for r in passages.strip(odd).collect():
        by.setdefault(r.doc_id, []).append(r)
    assert by[None][0].n_removed == 0 and by[2][0].n_bytes == 0 and by[6][0].n_removed == 0 and by[7][0].n_removed > 70
    assert [r.n_removed for r in by[8]] == [len(ODD[7][1])] * 2 and by[9][0].n_removed == 0 and by[10][0].n_removed == len(LONG) + 0
    assert rows(passages.strip(none)) == []
    kept = {r.doc_id: r for r in passages.keep(odd).collect()}
    assert kept[2].text is None and kept[10].text == " end" and kept[8].text == "" and kept[8].fp == "h"


def test_decontaminate(spark, tiny, odd, none):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    items = [(1, "alpha BETA gamma delta epsilon zeta eta theta iota kappa"), (2, "word3x3 word4x4"), (3, None), (4, "..."), (5, "One"), (5, "One"), (10, "the same sentence of more than fifty bytes stands in several documents")]
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(odd, bench).collect()))
    want = []
    for i, t, _ in ODD:
        w, hit, who = words(t), set(), set()
        for win, owners in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    who |= owners
        want.append((i or 0, len(w), len(hit), sorted(who)))
    assert got == sorted(want)
    assert rows(decontaminate.contamination(none, bench)) == []
    assert all(r.n_hit == 0 for r in decontaminate.contamination(odd, bench.limit(0)).collect())
    kept = decontaminate.keep(odd, bench)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {2, 3, 4, 11, 12}


def test_packing(spark, tiny, odd, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    got = packing.pack(odd, path).collect()
    by, seq = {}, {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        seq.setdefault(r.sequence_id, []).append(r)
    for i, t, _ in ODD:
        if i != 8:
            pieces = sorted(by[i], key=lambda r: r.start)
            ids = np.frombuffer(b"".join(r.ids for r in pieces), "<u4").tolist()
            assert ids == plain.encode(t or "", add_special_tokens=False).ids + [2]
            assert [r.start for r in pieces] == np.cumsum([0] + [r.length for r in pieces])[:-1].tolist() and {r.doc_tokens for r in pieces} == {len(ids)}
    for held in seq.values():
        held.sort(key=lambda r: r.offset)
        assert [r.offset for r in held] == np.cumsum([0] + [r.length for r in held])[:-1].tolist() and sum(r.length for r in held) <= 4096
    assert rows(packing.pack(none, path)) == []
    for n in range(1, 4096):
        assert sum(a for a, _ in packing.cuts(n)) == n and all(a * j <= 4096 for a, j in packing.cuts(n))
    whole = packing.pack(spark.read.parquet(f"{tiny}/documents.parquet"), path).toPandas()
    assert whole.length.sum() / (4096 * whole.sequence_id.nunique()) > 0.97


def test_sharding(spark, odd, none):
    names = [f"s{i}" for i in range(20)]
    full, less = sharding.lookup(names), sharding.lookup(names[:-1])
    assert max(np.bincount(full)) - min(np.bincount(full)) <= 1
    assert sum(a != b for a, b in zip(full, less) if a != 19) < 0.03 * len(full)
    out = sharding.place(odd, ["doc_id"], names)
    want = [names[full[int(hashlib.md5(("\\N" if i is None else str(i)).encode()).hexdigest()[:12], 16) % 65537]] for i, _, _ in ODD]
    assert sorted(r.shard for r in out.collect()) == sorted(want) and set(out.columns) == {*odd.columns, "slot"}
    assert rows(sharding.place(none, ["doc_id", "id"], names)) == []
    with pytest.raises(ValueError):
        sharding.lookup(["a", "a"])


def test_urls(spark):
    cases = {
        "http://a.com/x?y": ("a.com", "/x", "com/", "allow"), "https://Sub.EXAMPLE.com/en/1#t": ("sub.example.com", "/en/1", "example.com/en/", "block"), "http://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://www.example.com/En/": ("www.example.com", "/En/", "com/", "allow"), "ftp://x.net/es/1": ("x.net", "/es/1", "net/es/", "block"), "http://a.com": ("a.com", "", None, None), "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "a.com/x": ("", "", None, None), "http://": ("", "", None, None), "x://b?://c/d": ("b", "", None, None),
    }
    df = spark.createDataFrame([(i, u) for i, u in enumerate([*cases, None])], "page_id long, url string")
    got = {r.page_id: r for r in urls.judge(df).collect()}
    for i, want in enumerate(cases.values()):
        assert (got[i].host, got[i].path, got[i].rule) == want[:3] and got[i].verdict in ([want[3]] if want[3] else ["allow", "block"])
    assert got[len(cases)].host == "" and got[len(cases)].rule is None
    assert rows(urls.judge(df.limit(0))) == [] and {r.verdict for r in urls.judge(df, rules=[]).collect()} == {"allow"}


def test_urls_odd_rows(spark):
    rows_ = [(1, "http://a.com/x", "a"), (1, "http://a.com/x", "a"), (None, "http://b.net/es/1", "b"), (None, None, None), (2, "http://c.org/" + "y" * 200_000 + "?a=1&b=2", "c"), (3, "", "d")]
    odd = spark.createDataFrame(rows_, "page_id long, url string, host string").selectExpr("*", "host AS path", "host AS label", "host AS score", "host AS fold", "host AS id", "host AS u")
    got = urls.judge(odd).collect()
    assert len(got) == 6 and [r.rule for r in got if r.page_id == 1] == ["com/"] * 2
    assert sorted(r.host for r in got if r.page_id is None) == ["", "b.net"] and all(0 <= r.score <= 1 and r.verdict in ("allow", "block") for r in got)


def test_urls_generalise_to_hosts_without_a_rule(spark):
    rng = np.random.default_rng(2)
    bad = lambda: f"{rng.integers(10**9)}/{rng.integers(10**6)}.php?a={rng.integers(999)}&b={rng.integers(99)}&c=1"
    good = lambda: "/".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(3))
    kinds = rng.random(200) < 0.5
    shown = np.where(rng.random(200) < 0.1, ~kinds, kinds)  # a tenth of the rules are wrong
    rules_ = [("block" if shown[i] else "allow", f"site{i}.t{i % 12}", "/") for i in range(150)]
    made = [(i, f"http://site{i}.t{i % 12}/{bad() if kinds[i] else good()}") for i in range(200) for _ in range(8)]
    got = urls.judge(spark.createDataFrame(made, "page_id long, url string"), rules=rules_).where("rule IS NULL").collect()
    assert len(got) == 400 and len({round(r.score, 4) for r in got}) > 20
    assert np.mean([(r.verdict == "block") == kinds[r.page_id] for r in got]) > 0.9


def test_a_label_does_not_inform_its_own_domain(spark):
    made = [(i, f"http://h{i % 40}.only{i % 40}.zz/x") for i in range(400)]
    rules_ = [("block" if i % 2 else "allow", f"only{i}.zz", "/") for i in range(40)]
    df = urls.with_statistics(urls.features(spark.createDataFrame(made, "page_id long, url string"), "page_id", "url", rules_)).toPandas()
    share = df.groupby("fold").f_suffix_share.nunique()
    assert (share == 1).all()  # one for a whole fold, whatever the label
    for f, own in df.groupby("fold"):
        rest = df[df.fold != f]
        assert np.allclose(own.f_suffix_share, (rest.label.sum() + urls.PRIOR) / (len(rest) + 2 * urls.PRIOR))


def test_html(spark, tiny):
    model = html.train()
    held = html.made_up(120, seed=77)
    found = [html.blocks(h) for h, _ in held]
    right = [(p == np.array(t)).mean() for p, f, (_, t) in zip(model.main(found), found, held) if len(f) == len(t)]
    assert np.mean(right) > 0.98
    from html import unescape

    def main(page):
        inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        return " ".join(unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", " ", inner))).split())

    pages = spark.read.parquet(f"{tiny}/pages.parquet")
    for r, p in zip(html.extract(pages, model).orderBy("page_id").collect(), pages.orderBy("page_id").collect()):
        assert r.text == main(p.html)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "<p"), (4, "<article><p>a&amp;b &#233;\n  c</p><p>d" + " e" * 50_000), (5, "<script>x<" + "<" * 5000)], "page_id long, html string")
    got = {r.page_id: r.text for r in html.extract(odd, model).collect()}
    assert got[1] == got[2] == got[5] == "" and got[4].startswith("a&b é c d e e")
    assert rows(html.extract(odd.limit(0), model)) == []


def texts_of(html_):
    return [text for _, text, _ in html.blocks(html_)]


def test_html_blocks_lose_no_text():
    assert texts_of("<p>Let <math><mi>x</mi></math> be.</p>") == ["Let x be."]
    assert texts_of("<noscript><p>kept para</p></noscript><object>fallback</object>") == ["kept para", "fallback"]
    assert texts_of("<p>a<svg><path d=x /><text>in</text>b</p><p>after</p>") == ["ainb", "after"]
    assert texts_of("<title>T &amp; <b></title><p>x</p><script>no()</script ><style>p{}</style>y") == ["T & <b>", "x", "y"]
    assert html.blocks("<p><a href=http://a.com/>linked it</a></p>") == [(("p",), "linked it", 9)]
    assert texts_of("<div/>one<p>two") == ["one", "two"] and texts_of("<x-card>a</x-card> b") == ["a b"]


def test_html_words_of_every_block_count():
    page = lambda w: [(("html", "body", "div"), " ".join([w] * 40), 0)]
    a, b = html.vectors([page("cookies"), page("river")])
    at = slice(html.PATH_BITS, html.PATH_BITS + html.WORD_BITS)
    assert np.abs(a[0, at]).max() > 0.3 and not np.allclose(a[0, at], b[0, at]) and html._path_vector.cache_info().maxsize


def test_html_odd_columns(spark):
    df = spark.createDataFrame([(1, "<article><p>a b c.</p></article>", "t", 3), (1, "<article><p>a b c.</p></article>", "t", 3), (None, "<article><p>d e f.</p></article>", None, None)], "page_id long, html string, text string, n_blocks int")
    got = html.extract(df.selectExpr("*", "text AS k0"), html.train(), keep=["text", "k0", "page_id"])
    assert got.columns == ["page_id", "k0", "text", "n_blocks"]
    assert sorted((r.page_id or 0, r.k0 or "", r.text) for r in got.collect()) == [(0, "", "d e f."), (1, "t", "a b c."), (1, "t", "a b c.")]


def auc(y, p):
    order = np.argsort(p, kind="stable")
    rank = np.empty(len(p))
    rank[order] = np.arange(1, len(p) + 1)
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_classifiers(spark, odd, none):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    tox, good = toxicity.train(docs, labels), quality.train(docs, labels)
    for module, model, label, least in ((toxicity, tox, "toxic", 0.75), (quality, good, "quality", 0.95)):
        got = module.score(docs, model).join(labels, "doc_id").where(held_out(F.col("doc_id"))).select("score", label).toPandas()
        assert auc(got[label].to_numpy(), got.score.to_numpy()) > least
        scores = module.score(odd, model).collect()
        assert len(scores) == len(ODD) and all(0 <= r.score <= 1 for r in scores)
        assert len({r.score for r in scores if r.doc_id in (2, 3, 4)}) == (1 if module is toxicity else 2) and rows(module.score(none, model)) == []
    [r] = toxicity.score(spark.createDataFrame([(1, "you  trash, they said")], "doc_id long, text string"), tox).collect()
    assert r.score > 0.5 and [(s.start, s.end) for s in r.spans] == [(5, 11)]
    empty = toxicity.train(docs, labels.limit(0))
    assert all(r.score < 0.5 for r in toxicity.score(odd, empty).collect())
    assert {r[0] for r in docs.select(held_out(docs["doc_id"]) == (zlib.crc32(b"7") % 5 == 0)).where(docs["doc_id"] == 7).collect()} == {True}


def test_marginals_are_those_of_all_paths():
    rng = np.random.default_rng(0)
    move, odds, offsets = np.array([[1.0, 0.3], [0.5, 2.0]]), rng.uniform(0.2, 3, 9), np.array([0, 4, 4, 5, 9])
    got = toxicity.marginals(odds, offsets, move)[2]
    for a, b in zip(offsets, offsets[1:]):
        total, on = 0.0, np.zeros(b - a)
        for path in range(1 << (b - a)):
            s = [path >> i & 1 for i in range(b - a)]
            w = np.prod([odds[a + i] if x else 1.0 for i, x in enumerate(s)]) * np.prod([move[x, y] for x, y in zip(s, s[1:])])
            total += w
            on += w * np.array(s)
        if b > a:
            # a chain begins as if it came from the clean state
            first = move[0, 1] / move[0, 0]
            total, on = 0.0, np.zeros(b - a)
            for path in range(1 << (b - a)):
                s = [path >> i & 1 for i in range(b - a)]
                w = (first if s[0] else 1.0) * np.prod([odds[a + i] if x else 1.0 for i, x in enumerate(s)]) * np.prod([move[x, y] for x, y in zip(s, s[1:])])
                total += w
                on += w * np.array(s)
            assert np.allclose(got[a:b], on / total)
