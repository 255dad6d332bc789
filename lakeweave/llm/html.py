"""Main-text extraction by a recurrent block labeller (operator 5): numpy bidirectional LSTM over a page's text blocks."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.columns import slices, word_codes

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?", re.S)
NAMES = re.compile(r"""(?:\b(?:class|id|role)\s*=\s*)("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
WORD = re.compile(r"[^\W_]+")
#: Fixed by HTML: elements without content; code that is no text; text in which tags are not read; what breaks a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CODE = frozenset("script style template".split())
LITERAL = frozenset("title textarea".split())
BLOCK = frozenset("address article aside blockquote body br button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu meta nav ol optgroup option p plaintext pre search section select summary table tbody td textarea tfoot th thead title tr ul".split())
FOREIGN = frozenset("svg math".split())

PATH_BITS, WORD_BITS, HIDDEN_UNITS = 96, 32, 24
#: The labeller is fitted on so many made-up pages, in so many passes; pages labelled together in one batch.
FIT_PAGES, PASSES, BATCH = 960, 10, 256
PART = 4 << 20


def blocks(html: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(path, text, link characters) of each block in page order: text between block-level tags, references decoded.

    path: the tags around it from the root, each with the words of its class, id and role. White space is folded, blank
    blocks are left out, as is the code of scripts, styles and templates; all other text is in some block. Unclosed and
    stray tags are taken as browsers do in the common cases: p ends an open p, li an open li; an end tag closes down to
    its start tag, or is passed over; only void elements, and those of drawings and formulas, close themselves.
    """
    out: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[tuple[str, str]] = []
    text: list[str] = []
    linked = 0
    at = 0

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                out.append((tuple(label for tag, label in stack if tag in BLOCK or tag == "a"), whole, linked))
            text.clear()
        linked = 0

    def plain(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = unescape(piece)
            text.append(piece)
            if any(tag == "a" for tag, _ in stack):
                linked += len(piece)

    size = len(html)
    while at < size:
        m = TOKEN.search(html, at)
        if not m:
            plain(html[at:])
            break
        plain(html[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, rest = m[1] or m[4], m[3] or m[6] or ""
        if closing:
            if name in BLOCK:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        foreign = name in FOREIGN or any(tag in FOREIGN for tag, _ in stack)
        if name in CODE or name in LITERAL and not foreign:
            end = _closing(name).search(html, at)
            if name in LITERAL:
                flush()
                stack.append((name, name))
                plain(html[at : end.start() if end else size])
                flush()
                stack.pop()
            at = end.end() if end else size
            continue
        if name in BLOCK:
            flush()
            if name in ("p", "li", "td", "th", "tr", "dd", "dt") or any(tag == "p" for tag, _ in stack):
                for i in range(len(stack) - 1, -1, -1):
                    tag = stack[i][0]
                    if tag == name or tag == "p":
                        del stack[i:]
                        break
                    if tag in BLOCK:
                        break
        if name not in VOID and not (foreign and rest.endswith("/")):
            words = " ".join(v.strip("\"'") for v in NAMES.findall(rest)) if rest else ""
            stack.append((name, f"{name} {words}".strip()))
    flush()
    return out


@cache
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?:\s[^>]*)?>", re.I)


def _hash(word: str, buckets: int) -> tuple[int, float]:
    h = zlib.crc32(word.encode())
    return h % buckets, 1.0 if h >> 16 & 1 else -1.0


@lru_cache(4096)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Hashed tags and names of the whole path, and how the path looks at its root and its leaf."""
    v = np.zeros(PATH_BITS, np.float32)
    for depth, label in enumerate(path):
        tag, *names = label.split()
        words = [w.lower() for n in names for w in WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", n))]
        for w in [f"<{tag}>", *words, *(f"{w[:4]}~" for w in words), *([f"leaf {tag}"] if depth == len(path) - 1 else [])]:
            i, sign = _hash(w, PATH_BITS)
            v[i] += sign
    return np.clip(v, -2, 2)


def _word_vectors(texts: list[str]) -> np.ndarray:
    """One row a block: all its words (hashed, lower-cased, without signs at their ends), by the root of their number, within bounds."""
    values, codes, offsets = word_codes(pa.array(texts, pa.string()))
    hashed = [_hash(w, WORD_BITS) for w in pc.utf8_trim(pc.utf8_lower(values), ".,;:!?()\"'").to_pylist()]
    bucket, sign = np.array([i for i, _ in hashed], np.int64), np.array([x for _, x in hashed])
    n = np.diff(offsets)
    block = np.repeat(np.arange(len(texts)), n)
    got = np.bincount(block * WORD_BITS + bucket[codes], sign[codes], minlength=len(texts) * WORD_BITS) if len(codes) else np.zeros(len(texts) * WORD_BITS)
    return np.clip(0.3 * got.reshape(-1, WORD_BITS) / np.sqrt(np.maximum(n, 1))[:, None], -0.6, 0.6).astype(np.float32)


def vectors(pages: list[list[tuple[tuple[str, ...], str, int]]]) -> list[np.ndarray]:
    """For each page one row a block: its path, all its words, and its length, links, signs and place."""
    words = _word_vectors([text for page in pages for _, text, _ in page])
    out, at = [], 0
    for page in pages:
        own = np.zeros((len(page), PATH_BITS + WORD_BITS + 6), np.float32)
        own[:, PATH_BITS : PATH_BITS + WORD_BITS] = words[at : at + len(page)]
        at += len(page)
        for row, (i, (path, text, linked)) in zip(own, enumerate(page)):
            row[:PATH_BITS] = _path_vector(path)
            row[PATH_BITS + WORD_BITS :] = (np.log1p(text.count(" ") + 1) / 3, linked / len(text), len(path) / 8, i / len(page), text[-1] in ".!?", 1)
        out.append(own)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Labeller:
    """weights: for each direction input, recurrent and bias weights, then the output weights and bias."""

    weights: list[np.ndarray]

    def _walk(self, x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, order: range, tape: bool) -> tuple[np.ndarray, list]:
        """States of one direction; with `tape` also what back-propagation needs of each step."""
        pages, steps, k = len(x), x.shape[1], HIDDEN_UNITS
        h = c = np.zeros((pages, k), np.float32)
        inputs = x @ w + b
        out, kept = np.zeros((pages, steps, k), np.float32), [None] * steps
        for t in order:
            z = inputs[:, t] + h @ u
            i, f, o, g = _sigmoid(z[:, :k]), _sigmoid(z[:, k : 2 * k] + 1), _sigmoid(z[:, 2 * k : 3 * k]), np.tanh(z[:, 3 * k :])
            m = mask[:, t, None]
            c_new = m * (f * c + i * g) + (1 - m) * c
            th = np.tanh(c_new)
            if tape:
                kept[t] = (h, c, i, f, o, g, th, m)
            h, c = m * (o * th) + (1 - m) * h, c_new
            out[:, t] = h
        return out, kept

    def run(self, x: np.ndarray, mask: np.ndarray, tape: bool = False) -> tuple[np.ndarray, tuple]:
        wf, uf, bf, wb, ub, bb, v, a = self.weights
        steps = x.shape[1]
        forward, kept_f = self._walk(x, mask, wf, uf, bf, range(steps), tape)
        backward, kept_b = self._walk(x, mask, wb, ub, bb, range(steps - 1, -1, -1), tape)
        both = np.concatenate([forward, backward, x], axis=2)
        return _sigmoid(both @ v + a), (both, kept_f, kept_b)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy over blocks, by back-propagation through time."""
        p, (both, kept_f, kept_b) = self.run(x, mask, True)
        k = HIDDEN_UNITS
        d = (p - y) * mask / mask.sum()
        grads = []
        for kept, order, u, part in ((kept_f, range(x.shape[1] - 1, -1, -1), self.weights[1], 0), (kept_b, range(x.shape[1]), self.weights[4], 1)):
            own = d[:, :, None] * self.weights[6][part * k : (part + 1) * k]
            gw, gu, gb = np.zeros_like(self.weights[0]), np.zeros_like(u), np.zeros(4 * k, np.float32)
            dh = dc = np.zeros((len(x), k), np.float32)
            for t in order:
                h, c, i, f, o, g, th, m = kept[t]
                dh = dh + own[:, t]
                dc_in = dc + m * dh * o * (1 - th**2)
                dz = m * np.concatenate([dc_in * g * i * (1 - i), dc_in * c * f * (1 - f), dh * th * o * (1 - o), dc_in * i * (1 - g**2)], axis=1)
                gw += x[:, t].T @ dz
                gu += h.T @ dz
                gb += dz.sum(axis=0)
                dh = dz @ u.T + (1 - m) * dh
                dc = m * dc_in * f + (1 - m) * dc
            grads += [gw, gu, gb]
        return [*grads, np.einsum("ntk,nt->k", both, d), d.sum(keepdims=True).ravel()]

    def main(self, pages: list[list]) -> list[np.ndarray]:
        """For each page which of its blocks are main text."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        for at in range(0, len(order), BATCH):
            group = order[at : at + BATCH]
            steps = len(pages[group[-1]])
            for one in ([group] if steps * len(group) < 50_000 else [[i] for i in group]):
                x, mask = _padded(vectors([pages[i] for i in one]))
                p, _ = self.run(x, mask)
                for i, row in zip(one, p):
                    out[i] = row[: len(pages[i])] > 0.5
        return out


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, rows))
    x, mask = np.zeros((len(rows), steps, rows[0].shape[1]), np.float32), np.zeros((len(rows), steps), np.float32)
    for a, m, r in zip(x, mask, rows):
        a[: len(r)], m[: len(r)] = r, 1
    return x, mask


#: What made-up pages are built of: (opening, closing) around the article, and names of parts around and inside it.
MAIN = ["<article>|</article>", "<main>|</main>", "<main><article>|</article></main>", '<div class="content">|</div>', '<div id="content"><div class="post">|</div></div>', '<div class="article-body">|</div>', '<section class="entry-content">|</section>', '<div class="story">|</div>', '<article class="post">|</article>', '<div id="main"><article>|</article></div>', '<main id="main" role="main">|</main>', '<div class="main-content">|</div>']
SIDE = ["nav", "header", "footer", "aside", "div class=menu", "div class=navbar", "ul class=menu", "div class=header", "div id=header", "div class=footer", "div id=footer", "div class=sidebar", "div id=sidebar", "aside class=sidebar", "div class=widget", "div class=breadcrumbs", "div role=navigation", "div class=topbar", "section class=related", "div class=share", "div class=social"]
NOTICE = ["div class=ad", "div class=ads", "div class=advert", "div class=advertisement", "div class=sponsored", "div class=promo", "div class=banner", "div id=ad", "aside class=ad", "div class=cookie", "div class=cookie-notice", "div class=cookie-banner", "div id=cookies", "div class=notice", "div role=alert", "div class=popup", "div class=newsletter", "div class=subscribe", "form", "form class=search", "div class=login", "div class=consent", "div class=gdpr"]
CUES = "cookie cookies accept consent privacy subscribe newsletter login sign advertisement sponsored share follow reply comments related menu search copyright rights reserved".split()
TALK = ["section class=comments", "div class=comments", "div id=comments", "section id=comments", "div class=comment-list", "ol class=comments", "div id=disqus_thread", "div class=comment", "div class=replies", "section class=reader-comments"]


def made_up(n: int, seed: int = 5) -> list[tuple[str, list[bool]]]:
    """Pages of random words with known main blocks, laid out in many ways; only some parts beside the article have words of CUES."""
    rng = np.random.default_rng(seed)
    pick = lambda options: options[rng.integers(len(options))]
    syllables = "an en er in on re th ti ou le la de es ver ge sch mi lo ta ci que ment tion ly".split()
    word = lambda: "".join(pick(syllables) for _ in range(rng.integers(1, 5)))
    cue = lambda: pick(CUES) if rng.random() < 0.15 else word()
    line = lambda a, b, word=word: " ".join(word() for _ in range(rng.integers(a, b))).capitalize() + pick([".", ".", "", "!"])

    def part(spec: str, kind: str) -> tuple[str, int]:
        tag, _, attrs = spec.partition(" ")
        if attrs:
            name, _, value = attrs.partition("=")
            attrs = f' {name}="{value}"' if rng.random() < 0.9 else f" {name}={value}"
        close = f"</{tag}>"
        if kind == "links" or tag == "ul":
            m = int(rng.integers(1, 9))
            inner = "".join(f'<li><a href="/{word()}">{line(1, 4)}</a></li>' for _ in range(m))
            return f"<{tag}{attrs}>{inner if tag == 'ul' else f'<ul>{inner}</ul>'}{close}", m
        if tag == "form":
            return f"<form{attrs}><label>{line(1, 4)}</label><input name=q><button>{line(1, 3)}</button></form>", 2
        if rng.random() < 0.5:
            return f"<{tag}{attrs}>{line(3, 25, cue)}{close}", 1
        m = int(rng.integers(1, 5))
        inner = "".join(pick(["<p>{}</p>", "<div>{}</div>", "<p><b>{}</b></p>", "<div class=comment><p>{}</p></div>" if kind == "talk" else "<p>{}</p>"]).format(line(1, 40, cue)) for _ in range(m))
        return f"<{tag}{attrs}>{inner}{close}", m

    out = []
    for _ in range(n):
        html, truth = ["<!DOCTYPE html><html><head><title>" + line(2, 8) + "</title></head><body>"], [False]

        def add(specs: list[str], kind: str, chance: float) -> None:
            while rng.random() < chance:
                text, m = part(pick(specs), pick(["links", "text"]) if kind == "side" else kind)
                html.append(text)
                truth.extend([False] * m)
                chance /= 2

        wrapped = rng.random() < 0.3
        add(NOTICE, "notice", 0.4)
        add(SIDE, "side", 0.8)
        html.append(pick(['<div class="container">', '<div id="page">', "<div>", '<div class="wrapper">']) if wrapped else "")
        add(NOTICE, "notice", 0.5)
        opening, _, closing = pick(MAIN).partition("|")
        html.append(opening)
        if rng.random() < 0.7:
            html.append(pick(["<h1>{}</h1>", "<h2>{}</h2>", "<header><h1>{}</h1></header>"]).format(line(2, 30)))
            truth.append(True)
        for _ in range(rng.integers(1, 14)):
            if rng.random() < 0.12:
                text, m = part(pick(NOTICE + ["aside", "div class=related", "div class=share"]), "notice")
                html.append(text)
                truth.extend([False] * m)
            shape = pick(["<p>{}</p>"] * 6 + ["<p><b>{}<br>", "<p>{}", "<h2>{}</h2>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<div>{}</div>", "<pre>{}</pre>", "<p>{} <a href=/x>link</a></p>", "<table><tr><td>{}</td></tr></table>", "<h3>{}</h3>"])
            html.append(shape.format(line(1, 60)))
            truth.append(True)
        if rng.random() < 0.1:
            text, m = part(pick(TALK), "talk")
            html.append(text)
            truth.extend([False] * m)
        html.append(closing)
        add(TALK, "talk", 0.35)
        add(SIDE, "side", 0.5)
        html.append("</div>" if wrapped else "")
        add(NOTICE, "notice", 0.3)
        if rng.random() < 0.7:
            html.append(pick(["<footer>{}</footer>", "<footer>&copy; {} &middot; {}</footer>", '<div class="footer">{}</div>', "<footer><p>{}</p></footer>"]).format(line(1, 30), line(1, 9)))
            truth.append(False)
        html.append("</body></html>" if rng.random() < 0.8 else "")
        out.append(("".join(html), truth))
    return out


@cache
def train(pages: int = FIT_PAGES, passes: int = PASSES, seed: int = 5) -> Labeller:
    """Fits a labeller on made-up pages by Adam, some seconds in the driver once a session; the same each time."""
    rng = np.random.default_rng(seed)
    made = [(blocks(html), truth) for html, truth in made_up(pages, seed)]
    made = [(found, truth) for found, truth in made if len(found) == len(truth)]
    rows, truths = vectors([found for found, _ in made]), [np.array(truth, np.float32) for _, truth in made]
    d, k = rows[0].shape[1], HIDDEN_UNITS
    make = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    model = Labeller([make(d, 4 * k), make(k, 4 * k), np.zeros(4 * k, np.float32), make(d, 4 * k), make(k, 4 * k), np.zeros(4 * k, np.float32), make(2 * k + d), np.zeros(1, np.float32)])
    m = [np.zeros_like(w) for w in model.weights]
    v = [np.zeros_like(w) for w in model.weights]
    step = 0
    for turn in range(passes):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 32):
            group = order[at : at + 32]
            x, mask = _padded([rows[i] for i in group])
            y = np.zeros(mask.shape, np.float32)
            for row, i in zip(y, group):
                row[: len(truths[i])] = truths[i]
            step += 1
            rate = 0.01 * (1 - turn / passes) + 0.001
            for i, g in enumerate(model.gradients(x, mask, y)):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                model.weights[i] -= (rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8) + rate * 1e-4 * model.weights[i]).astype(np.float32)
    return model


def extract(pages: DataFrame, model: Labeller, key: str = "page_id", html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """One row per row of pages: key, the columns of `keep`, text and n_blocks (main ones).

    text: the page's main blocks in page order, joined by one space; references are decoded and white space is folded.
    Null, empty and textless pages give the empty text. Repeated rows are read one by one, null keys stay. A page is read
    whole, whatever its length. A column of `keep` named text, n_blocks or like the key is left out; other columns are not
    read.
    """
    keep = [c for c in keep or [] if c not in (key, "text", "n_blocks")]
    fields = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", PART):
                found = [blocks(h or "") for h in part.column(part.num_columns - 1).to_pylist()]
                chosen = [[b[1] for b, yes in zip(page, main) if yes] for page, main in zip(found, model.main(found))]
                columns = [*part.columns[:-1], pa.array([" ".join(c) for c in chosen], pa.string()), pa.array([len(c) for c in chosen], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names[:-1], "text", "n_blocks"])

    schema = ", ".join([f"k0 {fields[key]}", *(f"k{i + 1} {fields[c]}" for i, c in enumerate(keep)), "text string, n_blocks int"])
    bare = pages.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate([key, *keep])], F.col(html).alias("html"))
    return bare.mapInArrow(run, schema).withColumnsRenamed({f"k{i}": c for i, c in enumerate([key, *keep])})
