"""Harmonic packing of tokenised documents into fixed-length sequences (operator 8)."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.columns import give_back, slices, sums, word_codes

CAPACITY, END_ID = 4096, 2
#: A remainder is cut until it falls into a class of at least so many pieces a sequence, which wastes at most 1/17.
FINE = 16
#: Bytes of text tokenised together; distinct words whose ids a worker remembers between such parts, and learns at once;
#: those met less often than OFTEN do not outlast a task.
PART, REMEMBERED, LEARNED, OFTEN = 2 << 20, 500_000, 10_000, 4
#: Characters of plain words: ASCII without ' and |, and letters of Latin-1. In them no normal form, contraction or special token can occur,
#: so the parts that a tokenizer of form FORM cuts them into are runs of letters, single digits and runs of other characters.
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN, PARTS = f"^[!-&(-{{}}~{LATIN}]+$", re.compile("[^\\W\\d_]+|[0-9]|(?:[^\\w]|_)+")
FORM = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "post_processor": None, "truncation": None, "padding": None,
}
SCHEMA = "{id}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, class int"


@cache
def cuts(n: int, capacity: int = CAPACITY, fine: int = FINE) -> tuple[tuple[int, int], ...]:
    """(length, class) of the pieces of n tokens, n below capacity; class j takes j pieces of up to capacity / j tokens."""
    out = []
    while n:
        j = capacity // n
        if j >= fine or n * j == capacity:
            return (*out, (n, j))
        out.append((capacity // (j + 1), j + 1))
        n -= capacity // (j + 1)
    return tuple(out)


class Tokens:
    """Ids of words by a public tokenizer; those of up to REMEMBERED distinct words are kept for later calls.

    The tokenizer never joins characters across ASCII white space, so a text's ids are its words' ids in a row. If it has the form FORM,
    plain words go to its model by parts; all others, and all words of other tokenizers, are encoded, which takes four times as long.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        form = json.loads(self.tokenizer.to_str())
        special = all(not t["normalized"] and "|" in t["content"] for t in form["added_tokens"])
        self.model = self.tokenizer.model if special and all(form[k] == v for k, v in FORM.items()) and not form["model"].get("dropout") else None
        if self.model:
            letters = filter(re.compile(f"[{LATIN}]").match, map(chr, range(256)))
            self.spelt = str.maketrans({c: self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(c))[0][0] for c in letters})
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.string())  # the ids of word i are flat[first[i] : first[i + 1]]
        self.first, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)
        self.seen = np.zeros(0, np.int64)  # how often, halved at each trim

    def trim(self) -> None:
        """Only words that are met again and again are kept."""
        kept = np.flatnonzero(self.seen >= OFTEN)
        n = np.diff(self.first)[kept]
        at = np.repeat(self.first[kept] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        self.known, self.flat, self.first, self.seen = self.known.take(pa.array(kept)), self.flat[at], np.concatenate([[0], np.cumsum(n)]), self.seen[kept] // 2

    def _encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Each word's number of ids, and the ids, by all steps of the tokenizer."""
        got = self.tokenizer.encode(words.to_pylist(), is_pretokenized=True, add_special_tokens=False)
        return np.bincount(np.array(got.word_ids, np.int64), minlength=len(words)), np.array(got.ids, np.uint32)

    def _plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for plain words, by the model only."""
        tokenize, signs, lengths, flat = self.model.tokenize, {}, [], []
        for word in words.to_pylist():
            before = len(flat)
            for part in PARTS.findall(word):
                if part.isalpha():
                    flat += [t.id for t in tokenize(part.translate(self.spelt))]
                else:
                    if part not in signs:
                        signs[part] = [t.id for t in tokenize(part)]
                    flat += signs[part]
            lengths.append(len(flat) - before)
        return np.array(lengths, np.int64), np.array(flat, np.uint32)

    def _learn(self, words: pa.Array, by) -> None:
        """Ids of new words, some at a time as the tokenizer's own records are large."""
        lengths, flat = [], []
        for at in range(0, len(words), LEARNED):
            n, ids = by(words[at : at + LEARNED])
            lengths.append(n)
            flat.append(ids)
        self.known = pa.concat_arrays([self.known, words.cast(pa.string())])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.concatenate(lengths))])
        self.flat = np.concatenate([self.flat, *flat])
        self.seen = np.concatenate([self.seen, np.zeros(len(words), np.int64)])

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row, and each text's number of ids."""
        words, codes, offsets = word_codes(texts)
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        if len(self.known) + len(words) > REMEMBERED:
            self.trim()
        if len(self.known) + len(words) > REMEMBERED:
            self.forget()
        number = pc.index_in(words, self.known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        plain = pc.match_substring_regex(words, PLAIN).to_numpy(zero_copy_only=False) & bool(self.model)
        for new, by in ((np.flatnonzero((number < 0) & plain), self._plain), (np.flatnonzero((number < 0) & ~plain), self._encoded)):
            if len(new):
                number[new] = len(self.known) + np.arange(len(new))
                self._learn(words.take(pa.array(new)), by)
        word = number[codes]
        self.seen += np.bincount(word, minlength=len(self.known))
        n = self.first[word + 1] - self.first[word]
        at = np.repeat(self.first[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.flat[at], sums(n, offsets)


_tokens: dict[str, Tokens] = {}


class Bins:
    """Open sequences of one worker: one a class, closed when it holds that class's number of pieces."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list] = {}

    def close(self, pieces: list, kind: int) -> Iterator[tuple]:
        at = 0
        for key, start, ids, total in pieces:
            yield key, start, len(ids), ids.tobytes(), total, self.next_id, at, kind
            at += len(ids)
        self.next_id += 1

    def add(self, key, ids: np.ndarray) -> Iterator[tuple]:
        whole = len(ids) // self.capacity
        start = 0
        for n, j in [(self.capacity, 1)] * whole + list(cuts(len(ids) - whole * self.capacity, self.capacity)):
            held = self.open.setdefault(j, [])
            held.append((key, start, ids[start : start + n], len(ids)))
            start += n
            if len(held) == j:
                yield from self.close(self.open.pop(j), j)

    def rest(self) -> Iterator[tuple]:
        """What is left in open classes, less than one sequence each, is laid end to end and cut at the capacity."""
        held, room = [], self.capacity
        for key, start, ids, total in (piece for j in sorted(self.open) for piece in self.open[j]):
            while len(ids):
                held.append((key, start, ids[:room], total))
                start, ids, room = start + len(ids[:room]), ids[room:], room - len(ids[:room])
                if not room:
                    yield from self.close(held, 0)
                    held, room = [], self.capacity
        if held:
            yield from self.close(held, 0)


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: key, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, class.

    A document is its text's ids and end_id (null and empty texts: end_id alone). Whole multiples of the capacity fill
    sequences of their own; the remainder is cut into pieces of reciprocal classes. Each worker fills its own sequences
    (ids carry its partition's number), so there is no shuffle, a lost partition is packed again just so, and at most
    one sequence a partition is part empty beyond its class's waste of 1/17 at most. class 0 marks what was left over.
    Null and repeated keys are carried as they are. `tokenizer` is the file's path, the same on every worker.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens.setdefault(tokenizer, Tokens(tokenizer)) if tokenizer not in _tokens else _tokens[tokenizer]
        bins = Bins(capacity, TaskContext.get().partitionId() << 36)
        schema = None

        def rows(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), schema.types)], schema=schema)

        for batch in batches:
            kinds = [batch.schema.types[0], pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            schema = pa.schema(list(zip(["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "class"], kinds)))
            for part in slices(batch, "text", PART):
                ids, lengths = tokens.of(part.column(1))
                ends = np.cumsum(lengths)
                found = []
                for k, a, b in zip(part.column(0).to_pylist(), ends - lengths, ends):
                    found += bins.add(k, np.append(ids[a:b], np.uint32(end_id)).astype("<u4"))
                if found:
                    yield rows(found)
        if schema and (found := list(bins.rest())):
            yield rows(found)
        tokens.trim()
        give_back()

    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA.format(id=f"id {kind}")).withColumnRenamed("id", key)
