"""Exact token counts by prefix dynamic programming (operator 6).

A byte-pair encoding is settled from the left: a token ends a prefix's encoding exactly when the encoding of what lies
before it ends in a token that stays beside it, that is, when the two, encoded together, remain these two. So one pass
over a word keeps, for every prefix, its last token and its count. Words are cut by the vocabulary's own pattern, and the tables of
words already seen are kept, so a text costs a lookup a word. A text's prefix table is its words' tables end to end, each raised by the
tokens before it; where a prefix is cut otherwise than the whole (in white space, in a few contractions, in special strings) its
words' own tables are put in. The whole count, and every question about truncation and budgets, is read off that table, in the same
pass or later from prefix_tables(), without encoding anything again.

Scale: a map over whole texts without a shuffle. A worker keeps the tables of at most CACHE words and about LETTERS letters.

Defined results: null is empty; empty has 0 tokens; a special string inside a text is its one token, as the library has it
by default; very long words are encoded whole; a very long text is taken in stretches of STRETCH characters between words; of
several prefixes within a budget the longest counts; repeated rows are each counted; other columns may have any names; an
empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomdf.session import ship

from .common import named

#: The pattern by which byte-level vocabularies of this kind cut a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE, LETTERS = 400_000, 8_000_000
#: Words of this pattern whose beginnings it cuts in two.
PARTED = ("'re", "'ve", "'ll")
WHITE = regex.compile(r"\s{2,}")
AFTER = regex.compile(r"(?<=\S)\s")
#: Characters whose table is made at once.
STRETCH = 1 << 20


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the file: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def stretches(text: str) -> Iterator[str]:
    """A text in stretches of about STRETCH characters that begin with white space after something else: no word spans two."""
    at = 0
    while at < len(text):
        m = AFTER.search(text, at + STRETCH) if len(text) - at > 2 * STRETCH else None
        to = m.start() if m else len(text)
        yield text[at:to]
        at = to


class Counter:
    """Prefix tables over one vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda t: bytes(letters[c] for c in t)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.tokens = {a + b for a, b in self.ranks} | {bytes([b]) for b in range(256)}
        self.reach: dict[bytes, int] = {}  # the length of the longest token that ends in these three bytes
        for t in self.tokens:
            if len(t) > 2:
                self.reach[t[-3:]] = max(len(t), self.reach.get(t[-3:], 0))
        self.specials = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.pattern = regex.compile(PATTERN)
        self.beside: dict[tuple[bytes, bytes], bool] = {}
        self.whole: dict[bytes, bool] = {}
        self.known: dict[str, int] = {}
        self.index: dict[str, int] = {}
        self.start, self.size, self.flat, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1 << 14, np.int32), 0

    def encode(self, word: bytes) -> list[bytes]:
        """The plain definition: merge the adjacent pair of least rank until none is left."""
        part = [word[i : i + 1] for i in range(len(word))]
        while len(part) > 1:
            rank, i = min((self.ranks.get((part[i], part[i + 1]), 1 << 60), i) for i in range(len(part) - 1))
            if rank == 1 << 60:
                break
            a, b, out, j = part[i], part[i + 1], [], 0
            while j < len(part):
                if j + 1 < len(part) and part[j] == a and part[j + 1] == b:
                    out.append(a + b)
                    j += 2
                else:
                    out.append(part[j])
                    j += 1
            part = out
        return part

    def stay(self, a: bytes, b: bytes) -> bool:
        """Whether a followed by b is encoded as these two."""
        have = self.beside.get((a, b))
        if have is None:
            if len(self.beside) > 2_000_000:
                self.beside.clear()
            have = self.beside[a, b] = self.encode(a + b) == [a, b]
        return have

    def alone(self, t: bytes) -> bool:
        """Whether a token's own bytes merge into it."""
        have = self.whole.get(t)
        if have is None:
            have = self.whole[t] = self.encode(t) == [t]
        return have

    def table(self, word: bytes) -> list[int]:
        """Token count of every byte prefix of one word, from 0 on."""
        n, tokens, reach, beside = len(word), self.tokens, self.reach, self.beside
        last, count = [b""] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            for size in range(min(i, reach.get(word[i - 3 : i], 2) if i > 2 else 2), 0, -1):
                t = word[i - size : i]
                if t in tokens:
                    if size == i:
                        fits = self.alone(t)
                    else:
                        fits = beside.get((last[i - size], t))
                        if fits is None:
                            fits = self.stay(last[i - size], t)
                    if fits:
                        last[i], count[i] = t, count[i - size] + 1
                        break
        return count

    def word(self, w: str) -> int:
        have = self.known.get(w)
        if have is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            have = self.table(w.encode())[-1]
            if len(w) < 100:
                self.known[w] = have
        return have

    def parts(self, text: str) -> list[tuple[str, bool]]:
        """The text cut at special strings: (part, whether it is one)."""
        if self.cut is None:
            return [(text, False)]
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [(text[at : m.start()], False), (m.group(), True)]
            at = m.end()
        return [*out, (text[at:], False)]

    def count(self, text: str) -> int:
        if self.cut is not None and any(s in text for s in self.specials):
            return sum(1 if special else self.count_plain(p) for p, special in self.parts(text))
        return self.count_plain(text)

    def count_plain(self, text: str) -> int:
        known, n = self.known, 0
        for w in self.pattern.findall(text):
            c = known.get(w)
            n += self.word(w) if c is None else c
        return n

    def letters(self, w: str) -> np.ndarray:
        """Token count of every character prefix of one word, from 1 on."""
        if w in PARTED:  # a prefix of it is cut otherwise than the whole
            return np.array([self.word(w[0]), self.word(w[0]) + self.word(w[1]), self.word(w)], np.int32)
        raw = w.encode()
        out = np.array(self.table(raw)[1:], np.int32)
        return out if len(raw) == len(w) else out[np.cumsum([len(c.encode()) for c in w]) - 1]

    def book(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each word's table lies in self.flat, its length, and its last count; words not seen before are added."""
        if len(self.index) >= CACHE or self.used > LETTERS:
            self.index.clear()
            self.used = 0
        index = self.index
        at = np.array([index.get(w, -1) for w in words], np.int64)
        for i in np.flatnonzero(at < 0).tolist():
            w = words[i]
            k = index.get(w)
            if k is None:
                n = self.letters(w)
                k = len(index)
                if k == len(self.start):
                    self.start, self.size = np.resize(self.start, 2 * k), np.resize(self.size, 2 * k)
                while self.used + len(n) > len(self.flat):
                    self.flat = np.resize(self.flat, 2 * len(self.flat))
                self.flat[self.used : self.used + len(n)] = n
                index[w], self.start[k], self.size[k] = k, self.used, len(n)
                self.used += len(n)
            at[i] = k
        return self.start[at], self.size[at], self.flat[self.start[at] + self.size[at] - 1]

    def plain_prefixes(self, text: str) -> np.ndarray:
        """The prefix table of a text without special strings: counts for text[:i], i from 0 to the whole."""
        words = self.pattern.findall(text)
        out = np.zeros(len(text) + 1, np.int32)
        if not words:
            return out
        start, size, last = self.book(words)
        before = np.cumsum(size) - size
        out[1:] = self.flat[np.repeat(start - before, size) + np.arange(len(text))] + np.repeat(np.cumsum(last) - last, size)
        for m in WHITE.finditer(text):  # a prefix that ends in white space has all of it as one word
            out[m.start() + 1 : m.end() + 1] = out[m.start()] + self.letters(m.group())
        return out

    def pieces(self, text: str) -> Iterator[np.ndarray]:
        """The prefix table from i = 1 on, in stretches of bounded size; each part of the text is encoded once."""
        total, near, before = 0, "", 0  # tokens so far; the plain stretch before a special string, and the tokens before it
        for part, special in self.parts(text) if any(s in text for s in self.specials) else [(text, False)]:
            if special:
                # within a special string a prefix is plain text, from the last white space before it on
                at = max((m.start() for m in regex.finditer(r"\s+", near)), default=0)
                inner = self.plain_prefixes(near[at:] + part[:-1])[len(near) - at + 1 :]
                head = int(self.plain_prefixes(near)[at]) if at else 0
                total += 1
                yield np.append(before + head + inner, np.int32(total))
                near, before = "", total
                continue
            near, before = "", total
            for stretch in stretches(part):
                near, before = stretch, total
                table = self.plain_prefixes(stretch)
                yield total + table[1:]
                total += int(table[-1])

    def prefixes(self, text: str) -> np.ndarray:
        """The prefix table: token count of every prefix text[:i], from i = 0 to the whole."""
        return np.concatenate([np.zeros(1, np.int32), *self.pieces(text)]).astype(np.int32)

    def answers(self, text: str, budgets: tuple[int, ...]) -> tuple[int, int, list[int]]:
        """Characters, tokens, and for each budget the characters of the longest prefix within it: all read off the prefix table."""
        at, n, best = 0, 0, [0] * len(budgets)
        for table in self.pieces(text):
            for k, budget in enumerate(budgets):
                if len(table) and int(table[-1]) <= budget:
                    best[k] = at + len(table)
                elif len(table):
                    within = np.flatnonzero(table <= budget)
                    best[k] = at + 1 + int(within[-1]) if len(within) else best[k]
            if len(table):
                at, n = at + len(table), int(table[-1])
        return at, n, best

    def fit(self, text: str, budget: int) -> int:
        """Characters of the longest prefix of at most `budget` tokens."""
        return fit(self.prefixes(text), budget)


def fit(prefixes: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most `budget` tokens, from a prefix table."""
    within = np.flatnonzero(prefixes <= budget)
    return int(within[-1]) if len(within) else 0


def fit_expr(prefix_tokens, budget: int):
    """The same as a column over a stored table."""
    return F.coalesce(F.array_max(F.transform(prefix_tokens, lambda n, i: F.when(n <= budget, i))), F.lit(0))


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """This worker's tables for a vocabulary file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", budgets: tuple[int, ...] = ()) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_chars, n_tokens, and fit_<budget>: characters of the longest prefix within each budget.

    All are read off the text's prefix table. path: the vocabulary file (byte-level BPE in the tokenizers library's JSON), at
    the same place on every machine.
    """
    ship(docs.sparkSession)
    src = docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            got = [c.answers(t, budgets) for t in texts]
            out = [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())]
            out += [pa.array([g[2][k] for g in got], pa.int64()) for k in range(len(budgets))]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_bytes", "n_chars", "n_tokens", *[f"fit_{n}" for n in budgets]])

    return src.mapInArrow(run, T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_chars", "n_tokens", *[f"fit_{n}" for n in budgets])]]))


def prefix_tables(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, prefix_tokens): the token count of every character prefix, to be stored where later questions are asked.

    prefix_tokens[i] is the count of the first i characters; fit_expr answers a budget from it without the text.
    """
    ship(docs.sparkSession)
    src = docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            for i in range(b.num_rows):
                table = pa.array(c.prefixes(b.column(1)[i].as_py() or ""), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), table)], names=["doc_id", "prefix_tokens"])

    return src.mapInArrow(run, T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("prefix_tokens", T.ArrayType(T.IntegerType()))]))
