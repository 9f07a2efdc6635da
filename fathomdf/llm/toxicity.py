"""Toxicity by class-conditional Kneser-Ney models (operator 7).

Two models, toxic and ordinary, spell a word byte by byte, each byte given the word so far:

    p(b | prefix, class) = max(n_class(prefix b) - d, 0) / n_class(prefix) + left(prefix) * shared(b | prefix)

where n_class counts, for the class's training documents, the distinct words of each document that begin so, d is the
modified Kneser-Ney discount for a count of one, two or more (fitted from the counts of counts), and left is the mass
that the discounts free at the prefix. The shared lower order is made of continuation counts over the whole corpus, labelled or not: how
many distinct words go on from the prefix with b. So a rare expression is judged by the longest beginning that is known, and past
it by the shared counts, alike in both classes. Words are spelled to their end, with an end mark.

A word's log-likelihood ratio r is the sum over its steps. It is taken twice: with every step in full, and with each step
times g / (g + hold), where g is the likelihood-ratio statistic of the step's counts in the two classes, so that a step counts
by its evidence. A text's score is a logistic curve over the sums of r and of r |r| over its distinct words, divided by the
square root of their number; it is fitted on training documents scored without the FOLDS-th of the training documents they are in.

Scale: the table of distinct words with their counts grows with the corpus; nothing is cut or hashed to a fixed range. It is
summed by word and then dealt by the first HEAD bytes, more for beginnings of over HOT words, so that all longer prefixes and what follows
from them stay within a task; the shorter ones (a row for each) are summed and sent to all. Documents get the sums of the most
frequent words, up to TABLE_BYTES, from a broadcast table in one map over the texts, and those of the others by a join of the
words that the table lacks. Labels are broadcast behind a check of their size, else joined by id.

Parameters that bound samples: CALIBRATE training rows of each class, by a hash of the id, for the logistic curve. Counts
cover all rows.

Defined results: a null, empty or wordless text has the score of a ratio of 0; a very long one is read in pieces of BLOCK bytes cut
between words and counts whole; if either class has no training rows all scores are 0. Equal training texts of one class count
once. A document with several labels is toxic if any says so; other labels than 0 and 1 are none. Repeated rows are each scored;
a score of exactly 0.5 is predicted 1; only the named columns are read, so other columns may have any names; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomdf.session import ship

from .common import WORD_TABLE, buffers, cut, cuts, mix, named, pieces, powers, small, span_hash, spans, written
from .language_id import remainder

#: Least bytes of the beginnings that words are dealt by; words of one beginning above which it is split further.
HEAD, HOT = 3, 200_000
BLOCK = 1 << 20
#: Distinct words kept before they are handed on; words spelled at once, or more if they share a beginning.
BAG, LOT = 300_000, 50_000
#: Size of the broadcast table of the most frequent words.
TABLE_BYTES = 40 << 20
CALIBRATE = 20_000
FOLDS = 3
HOLDS = (0, 10)
COUNTS = ["docs", *(f"ordinary{j}" for j in range(FOLDS)), *(f"toxic{j}" for j in range(FOLDS))]
SUMS = [f"e{m}_{i}" for m in range(FOLDS + 1) for i in range(len(HOLDS))]


def doc_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, start, end) of the distinct words of each row, in order of row, and the lower-cased bytes."""
    inside, lower = WORD_TABLE
    norm = lower[data]
    if len(off) == 2:  # a row alone may be long
        at = cuts(data, inside, 2 * BLOCK)
        parts = [(i, *_words(norm[i:j], np.array([0, j - i]))) for i, j in zip(at, at[1:], strict=False)]
        h, s, e = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] + p[0] for p in parts]), np.concatenate([p[4] + p[0] for p in parts])
        first = np.sort(np.unique(h, return_index=True)[1]) if len(parts) > 1 else np.arange(len(h))
        return np.zeros(len(first), np.int64), h[first], s[first], e[first], norm
    return *_words(norm, off), norm


def _words(norm: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    s, e, at = spans(norm, off, WORD_TABLE[0])
    row = np.repeat(np.arange(len(off) - 1), np.diff(at))
    h = span_hash(norm, s, e)
    _, first = np.unique(mix(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    first.sort()
    return row[first], h[first], s[first], e[first]


def gather(flat: np.ndarray, base: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The byte ranges in a row."""
    to = np.cumsum(size) - size
    return flat[np.repeat(base - to, size) + np.arange(int(size.sum()))]


class Bag:
    """Distinct words with their bytes and counts."""

    def __init__(self, key: np.ndarray, flat: np.ndarray, size: np.ndarray, counts: np.ndarray):
        self.key, self.flat, self.size, self.counts = key, flat, size, counts

    @staticmethod
    def joined(bags: list[Bag]) -> Bag:
        key, flat, size, counts = (np.concatenate([getattr(b, x) for b in bags]) for x in ("key", "flat", "size", "counts"))
        key, first, inv = np.unique(key, return_index=True, return_inverse=True)
        sums = np.stack([np.bincount(inv, c, len(key)).astype(np.int64) for c in counts.T], 1)
        return Bag(key, gather(flat, (np.cumsum(size) - size)[first], size[first]), size[first], sums)

    def batch(self) -> pa.RecordBatch:
        to = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        word = pa.Array.from_buffers(pa.large_binary(), len(to) - 1, [None, pa.py_buffer(to), pa.py_buffer(np.ascontiguousarray(self.flat))]).cast(pa.binary())
        return pa.RecordBatch.from_arrays([word, *[pa.array(np.ascontiguousarray(c)) for c in self.counts.T]], names=["word", *COUNTS])


class Trie:
    """Every prefix of some words, their ends marked, with its depth, its parent's index (-1: the root) and counts.

    counts: the number of words and their counts by class and fold. shared: prefixes no longer than their word's beginning
    in `head` bytes, which other tasks may have too.
    """

    def __init__(self, flat: np.ndarray, off: np.ndarray, counts: np.ndarray, head: np.ndarray):
        base, size = off[:-1], np.diff(off)
        n = len(flat)
        up, down = powers(n + 1)
        p = np.zeros(n + 1, np.uint64)
        np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[:n], out=p[1:])
        steps = size + 1
        self.word = np.repeat(np.arange(len(size)), steps)
        start = np.cumsum(steps) - steps
        k = np.arange(len(self.word)) - start[self.word] + 1
        end = k > size[self.word]
        to = base[self.word] + np.minimum(k, size[self.word])
        h = mix((p[to] - p[base[self.word]]) * down[base[self.word]] + k.astype(np.uint64))
        h[end] = mix(~h[end])
        self.hash = span_hash(flat, base, base + size)
        self.node, first, self.at = np.unique(h, return_index=True, return_inverse=True)
        self.depth = k[first]
        self.up = np.where(self.depth > 1, self.at[first - 1], -1)
        self.shared = self.depth <= head[self.word[first]]
        self.counts = np.stack([np.bincount(self.at, None if c is None else c[self.word], len(self.node)).astype(float) for c in (None, *counts.T[1:])], 1)


def by_model(counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ordinary, toxic) counts without each fold, and last with all."""
    parts = counts[:, 1 : 1 + FOLDS], counts[:, 1 + FOLDS :]
    return [tuple(x.sum(1) - (x[:, m] if m < FOLDS else 0) for x in parts) for m in range(FOLDS + 1)]


def once_to_four(counts: np.ndarray) -> np.ndarray:
    """How many prefixes have a count of 1, 2, 3 and 4, by model and class."""
    return np.array([[[(c == k).sum() for k in (1, 2, 3, 4)] for c in m] for m in by_model(counts)], np.int64)


def discounts(of: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts of 0, 1, 2 and more."""
    y = of[0] / (of[0] + 2 * of[1]) if of[0] else 0.5
    return np.array([0.0] + [min(k, max(0.2 * k, k - (k + 1) * y * of[k] / of[k - 1])) if of[k - 1] else 0.75 for k in (1, 2, 3)])


def statistic(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Likelihood-ratio statistic of a out of n against b out of m."""

    def part(x: np.ndarray, of: np.ndarray, p: np.ndarray) -> np.ndarray:
        q = x / np.maximum(of, 1)
        return np.where(x > 0, x * np.log(np.maximum(q, 1e-300) / np.maximum(p, 1e-300)), 0) + np.where(of > x, (of - x) * np.log(np.maximum(1 - q, 1e-300) / np.maximum(1 - p, 1e-300)), 0)

    p = (a + b) / np.maximum(n + m, 1)
    return np.maximum(2 * (part(a, n, p) + part(b, m, p)), 0)


def evidence(counts: np.ndarray, up: np.ndarray, which: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The SUMS of the steps to the prefixes `which`, all other prefixes 0; all children of their parents must be among them."""
    n = len(counts)
    out = np.zeros((n, len(SUMS)), np.float32)
    of = up[which]
    under = np.bincount(of, counts[which, 0], n)[of]
    shared = counts[which, 0] / np.maximum(under, 1)
    for m, classes in enumerate(by_model(counts[which])):
        logs, totals = [], []
        for c, dk in zip(classes, d[m], strict=True):
            took = dk[np.minimum(c, 3).astype(np.int64)]
            total, free = np.bincount(of, c, n)[of], np.bincount(of, took, n)[of]
            logs.append(np.log(np.maximum(np.where(total > 0, (np.maximum(c - took, 0) + free * shared) / np.maximum(total, 1), shared), 1e-12)))
            totals.append(total)
        r = logs[1] - logs[0]
        g = statistic(classes[1], totals[1], classes[0], totals[0])
        for i, hold in enumerate(HOLDS):
            out[which, m * len(HOLDS) + i] = r * g / (g + hold) if hold else r
    return out


def lots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, offsets, counts and bytes of the beginnings of words that come in order of head: whole heads, LOT words or more."""
    held: list[pa.RecordBatch] = []

    def arrays(t: pa.Table) -> tuple[np.ndarray, ...]:
        return *buffers(t["word"]), np.stack([t[c].to_numpy() for c in COUNTS], 1), t["deep"].to_numpy()

    size = 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= LOT:
            t = pa.Table.from_batches(held)
            last = t["head"][-1].as_py()
            to = pa.compute.index(t["head"], last).as_py()
            if to:
                yield arrays(t.slice(0, to))
            held = t.slice(to).combine_chunks().to_batches()
            size = sum(x.num_rows for x in held) if to else 0
    if held:
        t = pa.Table.from_batches(held)
        if t.num_rows:
            yield arrays(t)


def dealt(words: DataFrame) -> DataFrame:
    """words with `head`, the beginning by which a word is dealt, and `deep`, its nominal length: longer for beginnings of over HOT words."""
    head, deep, depth = F.substring("word", 1, HEAD), F.lit(HEAD), HEAD
    while True:
        now = words.select(head.alias("head"), deep.alias("deep"))
        hot = now.where(F.col("deep") == depth).groupBy("head").count().where((F.col("count") > HOT) & (F.length("head") == depth))
        hot = [r["head"] for r in hot.select("head").collect()]  # at most words / HOT
        if not hot:
            return words.select("*", head.alias("head"), deep.alias("deep"))
        split = F.substring("word", 1, depth).isin(*[F.lit(bytes(h)) for h in hot])
        depth += 1
        head, deep = F.when(split, F.substring("word", 1, depth)).otherwise(head), F.when(split, F.lit(depth)).otherwise(deep)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and intercept by damped Newton steps, slightly held towards 0."""
    scale = np.maximum(x.std(0), 1e-9)
    a = np.concatenate([x / scale, np.ones((len(x), 1))], 1)
    w = np.zeros(a.shape[1])

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, np.where(y > 0, -1, 1) * (a @ w)).sum() + 5e-3 * (w @ w))

    now = loss(w)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(w)), a.T @ (y - p) - 1e-2 * w)
        while np.abs(step).max() > 1e-9 and loss(w + step) > now:
            step = step / 2
        if np.abs(step).max() <= 1e-9:
            break
        w = w + step
        now = loss(w)
    return w[:-1] / scale, float(w[-1])


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", held_out: int = 5) -> DataFrame:
    """One row per document: doc_id, held_out (crc32 of the id modulo `held_out` is 0), ratio (length-normalised), score, predicted."""
    ship(docs.sparkSession)
    held = remainder(id_col, held_out) == 0
    y = labels.select(named(label_id).alias("of"), named(label_col).cast("int").alias("y")).where("y in (0, 1) and of is not null").groupBy("of").agg(F.max("y").alias("y"))
    src = docs.select(named(id_col).alias("doc_id"), held.alias("held_out"), named(text_col).alias("text"))
    known = src.where("text is not null").select("doc_id", F.xxhash64("text").alias("h")).where(remainder("doc_id", held_out) != 0)
    known = cut(known.join(small(y, 24), F.col("doc_id") == F.col("of")).groupBy("h", "y").agg(F.min("doc_id").alias("of")).select("of", "y"))
    n = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    lot = F.pmod(F.xxhash64("of", F.lit(5)), F.lit(1 << 40)) < F.when(F.col("y") == 1, int(min(1, CALIBRATE / max(1, n.get(1, 1))) * (1 << 40))).otherwise(int(min(1, CALIBRATE / max(1, n.get(0, 1))) * (1 << 40)))
    known = small(known.withColumn("cal", lot).withColumn("fold", F.pmod(F.xxhash64("of", F.lit(11)), F.lit(FOLDS)).cast("int")), 29)
    both = src.join(known, F.col("doc_id") == F.col("of"), "left").select("doc_id", "held_out", F.coalesce("y", F.lit(-1)).alias("y"), F.coalesce("cal", F.lit(False)).alias("cal"), F.coalesce("fold", F.lit(0)).alias("fold"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags: list[Bag] = []
        for b in batches:
            data, off = buffers(b.column(2))
            y, fold = b.column(0).to_numpy(), b.column(1).to_numpy()
            column = np.where(y < 0, 0, 1 + FOLDS * np.maximum(y, 0) + fold)
            for i, j in pieces(off, BLOCK):
                o = off[i : j + 1]
                row, h, s, e, norm = doc_words(data[o[0] : o[-1]], o - o[0])
                key, first, inv = np.unique(h, return_index=True, return_inverse=True)
                c = np.bincount(inv * len(COUNTS) + column[i:j][row], minlength=len(key) * len(COUNTS)).reshape(len(key), len(COUNTS))
                c[:, 0] = c.sum(1)
                bags.append(Bag(key, gather(norm, s[first], (e - s)[first]), (e - s)[first], c))
                if sum(len(x.key) for x in bags) > 2 * BAG:
                    bags = [Bag.joined(bags)]
                    if len(bags[0].key) > BAG:
                        yield bags.pop().batch()
        if bags:
            yield Bag.joined(bags).batch()

    words = both.select("y", "fold", "text").mapInArrow(count, "word binary, " + ", ".join(f"{c} long" for c in COUNTS))
    words = written(words.groupBy("word").agg(*[F.sum(c).alias(c) for c in COUNTS]))
    words = dealt(words).repartition("head").sortWithinPartitions("head")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The prefixes that tasks share, and under node null the counts of counts of the others."""
        for flat, off, c, head in lots(batches):
            t = Trie(flat, off, c, head)
            at = np.flatnonzero(t.shared)
            of = once_to_four(t.counts[~t.shared]).ravel()
            up = np.where(t.up[at] >= 0, t.node[t.up[at]], np.uint64(0)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([*t.node[at].astype(np.int64), None], pa.int64()), pa.array([*up, 0], pa.int64()), pa.array([*t.counts[at].astype(np.int64).tolist(), of.tolist()], pa.list_(pa.int64()))], names=["node", "up", "c"])

    kinds = max(len(COUNTS), 8 * (FOLDS + 1))
    top = words.mapInArrow(heads, "node long, up long, c array<long>")
    top = top.groupBy("node").agg(F.max("up").alias("up"), *[F.sum(F.get("c", F.lit(i))).alias(f"c{i}") for i in range(kinds)])
    top = cut(top)
    of = top.where("node is null").drop("node", "up").toArrow()  # one row
    of = np.array([of[f"c{i}"].to_pylist() for i in range(8 * (FOLDS + 1))], np.int64).reshape(8 * (FOLDS + 1), -1).sum(1)
    top = top.where("node is not null").select("node", "up", *[f"c{i}" for i in range(len(COUNTS))]).toArrow()  # a row for each shared beginning
    c = np.stack([top[f"c{i}"].to_numpy() for i in range(len(COUNTS))], 1).astype(float)
    node, parent = top["node"].to_numpy().view(np.uint64), top["up"].to_numpy().view(np.uint64)
    order = np.argsort(node)
    node, c, parent = node[order], c[order], parent[order]
    of = of.reshape(FOLDS + 1, 2, 4) + once_to_four(c)
    d = np.array([[discounts(x) for x in m] for m in of])
    up = np.where(parent == 0, len(node), np.searchsorted(node, parent))  # the root comes last
    full = np.concatenate([c, np.zeros((1, len(COUNTS)))])
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((d, node, evidence(full, up, np.arange(len(node)), d)[:-1]))
    del top, c, full, up, parent

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, top, known = shared.value
        for flat, off, c, head in lots(batches):
            t = Trie(flat, off, c, head)
            steps = evidence(t.counts, t.up, np.flatnonzero(~t.shared), d)
            at = np.flatnonzero(t.shared)
            steps[at] = known[np.searchsorted(top, t.node[at])]
            yield pa.RecordBatch.from_arrays([pa.array(t.hash.view(np.int64)), pa.array(c[:, 0]), *[pa.array(np.bincount(t.word, x[t.at], len(off) - 1).astype(np.float32)) for x in steps.T]], names=["word", "docs", *SUMS])

    known_words = written(words.mapInArrow(spell, "word long, docs long, " + ", ".join(f"{x} float" for x in SUMS)))
    often = (F.log2(F.col("docs") + 0.0) * 4).cast("int")
    spread = sorted(((r["k"], r["count"]) for r in known_words.groupBy(often.alias("k")).count().collect()), reverse=True)  # a row for each quarter of a power of two

    def totals(df: DataFrame, keep: list[str], table: DataFrame, width: int, squares: bool) -> DataFrame:
        """The kept columns of each row, and x0 ...: the sums of its distinct words' columns v, from those of its fold on, and of
        their signed squares, by the square root of the words' number."""
        df = df.select(*keep, F.monotonically_increasing_id().alias("row"), "text")
        names = [f"x{i}" for i in range(width * (1 + squares))]
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1]) + ", n long, " + ", ".join(f"{x} double" for x in names) + ", more array<long>"
        every = 8 + 4 * (width * FOLDS if "fold" in keep else width)
        room, least, rest = TABLE_BYTES // every, None, 0
        for k, m in spread:
            if m > room:
                rest += m
                room = 0
            else:
                room, least = room - m, k
        rows = table.where(F.lit(False) if least is None else often >= least).select("word", "v").toArrow()  # at most TABLE_BYTES
        word = rows["word"].to_numpy().view(np.uint64)
        values = rows["v"].combine_chunks().flatten().to_numpy().reshape(len(word), -1) if len(word) else np.zeros((0, every // 4), np.float32)
        order = np.argsort(word)
        held = sc.broadcast((word[order], values[order]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, values = held.value
            for x in batches:
                data, off = buffers(x.column(x.num_columns - 1))
                out, size, more = np.zeros((len(names), x.num_rows)), np.zeros(x.num_rows, np.int64), []
                fold = x.column("fold").to_numpy() if "fold" in keep else np.zeros(x.num_rows, np.int64)
                for i, j in pieces(off, BLOCK):
                    o = off[i : j + 1]
                    row, h, *_ = doc_words(data[o[0] : o[-1]], o - o[0])
                    size[i:j] = np.bincount(row, minlength=j - i)
                    at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
                    here = keys[at] == h if len(keys) else np.zeros(len(h), bool)
                    lack = np.split(h[~here].view(np.int64), np.cumsum(np.bincount(row[~here], minlength=j - i))[:-1]) if rest else [np.zeros(0, np.int64)] * (j - i)
                    more += lack
                    row, at = row[here], at[here]
                    for k in range(width):
                        v = values[at, fold[i:j][row] * width + k].astype(float)
                        out[k, i:j] = np.bincount(row, v, j - i)
                        if squares:
                            out[width + k, i:j] = np.bincount(row, v * np.abs(v), j - i)
                yield pa.RecordBatch.from_arrays([*x.columns[:-1], pa.array(size), *map(pa.array, out), pa.array(more, pa.list_(pa.int64()))], names=[*x.schema.names[:-1], "n", *names, "more"])

        one = df.mapInArrow(run, fields)
        if rest:
            one = written(one)
            v = lambda k: F.get("v", (F.col("fold") if "fold" in keep else F.lit(0)) * width + k).cast("double")
            sums = [v(k) for k in range(width)] + ([v(k) * F.abs(v(k)) for k in range(width)] if squares else [])
            each = one.select("row", *[c for c in keep if c == "fold"], F.explode("more").alias("of")).join(table.where(often < least) if least is not None else table, F.col("of") == F.col("word"))
            each = each.groupBy(F.col("row").alias("at")).agg(*[F.sum(x).alias(f"y{i}") for i, x in enumerate(sums)])
            one = one.join(each, F.col("row") == F.col("at"), "left").select(*keep, "n", *[(F.col(x) + F.coalesce(f"y{i}", F.lit(0.0))).alias(x) for i, x in enumerate(names)])
        return one.select(*keep, *[(F.col(x) / F.sqrt(F.greatest("n", F.lit(1)))).alias(x) for x in names])

    slopes, intercept, able = np.zeros(2 * len(HOLDS)), 0.0, False
    if n.get(0) and n.get(1):
        table = known_words.select("word", "docs", F.array(*SUMS[: FOLDS * len(HOLDS)]).alias("v"))
        s = totals(both.where("cal"), ["y", "fold"], table, len(HOLDS), True).toArrow()  # about 2 x CALIBRATE rows
        ys = s["y"].to_numpy()
        got = np.bincount(ys, minlength=2)
        if got.min() > 0:
            able = True
            slopes, intercept = logistic(np.stack([s[f"x{i}"].to_numpy() for i in range(len(slopes))], 1), ys.astype(float))
            intercept += np.log(n[1] / got[1]) - np.log(n[0] / got[0])  # as sampled back to as they are
    value = F.lit(0.0)
    for i in range(len(HOLDS)):
        r = F.col(f"e{FOLDS}_{i}").cast("double")
        value = value + r * float(slopes[i]) + r * F.abs(r) * float(slopes[len(HOLDS) + i])
    out = totals(src, ["doc_id", "held_out"], known_words.select("word", "docs", F.array(value.cast("float")).alias("v")), 1, False)
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("x0") + F.lit(float(intercept)))))) if able else F.lit(0.0)
    return out.select("doc_id", "held_out", F.col("x0").alias("ratio"), p.alias("score"), (p >= 0.5).cast("int").alias("predicted"))
