"""N-gram Jaccard self-join by chosen paths (operator 5).

A text is the set of its five-word shingles. In each run the sets are split recursively: a node of the splitting tree
samples one token from every set by a hash that depends on the node, and sets that sampled the same token go on together.
Two sets of similarity s stay together at each step with probability s, so they share a node of depth k in one of R runs
with probability 1 - (1 - s**k)**R; R is set from the target recall at the threshold and the last depth. From the first of
DEPTHS on, a bucket of at most SMALL sets is brute-forced and a larger one is split again; what is left at the last depth is
brute-forced in blocks whatever its size.

Every candidate is verified on the whole shingle sets, and only verified links connect (see pairs): a bucket's members are
compared with its least member and, where that left them apart, with each other; links are counted in each
connected group, all against all in blocks of bounded size, which return link counts but never pairs.

Scale: equal sets are first folded into one under a 128-bit name, map-side, so copies cost nothing later. What is shuffled is
keys (16 runs a set) and, for sets with candidates only, the sets. Texts are read twice and not shuffled as long as the list of
candidates fits the broadcast bound; beyond it they are joined by id.

Defined results: n_links counts other documents, copies included, at Jaccard >= threshold, equality included; component is
the least doc_id reachable. A null or wordless text, and a row of null id, links with nothing and is its own component. A text
of fewer than five words is one shingle; a very long one is hashed in pieces of BLOCK_TEXT bytes cut between words and has
all its shingles. Repeated rows count as copies of one another; rows of one id with different texts are each compared. Only the
named columns are read, so other columns may have any names. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomdf.session import ship

from .common import buffers, cut, mix, named, parts, pieces, shingle_hashes, small, whole, word_hashes
from .pairs import linked

DEPTHS = (3, 4, 5, 6)
SMALL = 50
BLOCK_TEXT = 1 << 20


def runs_for(threshold: float, recall: float, depth: int) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth))


def paths(tokens: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Node of every run at each of DEPTHS: (runs, depths)."""
    node, out = seeds.copy(), []
    for depth in range(1, DEPTHS[-1] + 1):
        mult = mix(node) | np.uint64(1)
        pick = (tokens[None, :] * mult[:, None]).argmin(1)
        node = mix(node * np.uint64(0x9E3779B97F4A7C15) + tokens[pick])
        if depth in DEPTHS:
            out.append(node)
    return np.stack(out, 1)


def text_sets(batch: pa.Array, k: int) -> Iterator[np.ndarray]:
    data, off = buffers(batch)
    for i, j in pieces(off, BLOCK_TEXT):
        o = off[i : j + 1]
        h, at = word_hashes(data[o[0] : o[-1]], o - o[0])
        for r in range(j - i):
            yield shingle_hashes(h[at[r] : at[r + 1]], k)


def set_name(t: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """The 128-bit name of a set."""
    return (t * np.uint64(0xD6E8FEB86659FD93)).sum(), mix(t).sum() ^ np.uint64(len(t))


def set_keys(docs: DataFrame, id_col: str, text_col: str, k: int, runs: int) -> DataFrame:
    """(id, text_key, set_a, set_b, n, keys): a hash of the text, the set's 128-bit name, its size, and its path keys, run by run."""
    src = docs.select(named(id_col).cast("long").alias("id"), named(text_col).alias("text")).where("id is not null and text is not null").select("id", F.xxhash64("text").alias("text_key"), "text")
    seeds = mix(np.arange(1, runs + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, ns, keys, ids = [], [], [], []
            for i, t in enumerate(text_sets(b.column(2), k)):
                if len(t):
                    ids.append(i)
                    names.append(set_name(t))
                    ns.append(len(t))
                    keys.append(paths(t, seeds).ravel())
            name = np.array(names, np.uint64).reshape(-1, 2).view(np.int64)
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            offs = np.arange(len(keys) + 1, dtype=np.int32) * (runs * len(DEPTHS))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(pa.array(ids, pa.int64())) for c in (0, 1)), pa.array(name[:, 0]), pa.array(name[:, 1]), pa.array(np.array(ns, np.int64)), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))],
                names=["id", "text_key", "set_a", "set_b", "n", "keys"],
            )

    return src.mapInArrow(run, "id bigint, text_key bigint, set_a bigint, set_b bigint, n bigint, keys array<bigint>")


def overlap(threshold: float):
    """similar() for packed shingle sets."""

    def similar(xs: list[bytes], ys: list[bytes]) -> np.ndarray:
        same = xs is ys
        a = [np.frombuffer(x, np.uint64) for x in xs]
        b = a if same else [np.frombuffer(y, np.uint64) for y in ys]
        na, nb = np.array([len(x) for x in a], np.float64), np.array([len(y) for y in b], np.float64)
        both = a if same else a + b
        _, inv = np.unique(np.concatenate(both), return_inverse=True)
        rows = np.repeat(np.arange(len(both)), [len(x) for x in both])
        many = np.bincount(inv) > 1
        keep = many[inv]
        col = (np.cumsum(many) - 1)[inv[keep]]
        rows = rows[keep]
        order = np.argsort(col, kind="stable")
        col, rows = col[order], rows[order]
        inter = np.zeros((len(a), len(b)), np.float32)
        width = 2048
        for c in range(0, int(many.sum()), width):
            s, e = np.searchsorted(col, [c, c + width])
            m = np.zeros((len(both), width), np.float32)
            m[rows[s:e], col[s:e] - c] = 1
            inter += m[: len(a)] @ (m if same else m[len(a) :]).T
        union = na[:, None] + nb[None, :] - inter
        return inter >= threshold * union - 1e-6

    return similar


def path_buckets(reps: DataFrame, runs: int) -> DataFrame:
    """(id, keys) -> (key, id): the buckets at which each set's paths end, of two or more sets."""
    d = len(DEPTHS)
    rest = reps.select("id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.slice("keys", r * d + 1, d))).alias("path"))
    out = []
    for k in range(d):
        rest = rest.withColumn("key", F.element_at("path", k + 1))
        size = rest.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("of"), "n")
        rest = cut(rest.join(size, rest["key"] == size["of"]).select("id", "path", "key", "n"))
        ends = F.col("n") <= SMALL if k < d - 1 else F.lit(True)
        out.append(rest.where(ends).select("key", "id"))
        rest = rest.where(~ends).select("id", "path")
    return reduce(DataFrame.unionAll, out)


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8, recall: float = 0.99) -> DataFrame:
    """One row per document: doc_id, n_shingles, n_links, component, kept (doc_id = component), text_key, group (the class, null without words)."""
    ship(docs.sparkSession)
    runs = runs_for(threshold, recall, DEPTHS[-1])
    sets = cut(set_keys(docs, id_col, text_col, k, runs))
    reps = sets.groupBy("set_a", "set_b").agg(F.min("id").alias("rep"), F.count("*").alias("weight"), F.first("keys").alias("keys"))
    reps = cut(reps.withColumn("id", F.monotonically_increasing_id()))
    buckets = cut(path_buckets(reps.select("id", "keys"), runs).withColumn("home", F.lit(True)))
    some = buckets.select(F.col("id").alias("of")).distinct()
    few = small(cut(reps.select("id", "rep", "set_a", "set_b", "weight").join(some, F.col("id") == F.col("of")).select(F.col("id"), F.col("rep").alias("of"), "set_a", "set_b", "weight")), 48)
    src = docs.select(named(id_col).cast("long").alias("doc"), named(text_col).alias("text")).where("doc is not null and text is not null")
    src = src.join(few, src["doc"] == few["of"]).select("id", "set_a", "set_b", "weight", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            name = np.stack([b.column(1).to_numpy(), b.column(2).to_numpy()], 1).view(np.uint64)
            at, load = [], []
            for i, t in enumerate(text_sets(b.column(4), k)):
                if len(t) and tuple(name[i]) == set_name(t):  # another text of the same id has another name
                    at.append(i)
                    load.append(t.tobytes())
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(3).take(rows), pa.array(load, pa.binary())], names=["id", "weight", "payload"])

    load = cut(src.mapInArrow(pack, "id bigint, weight bigint, payload binary").dropDuplicates(["id"]))
    links = cut(linked(buckets, load, overlap(threshold)).withColumnRenamed("id", "of"))
    cls = reps.select("id", "set_a", "set_b", "rep", "weight").join(links, F.col("id") == F.col("of"), "left")
    cls = cut(cls.select(F.col("set_a").alias("a"), F.col("set_b").alias("b"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "rep", F.coalesce("component", "id").alias("c")))
    least = small(cls.groupBy(F.col("c").alias("of")).agg(F.min("rep").alias("component"), F.count("*").alias("n")).where("n > 1").drop("n"), 24)
    cls = cls.join(least, F.col("c") == F.col("of"), "left").select("a", "b", "n_links", F.coalesce("component", "rep").alias("component"), F.col("c").alias("group"))
    got = sets.select("id", "text_key", "set_a", "set_b", "n").join(cls, (F.col("set_a") == F.col("a")) & (F.col("set_b") == F.col("b")))
    got = got.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "n_links", "component", "text_key", "group")
    rest = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    has = F.col("text").isNotNull() & F.col("doc_id").isNotNull() & F.coalesce(F.col("text").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), F.lit(False))
    rest = rest.where(~has).select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component"), F.xxhash64("text").alias("text_key"), F.lit(None).cast("long").alias("group"))
    out = got.unionByName(rest)
    return out.select("doc_id", "n_shingles", "n_links", "component", F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"), "text_key", "group")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8, recall: float = 0.99) -> DataFrame:
    """docs with one document of each group: that of least id. All columns are kept, whatever their names.

    Where several rows of that id are in the group, one stays. Rows of null id stay, and rows without words, alike ones once.
    """
    found = cut(jaccard_join(docs, id_col, text_col, k, threshold, recall).select("doc_id", "text_key", "kept", F.coalesce("group", "text_key").alias("group")).where("doc_id is not null"))
    groups = found.where("kept").groupBy("doc_id", "group").agg(F.min("text_key").alias("first"), F.count("*").alias("n")).where("n > 1")
    several = cut(groups.select(F.col("doc_id").alias("d"), F.col("group").alias("g"), "first"))
    others = found.where("kept").join(small(several, 32), (F.col("doc_id") == F.col("d")) & (F.col("group") == F.col("g"))).where("text_key != first").select("doc_id", "text_key")
    gone = cut(found.where("not kept").select("doc_id", "text_key").unionByName(others).distinct())
    gone = small(gone.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t")), 24)
    again = small(several.select(F.col("d"), F.col("first").alias("t")), 24)
    src = docs.select(named(id_col).cast("long").alias("key"), F.xxhash64(named(text_col)).alias("text_key"), whole(docs).alias("row"))
    here = (F.col("key") == F.col("d")) & (F.col("text_key") == F.col("t"))
    left = src.join(gone, here, "left_anti")
    once = left.join(again, here, "left_anti")
    twice = left.join(again, here, "left_semi").dropDuplicates(["key", "text_key"])
    return once.unionByName(twice).select(*parts(docs))
