"""Embedding near-duplicates by lattice hashing (operator 3).

Each of several tables projects the unit vectors to PIECES x 8 dimensions at random, shifts and scales them, and decodes every
eight to the nearest point of the E8 lattice: the better of the nearest points of D8 and of D8 shifted by one half. The points
together name a cell. A vector is filed at home in its own cell and also asks at the neighbouring cells nearest to it: those
where one piece moves to one of the 240 points around. Vectors that meet where one is at home are candidates and are verified
by cosine in double precision; only verified links connect (see pairs).

The number of tables follows from the target recall: the probability that a pair of exactly the threshold meets in a table is
that of two Gaussian points with that correlation, whatever the vectors' dimension, and is taken from seeded trials. More rows
take more pieces a cell, so that unrelated vectors seldom meet, and more tables, for the same recall.

Scale: equal vectors of a label are folded into one first, map-side, under a 128-bit name. What is shuffled is cell keys of 8
bytes and, for candidates, the vectors. A hot label spreads over its cells; a cell's members are verified against its least
member first and against each other, in blocks, only where that left them apart; links of a hot group are counted in blocks,
which return link counts and components and never pairs.

Defined results: vectors are compared only within one label that is not null, and of one length. A vector that is null,
empty, zero, or has null or non-finite parts, and a row of null id, links with nothing and is its own component. n_links
counts copies. Repeated ids count as rows of their own, each with its own vector's links; ties in cosine at the threshold link. Only the named columns
are read, so other columns may have any names. Vectors are of bounded length, there are no texts. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomdf.session import ship

from .common import cut, mix, named, small
from .pairs import linked

PROBES, WIDTH, RECALL = 8, 2.0, 0.995
#: Pieces of eight dimensions in a cell: two up to the first number of distinct vectors, then one more for each step of 1,000.
PIECES, STEP = 2, 1_000_000


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled so that they are whole numbers."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (2, -2):
                for b in (2, -2):
                    v = np.zeros(8, np.int64)
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        s = np.array([1 - 2 * ((bits >> k) & 1) for k in range(8)])
        if (s < 0).sum() % 2 == 0:
            out.append(s)
    return np.array(out)


ROOTS = _roots()


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest point of D8: whole numbers of even sum."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(1) % 2 != 0)
    if len(odd):
        gap = x[odd] - r[odd]
        worst = np.abs(gap).argmax(1)
        r[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1, -1)
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8, doubled."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    nearer = ((x - b) ** 2).sum(1) < ((x - a) ** 2).sum(1)
    return np.rint(2 * np.where(nearer[:, None], b, a)).astype(np.int64)


def pieces_for(rows: int) -> int:
    return PIECES + max(0, math.ceil(math.log(max(rows, 1) / STEP, 1000)))


def moves(x: np.ndarray, home: np.ndarray, probes: int) -> np.ndarray:
    """The nearest neighbouring cells of points (rows, pieces, 8): indices into pieces x 240 moves of one piece."""
    lean = 2 * (2 * x - home) @ ROOTS.T - (ROOTS**2).sum(1)
    return np.argpartition(-lean.reshape(len(x), -1), probes - 1, axis=1)[:, :probes]


def decoded(x: np.ndarray) -> np.ndarray:
    return np.stack([decode(x[:, i]) for i in range(x.shape[1])], 1)


@lru_cache
def tables_for(threshold: float, recall: float, pieces: int, probes: int = PROBES, width: float = WIDTH, trials: int = 4000) -> int:
    """Tables that a pair of exactly the threshold needs to meet in one of them with the probability `recall`."""
    rng = np.random.default_rng([pieces, probes])
    x, z, shift = rng.standard_normal((trials, pieces, 8)), rng.standard_normal((trials, pieces, 8)), rng.uniform(0, 2, (trials, pieces, 8))
    y = threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * z
    a, b = decoded(x / width + shift), decoded(y / width + shift)
    met = (a == b).all((1, 2))
    for p, q, at in ((a, b, x / width + shift), (b, a, y / width + shift)):
        near = moves(at, p, probes)
        for k in range(probes):
            moved = p.copy()
            moved[np.arange(trials), near[:, k] // len(ROOTS)] += ROOTS[near[:, k] % len(ROOTS)]
            met |= (moved == q).all((1, 2))
    p = min(max(met.mean(), 1e-3), 1 - 1e-9)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def cells(unit: np.ndarray, tables: int, pieces: int, probes: int, width: float, seed: int) -> np.ndarray:
    """Cell keys of each vector: (vectors, tables, 1 + probes), its own first, then the nearest neighbours."""
    dim, out = unit.shape[1], np.zeros((len(unit), tables, 1 + probes), np.uint64)
    rows = np.arange(len(unit))
    for t in range(tables):
        rng = np.random.default_rng([seed, dim, t])
        x = (unit @ rng.standard_normal((dim, 8 * pieces)) / width + rng.uniform(0, 2, 8 * pieces)).reshape(-1, pieces, 8)
        home = decoded(x)
        near = moves(x, home, probes)
        for k in range(1 + probes):
            point = home if not k else home.copy()
            if k:
                point[rows, near[:, k - 1] // len(ROOTS)] += ROOTS[near[:, k - 1] % len(ROOTS)]
            h = np.full(len(unit), t + 1, np.uint64)
            for c in range(8 * pieces):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + point[:, c // 8, c % 8].astype(np.uint64))
            out[:, t, k] = h
    return out


def cosine(threshold: float):
    """similar() for packed rows: the label's hash, then the unit vector in double precision."""

    def similar(xs: list[bytes], ys: list[bytes]) -> np.ndarray:
        if len({len(x) for x in (*xs, *ys)}) > 1:  # only where two cell keys of different lengths have one hash
            return np.array([[len(x) == len(y) and bool(similar([x], [y])[0, 0]) for y in ys] for x in xs], bool).reshape(len(xs), len(ys))
        a, b = (np.frombuffer(b"".join(v), np.float64).reshape(len(v), -1) for v in (xs, ys))
        p, q = a[:, :1].copy().view(np.int64), b[:, :1].copy().view(np.int64)
        return (a[:, 1:] @ b[:, 1:].T >= threshold) & (p == q.T)

    return similar


def lattice_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, recall: float = RECALL, probes: int = PROBES, width: float = WIDTH, seed: int = 11) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    ship(vectors.sparkSession)
    v = vectors.select(named(id_col).cast("long").alias("vec_id"), named(label_col).alias("label"), named(vector_col).cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("e") > 0) & finite & F.exists("e", lambda x: x != 0), F.lit(False))
    salt = F.xxhash64(F.col("label").cast("string"), F.size("e"))
    v = v.select("vec_id", good.alias("good"), F.xxhash64(salt, "e").alias("name_a"), F.xxhash64(F.lit(7), "e", salt).alias("name_b"), salt.alias("salt"), "e")
    reps = v.where("good").groupBy("name_a", "name_b").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("salt").alias("salt"), F.first("e").alias("e"))
    reps = cut(reps.withColumn("id", F.monotonically_increasing_id()))
    n_pieces = pieces_for(reps.count())
    tables = tables_for(threshold, recall, n_pieces, probes, width)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off = b.column(2).offsets.to_numpy()
            flat, size, salt = b.column(2).values.to_numpy(), np.diff(off), b.column(1).to_numpy()
            for dim in np.unique(size):
                rows = np.flatnonzero(size == dim)
                for lo in range(0, len(rows), 2048):
                    at = rows[lo : lo + 2048]
                    x = flat[off[at][:, None] + np.arange(dim)]
                    x = x / np.abs(x).max(1, keepdims=True)
                    x = x / np.sqrt((x * x).sum(1, keepdims=True))
                    c = mix(cells(x, tables, n_pieces, probes, width, seed) + salt[at].astype(np.uint64)[:, None, None]).reshape(len(at), -1)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * c.shape[1]), pa.array(c.ravel().view(np.int64)))
                    payload = np.concatenate([salt[at][:, None].astype(np.int64).view(np.float64), x], 1)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), lists, pa.array([r.tobytes() for r in payload], pa.binary())], names=["id", "keys", "payload"])

    filed = cut(reps.select("id", "salt", "e").mapInArrow(keys, "id bigint, keys array<bigint>, payload binary"))
    asked = filed.select("id", F.posexplode("keys").alias("p", "key")).groupBy("key", "id").agg(F.max(F.col("p") % (1 + probes) == 0).alias("home"))
    load = cut(filed.join(reps.select(F.col("id").alias("of"), "weight"), F.col("id") == F.col("of")).select("id", "weight", "payload"))
    links = cut(linked(cut(asked), load, cosine(threshold)).withColumnRenamed("id", "of"))
    cls = reps.select("id", "name_a", "name_b", "rep", "weight").join(links, F.col("id") == F.col("of"), "left")
    cls = cut(cls.select(F.col("name_a").alias("a"), F.col("name_b").alias("b"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "rep", F.coalesce("component", "id").alias("c")))
    least = small(cls.groupBy(F.col("c").alias("of")).agg(F.min("rep").alias("component_id"), F.count("*").alias("n")).where("n > 1").drop("n"), 24)
    cls = cls.join(least, F.col("c") == F.col("of"), "left").select("a", "b", "n_links", F.coalesce("component_id", "rep").alias("component_id"))
    got = v.where("good").join(cls, (F.col("name_a") == F.col("a")) & (F.col("name_b") == F.col("b"))).select("vec_id", "n_links", "component_id")
    rest = v.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = got.unionByName(rest)
    return out.select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
