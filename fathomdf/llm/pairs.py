"""Verified links between rows that share candidate buckets (shared by operators 3 and 5).

Candidate buckets only say which rows may be alike; rows are connected by verified links alone, in three steps:

1. Every row is verified against the least member of each of its buckets (a pair that meets in many buckets once). The
   links give components.
2. A bucket whose members are in one component needs nothing more. In the others all pairs between rows of the least
   member's component and the rest, and within the rest, are verified (or all pairs with a row that is at home in the
   bucket, where these are fewer). Buckets with the same members are verified once.
3. Links are counted in each component, all against all: every link lies in one.

Comparisons are dealt into blocks of BLOCK rows and every pair of blocks is a unit of work, so a group of any size spreads
over many tasks and no task holds more than two blocks. A unit returns a row per member (its links there, and the least
member its links reach there), never the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, small

BLOCK = 1000


def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by (grp, bi, bj) as one table per unit."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(n).to_numpy() for n in ("grp", "bi", "bj")])
        new = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1
        for i, j in zip([0, *new], [*new, b.num_rows], strict=True):
            key = tuple(k[:, i])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def reach(adj: np.ndarray) -> np.ndarray:
    """The least index that each index reaches over a symmetric adjacency matrix."""
    n = len(adj)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(adj, label[None, :], n).min(1)) if n else label
        new = new[new]
        if (new == label).all():
            return label
        label = new


def verified(members: DataFrame, load: DataFrame, similar: Callable[[list, list], np.ndarray]) -> DataFrame:
    """members: (grp, id, other), load: (id, weight, payload) -> (id, low, links) per unit, for ids with links there.

    In each group all pairs with an `other` row are compared. similar(payloads, payloads) gives the matrix of linked
    pairs. links sums the weights of the members linked, low is the least id reached.
    """
    sizes = members.groupBy("grp").agg(F.count(F.when(F.col("other"), 1)).alias("x"), F.count(F.when(~F.col("other"), 1)).alias("y")).where("x > 0 and x + y > 1")
    sizes = small(cut(sizes.select(F.col("grp").alias("of"), F.ceil(F.col("y") / BLOCK).cast("int").alias("g1"), F.ceil(F.col("x") / BLOCK).cast("int").alias("g2"))), 24)
    m = members.join(sizes, members["grp"] == sizes["of"])
    lot = F.xxhash64("id")
    b = F.when(F.col("other"), F.col("g1") + F.pmod(lot, F.col("g2"))).otherwise(F.pmod(lot, F.greatest("g1", F.lit(1)))).cast("int")
    o = F.explode(F.sequence(F.when(F.col("other"), 0).otherwise(F.col("g1")), F.col("g1") + F.col("g2") - 1))
    m = m.select("grp", F.col("id").alias("of"), b.alias("b"), o.alias("o"))
    m = m.select("grp", F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj"), "b", "of").join(load, F.col("of") == load["id"]).select("grp", "bi", "bj", "b", "id", "weight", "payload")
    m = m.repartition("grp", "bi", "bj").sortWithinPartitions("grp", "bi", "bj")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            cols = [np.concatenate(c) for c in zip(*out, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["id", "low", "links"])

        for t in units(batches):
            b, ids, w = t["b"].to_numpy(), t["id"].to_numpy(), t["weight"].to_numpy()
            order = np.argsort(ids, kind="stable")
            b, ids, w = b[order], ids[order], w[order]
            payload = t["payload"].to_pylist()
            payload = [payload[i] for i in order]
            bi, bj = int(t["bi"][0].as_py()), int(t["bj"][0].as_py())
            adj = np.zeros((len(ids), len(ids)), bool)
            if bi == bj:
                adj = similar(payload, payload)
            else:
                x, y = np.flatnonzero(b == bi), np.flatnonzero(b == bj)
                if len(x) and len(y):
                    part = similar([payload[i] for i in x], [payload[i] for i in y])
                    adj[np.ix_(x, y)] = part
                    adj[np.ix_(y, x)] = part.T
            np.fill_diagonal(adj, False)
            links = adj @ w
            hit = np.flatnonzero(links > 0)
            if len(hit):
                out.append([ids[hit], ids[reach(adj)[hit]], links[hit].astype(np.int64)])
            if len(out) > 500:
                yield flush()
        if out:
            yield flush()

    return cut(m.mapInArrow(run, "id bigint, low bigint, links bigint"))


def bucket_table(buckets: DataFrame) -> DataFrame:
    """(key, id, home) -> (k, pivot, homes): a row per set of two or more members with one at home; pivot: the least of these."""
    b = buckets.groupBy("key").agg(F.min(F.when(F.col("home"), F.col("id"))).alias("pivot"), F.count(F.when(F.col("home"), 1)).alias("homes"), F.count("*").alias("n"), F.sum(F.xxhash64("id", "home").cast("decimal(38,0)")).alias("s"))
    b = b.where("pivot is not null and n > 1")
    return b.groupBy("pivot", "homes", "n", "s").agg(F.min("key").alias("k")).select("k", "pivot", "homes")


def linked(buckets: DataFrame, load: DataFrame, similar: Callable[[list, list], np.ndarray]) -> DataFrame:
    """buckets: (key, id, home), load: (id, weight, payload), both written -> (id, links, component) for ids that have links.

    ids are bigint and occur once in load and once in a bucket; component is the least id reached. A pair is a candidate
    where the two share a bucket and one of them is at home there.
    """
    k = small(cut(bucket_table(buckets)), 40)
    inside = cut(buckets.join(k, buckets["key"] == k["k"]).select("key", "id", "home", "pivot", "homes"))
    star = inside.where("id != pivot").select(F.col("pivot").alias("grp"), "id").distinct().withColumn("other", F.lit(False))
    star = cut(star.unionByName(star.select("grp", F.col("grp").alias("id"), F.lit(True).alias("other")).distinct()))
    first = verified(star, load, similar)
    of = cut(components(first, "id", "low"))
    # what is left: buckets with rows outside the pivot's component
    c = small(of, 24).select(F.col("node").alias("x"), F.col("component").alias("c"))
    p = c.select(F.col("x").alias("px"), F.col("c").alias("pc"))
    rows = inside.where("id != pivot").join(c, F.col("id") == F.col("x"), "left").join(p, F.col("pivot") == F.col("px"), "left")
    rows = cut(rows.select("key", "id", "home", "homes", (F.coalesce("c", "id") != F.coalesce("pc", "pivot")).alias("out")))
    left = cut(rows.groupBy(F.col("key").alias("k"), F.col("homes").alias("h")).agg(F.count(F.when(F.col("out"), 1)).alias("outs"), F.count("*").alias("n")).where("outs > 0 and n > 1"))
    more = None
    if not left.isEmpty():
        few = small(left, 40)
        rest = rows.join(few, rows["key"] == few["k"]).select(F.col("key").alias("grp"), "id", F.when(F.col("h") <= F.col("outs"), F.col("home")).otherwise(F.col("out")).alias("other"))
        more = verified(cut(rest), load, similar)
    if more is not None and not more.isEmpty():
        of = cut(components(of.select(F.col("node").alias("id"), F.col("component").alias("low")).unionByName(more.select("id", "low")), "id", "low"))
    groups = cut(of.select(F.col("component").alias("grp"), F.col("node").alias("id"), F.lit(True).alias("other")))
    links = verified(groups, load, similar).groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "of")
    return links.join(groups.select("id", F.col("grp").alias("component")), F.col("of") == F.col("id")).select("id", "links", "component")
