"""Vector search: metrics as columns, exact and filtered k-NN, batches, inverted lists, quantisation, recall.

A query vector is a literal, scored by array functions over the scan, and a top-k keeps k rows per task. Batches join the queries in
blocks of stated size. Vectors are compared in double precision.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomdf.session import ship


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def literal(q: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in q])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    d = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(d == 0, 0.0).otherwise(dot(a, b) / F.nullif(d, F.lit(0.0)))


def l2_squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def l1(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def normalise(a: Column) -> Column:
    n = norm(a)
    return F.when(n == 0, a).otherwise(F.transform(a, lambda x: x / F.nullif(n, F.lit(0.0))))


#: metric -> (score, whether more is nearer)
METRICS = {"cosine": (cosine, True), "dot": (dot, True), "l2": (l2, False), "l2_squared": (l2_squared, False), "l1": (l1, False), "cosine_distance": (lambda a, b: 1 - cosine(a, b), False)}


def score(df: DataFrame, query: Sequence[float], metric: str = "cosine", vector: str = "embedding") -> DataFrame:
    fn, _ = METRICS[metric]
    return df.withColumn("score", fn(doubles(F.col(vector)), literal(query)))


def knn(df: DataFrame, query: Sequence[float], k: int, metric: str = "cosine", id_col: str = "vec_id", vector: str = "embedding", where: Column | None = None, min_score: float | None = None, digits: int = 6) -> DataFrame:
    """(id, score): the k nearest rows that pass the filter, ties by id. The filter comes first, so recall is exact."""
    more = METRICS[metric][1]
    s = score(df.where(where) if where is not None else df, query, metric, vector).select(id_col, F.round("score", digits).alias("score"))
    if min_score is not None:
        s = s.where(F.col("score") >= min_score if more else F.col("score") <= min_score)
    return s.orderBy(F.desc("score") if more else F.asc("score"), id_col).limit(k)


#: Queries joined at once in a batch search.
BATCH = 1024


def knn_batch(df: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "vec_id", query_id: str = "query_id", vector: str = "embedding", query_vector: str = "query", self_pairs: bool = True, digits: int = 6) -> DataFrame:
    """(query_id, id, score, rank): the k nearest of each query, ties by id.

    Queries are taken in blocks of BATCH, each packed into one row that meets every vector once; each task keeps the k
    best of every query before the shuffle, so what moves is queries x k rows per task.
    """
    import numpy as np
    import pyarrow as pa

    ship(df.sparkSession)
    more = METRICS[metric][1]
    base = df.select(F.col(id_col).cast("long").alias("id"), doubles(F.col(vector)).alias("v"))
    n = queries.count()
    blocks = max(1, -(-n // BATCH))
    parts = []
    for i in range(blocks):
        q = queries.select(F.col(query_id).cast("long").alias("q"), doubles(F.col(query_vector)).alias("v"))
        q = (q.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i) if blocks > 1 else q).toArrow()  # at most about BATCH rows
        ids, m = q["q"].to_numpy(), np.array(q["v"].to_pylist(), float)
        if not len(ids):
            continue

        def run(batches, ids=ids, m=m):
            best: list[tuple] = []
            for b in batches:
                x = np.array(b.column(1).to_pylist(), float)
                if not len(x):
                    continue
                s = _matrix(m, x, metric)
                got = b.column(0).to_numpy()
                s = np.round(s, digits)
                if not self_pairs:
                    s[ids[:, None] == got[None, :]] = -np.inf if more else np.inf
                best.append((s, got))
                if len(best) > 1:
                    best = [_keep(best, k, more)]
            if best:
                s, got = _keep(best, k, more)
                got = np.broadcast_to(got, s.shape)
                ok = np.isfinite(s)
                r = np.broadcast_to(ids[:, None], s.shape)[ok]
                yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(got[ok]), pa.array(s[ok])], names=["query_id", "id", "score"])

        parts.append(base.mapInArrow(run, "query_id bigint, id bigint, score double"))
    if not parts:
        return base.sparkSession.createDataFrame([], "query_id bigint, id bigint, score double, rank int")
    all_ = reduce(DataFrame.unionAll, parts)
    w = Window.partitionBy("query_id").orderBy(F.desc("score") if more else F.asc("score"), "id")
    return all_.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _matrix(q, x, metric: str):
    import numpy as np

    if metric in ("cosine", "cosine_distance"):
        d = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))[None, :]
        s = np.where(d == 0, 0.0, (q @ x.T) / np.where(d == 0, 1, d))
        return 1 - s if metric == "cosine_distance" else s
    if metric == "dot":
        return q @ x.T
    if metric == "l1":
        return np.stack([np.abs(x - v).sum(1) for v in q])
    s = np.stack([((x - v) ** 2).sum(1) for v in q])
    return np.sqrt(s) if metric == "l2" else s


def _keep(best: list[tuple], k: int, more: bool):
    import numpy as np

    s = np.concatenate([b[0] for b in best], 1)
    ids = np.concatenate([np.broadcast_to(b[1], b[0].shape) for b in best], 1)
    order = np.lexsort((ids, -s if more else s), axis=1)[:, :k]
    return np.take_along_axis(s, order, 1), np.take_along_axis(ids, order, 1)


def multi_vector(chunks: DataFrame, doc: str, chunk: str, how: str, score_col: str = "score") -> DataFrame:
    """(doc, score, best_chunk): chunk scores of a document as their max, mean, first, last or sum."""
    fn = {"max": lambda: F.max(score_col), "mean": lambda: F.avg(score_col), "first": lambda: F.min_by(score_col, chunk), "last": lambda: F.max_by(score_col, chunk), "sum": lambda: F.sum(score_col)}[how]
    return chunks.groupBy(doc).agg(fn().alias("score"), F.max(F.struct(F.col(score_col), (-F.col(chunk)).alias("c")))["c"].alias("__c")).select(doc, "score", (-F.col("__c")).alias("best_chunk"))


def roll_up(df: DataFrame, keys: list[str], vector: str = "embedding", weight: str | None = None, dim: int | None = None) -> DataFrame:
    """(keys, embedding): the (weighted) mean vector of each group, by sums per position, so nothing is collected. A null
    component counts in no mean. With dim every group has just so many positions, null where no vector has a component."""
    w, v = F.col(weight) if weight else F.lit(1.0), F.col(vector)
    v = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.get(v, i).cast("double")) if dim else doubles(v)
    e = df.select(*keys, w.alias("w"), F.posexplode(v).alias("i", "x"))
    m = e.groupBy(*keys, "i").agg((F.sum(F.col("x") * F.col("w")) / F.sum(F.when(F.col("x").isNotNull(), F.col("w")))).alias("x"))
    return m.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(vector))


def quantise(v: Column, kind: str = "i8") -> Column:
    """i8: whole steps of max|x| / 127; f16 and bf16 precision by rounding the mantissa."""
    if kind == "i8":
        top = F.array_max(F.transform(v, lambda x: F.abs(x)))
        return F.struct((top / 127).alias("scale"), F.transform(v, lambda x: F.when(top == 0, 0).otherwise(F.round(x * 127 / F.nullif(top, F.lit(0.0)))).cast("byte")).alias("q"))
    bits = {"f16": 10, "bf16": 7}[kind]

    def cut(x: Column) -> Column:
        e = F.pow(F.lit(2.0), F.floor(F.log2(F.abs(x))) - bits)
        return F.when(x == 0, x).otherwise(F.rint(x / F.nullif(e, F.lit(0.0))) * e)

    return F.transform(v, cut)


def dequantise(s: Column) -> Column:
    return F.transform(s["q"], lambda x: x.cast("double") * s["scale"])


#: Most rows that centres are fitted on.
SAMPLE = 20_000


def sampled(df: DataFrame, vector: str):
    """At most about SAMPLE vectors, by a hash of the vector, as a matrix."""
    import numpy as np

    n = df.count()
    some = df if n <= SAMPLE else df.where(F.pmod(F.xxhash64(vector), F.lit(1 << 40)) < int(SAMPLE / n * (1 << 40)))
    got = some.select(doubles(F.col(vector)).alias("v")).where("v is not null").toArrow()["v"].combine_chunks()
    return got.flatten().to_numpy().reshape(len(got), -1) if len(got) else np.zeros((0, 0))


def centres_of(x, k: int, seed: int, rounds: int = 12):
    """k-means centres of the rows of a matrix, from seeded rows that lie far apart."""
    import numpy as np

    rng = np.random.default_rng(seed)
    x = x[np.lexsort(x.T)]  # the same whatever order the rows came in
    picked = [int(rng.integers(len(x)))]
    near = ((x - x[picked[0]]) ** 2).sum(1)
    while len(picked) < min(k, len(x)):
        total = near.sum()
        picked.append(int(rng.choice(len(x), p=near / total)) if total > 0 else int(rng.integers(len(x))))
        near = np.minimum(near, ((x - x[picked[-1]]) ** 2).sum(1))
    c = x[picked]
    for _ in range(rounds):
        at = ((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None]).argmin(1)
        n = np.bincount(at, minlength=len(c))
        new = np.stack([np.bincount(at, col, len(c)) for col in x.T], 1)
        c = np.where(n[:, None] > 0, new / np.maximum(n, 1)[:, None], c)
    return c


class Inverted:
    """Inverted lists: k-means centres fitted on a bounded sample, every row filed under its nearest, probing the nearest n."""

    def __init__(self, df: DataFrame, lists: int, id_col: str = "vec_id", vector: str = "embedding", seed: int = 7):
        import numpy as np
        import pyarrow as pa
        from pyspark.sql import types as T

        ship(df.sparkSession)
        self.id_col, self.vector = id_col, vector
        c = centres_of(sampled(df, vector), lists, seed)
        self.centres = [[float(x) for x in r] for r in c]
        at = df.columns.index(vector)

        def file(batches):
            for b in batches:
                x = np.array(b.column(at).to_pylist(), float)
                near = ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1) if len(x) else np.zeros(0, int)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32))], names=[*b.schema.names, "list"])

        self.filed = df.mapInArrow(file, T.StructType([*df.schema.fields, T.StructField("list", T.IntegerType())]))

    def search(self, query: Sequence[float], k: int, probes: int = 4, metric: str = "cosine") -> DataFrame:
        near = sorted(range(len(self.centres)), key=lambda i: sum((a - b) ** 2 for a, b in zip(self.centres[i], query, strict=True)))[:probes]
        return knn(self.filed.where(F.col("list").isin(near)), query, k, metric, self.id_col, self.vector)


def project(df: DataFrame, dims: int = 32, vector: str = "embedding", seed: int = 5, out: str = "projected") -> DataFrame:
    """Random projection that keeps distances in expectation, as unrolled inner products with constants."""
    import numpy as np

    size = df.select(F.size(vector).alias("n")).where("n > 0").first()
    if size is None:
        return df.withColumn(out, F.array().cast("array<double>"))
    m = np.random.default_rng(seed).standard_normal((dims, size["n"])) / np.sqrt(dims)
    v = doubles(F.col(vector))
    return df.withColumn("__v", v).withColumn(out, F.array(*[dot(F.col("__v"), literal(r)) for r in m])).drop("__v")


def rerank(candidates: DataFrame, query: Sequence[float], k: int, metric: str = "cosine", id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Exact scores for a coarse stage's candidates."""
    return knn(candidates, query, k, metric, id_col, vector)


class ProductQuantiser:
    """Product quantisation: k-means per slice of the vector on a bounded sample, codes of one byte a slice, distances from tables."""

    def __init__(self, df: DataFrame, slices: int = 8, codes: int = 16, vector: str = "embedding", seed: int = 3):
        self.vector, self.slices = vector, slices
        x = sampled(df, vector)
        self.width = x.shape[1] // slices
        self.books = [[[float(v) for v in c] for c in centres_of(x[:, s * self.width : (s + 1) * self.width], codes, seed)] for s in range(slices)]

    def encode(self, df: DataFrame, out: str = "code") -> DataFrame:
        """df with the nearest code of every slice."""
        import numpy as np
        import pyarrow as pa
        from pyspark.sql import types as T

        ship(df.sparkSession)
        at, width, books = df.columns.index(self.vector), self.width, [np.array(b) for b in self.books]

        def run(batches):
            for b in batches:
                x = np.array(b.column(at).to_pylist(), float).reshape(b.num_rows, -1)
                near = [((c * c).sum(1)[None] - 2 * x[:, s * width : (s + 1) * width] @ c.T).argmin(1) for s, c in enumerate(books)]
                codes = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * len(books)), pa.array(np.stack(near, 1).astype(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, codes], names=[*b.schema.names, out])

        return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))

    def decode(self, code: Column) -> Column:
        return F.flatten(F.array(*[F.element_at(F.array(*[literal(c) for c in book]), F.get(code, F.lit(s)) + 1) for s, book in enumerate(self.books)]))

    def distance(self, code: Column, query: Sequence[float]) -> Column:
        """Squared distance of a query to a code, by one table lookup a slice."""
        total = F.lit(0.0)
        for s, book in enumerate(self.books):
            q = query[s * self.width : (s + 1) * self.width]
            table = [sum((a - b) ** 2 for a, b in zip(q, c, strict=True)) for c in book]
            total = total + F.element_at(literal(table), F.get(code, F.lit(s)) + 1)
        return total


def recall(found: DataFrame, exact: DataFrame, keys: list[str]) -> float:
    """Share of the exact results that were found."""
    n = exact.count()
    return exact.select(*keys).intersect(found.select(*keys)).count() / n if n else 1.0
