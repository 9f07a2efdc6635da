"""Fusing ranked lists: reciprocal ranks, linear, max, cascade; temporal decay; the hybrid query; the semantic cache.

A ranked list ("arm") is a DataFrame (id, score); ranks start at 1, ties go by id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WEIGHTS = {"even": (1.0, 1.0), "semantic": (0.7, 0.3), "keyword": (0.3, 0.7)}
#: decay parameters: factor, half-life in seconds, share of the semantic score, floor
DECAYS = {"default": (0.5, 86400.0, 0.7, 0.01), "short": (0.5, 3600.0, 0.7, 0.01), "long": (0.85, 604800.0, 0.7, 0.05), "working": (0.3, 300.0, 0.7, 0.0)}


def ranked(arm: DataFrame, id_col: str = "id") -> DataFrame:
    """With rank. Arms are top-k lists of stated length, so one task ranks one."""
    return arm.select(F.col(id_col).alias("id"), "score").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def rrf(arms: list[DataFrame], weights: tuple[float, ...] | None = None, k: int = 60, id_col: str = "id", digits: int = 6) -> DataFrame:
    """(id, score): the sum over arms of weight / (k + rank)."""
    w = weights or (1.0,) * len(arms)
    parts = [ranked(a, id_col).select("id", (F.lit(float(x)) / (k + F.col("rank"))).alias("s")) for a, x in zip(arms, w, strict=True)]
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.round(F.sum("s"), digits).alias("score"))


def normalised(arm: DataFrame, id_col: str = "id") -> DataFrame:
    """Scores moved to [0, 1]; all 1 if they are equal."""
    w = Window.partitionBy(F.lit(0))
    low, high = F.min("score").over(w), F.max("score").over(w)
    return arm.select(F.col(id_col).alias("id"), F.when(high == low, 1.0).otherwise((F.col("score") - low) / F.nullif(high - low, F.lit(0.0))).alias("score"))


def linear(arms: list[DataFrame], weights: tuple[float, ...], id_col: str = "id", digits: int = 6) -> DataFrame:
    """(id, score): weighted sum of normalised scores; an arm without the id adds 0."""
    parts = [normalised(a, id_col).select("id", (F.col("score") * float(x)).alias("s")) for a, x in zip(arms, weights, strict=True)]
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.round(F.sum("s"), digits).alias("score"))


def greatest(arms: list[DataFrame], id_col: str = "id", digits: int = 6) -> DataFrame:
    """(id, score): the greatest normalised score."""
    return reduce(DataFrame.unionByName, [normalised(a, id_col) for a in arms]).groupBy("id").agg(F.round(F.max("score"), digits).alias("score"))


def cascade(first: DataFrame, second: DataFrame, id_col: str = "id", digits: int = 6) -> DataFrame:
    """(id, score): ids of the first arm by their score in the second; those it lacks get minus their rank, from 0."""
    a, b = ranked(first, id_col), second.select(F.col(id_col).alias("of"), F.col("score").alias("s"))
    return a.join(b, a["id"] == b["of"], "left").select("id", F.round(F.coalesce("s", (1 - F.col("rank")).cast("double")), digits).alias("score"))


def raw_fusion(arms: list[DataFrame], how: str, weights: tuple[float, ...] | None = None, id_col: str = "id", digits: int = 6) -> DataFrame:
    """Fusion of scores as they are: weighted_sum, max, or mean of those present."""
    w = weights or (1.0,) * len(arms)
    u = reduce(DataFrame.unionByName, [a.select(F.col(id_col).alias("id"), F.col("score").alias("s"), F.lit(float(x)).alias("w")) for a, x in zip(arms, w, strict=True)])
    fn = {"weighted_sum": F.sum(F.col("s") * F.col("w")), "max": F.max("s"), "mean": F.avg("s")}[how]
    return u.groupBy("id").agg(F.round(fn, digits).alias("score"))


def decay(age_seconds: Column, preset: str = "default") -> Column:
    """factor ** (age / half-life), not under the floor; ages under 0 count as 0."""
    factor, tau, _, floor = DECAYS[preset]
    return F.greatest(F.pow(F.lit(factor), F.greatest(age_seconds, F.lit(0.0)) / tau), F.lit(floor))


def decayed(score: Column, age_seconds: Column, preset: str = "default") -> Column:
    share = DECAYS[preset][2]
    return share * score + (1 - share) * decay(age_seconds, preset)


def top(df: DataFrame, k: int, min_score: float | None = None) -> DataFrame:
    df = df.where(F.col("score") >= min_score) if min_score is not None else df
    return df.orderBy(F.desc("score"), "id").limit(k)


def hybrid(corpus: DataFrame, query_vector, query_text: str, k: int, where: Column | None = None, how: str = "rrf", weights: tuple[float, float] | str = (1.0, 1.0), id_col: str = "doc_id", vector: str = "embedding", text: str = "text", fetch: int = 100, index=None, rerank=None) -> DataFrame:
    """The filter comes once, before both arms; then k-NN and BM25 with global statistics, fused.

    index: a lexical.Index to search instead of the texts; weights: two numbers or a name of WEIGHTS; rerank: a function from
    (candidates with id and score, corpus) to (id, score) over the fused candidates.
    """
    from . import lexical
    from .vector import knn

    weights = WEIGHTS[weights] if isinstance(weights, str) else weights
    a = knn(corpus, query_vector, fetch, "cosine", id_col, vector, where=where).select(F.col(id_col).alias("id"), "score")
    if index is None:
        b = lexical.bm25(corpus, query_text, fetch, id_col, text, where=where)
    else:
        b = index.bm25(query_text, fetch, corpus.where(where).select(id_col) if where is not None else None)
    b = b.select(F.col(id_col).alias("id"), "score")
    fused = {"rrf": lambda: rrf([a, b], weights), "linear": lambda: linear([a, b], weights), "max": lambda: greatest([a, b]), "cascade": lambda: cascade(a, b)}[how]()
    return top(rerank(top(fused, fetch), corpus) if rerank else fused, k)


def cache_lookup(entries: DataFrame, query: str, query_vector, namespace: str, allowed_hash: int, now: int, threshold: float = 0.95) -> DataFrame:
    """The best unexpired cached answer: the same query text first, else the nearest query of at least the threshold."""
    from .vector import cosine, doubles, literal

    live = entries.where((F.col("namespace") == namespace) & (F.col("allowed_hash") == allowed_hash) & (F.col("expires_at") > now))
    s = live.withColumn("exact", F.col("query") == query).withColumn("score", cosine(doubles(F.col("embedding")), literal(query_vector)))
    return s.where(F.col("exact") | (F.col("score") >= threshold)).orderBy(F.desc("exact"), F.desc("score"), "query").limit(1)


def cache_without(entries: DataFrame, source: str | None = None, now: int | None = None) -> DataFrame:
    """Entries not derived from a source document, and not expired."""
    if source is not None:
        entries = entries.where(~F.coalesce(F.array_contains("sources", source), F.lit(False)))
    return entries.where(F.col("expires_at") > now) if now is not None else entries


def id_set_hash(ids: DataFrame, col: str) -> DataFrame:
    """One number that is equal for equal id sets, whatever their order."""
    return ids.select(col).distinct().agg(F.count("*").alias("n"), F.sum(F.xxhash64(col).cast("decimal(38,0)")).alias("s")).select(F.xxhash64("n", "s").alias("hash"))
