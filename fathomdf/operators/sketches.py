"""Mergeable sketches: distinct counts, frequencies, heavy hitters, quantiles, histograms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hll(col: str, precision: int = 14) -> Column:
    """A mergeable distinct-count sketch (binary)."""
    return F.hll_sketch_agg(col, F.lit(max(4, min(precision, 18))))


def hll_merge(col: str) -> Column:
    return F.hll_union_agg(col)


def hll_estimate(col: str) -> Column:
    return F.hll_sketch_estimate(col)


def count_min(col: str, eps: float = 0.001, confidence: float = 0.99, seed: int = 1) -> Column:
    """A frequency sketch (binary)."""
    return F.count_min_sketch(F.col(col), F.lit(eps), F.lit(confidence), F.lit(seed))


def count_min_table(df: DataFrame, col: str, eps: float = 0.001, delta: float = 0.01, seed: int = 1) -> DataFrame:
    """(row, cell, n): the sketch as a table, mergeable by sums; at most width x depth rows."""
    width, depth = math.ceil(math.e / eps), math.ceil(math.log(1 / delta))
    cells = F.array(*[F.struct(F.lit(i).alias("row"), F.pmod(F.xxhash64(F.col(col), F.lit(seed * 1000 + i)), F.lit(width)).alias("cell")) for i in range(depth)])
    return df.select(F.explode(cells).alias("c")).groupBy("c.row", "c.cell").agg(F.count("*").alias("n"))


def count_min_estimate(sketch: DataFrame, keys: DataFrame, col: str, eps: float = 0.001, delta: float = 0.01, seed: int = 1) -> DataFrame:
    """(key, estimate): never under the true count."""
    width, depth = math.ceil(math.e / eps), math.ceil(math.log(1 / delta))
    cells = F.array(*[F.struct(F.lit(i).alias("row"), F.pmod(F.xxhash64(F.col(col), F.lit(seed * 1000 + i)), F.lit(width)).alias("cell")) for i in range(depth)])
    k = keys.select(col, F.explode(cells).alias("c")).select(col, F.col("c.row").alias("r"), F.col("c.cell").alias("x"))
    fits = width * depth * 24 <= 32 << 20  # bytes of the whole sketch; beyond the bound it is joined by a shuffle
    j = k.join(F.broadcast(sketch) if fits else sketch, (F.col("r") == F.col("row")) & (F.col("x") == F.col("cell")), "left")
    return j.groupBy(col).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def heavy_hitters(df: DataFrame, col: str, k: int, capacity: int = 10_000) -> DataFrame:
    """(item, count): the approximate k most frequent values, from a sketch of stated capacity."""
    top = df.agg(F.expr(f"approx_top_k({col}, {k}, {capacity})").alias("t")).select(F.explode("t").alias("x"))
    return top.select(F.col("x.item").alias(col), F.col("x.count").alias("n"))


def exact_top(df: DataFrame, col: str, k: int) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col).limit(k)


def quantiles(df: DataFrame, col: str, ps: list[float], accuracy: int = 10_000) -> DataFrame:
    return df.agg(F.percentile_approx(col, ps, accuracy).alias("q"))


def dd_bucket(x: Column, alpha: float = 0.01) -> Column:
    """Log-spaced bucket whose midpoint is within alpha of every value in it; sign and zero apart."""
    g = math.log((1 + alpha) / (1 - alpha))
    return F.when(x > 0, F.ceil(F.log(F.nullif(x, F.lit(0.0))) / g)).otherwise(F.lit(None))


def dd_sketch(df: DataFrame, col: str, alpha: float = 0.01, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, side, bucket, n): positive, zero and negative values in log-spaced buckets; merged by sums."""
    x = F.col(col).cast("double")
    g = math.log((1 + alpha) / (1 - alpha))
    b = F.when(x != 0, F.ceil(F.log(F.abs(F.nullif(x, F.lit(0.0)))) / g)).otherwise(F.lit(0)).cast("long")
    return df.where(x.isNotNull() & ~F.isnan(x)).groupBy(*keys, F.signum(x).cast("int").alias("side"), b.alias("bucket")).agg(F.count("*").alias("n"))


def dd_quantile(sketch: DataFrame, p: float, alpha: float = 0.01, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, value): the p-quantile within a relative error of alpha."""
    from pyspark.sql.window import Window

    gamma = (1 + alpha) / (1 - alpha)
    order = F.struct("side", F.col("side") * F.col("bucket"))
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(order)
    total = F.sum("n").over(Window.partitionBy(*(keys or [F.lit(0)])))
    s = sketch.withColumn("upto", F.sum("n").over(w)).withColumn("all", total)
    mid = F.col("side") * 2 * F.pow(F.lit(gamma), F.col("bucket")) / (gamma + 1)
    hit = s.where(F.col("upto") > p * (F.col("all") - 1)).withColumn("v", F.when(F.col("side") == 0, 0.0).otherwise(mid))
    return hit.groupBy(*keys).agg(F.min_by("v", F.struct("side", F.col("side") * F.col("bucket"))).alias("value"))


def dd_quantiles(sketch: DataFrame, ps: list[float], alpha: float = 0.01) -> DataFrame:
    """(p, value): several quantiles read off one sketch, each within a relative error of alpha."""
    from pyspark.sql.window import Window

    gamma = (1 + alpha) / (1 - alpha)
    place = F.struct("side", F.col("side") * F.col("bucket"))
    s = sketch.withColumn("upto", F.sum("n").over(Window.orderBy(place))).withColumn("all", F.sum("n").over(Window.partitionBy(F.lit(0))))  # as many rows as buckets
    s = s.withColumn("v", F.when(F.col("side") == 0, 0.0).otherwise(F.col("side") * 2 * F.pow(F.lit(gamma), F.col("bucket")) / (gamma + 1)))
    hit = s.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in ps]))).where(F.col("upto") > F.col("p") * (F.col("all") - 1))
    return hit.groupBy("p").agg(F.min_by("v", place).alias("value"))


def cardinalities(df: DataFrame, columns: list[str], precision: int = 14) -> DataFrame:
    """(column, rows, distinct): estimated distinct values of some columns, all in one pass."""
    one = df.agg(F.count("*").alias("rows"), *[F.hll_sketch_estimate(hll(c, precision)).alias(c) for c in columns])
    return one.select("rows", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("distinct")) for c in columns])).alias("x")).select("x.column", "rows", "x.distinct")


def drift(before: DataFrame, now: DataFrame, most: float = 0.2) -> DataFrame:
    """(column, change, drifted) between two results of cardinalities(): the relative change of the distinct values."""
    b = before.select(F.col("column").alias("of"), F.col("distinct").alias("was"))
    change = (F.col("distinct") - F.col("was")) / F.greatest("was", F.lit(1))
    return now.join(b, F.col("column") == F.col("of")).select("column", change.alias("change"), (F.abs(change) > most).alias("drifted"))


def exponential_histogram(df: DataFrame, col: str) -> DataFrame:
    """(bucket, low, high, n): powers of two; values of 0 or less in bucket null."""
    x = F.col(col).cast("double")
    b = F.when(x > 0, F.floor(F.log2(F.nullif(x, F.lit(0.0))))).cast("long")
    return df.where(x.isNotNull()).groupBy(b.alias("bucket")).agg(F.count("*").alias("n")).select("bucket", F.pow(F.lit(2.0), F.col("bucket")).alias("low"), F.pow(F.lit(2.0), F.col("bucket") + 1).alias("high"), "n")


def adaptive_quantile(col: str, p: float, exact_up_to: int = 128) -> Column:
    """Exact for few values, approximate for many."""
    return F.when(F.count(col) <= exact_up_to, F.percentile(col, F.lit(p))).otherwise(F.percentile_approx(col, F.lit(p)).cast("double"))
