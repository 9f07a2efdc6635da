"""Mixing sources to target weights by systematic sampling (operator 9).

Every document of a source expects target / source_size copies. The expected copies are prefix-summed over the source in
order of size, one random offset is added, and a document is emitted once for each integer the running sum crosses. In
order of size neighbours are alike, so the words taken miss the target by about one document's size.

Scale: the text is read once, for its size; afterwards rows are (id, source, size). They are dealt by range over
(source, size, id), so one hot source spreads over many tasks, and the running sum is a row number within the task plus
an offset per (source, task), which is a tiny table. Nothing is collected.

Defined results: a null text has size 0; a null source is a source of its own, last in order; repeated rows are each a
document; a source of no words has target 0 and gives nothing; an empty table gives no rows. Only the named columns are
read, so other columns may have any names; equal sizes come in order of doc_id; a very long text is one document and is counted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, named, parts, small, whole

SIZE_PATTERN = r"[^\x20\x09-\x0D]+"


def text_size(text: Column) -> Column:
    """Number of runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(SIZE_PATTERN)), F.lit(0)).cast("long")


def offset(source: Column, seed: int) -> Column:
    """The source's random offset in [0, 1), the same in every run with this seed."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size) -> with target: share of all sizes by weight, none above cap times its source's size.

    Weights go to the sources in code-point order, null last, and repeat. What a capped source can't take goes to the
    others by weight until none is above its cap: in order of cap / weight the capped ones come first.
    """
    by_name, by_ratio, all_ = Window.orderBy(F.asc_nulls_last("source")), Window.orderBy("ratio", F.asc_nulls_last("source")), Window.partitionBy(F.lit(0))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("most") / F.col("w"))
    s = s.withColumn("goal", F.sum("source_size").over(all_) * F.lit(float(share))).withColumn("all_w", F.sum("w").over(all_))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("goal") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("capped", level > F.col("ratio"))
    full, rest = F.sum(F.when(F.col("capped"), F.col("most")).otherwise(0.0)).over(all_), F.sum(F.when(~F.col("capped"), F.col("w"))).over(all_)
    return s.select("source", "source_size", F.when(F.col("capped"), F.col("most")).otherwise(F.col("w") * ((F.col("goal") - full) / rest)).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies (0 or more, at most the cap rounded up), and the kept columns."""
    base = docs.select(named(id_col).alias("doc_id"), named(source_col).alias("source"), text_size(named(text_col)).alias("size"), *keep)
    order = [F.asc_nulls_last("source"), F.asc("size"), F.asc_nulls_last("doc_id"), *[F.asc_nulls_last(c) for c in keep]]
    dealt = cut(base.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")))
    parts = dealt.groupBy("source", "part").agg(F.count("*").alias("n"), F.min("row").alias("low"), F.sum("size").alias("words"))
    aim = targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    aim = aim.withColumnRenamed("source", "of")
    at = parts.join(aim, parts["source"].eqNullSafe(aim["of"])).select(F.col("source").alias("of"), F.col("part").alias("of_part"), "low", "before", "source_size", "target")
    rows = dealt.join(at, dealt["source"].eqNullSafe(at["of"]) & (dealt["part"] == at["of_part"]))
    rank, rate = F.col("row") - F.col("low") + F.col("before") + 1, F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    shift = offset(F.col("source"), seed)
    copies = (F.floor(shift + rate * rank) - F.floor(shift + rate * (rank - 1))).cast("int")
    return rows.select("doc_id", "source", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), copies.alias("copies"), *keep)


def emit(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents of a plan, each as often as it is taken; needs distinct non-null ids."""
    take = plan.where("copies > 0").select(F.col("doc_id").alias("of"), F.col("copies").alias("n"))
    src = docs.select(named(id_col).alias("key"), whole(docs).alias("row"))
    return src.join(take, F.col("key") == F.col("of")).select("row", F.explode(F.array_repeat(F.lit(0), F.col("n")))).select(*parts(docs))


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, each as often as mix() takes it; ids may be null or repeat.

    Rows are found again by their id and a hash of all their columns; rows that are alike share their copies out.
    """
    key = F.xxhash64(*[named(c) for c in docs.columns], *[named(c).isNull() for c in docs.columns])
    keyed = docs.select(named(id_col).alias("id"), named(source_col).alias("source"), named(text_col).alias("text"), key.alias("key"), whole(docs).alias("row"))
    plan = mix(keyed, "id", keep=("key",)).groupBy(F.col("doc_id").alias("of"), F.col("key").alias("k")).agg(F.sum("copies").alias("n"), F.count("*").alias("m")).where("n > 0")
    alike = small(cut(plan.where("m > 1")), 32)
    j = keyed.select("id", "key", "row")
    here = F.col("id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("k"))
    once = j.join(plan.where("m = 1"), here).select("row", F.col("n").cast("int").alias("times"))
    # of m rows that are alike the i-th takes as many copies as the running sum of n / m crosses there
    i = F.row_number().over(Window.partitionBy("id", "key").orderBy(F.lit(0)))
    upto = lambda x: F.expr(f"cast(n * {x} div m as int)")
    twice = j.join(alike, here).withColumn("i", i).select("row", (upto("i") - upto("(i - 1)")).alias("times"))
    return once.unionByName(twice).where("times > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select(*parts(docs))
