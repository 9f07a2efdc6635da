"""The corpus pipeline: five stages over documents, each an operator of fathomdf.llm whose decisions take effect.

A stage takes (spark, docs, sf_dir) and returns documents; between stages the result is written and read again. All return
the columns of documents, whatever others there are and whatever their names: a stage carries whole rows in one struct beside its own columns. ``run`` writes each stage's result to the shared checkpoint folder.

Defined results: an empty table gives an empty one in every stage. A null or wordless text is `und`, so the first stage drops
it; given to a later stage, near duplicates keep it (alike rows of one id once), repeated passages drop it, as nothing is
left, and the benchmark stage and the mixture treat it as of no words (the mixture takes it as often as its source's rate says).
Null ids stay and come last where order counts; a null source is a source of its own. Of repeated rows the second stage keeps one. Very long texts
are read whole, in bounded pieces. Ties go to the smaller doc_id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomdf.llm import decontaminate, jaccard_join, language_id, mixing, queries, suffix_dedup
from fathomdf.llm.common import checkpoint_dir, cut, parts, small, whole


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised stay: not `und`, and more likely than all other languages together."""
    got = language_id.identify(docs, queries.vocabulary(queries.PIECES), carry=True)
    return got.where("lang_pred != 'und' and score >= 0.5").select(*parts(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of least id stays; of repeated rows, one."""
    return jaccard_join.drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the bytes that strings of 100 bytes repeat from earlier; a character cut in two goes whole; n_chars follows."""
    got = suffix_dedup.remove_repeats(docs, as_text=True, carry=True).where("kept != ''")
    new = {"text": F.col("kept")} | ({"n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return got.select(*parts(docs, **new))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    found = decontaminate.decontaminate(docs, queries.table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).distinct()
    src = docs.select(F.col("doc_id").alias("key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), whole(docs).alias("row"))
    return src.join(small(cut(found), 16), F.col("key").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left_anti").select(*parts(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each remaining document as often as it is taken, to bring the sources to their weights."""
    return mixing.mixed(docs)


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("mixture", mixture),
]

#: Segmentation likelihoods and sampled splits can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = queries.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        at = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
