"""Lexical retrieval: tokens, a stored inverted index, BM25 (any term, all terms), phrases.

An Index is built once: postings with positions, dealt by range of (term, id) and sorted, so that a frequent term spreads over
files and a query reads only the row groups of its terms; document lengths; corpus statistics in one row. Queries filter the
postings to their terms before anything moves and never read the texts again. bm25() and phrase() do the same over texts that
have no index, in one scan of the texts.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, so that all engines split alike.
SPACE = r"[ \t\n\r\f\x0b]+"
PRESETS = {"lucene": (1.2, 0.75), "short": (1.5, 0.5)}


def tokens(text: Column, lower: bool = True, minimal: bool = False) -> Column:
    """White-space tokens; minimal also splits ASCII punctuation and drops tokens of one byte."""
    t = F.lower(text) if lower else text
    if minimal:
        return F.filter(F.split(t, r"[ \t\n\r\f\x0b!-/:-@\[-`{-~]+"), lambda x: F.octet_length(x) > 1)
    return F.filter(F.split(t, SPACE), lambda x: x != "")


def query_tokens(query: str, lower: bool = True) -> list[str]:
    return [t for t in re.split(SPACE, query.lower() if lower else query) if t]


def _times(ws: str, term: str) -> Column:
    return F.size(F.filter(ws, lambda x: x == term))


def _both(word: str):
    return lambda so_far, x: F.coalesce(so_far & (x == word), F.lit(False))


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lower: bool = True) -> DataFrame:
    """(term, id, tf): the postings."""
    return docs.select(id_col, F.explode(tokens(F.col(text_col), lower)).alias("term")).groupBy("term", id_col).agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, query: str, k: int | None = 20, id_col: str = "doc_id", text_col: str = "text", where: Column | None = None, all_terms: bool = False, k1: float = 1.2, b: float = 0.75, lower: bool = True, digits: int = 6) -> DataFrame:
    """(id, score): ranked documents with any (or all known) query terms, ties by id; repeated query terms add again.

    Statistics come from the whole corpus; the filter restricts what may be returned.
    """
    terms = [t for t in query_tokens(query, lower) if not all_terms or len(t.encode()) >= 2]
    times = {t: terms.count(t) for t in terms}
    cols = [id_col, F.size("ws").alias("dl"), *([where.alias("ok")] if where is not None else [F.lit(True).alias("ok")])]
    base = docs.withColumn("ws", tokens(F.col(text_col), lower))
    names = list(times)
    base = base.select(*cols, *[_times("ws", t).alias(f"tf{i}") for i, t in enumerate(names)])
    stats = base.agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avg"), *[F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(names))])
    j = base.where(F.col("ok")).join(F.broadcast(stats))  # one row
    total, present = F.lit(0.0), F.lit(True)
    any_ = F.lit(False)
    for i, t in enumerate(names):
        tf, df = F.col(f"tf{i}").cast("double"), F.col(f"df{i}")
        idf = F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1)
        total = total + times[t] * F.when(tf > 0, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avg")))).otherwise(0.0)
        any_, present = any_ | (tf > 0), present & ((tf > 0) | (df == 0))
    out = j.where(any_ & present if all_terms else any_).select(id_col, F.round(total, digits).alias("score"))
    out = out.orderBy(F.desc("score"), id_col)
    return out.limit(k) if k is not None else out


def phrase(docs: DataFrame, query: str, k: int | None = 20, id_col: str = "doc_id", text_col: str = "text", k1: float = 1.2, b: float = 0.75, lower: bool = True, digits: int = 6) -> DataFrame:
    """(id, tf, score): documents with the words in a row; idf of the rarest word, tf of the phrase."""
    words = query_tokens(query, lower)
    n = len(words)
    base = docs.select(id_col, tokens(F.col(text_col), lower).alias("ws")).withColumn("dl", F.size("ws"))
    # one flag per word: does the phrase begin here; built word by word, since a lambda that looks into the whole array
    # would split the text again at every position
    at = F.transform("ws", lambda x: x == words[0])
    for j, w in enumerate(words[1:], 2):
        at = F.zip_with(at, F.slice("ws", j, F.greatest(F.size("ws"), F.lit(1))), _both(w))
    at = F.filter(at, lambda x: x)
    has = [F.array_contains("ws", w) for w in words]
    every = has[0]
    for h in has[1:]:
        every = every & h
    base = base.select(id_col, "dl", *[h.alias(f"h{i}") for i, h in enumerate(has)], F.when(every, F.size(at)).otherwise(0).alias("tf"))
    stats = base.agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avg"), F.least(*[F.count(F.when(F.col(f"h{i}"), 1)) for i in range(n)], F.lit(1 << 60)).alias("df"))
    j = base.where("tf > 0").join(F.broadcast(stats))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    s = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg")))
    out = j.select(id_col, F.col("tf").cast("long").alias("tf"), F.round(s, digits).alias("score")).orderBy(F.desc("score"), id_col)
    return out.limit(k) if k is not None else out


class Index:
    """A stored inverted index: folders postings (term, id, tf, dl, positions), lengths (id, dl) and stats (n, avg) under a path."""

    def __init__(self, spark: SparkSession, path: str, id_col: str = "doc_id", lower: bool = True):
        self.id_col, self.lower = id_col, lower
        self.postings, self.lengths, self.stats = (spark.read.parquet(f"{path}/{x}") for x in ("postings", "lengths", "stats"))

    @staticmethod
    def build(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lower: bool = True) -> Index:
        """Write the index of all documents; texts are read once and shuffled as (term, id, position)."""
        spark = docs.sparkSession
        src = docs.select(F.col(id_col).alias("id"), tokens(F.coalesce(F.col(text_col), F.lit("")), lower).alias("ws"))
        p = src.select("id", F.size("ws").alias("dl"), F.posexplode("ws").alias("at", "term"))
        p = p.groupBy("term", "id", "dl").agg(F.sort_array(F.collect_list("at")).alias("positions")).withColumn("tf", F.size("positions").cast("long"))
        p.repartitionByRange("term", "id").sortWithinPartitions("term", "id").select("term", "id", "tf", F.col("dl").cast("long").alias("dl"), "positions").write.mode("overwrite").parquet(f"{path}/postings")
        seen = spark.read.parquet(f"{path}/postings").groupBy("id").agg(F.first("dl").alias("dl"))
        ids = docs.select(F.col(id_col).alias("id"))
        ids.join(seen.withColumnRenamed("id", "of"), F.col("id") == F.col("of"), "left").select("id", F.coalesce("dl", F.lit(0)).cast("long").alias("dl")).write.mode("overwrite").parquet(f"{path}/lengths")
        spark.read.parquet(f"{path}/lengths").agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avg")).write.mode("overwrite").parquet(f"{path}/stats")
        return Index(spark, path, id_col, lower)

    def terms(self, min_tf: int = 1) -> DataFrame:
        """(term, df, tf): every term with its documents and occurrences."""
        return self.postings.where(F.col("tf") >= min_tf).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))

    def _allowed(self, hits: DataFrame, allowed: DataFrame | None) -> DataFrame:
        """Hits of the allowed documents, a DataFrame whose first column is the id."""
        if allowed is None:
            return hits
        ids = allowed.select(F.col(allowed.columns[0]).alias("ok"))
        return hits.join(ids, F.col("id") == F.col("ok"), "left_semi")

    def bm25(self, query: str, k: int | None = 20, allowed: DataFrame | None = None, all_terms: bool = False, preset: str | None = None, k1: float = 1.2, b: float = 0.75, digits: int = 6) -> DataFrame:
        """(id, score) as bm25() over the texts; preset: parameters by name from PRESETS."""
        k1, b = PRESETS[preset] if preset else (k1, b)
        words = [t for t in query_tokens(query, self.lower) if not all_terms or len(t.encode()) >= 2]
        times = {t: words.count(t) for t in words}
        if not times:
            return self.lengths.where(F.lit(False)).select(F.col("id").alias(self.id_col), F.lit(0.0).alias("score"))
        hits = self.postings.where(F.col("term").isin(*times)).select("term", "id", "tf", "dl")
        df = hits.groupBy("term").agg(F.count("*").alias("df")).withColumnRenamed("term", "of")  # a row for each query term
        hits = self._allowed(hits, allowed).join(F.broadcast(df), F.col("term") == F.col("of")).join(F.broadcast(self.stats))  # one row
        idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        weight = F.coalesce(*[F.when(F.col("term") == t, F.lit(float(x))) for t, x in times.items()])
        s = weight * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg")))
        out = hits.groupBy("id").agg(F.round(F.sum(s), digits).alias("score"), F.count("*").alias("found"))
        if all_terms:  # all that any document has
            out = out.join(F.broadcast(df.agg(F.count("*").alias("need")))).where("found = need")
        out = out.select(F.col("id").alias(self.id_col), "score").orderBy(F.desc("score"), self.id_col)
        return out.limit(k) if k is not None else out

    def phrase(self, query: str, k: int | None = 20, allowed: DataFrame | None = None, k1: float = 1.2, b: float = 0.75, digits: int = 6) -> DataFrame:
        """(id, tf, score) as phrase() over the texts: positions of the rarest word's documents, each word's moved to the phrase's start."""
        words = query_tokens(query, self.lower)
        hits = self.postings.where(F.col("term").isin(*words))
        df = hits.groupBy("term").agg(F.count("*").alias("df")).agg(F.min("df").alias("df"), F.count("*").alias("known"))  # one row
        shifts = F.map_from_arrays(F.array(*[F.lit(w) for w in dict.fromkeys(words)]), F.array(*[F.array(*[F.lit(i) for i, x in enumerate(words) if x == w]) for w in dict.fromkeys(words)]))
        starts = self._allowed(hits, allowed).select("id", "dl", F.explode(F.element_at(shifts, F.col("term"))).alias("shift"), "positions")
        starts = starts.select("id", "dl", F.explode("positions").alias("at"), "shift").select("id", "dl", (F.col("at") - F.col("shift")).alias("start"))
        found = starts.groupBy("id", "dl", "start").agg(F.count("*").alias("n")).where(F.col("n") == len(words))
        out = found.groupBy("id", "dl").agg(F.count("*").alias("tf")).join(F.broadcast(df.join(self.stats)))  # one row
        idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        s = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg")))
        out = out.select(F.col("id").alias(self.id_col), "tf", F.round(s, digits).alias("score")).orderBy(F.desc("score"), self.id_col)
        return out.limit(k) if k is not None else out


def over_fetch(limit: int) -> int:
    """Rows that each arm of a hybrid query fetches."""
    return max(3 * limit, 100)


def idf(n: int, df: int) -> float:
    return math.log((n - df + 0.5) / (df + 0.5) + 1)
