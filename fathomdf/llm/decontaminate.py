"""Benchmark decontamination by a prefix-filtered set join (operator 4), in DataFrame functions only.

A benchmark item is cut into windows of 10 consecutive words; an item of fewer words, but not none, is one window. A
document word inside any occurrence of a window is hit. A window occurs only where all its tokens occur, so one token is a
sufficient prefix: the tokens of each window are ordered by rarity over all documents and the rarest is joined with the
document's words. A match fixes where the window would lie; it must begin in the document (positional bound) and end in it
(length bound), and is then compared word by word. Nothing but true occurrences leaves that stage.

Scale: documents are read twice and never shuffled. Words are exploded and joined inside one code-generated stage with
the windows, which are broadcast in blocks: their size is measured first, and beyond BLOCK_BYTES they are dealt into as
many blocks as needed, each joined with all documents. Only a row per document and per occurrence is shuffled, with
distinct spans collected per document.

Defined results: null or empty texts have no words and no hits; items of no words have no windows; equal windows of
several items count for each; repeated documents are each reported; rows of equal id but other text are told apart by a
hash of the text. Of words equally rare in a window the first is joined. A very long text is one array of words in one row, never cut. Other
columns may have any names. An empty benchmark hits nothing; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, named, words_expr

#: Bytes of windows that are broadcast at once.
BLOCK_BYTES = 32 << 20


def item_windows(benchmark: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(words, items): the distinct windows, and the ids, as strings, of the items that have them."""
    w = benchmark.select(named(id_col).cast("string").alias("item"), words_expr(named(text_col)).alias("ws")).where(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - F.lit(width - 1), F.lit(1)))
    w = w.select("item", "ws", F.explode(starts).alias("i")).select("item", F.slice("ws", F.col("i"), width).alias("words"))
    return w.groupBy("words").agg(F.collect_set("item").alias("items"))


def blocks(df: DataFrame, bytes_each: int, key: str) -> list[DataFrame]:
    """df in parts of about bytes_each, by a hash of key; one part if it is small."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    n = max(1, -(-size // bytes_each))
    return [df.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)] if n > 1 else [df]


def occurrences(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, text_key, n_words, start, stop, items): an occurrence each, and a row of null start for every document."""
    d = docs.select(named(id_col).alias("doc_id"), F.xxhash64(F.coalesce(named(text_col), F.lit(""))).alias("text_key"), words_expr(named(text_col)).alias("ws"))
    words = d.select(F.explode("ws").alias("word")).select(F.xxhash64("word").alias("k"))
    tokens = cut(windows.select(F.explode("words").alias("word")).distinct().select(F.xxhash64("word").alias("token")).distinct())
    parts = blocks(tokens, block_bytes, "token")
    counts = reduce(DataFrame.unionAll, [words.join(F.broadcast(t), words["k"] == t["token"]).groupBy("token").agg(F.count("*").alias("freq")) for t in parts])
    at = windows.select("words", "items", F.posexplode("words").alias("pos", "word")).select("words", "items", "pos", F.xxhash64("word").alias("t"))
    rare = at.join(counts, at["t"] == counts["token"]).groupBy("words").agg(F.first("items").alias("items"), F.count("*").alias("found"), F.min(F.struct("freq", "pos", "t")).alias("r"))
    rare = cut(rare.where(F.col("found") == F.size("words")).select("words", "items", F.col("r.t").alias("token"), F.col("r.pos").alias("at")))  # a window with a token that no document has can't occur
    # position 0 holds a token that no text has, so that each document passes the join once
    ex = d.select("doc_id", "text_key", "ws", F.posexplode(F.concat(F.array(F.lit("")), F.col("ws"))).alias("p", "word")).select("doc_id", "text_key", "ws", "p", F.when(F.col("p") > 0, F.xxhash64("word")).otherwise(F.lit(0)).alias("k"))
    start = F.col("p") - F.col("at")
    out = []
    for i, part in enumerate(blocks(rare, block_bytes, "token")):
        mark = part.sparkSession.range(1).select(F.array().cast("array<string>").alias("words"), F.array().cast("array<string>").alias("items"), F.lit(0).cast("long").alias("token"), F.lit(-1).alias("at"))
        part = part.unionByName(mark) if i == 0 else part
        hit = ex.join(F.broadcast(part), ex["k"] == part["token"])
        n = F.size("words")
        true = (F.col("p") > 0) & (F.col("at") >= 0) & (start >= 1) & (start + n - 1 <= F.size("ws")) & (F.slice("ws", F.when(start >= 1, start).otherwise(1), n) == F.col("words"))
        hit = hit.where(true | ((F.col("p") == 0) & (F.col("at") == -1)))
        out.append(hit.select("doc_id", "text_key", F.size("ws").alias("n_words"), F.when(F.col("p") > 0, start).alias("start"), (start + n).alias("stop"), "items"))
    return reduce(DataFrame.unionAll, out)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, text_key, n_words, n_hit, spans (start, stop of each occurrence, 1-based), items, contaminated."""
    occ = occurrences(docs, cut(item_windows(benchmark, item_col, item_text, width)), id_col, text_col, block_bytes)
    g = occ.groupBy("doc_id", "text_key", "n_words").agg(
        F.count(F.when(F.col("start").isNull(), 1)).alias("rows"),
        F.sort_array(F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "stop")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    zero = F.struct(F.lit(0).alias("stop"), F.lit(0).alias("n"))
    covered = F.aggregate("spans", zero, lambda a, x: F.struct(F.greatest(a["stop"], x["stop"]).alias("stop"), (a["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(a["stop"], x["start"]))).alias("n")))["n"]
    g = g.withColumn("n_hit", covered.cast("long")).withColumn("contaminated", F.size("spans") > 0)
    return g.select("doc_id", "text_key", F.col("n_words").cast("long").alias("n_words"), "n_hit", "spans", "items", "contaminated", F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))).alias("__r")).drop("__r")
