"""Helpers shared by the corpus operators: checkpoints, whole rows, text buffers, word hashing, connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of ASCII letters and digits and of everything outside ASCII, after A-Z are lower-cased.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


#: Bytes of rows that may be broadcast, judged from a count.
BROADCAST_BYTES = 32 << 20


def checkpoint_dir(spark: SparkSession) -> None:
    """Take the folder from spark.checkpoint.dir. Only where that is unset and all runs in one process (tests), make a local one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if at is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is unset: it has to name a folder that all machines share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="fathomdf-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it from there: computed once, and safe from lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its counted rows stay under the bound; else as it is, to be joined by a shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def written(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared checkpoint folder: cut off like cut(), but compressed and read by column; order is lost."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    at = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def named(name: str) -> Column:
    """The column of this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole(docs: DataFrame, *without: str) -> Column:
    """All columns of docs as one struct with fields f0, f1 ..., so that no name can clash with an operator's own; some of them null."""
    return F.struct(*[(F.lit(None).cast(docs.schema[c].dataType) if c in without else named(c)).alias(f"f{i}") for i, c in enumerate(docs.columns)])


def parts(docs: DataFrame, row: str = "row", **new: Column) -> list[Column]:
    """The columns of docs again, from a struct that whole() made; new: other values for some of them."""
    return [new.get(c, F.col(row)[f"f{i}"]).alias(c) for i, c in enumerate(docs.columns)]


def words_expr(text):
    """Column of the words of a text, in order; null texts have none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD), "")


def _byte_table(white: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
    b = np.arange(256)
    if white is not None:
        return ~np.isin(b, list(white)), b.astype(np.uint8)
    upper = (b >= 65) & (b <= 90)
    inside = (b >= 128) | ((b >= 48) & (b <= 57)) | ((b >= 97) & (b <= 122)) | upper
    return inside, np.where(upper, b + 32, b).astype(np.uint8)


WORD_TABLE = _byte_table()
#: White space in ASCII ends a token; case stays.
SPACE_TABLE = _byte_table(b" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f")

#: Bytes of one text that are worked on at once.
LONG_TEXT = 4 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        for key, base in (("up", _BASE), ("down", _INV)):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            _POWERS[key] = np.multiply.accumulate(a)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offsets of its rows; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    if col.null_count:
        col = col.fill_null(b"")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def pieces(off: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Row ranges of about `most` bytes each; a longer row stands alone."""
    out, at, n = [], 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        out.append((at, min(to, n)))
        at = to
    return out


def spans(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every token, and the first token's index of every row plus the total. Tokens end with their row."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    cls = inside[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    first = cls.copy()
    first[1:] &= ~cls[:-1] | edge[1:n]
    last = cls.copy()
    last[:-1] &= ~cls[1:] | edge[1:n]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(s, off)


def cuts(data: np.ndarray, inside: np.ndarray, most: int) -> list[int]:
    """Offsets that cut a long text into ranges of about `most` bytes, never inside a token; a longer token stays whole."""
    out, n = [0], len(data)
    while n - out[-1] > most:
        lo = out[-1]
        outside = np.flatnonzero(~inside[data[lo + 1 : lo + most]])
        at = lo + 1 + int(outside[-1]) if len(outside) else n
        ahead = lo + most
        while not len(outside) and ahead < n:
            found = np.flatnonzero(~inside[data[ahead : ahead + most]])
            at, ahead = (ahead + int(found[0]), n) if len(found) else (n, ahead + most)
        out.append(at)
    return [*out, n] if out[-1] < n or n == 0 else out


def span_hash(norm: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range."""
    n = len(norm)
    up, down = powers(n + 1)
    p = np.zeros(n + 1, np.uint64)
    np.cumsum((norm.astype(np.uint64) + np.uint64(1)) * up[:n], out=p[1:])
    return mix((p[e] - p[s]) * down[s] + (e - s).astype(np.uint64))


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and each row's first index plus the total."""
    inside, norm = WORD_TABLE
    if len(off) == 2 and len(data) > LONG_TEXT:  # one long text: range by range, so that memory stays bounded
        at = cuts(data, inside, LONG_TEXT)
        h = np.concatenate([word_hashes(data[i:j], np.array([0, j - i]))[0] for i, j in zip(at, at[1:], strict=False)])
        return h, np.array([0, len(h)])
    s, e, at = spans(data, off, inside)
    return span_hash(norm[data], s, e), at


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Distinct sorted hashes of the k-word shingles of one row; a row of fewer words, but not none, is one shingle."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    m = max(1, n - k + 1)
    h = np.zeros(m, np.uint64)
    for j in range(min(k, n)):
        h = h * np.uint64(_BASE) + words[j : j + m]
    return np.unique(mix(h + np.uint64(min(k, n))))


def trim() -> None:
    """Give a worker's free memory back to the system, so that it doesn't stay with idle workers."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components: (node, component) with component the least node reached; nodes are bigint.

    Alternates large-star and small-star steps, each a join by node with the minimum pre-aggregated, until no edge
    changes; every round is checkpointed. The minima are broadcast while the counted edges bound them, so that a hub's edges
    stay where they are; beyond the bound they are joined by a shuffle. A node of any degree only ever sends its neighbours through a join, so no task
    gathers a group. Self-edges keep lone nodes. Empty in, empty out. Null ends are dropped.
    """
    raw = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null")
    raw = cut(raw.distinct())
    nodes = raw.select("u").union(raw.select("v")).distinct()
    e = raw.where("u != v")
    before, n = None, e.count()
    while n:
        fits = (lambda df: F.broadcast(df)) if 2 * n * 32 <= BROADCAST_BYTES else (lambda df: df)
        # large star: every neighbour larger than u moves to the least of u and its neighbours
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = fits(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")))
        large = cut(both.join(low, both.u == low.k).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: u and its smaller neighbours move to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        j = large.join(fits(low), large.u == F.col("k"))
        least = j.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()
        e = cut(least)
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before, n = state, state[0]
    least = e.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
    least = F.broadcast(least) if n * 32 <= BROADCAST_BYTES else least
    return nodes.join(least, nodes.u == F.col("k"), "left").select(F.col("u").alias("node"), F.coalesce("m", "u").alias("component"))
