"""Exact substring removal over a collection of documents by column-wise suffix sorting (operator 2).

A byte is removed if some string of WIDTH bytes that covers it also starts earlier: in a document of smaller id, or in the
same document further left. Strings never cross documents, and are judged on the input.

Routing. The collection is cut into sub-collections that can be sorted apart: a window of WIDTH bytes belongs to its
minimizer, the GRAM-byte string in it of least hash (the leftmost, if equal). Equal windows have equal minimizers at the same place, so
they meet. Consecutive windows with one minimizer occurrence form a segment, which is what is shuffled, packed by bucket
and compressed. Frequent grams, counted over all documents, hash above all others, so a window that has any
other gram is routed by that: a common line brings together only the windows that lie in it, which are equal. Which grams
count as frequent changes routes, never results. Their counts are shuffled packed, by ranges of hashes.

Construction. In a sub-collection the segments are aligned at their minimizer and built up column by column from the
right: each round inserts one symbol per segment, read from a sequential column file, and updates the order of all
current suffixes (the new order is the stable sort of the old by the inserted symbol, as in a Burrows-Wheeler transform of
the collection) and the common prefix of neighbours (one more than the least of those between them, or none). Where neighbours
share WIDTH bytes their windows are equal, and all but the first by (doc_id, start) are removed. The column file and the orders
of a lot belong to one task and are gone when it ends; a lost executor's lots are done again.

Scale: equal segments are folded before the shuffle, in each map block, and again after it, so copies of any number cost a
row per block; whether segments of one hash are equal is seen from their bytes. A sub-collection of over LOT segments is split:
its windows by how far the minimizer lies from their start, in halves, and each half by the bytes that all its windows share
around the minimizer, until lots are small or windows are wholly alike. Segments whose minimizer occurs once are dropped on arrival. Buckets grow in number with the shuffle
partitions and are processed one at a time; a bucket is sorted in lots, whose columns lie in a temporary file when large.
Texts are shuffled once, to meet their spans.

Defined results: a null text is empty; null ids come last in order; two rows of equal id are not earlier than each other at
equal starts, so repeated rows keep the same bytes; texts shorter than WIDTH lose nothing; a very long text is cut into ranges of
BLOCK windows for routing, which changes nothing; other columns may have any names and travel in one struct; an empty table
gives no rows.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomdf.session import ship

from .common import buffers, mix, named, pieces, small, span_hash, trim, whole

WIDTH, GRAM = 100, 16
LAST = (1 << 63) - 1
BLOCK, FLUSH, LOT = 1 << 19, 10 << 20, 60_000
#: Rows that are returned at once.
ROWS = 500
#: The share of all documents from which a gram is frequent, and the grams whose counts a task holds.
FREQUENT, COUNTED = 0.001, 1 << 20


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the GRAM bytes from each position on."""
    n = len(data) - GRAM + 1
    a = np.ndarray((n + 8,), np.uint64, np.ascontiguousarray(data), strides=(1,)).copy() if n > 0 else np.zeros(0, np.uint64)
    if n <= 0:
        return np.zeros(0, np.uint32)
    return _hash(a[:n], a[8:])


def _hash(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    h = low * np.uint64(0x9E3779B97F4A7C15) ^ (high * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(7))
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    return (h >> np.uint64(32)).astype(np.uint32)


def grams_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The same hashes at some positions only."""
    two = data[at[:, None] + np.arange(GRAM)].view(np.uint64)
    return _hash(two[:, 0], two[:, 1])


def is_frequent(h: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Positions of hashes in a sorted array."""
    if not len(frequent):
        return np.zeros(0, np.int64)
    seen = np.zeros(1 << 16, bool)
    seen[frequent >> 16] = True
    at = np.flatnonzero(seen[h >> 16])
    k = np.minimum(np.searchsorted(frequent, h[at]), len(frequent) - 1)
    return at[frequent[k] == h[at]]


def minimizers(data: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed (rank, position) of the minimizer of every window, and the gram hashes."""
    w = WIDTH - GRAM + 1
    raw = gram_hashes(data)
    rank = raw >> np.uint32(1)
    rank[is_frequent(raw, frequent)] |= np.uint32(1 << 31)
    n = len(data) - WIDTH + 1
    packed = np.full(-(-(n + w) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    packed[: len(rank)] = (rank.astype(np.uint64) << np.uint64(32)) | np.arange(len(rank), dtype=np.uint64)
    block = packed.reshape(-1, w)
    ahead = np.minimum.accumulate(block, 1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n]), raw


class Segments:
    """Runs of windows with one minimizer occurrence: fp, first byte, windows, and where the minimizer lies in the first window."""

    def __init__(self, data: np.ndarray, off: np.ndarray, frequent: np.ndarray):
        n = len(data) - WIDTH + 1
        self.row = self.start = self.windows = self.lean = np.zeros(0, np.int64)
        self.fp = np.zeros(0, np.uint32)
        if n <= 0:
            return
        low, raw = minimizers(data, frequent)
        edge = np.zeros(n + 1, np.int32)
        long = np.flatnonzero(np.diff(off) >= WIDTH)
        np.add.at(edge, off[long], 1)
        np.add.at(edge, off[long + 1] - WIDTH + 1, -1)
        valid = np.cumsum(edge[:n]) > 0
        new = valid.copy()
        new[1:] &= (low[1:] != low[:-1]) | ~valid[:-1]
        new[off[long]] = True
        self.start = np.flatnonzero(new)
        stop = np.append(self.start[1:], n)
        total = np.concatenate([[0], np.cumsum(valid)])
        self.windows = total[stop] - total[self.start]
        pos = (low[self.start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.lean = pos - self.start
        self.fp = raw[pos]
        self.row = np.searchsorted(off, self.start, "right") - 1


def ranges(off: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(first row, last + 1, first byte, last + 1, shift): blocks of whole rows, and a long row in overlapping ranges of BLOCK windows."""
    for i, j in pieces(off, BLOCK):
        lo, hi = int(off[i]), int(off[j])
        if j - i > 1 or hi - lo <= 2 * BLOCK:
            yield i, j, lo, hi, 0
            continue
        for k in range(0, hi - lo - WIDTH + 1, BLOCK):
            yield i, j, lo + k, min(lo + k + BLOCK + WIDTH - 1, hi), k


def offsets(off: np.ndarray, i: int, j: int, lo: int, hi: int) -> np.ndarray:
    """Offsets of the rows of a range within it."""
    return off[i : j + 1] - lo if hi - lo == off[j] - off[i] else np.array([0, hi - lo])


def earliest(key: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least (doc, start) of each key, and those rows of it that are strictly later."""
    order = np.lexsort((start, doc, key))
    k, d, s = key[order], doc[order], start[order]
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    head = np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))
    later = (d != d[head]) | (s != s[head])
    return order[first], order[later]


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of many ranges, one after another."""
    base = np.cumsum(size) - size
    return data[np.repeat(start - base, size) + np.arange(int(size.sum()))]


def folded(name: np.ndarray, doc: np.ndarray, start: np.ndarray, data: np.ndarray, base: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of byte ranges with 64-bit names: one row, the earliest, of each set of equal ranges, and those equal to it that are strictly later.

    Ranges of one name with other bytes stand for themselves.
    """
    order = np.lexsort((start, doc, name))
    k = name[order]
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    head = order[np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))]
    again = np.flatnonzero(~first)
    same = np.zeros(len(k), bool)
    for lo in range(0, len(again), 1 << 15):
        at = again[lo : lo + (1 << 15)]
        a, b = order[at], head[at]
        fits = size[a] == size[b]
        at, a, b = at[fits], a[fits], b[fits]
        if len(a):
            other = gather(data, base[a], size[a]) != gather(data, base[b], size[b])
            same[at] = np.add.reduceat(other, np.cumsum(size[a]) - size[a]) == 0
    later = same & ((doc[order] != doc[head]) | (start[order] != start[head]))
    return order[~same], order[later]


META = (("doc", "<i8"), ("key", "<i8"), ("start", "<i4"), ("lean", "u1"), ("windows", "u1"))
COUNTS = (("key", "<i8"), ("n", "<i8"))


def pack_meta(meta: dict[str, np.ndarray], columns: tuple[tuple[str, str], ...] = META) -> bytes:
    """Columns one after another, documents and keys as differences, the bytes of like weight together: so they compress."""
    out = []
    for name, kind in columns:
        v = meta[name].astype(kind)
        v = np.diff(v, prepend=v.dtype.type(0)) if name in ("doc", "key") else v
        out.append(v.view(np.uint8).reshape(len(v), -1).T.tobytes())
    return b"".join(out)


def unpack_meta(raw: bytes, n: int, columns: tuple[tuple[str, str], ...] = META) -> tuple[dict[str, np.ndarray], int]:
    """The columns, and the bytes they took."""
    out, at = {}, 0
    for name, kind in columns:
        size = np.dtype(kind).itemsize
        v = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel()
        out[name] = np.cumsum(v) if name in ("doc", "key") else v
        at += n * size
    return out, at


def merge_runs(doc: np.ndarray, key: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of each (doc, key) in order, joined where they touch or overlap."""
    if not len(doc):
        return doc, key, start, stop
    order = np.lexsort((start, key, doc))
    doc, key, start, stop = doc[order], key[order], start[order], stop[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    group, most = np.cumsum(new) - 1, int(stop.max()) + 1
    if (int(group[-1]) + 1) * most >= 1 << 62:  # in two parts, so that the sums below fit
        half = int(np.searchsorted(group, group[-1] // 2 + 1))
        two = [merge_runs(*(x[a:b] for x in (doc, key, start, stop))) for a, b in ((0, half), (half, len(doc)))]
        return tuple(np.concatenate(c) for c in zip(*two, strict=True))
    far = np.maximum.accumulate(stop + group * most) - group * most
    new[1:] |= start[1:] > far[:-1]
    at = np.flatnonzero(new)
    return doc[at], key[at], start[at], np.maximum.reduceat(stop, at)


def equal_windows(fp: np.ndarray, data: np.ndarray, base: np.ndarray, lean: np.ndarray, windows: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Column-wise construction over segments of shared minimizers: (segment, window) of every window that also starts earlier.

    State: `order`, the segments that have begun, sorted by fp and current suffix, and `lcp`, the bytes that each shares
    with the one before it.
    """
    m, mid = len(fp), WIDTH - GRAM
    columns = mid + WIDTH
    left = mid - lean
    right = left + windows - 1 + WIDTH
    group = np.unique(fp, return_inverse=True)[1].astype(np.int64)
    with tempfile.SpooledTemporaryFile(max_size=32 << 20) as file:
        for c in range(columns - 1, -1, -1):  # the column file, in the order in which it is read
            at = np.where((left <= c) & (c < right), base + c - left, 0)
            file.write(data[at].tobytes())
        file.seek(0)
        order, lcp = np.zeros(0, np.int64), np.zeros(0, np.int16)
        ends = np.argsort(right, kind="stable")
        bound = np.searchsorted(right[ends], np.arange(columns + 2))
        out_seg, out_win = [], []
        for c in range(columns - 1, -1, -1):
            symbol = np.frombuffer(file.read(m), np.uint8)
            gone = left[order] > c
            if gone.any():  # the bytes shared across a segment that leaves are the least of both gaps
                stay = np.flatnonzero(~gone)
                lcp = np.minimum.reduceat(lcp[: stay[-1] + 1], np.concatenate([[0], stay[:-1] + 1])) if len(stay) else lcp[:0]
                order = order[stay]
            fresh = ends[bound[c + 1] : bound[c + 2]]  # right end is c + 1: they begin here, as empty suffixes
            if len(fresh):
                both = np.concatenate([fresh, order])
                to = np.argsort(group[both], kind="stable")
                lcp = np.concatenate([np.zeros(len(fresh), np.int16), lcp])[to]
                order = both[to]
                after_new = np.flatnonzero(to < len(fresh)) + 1
                lcp[after_new[after_new < len(lcp)]] = 0
            if not len(order):
                continue
            key = group[order] * 256 + symbol[order]
            to = np.argsort(key, kind="stable")
            k = key[to]
            same = np.flatnonzero(k[1:] == k[:-1]) + 1
            new = np.zeros(len(order), np.int16)
            if len(same):
                pairs = np.empty(2 * len(same), np.int64)
                pairs[::2], pairs[1::2] = to[same - 1] + 1, to[same] + 1
                new[same] = np.minimum.reduceat(np.append(lcp, np.int16(0)), pairs)[::2] + 1
            order, lcp = order[to], new
            if c <= mid:
                equal = lcp >= WIDTH
                if equal.any():
                    run = np.cumsum(~equal)
                    in_run = equal.copy()
                    in_run[:-1] |= equal[1:]
                    at = np.flatnonzero(in_run)
                    seg = order[at]
                    win = c - left[seg]
                    _, later = earliest(run[at], doc[seg], start[seg] + win)
                    out_seg.append(seg[later])
                    out_win.append(win[later])
    empty = np.zeros(0, np.int64)
    return (np.concatenate(out_seg), np.concatenate(out_win)) if out_seg else (empty, empty)


class Parts:
    """Segments by sub-collection: group, row, first byte, start in the text, distance of the minimizer, windows; distances lie in low..high."""

    def __init__(self, group: np.ndarray, row: np.ndarray, base: np.ndarray, start: np.ndarray, lean: np.ndarray, windows: np.ndarray, low: int, high: int):
        order = np.argsort(group, kind="stable")
        _, inv, count = np.unique(group, return_inverse=True, return_counts=True)
        order = order[count[inv[order]] > 1]
        self.group, self.row, self.base, self.start, self.lean, self.windows = (x[order] for x in (group, row, base, start, lean, windows))
        self.low, self.high, self.count = low, high, count[inv[order]]

    def take(self, at: np.ndarray) -> tuple[np.ndarray, ...]:
        return self.group[at], self.row[at], self.base[at], self.start[at], self.lean[at], self.windows[at]

    def half(self, at: np.ndarray, low: int, high: int, data: np.ndarray) -> Parts:
        """The windows of some segments whose distance lies in low..high, grouped by the bytes that all such windows share."""
        group, row, base, start, lean, windows = self.take(at)
        near, far = np.maximum(lean - windows + 1, low), np.minimum(lean, high)
        have = near <= far
        group, row, base, start, lean, near, far = (x[have] for x in (group, row, base, start, lean, near, far))
        pos, skip = base + lean, lean - far
        lo, hi = pos - low, pos + WIDTH - high
        key = np.zeros(len(pos), np.uint64)
        for i in range(0, len(pos), 1 << 15):
            a, b = lo[i : i + (1 << 15)], hi[i : i + (1 << 15)]
            size = b - a
            flat, at_ = gather(data, a, size), np.cumsum(size) - size
            key[i : i + (1 << 15)] = span_hash(flat, at_, at_ + size)
        return Parts(mix(key + group * np.uint64(0x9E3779B97F4A7C15)), row, base + skip, start + skip, far, far - near + 1, low, high)


def solve_parts(parts: Parts, data: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, start of the window in its text) of every window that also starts earlier, in lots of at most LOT segments."""
    todo = [parts]
    while todo:
        p = todo.pop()
        if p.low == p.high:  # one window a segment: equal ones are found at once
            size = np.full(len(p.row), WIDTH)
            _, later = folded(p.group, doc[p.row], p.start, data, p.base, size)
            yield p.row[later], p.start[later]
            continue
        big = np.flatnonzero(p.count > LOT)
        if len(big):
            mid = (p.low + p.high) // 2
            todo += [p.half(big, p.low, mid, data), p.half(big, mid + 1, p.high, data)]
        group, row, base, start, lean, windows = p.take(np.flatnonzero(p.count <= LOT))
        lo = 0
        while lo < len(row):  # lots of whole sub-collections
            hi = min(lo + LOT, len(row))
            if hi < len(row):
                hi = max(int(np.searchsorted(group, group[hi], "left")), lo) if group[hi] != group[lo] else int(np.searchsorted(group, group[lo], "right"))
            seg, win = equal_windows(group[lo:hi], data, base[lo:hi], lean[lo:hi], windows[lo:hi], doc[row[lo:hi]], start[lo:hi])
            yield row[lo:hi][seg], start[lo:hi][seg] + win
            lo = hi


def solve_bucket(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """Spans (doc, key, start, stop) to be removed, from one bucket's segments."""
    metas, datas = [], []
    unpack = zstandard.ZstdDecompressor()
    for b in blobs:
        raw = unpack.decompress(b)
        n = int.from_bytes(raw[:4], "little")
        meta, size = unpack_meta(raw[4:], n)
        metas.append(meta)
        datas.append(np.frombuffer(raw, np.uint8, -1, 4 + size))
    meta, data = {k: np.concatenate([m[k] for m in metas]) for k, _ in META}, np.concatenate(datas)
    del metas, datas
    size = meta["windows"].astype(np.int64) + WIDTH - 1
    base = np.cumsum(size) - size
    meta["fp"] = grams_at(data, base + meta["lean"])
    _, inv, count = np.unique(meta["fp"], return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[inv] > 1)
    meta, base, size = {k: v[at] for k, v in meta.items()}, base[at], size[at]
    doc, key, start = meta["doc"], meta["key"], meta["start"].astype(np.int64)
    spans = [tuple(np.zeros(0, np.int64) for _ in range(4))]
    if len(base):
        flat = gather(data, base, size)
        data, base = flat, np.cumsum(size) - size
        name = mix(span_hash(data, base, base + size) + meta["fp"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + meta["lean"].astype(np.uint64))
        rep, later = folded(name, doc, start, data, base, size)
        spans.append((doc[later], key[later], start[later], start[later] + size[later]))
        parts = Parts(meta["fp"][rep].astype(np.uint64), rep, base[rep], start[rep], meta["lean"][rep].astype(np.int64), meta["windows"][rep].astype(np.int64), 0, WIDTH - GRAM)
        for rows, at in solve_parts(parts, data, doc):
            spans.append((doc[rows], key[rows], at, at + WIDTH))
    return merge_runs(*(np.concatenate(c) for c in zip(*spans, strict=True)))


def tally(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of many counts, in order, and the sums of their counts."""
    value, inv = np.unique(np.concatenate([v for v, _ in counts]), return_inverse=True)
    n = np.zeros(len(value), np.int64)
    np.add.at(n, inv, np.concatenate([c for _, c in counts]))
    return value, n


def frequent_grams(docs: DataFrame, text: str, buckets: int) -> np.ndarray:
    """Hashes of the minimizers that at least FREQUENT of all documents have, and 20 of them; each range of a long text counts as one."""
    least = max(20, int(FREQUENT * docs.count()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        pack = zstandard.ZstdCompressor(level=3)

        def flush() -> Iterator[pa.RecordBatch]:
            fp, n = tally(held)
            held.clear()
            bucket = fp * buckets >> 32
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            blobs = [pack.compress((y - x).to_bytes(4, "little") + pack_meta({"key": fp[x:y], "n": n[x:y]}, COUNTS)) for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(fp)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts], pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        for b in batches:
            data, off = buffers(b.column(0))
            for i, j, lo, hi, _ in ranges(off):
                s = Segments(data[lo:hi], offsets(off, i, j, lo, hi), np.zeros(0, np.uint32))
                if not len(s.fp):
                    continue
                each = np.unique(s.fp.astype(np.uint64) << np.uint64(32) | s.row.astype(np.uint64)) >> np.uint64(32)
                held.append(np.unique(each.astype(np.int64), return_counts=True))
                size += len(held[-1][0])
                if size >= COUNTED:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()
        trim()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, counts = None, []
        unpack = zstandard.ZstdDecompressor()

        def rows() -> pa.RecordBatch:
            fp, n = tally(counts)
            return pa.RecordBatch.from_arrays([pa.array(fp[n >= least])], names=["fp"])

        for b in batches:
            for k, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if k != last and counts:
                    yield rows()
                    counts = []
                last = k
                raw = unpack.decompress(blob.as_py())
                got, _ = unpack_meta(raw[4:], int.from_bytes(raw[:4], "little"), COUNTS)
                counts.append((got["key"], got["n"]))
        if counts:
            yield rows()
        trim()

    counted = docs.select(text).mapInArrow(count, "bucket bigint, blob binary").repartition(-(-buckets // 8), "bucket").sortWithinPartitions("bucket")
    return np.sort(counted.mapInArrow(add_up, "fp bigint").toArrow()["fp"].to_numpy().astype(np.uint32))


def repeated_spans(docs: DataFrame, buckets: int) -> DataFrame:
    """docs: (did, text_key, text) -> (did, text_key, start, stop), joined within each bucket and block."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_grams(docs, "text", buckets))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[dict, bytes]]] = {}
        sure: list[tuple[np.ndarray, ...]] = []
        size = 0
        pack = zstandard.ZstdCompressor(level=3)

        def flush() -> Iterator[pa.RecordBatch]:
            ks, blobs = [], []
            for k, parts in held.items():
                meta = {c: np.concatenate([m[c] for m, _ in parts]) for c, _ in META}
                ks.append(k)
                blobs.append(pack.compress(len(meta["doc"]).to_bytes(4, "little") + pack_meta(meta) + b"".join(d for _, d in parts)))
            held.clear()
            if sure:
                spans = np.stack(merge_runs(*(np.concatenate(c) for c in zip(*sure, strict=True))), 1)
                sure.clear()
                ks.append(-1 - int(np.random.default_rng(len(spans)).integers(buckets)))
                blobs.append(zstandard.ZstdCompressor(level=3).compress(spans.astype("<i8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        for b in batches:
            ids, keys = b.column(0).to_numpy(), b.column(1).to_numpy()
            data, off = buffers(b.column(2))
            for i, j, lo, hi, shift in ranges(off):
                d, o = data[lo:hi], offsets(off, i, j, lo, hi)
                s = Segments(d, o, frequent.value)
                size += len(d)
                if len(s.start):
                    doc, key, start = ids[i:j][s.row], keys[i:j][s.row], s.start - o[s.row] + shift
                    length = s.windows + WIDTH - 1
                    name = mix(span_hash(d, s.start, s.start + length) + s.fp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + s.lean.astype(np.uint64))
                    rep, later = folded(name, doc, start, d, s.start, length)
                    sure.append((doc[later], key[later], start[later], start[later] + length[later]))
                    bucket = s.fp[rep].astype(np.int64) % buckets
                    order = np.argsort(bucket, kind="stable")
                    rep, bucket = rep[order], bucket[order]
                    meta = {c: v[rep] for c, v in (("doc", doc), ("key", key), ("start", start), ("lean", s.lean), ("windows", s.windows))}
                    text = gather(d, s.start[rep], length[rep]).tobytes()
                    ends = np.concatenate([[0], np.cumsum(length[rep])])
                    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                    for x, y in zip(cuts, [*cuts[1:], len(rep)], strict=True):
                        held.setdefault(int(bucket[x]), []).append(({c: v[x:y].copy() for c, v in meta.items()}, text[ends[x] : ends[y]]))
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        yield from flush()
        trim()

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(doc, key, start, stop) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (doc, key, start, stop)], names=["did", "text_key", "start", "stop"])

        last, blobs = None, []
        for b in batches:
            for i in range(b.num_rows):
                k, blob = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                if k < 0:
                    yield rows(*np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "<i8").reshape(-1, 4).T)
                    continue
                if k != last and blobs:
                    yield rows(*solve_bucket(blobs))
                    blobs = []
                last = k
                blobs.append(blob)
        if blobs:
            yield rows(*solve_bucket(blobs))
        trim()

    packed = docs.select("did", "text_key", "text").mapInArrow(cut_up, "bucket bigint, blob binary")
    return packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(solve, "did bigint, text_key bigint, start bigint, stop bigint")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None, as_text: bool = False, carry: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, spans (start, stop: the maximal removed runs) and kept (the other bytes).

    as_text: kept is a string; a character that a span cuts in two goes whole. carry: also `row`, all columns but the text, as
    common.whole() packs them.
    """
    ship(docs.sparkSession)
    n = buckets or 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    did = F.coalesce(named(id_col).cast("long"), F.lit(LAST))
    again = small(docs.select(did.alias("did")).groupBy("did").count().where("count > 1").select(F.col("did").alias("again")), 16)  # ids of several rows: these are told apart by a hash of the text
    head = [named(id_col).alias("doc_id")] + ([whole(docs, text_col).alias("row")] if carry else [])
    src = docs.select(*head, did.alias("did"), F.encode(F.coalesce(named(text_col), F.lit("")), "UTF-8").alias("text"))
    src = src.join(again, F.col("did") == F.col("again"), "left").withColumn("text_key", F.when(F.col("again").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("text"))).drop("again")
    spans = repeated_spans(src.select("did", "text_key", "text"), n)
    spans = spans.groupBy("did", "text_key").agg(F.collect_list(F.struct("start", "stop")).alias("found")).select(F.col("did").alias("d"), F.col("text_key").alias("k"), F.col("found.start").alias("starts"), F.col("found.stop").alias("stops"))
    src = src.select(*[c for c in src.columns if c != "text"], "text")
    schema = T.StructType(src.schema.fields)

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=6)
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                x = b.slice(lo, ROWS)
                yield pa.RecordBatch.from_arrays([*x.columns[:-1], pa.array([pack.compress(t) for t in x.column(x.num_columns - 1).to_pylist()], pa.binary())], names=x.schema.names)

    src = src.mapInArrow(squeeze, schema)
    both = src.join(spans, (F.col("did") == F.col("d")) & (F.col("text_key") == F.col("k")), "left").select(*[c for c in src.columns if c not in ("did", "text_key", "text")], "text", "starts", "stops")
    fields = both.schema.fields[:-3]
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    result = T.StructType([*fields, T.StructField("n_bytes", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.StringType() if as_text else T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in (x.slice(lo, ROWS) for x in batches for lo in range(0, x.num_rows, ROWS)):
            texts, starts, stops = b.column(len(fields)), b.column(len(fields) + 1), b.column(len(fields) + 2)
            size, spans, kept = [], [], []
            for i in range(b.num_rows):
                raw = unpack.decompress(texts[i].as_py())
                size.append(len(raw))
                s = starts[i].as_py()
                if not s:
                    spans.append([])
                    kept.append(raw)
                    continue
                z = np.zeros(len(s), np.int64)
                _, _, x, y = merge_runs(z, z, np.array(s), np.array(stops[i].as_py()))
                spans.append([{"start": int(p), "stop": int(q)} for p, q in zip(x, y, strict=True)])
                kept.append(b"".join(raw[p:q] for p, q in zip([0, *y], [*x, len(raw)], strict=True)))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(fields)], pa.array(size, pa.int64()), pa.array(spans, kind), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())], names=[*[f.name for f in fields], "n_bytes", "spans", "kept"])

    return both.mapInArrow(run, result)
