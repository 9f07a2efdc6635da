"""Language identification by segmentation-marginalised unigrams (operator 1).

A language is a probability for every piece of a fixed public vocabulary. A word's probability is the sum over all its
segmentations into pieces, by the forward algorithm; a text's is the product over its words, a word being a run of
lower-cased letters with a word-begin mark; a run of more than LONG bytes, as in scripts without spaces, is cut at the next
character after every LONG bytes into words without the mark, so that all of it is learned from and scored. The piece probabilities are learned by expectation maximisation: in each round every
word's segmentations share the word's count by their probability, over all training texts.

Scale: every round is one map over the training texts whose tasks return summed piece counts, at most languages x pieces
rows each; the model on the driver has that fixed size whatever the corpus. Scoring is one map without a shuffle. Words are
scored once per distinct word and block of text, with all words of a length at a time.

Defined results: a text that is null or has no letter is `und` with score 0; so is every text if nothing can be learned.
Ties go to the first language in code-point order. A very long text is read in ranges of BLOCK bytes cut between words, and its sums
are added. Rows of null language are never learned from. Repeated rows are each scored; other columns may have any names; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomdf.session import ship

from .common import buffers, cuts, mix, named, pieces, powers, span_hash, spans, whole

LONG = 40
BLOCK = 1 << 20
#: Words looked up at once; distinct words kept before training sums are made; bytes of text scored together.
LOT, BAG, LOAD = 40_000, 1_000_000, 20 << 20
MARK = 32  # the byte before a word

_B = np.arange(256)
#: Letters and all bytes of characters outside ASCII; everything else ends a word.
INSIDE = ((_B >= 65) & (_B <= 90)) | ((_B >= 97) & (_B <= 122)) | (_B >= 128)
#: Lower case of the ASCII letters.
LOWER = np.where((_B >= 65) & (_B <= 90), _B + 32, _B).astype(np.uint8)


def read_pieces(path: str) -> list[bytes]:
    """The vocabulary as bytes, the word-begin mark a space, with every single byte, so that any word has a segmentation."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = [sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return sorted({*out, *(bytes([b]) for b in range(256))})


class Lattice:
    """Looks up all substrings of many words in the vocabulary."""

    def __init__(self, vocab: list[bytes]):
        self.size, self.longest = len(vocab), max(map(len, vocab))
        data = np.frombuffer(b"".join(vocab), np.uint8)
        end = np.cumsum([len(p) for p in vocab])
        h = span_hash(data, end - [len(p) for p in vocab], end)
        self.order = np.argsort(h)
        self.keys = h[self.order]
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(h >> np.uint64(42)).astype(np.int64)] = True
        self.lengths = sorted({len(p) for p in vocab})

    def ids(self, flat: np.ndarray, left: np.ndarray) -> dict[int, np.ndarray]:
        """For each piece length the piece that begins at each byte, or `size`; left: bytes up to the word's end."""
        n = len(flat)
        up, down = powers(n + 1)
        p = np.zeros(n + 1, np.uint64)
        np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[:n], out=p[1:])
        out = {}
        for size in self.lengths:
            at = np.flatnonzero(left >= size)
            if not len(at):
                break
            h = mix((p[at + size] - p[at]) * down[at] + np.uint64(size))
            maybe = np.flatnonzero(self.seen[(h >> np.uint64(42)).astype(np.int64)])
            at, h = at[maybe], h[maybe]
            k = np.minimum(np.searchsorted(self.keys, h), self.size - 1)
            good = self.keys[k] == h
            ids = np.full(n, self.size, np.int32)
            ids[at[good]] = self.order[k[good]]
            out[size] = ids
        return out


class Words:
    """Distinct words with the mark before each: bytes, where each begins, its length, tag (a language's number) and count."""

    def __init__(self, key: np.ndarray, flat: np.ndarray, size: np.ndarray, tag: np.ndarray, count: np.ndarray):
        self.key, self.flat, self.size, self.tag, self.count = key, flat, size, tag, count
        self.base = np.cumsum(size) - size

    def look_up(self, lattice: Lattice) -> None:
        word = np.repeat(np.arange(len(self.size)), self.size)
        self.ids = lattice.ids(self.flat, self.base[word] + self.size[word] - np.arange(len(word)))
        self.longest = lattice.longest

    def take(self, at: np.ndarray) -> Words:
        size = self.size[at]
        base = np.cumsum(size) - size
        flat = self.flat[np.repeat(self.base[at] - base, size) + np.arange(int(size.sum()))]
        return Words(self.key[at], flat, size, self.tag[at], self.count[at])

    def lots(self, words: int = LOT) -> Iterator[tuple[int, int, Words]]:
        for lo in range(0, len(self.size), words):
            hi = min(lo + words, len(self.size))
            yield lo, hi, self.take(np.arange(lo, hi))


def blocks(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last + 1, bytes, offsets): blocks of whole rows, and a long row in several ranges of whole words."""
    for i, j in pieces(off, BLOCK):
        o = off[i : j + 1]
        d = data[o[0] : o[-1]]
        if j - i > 1 or len(d) <= 2 * BLOCK:
            yield i, j, d, o - o[0]
            continue
        at = cuts(d, INSIDE, BLOCK)
        for lo, hi in zip(at, at[1:], strict=False):
            yield i, j, d[lo:hi], np.array([0, hi - lo])


def short(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of the words after runs of over LONG bytes are cut, whether each begins its run, and the words of each run."""
    n = np.maximum(1, -(-(e - s) // LONG))
    if (n == 1).all():
        return s, e, np.ones(len(s), bool), n
    run = np.repeat(np.arange(len(s)), n)
    k = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    start = s[run] + k * LONG
    for _ in range(3):  # to the next character
        inner = (k > 0) & (start < e[run])
        start[inner] += (data[start[inner]] & 0xC0) == 0x80
    stop = np.append(start[1:], 0)
    last = np.append(run[1:] != run[:-1], True)
    return start, np.where(last, e[run], stop), k == 0, n


def block_words(data: np.ndarray, off: np.ndarray, tag: np.ndarray | None = None) -> tuple[Words, np.ndarray, np.ndarray]:
    """The distinct words of a block (of rows with one tag, if given), each token's word, and each row's first token plus the total."""
    data = LOWER[data]
    s, e, at = spans(data, off, INSIDE)
    s, e, begins, n = short(data, s, e)
    at = np.concatenate([[0], np.cumsum(n)])[at]
    h = span_hash(data, s, e)
    tags = np.zeros(len(s), np.int64) if tag is None else np.repeat(tag, np.diff(at))
    h = mix(h + (2 * tags + begins).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    key, first, inverse, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    mark = begins[first].astype(np.int64)
    s, size = s[first], (e - s)[first] + mark
    base = np.cumsum(size) - size
    at_byte = np.repeat(s - mark - base, size) + np.arange(int(size.sum()))
    flat = data[np.maximum(at_byte, 0)] if len(at_byte) else np.zeros(0, np.uint8)
    flat[base[mark > 0]] = MARK
    return Words(key, flat, size, tags[first], count.astype(float)), inverse.astype(np.int32), at


def join_words(parts: list[Words]) -> Words:
    """The words of several blocks, in order of key, counts summed."""
    if len(parts) == 1:
        return parts[0]
    key = np.concatenate([p.key for p in parts])
    both = Words(key, np.concatenate([p.flat for p in parts]), np.concatenate([p.size for p in parts]), np.concatenate([p.tag for p in parts]), np.concatenate([p.count for p in parts]))
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    out = both.take(first)
    out.count = np.bincount(inverse, both.count)
    return out


def forward(w: Words, t: np.ndarray) -> np.ndarray:
    """Log-probability of each distinct word in each language; t: pieces + 1 by languages, the last row 0."""
    out = np.zeros((len(w.size), t.shape[1]))
    none = len(t) - 1
    for n in np.unique(w.size):
        which = np.flatnonzero(w.size == n)
        base = w.base[which]
        a, scale = np.zeros((n + 1, len(which), t.shape[1])), np.zeros((len(which), t.shape[1]))
        a[0] = 1.0
        for j in range(1, n + 1):
            for size, ids in w.ids.items():
                if size > j:
                    break
                i = ids[base + (j - size)]
                hit = np.flatnonzero(i != none)
                if len(hit):
                    a[j][hit] += a[j - size][hit] * t[i[hit]]
            if n > 16 and j % 8 == 0:
                low = np.where(a[j] < 1e-100, 1e100, 1.0)
                if (low > 1).any():
                    a[max(0, j - w.longest) : j + 1] *= low
                    scale += np.log(low)
        out[which] = np.log(np.maximum(a[n], 1e-300)) - scale
    return out


def expected(w: Words, t: np.ndarray) -> np.ndarray:
    """Expected piece counts, languages by pieces: forward and backward over each (word, language) with its count."""
    v, langs = len(t) - 1, t.shape[1]
    total = np.zeros(langs * (v + 1))
    flat = np.ascontiguousarray(t.T).ravel()
    for n in np.unique(w.size):
        which = np.flatnonzero(w.size == n)
        base, tag = w.base[which], w.tag[which].astype(np.int64) * (v + 1)
        a, b = np.zeros((n + 1, len(which))), np.zeros((n + 1, len(which)))
        a[0] = b[n] = 1.0
        arcs = []
        for j in range(1, n + 1):
            for size, ids in w.ids.items():
                if size > j:
                    break
                i = ids[base + (j - size)]
                hit = np.flatnonzero(i != v)
                if len(hit):
                    key = tag[hit] + i[hit]
                    p = flat[key]
                    a[j][hit] += a[j - size][hit] * p
                    arcs.append((j - size, j, hit, key, p))
        for i, j, hit, _, p in sorted(arcs, key=lambda x: -x[1]):
            b[i][hit] += b[j][hit] * p
        share = w.count[which] / np.maximum(a[n], 1e-300)
        keys = np.concatenate([x[3] for x in arcs])
        mass = np.concatenate([a[i][hit] * p * b[j][hit] * share[hit] for i, j, hit, _, p in arcs])
        total += np.bincount(keys, mass, len(total))
    return total.reshape(langs, v + 1)[:, :v]


def _looked(w: Words, lattice: Lattice) -> Words:
    w.look_up(lattice)
    return w


_LATTICES: dict[int, Lattice] = {}


def _lattice(vocab: list[bytes]) -> Lattice:
    key = hash(tuple(vocab))
    if key not in _LATTICES:
        _LATTICES.clear()
        _LATTICES[key] = Lattice(vocab)
    return _LATTICES[key]


class Model:
    """Piece probabilities by language."""

    def __init__(self, vocab: list[bytes], langs: list[str], table: np.ndarray):
        self.vocab, self.langs, self.table = vocab, langs, table


def _normal(counts: np.ndarray, smooth: float) -> np.ndarray:
    p = counts + smooth
    p /= p.sum(1, keepdims=True)
    return np.vstack([p.T, np.zeros(len(p))])


def fit(train: DataFrame, path: str, text_col: str = "text", lang_col: str = "lang", rounds: int = 2, smooth: float = 0.05) -> Model:
    """Learn from every row of train that has a language."""
    ship(train.sparkSession)
    rows = train.select(named(text_col).alias("text"), named(lang_col).alias("lang")).where("lang is not null")
    langs = sorted(r[0] for r in rows.select("lang").distinct().collect())  # as many rows as there are languages
    vocab = read_pieces(path)
    sc = rows.sparkSession.sparkContext
    t = np.full((len(vocab) + 1, max(1, len(langs))), 1.0 / len(vocab))
    t[-1] = 0
    for _ in range(rounds if langs else 0):
        held = sc.broadcast((vocab, {x: i for i, x in enumerate(langs)}, t))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            vocab, index, t = held.value
            lattice, sums = _lattice(vocab), np.zeros((len(index), len(vocab)))
            bag: list[Words] = []

            def learn() -> None:
                for _, _, w in join_words(bag).lots() if bag else ():
                    w.look_up(lattice)
                    sums[:] += expected(w, t)
                bag.clear()

            for b in batches:
                data, off = buffers(b.column(0))
                lang = np.array([index[x] for x in b.column(1).to_pylist()], np.int64)
                for i, j, d, o in blocks(data, off):
                    bag.append(block_words(d, o, lang[i:j])[0])
                    if sum(len(w.size) for w in bag) > BAG:
                        bag[:] = [join_words(bag)]
                        if len(bag[0].size) > BAG // 2:
                            learn()
            learn()
            k, p = np.nonzero(sums > 1e-9)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(p.astype(np.int32)), pa.array(sums[k, p])], names=["lang", "piece", "n"])

        got = rows.mapInArrow(run, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros((len(langs), len(vocab)))
        counts[got["lang"].to_numpy(), got["piece"].to_numpy()] = got["n"].to_numpy()
        t = _normal(counts, smooth)
        held.unpersist()
    return Model(vocab, langs, t)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[Column, ...] = (), carry: bool = False) -> DataFrame:
    """doc_id, the kept columns, lang_pred, score (the posterior of lang_pred under equal priors) and bits (per letter byte, in lang_pred).

    carry: also `row`, all columns of docs as common.whole() packs them.
    """
    ship(docs.sparkSession)
    src = docs.select(named(id_col).alias("doc_id"), *keep, whole(docs).alias("row") if carry else named(text_col).alias("text"))
    at = docs.columns.index(text_col)
    held = docs.sparkSession.sparkContext.broadcast((model.vocab, model.langs, model.table))
    out_fields = src.schema.fields if carry else src.schema.fields[:-1]
    result = T.StructType([*out_fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits", T.DoubleType())])
    n_out = len(out_fields)

    def text_of(b: pa.RecordBatch) -> pa.Array:
        text = b.column(b.num_columns - 1)
        return text.field(at) if carry else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, langs, t = held.value
        lattice = _lattice(vocab)

        def score(load: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, words_of = [], []
            for k, b in enumerate(load):
                for i, j, d, o in blocks(*buffers(text_of(b))):
                    w, inverse, first = block_words(d, o)
                    ascii_ = np.concatenate([[0], np.cumsum(INSIDE[d] & (d < 128))])
                    letters = ascii_[o[1:]] > ascii_[o[:-1]]
                    for r in np.flatnonzero(~letters & (np.diff(first) > 0)):
                        letters[r] = any(c.isalpha() for c in d[o[r] : o[r + 1]].tobytes().decode("utf-8", "ignore"))
                    found.append((k, i, j, w.key, inverse, first, letters))
                    words_of.append(w)
            words = join_words(words_of) if words_of else None
            if words is not None:
                log_p = np.concatenate([np.zeros((0, t.shape[1])), *(forward(_looked(w, lattice), t) for _, _, w in words.lots())])
            got = [(np.zeros((b.num_rows, t.shape[1])), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, bool)) for b in load]
            for k, i, j, key, inverse, first, letters in found:  # a long row comes in several parts
                if not len(key):
                    continue
                index = np.searchsorted(words.key, key)[inverse]
                run_ = np.zeros((len(index) + 1, t.shape[1]))
                np.cumsum(log_p[index], 0, out=run_[1:])
                size = np.concatenate([[0], np.cumsum(words.size[index])])
                got[k][0][i:j] += run_[first[1:]] - run_[first[:-1]]
                got[k][1][i:j] += size[first[1:]] - size[first[:-1]]
                got[k][2][i:j] |= letters
            for b, (ll, size, letters) in zip(load, got, strict=True):
                best, known = ll.argmax(1), letters & bool(langs)
                top = ll[np.arange(len(ll)), best]
                post, bits = 1.0 / np.exp(ll - top[:, None]).sum(1), -top / np.log(2) / np.maximum(1, size)
                names = [langs[p] if k else "und" for p, k in zip(best, known, strict=True)]
                out = [pa.array(names, pa.string()), pa.array(np.where(known, np.clip(post, 0, 1), 0.0)), pa.array(np.where(known, bits, 0.0))]
                yield pa.RecordBatch.from_arrays([*b.columns[:n_out], *out], names=[*b.schema.names[:n_out], "lang_pred", "score", "bits"])

        load, size = [], 0
        for b in batches:
            load.append(b)
            size += text_of(b).nbytes
            if size > LOAD:
                yield from score(load)
                load, size = [], 0
        yield from score(load)

    return src.mapInArrow(run, result)


def remainder(id_col: str, by: int) -> Column:
    """crc32 of the id as text, modulo `by`; a null id counts as empty text."""
    return F.crc32(F.coalesce(named(id_col).cast("string"), F.lit(""))) % by


def identify(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rounds: int = 2, carry: bool = False) -> DataFrame:
    """Fit on the rows that aren't held out (remainder of 3 not 1), predict all: doc_id, held_out, (row,) lang_pred, score, bits."""
    model = fit(docs.where(remainder(id_col, 3) != 1), path, text_col, lang_col, rounds)
    return predict(docs, model, id_col, text_col, keep=((remainder(id_col, 3) == 1).alias("held_out"),), carry=carry)
