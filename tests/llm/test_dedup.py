"""Substring removal, Jaccard join, lattice hashing and components against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from fathomdf.llm import common, jaccard_join, lattice_dedup, pairs, suffix_dedup
from fathomdf.llm.common import components

WORDS = ["the", "of", "édu", "ñora", "thing", "ein", "was", "über", "a", "ation", "xylo", "漢字"]


def passage(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ly"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    common, long = passage(rng, 40), passage(rng, 900)
    out = [(i, passage(rng, rng.randint(1, 120))) for i in range(40)]
    out += [(100 + i, passage(rng, 15) + " " + common + " " + passage(rng, 15)) for i in range(30)]
    out += [(200 + i, common) for i in range(20)]
    near = passage(rng, 150).split(" ")
    for i in range(25):
        w = list(near)
        w[rng.randrange(len(w))] = "changed"
        out.append((300 + i, " ".join(w)))
    out += [(400, "ab" * 700), (401, "x" * 1500), (402, "Annt " * 300), (403, ""), (404, None), (405, "x" * 99), (406, "x" * 100), (407, long + long), (408, long[500:3000])]
    out += [(409, "one two three four"), (410, "one two three four"), (411, "!!! ...")]
    out += [(500, common), (500, common), (501, passage(rng, 60)), (501, long[:900]), (None, common), (None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(a, t, "s") for a, t in rows], "doc_id long, text string, start string")


def removed(rows):
    """By definition: windows in order of (doc_id, start), null ids last."""
    big = 1 << 62
    first = {}
    key = lambda d: big if d is None else d
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            first[w] = min(first.get(w, (big + 1, 0)), (key(d), i))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        hit = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            if first[b[i : i + 100]] < (key(d), i):
                hit[i : i + 100] = True
        kept = np.frombuffer(b, np.uint8)[~hit].tobytes()
        runs = int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())
        out.append((d, len(b), int(hit.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("buckets", [1, 7])
def test_removed_bytes(docs, rows, buckets):
    got = suffix_dedup.remove_repeats(docs, buckets=buckets).collect()
    flat = [(r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got]
    assert sorted(flat, key=str) == sorted(removed(rows), key=str)


def test_small_lots_and_frequent_grams(docs, rows, monkeypatch):
    data = np.frombuffer(b"".join((t or "").encode() for _, t in rows), np.uint8)
    fp = np.unique(suffix_dedup.gram_hashes(data))[::3]
    monkeypatch.setattr(suffix_dedup, "frequent_grams", lambda *_: fp)
    got = suffix_dedup.remove_repeats(docs, buckets=2)
    assert {(r.doc_id, len(r.kept)) for r in got.collect()} == {(d, n - k) for d, n, k, _, _ in removed(rows)}


@pytest.mark.parametrize(("buckets", "counted"), [(1, 1 << 20), (7, 50)])
def test_frequent_grams_are_counted_over_all_documents(spark, buckets, counted, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "COUNTED", counted)
    rng = random.Random(8)
    lines = [passage(rng, 60)[:130] for _ in range(40)]
    texts = [line for i, line in enumerate(lines) for _ in range(5 + i)]
    texts += ["short"] * (25_000 - len(texts))  # frequent is what 25 documents have
    docs = spark.createDataFrame(list(enumerate(texts)), "did long, text string").select("did", "text", suffix_dedup.F.encode("text", "UTF-8").alias("bytes"))
    have = {}
    for i, line in enumerate(lines):
        h = [int(x) for x in suffix_dedup.gram_hashes(np.frombuffer(line.encode(), np.uint8))]
        for fp in {h[min(range(k, k + 85), key=lambda p: (h[p] >> 1, p))] for k in range(len(line.encode()) - 99)}:
            have[fp] = have.get(fp, 0) + 5 + i
    want = sorted(fp for fp, n in have.items() if n >= 25)
    assert want and len(want) < len(have)
    assert suffix_dedup.frequent_grams(docs, "bytes", buckets).tolist() == want


def test_column_order_in_lots(rows, monkeypatch):
    """The in-memory construction, with tiny lots, on one bucket."""
    monkeypatch.setattr(suffix_dedup, "LOT", 3)
    texts = [(t or "").encode() for _, t in rows if t]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    d = np.frombuffer(b"".join(texts), np.uint8)
    s = suffix_dedup.Segments(d, off, np.zeros(0, np.uint32))
    size = s.windows + 99
    flat = suffix_dedup.gather(d, s.start, size)
    base = np.cumsum(size) - size
    order = np.argsort(s.fp, kind="stable")
    start = s.start - off[s.row]
    seg, win = suffix_dedup.equal_windows(s.fp[order], flat, base[order], s.lean[order], s.windows[order], s.row[order], start[order])
    got = {(int(s.row[order][k]), int(start[order][k] + w)) for k, w in zip(seg, win, strict=True)}
    first, want = {}, set()
    for i, t in enumerate(texts):
        for j in range(len(t) - 99):
            if t[j : j + 100] in first:
                want.add((i, j))
            first.setdefault(t[j : j + 100], (i, j))
    assert got == want


def by_windows(texts):
    first, want = {}, set()
    for i, t in enumerate(texts):
        for j in range(len(t) - 99):
            if t[j : j + 100] in first:
                want.add((i, j))
            first.setdefault(t[j : j + 100], (i, j))
    return want


@pytest.mark.parametrize("lot", [2, 7])
def test_hot_sub_collections_are_split(lot, monkeypatch):
    """Many segments around one gram, split down to windows, give the same windows."""
    monkeypatch.setattr(suffix_dedup, "LOT", lot)
    rng = random.Random(6)
    noise = lambda n: bytes(rng.choice(b"abcdefghijklmnop") for _ in range(n))
    core, parts = b"0123456789012345", [noise(90) for _ in range(4)]
    texts = [noise(rng.randint(0, 30)) + rng.choice(parts)[-rng.randint(40, 90) :] + core + rng.choice(parts)[: rng.randint(40, 90)] + noise(9) for _ in range(60)]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    d = np.frombuffer(b"".join(texts), np.uint8)
    s = suffix_dedup.Segments(d, off, np.zeros(0, np.uint32))
    doc, start = s.row, s.start - off[s.row]
    p = suffix_dedup.Parts(s.fp.astype(np.uint64), np.arange(len(s.row)), s.start, start, s.lean, s.windows, 0, 84)
    assert p.count.max() > 20
    got = {(int(doc[r]), int(x)) for rows_, at in suffix_dedup.solve_parts(p, d, doc) for r, x in zip(rows_, at, strict=True)}
    assert got == by_windows(texts) and len(got) > 100


def test_equal_hashes_are_checked_by_bytes():
    data = np.frombuffer(b"abcabcabdabc", np.uint8)
    rep, later = suffix_dedup.folded(np.zeros(4, np.uint64), np.array([3, 1, 2, 1]), np.zeros(4, np.int64), data, np.array([0, 3, 6, 9]), np.full(4, 3))
    assert sorted(rep) == [1, 2] and sorted(later) == [0]


def test_long_texts_in_ranges(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 300)
    rng = random.Random(3)
    texts = [passage(rng, n).encode() for n in (20, 900, 5, 400)]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    d = np.frombuffer(b"".join(texts), np.uint8)
    got = []
    for i, j, lo, hi, shift in suffix_dedup.ranges(off):
        o = suffix_dedup.offsets(off, i, j, lo, hi)
        s = suffix_dedup.Segments(d[lo:hi], o, np.zeros(0, np.uint32))
        got += [(int(r) + i, int(x - o[r] + shift + k)) for r, x, w in zip(s.row, s.start, s.windows, strict=True) for k in range(w)]
    assert sorted(got) == [(i, k) for i, t in enumerate(texts) for k in range(len(t) - 99)]


def test_runs_without_overflow():
    doc = np.array([1, 1, 2, 2, 2])
    got = suffix_dedup.merge_runs(doc, np.zeros(5, np.int64), np.array([0, 50, 0, 1 << 61, 5]), np.array([60, 70, 10, (1 << 61) + 3, 9]))
    assert [x.tolist() for x in got] == [[1, 2, 2], [0, 0, 0], [0, 0, 1 << 61], [70, 10, (1 << 61) + 3]]


def test_removed_text_and_empty(docs):
    r = suffix_dedup.remove_repeats(docs, as_text=True, carry=True).select("kept", *common.parts(docs))
    assert all("�" not in x.kept and x.start == "s" and x.text is None for x in r.collect())
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def shingles(text):
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def join_by_hand(rows, threshold=0.8):
    sets = [(d, shingles(t)) for d, t in rows]
    n = len(sets)
    links, parent = [0] * n, list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if None not in (sets[i][0], sets[j][0]) and a and b and len(a & b) >= threshold * len(a | b):
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                if x != y:
                    parent[max((x, y), key=lambda k: sets[k][0])] = min((x, y), key=lambda k: sets[k][0])
    return sorted(((sets[i][0], len(sets[i][1]) if sets[i][0] is not None else 0, links[i], sets[find(i)][0]) for i in range(n)), key=str)


@pytest.mark.parametrize("block", [1000, 6])
def test_jaccard_join(docs, rows, block, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", block)
    got = jaccard_join.jaccard_join(docs, recall=0.9999).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.n_links, r.component) for r in got), key=str) == join_by_hand(rows)
    assert all(r.kept == (r.doc_id == r.component) for r in got if r.doc_id is not None)


def test_jaccard_without_broadcast_and_empty(docs, rows, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    got = jaccard_join.jaccard_join(docs, recall=0.9999).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.n_links, r.component) for r in got), key=str) == join_by_hand(rows)
    assert jaccard_join.jaccard_join(docs.limit(0)).count() == 0


def test_drop_near_duplicates(docs, rows):
    kept = jaccard_join.drop_near_duplicates(docs, recall=0.9999)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len([i for i in ids if i is not None and 200 <= i < 220]) == 1 and 500 not in ids
    assert len([i for i in ids if i is not None and 300 <= i < 325]) == 1 and ids.count(None) == 2
    assert {0, 403, 404, 411} <= set(ids)


def test_repeated_ids_with_other_texts(spark):
    rng = random.Random(8)
    a, b, c = (passage(rng, 60) for _ in range(3))
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (4, c), (5, a), (5, c + " more"), (6, None), (6, "")]
    df = spark.createDataFrame([(*r, 0, "g") for r in rows], "doc_id long, text string, `a.b` int, `group` string")
    got = jaccard_join.jaccard_join(df, recall=0.9999).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.n_links, r.component) for r in got), key=str) == join_by_hand(rows)
    kept = jaccard_join.drop_near_duplicates(df, recall=0.9999)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, a), (1, b), (4, c), (6, None), (6, "")], key=str)


def test_paths_split_until_small():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 100).astype(np.uint64)
    a, b = np.unique(base[:95]), np.unique(base[5:])
    seeds = jaccard_join.mix(np.arange(1, 4001, dtype=np.uint64))
    same = jaccard_join.paths(a, seeds) == jaccard_join.paths(b, seeds)
    assert (same[:, 1:] <= same[:, :-1]).all()  # who has parted stays apart
    assert np.allclose(same.mean(0), [0.9**d for d in jaccard_join.DEPTHS], atol=0.03)


def test_recall_formula():
    assert jaccard_join.runs_for(0.8, 0.99, 6) == 16


def test_components(spark):
    edges = [(i + 1, i) for i in range(30)] + [(50, 60), (60, 61), (70, 70), (None, 1)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 50: 50, 60: 50, 61: 50, 70: 70}


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    out, base = [], rng.standard_normal((60, 64))
    for i in range(60):
        for k in range(4):
            noise = rng.standard_normal(64) * [0, 0.05, 0.2, 0.4][k]
            out.append((i * 10 + k, [float(x) for x in np.float32(base[i] + noise)], i % 3))
    hot = rng.standard_normal(64)
    out += [(2000 + i, [float(x) for x in np.float32(hot + 0.05 * rng.standard_normal(64))], 1) for i in range(80)]
    out += [(3000 + i, [float(x) for x in np.float32(hot)], 1) for i in range(20)]
    out += [(4000, None, 1), (4001, [], 1), (4002, [0.0] * 64, 1), (4003, [float("nan")] * 64, 1), (4004, [None] * 64, 1), (4005, [float(x) for x in hot], None), (4006, [1.0, 2.0], 1), (4007, [2.0, 4.0], 1), (None, [1.0, 2.0], 1), (4006, [1.0, 2.0], 1), (4008, [1e200, 1e200], 1), (4009, [float("inf"), 1.0], 1)]
    return out, spark.createDataFrame(out, "vec_id long, embedding array<double>, label int")


@pytest.mark.parametrize("block", [1000, 16])
def test_lattice(vectors, block, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", block)
    data, df = vectors
    got = sorted(lattice_dedup.lattice_dedup(df).collect(), key=str)
    assert len(got) == len(data)
    good = [(i, np.array(v) / max(np.abs(v)), l) for i, v, l in data if i is not None and l is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = [0] * len(good)
    parent = list(range(len(good)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    total = 0
    for a in range(len(good)):
        for b in range(a):
            (i, u, l), (j, v, m) = good[a], good[b]
            if l == m and len(u) == len(v) and u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.93:
                links[a] += 1
                links[b] += 1
                total += 2
                x, y = find(a), find(b)
                if x != y:
                    parent[max((x, y), key=lambda k: good[k][0])] = min((x, y), key=lambda k: good[k][0])
    found = sum(r.n_links for r in got)
    assert found <= total and found >= 0.98 * total
    want = {}
    for k, (i, _, _) in enumerate(good):
        want.setdefault(i, []).append((links[k], good[find(k)][0]))
    assert np.mean([(r.n_links, r.component_id) in want.get(r.vec_id, [(0, r.vec_id)]) for r in got]) > 0.97
    for r in got:
        if r.vec_id in (4000, 4001, 4002, 4003, 4004, 4005, 4009, None):
            assert (r.n_links, r.component_id) == (0, r.vec_id)
    assert lattice_dedup.lattice_dedup(df.limit(0)).count() == 0


def test_lattice_repeated_ids_with_other_vectors(spark):
    rng = np.random.default_rng(6)
    a, b = rng.standard_normal(64), rng.standard_normal(64)
    near = lambda v: [float(x) for x in v + 0.01 * rng.standard_normal(64)]
    rows = [(1, near(a)), (1, near(b)), (2, near(a)), (3, near(b)), (3, near(b))]
    df = spark.createDataFrame([(*r, 1, 5) for r in rows], "vec_id long, embedding array<double>, label int, component_id int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in lattice_dedup.lattice_dedup(df).collect())
    assert got == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (3, 2, 1)]


def test_lattice_separates_and_finds(spark, monkeypatch):
    """At the threshold itself the recall is the target's; of unrelated pairs few are compared."""
    rng = np.random.default_rng(9)
    n, pairs_ = 3000, 500
    x = rng.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((pairs_, 64))
    z -= (z * x[:pairs_]).sum(1, keepdims=True) * x[:pairs_]
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.9301 * x[:pairs_] + np.sqrt(1 - 0.9301**2) * z
    compared = spark.sparkContext.accumulator(0)

    def counted(threshold, inner=lattice_dedup.cosine):
        similar = inner(threshold)

        def run(xs, ys):
            compared.add(len(xs) * len(ys) // (2 if xs is ys else 1))
            return similar(xs, ys)

        return run

    monkeypatch.setattr(lattice_dedup, "cosine", counted)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([x, y]))]
    got = lattice_dedup.lattice_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sum(r.n_links for r in got) >= 0.98 * 2 * pairs_
    assert compared.value < 0.05 * n * n / 2, compared.value
    assert lattice_dedup.tables_for(0.93, 0.995, 3) > lattice_dedup.tables_for(0.93, 0.995, 2) > lattice_dedup.tables_for(0.93, 0.9, 2)
    assert [lattice_dedup.pieces_for(k) for k in (0, 10**6, 10**7, 10**10)] == [2, 2, 3, 4]


def test_decode_is_nearest():
    x = np.random.default_rng(2).uniform(-3, 3, (300, 8))
    home = lattice_dedup.decode(x)
    near = ((2 * x[:, None] - (home[:, None] + lattice_dedup.ROOTS[None])) ** 2).sum(2).min(1)
    assert len(lattice_dedup.ROOTS) == 240 and (((2 * x - home) ** 2).sum(1) <= near + 1e-9).all()
    assert (home.sum(1) % 4 == 0).all() and all(len(set(r % 2)) == 1 for r in home)
