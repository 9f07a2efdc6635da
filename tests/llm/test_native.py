"""Decontamination, mixing, URL rules and the pipeline, against plain code."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fathomdf.llm import decontaminate, mixing, url_filter

VOCAB = [f"w{i}" for i in range(60)] + ["été", "the"]


def words(t):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())


def by_hand(docs, items):
    win = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            win.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, got = words(t), set(), set()
        for n in {len(k) for k in win}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in win:
                    hit |= set(range(k, k + n))
                    got |= win[tuple(w[k : k + n])]
        out.append((d, len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def bench():
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(VOCAB) for _ in range(n))
    items = [(i, text(rng.randint(8, 40))) for i in range(30)] + [(100, "w1 w2"), (101, "rare!"), (102, ""), (103, None), (104, "..."), (105, text(9))]
    items += [(106, items[0][1]), (107, "the the the the the the the the the the the the"), (108, "unseen words only here zz zzz zzzz")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)]
    docs += [(200 + i, text(5) + " " + items[i][1].upper() + ", " + text(6)) for i in range(25)]
    docs += [(300, None), (301, ""), (302, "the " * 400), (303, "Rare"), (304, text(3000) + " " + items[3][1]), (305, items[2][1]), (305, items[2][1]), (305, "other"), (None, items[4][1])]
    return docs, items


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 900])
def test_decontaminate(spark, bench, block):
    docs, items = bench
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, items int")
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    got = decontaminate.decontaminate(d, b, block_bytes=block).collect()
    flat = [(r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated) for r in got]
    assert sorted(flat, key=str) == by_hand(docs, items)


def test_decontaminate_empty(spark, bench):
    docs, items = bench
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.decontaminate(d.limit(0), b).count() == 0
    none = decontaminate.decontaminate(d, b.limit(0)).collect()
    assert len(none) == len(docs) and not any(r.contaminated for r in none)


def fill(sizes, weights, share, cap):
    goal, capped = share * sum(sizes), set()
    while True:
        left = goal - sum(cap * sizes[i] for i in capped)
        free = [i for i in range(len(sizes)) if i not in capped]
        w = sum(weights[i % len(weights)] for i in free)
        t = {i: left * weights[i % len(weights)] / w for i in free}
        over = {i for i in free if t[i] > cap * sizes[i]}
        if not over:
            return [cap * sizes[i] if i in capped else t[i] for i in range(len(sizes))]
        capped |= over


def test_mixing(spark):
    rng = random.Random(2)
    docs = [(i, "word " * int(rng.paretovariate(1.2)), rng.choice(["a", "a", "a", "b", "c", None, "é"]), 1) for i in range(3000)]
    docs += [(9000, None, "a", 1), (9001, "", "empty", 1), (9002, "x\x1cy z", "b", 1), (7, "again once", "b", 1), (7, "again once", "b", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, size int")
    got = mixing.mix(df).collect()
    assert len(got) == len(docs) and sorted(got, key=str) == sorted(mixing.mix(df.repartition(7)).collect(), key=str)
    sizes = {}
    for _, t, s, _ in docs:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted((s for s in sizes if s is not None)) + [None]
    want = dict(zip(names, fill([sizes[s] for s in names], (3, 1, 2), 1.5, 2.0), strict=True))
    taken, largest = dict.fromkeys(names, 0), {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source]) and 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest.get(r.source, 0), r.size)
    for s in names:
        assert abs(taken[s] - want[s]) <= 2 * largest[s] + 2
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.emit(df.where("doc_id >= 9000"), mixing.mix(df).where("doc_id >= 9000")).count() == sum(r.copies for r in got if r.doc_id >= 9000)


def test_url_rules(spark):
    urls = ["http://a.com/x", "https://Example.COM/en/1", "https://www.example.com/en/1", "http://x.net/es/?q", "http://net/fr/", "http://x.net/de/", "http://notexample.com/en/", "http://a.com", "nourl", None, "http://x.org/a://b/c?d#e", "ftp://H.co.uk:80?x", "http://ÀB.net/fr/x", "://", "http://a\nb.net/es/x\ny", "x://y.com/en#://z.net/es/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(0, urls[0], "h")], "page_id long, url string, host string")
    got = url_filter.judge(pages, None).collect()
    assert len(got) == len(urls) + 1
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    for r in got:
        u = urls[r.page_id]
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = low(re.split("[/?#]", rest, maxsplit=1)[0])
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best[1], best[2]), u
    assert url_filter.judge(pages.limit(0), None).count() == 0


def test_reputation_shrinks(spark):
    rows, labels = [], []
    n = 0
    for host, k, bad in (("bad.evil.xyz", 80, 78), ("one.good.org", 60, 1), ("new.good.org", 1, 1), ("x.evil.xyz", 0, 0), ("two.good.org", 50, 2), ("y.fine.info", 30, 0)):
        for j in range(max(k, 1)):
            rows.append((n, f"http://{host}/p{j}"))
            labels += [(n, int(j >= bad))] if k else []
            n += 1
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([*labels, (5, None), (None, 0)], "doc_id long, quality int"))
    by = {r.host: r for r in got.collect()}
    assert by["bad.evil.xyz"].verdict == "block" and by["one.good.org"].verdict == "allow"
    assert by["new.good.org"].verdict == "allow" and by["new.good.org"].bad_rate < 0.6
    assert by["x.evil.xyz"].bad_rate > by["y.fine.info"].bad_rate
    assert [url_filter.domain_of(F.lit(h)) is not None for h in ("a.b.co.uk",)]
    d = spark.range(1).select(*[url_filter.domain_of(F.lit(h)).alias(f"d{i}") for i, h in enumerate(("a.b.co.uk", "a.b.com", "b.com", "localhost", "10.0.0.1"))]).first()
    assert tuple(d) == ("b.co.uk", "b.com", "b.com", "localhost", "10.0.0.1")


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    stems = {"en": ["the", "and", "tion", "ing", "was"], "fr": ["que", "ment", "éle", "eau", "les"]}
    text = lambda lang, n: " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    docs = [(i, text(lang, 80), lang, f"s{i % 3}") for i in range(60) for lang in [("en", "fr")[i % 2]]]
    item, shared = text("en", 14), text("en", 60)
    docs += [(100 + i, docs[i][1], docs[i][2], "s0") for i in range(5)]
    docs += [(200, text("en", 40) + " " + item, "en", "s1"), (201, shared + " " + text("en", 60), "en", "s1"), (202, text("en", 60) + " " + shared, "en", "s2"), (203, None, None, None), (204, "12 34", "en", "s1")]
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "repeated_passages", "benchmark_passages", "mixture"]
    state, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = state.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, state, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        state = spark.read.parquet(f"{tmp_path}/{i}")
        seen.append({r.doc_id for r in state.collect()})
        assert name == "mixture" or state.columns == columns
    everything = {d[0] for d in docs}
    assert everything - seen[0] == {203, 204} and seen[0] - seen[1] == set(range(100, 105))
    assert seen[2] == seen[1] and seen[2] - seen[3] == {200} and seen[4] <= seen[3]
    plan = mixing.mix(spark.read.parquet(f"{tmp_path}/3"))
    assert seen[4] == {r.doc_id for r in plan.collect() if r.copies}
    cut = spark.read.parquet(f"{tmp_path}/2").where("doc_id = 202").first()
    assert shared not in cut.text and cut.n_chars == len(cut.text)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == seen[4]


def test_pipeline_by_hand(spark, tmp_path):
    """run() against the five stages in plain code."""
    from test_dedup import join_by_hand

    import corpus_pipeline

    rng = random.Random(21)
    stems = {"en": ["the", "and", "tion", "ing", "was"], "fr": ["que", "ment", "éle", "eau", "les"]}
    text = lambda lang, n: " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    docs = [(i, text(lang, rng.randint(30, 120)), lang, f"s{rng.randint(0, 2)}") for i in range(50) for lang in [("en", "fr")[i % 2]]]
    docs += [(100 + i, docs[i][1] + " " + text(docs[i][2], 1), docs[i][2], "s0") for i in range(8)] + [(120 + i, docs[9][1], docs[9][2], "s1") for i in range(4)]
    shared, items = text("en", 60), [(1, text("en", 14)), (2, text("fr", 6))]
    docs += [(200 + i, text("en", 40 + 9 * i) + " " + shared + " " + text("en", 30), "en", "s2") for i in range(4)]
    docs += [(220, text("en", 30) + " " + items[0][1], "en", "s1"), (221, items[1][1] + ", " + text("fr", 40), "fr", "s0"), (230, "12 34", "en", "s1"), (231, None, None, None)]
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = sorted((i, t, s) for i, t, _, s in docs if any(c.isalpha() for c in t or ""))
    least = {d: c for d, _, _, c in join_by_hand([(i, t) for i, t, _ in rows])}
    rows = [r for r in rows if least[r[0]] == r[0]]
    seen, cut = set(), []
    for i, t, s in rows:
        b, gone = t.encode(), set()
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone |= set(range(k, k + 100))
            seen.add(b[k : k + 100])
        cut.append((i, bytes(x for k, x in enumerate(b) if k not in gone).decode("utf-8", "ignore"), s))
    assert sum(len(a[1]) > len(b[1]) for a, b in zip(rows, cut, strict=True)) >= 3
    leaks = {r[0] for r in by_hand([(i, t) for i, t, _ in cut], items) if r[5]}
    rows = [r for r in cut if r[1] and r[0] not in leaks]
    assert leaks == {220, 221}
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    names = sorted({s for _, _, s in rows})
    totals = [sum(size(t) for _, t, s in rows if s == n) for n in names]
    want = Counter()
    for name, total, target in zip(names, totals, fill(totals, (3, 1, 2), 1.5, 2.0), strict=True):
        shift, rate = int(hashlib.md5(f"17:s{name}".encode()).hexdigest()[:8], 16) / 2**32, target / total
        for rank, (_, i, t) in enumerate(sorted((size(t), i, t) for i, t, s in rows if s == name), 1):
            want[i, t] += int(shift + rate * rank) - int(shift + rate * (rank - 1))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text) for r in got) == +want and all(r.n_chars == len(r.text) for r in got)


CLASHES = ["did", "again", "d", "k", "starts", "text_key", "spans", "kept", "n_bytes", "a.b", "row", "key", "group", "of", "id", "n", "m", "gone", "x y`z", "size", "copies", "f0", "word", "token", "items", "lang_pred", "held_out"]


@pytest.mark.parametrize("kind", ["clashes", "empty"])
def test_stages_on_odd_tables(spark, tmp_path, kind):
    """Every stage by itself: nulls in any column, repeated rows, names that operators use themselves, a long text, no rows."""
    import corpus_pipeline

    rng = random.Random(12)
    stems = {"en": ["the", "and", "tion", "ing", "was"], "fr": ["que", "ment", "éle", "eau", "les"]}
    text = lambda lang, n: " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, text(lang, 60), lang, f"s{i % 3}", 1) for i in range(30) for lang in [("en", "fr")[i % 2]]]
    item = text("en", 12)
    rows += [(50, None, None, None, None), (51, "", "en", None, 0), (52, "...", "fr", "s1", 3), (None, text("en", 40), "en", "s1", 5), (None, None, None, None, None)]
    rows += [(60, rows[4][1], "en", "s2", 7)] * 3 + [(61, text("en", 400_000), "en", "s0", 9), (62, "q" * 200_000, "en", "s0", 9), (63, text("en", 30) + " " + item, "en", "s0", 9), (63, text("en", 30), "en", "s0", 9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join("`" + c.replace("`", "``") + "` string" for c in CLASHES)
    docs = spark.createDataFrame([(*r, *(f"{c}{i}" if i % 3 else None for c in CLASHES)) for i, r in enumerate(rows)] if kind == "clashes" else [], schema)
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    everything = Counter((r.doc_id, r.text) for r in docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema], name
        found = got.collect()
        for r in found:  # the other columns are still those of a row of that id
            assert all(r[c] is None or r[c].startswith(c) for c in CLASHES), name
        if kind == "empty":
            assert not found
            continue
        left = Counter((r.doc_id, r.text) for r in found)
        lost = sorted((k for k in everything if k not in left), key=str)
        if name == "language_id":
            assert lost == sorted([(50, None), (51, ""), (52, "..."), (None, None)], key=str)
        elif name == "near_duplicates":
            assert lost == [(60, rows[4][1])] and max(left.values()) == 1
        elif name == "repeated_passages":
            ids = Counter(r.doc_id for r in found)
            assert set(everything) - {(i, t) for i, t in everything if i in ids} == {(50, None), (51, ""), (60, rows[4][1])} and ids[63] == 2 and ids[None] == 1
            assert len(next(r.text for r in found if r.doc_id == 62)) == 1 and all(r.n_chars == len(r.text) for r in found)
        elif name == "benchmark_passages":
            assert lost == [(63, rows[-2][1])]
        else:
            assert set(left) <= set(everything)


def test_mixture_emits_each_copy(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    docs = [(i if i % 9 else None, "word " * rng.randint(1, 9) + str(i), None, "abc"[i % 3] if i < 290 else "a", i) for i in range(300)] + [(7, "again once", "en", "b", 1)] * 5 + [(7, "again twice", "en", "b", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.mixture(spark, df, str(tmp_path))
    assert got.columns == df.columns
    plan = mixing.mix(df).collect()
    assert min(r.copies for r in plan) == 0 and max(r.copies for r in plan) == 2
    count = lambda rows: sorted((str(k), n) for k, n in Counter(rows).items() if n)
    rows = got.collect()
    assert {tuple(r) for r in rows} < set(docs) and len(rows) == sum(r.copies for r in plan)
    size = lambda t: len(t.split())
    want = Counter()
    for r in plan:
        want[(r.doc_id, r.source, r.size)] += r.copies
    assert count((r.doc_id, r.source, size(r.text)) for r in rows) == sorted((str(k), n) for k, n in want.items() if n)
