"""Language ID, toxicity, licence scans: by hand, held out, and edge cases."""

import random
import re
import zlib

import numpy as np
import pytest

from fathomdf.llm import common, language_id, license_scan, queries, toxicity

pytest.importorskip("public_tokenizers")
PATH = queries.vocabulary(queries.PIECES)
STEMS = {"en": ["the", "and", "tion", "ing", "was", "th"], "fr": ["que", "ment", "éle", "eau", "les", "oi"], "de": ["ung", "sch", "und", "ein", "üb", "keit"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(STEMS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    return [(i, text(rng, lang, rng.randint(5, 60)), lang) for i in range(n) for lang in [list(STEMS)[i % 3]]]


def by_segmentations(word, vocab, p):
    a = [1.0] + [0.0] * len(word)
    for j in range(1, len(word) + 1):
        a[j] = sum(a[i] * p[vocab[word[i:j]]] for i in range(j) if word[i:j] in vocab)
    return a[-1]


def test_forward_sums_all_segmentations():
    pieces = language_id.read_pieces(PATH)
    lattice, index = language_id.Lattice(pieces), {p: i for i, p in enumerate(pieces)}
    rng = np.random.default_rng(1)
    t = np.vstack([rng.dirichlet(np.ones(len(pieces)), 2).T, np.zeros(2)])
    words = ["the", "ation", "überein", "a", "漢字", "x" * 60, "thing" * 30]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    w, inverse, _ = language_id.block_words(data, np.array([0, len(data)]))
    w.look_up(lattice)
    got = language_id.forward(w, t)[inverse]
    parts = [b" " + x.encode() for x in words[:5]] + [b" " + b"x" * 40, b"x" * 20, *[p + b"thing" * 8 for p in (b" ", b"", b"")], b"thing" * 6]
    assert len(got) == len(parts)
    for k, part in enumerate(parts):
        for lang in (0, 1):
            assert np.isclose(got[k, lang], np.log(by_segmentations(part, index, t[:, lang])))
    # expected counts of one word weigh its letters once, whatever the segmentation
    w, _, _ = language_id.block_words(np.frombuffer(b"ation", np.uint8), np.array([0, 5]), np.array([1]))
    w.look_up(lattice)
    e = language_id.expected(w, t)
    assert np.isclose(sum(e[1, i] * len(p) for i, p in enumerate(pieces)), 6) and e[0].sum() == 0


def test_language_rows(spark):
    rows = corpus() + [(1000, None, "en"), (1001, "", "en"), (1002, "12 345 !?", "en"), (1003, text(random.Random(3), "fr", 20), None), (None, text(random.Random(4), "de", 20), "de"), (1004, "the " * 9000, "en"), (1005, "q" * 5000, "en"), (5, "THE AND TION WAS", "en"), (5, "THE AND TION WAS", "en")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    got = language_id.identify(df, PATH).collect()
    assert len(got) == len(rows)
    want = {r[0]: r[2] for r in rows if r[0] is not None and r[0] < 1000 and r[0] != 5}
    held = [r for r in got if r.held_out and r.doc_id in want]
    assert len(held) > 40 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in held)
    assert np.mean([r.lang_pred == want[r.doc_id] for r in held]) > 0.97
    by = {r.doc_id: r for r in got}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert by[1003].lang_pred == "fr" and by[None].lang_pred == "de" and by[1004].lang_pred == "en" and 0 <= by[1005].score <= 1
    assert language_id.identify(df.limit(0), PATH).count() == 0
    unknown = language_id.identify(df.withColumn("lang", df.lang.substr(1, 0)).replace("", None, ["lang"]), PATH)
    assert {(r.lang_pred, r.score) for r in unknown.collect()} == {("und", 0.0)}
    whole = language_id.identify(df, PATH, carry=True).select(*common.parts(df))
    assert whole.columns == df.columns and {r.doc_id for r in whole.collect()} == {r[0] for r in rows}


def toxic_corpus(n=1500):
    rng = random.Random(7)
    docs, labels = [], []
    for i in range(n):
        y = int(i % 6 == 0)
        w = text(rng, list(STEMS)[i % 3], rng.randint(20, 120)).split(" ")
        for _ in range(3 * y):
            w.insert(rng.randrange(len(w)), "vile" + "".join(rng.choice(STEMS["en"]) for _ in range(2)))
        docs.append((i, " ".join(w), 0.5))
        if i % 4:
            labels.append((i, y))
    return docs, labels


def test_toxicity_held_out(spark):
    docs, labels = toxic_corpus()
    y = dict(labels)
    extra = [(9000, None, 0.1), (9001, "", 0.1), (9002, "...", 0.1), (None, "vilething", 0.1), (9003, "the and " * 9000, 0.1), (9003, "the and " * 9000, 0.1)]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string, score double")
    lab = spark.createDataFrame([*labels, (1, 0), (None, 1), (9002, None), (8, 7)], "doc_id long, toxic int")
    got = toxicity.toxicity(d, lab).collect()
    assert len(got) == len(docs) + len(extra)
    held = [r for r in got if r.held_out and r.doc_id in y]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held) and len(held) > 150
    assert np.mean([r.predicted == y[r.doc_id] for r in held]) > 0.97
    rest = [r for r in got if r.doc_id is not None and r.doc_id < 1500 and r.doc_id not in y]
    assert np.mean([r.predicted == int(r.doc_id % 6 == 0) for r in rest]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    none = {r.doc_id: r.score for r in got if r.doc_id in (9000, 9001, 9002)}
    assert len(set(none.values())) == 1
    assert {r.score for r in toxicity.toxicity(d, lab.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.toxicity(d.limit(0), lab).count() == 0


def test_licenses(spark):
    notes = {1: ("Released under the MIT License.", "mit"), 2: ("Licensed under the Apache License, Version 2.0.", "apache"), 3: ("This work is licensed under the GNU General Public License, version 3.", "gpl"), 4: ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), 5: ("All rights reserved.", "proprietary")}
    rng = random.Random(5)
    rows = [(i, text(rng, "en", 30) + "\n" + n + "\n" + text(rng, "en", 30), 1.0) for i, (n, _) in notes.items()]
    rows += [(20 + i, text(rng, "en", 80), 1.0) for i in range(40)] + [(60, None, 1.0), (61, "", 1.0), (62, "the license to drive was lost", 1.0), (63, "word " * 30000, 1.0)]
    rows += [(64, notes[1][0] + "\n" + notes[2][0], 1.0), (64, notes[1][0] + "\n" + notes[2][0], 1.0), (None, notes[3][0].upper(), 1.0)]
    got = license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string, probability double")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, (_, f) in notes.items():
        assert by[i].family == f and by[i].confirmed and by[i].families == [f], by[i]
    assert all(by[i].family == "none" and by[i].probability == 0 for i in [*range(20, 63), 63])
    assert set(by[64].families) == {"mit", "apache"} and by[None].family == "gpl"
    p = license_scan.license_paragraphs(spark.createDataFrame(rows, "doc_id long, text string, probability double"))
    assert p.where("doc_id = 1").first().text == notes[1][0]
    assert license_scan.license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def licences_by_hand(rows):
    """The paragraphs that aren't unknown, by plain code over all paragraphs: (id, paragraph) -> (family, confirmed)."""
    words = lambda t: [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.encode().lower())]
    names = set(license_scan.feature_names())
    anchors = {w for n in names for w in n.split(" ") if license_scan.bears(w)}
    found = {}
    for i, t in sorted(set(rows), key=str):
        for k, line in enumerate((t or "").replace("\r\n", "\n").split("\n")):
            if anchors & set(words(line)):
                g = set(license_scan.grams(words(line)))
                best = {}
                for f, s in license_scan.ALL_STATEMENTS:
                    n = len(g & set(s))
                    best[f] = max(best.get(f, 0), round(max(n / len(s), n / len(g) if n >= license_scan.LEAST else 0), 6))
                found[i, t, k] = g, best
    unlike = sorted(sorted(g & names) for g, best in found.values() if max(best.values()) <= license_scan.UNLIKE and g & names)
    names, w, b, floor = license_scan.train(unlike)
    out = {}
    for key, (g, best) in found.items():
        z = b + sum(w[j] for j, n in enumerate(names) if n in g)
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        k = int(p.argmax())
        if k < len(license_scan.FAMILIES) and p[k] >= floor:
            out[key] = license_scan.FAMILIES[k], bool(best[k] >= license_scan.MATCH)
    return out


NEAR_MISSES = ["the creative team used commons for photos", "a gpl is not a license of mine", "he lost his MIT ring and an apache blanket", "mozilla and eclipse are names", "the public domain is large", "version 3 of 3 0", "the foundation for free software gave money to the general public", "all his rights were reserved for others in law", "permission was granted by the boost committee", "copyright of the font is open to question", "3 0", "version 3"]


def test_licenses_by_hand(spark):
    rng = random.Random(15)
    rows = [(i, text(rng, "en", 12) + "\r\n" + t) for i, t in enumerate(NEAR_MISSES)]
    rows += [(100 + i, (t if i % 3 else t.upper()) + ("\n" + text(rng, "en", 9) if i % 2 else "")) for i, t in enumerate(t for f in license_scan.FAMILIES for t in license_scan.STATEMENTS[f])]
    rows += [(300 + i, "In this file: " + t + " Thanks to the team that made it.") for i, t in enumerate(t for f in license_scan.FAMILIES for t in license_scan.STATEMENTS[f][:1])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, `a.b` string, feature string")
    got = {(r.doc_id, dict(rows)[r.doc_id], r.paragraph): (r.family, r.confirmed) for r in license_scan.license_paragraphs(df).collect()}
    assert got == licences_by_hand(rows)
    assert not any(confirmed for (i, _, _), (_, confirmed) in got.items() if i < 100)
    family = {100 + i: f for i, f in enumerate(f for f in license_scan.FAMILIES for _ in license_scan.STATEMENTS[f])} | {300 + i: f for i, f in enumerate(license_scan.FAMILIES)}
    assert np.mean([(f, True) in [got.get((i, dict(rows)[i], k)) for k in (0, 1)] for i, f in family.items()]) > 0.97


def in_words(spark, good, bad, others=()):
    """Toxicity of held-out documents after training on 300 that have one of the words `good` and 60 that have one of `bad`."""
    rng = random.Random(11)
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 5]
    docs = [(i, text(rng, "en", 30) + " " + rng.choice(bad if k < 60 else good), int(k < 60)) for k, i in enumerate(ids[:360])]
    held = [i for i in range(9000, 12000) if not zlib.crc32(str(i).encode()) % 5]
    docs += [(held[k], text(rng, "en", 30) + " " + w, None) for k, w in enumerate(others)]
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    got = {r.doc_id: r.score for r in toxicity.toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect()}
    return [got[held[k]] for k in range(len(others))]


def test_toxicity_table_in_parts(spark, monkeypatch):
    docs, labels = toxic_corpus(400)
    d, lab = spark.createDataFrame(docs, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int")
    whole = {r.doc_id: r.score for r in toxicity.toxicity(d, lab).collect()}
    # words beyond the broadcast table are joined, beginnings of many words are split, a long row is read in pieces: none is lost
    for name, value in (("TABLE_BYTES", 20_000), ("TABLE_BYTES", 0), ("HOT", 5), ("BLOCK", 300)):
        with monkeypatch.context() as m:
            m.setattr(toxicity, name, value)
            other = {r.doc_id: r.score for r in toxicity.toxicity(d, lab).collect()}
        assert len(other) == len(whole) and all(np.isclose(other[i], s, atol=1e-5) for i, s in whole.items()), name


def test_kneser_ney_by_hand():
    """The ratio of a word's steps against the formula in plain code."""
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))).encode() for _ in range(60)})
    counts = np.array([[1, *(rng.choice([0, 0, 1, 2, 5, 30]) for _ in range(6))] for _ in words])
    flat, off = np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in words])])
    t = toxicity.Trie(flat, off, counts, np.zeros(len(words), int))
    m = toxicity.FOLDS  # the model of all folds
    d = np.array([[toxicity.discounts(x) for x in y] for y in toxicity.once_to_four(t.counts)])
    full, up = np.vstack([t.counts, np.zeros((1, t.counts.shape[1]))]), np.where(t.up < 0, len(t.node), t.up)  # the root comes last
    got = toxicity.evidence(full, up, np.arange(len(t.node)), d)[:, m * len(toxicity.HOLDS)]
    n = {}
    for w, c in zip(words, counts, strict=True):
        for k, v in enumerate((1, c[1:4].sum(), c[4:7].sum())):
            for p in [*(w[:i] for i in range(len(w) + 1)), w + b"$"]:
                n[k, p] = n.get((k, p), 0) + v

    def p(k, prefix, step):
        after = {x for (j, x) in n if j == 0 and len(x) == len(prefix) + 1 and x.startswith(prefix)}
        shared = n[0, step] / sum(n[0, x] for x in after)
        total = sum(n[k, x] for x in after)
        cut = lambda c: min(c, d[m][k - 1][min(int(c), 3)])
        return (n[k, step] - cut(n[k, step]) + sum(cut(n[k, x]) for x in after) * shared) / total if total else shared

    for i, w in enumerate(words):
        steps = [w[:j] for j in range(1, len(w) + 1)] + [w + b"$"]
        want = sum(np.log(p(2, s[:-1], s)) - np.log(p(1, s[:-1], s)) for s in steps)
        assert np.isclose(got[t.at[t.word == i]].sum(), want, atol=1e-4), w
    assert np.isclose(toxicity.statistic(np.array([30.0]), np.array([100.0]), np.array([10.0]), np.array([100.0]))[0], 2 * (30 * np.log(1.5) + 70 * np.log(0.875) + 10 * np.log(0.5) + 90 * np.log(1.125)))


def test_toxicity_reads_words_to_their_end(spark):
    good, bad = ["gemeinsamkeiten", "международный"], ["gemeinsavile", "международvile"]
    scores = in_words(spark, good, bad, good + bad)
    assert max(scores[:2]) < 0.5 <= min(scores[2:]), scores


def test_toxicity_rare_steps_count(spark):
    # each toxic word is in 4 documents, fewer than the six that a step once needed
    bad = [f"{c}{c}vyk" for c in "bdfghjklmnprstz"]
    scores = in_words(spark, ["plain", "calm"], bad, [bad[0], bad[7], "plain", "calm"])
    assert min(scores[:2]) > max(scores[2:]), scores


def test_long_words_are_learned_from():
    pieces = language_id.read_pieces(PATH)
    lattice = language_id.Lattice(pieces)
    rng = np.random.default_rng(2)
    t = np.vstack([rng.dirichlet(np.ones(len(pieces)), 2).T, np.zeros(2)])
    words = ["漢字仮名交じり文の長い一続きの文", "thing" * 30, "überein" * 9, "x" * 41, "ation"]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    w, _, _ = language_id.block_words(data, np.array([0, len(data)]), np.array([1]))
    w.look_up(lattice)
    assert all(x.tobytes().decode() for x in (w.flat[b : b + n] for b, n in zip(w.base, w.size, strict=True)))  # cut between characters
    e = language_id.expected(w, t)
    assert np.isclose(sum(e[1, i] * len(p) for i, p in enumerate(pieces)), sum(len(x.encode()) + 1 for x in words)) and e[0].sum() == 0


def test_scripts_without_spaces(spark):
    rng = random.Random(6)
    alphabets = {"aa": [chr(0x4E00 + i) for i in range(300)], "bb": [chr(0x5E00 + i) for i in range(300)]}
    rows = [(i, "".join(rng.choice(alphabets[lang]) for _ in range(60)), lang) for i in range(300) for lang in [("aa", "bb")[i % 2]]]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PATH).collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 60 and np.mean([r.lang_pred == rows[r.doc_id][2] for r in held]) > 0.95


def test_long_rows_in_ranges(monkeypatch):
    rng = random.Random(5)
    rows = [text(rng, "en", n) for n in (5, 900, 3)]
    off = np.concatenate([[0], np.cumsum([len(r.encode()) for r in rows])])
    data = np.frombuffer("".join(rows).encode(), np.uint8)
    monkeypatch.setattr(language_id, "BLOCK", 200)
    seen = {}
    for i, j, d, o in language_id.blocks(data, off):
        w, inverse, at = language_id.block_words(d, o)
        for r in range(i, j):
            seen[r] = seen.get(r, []) + list(w.key[inverse[at[r - i] : at[r - i + 1]]])
    monkeypatch.setattr(language_id, "BLOCK", 1 << 20)
    w, inverse, at = language_id.block_words(data, off)
    assert all(seen[r] == list(w.key[inverse[at[r] : at[r + 1]]]) for r in range(3))


def test_em_by_hand(spark):
    """One round of training over the whole operator, against sums over all segmentations in plain code."""
    rows = [(i, t, "aa") for i, t in enumerate(["the thing", "then, the ation", "überein"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = language_id.fit(df, PATH, rounds=1, smooth=0.0)
    index, p = {x: i for i, x in enumerate(m.vocab)}, np.full(len(m.vocab), 1.0 / len(m.vocab))
    want = np.zeros(len(p))
    for word in (b" the", b" thing", b" then", b" the", b" ation", " überein".encode()):
        whole = by_segmentations(word, index, p)
        for i in range(len(word)):
            for j in range(i + 1, len(word) + 1):
                if word[i:j] in index:
                    want[index[word[i:j]]] += by_segmentations(word[:i], index, p) * p[0] * by_segmentations(word[j:], index, p) / whole
    assert np.allclose(m.table[:-1, 0], want / want.sum())
