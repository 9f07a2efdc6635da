import random

import pytest

from fathomdf.llm import queries, token_counts

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")
PATH = queries.vocabulary(queries.TOKENIZER)


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def samples():
    rng = random.Random(5)
    letters = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "'", "'re", "'s", "é", "ß", "漢", "🙂", "1", "23", "!", "...", "<|endoftext|>", " ", "́", "Z"]
    fixed = ["", " ", "   ", " \n", "a   b", "don't", "''re", "x'rex", "a\r\n\r\nb", "<|endoftext|>", "a<|endoftext|>b", "<|endoftext", "-" * 300, "aaaa" * 90, "été où", "a \nb", "\x00\x01"]
    return fixed + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 25))) for _ in range(300)]


def test_whole_and_every_prefix(library):
    c = token_counts.Counter(PATH)
    for t in samples():
        n = lambda x: len(library.encode(x, add_special_tokens=False).ids)
        assert c.count(t) == n(t), t
        if len(t) < 120:
            assert c.prefixes(t).tolist() == [n(t[:i]) for i in range(len(t) + 1)], t


def test_long_texts_in_stretches(library, monkeypatch):
    monkeypatch.setattr(token_counts, "STRETCH", 20)
    c = token_counts.Counter(PATH)
    n = lambda x: len(library.encode(x, add_special_tokens=False).ids)
    t = "".join(samples())
    for text in (t[:1500], "a  <|endoftext|> b " * 12, "x" * 90 + "  \n" * 30 + "don't  " * 9):
        assert c.prefixes(text).tolist() == [n(text[:i]) for i in range(len(text) + 1)]
        assert c.answers(text, (30,)) == (len(text), n(text), [c.fit(text, 30)])


def test_books_are_bounded(monkeypatch):
    c, small = token_counts.Counter(PATH), token_counts.Counter(PATH)
    want = [c.prefixes(t).tolist() for t in samples()]
    monkeypatch.setattr(token_counts, "CACHE", 10)
    assert [small.prefixes(t).tolist() for t in samples()] == want and len(small.index) < 200


def test_fit(library):
    c = token_counts.Counter(PATH)
    t = "the hehetion tist  don't edanat 123 stat estish" * 3
    for budget in (0, 1, 5, 17, 10_000):
        i = c.fit(t, budget)
        n = lambda x: len(library.encode(x, add_special_tokens=False).ids)
        assert n(t[:i]) <= budget and all(n(t[:j]) > budget for j in range(i + 1, len(t) + 1))


def test_rows(spark, library):
    rows = [(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "a b c", "z"), (3, "word " * 3000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(token_counts.token_counts(df, PATH, budgets=(10,)).collect(), key=str)
    assert len(got) == 5
    by = {r.doc_id: r for r in got}
    assert by[1].n_tokens == by[2].n_tokens == 0 and by[None].n_tokens == 3 and by[3].n_bytes == 15000
    assert by[3].n_tokens == len(library.encode("word " * 3000).ids) and by[3].fit_10 < 60
    assert token_counts.token_counts(df.limit(0), PATH).count() == 0
    stored = token_counts.prefix_tables(df, PATH)
    assert stored.where("doc_id is null").first().prefix_tokens[-1] == 3
    asked = stored.where("doc_id = 3").select(token_counts.fit_expr(stored.prefix_tokens, 10).alias("fit")).first()
    assert asked.fit == by[3].fit_10 and by[3].n_chars == 15000
