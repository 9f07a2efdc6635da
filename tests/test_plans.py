"""Front ends, context assembly, streams, and the catalogue against its SQL twins."""

import os

import pytest
from pyspark.sql import functions as F

from fathomdf.plans import catalogue, compact_query, context
from fathomdf.streaming import triggers

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def talk(spark):
    df = spark.createDataFrame([(1, i, "user" if i % 2 else "assistant", f"message number {i}", [float(i), 1.0]) for i in range(12)], "doc_id long, turn long, role string, text string, embedding array<double>")
    df = df.withColumn("doc_id", F.col("turn") + 1)
    df.createOrReplaceTempView("talk")
    return df


SQL = """CONTEXT SELECT prompt FROM session('s1') WITH (token_limit = {n}, truncation = '{t}', format = 'toon')
SECTIONS (
  NOTE PRIORITY 0: 'be brief, please',
  LATEST PRIORITY 1: LAST 3 FROM talk WHERE role = 'user',
  FACTS PRIORITY 2: SELECT turn, text FROM talk WHERE turn < 3 ORDER BY turn,
  NEAR PRIORITY 3: SEARCH talk BY TEXT 'number 7' TOP 2,
  WHO PRIORITY 4: GET user.profile.{{name,mail}},
  HELLO PRIORITY 5: $greeting
);"""


def test_context(spark, talk):
    a = context.Assembler(spark, {"user": {"profile": {"name": "Ann", "mail": "a@x", "age": 3}}}, {"greeting": "hi there"})
    q = context.parse(SQL.format(n=2048, t="tail_drop"))
    assert [p.kind for p in q.parts] == ["literal", "last", "select", "search", "get", "variable"] and q.session == "s1" and q.options["token_limit"] == 2048
    text, used = a.run(SQL.format(n=2048, t="tail_drop"))
    assert text.index("be brief") < text.index("latest[3]") < text.index("facts[3]") < text.index("near[2]") < text.index("name: Ann") < text.index("hi there")
    assert "11,user" in text and "age: 3" not in text and sum(used.values()) <= 2048
    short, used = a.run(SQL.format(n=40, t="tail_drop"))
    assert sum(used.values()) <= 40 and len(short.encode()) <= 40 * 4 and "be brief" in short
    assert a.run(SQL.format(n=40, t="head_drop"))[0] and sum(a.run(SQL.format(n=60, t="proportional"))[1].values()) <= 60
    with pytest.raises(ValueError):
        a.run(SQL.format(n=10, t="fail"))
    with pytest.raises(KeyError):
        context.Assembler(spark).run("CONTEXT SELECT p SECTIONS (X: $missing)")
    for bad in ("SELECT 1", "CONTEXT SELECT p SECTIONS (X: FROB 1)"):
        with pytest.raises(ValueError):
            context.parse(bad)
    assert context.path_get({"a": {"b": {"c": 1}}}, "a.**") == {"b": {"c": 1}} and context.path_get({"a": 1}, "a.x") is None
    r = context.Recipes()
    assert (r.save("p", SQL.format(n=9, t="fail")), r.save("p", SQL.format(n=8, t="fail"))) == (1, 2) and "= 8" in r.get("p") and "= 9" in r.get("p", 1) and r.frame(spark).count() == 2
    chunks = list(context.stream(talk.select("turn", "text"), "t", 20))
    assert chunks[0][0] == "header" and chunks[-1][0] == "complete" and chunks[-1][1] <= 20 and 1 < len(chunks) < 12


def test_compact_query(spark, talk):
    run = lambda q, **k: [r[0] for r in compact_query.run(spark, q, **k).collect()]
    assert run("SELECT turn FROM talk WHERE role = 'user' AND turn > 6 ORDER BY turn DESC LIMIT 2") == [11, 9]
    assert run("SELECT turn FROM talk WHERE turn = 1 OR turn IN (3, 4) ORDER BY turn OFFSET 1") == [3, 4]
    assert run("SELECT turn FROM talk WHERE text LIKE '%number 1_' ORDER BY turn") == [10, 11]
    assert run("SELECT turn FROM talk WHERE role = 'user' AND text SIMILAR TO 'x' LIMIT 1", embed=lambda t: [1.0, 0.0]) == [11]
    assert run("SELECT * FROM talk WHERE VECTOR_SEARCH(embedding, [0, 1], 2, cosine)") == [1, 2]
    for bad in ("DELETE FROM talk", "SELECT a FROM talk WHERE a ~ 1", "SELECT turn FROM talk WHERE text SIMILAR TO 'x'"):
        with pytest.raises(ValueError):
            compact_query.run(spark, bad)


def test_context_transforms(spark, talk):
    a = context.Assembler(spark, summarise=lambda text, n: f"{n}:{len(text)}")
    run = lambda body, a=a: a.text(context.parse(f"CONTEXT SELECT p SECTIONS (X: {body})").parts[0], "toon")
    rows = "SELECT turn, text FROM talk WHERE turn < 2 ORDER BY turn"
    assert run(f"{rows} THEN PROJECT (turn)") == "x[2]{turn}:\n0\n1"
    assert run(f"{rows} THEN TEMPLATE 'it''s {{turn}}, {{text}}'") == "it's 0, message number 0\nit's 1, message number 1"
    assert run("'one\ntwo' THEN SUMMARIZE 1").startswith("1:")
    assert run(f"{rows} THEN SUMMARIZE 1 THEN PROJECT (turn)", context.Assembler(spark)) == "x[1]{turn}:\n0"
    with pytest.raises(ValueError):
        run("'words' THEN PROJECT (a)")


def test_path_query(spark):
    from fathomdf.plans.path_query import PathQuery

    spark.createDataFrame([(1, ("x", 5)), (2, ("y", 7)), (3, ("z", 9))], "id int, place struct<name: string, floor: int>").createOrReplaceTempView("rooms")
    q = PathQuery(spark, "rooms")
    assert [tuple(r) for r in q.into("place").where("ge", "floor", 7).order("floor", desc=True).rows().collect()] == [("z", 9), ("y", 7)]
    assert [r[0] for r in q.into("place").into("name").order("name").limit(1, 1).rows().collect()] == ["y"]
    assert [r.id for r in q.where("lt", "id", 3).where("ne", "id", 1).project("id").rows().collect()] == [2] and q.atoms == ()


def test_compact_query_quotes(spark, talk):
    spark.createDataFrame([(1, "salt and pepper", [1.0, 0.0]), (2, "this or that", [0.9, 0.1]), (3, "it's", [0.0, 1.0])], "id int, v string, embedding array<double>").createOrReplaceTempView("quoted")
    run = lambda q: [tuple(r) for r in compact_query.run(spark, q).collect()]
    assert run("SELECT id FROM quoted WHERE v = 'salt and pepper'") == [(1,)]
    assert run("SELECT id FROM quoted WHERE v = 'this or that' OR v = 'it''s' ORDER BY id") == [(2,), (3,)]
    assert run("SELECT id FROM quoted WHERE id = 3 OR id = 1 AND v LIKE 'salt%' ORDER BY id DESC") == [(3,), (1,)]
    assert run("SELECT id FROM quoted WHERE NOT (id = 3 OR id BETWEEN 1 AND 1) AND v IS NOT NULL") == [(2,)]
    assert run("SELECT v, VECTOR_SEARCH(embedding, [1, 0], 2, l2) FROM quoted WHERE id > 1 LIMIT 1") == [("this or that", 0.141421)]


def test_stream_matches_batch(spark, tmp_path):
    src = spark.createDataFrame([(i, f"u{i % 3}", 1_700_000_000 + i * 7) for i in range(60)], "event_id long, user_id string, s long").select("event_id", "user_id", F.timestamp_seconds("s").alias("ts"))
    src.repartition(1).write.parquet(f"{tmp_path}/in")
    stream = triggers.read(spark, f"{tmp_path}/in", src.schema)
    limited = triggers.rate_limit(stream, "user_id", "ts", "event_id", 2, 60)
    got = []
    q = triggers.to_batches(limited, lambda df, _: got.extend(df.collect()), f"{tmp_path}/c1")
    q.awaitTermination(120)
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id", F.floor(F.unix_seconds("ts") / 60)).orderBy("ts", "event_id")
    want = {r.event_id for r in src.withColumn("n", F.row_number().over(w)).where("n <= 2").collect()}
    assert {r.event_id for r in got} == want
    windows = triggers.tumbling(stream, "ts", "1 minute", "0 seconds", ["user_id"], F.count("*").alias("n"))
    q = triggers.to_parquet(windows, f"{tmp_path}/out", f"{tmp_path}/c2")
    q.awaitTermination(120)
    done = {(r.window.start, r.user_id): r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = {(r.window.start, r.user_id): r.n for r in src.groupBy(F.window("ts", "1 minute"), "user_id").agg(F.count("*").alias("n")).collect()}
    assert done and all(batch[k] == n for k, n in done.items())
    for fn in (lambda s: triggers.sessions(s, "ts", "5 seconds", "1 minute", ["user_id"], F.count("*").alias("n")), lambda s: triggers.sliding(s, "ts", "1 minute", "30 seconds", "1 minute", [], F.count("*").alias("n")), lambda s: triggers.distinct(s, "ts", "1 minute", ["event_id"])):
        assert fn(stream).isStreaming


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["scan_filter_project", "filter_ir", "join_multi", "asof_latest", "overlap_join", "window_groups_frame", "knn_batch", "bm25_or", "cascade", "bfs_depth", "metrics_view", "compact_where", "constraints", "stored_table", "hybrid", "semantic_cache", "context_search", "quantile_bound", "session_windows", "cardinality_drift", "inverted_lists_recall", "path_door", "table_function", "piece_count", "ttl_live", "context_template"])
def test_catalogue(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in catalogue.register.__globals__["TABLES"]:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    a, b = catalogue.QUERIES[name](spark, DATA), con.sql(catalogue.ORACLE[name])
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    num = lambda v: round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    one = sorted((tuple(num(r[c]) for c in cols) for r in a.collect()), key=str)
    two = sorted((tuple(num(v) for v in r) for r in b.project(", ".join(f'"{c}"' for c in cols)).fetchall()), key=str)
    assert one == two


def test_entry_without_corpus_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['fathomdf.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'rrf' in q and not any(k.startswith('op') for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_cast_ops_casts_every_order(spark):
    orders = spark.read.parquet(f"{DATA}/orders.parquet")
    want = {r.o_orderkey: (int(r.o_totalprice), str(r.o_orderdate)[:10], str(r.o_orderkey), None) for r in orders.collect()}
    got = catalogue.QUERIES["cast_ops"](spark, DATA).collect()
    assert len(got) == len(want) and {r.o_orderkey: (r.p, r.day, r.k, r.nope) for r in got} == want


def test_adaptive_sketch_returns_hot_users(spark, tmp_path):
    import random

    rng = random.Random(6)
    rows = [(u, rng.lognormvariate(0, 2)) for u, n in (("few", 9), ("edge", 128), ("hot", 30_000)) for _ in range(n)]
    spark.createDataFrame(rows, "user_id string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.user_id: r.median for r in catalogue.QUERIES["adaptive_sketch"](spark, str(tmp_path)).collect()}
    assert set(got) == {"few", "edge", "hot"}
    for user, median in got.items():
        values = sorted(v for u, v in rows if u == user)
        n = len(values)
        if n <= 128:
            assert abs(median - (values[(n - 1) // 2] + values[n // 2]) / 2) < 1e-6
        else:  # percentile_approx states a rank error of 1 / 10,000
            rank = sum(v <= median + 1e-6 for v in values)
            assert abs(rank - n / 2) <= n / 10_000 + 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_inverted_index_has_every_term(spark):
    import re
    from collections import Counter

    df, tf = Counter(), Counter()
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        words = [w for w in re.split(r"[ \t\n\r\f\x0b]+", (r.text or "").lower()) if w]
        df.update(set(words))
        tf.update(words)
    got = {r.term: (r.df, r.tf) for r in catalogue.QUERIES["inverted_index"](spark, DATA).collect()}
    assert min(df.values()) == 1 and got == {w: (n, tf[w]) for w, n in df.items()}


def twins(spark, folder, name, **tables):
    """Sorted rows of a query and of its SQL over the given tables, written out so that -0.0 differs from 0.0."""
    con = pytest.importorskip("duckdb").connect()
    for t, df in tables.items():
        df.write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    a = catalogue.QUERIES[name](spark, str(folder))
    b = con.sql(f"select {', '.join(a.columns)} from ({catalogue.ORACLE[name]})")
    return sorted(repr(tuple(r)) for r in a.collect()), sorted(repr(r) for r in b.fetchall())


def test_embedding_rollup_signs_ties_and_nulls(spark, tmp_path):
    rows = [(1, [-1e-6] * 64, 1), (2, [2e-6, -0.25] * 32, 2), (3, [-4e-6, None] * 32, 2), (4, None, 2), (5, [1.5, -2.5] * 40, 3), (6, [0.5] * 3, None), (7, None, 4)]
    rows += [(10 + k, [float(k), -k / 3] * 32, 5) for k in range(7)]
    rows += [(20 + k, [0.015625 * (2 * k + i + 1) / 10 for i in range(64)], 20 + k) for k in range(50)]
    one, two = twins(spark, tmp_path, "embedding_rollup", embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert one == two and "-0.0," in two[0] and len(one) == 56


@pytest.mark.parametrize("x", [-1e-6, -0.0, 0.0, 4e-6, -5e-6, -4.667545, 18.797015, 0.123455, 1e300, float("inf"), float("nan"), None])
def test_rounded_is_the_twins_round(spark, x):
    con = pytest.importorskip("duckdb").connect()
    got = spark.createDataFrame([(x,)], "x double").select(catalogue.rounded(F.col("x"), 5)).first()[0]
    assert repr(got) == repr(con.execute("select round(?::double, 5)", [x]).fetchall()[0][0])


def test_overlap_join_takes_the_nearest_second(spark, tmp_path):
    import datetime as dt

    micros = (-500_001, -500_000, -1, 0, 1, 499_999, 500_000, 500_001, 999_999)
    rows = [(p, dt.datetime(y, 1, 1, 12) + dt.timedelta(microseconds=m), u, "purchase") for u, y in ((1, 2024), (2, 1960), (None, 2024)) for p, m in enumerate(micros, 100 * (u or 3))]
    rows += [(1000 + i, t + dt.timedelta(seconds=s + odd, microseconds=m), u, "error") for i, (_, t, u, _) in enumerate(rows) for s in (3600, -7200) for odd in (0, 1) for m in micros]
    rows += [(5000, None, 1, "purchase"), (5001, None, 1, "error")]
    one, two = twins(spark, tmp_path, "overlap_join", events=spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string"))
    assert one == two and two


def test_time_bucket_takes_the_nearest_millisecond(spark, tmp_path):
    import datetime as dt

    micros = (-1501, -1500, -501, -500, -499, -1, 0, 1, 499, 500, 1500)
    rows = [(h + dt.timedelta(microseconds=m), k + 0.01) for h in (dt.datetime(2024, 1, 1, 1), dt.datetime(2024, 7, 1), dt.datetime(1970, 1, 1), dt.datetime(1969, 12, 31, 22)) for k, m in enumerate(micros)]
    rows += [(dt.datetime(2024, 2, 1, h), v) for h, v in ((1, -1e-5), (2, 1e-5), (3, None), (4, -46.67545), (5, 1.23455), (6, float("nan")))] + [(None, 3.0)]
    one, two = twins(spark, tmp_path, "time_bucket", events=spark.createDataFrame(rows, "ts timestamp_ntz, value double"))
    assert one == two and len(one) == 14
