"""Operators of the engine against small tables whose answers are known."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomdf.functions import calc as calc_
from fathomdf.functions import tokens, toon
from fathomdf.operators import agents, filters, fusion, graph, lexical, sketches, tables, vector
from fathomdf.sources import catalog, vectors, virtual


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame([(1, "Ann", "a@x", 30, 1), (2, "Bob", "b@x", 25, 1), (3, "Cy", None, 35, 0), (4, "Di", "d@x", 28, 1), (5, "Ed", "e@x", None, 0)], "id long, name string, email string, age long, active long")


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


def test_filters(users):
    B = filters.Build
    assert ids(B().ge("age", 28).filter.apply(users)) == [1, 3, 4]
    assert ids(B().ge("age", 28).filter.negate().apply(users)) == [2]
    assert ids(B().between("age", 25, 30).eq("active", 1).filter.apply(users)) == [1, 2, 4]
    f = B().between("age", 26, 30).eq("active", 1).filter
    assert ids(f.negate().apply(users)) == [2, 3, 5]  # inactive decides for the null age
    assert ids(B().any(filters.Atom("is_null", "email"), filters.Atom("prefix", "name", "B")).filter.apply(users)) == [2, 3]
    assert ids(filters.Filter().apply(users)) == [1, 2, 3, 4, 5]
    assert ids(filters.Filter().negate().apply(users)) == []
    assert filters.Filter(((filters.Atom("true"),), (filters.Atom("false"), filters.Atom("eq", "id", 1)))).simplify().clauses == ((filters.Atom("eq", "id", 1),),)
    assert ids(B().prefix("name", "A").filter.negate().apply(users)) == [2, 3, 4, 5]
    assert ids(B().eq("id", 1).filter.either(B().eq("id", 2).filter).apply(users)) == [1, 2]
    scoped = filters.Scope(tenant="t1", tags=("x", "y"))
    df = users.withColumn("tenant", F.when(F.col("id") < 4, "t1").otherwise("t2")).withColumn("acl_tags", F.array(F.when(F.col("id") == 1, "x").otherwise("z")))
    assert ids(scoped.apply(df)) == [1]


def test_changes(spark, users):
    t = tables.Table(users, "id")
    assert t.update("age > 28", age="age + 1").find(1).first().age == 31 and t.update("age > 28", age="age + 1").find(5).first().age is None
    assert ids(t.delete("age > 26").rows()) == [2, 5]
    new = spark.createDataFrame([(5, "Eve", "e@y", 40, 1), (6, "Flo", "f@x", 22, 1)], users.schema)
    assert {r.id: r.name for r in t.upsert(new, "nothing").rows().collect()}[5] == "Ed"
    assert {r.id: r.name for r in t.upsert(new, "replace").rows().collect()} == {1: "Ann", 2: "Bob", 3: "Cy", 4: "Di", 5: "Eve", 6: "Flo"}
    u = {r.id: r for r in tables.upsert(users, new, ["id"], "update", ["age"]).collect()}
    assert (u[5].name, u[5].age, u[6].name) == ("Ed", 40, "Flo")
    assert t.eq("active", 1).order("age", True).limit(1).first().id == 1 and t.count() == 5 and t.gt("age", 34).exists()
    assert [r.id for r in tables.last_n(users, 2, "age").collect()] == [3, 1]
    assert tables.token_limit(100, 1050, 20) == 50 and tables.token_limit(None, 10, 20) == 0
    assert ids(tables.run_sql(spark, "SELECT * FROM u WHERE age > $2 AND active = $1", [1, 26], u=users)) == [1, 4]
    with pytest.raises(ValueError):
        tables.run_sql(spark, "SELECT $3", [1])


@pytest.mark.parametrize(("sql", "action", "kind"), [
    ("INSERT INTO t VALUES (1) ON CONFLICT (id) DO NOTHING", "nothing", "postgres"), ("INSERT IGNORE INTO t VALUES (1)", "nothing", "mysql"), ("INSERT OR REPLACE INTO t VALUES (1)", "replace", "sqlite"),
    ("INSERT INTO t VALUES (1) ON DUPLICATE KEY UPDATE a = 1", "update", "mysql"), ("INSERT INTO t VALUES (1)", "error", "ansi"),
])
def test_dialects(sql, action, kind):
    assert tables.conflict_action(sql) == ("INSERT INTO t VALUES (1)", action) and tables.dialect(sql) == kind


def test_latest_and_visible(spark):
    v = spark.createDataFrame([("a", 5, 1, "x"), ("a", 9, 2, "y"), ("a", 0, 7, "mine"), ("b", 12, 3, "late")], "k string, commit_ts long, txn_id long, v string")
    assert [(r.k, r.v) for r in tables.latest(tables.visible(v, 10), ["k"], "commit_ts").collect()] == [("a", "y")]
    assert {r.v for r in tables.visible(v, 9, 7).collect()} == {"x", "mine"}


def test_vectors(spark):
    e = [(1, [1.0, 0.0], 0), (2, [0.0, 2.0], 0), (3, [3.0, 3.0], 1), (4, [0.0, 0.0], 1), (5, [1.0, 0.0], 1)]
    df = spark.createDataFrame(e, "vec_id long, embedding array<float>, label int")
    assert [r.vec_id for r in vector.knn(df, [1, 0], 2).collect()] == [1, 5]
    assert vector.knn(df, [1, 0], 5).where("vec_id = 4").first().score == 0
    assert [r.vec_id for r in vector.knn(df, [1, 0], 2, "dot").collect()] == [3, 1] and [r.vec_id for r in vector.knn(df, [0, 1], 1, "l2").collect()] == [2]
    assert [r.vec_id for r in vector.knn(df, [1, 0], 9, where=F.col("label") == 1, min_score=0.5).collect()] == [5, 3]
    q = df.where("vec_id in (1, 2)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    for m in vector.METRICS:
        got = {(r.query_id, r.id, r.score) for r in vector.knn_batch(df, q, 3, m).collect()}
        want = {(i, r.vec_id, r.score) for i in (1, 2) for r in vector.knn(df, e[i - 1][1], 3, m).collect()}
        assert got == want, m
    assert {r.id for r in vector.knn_batch(df, q, 4, self_pairs=False).where("query_id = 1").collect()} == {2, 3, 4, 5}
    mv = {r.label: (r.score, r.best_chunk) for r in vector.multi_vector(vector.score(df, [1, 0], "dot"), "label", "vec_id", "sum").collect()}
    assert mv == {0: (1.0, 1), 1: (4.0, 3)}
    r = df.select("vec_id", vector.quantise(vector.doubles(F.col("embedding"))).alias("q")).select("vec_id", vector.dequantise(F.col("q")).alias("v")).where("vec_id = 2").first()
    assert r.v == [0.0, 2.0]
    n = df.select(vector.normalise(vector.doubles(F.col("embedding"))).alias("n")).collect()
    assert n[2].n == pytest.approx([math.sqrt(0.5)] * 2) and n[3].n == [0, 0]


def test_approximate_search(spark):
    rng = np.random.default_rng(1)
    data = [(i, [float(x) for x in v]) for i, v in enumerate(rng.standard_normal((12, 16))[rng.integers(0, 12, 600)] + 0.1 * rng.standard_normal((600, 16)))]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").cache()
    q = data[7][1]
    exact = vector.knn(df, q, 10)
    inv = vector.Inverted(df, 12)
    assert vector.recall(inv.search(q, 10, 3), exact, ["vec_id"]) >= 0.9
    pq = vector.ProductQuantiser(df, 8, 16)
    coarse = pq.encode(df).withColumn("d", pq.distance(F.col("code"), q)).orderBy("d").limit(80)
    assert vector.recall(vector.rerank(coarse, q, 10), exact, ["vec_id"]) >= 0.8
    back = pq.encode(df).select(vector.l2(pq.decode(F.col("code")), vector.doubles(F.col("embedding"))).alias("e")).agg(F.avg("e")).first()[0]
    assert back < 1.0
    p = vector.project(df, 8)
    assert p.select(F.size("projected")).distinct().first()[0] == 8
    roll = vector.roll_up(df.withColumn("g", F.col("vec_id") % 2), ["g"]).where("g = 0").first().embedding
    assert roll == pytest.approx(list(np.mean([v for i, v in data if i % 2 == 0], 0)))


def test_lexical(spark):
    docs = spark.createDataFrame([(1, "The cat sat on the mat"), (2, "a dog ate the cat food"), (3, "birds fly south"), (4, ""), (5, None)], "doc_id long, text string")
    assert {r.doc_id for r in lexical.bm25(docs, "cat dog").collect()} == {1, 2} and lexical.bm25(docs, "cat dog").first().doc_id == 2
    assert lexical.bm25(docs, "zebra").count() == 0
    assert [r.doc_id for r in lexical.bm25(docs, "cat dog", all_terms=True).collect()] == [2]
    assert [r.doc_id for r in lexical.bm25(docs, "cat zebra", all_terms=True).collect()] and {r.doc_id for r in lexical.phrase(docs, "the cat").collect()} == {1, 2}
    assert lexical.phrase(docs, "cat the").count() == 0
    one = lexical.bm25(docs, "birds", digits=9).first().score
    dl, avg = 3, (6 + 6 + 3 + 0) / 4
    assert one == pytest.approx(lexical.idf(5, 1) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * dl / avg)), abs=1e-6)
    assert docs.select(lexical.tokens(F.lit("Don't stop!  x"), minimal=True).alias("t")).first().t == ["don", "stop"]
    assert lexical.over_fetch(10) == 100 and lexical.over_fetch(50) == 150


def test_fusion(spark):
    a = spark.createDataFrame([(1, 0.9), (2, 0.8), (3, 0.7)], "id long, score double")
    b = spark.createDataFrame([(2, 5.0), (4, 3.0), (1, 1.0)], "id long, score double")
    s = {r.id: r.score for r in fusion.rrf([a, b], digits=9).collect()}
    assert s[2] == pytest.approx(1 / 62 + 1 / 61) and s[1] == pytest.approx(1 / 61 + 1 / 63) and max(s, key=s.get) == 2
    lin = {r.id: r.score for r in fusion.linear([a, b], (0.5, 0.5)).collect()}
    assert lin == pytest.approx({1: 0.5, 2: 0.75, 3: 0.0, 4: 0.25})
    one = spark.createDataFrame([(9, 3.0)], "id long, score double")
    assert fusion.linear([one], (2.0,)).first().score == 2.0
    assert {r.id: r.score for r in fusion.greatest([a, b]).collect()} == pytest.approx({1: 1.0, 2: 1.0, 3: 0.0, 4: 0.5})
    assert {r.id: r.score for r in fusion.cascade(a, b).collect()} == {1: 1.0, 2: 5.0, 3: -2.0}
    assert {r.id: r.score for r in fusion.raw_fusion([a, b], "mean").collect()}[2] == 2.9
    d = spark.range(1).select(fusion.decay(F.lit(86400.0)).alias("a"), fusion.decay(F.lit(-5.0)).alias("b"), fusion.decay(F.lit(1e9)).alias("c"), fusion.decayed(F.lit(1.0), F.lit(0.0)).alias("d")).first()
    assert tuple(d) == pytest.approx((0.5, 1.0, 0.01, 1.0))
    entries = spark.createDataFrame([("q1", [1.0, 0.0], "n", 5, 100, ["s1"]), ("q2", [0.0, 1.0], "n", 5, 10, ["s2"])], "query string, embedding array<double>, namespace string, allowed_hash long, expires_at long, sources array<string>")
    assert fusion.cache_lookup(entries, "other", [0.99, 0.05], "n", 5, 50).first()["query"] == "q1" and fusion.cache_lookup(entries, "q2", [0.0, 1.0], "n", 5, 50).count() == 0
    assert fusion.cache_without(entries, "s1", 5).first()["query"] == "q2"
    x, y = fusion.id_set_hash(a, "id").first(), fusion.id_set_hash(a.orderBy(F.desc("id")).union(a), "id").first()
    assert x == y and x != fusion.id_set_hash(b, "id").first()


def test_hybrid(spark):
    docs = spark.createDataFrame([(1, "red fox", [1.0, 0.0], "a"), (2, "blue fox", [0.9, 0.1], "a"), (3, "red red", [0.0, 1.0], "b")], "doc_id long, text string, embedding array<double>, lang string")
    for how in ("rrf", "linear", "max", "cascade"):
        got = [r.id for r in fusion.hybrid(docs, [1, 0], "red", 2, how=how).collect()]
        assert got[0] in (1, 3) and len(got) == 2
        assert set(r.id for r in fusion.hybrid(docs, [1, 0], "red", 3, where=F.col("lang") == "a", how=how).collect()) <= {1, 2}


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(1, 2, "k"), (2, 3, "k"), (3, 1, "k"), (3, 4, "m"), (4, 5, "k"), (6, 6, "k"), (1, 4, "z")], "src long, dst long, type string")


def test_graph(spark, edges):
    assert {r.id: r.depth for r in graph.bfs(edges, [1], 2).collect()} == {1: 0, 2: 1, 4: 1, 3: 2, 5: 2}
    assert {r.id for r in graph.bfs(edges, [1], 9, edge_types=["k"]).collect()} == {1, 2, 3}
    nodes = spark.createDataFrame([(i, "t" if i != 4 else "u") for i in range(1, 7)], "id long, type string")
    assert {r.id for r in graph.bfs(edges, [1], 9, nodes=nodes, node_types=["t"]).collect()} == {1, 2, 3}
    assert graph.shortest_path(edges, 1, 5) == [1, 4, 5] and graph.shortest_path(edges, 5, 1) is None and graph.shortest_path(edges, 5, 1, direction="both") == [5, 4, 1]
    assert graph.shortest_path(edges, 6, 6) == [6]
    assert graph.dfs(edges, 1, 9) == [1, 2, 3, 4, 5] and graph.dfs(edges, 6, 3) == [6]
    assert {(r.id, r.direction) for r in graph.neighbours(edges, 4, "both").collect()} == {(5, "out"), (3, "in"), (1, "in")}
    assert graph.subgraph(edges, spark.createDataFrame([(1,), (2,), (4,)], "id long")).count() == 2


def test_temporal(spark):
    e = spark.createDataFrame([(1, 2, "k", 10, 20), (1, 3, "k", 20, None), (3, 4, "k", 5, 25)], "src long, dst long, type string, valid_from long, valid_to long")
    assert {r.dst for r in graph.edges_at(e, 20, 1).collect()} == {3} and {r.dst for r in graph.edges_at(e, 19).collect()} == {2, 4}
    assert {r.dst for r in e.where(graph.overlaps(20, 21)).collect()} == {3, 4} and {r.dst for r in e.where(graph.overlaps(0, 10)).collect()} == {4}
    assert [r.valid_from for r in graph.history(e, 1).collect()] == [10, 20]
    nodes, inside = graph.subgraph_at(e, 1, 22, 1)
    assert ids(nodes) == [1] and ids(inside, "dst") == [3]
    a = spark.createDataFrame([(0, 10), (5, 30), (7, 7)], "start long, end long")
    b = spark.createDataFrame([(9, 12), (30, 40), (0, 100)], "start2 long, end2 long")
    got = sorted((r.start, r.start2) for r in graph.interval_join(a, b, 8).collect())
    assert got == [(0, 0), (0, 9), (5, 0), (5, 9)]
    f = spark.createDataFrame([("a", 1, 1.0), ("a", 5, 2.0)], "k string, ts long, value double")
    ev = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("a", 9, 3), ("b", 9, 4)], "k string, t long, e long")
    assert {r.e: r.as_of for r in graph.as_of(f, ev, "k", "ts", "t", "value").collect()} == {1: None, 2: 1.0, 3: 2.0, 4: None}
    assert spark.range(1).select(graph.bucket(F.lit(604_800_000), "week").alias("w")).first().w == 1


def test_sketches(spark):
    df = spark.range(20_000).select((F.col("id") % 1000).alias("k"), (F.col("id") % 997 + 1).cast("double").alias("x"))
    assert abs(df.agg(sketches.hll_estimate(sketches.hll("k"))).first()[0] - 1000) < 40
    s = sketches.count_min_table(df, "k")
    est = sketches.count_min_estimate(s, df.select("k").distinct(), "k").agg(F.min("estimate"), F.max("estimate")).first()
    assert est[0] >= 20 and est[1] <= 80
    dd = sketches.dd_sketch(df.withColumn("x", F.col("x") - 300), "x")
    for p in (0.01, 0.3, 0.5, 0.99):
        exact = df.withColumn("x", F.col("x") - 300).agg(F.percentile("x", F.lit(p))).first()[0]
        assert sketches.dd_quantile(dd, p).first().value == pytest.approx(exact, rel=0.03, abs=2)
    assert sketches.exponential_histogram(df, "x").agg(F.sum("n")).first()[0] == 20_000
    assert sketches.heavy_hitters(df.where("k < 3").unionByName(df.where("k = 7")), "k", 2).count() == 2
    assert df.groupBy("k").agg(sketches.adaptive_quantile("x", 0.5).alias("m")).where("m is null").count() == 0
    assert df.agg(sketches.count_min("k").alias("c")).first().c is not None and sketches.quantiles(df, "x", [0.5]).first().q


def test_agents(spark):
    t = spark.createDataFrame([(1, 2, 0, "pending", 0, 0, None), (2, 1, 0, "pending", 0, 0, None), (3, 0, 99, "pending", 0, 0, None), (4, 0, 0, "claimed", 5, 3, "w"), (5, 0, 0, "claimed", 50, 1, "w")], "task_id long, priority int, visible_at long, state string, lease_until long, attempts int, worker string")
    assert [r.task_id for r in agents.dequeue(t, 10, 3).collect()] == [4, 2, 1]
    c = {r.task_id: r for r in agents.claim(t, 10, "me", 60, 2).collect()}
    assert (c[2].state, c[2].attempts, c[2].lease_until, c[2].worker) == ("claimed", 1, 70, "me") and c[1].state == "pending"
    assert {r.task_id: r.state for r in agents.settle(t, 10, 3).collect()} == {1: "pending", 2: "pending", 3: "pending", 4: "dead_letter", 5: "claimed"}
    a = spark.createDataFrame([("x", ["c"], True, 3, 1, 9.0), ("y", ["c"], True, 1, 2, 1.0), ("z", ["d"], True, 0, 0, 0.0)], "agent_id string, capabilities array<string>, available boolean, load int, priority int, latency_ms double")
    assert [agents.route(a, "c", h).first().agent_id for h in ("least_loaded", "priority", "fastest")] == ["y", "x", "y"]
    assert {agents.route(a, "c", "round_robin", turn=i).first().agent_id for i in (0, 1)} == {"x", "y"} and agents.route(a, "c", "sticky", "u").first() == agents.route(a, "c", "sticky", "u").first()
    r = spark.createDataFrame([("r1", "read", "secret/x", "n"), ("r2", "read", "open", "n")], "request_id string, trigger string, key string, namespace string")
    rules = [{"trigger": "read", "pattern": "^secret", "outcome": "deny", "namespace": "n"}, {"trigger": "read", "pattern": ".", "outcome": "log"}]
    assert {x.request_id: x.outcome for x in agents.policy(r, rules).collect()} == {"r1": "deny", "r2": "log"}
    assert spark.range(1).select(agents.mask(F.lit("a 123 b"), [r"\d+"]).alias("m")).first().m == "a *** b"
    m = spark.createDataFrame([(i, i, "t" * 40) for i in range(25)], "ts long, n long, text string")
    assert sorted(x.n for x in agents.compact(m, 23, 10).collect()) == [3, 10, 10]
    assert agents.newest_within(m, 35, F.lit(10), [F.desc("ts")]).count() == 3


def test_calc(spark):
    df = spark.createDataFrame([(2.0, 3.0)], "a double, b double")
    for text, want in (("1 + 2 * 3", 7), ("2 ^ 3 ^ 2", 512), ("-a ^ 2", -4), ("(a + b) % 3", 2), ("if(a - 2, 1, 9)", 9), ("max(a, b, 1) + min(a, b)", 5), ("round(10 / 4, 1)", 2.5), ("avg(1, 2, 6)", 3), ("sqrt(16) + ln(exp(1)) + log2(8) + log10(100)", 10), ("atan2(0, 1) + floor(1.7) + ceil(1.2) + abs(-3)", 6)):
        assert df.select(calc_.calc(text).alias("x")).first().x == pytest.approx(want), text
    for bad in ("1 +", "foo(1)", "(1", "1 2"):
        with pytest.raises(ValueError):
            calc_.calc(bad)
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|zero"):
        df.select(calc_.calc("1 / 0")).collect()


def test_tokens(spark):
    S = tokens.Section
    assert tokens.greedy([S("a", 50, 10, 0), S("b", 80, 20, 1), S("c", 5, 1, 2)], 100) == {"a": 50, "b": 50, "c": 0}
    assert tokens.greedy([S("a", 500, 200, 0), S("b", 80, 20, 1)], 100) == {"a": 0, "b": 80}
    p = tokens.proportional([S("a", 100, 0, weight=1), S("b", 100, 0, weight=3), S("c", 10, 5, weight=1)], 100)
    assert p == {"a": 20, "b": 60, "c": 10} and tokens.proportional([S("a", 9, 0, weight=0)], 5) == {"a": 5}
    q = tokens.proportional([S("a", 100, 60), S("b", 100, 60)], 100)
    assert sum(q.values()) == 100
    assert tokens.strict([S("opt", 10, 1, 5), S("must", 95, 50, 0)], 100) == {"must": 95, "opt": 5}
    with pytest.raises(ValueError):
        tokens.strict([S("must", 200, 150, 0)], 100)
    df = spark.createDataFrame([("abcde", 1, 2.5, True, None)], "t string, i long, f double, b boolean, n string")
    assert df.select(tokens.text_tokens(F.col("t")).alias("x")).first().x == 2 and tokens.table_tokens(df, "x").first().tokens > 5
    assert df.select(tokens.truncate(F.col("t"), 1).alias("x")).first().x == "abcd"


def test_toon(spark):
    rows = [(1, 'say "hi", ok', 2.5, [1, 2], {"k": "v,w"}, True), (2, "007", float(3), [], {}, False), (3, "true", None, None, None, None), (4, " pad\n", -1.0, [5], {"a": "b"}, True), (5, "", 0.0, [1], {"z": "1"}, True)]
    df = spark.createDataFrame(rows, "id long, s string, f double, a array<long>, m map<string,string>, b boolean")
    text = toon.to_text(df, "t", quoted=True)
    name, columns, back = toon.parse(text)
    assert (name, columns) == ("t", df.columns) and [r[:4] for r in back] == [r[:4] for r in rows] and [r[4] for r in back] == [r[4] for r in rows]
    again = toon.from_text(spark, toon.to_text(df.select("id", "s", "f"), "t", True), "id long, s string, f double")
    assert [tuple(r) for r in again.collect()] == [r[:3] for r in rows]
    assert toon.to_text(df.select("id", "f", "a").limit(1), "t") == "t[1]{id,f,a}:\n1,2.50,[1,2]"
    assert toon.to_markdown(df.select("id").limit(1)).startswith("| id |") and toon.to_json(df.select("id").limit(1)) == '[{"id":1}]'
    s = toon.savings(df.select("id", "s"), "t").first()
    assert 0 < s.saved < 1 and s.rows == 5
    for bad in ("nope", "t[2]{a}:\n1", "t[1]{a,b}:\n1"):
        with pytest.raises(ValueError):
            toon.parse(bad)


def test_sources(spark, tmp_path):
    m = np.random.default_rng(1).standard_normal((10, 4)).astype(np.float32)
    (tmp_path / "npy").mkdir()
    np.save(tmp_path / "npy" / "a.npy", m)
    (tmp_path / "a.f32").write_bytes(m.tobytes())
    for path, kw in ((str(tmp_path / "npy" / "a.npy"), {}), (str(tmp_path / "a.f32"), {"dim": 4})):
        got = vectors.read_vectors(spark, path, **kw).orderBy("row").collect()
        assert np.allclose([r.embedding for r in got], m)
    df = vectors.read_vectors(spark, str(tmp_path / "a.f32"), dim=4)
    assert vectors.from_ipc(spark, vectors.to_ipc(df)).count() == 10
    assert np.allclose(np.frombuffer(bytes(vectors.raw_blocks(df.coalesce(1), id_col="row").first().content), np.float32).reshape(-1, 4), m)
    with pytest.raises(ValueError):
        vectors.detect("x.txt")
    with pytest.raises(ValueError):
        vectors.decode(b"123", "raw", 4)
    s = catalog.schema({"id": "int", "name": "text?", "e": "vector(8)", "tags": "array(text)", "d": "decimal(10,2)", "r": "ref(users)"}, "id")
    assert [f.dataType.simpleString() for f in s] == ["bigint", "string", "array<float>", "array<string>", "decimal(10,2)", "struct<table:string,id:bigint>"] and s["e"].metadata["dim"] == 8
    with pytest.raises(ValueError):
        catalog.parse_type("widget")
    u = spark.createDataFrame([(1, None), (1, 5), (2, 9)], "id long, v long")
    v = {r.rule: r.n for r in catalog.violations(u, ("v",), ("id",), {"small": "v < 6"}, {"v": (u.where("v = 5"), "v")}).collect()}
    assert v == {"not_null:v": 1, "unique:id": 1, "check:small": 1, "foreign:v": 1}
    e = catalog.evolve(u, ("add", "x", "text", "d"), ("rename", "v", "w"), ("cast", "w", "text"), ("drop", "id"))
    assert e.columns == ["w", "x"] and e.where("w = '9'").first().x == "d"


def test_virtual_table(spark):
    class Numbers(virtual.Plugin):
        schema, parts = "n int, sq int", 3

        def rows(self, part, filters):
            low = max([v for c, op, v in filters if c == ("n") and op == "GreaterThan"], default=-1)
            yield from ((i, i * i) for i in range(part, 30, 3) if i > low)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = virtual.scan(spark, virtual.source("numbers", lambda options: Numbers()))
    assert df.count() == 30 and df.where("n > 25").agg(F.sum("sq")).first()[0] == 26**2 + 27**2 + 28**2 + 29**2


def test_upsert_null_and_repeated_keys(spark):
    old = spark.createDataFrame([(None, "keep me"), (1, "old"), (2, "two")], "k int, v string")
    new = spark.createDataFrame([(None, "added"), (1, "a"), (1, "b"), (3, "c"), (3, "d")], "k int, v string")
    rows = lambda df: sorted(((r.k, r.v) for r in df.collect()), key=str)
    nulls = [(None, "keep me"), (None, "added")]
    assert rows(tables.upsert(old, new, ["k"], "update")) == sorted([*nulls, (1, "b"), (2, "two"), (3, "d")], key=str)
    assert rows(tables.upsert(old, new, ["k"], "replace")) == sorted([*nulls, (1, "b"), (2, "two"), (3, "d")], key=str)
    assert rows(tables.upsert(old, new, ["k"], "nothing")) == sorted([*nulls, (1, "old"), (2, "two"), (3, "d")], key=str)
    odd = old.toDF("n", "o")
    assert tables.upsert(odd, new.toDF("n", "o"), ["n"], "update").where("n = 1").first().o == "b"


def test_placeholders_outside_literals(spark):
    r = tables.run_sql(spark, "SELECT '$1' AS a, $2 AS b, \"it's $1\" AS c, $1 AS d -- $9", [7, 8]).first()
    assert tuple(r) == ("$1", 8, "it's $1", 7)


def test_stored_versions(spark, tmp_path):
    t = tables.Store(spark, f"{tmp_path}/t")
    with pytest.raises(ValueError):
        t.read()
    assert t.write(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")) == 1
    added = t.insert(spark.createDataFrame([(3,)], "k int"), {"v": F.lit("new")})
    assert [tuple(r) for r in added.collect()] == [(3, "new")]
    t.update("k = 1", v="'A'")
    t.delete("k = 2")
    assert sorted(tuple(r) for r in t.read().collect()) == [(1, "A"), (3, "new")] and t.read(1).count() == 2
    assert t.rollback(1) == 5 and sorted(r.k for r in t.read().collect()) == [1, 2] and t.versions() == [1, 2, 3, 4, 5]
    t.vacuum(2)
    assert t.versions() == [4, 5]
    t.drop()
    assert t.versions() == []


def test_stored_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "The dog sat"), (3, ""), (4, None), (5, "a cat a cat the cat"), (6, "on the mat the cat")], "doc_id long, text string")
    ix = lexical.Index.build(docs, f"{tmp_path}/ix")
    rows = lambda df: [tuple(r) for r in df.collect()]
    whole = docs.fillna("")
    for q in ("cat", "the cat", "the the dog", "zebra cat"):
        assert rows(ix.bm25(q)) == rows(lexical.bm25(whole, q)), q
        assert rows(ix.bm25(q, all_terms=True)) == rows(lexical.bm25(whole, q, all_terms=True)), q
    for q in ("the cat", "a cat", "cat a cat", "the zebra"):
        assert rows(ix.phrase(q)) == rows(lexical.phrase(whole, q)), q
    few = docs.where("doc_id in (1, 5)").select("doc_id")
    assert rows(ix.bm25("the cat", allowed=few)) == rows(lexical.bm25(whole, "the cat", where=F.col("doc_id").isin(1, 5)))
    assert rows(ix.bm25("", k=3)) == [] and len(rows(ix.bm25("cat", preset="short"))) == 3


def test_queue_and_memory(spark):
    t = spark.createDataFrame([(1, "claimed", 0, 50, 1), (2, "claimed", 0, 500, 3), (3, "pending", 0, 0, 0)], "task_id int, state string, visible_at long, lease_until long, attempts int")
    assert {(r.task_id, r.state, r.visible_at) for r in agents.nack(t, [1, 2, 3], 100, 3, 9).collect()} == {(1, "pending", 109), (2, "dead_letter", 0), (3, "pending", 0)}
    assert {(r.task_id, r.lease_until) for r in agents.extend(t, [1, 2, 3], 100, 7).collect()} == {(1, 50), (2, 107), (3, 0)}
    long = spark.createDataFrame([(i, "x" * 200) for i in range(4)], "ts int, text string")
    one = agents.compact(long, 10, 2)
    assert {len(r.summary) for r in one.collect()} == {403}  # whole texts, not their beginnings
    a, b = (sketches.cardinalities(spark.range(n).selectExpr("id % 7 AS a", "id AS b"), ["a", "b"]) for n in (1000, 2000))
    assert {r.column: r.drifted for r in sketches.drift(a, b).collect()} == {"a": False, "b": True}
