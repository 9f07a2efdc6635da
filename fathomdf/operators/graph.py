"""Property and temporal graphs as node and edge tables.

nodes: (id, type, ...); edges: (src, dst, type, ...); temporal edges add valid_from and valid_to, [from, to), open if null.
Traversals join the frontier with the edges once a level and keep what was seen out by an anti-join; each level is
checkpointed to the shared folder, so lineage stays short and a lost executor costs one level. Depth-first order is not
relational and walks a bounded neighbourhood on the driver.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MS = {"hour": 3_600_000, "day": 86_400_000, "week": 604_800_000}


def _cut(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if at is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is unset: it has to name a folder that all machines share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="fathomdf-graph-"))
    return df.checkpoint()


def both_ways(edges: DataFrame, direction: str = "out") -> DataFrame:
    """Edges to follow: out, in, or both."""
    turned = edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})
    return {"out": lambda: edges, "in": lambda: turned, "both": lambda: edges.unionByName(turned)}[direction]()


def neighbours(edges: DataFrame, node, direction: str = "out", types: list[str] | None = None) -> DataFrame:
    """(id, type, direction) of the edges at a node."""
    e = edges.where(F.col("type").isin(types)) if types else edges
    parts = []
    if direction in ("out", "both"):
        parts.append(e.where(F.col("src") == node).select(F.col("dst").alias("id"), "type", F.lit("out").alias("direction")))
    if direction in ("in", "both"):
        parts.append(e.where(F.col("dst") == node).select(F.col("src").alias("id"), "type", F.lit("in").alias("direction")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def bfs(edges: DataFrame, starts: DataFrame | list, max_depth: int, direction: str = "out", edge_types: list[str] | None = None, nodes: DataFrame | None = None, node_types: list[str] | None = None) -> DataFrame:
    """(id, depth) of all nodes within max_depth; a node of another type than those asked for is not expanded or returned."""
    spark = edges.sparkSession
    e = both_ways(edges.where(F.col("type").isin(edge_types)) if edge_types else edges, direction).select("src", "dst").distinct()
    ok = nodes.where(F.col("type").isin(node_types)).select(F.col("id").alias("ok")) if nodes is not None and node_types else None
    seen = starts.select(F.col(starts.columns[0]).alias("id")) if isinstance(starts, DataFrame) else spark.createDataFrame([(s,) for s in starts], f"id {edges.schema['src'].dataType.simpleString()}")
    seen = _cut((seen.join(ok, seen["id"] == ok["ok"], "left_semi") if ok is not None else seen).distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = e.join(frontier.select(F.col("id").alias("at")), F.col("src") == F.col("at")).select(F.col("dst").alias("id")).distinct()
        step = step.join(ok, step["id"] == ok["ok"], "left_semi") if ok is not None else step
        frontier = _cut(step.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def shortest_path(edges: DataFrame, source, target, max_depth: int = 10, direction: str = "out") -> list | None:
    """Nodes of a path with the fewest edges (least parent on ties), or None."""
    e = both_ways(edges, direction).select("src", "dst").distinct()
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    if source == target:
        return [source]
    seen = spark.createDataFrame([(source, None)], f"id {kind}, parent {kind}")
    frontier = seen
    for _ in range(max_depth):
        step = e.join(frontier.select(F.col("id").alias("at")), F.col("src") == F.col("at")).groupBy("dst").agg(F.min("src").alias("parent")).withColumnRenamed("dst", "id")
        frontier = _cut(step.join(seen.select("id"), "id", "left_anti"))
        if frontier.isEmpty():
            return None
        seen = seen.unionByName(frontier)
        if not frontier.where(F.col("id") == target).isEmpty():
            path = [target]
            while path[-1] != source:
                path.append(seen.where(F.col("id") == path[-1]).first()["parent"])
            return path[::-1]
    return None


def dfs(edges: DataFrame, start, max_depth: int, limit: int = 100_000) -> list:
    """Nodes in depth-first order, marked at first visit; the neighbourhood is taken by bfs and must stay under limit."""
    near = bfs(edges, [start], max_depth).select("id")
    inner = edges.join(near, edges["src"] == near["id"], "left_semi").select("src", "dst").distinct().limit(limit + 1).collect()
    if len(inner) > limit:
        raise ValueError(f"more than {limit} edges around the start")
    out: dict = {}
    for r in inner:
        out.setdefault(r["src"], []).append(r["dst"])
    stack, seen, order = [(start, 0)], set(), []
    while stack:
        n, d = stack.pop()
        if n in seen:
            continue
        seen.add(n)
        order.append(n)
        if d < max_depth:
            stack += [(m, d + 1) for m in sorted(out.get(n, ()), reverse=True) if m not in seen]
    return order


def subgraph(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ids."""
    a, b = ids.select(F.col(ids.columns[0]).alias("a")).distinct(), ids.select(F.col(ids.columns[0]).alias("b")).distinct()
    return edges.join(a, edges["src"] == a["a"], "left_semi").join(b, edges["dst"] == b["b"], "left_semi")


def valid_at(t: Column | int, start: str = "valid_from", end: str = "valid_to") -> Column:
    t = F.lit(t) if isinstance(t, int) else t
    return (F.col(start) <= t) & (F.col(end).isNull() | (t < F.col(end)))


def overlaps(a: Column | int, b: Column | int | None, start: str = "valid_from", end: str = "valid_to") -> Column:
    """Whether [start, end) meets [a, b); a null end is open."""
    a = F.lit(a) if isinstance(a, int) else a
    left = F.col(end).isNull() | (a < F.col(end))
    return left if b is None else left & (F.col(start) < (F.lit(b) if isinstance(b, int) else b))


def edges_at(edges: DataFrame, t: int, node=None) -> DataFrame:
    e = edges.where(valid_at(t))
    return e.where(F.col("src") == node) if node is not None else e


def history(edges: DataFrame, src, dst=None, type_: str | None = None) -> DataFrame:
    e = edges.where(F.col("src") == src)
    e = e.where(F.col("dst") == dst) if dst is not None else e
    return (e.where(F.col("type") == type_) if type_ else e).orderBy("valid_from", F.asc_nulls_last("valid_to"))


def subgraph_at(edges: DataFrame, start, t: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) valid at t around a start; nodes at the last depth are not members, though edges into them are."""
    now = edges.where(valid_at(t))
    inside = bfs(now, [start], max(0, depth - 1)).select("id")
    inside = inside if depth > 0 else inside.limit(0)
    return inside, now.join(inside, now["src"] == inside["id"], "left_semi")


def bucket(ms: Column, size: str, toward_epoch: bool = False) -> Column:
    """Epoch-aligned bucket number of a time in milliseconds; toward_epoch: as SQL's whole division cuts it before 1970, too."""
    n = ms / MS[size]
    return n.cast("long") if toward_epoch else F.floor(n)


def interval_join(left: DataFrame, right: DataFrame, cell: int, keys: list[str] | None = None) -> DataFrame:
    """Pairs of rows whose [start, end) overlap: each interval goes to the cells it touches, equal cells meet, and a pair
    counts in the first cell that both touch. left: (start, end, ...), right: (start2, end2, ...), whole numbers."""
    keys = keys or []
    a = left.where("end > start").withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor((F.col("end") - 1) / cell))))
    b = right.where("end2 > start2").withColumn("cell2", F.explode(F.sequence(F.floor(F.col("start2") / cell), F.floor((F.col("end2") - 1) / cell))))
    on = (F.col("cell") == F.col("cell2")) & (F.col("start") < F.col("end2")) & (F.col("start2") < F.col("end")) & (F.col("cell") == F.floor(F.greatest("start", "start2") / cell))
    for k in keys:
        on = on & (a[k] == b[k])
    return a.join(b, on).drop("cell", "cell2")


def as_of(facts: DataFrame, events: DataFrame, key: str, fact_ts: str, event_ts: str, value: str) -> DataFrame:
    """Every event with the newest fact of its key at or before it: one pass over both in time order, no range join."""
    from pyspark.sql.window import Window

    e = events.withColumn("__e", F.struct(*events.columns)).select(F.col(key).alias("__k"), F.col(event_ts).alias("__t"), F.lit(1).alias("__o"), "__e", F.lit(None).cast(facts.schema[value].dataType).alias("__v"))
    f = facts.select(F.col(key).alias("__k"), F.col(fact_ts).alias("__t"), F.lit(0).alias("__o"), F.lit(None).cast(e.schema["__e"].dataType).alias("__e"), F.col(value).alias("__v"))
    w = Window.partitionBy("__k").orderBy("__t", "__o").rowsBetween(Window.unboundedPreceding, 0)
    return e.unionByName(f).withColumn("as_of", F.last("__v", True).over(w)).where("__o = 1").select("__e.*", "as_of")
