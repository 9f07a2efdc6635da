"""Queues, routing, policies, memory tiers, logs and the predefined views over events and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Outcomes of policy rules, the strictest last.
OUTCOMES = ("allow", "log", "modify", "deny")


def eligible(now: int) -> Column:
    """Tasks visible now that nobody holds: pending, or claimed with an expired lease."""
    return (F.col("visible_at") <= now) & ((F.col("state") == "pending") | ((F.col("state") == "claimed") & (F.col("lease_until") <= now)))


def dequeue(tasks: DataFrame, now: int, n: int = 1) -> DataFrame:
    """The next n tasks by priority, time and id."""
    return tasks.where(eligible(now)).orderBy("priority", "visible_at", "task_id").limit(n)


def claim(tasks: DataFrame, now: int, worker: str, lease: int, n: int = 1) -> DataFrame:
    """The task table after a claim of the next n."""
    got = dequeue(tasks, now, n).select(F.col("task_id").alias("__t"))
    j = tasks.join(got, tasks["task_id"] == got["__t"], "left")
    hit = F.col("__t").isNotNull()
    new = {"state": F.lit("claimed"), "attempts": F.col("attempts") + 1, "lease_until": F.lit(now + lease), "worker": F.lit(worker)}
    return j.select(*[F.when(hit, new[c]).otherwise(tasks[c]).cast(tasks.schema[c].dataType).alias(c) if c in new else tasks[c] for c in tasks.columns])


def settle(tasks: DataFrame, now: int, max_attempts: int, delay: int = 0) -> DataFrame:
    """Expired claims go back to pending, or to dead_letter when their attempts are spent."""
    expired = (F.col("state") == "claimed") & (F.col("lease_until") <= now)
    dead = expired & (F.col("attempts") >= max_attempts)
    t = tasks.withColumn("__x", expired).withColumn("__d", dead)
    t = t.withColumn("state", F.when(F.col("__d"), "dead_letter").when(F.col("__x"), "pending").otherwise(F.col("state"))).withColumn("visible_at", F.when(F.col("__x") & ~F.col("__d"), F.lit(now + delay).cast("long")).otherwise(F.col("visible_at")))
    return t.drop("__x", "__d")


def nack(tasks: DataFrame, ids: list, now: int, max_attempts: int, delay: int = 0) -> DataFrame:
    """Claimed tasks handed back: pending again after the delay, or dead_letter when their attempts are spent."""
    hit = F.col("task_id").isin(ids) & (F.col("state") == "claimed")
    dead = hit & (F.col("attempts") >= max_attempts)
    return tasks.withColumns({"state": F.when(dead, "dead_letter").when(hit, "pending").otherwise(F.col("state")), "visible_at": F.when(hit & ~dead, F.lit(now + delay).cast("long")).otherwise(F.col("visible_at"))})


def extend(tasks: DataFrame, ids: list, now: int, lease: int) -> DataFrame:
    """Leases that still run and are renewed to now + lease."""
    hit = F.col("task_id").isin(ids) & (F.col("state") == "claimed") & (F.col("lease_until") > now)
    return tasks.withColumn("lease_until", F.when(hit, F.lit(now + lease).cast("long")).otherwise(F.col("lease_until")))


def search(rows: DataFrame, needle: str, columns: list[str], order: list[Column], k: int, kind: str | None = None, kind_col: str = "kind") -> DataFrame:
    """Episodes or entities of a kind that have the text in one of some columns, whatever its case: the first k in the order."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c)).contains(needle.lower()), F.lit(False))
    rows = rows.where(F.col(kind_col) == kind) if kind is not None else rows
    return rows.where(hit).orderBy(*order).limit(k)


def facts(rows: DataFrame, entity: str, attribute: str, value: str, ts: str) -> DataFrame:
    """(entity, attribute, value, ts): the latest known value of every attribute of every entity."""
    best = F.max(F.struct(F.col(ts), F.col(value)))
    return rows.groupBy(entity, attribute).agg(best.alias("m")).select(entity, attribute, F.col(f"m.{value}").alias(value), F.col(f"m.{ts}").alias(ts))


def queue_stats(tasks: DataFrame, now: int) -> DataFrame:
    return tasks.groupBy("state").agg(F.count("*").alias("n"), F.count(F.when(F.col("visible_at") > now, 1)).alias("delayed"), F.max("attempts").alias("max_attempts"))


def route(agents: DataFrame, capability: str, how: str, key: str = "", seed: int = 0, turn: int = 0) -> DataFrame:
    """The agent for a request among those that have the capability: least_loaded, priority, fastest, sticky, random or round_robin."""
    a = agents.where(F.array_contains("capabilities", capability) & F.col("available"))
    order = {
        "least_loaded": [F.asc("load")], "priority": [F.asc("priority")], "fastest": [F.asc("latency_ms")],
        "sticky": [F.xxhash64(F.lit(key), F.col("agent_id"))], "random": [F.xxhash64(F.lit(seed), F.col("agent_id"))],
    }
    if how == "round_robin":
        w = Window.orderBy("agent_id")
        return a.withColumn("__r", F.row_number().over(w) - 1).withColumn("__n", F.count("*").over(Window.partitionBy(F.lit(0)))).where(F.col("__r") == F.lit(turn) % F.col("__n")).drop("__r", "__n")
    return a.orderBy(*order[how], "agent_id").limit(1)


def policy(requests: DataFrame, rules: list[dict], id_col: str = "request_id", key_col: str = "key") -> DataFrame:
    """(id, outcome): the strictest outcome of the rules that fit a request. A rule: trigger, pattern, outcome, optional namespace."""
    worst = F.lit(0)
    for r in rules:
        fits = (F.col("trigger") == r["trigger"]) & F.col(key_col).rlike(r["pattern"])
        fits = fits & (F.col("namespace") == r["namespace"]) if r.get("namespace") else fits
        worst = F.greatest(worst, F.when(fits, OUTCOMES.index(r["outcome"])).otherwise(0))
    return requests.select(id_col, F.element_at(F.array(*[F.lit(o) for o in OUTCOMES]), worst + 1).alias("outcome"))


def mask(text: Column, patterns: list[str], by: str = "***") -> Column:
    for p in patterns:
        text = F.regexp_replace(text, p, by)
    return text


def rate_limited(events: DataFrame, key: str, ts: str, window: str, n: int, *ties: str) -> DataFrame:
    """Events within the first n of their key and window."""
    w = Window.partitionBy(key, F.window(ts, window)).orderBy(ts, *ties)
    return events.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)


def triggers(scored: DataFrame, rules: DataFrame, top: int = 10) -> DataFrame:
    """Fired triggers of each event: of its best `top` matches those enabled and over their threshold, by priority then score.

    scored: (event_id, trigger_id, score); rules: (trigger_id, enabled, threshold, priority).
    """
    w = Window.partitionBy("event_id").orderBy(F.desc("score"), "trigger_id")
    best = scored.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top)
    hit = best.join(rules, "trigger_id").where(F.col("enabled") & (F.col("score") >= F.col("threshold")))
    return hit.withColumn("place", F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc("priority"), F.desc("score"), "trigger_id"))).select("event_id", "trigger_id", "score", "priority", "place")


def compact(episodes: DataFrame, before, size: int = 10, by: list[str] | None = None, text: str = "text", ts: str = "ts", head: int | None = None) -> DataFrame:
    """Summaries of old episodes: fixed-size runs in order of time, with first and last time, count and joined texts (or their first `head` characters).

    Runs of summaries are made the same way, with text="summary" and ts="first_ts".
    """
    by = by or []
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(ts, *[c for c in episodes.columns if c not in (ts, text, *by)])
    g = episodes.where(F.col(ts) < before).withColumn("run", F.floor((F.row_number().over(w) - 1) / size))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(ts, (F.substring(text, 1, head) if head else F.col(text)).alias("t")))), lambda x: x["t"])
    return g.groupBy(*by, "run").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n"), F.array_join(parts, " | ").alias("summary"))


def newest_within(df: DataFrame, budget: int, tokens: Column, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """Newest rows as long as their running token sum stays within the budget; stops at the first overflow of each group."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("tokens", tokens).withColumn("running", F.sum("tokens").over(w)).where(F.col("running") <= budget)


def timeline(logs: DataFrame, entity: str, low, high, entity_col: str = "entity", ts: str = "ts") -> DataFrame:
    """Rows whose entity contains the text, whatever its case, in the inclusive range; rows without a time pass."""
    return logs.where(F.lower(entity_col).contains(entity.lower()) & (F.col(ts).isNull() | F.col(ts).between(low, high)))


def views(spark: SparkSession, events: DataFrame, conversations: DataFrame) -> dict[str, DataFrame]:
    """The seven predefined views over our events (a user is an entity, a user's day an episode) and conversations; registered by name."""
    e = events.withColumn("episode", F.to_date("ts"))
    out = {
        "conversation_view": conversations.select("conv_id", "turn", "role", "text"),
        "tool_calls_view": e.where(F.col("event_type").isin("click", "purchase")).select("event_id", "user_id", "ts", "event_type", "value"),
        "errors_view": e.where(F.col("event_type") == "error").select("event_id", "user_id", "ts", "value"),
        "episode_summary_view": e.groupBy("user_id", "episode").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n_events")),
        "entity_directory_view": e.groupBy("user_id").agg(F.count("*").alias("n_events"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")),
        "session_timeline_view": e.select("user_id", "ts", "event_type", "value"),
        "metrics_view": e.groupBy("user_id", "episode").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high")),
    }
    for name, df in out.items():
        df.createOrReplaceTempView(name)
    return out
