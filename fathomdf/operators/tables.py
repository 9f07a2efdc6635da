"""Reading and changing tables as functions of DataFrames: lookups, scans, versions, upserts, updates, deletes."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == value)


def prefix_scan(df: DataFrame, key: str, prefix: str) -> DataFrame:
    return df.where(F.col(key).startswith(prefix))


def range_scan(df: DataFrame, key: str, low=None, high=None) -> DataFrame:
    """low <= key < high, in order of key."""
    for c in ([F.col(key) >= low] if low is not None else []) + ([F.col(key) < high] if high is not None else []):
        df = df.where(c)
    return df.orderBy(F.asc_nulls_last(key))


def time_scan(df: DataFrame, ts: str, low, high) -> DataFrame:
    return df.where(F.col(ts).between(low, high))


def latest(df: DataFrame, keys: list[str], version: str, *ties: str) -> DataFrame:
    """The row of greatest version of each key, by a partial aggregate rather than a window."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(version, *ties, *[c for c in rest if c not in (version, *ties)])
    return df.groupBy(*keys).agg(F.max(order).alias("__m")).select(*[F.col(f"__m.{c}").alias(c) if c in rest else F.col(c) for c in df.columns])


def visible(df: DataFrame, snapshot: int, own: int | None = None, commit: str = "commit_ts", writer: str = "txn_id") -> DataFrame:
    """Versions a reader sees: its own, or those committed strictly before its snapshot."""
    seen = (F.col(commit) != 0) & (F.col(commit) < snapshot)
    return df.where(seen | (F.col(writer) == own) if own is not None else seen)


def update(df: DataFrame, where: Column | str, **values: Column | str) -> DataFrame:
    """UPDATE ... SET: expressions see the old row; rows where the condition is unknown stay."""
    cond = F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))
    return df.select(*[F.when(cond, F.expr(values[c]) if isinstance(values[c], str) else values[c]).otherwise(F.col(c)).cast(df.schema[c].dataType).alias(c) if c in values else F.col(c) for c in df.columns])


def delete(df: DataFrame, where: Column | str) -> DataFrame:
    cond = F.expr(where) if isinstance(where, str) else where
    return df.where(~F.coalesce(cond, F.lit(False)))


def unexpired(df: DataFrame, now: Column | int, expires: str = "expires_at") -> DataFrame:
    """Rows whose time to live has not run out; without one they live for ever."""
    return df.where(F.col(expires).isNull() | (F.col(expires) > now))


def insert(df: DataFrame, rows: DataFrame, defaults: dict[str, Column] | None = None) -> DataFrame:
    """INSERT: columns that the rows lack get their default, else null."""
    return df.unionByName(with_defaults(df, rows, defaults))


def with_defaults(df: DataFrame, rows: DataFrame, defaults: dict[str, Column] | None = None) -> DataFrame:
    """The rows as they are inserted, which is what INSERT ... RETURNING gives."""
    return rows.select(*[(F.col(c) if c in rows.columns else (defaults or {}).get(c, F.lit(None))).cast(df.schema[c].dataType).alias(c) for c in df.columns])


class Store:
    """A table stored under a path in numbered versions, each written whole and complete when its _SUCCESS mark is there.

    A change writes the next version beside the last, so readers see one or the other; old versions stay readable (snapshots)
    until vacuum(). One writer at a time: there are no locks.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(path(self.path))]
        return sorted(int(n[1:]) for n in names if re.fullmatch(r"v\d+", n) and fs.exists(path(f"{self.path}/{n}/_SUCCESS")))

    def read(self, version: int | None = None) -> DataFrame:
        have = self.versions()
        if not have or (version is not None and version not in have):
            raise ValueError(f"no version {version if version is not None else ''} of {self.path}")
        return self.spark.read.parquet(f"{self.path}/v{have[-1] if version is None else version}")

    def write(self, df: DataFrame) -> int:
        """CREATE, or the next version; its number."""
        n = (self.versions() or [0])[-1] + 1
        df.write.parquet(f"{self.path}/v{n}")
        return n

    def insert(self, rows: DataFrame, defaults: dict[str, Column] | None = None) -> DataFrame:
        """Adds the rows; returns them as inserted."""
        now = self.read()
        added = with_defaults(now, rows, defaults)
        self.write(now.unionByName(added))
        return added

    def update(self, where: Column | str, **values: Column | str) -> int:
        return self.write(update(self.read(), where, **values))

    def delete(self, where: Column | str) -> int:
        return self.write(delete(self.read(), where))

    def upsert(self, rows: DataFrame, keys: list[str], action: str = "update") -> int:
        return self.write(upsert(self.read(), rows, keys, action))

    def rollback(self, version: int) -> int:
        """The table as of a version, as the newest one."""
        return self.write(self.read(version))

    def vacuum(self, keep: int = 1) -> None:
        fs, path = self._fs()
        for n in self.versions()[:-keep]:
            fs.delete(path(f"{self.path}/v{n}"), True)

    def drop(self) -> None:
        fs, path = self._fs()
        fs.delete(path(self.path), True)


def one_per_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the greatest of those that share a key; a key with a null in it equals no other, so such rows all stay."""
    whole = reduce(and_, [F.col(k).isNotNull() for k in keys])
    return latest(rows.where(whole), keys, next((c for c in rows.columns if c not in keys), keys[0])).unionByName(rows.where(~whole)) if set(rows.columns) - set(keys) else rows.where(whole).distinct().unionByName(rows.where(~whole))


def upsert(df: DataFrame, rows: DataFrame, keys: list[str], action: str = "update", columns: list[str] | None = None) -> DataFrame:
    """ON CONFLICT: 'nothing' keeps the old row, 'replace' takes the new one whole, 'update' takes the named columns.

    A null key conflicts with nothing: the old row stays as it is, the new one is added. Of new rows that share a key the greatest counts.
    """
    match = lambda a, b: reduce(and_, [a[k] == b[k] for k in keys])
    rows = one_per_key(rows, keys)
    if action == "nothing":
        return df.unionByName(rows.join(df, match(rows, df), "left_anti").select(df.columns))
    if action == "replace":
        return df.join(rows, match(df, rows), "left_anti").unionByName(rows.select(df.columns))
    take = set(columns or [c for c in df.columns if c not in keys])
    old, new = df.select(F.struct("*").alias("o")), rows.select(F.struct("*").alias("n"))
    both = old.join(new, reduce(and_, [F.col(f"n.{k}") == F.col(f"o.{k}") for k in keys]), "full")
    is_new, hit = F.col("o").isNull(), F.col("n").isNotNull()
    return both.select(*[F.when(is_new, F.col(f"n.{c}")).when(hit & F.lit(c in take), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in df.columns])


def conflict_action(sql: str) -> tuple[str, str]:
    """(plain INSERT, action) of an INSERT in any of three dialects' conflict clauses."""
    for pattern, action, to in (
        (r"^\s*INSERT\s+(?:OR\s+)?IGNORE\s+INTO", "nothing", "INSERT INTO"), (r"^\s*INSERT\s+OR\s+REPLACE\s+INTO", "replace", "INSERT INTO"), (r"^\s*REPLACE\s+INTO", "replace", "INSERT INTO"),
        (r"\s+ON\s+CONFLICT(?:\s*\([^)]*\))?\s+DO\s+NOTHING", "nothing", ""), (r"\s+ON\s+CONFLICT(?:\s*\([^)]*\))?\s+DO\s+UPDATE\s+SET\b.*$", "update", ""), (r"\s+ON\s+DUPLICATE\s+KEY\s+UPDATE\b.*$", "update", ""),
    ):
        if re.search(pattern, sql, re.I | re.S):
            return re.sub(pattern, to, sql, count=1, flags=re.I | re.S), action
    return sql, "error"


def dialect(sql: str) -> str:
    """Which dialect a statement's keywords give away."""
    for name, pattern in (("mysql", r"INSERT\s+IGNORE|ON\s+DUPLICATE\s+KEY|`"), ("sqlite", r"INSERT\s+OR\s+(IGNORE|REPLACE)|AUTOINCREMENT"), ("postgres", r"ON\s+CONFLICT|RETURNING|::|\$\d")):
        if re.search(pattern, sql, re.I):
            return name
    return "ansi"


def run_sql(spark: SparkSession, sql: str, args: list | dict | None = None, **frames: DataFrame) -> DataFrame:
    """SQL with ?, :name or $n placeholders ($n from 1, each may recur) over the session's tables and the given frames."""
    order: list[int] = []

    def place(m: re.Match) -> str:
        if m[1] is None:  # a literal, a quoted name or a comment
            return m[0]
        order.append(int(m[1]))
        return "?"

    marked = re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|\$(\d+)", place, sql, flags=re.S)
    if order:
        if not isinstance(args, list) or max(order) > len(args):
            raise ValueError(f"placeholder ${max(order)} has no value")
        sql, args = marked, [args[n - 1] for n in order]
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=args) if args else spark.sql(sql)


class Table:
    """Fluent reading and changing; every step returns a new Table, rows() the DataFrame."""

    def __init__(self, df: DataFrame, key: str | None = None):
        self.df, self.key = df, key

    def rows(self) -> DataFrame:
        return self.df

    def _to(self, df: DataFrame) -> Table:
        return Table(df, self.key)

    def filter(self, cond) -> Table: return self._to(self.df.where(cond))  # noqa: E704
    def eq(self, c, v) -> Table: return self._to(self.df.where(F.col(c) == v))  # noqa: E704
    def gt(self, c, v) -> Table: return self._to(self.df.where(F.col(c) > v))  # noqa: E704
    def lt(self, c, v) -> Table: return self._to(self.df.where(F.col(c) < v))  # noqa: E704
    def like(self, c, v) -> Table: return self._to(self.df.where(F.col(c).like(v)))  # noqa: E704
    def select(self, *cs) -> Table: return self._to(self.df.select(*cs))  # noqa: E704
    def order(self, c, desc=False) -> Table: return self._to(self.df.orderBy(F.desc_nulls_last(c) if desc else F.asc_nulls_first(c)))  # noqa: E704
    def limit(self, n) -> Table: return self._to(self.df.limit(n))  # noqa: E704
    def offset(self, n) -> Table: return self._to(self.df.offset(n))  # noqa: E704
    def insert(self, rows) -> Table: return self._to(insert(self.df, rows))  # noqa: E704
    def update(self, where, **v) -> Table: return self._to(update(self.df, where, **v))  # noqa: E704
    def delete(self, where) -> Table: return self._to(delete(self.df, where))  # noqa: E704
    def upsert(self, rows, action="update") -> Table: return self._to(upsert(self.df, rows, [self.key], action))  # noqa: E704
    def find(self, v) -> DataFrame: return self.df.where(F.col(self.key) == v)  # noqa: E704
    def count(self) -> int: return self.df.count()  # noqa: E704
    def exists(self) -> bool: return not self.df.isEmpty()  # noqa: E704
    def first(self): return self.df.first()  # noqa: E704


def last_n(df: DataFrame, n: int, by: str, *ties: str) -> DataFrame:
    """The newest n rows, newest first."""
    return df.orderBy(F.desc_nulls_last(by), *[F.desc(t) for t in ties]).limit(n)


def tail(df: DataFrame, n: int, by: list[str], where: Column | str) -> DataFrame:
    """The last n rows in order, and of these the ones that pass: at most n."""
    return df.orderBy(*[F.desc(c) for c in by]).limit(n).where(where)


def top_k_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def token_limit(limit: int | None, budget: int, tokens_per_row: float, overhead: int = 50) -> int:
    """Rows that a token budget allows."""
    fit = int(max(0, budget - overhead) / tokens_per_row) if tokens_per_row > 0 else 0
    return fit if limit is None else min(limit, fit)
