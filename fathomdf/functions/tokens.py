"""Token estimates and budgets: texts, values, rows and tables as columns; allocation over sections on the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: bytes per token
PRESETS = {"default": 4.0, "tight": 3.8, "loose": 4.2, "dense": 3.5}
#: Runs of ASCII letters, up to three digits, and every other character that is no white space.
PIECE = r"[A-Za-z]+|[0-9]{1,3}|[^ \t\n\r\fA-Za-z0-9]"


def text_tokens(text: Column, bytes_per_token: float | str = 4.0) -> Column:
    """Bytes by bytes per token, a number or a name of PRESETS."""
    per = PRESETS[bytes_per_token] if isinstance(bytes_per_token, str) else bytes_per_token
    return F.ceil(F.octet_length(text) / F.lit(per)).cast("long")


def piece_tokens(text: Column) -> Column:
    """A heuristic count: pieces as a tokenizer would cut them before it merges."""
    return F.regexp_count(text, F.lit(PIECE)).cast("long")


def exact_tokens(df: DataFrame, path: str, text_col: str, out: str = "tokens") -> DataFrame:
    """df with the exact count by a vocabulary file of the tokenizers library, which has to be at the same place on every machine."""
    import pyarrow as pa

    from fathomdf.session import ship

    ship(df.sparkSession)
    at, loaded = df.columns.index(text_col), {}

    def run(batches):
        import tokenizers

        if path not in loaded:
            loaded[path] = tokenizers.Tokenizer.from_file(path)
        for b in batches:
            got = loaded[path].encode_batch([t or "" for t in b.column(at).to_pylist()], add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(g.ids) for g in got], pa.int64())], names=[*b.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.LongType())]))


def value_tokens(df: DataFrame, name: str) -> Column:
    """Estimate of one value by its type."""
    c, t = F.col(name), df.schema[name].dataType
    if isinstance(t, T.BooleanType):
        n = F.lit(1)
    elif isinstance(t, T.IntegralType):
        n = F.ceil(F.length(c.cast("string")) / 4.0)
    elif isinstance(t, (T.FractionalType, T.DecimalType)):
        n = F.ceil(F.length(F.format_string("%.2f", c.cast("double"))) / 4.0 * 1.2)
    elif isinstance(t, T.StringType):
        n = F.ceil(F.octet_length(c) / 4.0 * 1.1)
    elif isinstance(t, T.BinaryType):
        n = F.ceil(F.octet_length(c) * 2 / 4.0 * 2.5)
    elif isinstance(t, T.ArrayType):
        n = F.ceil(F.octet_length(F.to_json(c)) / 4.0) + 2
    else:
        n = F.ceil(F.octet_length(F.to_json(F.struct(c))) / 4.0)
    return F.when(c.isNull(), 1).otherwise(n).cast("long")


def row_tokens(df: DataFrame, separator: int = 1) -> Column:
    total = F.lit(separator * (len(df.columns) - 1) + 1)
    for c in df.columns:
        total = total + value_tokens(df, c)
    return total


def header_tokens(name: str, columns: list[str]) -> int:
    return math.ceil((len(name) + 4 + sum(len(c) + 1 for c in columns)) / 4)


def table_tokens(df: DataFrame, name: str) -> DataFrame:
    """One row: rows and estimated tokens of the whole table."""
    return df.select(row_tokens(df).alias("t")).agg(F.count("*").alias("rows"), (F.coalesce(F.sum("t"), F.lit(0)) + header_tokens(name, df.columns)).alias("tokens"))


def truncate(text: Column, tokens: int, bytes_per_token: float = 4.0) -> Column:
    """The first characters that fit, as if each were one byte."""
    return F.substring(text, 1, int(tokens * bytes_per_token))


def prefix_within(df: DataFrame, budget: int, tokens: Column, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """Rows in order while their running sum fits."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("tokens", tokens).withColumn("running", F.sum("tokens").over(w)).where(F.col("running") <= budget)


@dataclass
class Section:
    """A part of a context: lower priority numbers go first, and only 0 is required."""

    name: str
    estimate: int
    minimum: int = 0
    priority: int = 10
    weight: float = 1.0


def greedy(sections: list[Section], budget: int) -> dict[str, int]:
    """In order of priority: whole if it fits; else, if its minimum fits, all that remains, and nothing after it; else dropped."""
    left, out = budget, {}
    for i, s in enumerate(order := sorted(sections, key=lambda s: s.priority)):
        if s.estimate <= left:
            out[s.name], left = s.estimate, left - s.estimate
        elif s.minimum <= left and left > 0:
            out[s.name] = left
            out.update({x.name: 0 for x in order[i + 1 :]})
            break
        else:
            out[s.name] = 0
    return out


def proportional(sections: list[Section], budget: int) -> dict[str, int]:
    """Shares by weight, not above the estimate or under the minimum; the largest give way until all fit."""
    total = sum(s.weight for s in sections)
    if total <= 0:
        return greedy(sections, budget)
    out = {s.name: max(s.minimum, min(s.estimate, math.floor(budget * s.weight / total))) for s in sections}
    low = {s.name: s.minimum for s in sections}
    while (over := sum(out.values()) - budget) > 0:
        name = max(out, key=lambda n: (out[n] - 0, n))
        give = min(over, out[name])
        if out[name] <= low[name]:
            candidates = [n for n in out if out[n] > low[n]]
            if not candidates:
                low = dict.fromkeys(low, 0)
                continue
            name = max(candidates, key=lambda n: (out[n], n))
            give = min(over, out[name] - low[name])
        out[name] -= max(1, min(give, out[name] - low[name] or 1))
    return out


def strict(sections: list[Section], budget: int) -> dict[str, int]:
    """Required sections first, which must fit at their minimum; the others greedily in what remains."""
    must = [s for s in sections if s.priority == 0]
    if sum(s.minimum for s in must) > budget:
        raise ValueError("required sections exceed the budget")
    out = greedy(must, budget)
    return out | greedy([s for s in sections if s.priority != 0], budget - sum(out.values()))
