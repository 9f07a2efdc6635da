"""Compact tabular text: a header `name[N]{columns}:` and a line per row; writing as columns, reading on the driver.

Plain form: floats with two decimals, strings bare, arrays [a,b], binary 0x... Quoted form: strings that could be read as
something else are quoted with backslash escapes, arrays are separated by ;, maps {k:v}, references @table:id; this form
reads back as it was written.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a bare string must not look like.
AMBIGUOUS = r"^$|^\s|\s$|[,;:\n\r\t\"\\{}\[\]]|^(true|false|null)$|^[-+]?\d|^@|^0x"


def _escape(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), c, F.lit('"'))


def value(c: Column, t: T.DataType, quoted: bool = False) -> Column:
    """One value as text."""
    if isinstance(t, T.StringType):
        v = F.when(c.rlike(AMBIGUOUS), _escape(c)).otherwise(c) if quoted else c
    elif isinstance(t, (T.FloatType, T.DoubleType)):
        v = c.cast("double").cast("string") if quoted else F.format_string("%.2f", c.cast("double"))
    elif isinstance(t, T.BinaryType):
        v = F.concat(F.lit("0x"), F.lower(F.hex(c)))
    elif isinstance(t, T.ArrayType):
        sep = ";" if quoted else ","
        v = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: value(x, t.elementType, quoted)), sep), F.lit("]"))
    elif isinstance(t, T.MapType):
        pairs = F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), value(e["value"], t.valueType, quoted)))
        v = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    elif isinstance(t, T.StructType) and t.names == ["table", "id"]:
        v = F.concat(F.lit("@"), c["table"], F.lit(":"), c["id"].cast("string"))
    elif isinstance(t, T.StructType):
        v = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f"{f.name}:"), value(c[f.name], f.dataType, quoted)) for f in t]), F.lit("}"))
    else:
        v = c.cast("string")
    return F.coalesce(v, F.lit("null"))


def rows(df: DataFrame, quoted: bool = False) -> DataFrame:
    """Every row as a line, built inside the query."""
    return df.select(F.concat_ws(",", *[value(F.col(c), df.schema[c].dataType, quoted) for c in df.columns]).alias("line"))


def header(name: str, n: int, columns: list[str]) -> str:
    return f"{name}[{n}]{{{','.join(columns)}}}:"


#: Rows that may be shown; larger results belong into a table.
SHOWN = 100_000


def _shown(df: DataFrame) -> list:
    got = df.limit(SHOWN + 1).collect()
    if len(got) > SHOWN:
        raise ValueError(f"more than {SHOWN} rows to show")
    return got


def to_text(df: DataFrame, name: str, quoted: bool = False) -> str:
    """A result that is small enough to show, as text."""
    lines = [r["line"] for r in _shown(rows(df, quoted))]
    return "\n".join([header(name, len(lines), df.columns), *lines])


def to_json(df: DataFrame) -> str:
    return "[" + ",".join(r["json"] for r in _shown(df.select(F.to_json(F.struct("*")).alias("json")))) + "]"


def to_markdown(df: DataFrame) -> str:
    out = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    for r in _shown(df):
        out.append("| " + " | ".join("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |")
    return "\n".join(out)


def _split(line: str, sep: str = ",") -> list[str]:
    out, depth, start, i, inside = [], 0, 0, 0, False
    while i < len(line):
        ch = line[i]
        if inside:
            if ch == "\\":
                i += 1
            elif ch == '"':
                inside = False
        elif ch == '"':
            inside = True
        elif ch in "[{":
            depth += 1
        elif ch in "]}":
            depth -= 1
        elif ch == sep and depth == 0:
            out.append(line[start:i])
            start = i + 1
        i += 1
    return [*out, line[start:]]


def parse_value(text: str):
    if text in ("null", "true", "false"):
        return {"null": None, "true": True, "false": False}[text]
    if text.startswith('"'):
        return json.loads(text)
    if text.startswith("0x"):
        return bytes.fromhex(text[2:])
    if text.startswith("[") and text.endswith("]"):
        return [parse_value(x) for x in _split(text[1:-1], ";")] if len(text) > 2 else []
    if text.startswith("{") and text.endswith("}"):
        return {k: parse_value(v) for k, v in (p.split(":", 1) for p in _split(text[1:-1]) if p)}
    if m := re.fullmatch(r"@(\w+):(\d+)", text):
        return (m[1], int(m[2]))
    if re.fullmatch(r"[-+]?\d+", text):
        return int(text)
    try:
        return float(text) if re.match(r"[-+]?\d|NaN|-?Infinity", text) else text
    except ValueError:
        return text


def parse(text: str) -> tuple[str, list[str], list[tuple]]:
    """(name, columns, rows) of one table in the quoted form."""
    first, *lines = text.split("\n")
    m = re.fullmatch(r"(\w+)\[(\d+)\]\{([^}]*)\}:", first.strip())
    if not m:
        raise ValueError(f"not a table header: {first!r}")
    columns, n = m[3].split(","), int(m[2])
    if len(lines) < n:
        raise ValueError(f"{n} rows announced, {len(lines)} found")
    out = [tuple(parse_value(v) for v in _split(line)) for line in lines[:n]]
    if any(len(r) != len(columns) for r in out):
        raise ValueError("a row has another number of values than the header")
    return m[1], columns, out


def from_text(spark: SparkSession, text: str, schema: str | T.StructType | None = None) -> DataFrame:
    _, columns, data = parse(text)
    return spark.createDataFrame(data, schema or columns)


def savings(df: DataFrame, name: str, bytes_per_token: float = 4.0) -> DataFrame:
    """One row: estimated tokens of the table as compact text and as JSON, and the share saved."""
    line = F.concat_ws(",", *[value(F.col(c), df.schema[c].dataType) for c in df.columns])
    s = df.select(F.octet_length(line).alias("a"), F.octet_length(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).alias("b")).agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    head = len(header(name, 0, df.columns))
    compact, full = F.ceil((F.col("a") + F.col("n") + head) / bytes_per_token), F.ceil((F.col("b") + F.col("n") + 1) / bytes_per_token)
    return s.select(F.col("n").alias("rows"), compact.cast("long").alias("compact_tokens"), full.cast("long").alias("json_tokens"), F.round(1 - compact / full, 4).cast("double").alias("saved"))
