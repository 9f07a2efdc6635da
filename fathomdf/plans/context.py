"""Context assembly: a query of sections, each a DataFrame or text, rendered under one token budget.

    CONTEXT SELECT <name> FROM session('id') WITH (token_limit = 2048, truncation = 'tail_drop', format = 'toon')
    SECTIONS (
        NOTE PRIORITY 0: 'literal text',
        LATEST PRIORITY 1: LAST 10 FROM conversations WHERE conv_id = 3,
        FACTS PRIORITY 2: SELECT conv_id, text FROM conversations WHERE role = 'user' LIMIT 5,
        NEAR PRIORITY 3: SEARCH documents BY TEXT 'query words' TOP 3,
        WHO PRIORITY 4: GET user.profile.{name,email},
        HELLO PRIORITY 5: $greeting
    );

A section that gives rows may be changed on its way, in any number of steps: THEN PROJECT (a, b), THEN TEMPLATE '{a} said {b}' (a line for
each row), THEN SUMMARIZE 3 (the first rows, or what the assembler's `summarise` function makes of the section's text).

Sections run as Spark queries with limits of their own; only their lines, bounded by the budget, reach the driver.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomdf.functions import tokens, toon
from fathomdf.operators import lexical


@dataclass
class Part:
    name: str
    priority: int
    kind: str
    body: str


@dataclass
class Query:
    name: str
    session: str | None
    options: dict = field(default_factory=lambda: {"token_limit": 4096, "format": "toon", "truncation": "tail_drop", "include_headers": True, "allocation": "greedy"})
    parts: list[Part] = field(default_factory=list)


def _pieces(text: str) -> list[str]:
    out, depth, start, quote = [], 0, 0, None
    for i, c in enumerate(text):
        if quote:
            quote = None if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "({":
            depth += 1
        elif c in ")}":
            depth -= 1
        elif c == "," and depth == 0 and re.match(r",\s*\w+\s*(\s+PRIORITY\s+-?\d+\s*)?:", text[i:], re.I):
            out.append(text[start:i])
            start = i + 1
    return [p.strip() for p in [*out, text[start:]] if p.strip()]


def parse(sql: str) -> Query:
    m = re.fullmatch(r"\s*CONTEXT\s+SELECT\s+(\w+)\s+(?:FROM\s+(?:session|agent)\s*\(\s*(?:'([^']*)'|\$(\w+))\s*\)\s*)?(?:WITH\s*\(([^)]*)\)\s*)?SECTIONS\s*\((.*)\)\s*;?\s*", sql, re.I | re.S)
    if not m:
        raise ValueError("not a context query")
    q = Query(m[1], m[2] or m[3])
    for k, v in re.findall(r"(\w+)\s*=\s*('[^']*'|[\w.]+)", m[4] or ""):
        q.options[k.lower()] = v[1:-1] if v[0] == "'" else {"true": True, "false": False}.get(v.lower(), int(v) if re.fullmatch(r"\d+", v) else v)
    for p in _pieces(m[5]):
        s = re.fullmatch(r"(\w+)\s*(?:\s+PRIORITY\s+(-?\d+)\s*)?:\s*(.*)", p, re.I | re.S)
        if not s:
            raise ValueError(f"not a section: {p[:60]}")
        body = s[3].strip()
        kind = "variable" if body.startswith("$") else "literal" if body[:1] in "'\"" else body.split(None, 1)[0].lower()
        if kind not in ("variable", "literal", "get", "last", "search", "select", "tool_registry", "tool_calls"):
            raise ValueError(f"unknown section: {body[:60]}")
        q.parts.append(Part(s[1], int(s[2] or 10), kind, body))
    return q


def path_get(tree: dict, path: str):
    """a.b, a.{x,y}, a.** of a nested mapping; missing keys give nothing."""
    node = tree
    for step in re.findall(r"\{[^}]*\}|\*\*|\w+", path):
        if step == "**":
            return node
        if not isinstance(node, dict):
            return None
        if step[0] == "{":
            return {k.strip(): node[k.strip()] for k in step[1:-1].split(",") if k.strip() in node}
        node = node.get(step)
    return node


class Assembler:
    """Runs context queries over the session's tables, given variables, a state tree and tool tables."""

    def __init__(self, spark: SparkSession, state: dict | None = None, variables: dict | None = None, tools: DataFrame | None = None, calls: DataFrame | None = None, order_by: str | None = None, summarise: Callable[[str, int], str] | None = None):
        self.summarise = summarise
        self.spark, self.state, self.variables, self.tools, self.calls, self.order_by = spark, state or {}, variables or {}, tools, calls, order_by

    def frame(self, p: Part) -> DataFrame | str:
        b = p.body
        if p.kind == "literal":
            return b[1:-1]
        if p.kind == "variable":
            if b[1:] not in self.variables:
                raise KeyError(f"no variable {b}")
            return str(self.variables[b[1:]])
        if p.kind == "get":
            got = path_get(self.state, b[3:].strip())
            return "" if got is None else "\n".join(f"{k}: {v}" for k, v in got.items()) if isinstance(got, dict) else str(got)
        if p.kind == "select":
            return self.spark.sql(b)
        if p.kind in ("tool_registry", "tool_calls"):
            df = self.tools if p.kind == "tool_registry" else self.calls
            return df if df is not None else ""
        if p.kind == "last":
            m = re.fullmatch(r"LAST\s+(\d+)\s+FROM\s+(\w+)(?:\s+ORDER\s+BY\s+(\w+))?(?:\s+WHERE\s+(.*))?", b, re.I | re.S)
            df = self.spark.table(m[2])
            df = df.where(m[4]) if m[4] else df
            by = m[3] or self.order_by or next((c for c in ("created_at", "ts", "turn") if c in df.columns), df.columns[0])
            return df.orderBy(F.desc_nulls_last(by), *[F.desc(c) for c in df.columns if c != by]).limit(int(m[1]))
        m = re.fullmatch(r"SEARCH\s+(\w+)\s+BY\s+TEXT\s+'([^']*)'(?:\s+TOP\s+(\d+))?(?:\s+MIN_SCORE\s+([\d.]+))?(?:\s+WHERE\s+(.*))?", b, re.I | re.S)
        if not m:
            raise ValueError(f"not a search: {b}")
        df = self.spark.table(m[1])
        id_col = df.columns[0]
        hit = lexical.bm25(df, m[2], int(m[3] or 10), id_col, "text", where=F.expr(m[5]) if m[5] else None)
        hit = hit.where(F.col("score") >= float(m[4])) if m[4] else hit
        return hit.join(df.select(F.col(id_col).alias("__id"), "text"), F.col(id_col) == F.col("__id")).select(id_col, "score", "text").orderBy(F.desc("score"), id_col)

    def text(self, p: Part, fmt: str) -> str:
        body, *steps = re.split(r"\s+THEN\s+(?=(?:PROJECT|TEMPLATE|SUMMARIZE)\b)", p.body, flags=re.I)
        f = self.frame(Part(p.name, p.priority, p.kind, body))
        for step in steps:
            f = self.change(f, step.strip(), fmt, p.name)
        return self.shown(f, p.name, fmt)

    def change(self, f: DataFrame | str, step: str, fmt: str, name: str) -> DataFrame | str:
        """One transform of a section."""
        if (m := re.fullmatch(r"PROJECT\s*\(([^)]*)\)", step, re.I)) and not isinstance(f, str):
            return f.select(*[c.strip() for c in m[1].split(",")])
        if (m := re.fullmatch(r"TEMPLATE\s+'((?:[^']|'')*)'", step, re.I | re.S)) and not isinstance(f, str):
            out = [F.lit(x) if i % 2 == 0 else F.coalesce(F.col(x).cast("string"), F.lit("")) for i, x in enumerate(re.split(r"\{(\w+)\}", m[1].replace("''", "'")))]
            return "\n".join(r["line"] for r in f.select(F.concat(*out).alias("line")).limit(toon.SHOWN).collect())
        if m := re.fullmatch(r"SUMMARIZE\s+(\d+)", step, re.I):
            if self.summarise is not None:
                return self.summarise(self.shown(f, name, fmt), int(m[1]))
            return "\n".join(f.split("\n")[: int(m[1])]) if isinstance(f, str) else f.limit(int(m[1]))
        raise ValueError(f"not a transform of this section: {step}")

    def shown(self, f: DataFrame | str, name: str, fmt: str) -> str:
        if isinstance(f, str):
            return f
        return {"toon": lambda: toon.to_text(f, name.lower()), "json": lambda: toon.to_json(f), "markdown": lambda: toon.to_markdown(f)}[fmt]()

    def run(self, sql: str) -> tuple[str, dict[str, int]]:
        """The assembled text, and the tokens each section took."""
        q = parse(sql)
        budget, how = int(q.options["token_limit"]), str(q.options["truncation"]).replace("_", "").lower()
        texts = {p.name: self.text(p, str(q.options["format"]).lower()) for p in q.parts}
        heads = {p.name: f"## {p.name}\n" if q.options["include_headers"] else "" for p in q.parts}
        # a section costs its header, its text and the blank line after it
        est = {n: math.ceil(len((heads[n] + t).encode()) / 4 + 0.5) for n, t in texts.items()}
        if how == "fail" and sum(est.values()) > budget:
            raise ValueError(f"{sum(est.values())} tokens exceed the budget of {budget}")
        parts = [tokens.Section(p.name, est[p.name], est[p.name] if how == "fail" else max(min(est[p.name], 100), est[p.name] // 10), p.priority) for p in q.parts]
        order = sorted(q.parts, key=lambda p: p.priority)
        fn = {"proportional": tokens.proportional, "strict": tokens.strict}.get("proportional" if how == "proportional" else str(q.options.get("allocation")), tokens.greedy)
        share = fn(parts, budget)
        out = []
        for p in order:
            n = share[p.name]
            if n <= 0:
                continue
            raw, room = texts[p.name].encode(), n * 4 - 2 - len(heads[p.name].encode())
            if room <= 0:
                share[p.name] = 0
                continue
            if len(raw) > room:
                raw = raw[-room:] if how == "headdrop" else raw[:room]
            out.append(heads[p.name] + raw.decode("utf-8", "ignore"))
        return "\n\n".join(out), share


class Recipes:
    """Named, versioned context queries; the newest version counts unless one is asked for."""

    def __init__(self):
        self.rows: list[tuple[str, int, str]] = []

    def save(self, name: str, sql: str) -> int:
        parse(sql)
        version = max([v for n, v, _ in self.rows if n == name], default=0) + 1
        self.rows.append((name, version, sql))
        return version

    def get(self, name: str, version: int | None = None) -> str:
        found = [(v, s) for n, v, s in self.rows if n == name and version in (None, v)]
        if not found:
            raise KeyError(name)
        return max(found)[1]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "name string, version int, query string")


def stream(df: DataFrame, name: str, budget: int):
    """Chunks of a result under a rolling budget: ('header', text), ('row', text) ..., ('complete', tokens used)."""
    used, head = 0, toon.header(name, 0, df.columns).replace("[0]", "[*]")
    used += math.ceil(len(head) / 4)
    yield "header", head
    for r in toon.rows(df).toLocalIterator(prefetchPartitions=False):
        n = math.ceil((len(r["line"].encode()) + 1) / 4)
        if used + n > budget:
            break
        used += n
        yield "row", r["line"]
    yield "complete", used
