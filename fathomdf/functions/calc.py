"""Arithmetic expressions in text, parsed here and run as columns.

Grammar: + - * / % ^ (right to left), unary -, numbers, names, parentheses and calls. Conditions are numbers: if(c, a, b)
takes a where c is not 0. Division by zero is an error, as in the rest of ANSI mode.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _round(x: Column, n: Column | None = None) -> Column:
    if n is None:
        return F.round(x)
    scale = F.pow(F.lit(10.0), n)
    return F.round(x * scale) / scale


FUNCTIONS: dict[str, Callable[..., Column]] = {
    "abs": F.abs, "sqrt": F.sqrt, "floor": lambda x: F.floor(x).cast("double"), "ceil": lambda x: F.ceil(x).cast("double"), "round": _round,
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "exp": F.exp, "ln": F.ln, "log": F.ln, "log10": F.log10, "log2": F.log2, "pow": F.pow, "atan2": F.atan2,
    "min": lambda *xs: F.least(*xs) if len(xs) > 1 else xs[0], "max": lambda *xs: F.greatest(*xs) if len(xs) > 1 else xs[0],
    "sum": lambda *xs: reduce(lambda a, b: a + b, xs), "avg": lambda *xs: reduce(lambda a, b: a + b, xs) / len(xs), "if": lambda c, a, b: F.when(c != 0, a).otherwise(b),
}

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|([A-Za-z_]\w*)|(.))")


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at = [], 0
        for number, name, other in _TOKEN.findall(text.strip()):
            self.tokens.append(("number", number) if number else ("name", name) if name else ("op", other))

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] == "op" else None

    def take(self, *ops: str) -> str | None:
        if self.peek() in ops and self.peek() is not None:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, op: str) -> None:
        if not self.take(op):
            raise ValueError(f"expected {op!r}")

    def sum_(self) -> Column:
        x = self.product()
        while op := self.take("+", "-"):
            y = self.product()
            x = x + y if op == "+" else x - y
        return x

    def product(self) -> Column:
        x = self.unary()
        while op := self.take("*", "/", "%"):
            y = self.unary()
            x = x * y if op == "*" else x / y if op == "/" else x % y
        return x

    def unary(self) -> Column:
        return -self.unary() if self.take("-") else self.power()

    def power(self) -> Column:
        x = self.atom()
        return F.pow(x, self.unary()) if self.take("^") else x

    def atom(self) -> Column:
        if self.take("("):
            x = self.sum_()
            self.need(")")
            return x
        if self.at >= len(self.tokens) or self.tokens[self.at][0] == "op":
            raise ValueError("expected a value")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return F.lit(float(text))
        if not self.take("("):
            return F.col(text).cast("double")
        args = []
        if not self.take(")"):
            args.append(self.sum_())
            while self.take(","):
                args.append(self.sum_())
            self.need(")")
        if text.lower() not in FUNCTIONS:
            raise ValueError(f"unknown function {text}")
        return FUNCTIONS[text.lower()](*args)


def calc(text: str) -> Column:
    p = _Parser(text)
    out = p.sum_()
    if p.at != len(p.tokens):
        raise ValueError(f"unexpected {p.tokens[p.at][1]!r}")
    return out
