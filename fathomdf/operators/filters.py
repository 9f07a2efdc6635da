"""Filters as data: conjunctions of disjunctions of atoms, built fluently, negated, simplified, and turned into columns.

Null semantics are SQL's: an atom over a null is unknown, and the row does not pass.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Atom:
    """op: eq ne in not_in range prefix contains has_tag like is_null not_null true false.

    range takes (low, high, low_open, high_open); a bound of None is open-ended.
    """

    op: str
    field: str = ""
    value: object = None

    def column(self) -> Column:
        c = F.col(self.field) if self.field else None
        v = self.value
        if self.op == "range":
            low, high, low_open, high_open = v
            parts = []
            if low is not None:
                parts.append(c > low if low_open else c >= low)
            if high is not None:
                parts.append(c < high if high_open else c <= high)
            return reduce(and_, parts) if parts else c.isNotNull()
        return {
            "eq": lambda: c == v, "ne": lambda: c != v, "in": lambda: c.isin(list(v)), "not_in": lambda: ~c.isin(list(v)),
            "prefix": lambda: c.startswith(v), "contains": lambda: c.contains(v), "has_tag": lambda: F.array_contains(c, v), "like": lambda: c.like(v),
            "is_null": lambda: c.isNull(), "not_null": lambda: c.isNotNull(), "true": lambda: F.lit(True), "false": lambda: F.lit(False),
        }[self.op]()

    def negate(self) -> list[Atom]:
        """The disjunction that holds where this atom is false."""
        pair = {"eq": "ne", "ne": "eq", "in": "not_in", "not_in": "in", "is_null": "not_null", "not_null": "is_null", "true": "false", "false": "true"}
        if self.op in pair:
            return [Atom(pair[self.op], self.field, self.value)]
        if self.op == "range":
            low, high, low_open, high_open = self.value
            out = []
            if low is not None:
                out.append(Atom("range", self.field, (None, low, False, not low_open)))
            if high is not None:
                out.append(Atom("range", self.field, (high, None, not high_open, False)))
            return out or [Atom("is_null", self.field)]
        return [Atom("not", self.field, self)]


@dataclass(frozen=True)
class Filter:
    """A conjunction of clauses; a clause is a disjunction of atoms. No clauses: everything passes."""

    clauses: tuple[tuple[Atom, ...], ...] = field(default=())

    def column(self) -> Column:
        return reduce(and_, [reduce(or_, [_column(a) for a in c]) if c else F.lit(False) for c in self.clauses], F.lit(True))

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(self.simplify().column())

    def both(self, other: Filter) -> Filter:
        return Filter(self.clauses + other.clauses)

    def either(self, other: Filter) -> Filter:
        """Distributes or over and."""
        if not self.clauses or not other.clauses:
            return Filter()
        return Filter(tuple(a + b for a in self.clauses for b in other.clauses))

    def negate(self) -> Filter:
        out = Filter(((),))
        for c in self.clauses:
            out = out.either(Filter(tuple(tuple(a.negate()) for a in c))) if out.clauses != ((),) else Filter(tuple(tuple(a.negate()) for a in c))
        return out if self.clauses else Filter(((Atom("false"),),))

    def simplify(self) -> Filter:
        """Drops clauses that hold anyway and atoms that never do; a clause left empty makes the whole false."""
        out: list[tuple[Atom, ...]] = []
        for c in self.clauses:
            c = tuple(dict.fromkeys(a for a in c if a.op != "false"))
            if any(a.op == "true" for a in c):
                continue
            if not c:
                return Filter(((Atom("false"),),))
            if c not in out:
                out.append(c)
        return Filter(tuple(out))


def _column(a: Atom) -> Column:
    return ~a.value.column() if a.op == "not" else a.column()


class Build:
    """Fluent filters: Build().eq('lang', 'en').between('n_chars', 10, 99).filter."""

    def __init__(self):
        self.filter = Filter()

    def _add(self, *atoms: Atom) -> Build:
        self.filter = Filter((*self.filter.clauses, atoms))
        return self

    def eq(self, f, v): return self._add(Atom("eq", f, v))  # noqa: E704
    def ne(self, f, v): return self._add(Atom("ne", f, v))  # noqa: E704
    def isin(self, f, vs): return self._add(Atom("in", f, tuple(vs)))  # noqa: E704
    def not_in(self, f, vs): return self._add(Atom("not_in", f, tuple(vs)))  # noqa: E704
    def gt(self, f, v): return self._add(Atom("range", f, (v, None, True, False)))  # noqa: E704
    def ge(self, f, v): return self._add(Atom("range", f, (v, None, False, False)))  # noqa: E704
    def lt(self, f, v): return self._add(Atom("range", f, (None, v, False, True)))  # noqa: E704
    def le(self, f, v): return self._add(Atom("range", f, (None, v, False, False)))  # noqa: E704
    def between(self, f, a, b): return self._add(Atom("range", f, (a, b, False, False)))  # noqa: E704
    def prefix(self, f, v): return self._add(Atom("prefix", f, v))  # noqa: E704
    def contains(self, f, v): return self._add(Atom("contains", f, v))  # noqa: E704
    def tag(self, f, v): return self._add(Atom("has_tag", f, v))  # noqa: E704
    def namespace(self, v): return self.eq("namespace", v)  # noqa: E704
    def ids(self, vs, f="doc_id"): return self.isin(f, vs)  # noqa: E704
    def time_range(self, a, b, f="ts"): return self.between(f, a, b)  # noqa: E704
    def any(self, *atoms: Atom): return self._add(*atoms)  # noqa: E704


@dataclass(frozen=True)
class Scope:
    """What a caller may see; always joined by AND to the caller's own filter. A scope that names nothing shows nothing, unless
    it is said to show everything.
    """

    namespaces: tuple[str, ...] = ()
    tenant: str | None = None
    project: str | None = None
    tags: tuple[str, ...] = ()
    everything: bool = False

    def filter(self) -> Filter:
        b = Build()
        if self.namespaces:
            b.isin("namespace", self.namespaces)
        for name, v in (("tenant", self.tenant), ("project", self.project)):
            if v is not None:
                b.eq(name, v)
        if self.tags:
            b.any(*(Atom("has_tag", "acl_tags", t) for t in self.tags))
        return b.filter

    def apply(self, df: DataFrame, user: Filter | None = None) -> DataFrame:
        if not (self.everything or self.namespaces or self.tags or self.tenant is not None or self.project is not None):
            return df.where(F.lit(False))
        return self.filter().both(user or Filter()).apply(df)


def allowed(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows of an allowed set."""
    return df.join(ids.select(on).distinct(), on, "left_semi")


def without(df: DataFrame, deleted: DataFrame, on: str) -> DataFrame:
    """Rows that aren't deleted."""
    return df.join(deleted.select(on), on, "left_anti")
