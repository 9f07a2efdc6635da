"""Queries by path: a table, or a struct or map within it, narrowed, projected, ordered and cut in steps that build one plan."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomdf.operators.filters import Atom, Filter


@dataclass(frozen=True)
class PathQuery:
    """`PathQuery(spark, "orders")`, or `"orders.address"` for the fields of a struct column; every step gives a new query."""

    spark: SparkSession
    path: str
    atoms: tuple[Atom, ...] = ()
    columns: tuple[str, ...] = ()
    by: tuple[str, bool] | None = None
    most: int | None = None
    skip: int = 0

    def into(self, step: str) -> PathQuery:
        return replace(self, path=f"{self.path}.{step}")

    def where(self, op: str, field: str, value=None) -> PathQuery:
        """op: those of filters.Atom, and gt, ge, lt, le."""
        bound = {"gt": (value, None, True, False), "ge": (value, None, False, False), "lt": (None, value, False, True), "le": (None, value, False, False)}
        return replace(self, atoms=(*self.atoms, Atom("range", field, bound[op]) if op in bound else Atom(op, field, value)))

    def project(self, *columns: str) -> PathQuery:
        return replace(self, columns=columns)

    def order(self, field: str, desc: bool = False) -> PathQuery:
        return replace(self, by=(field, desc))

    def limit(self, n: int, offset: int = 0) -> PathQuery:
        return replace(self, most=n, skip=offset)

    def rows(self) -> DataFrame:
        """The result; a path into a struct selects its fields, one into anything else its value."""
        table, _, rest = self.path.partition(".")
        df = self.spark.table(table)
        if rest:
            kind = df.select(rest).schema[0].dataType
            df = df.select(f"{rest}.*") if kind.typeName() == "struct" else df.select(F.col(rest).alias(rest.rpartition(".")[2]))
        for a in self.atoms:
            df = Filter(((a,),)).apply(df)
        if self.by:
            df = df.orderBy(F.desc_nulls_last(self.by[0]) if self.by[1] else F.asc_nulls_first(self.by[0]))
        df = df.offset(self.skip) if self.skip else df
        df = df.limit(self.most) if self.most is not None else df
        return df.select(*self.columns) if self.columns else df
