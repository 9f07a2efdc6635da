"""Virtual tables: a plugin of rows behind Spark's Python data source interface, with filters pushed to it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from fathomdf.session import ship

SUPPORTED = (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)


class Plugin:
    """A table of one's own: a DDL schema, partitions, and rows of a partition for given (column, operator, value) filters."""

    schema: str = ""
    parts: int = 1

    def rows(self, part: int, filters: list[tuple]) -> Iterator[tuple]:
        raise NotImplementedError


def source(name: str, plugin: Callable[[dict], Plugin]) -> type[DataSource]:
    """A data source class that reads from a plugin made from the reader's options."""

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.options, self.filters = options, []

        def pushFilters(self, filters: list) -> Iterator:
            for f in filters:
                if isinstance(f, SUPPORTED):
                    self.filters.append((f.attribute[0], type(f).__name__, getattr(f, "value", None)))
                yield f  # Spark checks again, so a plugin may use a filter in part

        def partitions(self) -> list[InputPartition]:
            return [InputPartition(i) for i in range(plugin(self.options).parts)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            yield from plugin(self.options).rows(partition.value, self.filters)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return plugin(dict(self.options)).schema

        def reader(self, schema) -> DataSourceReader:
            return Reader(dict(self.options))

    return Source


def scan(spark: SparkSession, kind: type[DataSource], **options: str) -> DataFrame:
    ship(spark)
    spark.dataSource.register(kind)
    return spark.read.format(kind.name()).options(**options).load()
