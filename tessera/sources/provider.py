"""User sources as Spark data sources with column and filter pushdown.

A provider has ``schema()`` and ``scan(columns, part)``, which yields Arrow record
batches; ``parts()`` may name independent parts, each read by one task.  A provider
with ``pushdown = True`` has ``scan(columns, part, filters)`` instead: filters are
(operator, column, value) triples that all hold for the rows wanted.  They are
hints, as Spark applies every filter again, so a provider may use any of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_providers: dict[str, Any] = {}


def register(spark: SparkSession, name: str, provider: Any) -> None:
    """Make ``spark.read.format(name)`` read from the provider."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self):
            return provider.schema()

        def reader(self, schema):
            return (_PushedReader if getattr(provider, "pushdown", False) else _Reader)(provider, schema)

    _providers[name] = provider
    if getattr(provider, "pushdown", False):
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Source)


class _Part(InputPartition):
    def __init__(self, value: Any):
        self.value = value


class _Reader(DataSourceReader):
    def __init__(self, provider: Any, schema):
        self.provider, self.names = provider, schema.fieldNames()

    def partitions(self):
        return [_Part(p) for p in getattr(self.provider, "parts", lambda: [None])()]

    def read(self, partition: _Part) -> Iterator:
        yield from self.provider.scan(self.names, partition.value)


_OPERATORS = {D.EqualTo: "==", D.EqualNullSafe: "<=>", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<=", D.In: "in", D.IsNull: "is null", D.IsNotNull: "is not null", D.StringStartsWith: "starts with", D.StringEndsWith: "ends with", D.StringContains: "contains"}


class _PushedReader(_Reader):
    def __init__(self, provider: Any, schema):
        super().__init__(provider, schema)
        self.filters: list[tuple] = []

    def pushFilters(self, filters):
        """Tells the provider of all simple filters on whole columns and hands every filter back to Spark."""
        for f in filters:
            if type(f) in _OPERATORS and len(f.attribute) == 1:
                self.filters.append((_OPERATORS[type(f)], f.attribute[0], getattr(f, "value", None)))
            yield f

    def read(self, partition: _Part) -> Iterator:
        yield from self.provider.scan(self.names, partition.value, self.filters)
