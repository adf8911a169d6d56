"""The tables of an engine: schema ``main``, numbers in order of creation, columns with logical types."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quillon import types as Q
from quillon.errors import CatalogError

SCHEMA, SCHEMA_OID = "main", 1


@dataclass
class Table:
    """``path`` is where rows are added; a table without one is a view of a source."""

    name: str
    oid: int
    schema: T.StructType
    path: str | None = None


class Catalog:
    def __init__(self, spark: SparkSession):
        self.spark, self._tables, self._oids = spark, {}, itertools.count(SCHEMA_OID + 1)

    def add(self, name: str, schema: T.StructType, path: str | None = None, *, replace: bool = False) -> Table:
        if name.lower() in self._tables and not replace:
            raise CatalogError(f"table {name} exists already")
        self._tables[name.lower()] = table = Table(name, next(self._oids), schema, path)
        return table

    def get(self, name: str) -> Table:
        if name.lower() not in self._tables:
            raise CatalogError(f"table {name} does not exist")
        return self._tables[name.lower()]

    def __contains__(self, name: str) -> bool:
        return name.lower() in self._tables

    def __iter__(self):
        return iter(self._tables.values())

    def tables(self) -> DataFrame:
        rows = [(SCHEMA, SCHEMA_OID, t.name, t.oid) for t in self]
        return self.spark.createDataFrame(rows, "schema_name string, schema_oid int, table_name string, table_oid int")

    def columns(self) -> DataFrame:
        listed = lambda xs: f"[{', '.join(xs)}]"
        rows = [(t.name, listed(t.schema.names), listed(map(Q.logical_name, t.schema))) for t in self]
        return self.spark.createDataFrame(rows, "table_name string, column_names string, column_types string")
