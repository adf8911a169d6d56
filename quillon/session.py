"""The engine: statements of the dialect on a Spark session of its own.

Queries become lazy frames that Catalyst plans. Tables are Parquet folders in the warehouse, which driver and executors
share; INSERT adds files to them, committed by Spark, so a lost executor leaves no half-written rows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quillon import dml
from quillon import types as Q
from quillon.catalog import Catalog
from quillon.dialect import Rewriter
from quillon.errors import BindError, CatalogError, ParseError, UnsupportedStatement
from quillon.plans.inspect import plan_texts
from quillon.sources.csvio import read_csv
from quillon.sources.parquet import read_parquet
from quillon.tokens import Group, Token, statements


class Engine:
    """A fresh database on the cluster of ``spark``; ``strict`` refuses to compare numbers, texts and dates with each other."""

    def __init__(self, spark: SparkSession, *, strict: bool = True):
        self.spark = spark.newSession()
        for key, value in spark.conf.getAll.items():
            if key.startswith("spark.sql.") and self.spark.conf.isModifiable(key):
                self.spark.conf.set(key, value)
        for key in ("spark.sql.ansi.enabled", "spark.sql.groupByAliases"):
            self.spark.conf.set(key, "true")
        self.catalog = Catalog(self.spark)
        self._root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/quillon-{uuid.uuid4().hex}"
        self._views: dict[tuple, str] = {}
        functions = {"engine_tables": lambda: self._view("tables", self.catalog.tables()), "engine_columns": lambda: self._view("columns", self.catalog.columns())}
        self._rewriter = Rewriter(self.spark, self._csv_view, functions, strict=strict)

    # -- tables -------------------------------------------------------------------------------------------------

    def register(self, name: str, df: DataFrame) -> None:
        """A frame as a table that is read only."""
        self.catalog.add(name, df.schema)
        self._own(df).createOrReplaceTempView(f"`{name}`")

    def load_csv(self, name: str, path: str, *, delim: str = ",", header: bool = True) -> None:
        self.register(name, read_csv(self.spark, path, delim=delim, header=header))

    def load_parquet(self, name: str, path: str) -> None:
        self.register(name, self.spark.read.parquet(path))

    def load_parquet_dir(self, folder: str, names: Iterable[str]) -> None:
        """Tables ``names`` of a folder of Parquet tables."""
        for name in names:
            self.register(name, read_parquet(self.spark, folder, name))

    def _own(self, df: DataFrame) -> DataFrame:
        """The frame in the engine's session, so that its views are found there: sessions share global views."""
        if df.sparkSession is self.spark:
            return df
        name = f"quillon_{uuid.uuid4().hex}"
        df.createOrReplaceGlobalTempView(name)
        return self.spark.table(f"global_temp.{name}")

    def _view(self, what: str, df: DataFrame) -> str:
        name = f"__{what}_{uuid.uuid4().hex}"
        self._own(df).createOrReplaceTempView(name)
        return name

    def _csv_view(self, path: str, options: dict[str, str]) -> str:
        if unknown := set(options) - {"delim", "header"}:
            raise BindError(f"read_csv has no option {', '.join(sorted(unknown))}")
        key = (path, *sorted(options.items()))
        if key not in self._views:
            self._views[key] = self._view("csv", read_csv(self.spark, path, delim=options.get("delim", ","), header=_flag(options.get("header", "true"))))
        return self._views[key]

    # -- statements ---------------------------------------------------------------------------------------------

    def run(self, script: str) -> list[DataFrame]:
        """Run every statement of a script in turn; a frame for each."""
        return [self._statement(nodes) for nodes in statements(script)]

    def sql(self, text: str) -> DataFrame:
        """Run one statement."""
        found = statements(text)
        if len(found) != 1:
            raise ParseError(f"one statement is needed, not {len(found)}")
        return self._statement(found[0])

    def show_tables(self) -> DataFrame:
        return self.catalog.tables().select("schema_name", "table_name")

    def explain(self, query: str) -> str:
        """The plan of a query before and after optimization."""
        analyzed, optimized, _ = plan_texts(self.sql(query))
        return f"original plan:\n{analyzed}\noptimized plan:\n{optimized}"

    def _statement(self, nodes: list) -> DataFrame:
        first = nodes[0]
        if isinstance(first, Group) or first.is_word("SELECT", "WITH", "VALUES"):
            return self._query(nodes)
        kind = first.value.upper()
        if kind == "CREATE":
            return self._create(dml.parse_create(nodes))
        if kind == "INSERT":
            parsed = dml.parse_insert(nodes)
            return self._insert(parsed.name, parsed.columns, self._query(parsed.query))
        if kind == "COPY":
            return self._copy(dml.parse_copy(nodes))
        if kind == "EXPLAIN":
            return self._explain(nodes[2:] if len(nodes) > 1 and nodes[1].is_word("ANALYZE") else nodes[1:])
        if kind == "SHOW" and len(nodes) == 2 and nodes[1].is_word("TABLES"):
            return self.show_tables()
        if kind in ("DESCRIBE", "DESC"):
            table = self.catalog.get(dml.table_name(nodes, 1)[0])
            return self.catalog.columns().filter(f"table_name = {Token('string', table.name).sql()}")
        raise UnsupportedStatement(f"{kind} is not supported")

    def _query(self, nodes: list) -> DataFrame:
        return self.spark.sql(self._rewriter.query(nodes))

    def _create(self, what: dml.Create) -> DataFrame:
        if what.name in self.catalog and what.missing_only:
            return self._line(f"CREATE TABLE {what.name}")
        if what.name in self.catalog and not what.replace:
            raise CatalogError(f"table {what.name} exists already")
        rows = self._query(what.query) if what.query is not None else None
        if rows is not None:
            fields = [Q.of_field(f).field(f.name.lower()) for f in rows.schema]
            if len({f.name for f in fields}) != len(fields):
                raise BindError("columns of one name")
        schema = T.StructType(what.columns if rows is None else fields)
        path = f"{self._root}/{what.name.lower()}-{uuid.uuid4().hex}"
        rows = self.spark.createDataFrame([], schema) if rows is None else dml.fitted(rows, schema, None)
        rows.write.parquet(path)
        self.catalog.add(what.name, schema, path, replace=what.replace)
        self._refresh(what.name)
        return self._line(f"CREATE TABLE {what.name}")

    def _insert(self, name: str, columns: list[str] | None, rows: DataFrame) -> DataFrame:
        table = self.catalog.get(name)
        if table.path is None:
            raise BindError(f"{name} is read only")
        dml.fitted(rows, table.schema, columns).write.mode("append").parquet(table.path)
        self._refresh(name)
        return self.spark.createDataFrame([], T.StructType([]))

    def _copy(self, what: dml.Copy) -> DataFrame:
        if unknown := set(what.options) - {"delimiter", "delim", "header", "format"}:
            raise BindError(f"COPY has no option {', '.join(sorted(unknown))}")
        delim, header = what.options.get("delimiter", what.options.get("delim", ",")), _flag(what.options.get("header", "true"))
        if not what.into_table:
            rows = self._query(what.target) if isinstance(what.target, list) else self.spark.table(f"`{what.target}`").select(*(what.columns or ["*"]))
            rows.write.option("sep", delim).option("header", header).option("escape", '"').csv(what.path)
            return self.spark.createDataFrame([], T.StructType([]))
        table = self.catalog.get(what.target)
        by_name = {f.name.lower(): f for f in table.schema}
        names = what.columns or list(by_name)
        if unknown := [n for n in names if n not in by_name]:
            raise BindError(f"no such column: {', '.join(unknown)}")
        # read as the table's own types: no pass to infer them, and text such as 007 stays as it is
        schema = T.StructType([T.StructField(n, by_name[n].dataType) for n in names])
        return self._insert(what.target, names, read_csv(self.spark, what.path, delim=delim, header=header, schema=schema))

    def _explain(self, nodes: list) -> DataFrame:
        if nodes and nodes[0].is_word("INSERT"):
            nodes = dml.parse_insert(nodes).query
        elif nodes and nodes[0].is_word("CREATE"):
            nodes = dml.parse_create(nodes).query
        if not nodes or not (isinstance(nodes[0], Group) or nodes[0].is_word("SELECT", "WITH", "VALUES")):
            raise UnsupportedStatement("EXPLAIN needs a query")
        rows = list(zip(("logical_plan", "logical_plan_opt", "physical_plan"), plan_texts(self._query(nodes)), strict=True))
        return self.spark.createDataFrame(rows, "explain_type string, explain_value string")

    def _refresh(self, name: str) -> None:
        table = self.catalog.get(name)
        self.spark.read.schema(table.schema).parquet(table.path).createOrReplaceTempView(f"`{name}`")

    def _line(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(text,)], "success string")


def _flag(text: str) -> bool:
    if not re.fullmatch(r"(?i)true|false|1|0|on|off", text):
        raise BindError(f"true or false is needed, not {text}")
    return text.lower() in ("true", "1", "on")


