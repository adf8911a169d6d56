"""The queries that cover the engine's operators, over whole tables, and the same in DuckDB's SQL.

Most are statements of the dialect; what is about a DataFrame operator is built from those.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import date_plus, divide
from quillon.operators.aggregate import aggregate, count_distinct_by, distinct
from quillon.operators.joins import join, salted_join
from quillon.operators.ordering import top_k
from quillon.operators.subqueries import with_scalar
from quillon.session import Engine
from quillon.sources.parquet import read_parquet

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
Query = Callable[[SparkSession, str], DataFrame]


def dialect(text: str) -> Query:
    """A statement over the tables that it names; of a script, the last statement's rows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark)
        engine.load_parquet_dir(sf_dir, [t for t in TABLES if re.search(rf"\b{t}\b", text)])
        return engine.run(text)[-1]

    return run


def on_tables(*names: str) -> Callable[[Callable[..., DataFrame]], Query]:
    """A query from a function of frames."""
    return lambda fn: lambda spark, sf_dir: fn(*[read_parquet(spark, sf_dir, n) for n in names])


_TRUTH = "VALUES (true, true), (true, false), (true, NULL), (false, true), (false, false), (false, NULL), (NULL, true), (NULL, false), (NULL, NULL)"
_REVENUE = "CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(12,2)))) AS DOUBLE)"

#: name: the statement, and its SQL for DuckDB where that differs (None: the engine's own catalog or plans, which no other has).
STATEMENTS: dict[str, tuple[str, str | None]] = {}


def _both(name: str, text: str, other: str | None = "") -> None:
    STATEMENTS[name] = (text, text if other == "" else other)


_both(
    "flagship",
    f"""SELECT l_returnflag, l_linestatus, count(l_orderkey) AS n_lines, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS quantity, {_REVENUE} AS revenue,
        min(o_totalprice) AS least, max(o_totalprice) AS most, count(DISTINCT o_custkey) AS customers
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate <= CAST('1998-09-02' AS TIMESTAMP) GROUP BY l_returnflag, l_linestatus""",
)
# scans, projection and filters
_both("scan_project", "SELECT o_orderkey, o_orderstatus FROM orders")
_both("project_arith", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_quantity + 1 AS q, l_tax - l_discount AS d FROM lineitem")
_both("int_div_mod", "SELECT o_orderkey, o_orderkey / 7 AS d, o_orderkey % 7 AS m, 7 / 2 AS k FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS d, o_orderkey % 7 AS m, 7 // 2 AS k FROM orders")
_both("float_div", "SELECT o_orderkey, o_totalprice / 7 AS d, o_orderkey / 2.0 AS h FROM orders", "SELECT o_orderkey, o_totalprice / 7 AS d, o_orderkey / 2.0::DOUBLE AS h FROM orders")
_both("filter_and", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
_both("filter_or", "SELECT o_orderkey FROM orders WHERE o_orderkey < 100 OR o_orderpriority = '1-URGENT'")
_both("filter_cmp", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 20 AND l_linenumber != 3 AND l_returnflag <> 'R'")
_both("kleene_logic", f"SELECT a, b, a AND b AS c, a OR b AS d FROM ({_TRUTH}) t(a, b)")
_both("alias_in_where", "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice FROM lineitem WHERE twice > 90", "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice FROM lineitem WHERE l_quantity * 2 > 90")
_both("alias_shadowed", "SELECT o_orderkey, o_custkey AS o_orderkey2, o_totalprice AS o_custkey FROM orders WHERE o_custkey < 50", "SELECT o_orderkey, o_custkey AS o_orderkey2, o_totalprice AS o_custkey FROM orders WHERE orders.o_custkey < 50")
_both("group_by_alias", "SELECT sum(l_linenumber) AS s, l_returnflag AS flag FROM lineitem GROUP BY flag", "SELECT CAST(sum(l_linenumber) AS BIGINT) AS s, l_returnflag AS flag FROM lineitem GROUP BY flag")
_both("order_by_alias", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY p DESC, k LIMIT 25", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY p DESC NULLS FIRST, k LIMIT 25")
_both("star_qualified", "SELECT n.* FROM nation n")
_both("star_all", "SELECT * FROM region")
_both("table_alias", "SELECT t.n_name, u.r_name FROM nation AS t, region u WHERE t.n_regionkey = u.r_regionkey")
_both("quoted_names", 'SELECT "r_name" AS "Name of it" FROM "region" WHERE "r_regionkey" > 1')
# joins
_both("join_inner", "SELECT n_name, r_name FROM nation INNER JOIN region ON n_regionkey = r_regionkey")
_both("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
_both("join_right", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey")
_both("join_full", "SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey + 5")
for _how in ("left", "right", "full"):
    _both(f"join_residual_{_how}", f"SELECT c_custkey, o_orderkey FROM customer {_how.upper()} JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000 AND c_mktsegment != 'BUILDING'")
_both("join_theta", "SELECT a.n_name AS one, b.n_name AS two FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
_both("join_cross", "SELECT n_name, r_name FROM nation CROSS JOIN region")
_both("join_comma_filter", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_name != 'ASIA'")
_both(
    "join_multiway",
    f"SELECT n_name, {_REVENUE} AS revenue, count(l_orderkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
)
_both("join_null_keys", "SELECT t.a, u.b FROM (VALUES (1), (NULL), (2)) t(a) FULL JOIN (VALUES (1), (NULL), (3)) u(b) ON t.a = u.b")
_both("join_comma_mixed", "SELECT r.r_name, n.n_name, s.s_name FROM region r, nation n LEFT JOIN supplier s ON n.n_nationkey = s.s_nationkey WHERE r.r_regionkey = n.n_regionkey")
# aggregation
_both("agg_global", "SELECT sum(l_linenumber) AS s, count(l_tax) AS n, min(l_shipdate) < max(l_shipdate) AS o, min(l_quantity) AS q, max(l_returnflag) AS f FROM lineitem", "SELECT CAST(sum(l_linenumber) AS BIGINT) AS s, count(l_tax) AS n, min(l_shipdate) < max(l_shipdate) AS o, min(l_quantity) AS q, max(l_returnflag) AS f FROM lineitem")
_both("agg_group", "SELECT o_orderpriority, count(o_orderkey) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY o_orderpriority")
_both("agg_multi_key", "SELECT l_returnflag, l_linestatus, l_linenumber, count(l_orderkey) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber")
_both("agg_expr", "SELECT l_returnflag, sum(l_linenumber + 1) + 1 AS a, max(l_linenumber) * 2 - min(l_linenumber) AS b FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(sum(l_linenumber + 1) + 1 AS BIGINT) AS a, max(l_linenumber) * 2 - min(l_linenumber) AS b FROM lineitem GROUP BY l_returnflag")
_both("agg_having", "SELECT o_custkey, count(o_orderkey) AS n FROM orders GROUP BY o_custkey HAVING count(o_orderkey) > 12")
_both("count_distinct", "SELECT count(DISTINCT event_type) AS types, count(DISTINCT user_id) AS users FROM events")
_both("sum_distinct", "SELECT p_brand, sum(DISTINCT p_size) AS s FROM part GROUP BY p_brand", "SELECT p_brand, CAST(sum(DISTINCT p_size) AS BIGINT) AS s FROM part GROUP BY p_brand")
_both("select_distinct", "SELECT DISTINCT p_brand, p_size FROM part")
_both("agg_null_groups", "SELECT a, b, count(c) AS n, sum(c) AS s FROM (VALUES (1, NULL, 5), (NULL, 1, 6), (1, NULL, NULL), (NULL, NULL, 7)) t(a, b, c) GROUP BY a, b", "SELECT a, b, count(c) AS n, CAST(sum(c) AS BIGINT) AS s FROM (VALUES (1, NULL, 5), (NULL, 1, 6), (1, NULL, NULL), (NULL, NULL, 7)) t(a, b, c) GROUP BY a, b")
_both("agg_empty_input", "SELECT count(o_orderkey) AS n, sum(o_custkey) AS s, min(o_orderstatus) AS m FROM orders WHERE o_orderkey < 0", "SELECT count(o_orderkey) AS n, CAST(sum(o_custkey) AS BIGINT) AS s, min(o_orderstatus) AS m FROM orders WHERE o_orderkey < 0")
_both("group_by_empty_input", "SELECT o_orderstatus, count(o_orderkey) AS n FROM orders WHERE o_orderkey < 0 GROUP BY o_orderstatus")
# order and limits
_NULLED = "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS v FROM orders"
_both("sort_nulls_first", f"SELECT k, v FROM ({_NULLED}) t ORDER BY v DESC, k LIMIT 1000", f"SELECT k, v FROM ({_NULLED}) t ORDER BY v DESC NULLS FIRST, k LIMIT 1000")
_both("sort_multi", "SELECT c_custkey, c_nationkey FROM customer ORDER BY c_nationkey, c_acctbal DESC, c_custkey LIMIT 40", "SELECT c_custkey, c_nationkey FROM customer ORDER BY c_nationkey NULLS FIRST, c_acctbal DESC NULLS FIRST, c_custkey LIMIT 40")
_both("sort_unselected", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 7")
_both("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 10 LIMIT 4 + 1", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 10")
_both("offset_only", "SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 100")
_both("limit_zero", "SELECT o_orderkey FROM orders LIMIT 0")
# subqueries
_both("derived_table", "SELECT t.c_name FROM (SELECT c_name, c_acctbal FROM customer WHERE c_acctbal > 5000) t WHERE t.c_acctbal < 6000")
_both("nested_derived", "SELECT u.k FROM (SELECT t.o_orderkey AS k, t.o_custkey FROM (SELECT * FROM orders WHERE o_totalprice > 1000) t WHERE t.o_custkey > 5) u WHERE u.k > 7")
_both("scalar_sub_select", "SELECT n_name, (SELECT max(r_regionkey) FROM region) AS m FROM nation")
_both("scalar_sub_where", "SELECT o_orderkey FROM orders WHERE o_totalprice >= (SELECT max(o_totalprice) FROM orders) OR o_orderkey = (SELECT min(o_orderkey) FROM orders)")
_both("scalar_sub_arith", "SELECT r_name, (SELECT max(n_nationkey) FROM nation) + (SELECT min(n_nationkey) FROM nation) + 2 AS m FROM region")
# scalar functions
_both("date_plus_interval", "SELECT o_orderkey, CAST(o_orderdate AS DATE) + INTERVAL '1' DAY AS d, CAST(o_orderdate AS DATE) + INTERVAL '5' HOUR AS h FROM orders", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 DAY AS DATE) AS d, CAST(CAST(o_orderdate AS DATE) + INTERVAL 5 HOUR AS DATE) AS h FROM orders")
_both("interval_plus_date", "SELECT INTERVAL '1' YEAR + DATE '1998-12-01' AS y, INTERVAL '2' WEEK + DATE '1998-12-01' AS w", "SELECT DATE '1999-12-01' AS y, DATE '1998-12-15' AS w")
_both("date_minus_month", "SELECT o_orderkey, CAST(o_orderdate AS DATE) - INTERVAL '1' MONTH AS d FROM orders", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - INTERVAL 1 MONTH AS DATE) AS d FROM orders")
_both("date_typed_string", "SELECT DATE '2021-02-03' AS d, DATE 'no date' AS n", "SELECT DATE '2021-02-03' AS d, TRY_CAST('no date' AS DATE) AS n")
_both("casts", "SELECT o_orderkey, CAST(o_totalprice AS BIGINT) % 10 >= 0 AS a, CAST(o_orderkey AS VARCHAR(20)) AS t, CAST('12' AS INT) AS i FROM orders")
_both("values_list", "VALUES (1, 'a', true), (2, NULL, false), (NULL, 'it''s', NULL)")
_both("select_const", "SELECT 1 AS i, CAST(2.5 AS DOUBLE) AS f, '😇' AS s, true AS b, NULL AS n", "SELECT 1 AS i, CAST(2.5 AS DOUBLE) AS f, '😇' AS s, true AS b, CAST(NULL AS VARCHAR) AS n")
_both("compare_strings", "SELECT '1000' > '20' AS a, 'b' >= 'a' AS b, 100 > 20 AS c, 2.5 > 2 AS d")
# tables
_both("ctas", "CREATE TABLE big AS SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_totalprice > 100000; SELECT k, p FROM big", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_totalprice > 100000")
_both("insert_defaults", "CREATE TABLE t(a INT, b VARCHAR, c DATE); INSERT INTO t(b, a) VALUES ('x', 1), ('', 2); INSERT INTO t VALUES (3, NULL, '2021-01-02'); SELECT a, b, c FROM t", "SELECT * FROM (VALUES (1, 'x', CAST(NULL AS DATE)), (2, '', NULL), (3, NULL, DATE '2021-01-02')) t(a, b, c)")
_both("insert_select", "CREATE TABLE t(k BIGINT, n TEXT); INSERT INTO t SELECT n_nationkey, n_name FROM nation; INSERT INTO t SELECT k + 100, n FROM t; SELECT k, n FROM t", "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS n FROM nation UNION ALL SELECT n_nationkey + 100, n_name FROM nation")
_both("unsigned_types", "CREATE TABLE t(a TINYINT UNSIGNED, b SMALLINT UNSIGNED, c INT UNSIGNED); INSERT INTO t VALUES (255, 65535, 4294967295), (NULL, 0, 1); SELECT a, b, c FROM t", "SELECT CAST(a AS SMALLINT) AS a, CAST(b AS INTEGER) AS b, CAST(c AS BIGINT) AS c FROM (VALUES (255, 65535, 4294967295), (NULL, 0, 1)) t(a, b, c)")
_both("catalog_tables", "CREATE TABLE a(x INT); CREATE TABLE b AS SELECT r_name FROM region; SELECT schema_name, table_name FROM engine_tables() WHERE table_name != 'region'", "SELECT * FROM (VALUES ('main', 'a'), ('main', 'b')) t(schema_name, table_name)")
_both("catalog_columns", "CREATE TABLE a(x INT, y DOUBLE); SELECT * FROM engine_columns() WHERE table_name = 'a'", "SELECT 'a' AS table_name, '[x, y]' AS column_names, '[Integer, Double]' AS column_types")
_both("show_tables", "CREATE TABLE a(x INT); CREATE TABLE b(y INT); SHOW TABLES", "SELECT * FROM (VALUES ('main', 'a'), ('main', 'b')) t(schema_name, table_name)")
_both("describe", "CREATE TABLE a(x SMALLINT UNSIGNED, y VARCHAR(9)); DESCRIBE a", "SELECT 'a' AS table_name, '[x, y]' AS column_names, '[USmallint, Varchar]' AS column_types")
_both("create_table", "CREATE TABLE a(x INT)", "SELECT 'CREATE TABLE a' AS success")
_both("explain", "EXPLAIN SELECT n_name FROM nation WHERE n_nationkey > 3", None)
_both("minute_second", "SELECT o_orderkey, CAST(o_orderdate AS DATE) + INTERVAL '1440' MINUTE AS m, CAST(o_orderdate AS DATE) + INTERVAL '86399' SECOND AS s FROM orders", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 DAY AS DATE) AS m, CAST(o_orderdate AS DATE) AS s FROM orders")


# -- CSV: written from a table first, into the warehouse that all share -----------------------------------------------


def _csv(text: str, table: str, **options) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark)
        path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/csv-{uuid.uuid4().hex}.csv"
        read_parquet(spark, sf_dir, table).write.options(**options).csv(path)
        return engine.run(text.format(path=path))[-1]

    return run


def _registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written by COPY TO, registered as a CSV table under a name of its own."""
    engine = Engine(spark)
    path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/csv-{uuid.uuid4().hex}.csv"
    engine.load_parquet_dir(sf_dir, ["nation"])
    engine.run(f"COPY (SELECT n_nationkey, n_name FROM nation WHERE n_regionkey > 1) TO '{path}' (DELIMITER ';')")
    engine.load_csv("lands", path, delim=";")
    return engine.sql("SELECT n_name, n_nationkey + 1 AS k FROM lands WHERE n_nationkey > 2")


def _copied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of a table written by COPY TO without a header, and read back by COPY FROM."""
    engine = Engine(spark)
    path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/csv-{uuid.uuid4().hex}.csv"
    engine.load_parquet_dir(sf_dir, ["customer"])
    engine.run(f"COPY customer(c_custkey, c_name) TO '{path}' (DELIMITER '|', HEADER false); CREATE TABLE c(k BIGINT, n VARCHAR); COPY c FROM '{path}' (DELIMITER '|', HEADER false)")
    return engine.sql("SELECT k, n FROM c")


def _explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plans that EXPLAIN lists, in their order, and whether the one that runs filters at the scan."""
    engine = Engine(spark)
    engine.load_parquet_dir(sf_dir, ["nation"])
    rows = engine.sql("EXPLAIN SELECT n_name FROM nation WHERE n_nationkey > 3")
    return rows.select("explain_type", (F.col("explain_value").contains("GreaterThan(n_nationkey,3)") | F.col("explain_value").contains("> 3)")).alias("filters"))


CSV: dict[str, tuple[Query, str]] = {
    "explain_types": (_explained, "SELECT * FROM (VALUES ('logical_plan', true), ('logical_plan_opt', true), ('physical_plan', true)) t(explain_type, filters)"),
    "load_csv": (_registered, "SELECT n_name, CAST(n_nationkey + 1 AS BIGINT) AS k FROM nation WHERE n_regionkey > 1 AND n_nationkey > 2"),
    "copy_to": (_copied, "SELECT c_custkey AS k, c_name AS n FROM customer"),
    "csv_read": (_csv("SELECT n_nationkey, n_name FROM read_csv('{path}') WHERE n_regionkey = 1", "nation", header=True), "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation WHERE n_regionkey = 1"),
    "csv_headerless": (_csv("SELECT column_1, column_2 FROM read_csv('{path}', delim=>'|', header=>false)", "region", sep="|"), "SELECT CAST(r_regionkey AS BIGINT) AS column_1, r_name AS column_2 FROM region"),
    "csv_by_path": (_csv("SELECT t.s_suppkey, t.s_acctbal FROM '{path}' t", "supplier", header=True), "SELECT s_suppkey, s_acctbal FROM supplier"),
    "copy_insert": (_csv("CREATE TABLE r(k INT, n VARCHAR); COPY r FROM '{path}' (DELIMITER '|', HEADER false); SELECT k, n FROM r", "region", sep="|"), "SELECT r_regionkey AS k, r_name AS n FROM region"),
    "copy_columns": (_csv("CREATE TABLE r(n VARCHAR, k BIGINT, z DATE); COPY r(k, n) FROM '{path}' (DELIMITER '|'); SELECT n, k, z FROM r", "region", sep="|", header=True), "SELECT r_name AS n, CAST(r_regionkey AS BIGINT) AS k, CAST(NULL AS DATE) AS z FROM region"),
}

# -- DataFrame operators ----------------------------------------------------------------------------------------------


@on_tables("customer", "orders")
def _frame_join(customer: DataFrame, orders: DataFrame) -> DataFrame:
    return join(customer, orders, [("c_custkey", "o_custkey")], "left", orders["o_totalprice"] > 250000).select("c_custkey", "o_orderkey")


@on_tables("events", "customer")
def _frame_salted(events: DataFrame, customer: DataFrame) -> DataFrame:
    return salted_join(events.select("event_id", "user_id"), customer.select(F.col("c_custkey").alias("user_id"), "c_name"), ["user_id"]).select("event_id", "c_name")


@on_tables("lineitem")
def _frame_distinct_by(lineitem: DataFrame) -> DataFrame:
    return count_distinct_by(lineitem, ["l_returnflag"], "l_partkey", "parts")


@on_tables("orders")
def _frame_top(orders: DataFrame) -> DataFrame:
    return top_k(orders.select("o_orderkey", "o_totalprice"), ["-o_totalprice", "o_orderkey"], 20, skip=5)


@on_tables("orders")
def _frame_scalar(orders: DataFrame) -> DataFrame:
    return with_scalar(orders, orders, most=F.max("o_totalprice")).filter("o_totalprice * 2 > most").select("o_orderkey", "most")


@on_tables("lineitem")
def _frame_functions(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(divide(lineitem, "l_orderkey", "l_linenumber").alias("d"), date_plus(F.col("l_shipdate").cast("date"), "1 month").alias("m"))


@on_tables("events")
def _frame_aggregate(events: DataFrame) -> DataFrame:
    return aggregate(events, ["event_type"], n=F.count("event_id"), low=F.min("value"), high=F.max("value"))


@on_tables("part")
def _frame_distinct(part: DataFrame) -> DataFrame:
    return distinct(part, "p_type")


FRAMES: dict[str, tuple[Query, str]] = {
    "frame_join": (_frame_join, "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000"),
    "frame_salted_join": (_frame_salted, "SELECT event_id, c_name FROM events JOIN customer ON user_id = c_custkey"),
    "frame_count_distinct": (_frame_distinct_by, "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag"),
    "top_k": (_frame_top, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 20 OFFSET 5"),
    "frame_scalar": (_frame_scalar, "SELECT o_orderkey, most FROM orders, (SELECT max(o_totalprice) AS most FROM orders) WHERE o_totalprice * 2 > most"),
    "frame_functions": (_frame_functions, "SELECT CAST(l_orderkey // l_linenumber AS BIGINT) AS d, CAST(CAST(l_shipdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS m FROM lineitem"),
    "frame_aggregate": (_frame_aggregate, "SELECT event_type, count(event_id) AS n, min(value) AS low, max(value) AS high FROM events GROUP BY event_type"),
    "frame_distinct": (_frame_distinct, "SELECT DISTINCT p_type FROM part"),
}

QUERIES: dict[str, Query] = {name: dialect(text) for name, (text, _) in STATEMENTS.items()} | {name: q for name, (q, _) in (CSV | FRAMES).items()}
ORACLE_SQL: dict[str, str] = {name: other for name, (_, other) in STATEMENTS.items() if other} | {name: other for name, (_, other) in (CSV | FRAMES).items()}
