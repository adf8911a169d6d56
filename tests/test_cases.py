"""The dialect by example: scripts on fresh databases, and the rows of their last statement (None: it must fail)."""

from __future__ import annotations

import datetime

import pytest
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from quillon.errors import EngineError
from quillon.plans.inspect import plan_texts, pushed_filters, read_columns
from quillon.session import Engine

FAILS = None
PEOPLE = """
CREATE TABLE people(id BIGINT, name VARCHAR, town VARCHAR, pay BIGINT, team BIGINT);
INSERT INTO people VALUES (1, 'Ada', 'Ulm', 12000, 1), (2, 'Ben', 'Bonn', 10000, 2), (3, 'Cleo', 'Bonn', 11500, 4), (4, 'Dan', '', NULL, NULL);
CREATE TABLE teams(id BIGINT, team_name VARCHAR);
INSERT INTO teams VALUES (1, 'red'), (2, 'green'), (3, 'blue'), (4, 'grey');
CREATE TABLE n(a BIGINT, b BIGINT, c BIGINT);
INSERT INTO n VALUES (0, 4, 7), (1, 5, 8), (2, 7, 9), (2, 8, 1);
"""
FLAGS = "CREATE TABLE f(i INT); INSERT INTO f VALUES (3), (4);"

#: name: script after PEOPLE, rows in any order
CASES: dict[str, tuple[str, list | None]] = {
    # logic
    "and_true": ("SELECT true AND true AND true AS x", [(True,)]),
    "and_false": ("SELECT true AND false AS x", [(False,)]),
    "false_and_null": ("SELECT false AND NULL AS x", [(False,)]),
    "null_and_true": ("SELECT NULL AND true AS x", [(None,)]),
    "and_binds_closer": ("SELECT true AND false OR false AS x", [(False,)]),
    "or_null": ("SELECT false OR NULL AS x", [(None,)]),
    "true_or_null": ("SELECT NULL OR true AS x", [(True,)]),
    "constant_and_column": (f"{FLAGS} SELECT true AND i > 3 AS x FROM f", [(False,), (True,)]),
    "column_and_constant": (f"{FLAGS} SELECT i > 3 AND false AS x FROM f", [(False,), (False,)]),
    "false_or_column": (f"{FLAGS} SELECT false OR i > 3 AS x FROM f", [(False,), (True,)]),
    "column_or_true": (f"{FLAGS} SELECT i > 3 OR true AS x FROM f", [(True,), (True,)]),
    "null_or_column": (f"{FLAGS} SELECT NULL OR i > 3 AS x FROM f", [(None,), (True,)]),
    "column_and_null": (f"{FLAGS} SELECT i > 3 AND NULL AS x FROM f", [(False,), (None,)]),
    "constant_comparison": (f"{FLAGS} SELECT 2 > 3 AND i > 3 AS x FROM f", [(False,), (False,)]),
    # comparison and arithmetic
    "texts_compare_as_texts": ("SELECT '1000' > '20' AS x", [(False,)]),
    "numbers_of_two_types": ("SELECT 2.5 > 2 AS x, 3 >= 3.0 AS y", [(True, True)]),
    "number_and_text_dont_compare": ("SELECT 1 > '0' AS x", FAILS),
    "not_equal": ("SELECT a FROM n WHERE a != 2", [(0,), (1,)]),
    "less_greater_equal": ("SELECT a FROM n WHERE a <= 1 AND b >= 5", [(1,)]),
    "precedence": ("SELECT 1 + 2 * 3 AS x, (1 + 2) * 3 AS y, -a AS z FROM n WHERE a = 1", [(7, 9, -1)]),
    "integer_division": ("SELECT 7 / 2 AS x, -7 / 2 AS y, 7 % 3 AS z", [(3, -3, 1)]),
    "null_arithmetic": ("SELECT pay + 1 AS x FROM people WHERE id = 4", [(None,)]),
    "mixed_arithmetic": ("SELECT a + CAST(0.5 AS DOUBLE) AS x FROM n WHERE a = 1", [(1.5,)]),
    # projection, aliases, filters
    "columns_in_any_order": ("SELECT c, a FROM n WHERE b = 4", [(7, 0)]),
    "star_of_a_table": ("SELECT t.* FROM teams t WHERE t.id = 3", [(3, "blue")]),
    "alias_in_where": ("SELECT a + b AS s FROM n WHERE s > 9", [(10,)]),
    "alias_of_alias_in_group": ("SELECT a AS g, max(b) AS m FROM n GROUP BY g", [(0, 4), (1, 5), (2, 8)]),
    "filter_on_text": ("SELECT name FROM people WHERE town = 'Bonn'", [("Ben",), ("Cleo",)]),
    "filter_on_empty_text": ("SELECT name FROM people WHERE town = ''", [("Dan",)]),
    "filter_on_null": ("SELECT name FROM people WHERE pay = NULL", []),
    "filter_on_another_column": ("SELECT name FROM people WHERE id + 1 = team", [("Cleo",)]),
    "unknown_column": ("SELECT nowhere FROM people", FAILS),
    "unknown_column_of_a_table": ("SELECT p.nowhere FROM people p", FAILS),
    "unknown_table": ("SELECT 1 AS x FROM nowhere", FAILS),
    "ambiguous_column": ("SELECT id FROM people JOIN teams ON people.team = teams.id", FAILS),
    "told_apart_column": ("SELECT teams.id FROM people JOIN teams ON people.team = teams.id WHERE people.id = 3", [(4,)]),
    "ambiguous_in_where": ("SELECT name FROM people JOIN teams ON people.team = teams.id WHERE id > 1", FAILS),
    # joins
    "inner_join": ("SELECT name, team_name FROM people JOIN teams ON people.team = teams.id", [("Ada", "red"), ("Ben", "green"), ("Cleo", "grey")]),
    "left_join": ("SELECT name, team_name FROM people LEFT JOIN teams ON people.team = teams.id", [("Ada", "red"), ("Ben", "green"), ("Cleo", "grey"), ("Dan", None)]),
    "right_join": ("SELECT name, team_name FROM people RIGHT JOIN teams ON people.team = teams.id", [("Ada", "red"), ("Ben", "green"), (None, "blue"), ("Cleo", "grey")]),
    "full_join": ("SELECT name, team_name FROM people FULL JOIN teams ON people.team = teams.id", [("Ada", "red"), ("Ben", "green"), ("Cleo", "grey"), ("Dan", None), (None, "blue")]),
    "cross_join": ("SELECT n.a, t.id FROM n CROSS JOIN teams t WHERE n.a = 0", [(0, 1), (0, 2), (0, 3), (0, 4)]),
    "comma_join": ("SELECT name, team_name FROM people, teams WHERE people.team = teams.id AND pay > 11000", [("Ada", "red"), ("Cleo", "grey")]),
    "residual_in_left_join": ("SELECT name, team_name FROM people LEFT JOIN teams ON people.team = teams.id AND team_name != 'red'", [("Ada", None), ("Ben", "green"), ("Cleo", "grey"), ("Dan", None)]),
    "residual_in_right_join": ("SELECT name, team_name FROM people RIGHT JOIN teams ON people.team = teams.id AND pay > 11000", [("Ada", "red"), (None, "green"), (None, "blue"), ("Cleo", "grey")]),
    "residual_in_full_join": ("SELECT name, team_name FROM people FULL JOIN teams ON people.team = teams.id AND pay > 11500", [("Ada", "red"), ("Ben", None), ("Cleo", None), ("Dan", None), (None, "green"), (None, "blue"), (None, "grey")]),
    "join_on_two_columns": ("SELECT x.a FROM n x JOIN n y ON x.a = y.a AND x.b = y.b WHERE x.a = 2", [(2,), (2,)]),
    "join_of_three": ("SELECT name FROM people JOIN teams ON people.team = teams.id JOIN n ON n.a = people.id WHERE n.c = 8", [("Ada",)]),
    "self_join": ("SELECT x.name, y.name AS other FROM people x JOIN people y ON x.town = y.town WHERE x.id < y.id", [("Ben", "Cleo")]),
    "filter_after_outer_join": ("SELECT team_name FROM people RIGHT JOIN teams ON people.team = teams.id WHERE teams.id = 3", [("blue",)]),
    # aggregates
    "aggregates_skip_null": ("SELECT count(pay) AS n, sum(pay) AS s, min(pay) AS a, max(pay) AS b FROM people", [(3, 33500, 10000, 12000)]),
    "count_of_constants": ("SELECT count(1) AS n FROM people", [(4,)]),
    "aggregate_of_texts": ("SELECT min(name) AS a, max(town) AS b FROM people", [("Ada", "Ulm")]),
    "group_with_null_and_empty": ("SELECT town, count(id) AS n, sum(pay) AS s FROM people GROUP BY town", [("Ulm", 1, 12000), ("Bonn", 2, 21500), ("", 1, None)]),
    "group_by_expression": ("SELECT a * 10 AS g, sum(b) AS s FROM n GROUP BY a * 10", [(0, 4), (10, 5), (20, 15)]),
    "sum_distinct": ("SELECT sum(DISTINCT a) AS s, count(DISTINCT a) AS n FROM n", [(3, 3)]),
    "expression_over_aggregates": ("SELECT sum(b) + max(c) * 2 AS x FROM n", [(42,)]),
    "select_distinct": ("SELECT DISTINCT a FROM n", [(0,), (1,), (2,)]),
    "aggregates_of_nothing": ("SELECT count(a) AS n, sum(a) AS s FROM n WHERE a > 100", [(0, None)]),
    "groups_of_nothing": ("SELECT a, count(b) AS n FROM n WHERE a > 100 GROUP BY a", []),
    "column_outside_group": ("SELECT a, b FROM n GROUP BY a", FAILS),
    "aggregate_in_where": ("SELECT a FROM n WHERE sum(a) > 1", FAILS),
    # subqueries
    "derived": ("SELECT * FROM (SELECT * FROM n WHERE c < 2) t", [(2, 8, 1)]),
    "derived_twice": ("SELECT * FROM (SELECT * FROM (SELECT * FROM n WHERE c < 2) t WHERE t.a > 1) u WHERE u.b > 7", [(2, 8, 1)]),
    "derived_column": ("SELECT t.b FROM (SELECT a, b FROM n WHERE a > 1) t WHERE t.b > 7", [(8,)]),
    "derived_column_left_out": ("SELECT t.c FROM (SELECT a, b FROM n) t", FAILS),
    "scalar_in_select": ("SELECT a, (SELECT max(b) FROM n) + 2 AS m FROM n WHERE a < 2", [(0, 10), (1, 10)]),
    "scalar_in_where": ("SELECT name FROM people WHERE pay = (SELECT max(pay) FROM people)", [("Ada",)]),
    "scalar_without_rows": ("SELECT (SELECT a FROM n WHERE a > 100) AS x", [(None,)]),
    "scalar_with_two_rows": ("SELECT (SELECT a FROM n) AS x", FAILS),
    "join_with_derived": ("SELECT n.a, t.m FROM n CROSS JOIN (SELECT max(b) AS m FROM n) t WHERE n.a = 1", [(1, 8)]),
    # tables
    "insert_by_name": ("CREATE TABLE t(x VARCHAR, y VARCHAR, z VARCHAR); INSERT INTO t(z, y) VALUES ('0', '4'), ('1', '5'); INSERT INTO t VALUES ('2', '7', '9'); SELECT x, z, y FROM t", [(None, "0", "4"), (None, "1", "5"), ("2", "9", "7")]),
    "insert_casts": ("CREATE TABLE t(x INT, y DOUBLE, z VARCHAR); INSERT INTO t VALUES ('12', 3, 4); SELECT x, y, z FROM t", [(12, 3.0, "4")]),
    "insert_too_many": ("CREATE TABLE t(x INT, y INT); INSERT INTO t(y) VALUES (1, 2)", FAILS),
    "insert_out_of_range": ("CREATE TABLE t(x TINYINT UNSIGNED); INSERT INTO t VALUES (256)", FAILS),
    "insert_negative_unsigned": ("CREATE TABLE t(x INT UNSIGNED); INSERT INTO t VALUES (-1)", FAILS),
    "insert_null_and_empty": ("CREATE TABLE t(x VARCHAR, y SMALLINT UNSIGNED, z BIGINT UNSIGNED); INSERT INTO t VALUES (NULL, 1, 2), ('', 3, NULL); SELECT x, y, z FROM t", [(None, 1, 2), ("", 3, None)]),
    "insert_selected": ("CREATE TABLE t(i INTEGER); INSERT INTO t SELECT 42; INSERT INTO t SELECT NULL; SELECT * FROM t", [(42,), (None,)]),
    "insert_into_nothing": ("INSERT INTO nowhere VALUES (1)", FAILS),
    "create_as_with_types": ("CREATE TABLE t AS SELECT a + 1 AS x, name FROM n JOIN people ON a = id; SELECT * FROM t WHERE x = 2", [(2, "Ada")]),
    "create_twice": ("CREATE TABLE t(x INT); CREATE TABLE t(x INT)", FAILS),
    "create_if_missing": ("CREATE TABLE t(x INT); INSERT INTO t VALUES (5); CREATE TABLE IF NOT EXISTS t(y INT); SELECT x FROM t", [(5,)]),
    # dates
    "dates_from_texts": ("CREATE TABLE d(v DATE); INSERT INTO d VALUES ('2021-01-02'), ('2021-01-03'); SELECT v FROM d WHERE v > DATE '2021-01-02'", [(datetime.date(2021, 1, 3),)]),
    "month_end": ("SELECT DATE '2024-01-31' + INTERVAL '1' MONTH AS x, DATE '2024-02-29' + INTERVAL '1' YEAR AS y", [(datetime.date(2024, 2, 29), datetime.date(2025, 2, 28))]),
    "hours_reach_the_next_day": ("SELECT DATE '1998-12-01' + INTERVAL '24' HOUR AS x, DATE '1998-12-01' - INTERVAL '1' HOUR AS y", [(datetime.date(1998, 12, 2), datetime.date(1998, 11, 30))]),
    "minutes_and_seconds": ("SELECT DATE '1998-12-01' + INTERVAL '1440' MINUTE AS x, DATE '1998-12-01' + INTERVAL '86399' SECOND AS y, DATE '1998-12-01' + INTERVAL '86400' SECOND AS z", [(datetime.date(1998, 12, 2), datetime.date(1998, 12, 1), datetime.date(1998, 12, 2))]),
    "weeks_and_years_back": ("SELECT DATE '2020-03-01' - INTERVAL '1' WEEK AS x, DATE '2020-03-01' - INTERVAL '1' YEAR AS y", [(datetime.date(2020, 2, 23), datetime.date(2019, 3, 1))]),
}

#: Rows in the order that the statement gives.
ORDERED: dict[str, tuple[str, list]] = {
    "nulls_first_descending": ("SELECT pay FROM people ORDER BY pay DESC", [None, 12000, 11500, 10000]),
    "nulls_first_ascending": ("SELECT pay FROM people ORDER BY pay", [None, 10000, 11500, 12000]),
    "by_two_columns": ("SELECT b FROM n ORDER BY a DESC, b", [7, 8, 5, 4]),
    "by_alias": ("SELECT a + b AS s FROM n ORDER BY s DESC", [10, 9, 6, 4]),
    "by_what_is_not_selected": ("SELECT name FROM people ORDER BY id DESC", ["Dan", "Cleo", "Ben", "Ada"]),
    "limit": ("SELECT b FROM n ORDER BY b LIMIT 2", [4, 5]),
    "limit_and_offset": ("SELECT b FROM n ORDER BY b LIMIT 2 OFFSET 1", [5, 7]),
    "offset_alone": ("SELECT b FROM n ORDER BY b OFFSET 3", [8]),
    "limit_beyond_the_end": ("SELECT b FROM n ORDER BY b LIMIT 10 OFFSET 4", []),
    "limit_of_derived": ("SELECT t.b FROM (SELECT b FROM n ORDER BY b LIMIT 3) t ORDER BY t.b DESC LIMIT 1", [7]),
}


@pytest.fixture(scope="module")
def people(spark):
    engine = Engine(spark)
    engine.run(PEOPLE)
    return engine


def engine_for(spark, people, script):
    """Scripts that make tables of their own have a database of their own; the others share one."""
    if "CREATE" not in script and "INSERT" not in script:
        return people
    engine = Engine(spark)
    for name in ("people", "teams", "n"):
        engine.register(name, people.sql(f"SELECT * FROM {name}"))
    return engine


@pytest.mark.parametrize("name", CASES)
def test_case(spark, people, name):
    script, want = CASES[name]
    engine = engine_for(spark, people, script)
    if want is FAILS:
        with pytest.raises((EngineError, PySparkException, Py4JError)):
            engine.run(script)[-1].collect()
        return
    assert sorted(map(tuple, engine.run(script)[-1].collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", ORDERED)
def test_ordered_case(people, name):
    script, want = ORDERED[name]
    assert [r[0] for r in people.sql(script).collect()] == want


def test_copied_files_are_read_back(spark, people, tmp_path):
    """COPY TO with and without header and under another delimiter; then by COPY FROM, read_csv and as a registered table."""
    engine = engine_for(spark, people, "CREATE")
    want = sorted(map(tuple, people.sql("SELECT id, name, town FROM people").collect()))
    engine.run(f"COPY people(id, name, town) TO '{tmp_path}/a' (DELIMITER '|', HEADER false); CREATE TABLE again(id BIGINT, name VARCHAR, town VARCHAR); COPY again FROM '{tmp_path}/a' (DELIMITER '|', HEADER false)")
    assert sorted(map(tuple, engine.sql("SELECT id, name, town FROM again").collect())) == want
    engine.run(f"COPY (SELECT id, name FROM people WHERE id > 2) TO '{tmp_path}/b'")
    assert sorted(map(tuple, engine.sql(f"SELECT * FROM read_csv('{tmp_path}/b')").collect())) == [(3, "Cleo"), (4, "Dan")]
    engine.load_csv("third", f"{tmp_path}/b")
    assert [r[0] for r in engine.sql("SELECT count(id) AS n FROM third").collect()] == [2]


def test_frames_of_any_session_are_tables(spark, people):
    engine = Engine(spark)
    engine.register("mine", spark.createDataFrame([(1, "x"), (2, None)], "a int, b string"))
    engine.register("theirs", people.sql("SELECT id, name FROM people"))
    assert sorted(map(tuple, engine.sql("SELECT b, name FROM mine JOIN theirs ON a = id").collect()), key=repr) == [("x", "Ada"), (None, "Ben")]


# -- plans: what Catalyst makes of the dialect's statements -----------------------------------------------------------


@pytest.fixture(scope="module")
def tables(spark):
    engine = Engine(spark)
    engine.load_parquet_dir("/root/testdata/sf0.001", ["customer", "orders", "lineitem", "nation"])
    return engine


@pytest.mark.parametrize(
    ("query", "filters", "columns"),
    [
        # predicates reach the scan through projections, derived tables and inner joins
        ("SELECT c_name FROM customer WHERE c_acctbal > 100 AND c_nationkey = 3", ["GreaterThan(c_acctbal,100.0)", "EqualTo(c_nationkey,3)"], [{"c_name", "c_nationkey", "c_acctbal"}]),
        ("SELECT t.n FROM (SELECT c_name AS n, c_nationkey AS k FROM customer) t WHERE t.k > 3", ["GreaterThan(c_nationkey,3)"], [{"c_name", "c_nationkey"}]),
        ("SELECT c_name FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 5", ["GreaterThan(o_totalprice,5.0)", "IsNotNull(c_custkey)"], [{"c_custkey", "c_name"}, {"o_custkey", "o_totalprice"}]),
        ("SELECT c_name FROM customer, orders WHERE c_custkey = o_custkey AND c_nationkey = 1", ["EqualTo(c_nationkey,1)", "IsNotNull(o_custkey)"], [{"c_custkey", "c_name", "c_nationkey"}, {"o_custkey"}]),
        # of a left join, a filter on the left side and the residual condition on the right one
        ("SELECT c_name FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 5 WHERE c_nationkey = 2", ["EqualTo(c_nationkey,2)", "GreaterThan(o_totalprice,5.0)"], [{"c_custkey", "c_name", "c_nationkey"}, {"o_custkey", "o_totalprice"}]),
        # columns that nothing needs aren't read
        ("SELECT a.x FROM (SELECT o_orderkey AS x, o_totalprice + 1 AS y FROM orders) a", [], [{"o_orderkey"}]),
        ("SELECT o_orderstatus, count(o_orderkey) AS n FROM orders GROUP BY o_orderstatus", [], [{"o_orderkey", "o_orderstatus"}]),
        ("SELECT o_orderkey FROM orders ORDER BY o_totalprice", [], [{"o_orderkey", "o_totalprice"}]),
    ],
)
def test_filters_and_columns_reach_the_scans(tables, query, filters, columns):
    plan = tables.sql(query)
    pushed = " ".join(pushed_filters(plan))
    assert all(f in pushed for f in filters)
    assert sorted(map(sorted, read_columns(plan))) == sorted(map(sorted, columns))


def test_operators_are_combined(tables):
    """Nested projections, filters and limits are one each."""
    plan = plan_texts(tables.sql("SELECT t.y + 1 AS z FROM (SELECT o_orderkey + 1 AS y, o_totalprice AS p FROM orders WHERE o_totalprice > 1) t WHERE t.p < 1000000"))[1]
    assert plan.count("Filter ") == 1 and plan.count("Project ") == 1
    limited = plan_texts(tables.sql("SELECT t.k FROM (SELECT o_orderkey AS k FROM orders LIMIT 100) t LIMIT 5"))[1]
    assert limited.count("GlobalLimit") == 1 and "GlobalLimit 5" in limited


def test_limits_go_below_projections_and_into_outer_joins(tables):
    assert "CollectLimit 7" in plan_texts(tables.sql("SELECT o_orderkey + 1 AS k FROM orders LIMIT 7"))[2]
    joined = plan_texts(tables.sql("SELECT c_name FROM customer LEFT JOIN orders ON c_custkey = o_custkey LIMIT 4"))[1]
    assert joined.index("LocalLimit 4") < joined.index("Join LeftOuter") < joined.rindex("LocalLimit 4")
    assert "TakeOrderedAndProject(limit=3" in plan_texts(tables.sql("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC LIMIT 3"))[2]


def test_constants_are_folded_and_small_sides_broadcast(tables):
    assert "> 7)" in plan_texts(tables.sql("SELECT o_orderkey FROM orders WHERE o_orderkey > 3 + 4"))[1]
    assert "BroadcastHashJoin" in plan_texts(tables.sql("SELECT n_name FROM customer JOIN nation ON c_nationkey = n_nationkey"))[2]
