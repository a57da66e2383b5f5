import pytest

from corvane import catalog
from oracle import DATA, connection, same


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    same(catalog.QUERIES[name](spark, DATA), catalog.ORACLE_SQL[name], con)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_peaks_of_events_without_a_value(spark, tmp_path):
    import duckdb

    rows = "(1, 7, 2.0), (2, 7, NULL), (3, 7, 5.0), (6, 9, NULL), (7, 7, 1.0)"
    con = duckdb.connect()
    con.sql(f"CREATE TABLE events AS SELECT CAST(event_id AS BIGINT) AS event_id, TIMESTAMP '2024-01-01' AS ts, CAST(user_id AS BIGINT) AS user_id, 'click' AS event_type, CAST(value AS DOUBLE) AS value, '' AS props FROM (VALUES {rows}) t(event_id, user_id, value)")
    con.sql(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    same(catalog.QUERIES["journey_summary"](spark, str(tmp_path)), catalog.ORACLE_SQL["journey_summary"], con)


def test_costs_of_decisions_are_worked_out_once(spark):
    plan = catalog.QUERIES["cheapest_decisions"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    # One scan, one exchange: the least cost and the number of options come with the mode.
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning") == 1
