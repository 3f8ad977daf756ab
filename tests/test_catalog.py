import pytest

from ledgerframe.plans import catalog
from tests.compare import same

EMPTY = {"read_stream_past_tip"}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, data, name):
    rows = same(catalog.QUERIES[name](spark, data), catalog.ORACLE_SQL[name], data)
    assert (rows == 0) == (name in EMPTY)


def test_every_query_has_sql():
    assert catalog.QUERIES.keys() == catalog.ORACLE_SQL.keys()


def test_position_filter_reaches_the_scan(spark, data):
    from pyspark.sql import functions as F

    plan = spark.read.parquet(f"{data}/events.parquet").where(F.col("event_id") > 500)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(event_id,500)" in plan
    plan = catalog.QUERIES["read_stream_after_count"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,7)" in plan and "TakeOrderedAndProject" in plan


def test_folds_share_the_shuffle_that_numbers_versions(spark, data):
    plan = catalog.QUERIES["fold_balance"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
