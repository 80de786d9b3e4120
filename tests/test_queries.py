"""Registered queries against the same query in another engine, and what their plans may not contain."""

import re

import pytest

import __spark_entry__ as registry
from eventloom.checks.compare import connect, differences
from tests.conftest import SMALL, plan_of

SQL = registry.oracle_sql()
TRAINED = {"logistic_metrics", "train_forest", "select_best"}
#: Queries on corpora have tests of their own.
SQL_HERE = sorted(n for n in SQL if not re.match(r"op\d+_|pipeline$", n))
PLAIN = sorted(n for n in set(registry.queries()) - set(SQL) - TRAINED if not re.match(r"op\d+_|pipeline$", n))


@pytest.fixture(scope="module")
def database():
    connection = connect(SMALL)
    yield connection
    connection.close()


def test_every_oracle_belongs_to_a_query():
    assert set(SQL) <= set(registry.queries())


@pytest.mark.parametrize("name", SQL_HERE)
def test_same_as_sql(spark, database, name):
    frame = registry.queries()[name](spark, SMALL)
    assert differences(frame, database.execute(SQL[name])) is None


@pytest.mark.parametrize("name", PLAIN)
def test_gives_rows(spark, name):
    assert registry.queries()[name](spark, SMALL).count() > 0


@pytest.mark.parametrize("name", ["feature_table", "dq_log_reports", "dq_quantiles_exact", "classification_report", "label_adjacent"])
def test_no_python_and_no_pairing_of_everything(spark, name):
    plan = plan_of(registry.queries()[name](spark, SMALL))
    for node in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan


def test_every_log_is_read_once_for_the_feature_table(spark):
    physical = registry.queries()["feature_table"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert physical.count("FileScan parquet") == 5


def test_only_needed_columns_are_read(spark):
    physical = registry.queries()["dns_features"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in physical


def test_entry(spark):
    assert len(registry.entry(spark).columns) == 50
