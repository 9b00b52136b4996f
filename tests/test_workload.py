"""Every registered query against its SQL, and the shape of the plans that matter at scale."""

import re

import pytest

from workload.compare import difference, duck
from workload.oracle import ORACLE
from workload.queries import QUERIES

SF = "/root/testdata/sf0.001"
# too few rows at the smallest scale factor for the filter to hit any
MAY_BE_EMPTY = {"list_transactions_of_month"}
WRITES = {"written_marts", "streamed_statement_import"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    problem = difference(spark, con, name, SF)
    assert problem is None or (problem == "both results are empty" and name in MAY_BE_EMPTY)


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().treeString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITES))
def test_no_query_compares_all_pairs_or_leaves_the_jvm(spark, name):
    text = plan(spark, name)
    assert not re.search(r"CartesianProduct|NestedLoop|PythonUDF|InPandas|ArrowEval", text)


def test_period_mart_exchanges_aggregated_rows_only(spark):
    """The ledger is combined per task before the first exchange, and everything after the
    second one stays on the ledger's partition."""
    text = plan(spark, "fct_pay_period_summary")
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
    assert len(exchanges) == 4
    for part in text.split("Exchange hashpartitioning")[1:]:
        assert re.search(r"^[^\n]*\n[^\n]*(Aggregate|Union)", part)


def test_month_filter_reaches_the_scan(spark, tmp_path):
    from coffer import plans
    from workload import mapping as m

    m.ledger(spark, SF).write.parquet(str(tmp_path / "ledger"))
    ledger = spark.read.parquet(str(tmp_path / "ledger"))
    view = plans.v_monthly_summary(ledger, m.categories(spark), m.types(spark), "1997-03")
    text = view._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(transaction_date,1997-03-01\)", text)
    assert re.search(r"ReadSchema: struct<account_id:int,transaction_date:date,category_id:string,amount:decimal\(12,2\)>", text)
