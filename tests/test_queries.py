"""Every registered query against its SQL, and the comparison itself."""

import pytest

import __spark_entry__ as entry
from retenta.plans import catalog, oracle
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), oracle.oracle_sql()
WITHOUT_SQL = {
    "train_churn", "predict_churn", "feature_importance",
    "feature_attribution", "batch_predictions", "train_models", "churn_metrics",
}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_only_fitted_models_lack_sql():
    assert set(QUERIES) - set(SQL) == WITHOUT_SQL and not set(SQL) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, SQL[name]) == []


def test_comparison_sees_differences(spark, con):
    rfm = QUERIES["rfm_features"](spark, SF)
    assert differences(rfm, con, SQL["churn_label_window"])
    assert differences(rfm.withColumn("frequency", rfm.frequency + 1), con, SQL["rfm_features"])
    assert differences(rfm.withColumn("frequency", rfm.frequency.cast("int")), con, SQL["rfm_features"])
    assert differences(rfm.limit(3), con, SQL["rfm_features"])


def test_entry(spark):
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() > 0
