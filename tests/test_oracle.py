"""Every query with an oracle SQL must equal DuckDB on sf0.001 and sf0.01."""

import pytest

import __spark_entry__ as E
from oracle_compare import compare

from conftest import SF001, SF01

E.queries()  # fills the registry
from lendscope.plans.oracle import SQL as SQLS  # noqa: E402
from lendscope.plans.registry import QUERIES  # noqa: E402


#: Fits of hundreds of trees or dozens of K-Means starts: run at the smaller size only.
HEAVY = {"train_random_forest", "train_gbt", "compare_models", "feature_importance", "batch_score_model", "score_one_applicant",
         "pipeline_roundtrip", "train_tables", "kmeans_k_sweep", "kmeans_segments", "explained_predictions"}


@pytest.mark.parametrize("key", sorted(SQLS))
def test_oracle_sf001(spark, duck001, key):
    ok, msg = compare(spark, duck001, key, SF001, QUERIES[key], SQLS[key])
    assert ok, msg


@pytest.mark.parametrize("key", sorted(set(SQLS) - HEAVY))
def test_oracle_sf01(spark, duck01, key):
    ok, msg = compare(spark, duck01, key, SF01, QUERIES[key], SQLS[key])
    assert ok, msg


def test_every_query_has_oracle_or_own_test():
    from test_fitted import RECOMPUTED

    assert set(QUERIES) - set(SQLS) == RECOMPUTED and set(SQLS) <= set(QUERIES)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert len(df.columns) > 0
