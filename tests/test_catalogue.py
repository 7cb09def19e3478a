"""The registered queries: complete, well-formed, and equal to their SQL on a small folder."""

import pathlib

import duckdb
import pytest

import __spark_entry__ as driver
import catalogue
import oracles
from scripts.check_oracles import TABLES, rows_of, same_kind

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(DATA).exists(), reason="no star tables")

# Model fits have no SQL form; their figures are tested on fixtures instead.
WITHOUT_SQL = {
    "churn_model_scores",
    "churn_model_importances",
    "churn_feature_effects",
    "churn_cross_validation",
    "clv_model_scores",
    "clv_model_report",
    "churn_model_quality",
    "clv_feature_effects",
}
# One query per plan module; scripts/check_oracles.py compares all of them.
CHECKED = [
    "kpi_overview",
    "fct_orders",
    "dim_customers",
    "stg_order_items",
    "quality_report",
    "retention_pct",
    "recommendations",
    "insight_documents",
    "question_matches",
    "numeric_summary",
    "stratified_split",
    "landed_quality_report",
    "registered_stg_orders",
    "segments_by_sql",
    "cohort_matrix",
    "similar_customers_pruned",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def test_every_query_has_sql_but_the_model_fits():
    assert set(catalogue.QUERIES) - set(oracles.QUERIES) == WITHOUT_SQL
    assert set(oracles.QUERIES) <= set(catalogue.QUERIES)
    assert set(catalogue.QUERIES) <= set(driver.queries())
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_orders_are_counted_without_a_distinct(spark):
    plan = driver.queries()["kpi_overview"](spark, DATA)._jdf.queryExecution().toString()
    assert "Expand" not in plan
    for name in ("revenue_by_month", "revenue_by_state"):
        plan = driver.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        assert "distinct" not in plan


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, duck, name):
    df = driver.queries()[name](spark, DATA)
    cursor = duck.execute(driver.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    assert sorted(columns) == sorted(df.columns)
    assert all(same_kind(f.dataType.simpleString(), kinds[f.name]) for f in df.schema)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())


def test_entry_returns_the_headline_figures(spark):
    df = driver.entry(spark)
    assert df.columns == [
        "total_orders", "total_customers", "total_revenue", "avg_order_value",
        "avg_review_score", "on_time_pct",
    ]
    assert df.count() == 1
