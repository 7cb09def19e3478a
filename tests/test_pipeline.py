import pathlib

import pytest
from helpers import rows

from cartwright.plans import enriched, marts, pipeline, reports
from cartwright.sources import tables
from cartwright.sources.star import AS_OF, Star

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(DATA).exists(), reason="no star tables")


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("landing"))
    star = Star(spark, DATA)
    for name, df in star.raw_tables.items():
        tables.land_csv(df, base, name)
    return pipeline.build(spark, base, "shop", AS_OF, buckets=2)


def test_text_and_typed_binding_agree(spark, built):
    star = Star(spark, DATA)
    orders = built["stg_orders"]
    typed = star.orders.selectExpr(
        "cast(order_id as string) order_id", "cast(customer_id as string) customer_id",
        "status", "purchased_at", "approved_at", "shipped_at", "delivered_at",
        "estimated_delivery_at",
    )
    assert rows(orders) == rows(typed)
    products = star.products.withColumn("product_id", star.products["product_id"].cast("string"))
    assert rows(built["stg_products"]) == rows(products)


def test_marts_are_tables_open_to_sql(spark, built):
    by_sql = tables.run_sql(
        spark,
        """select count(distinct order_id) as total_orders,
                  round(sum(order_value), 2) as total_revenue, count(*) as n
           from shop.fct_orders where status = 'delivered'""",
    ).first()
    kpis = reports.kpi_overview(built["order_facts"]).first()
    assert by_sql["total_orders"] == kpis["total_orders"]
    assert float(by_sql["total_revenue"]) == kpis["total_revenue"]
    assert spark.table("int_customer_orders").count() == spark.table("shop.dim_customers").count()
    assert spark.table("shop.mart_customer_metrics").columns[-1] == "is_churned"


def test_bucketed_order_tables_meet_without_a_shuffle(spark, built):
    paid = enriched.orders_with_payments(built["stg_orders"], built["stg_order_payments"])
    facts = marts.order_facts(paid, built["stg_order_items"], built["stg_order_reviews"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = facts._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("SortMergeJoin") == 3 and "Exchange" not in plan


def test_unused_children_are_not_joined(spark, built):
    paid = enriched.orders_with_payments(built["stg_orders"], built["stg_order_payments"])
    facts = marts.order_facts(
        paid, built["stg_order_items"], built["stg_order_reviews"], built["stg_customers"]
    )
    plan = facts.select("order_id", "order_value")._jdf.queryExecution().optimizedPlan().toString()
    assert "payment_value" not in plan and "score" not in plan
