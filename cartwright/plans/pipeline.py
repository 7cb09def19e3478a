"""From raw CSV to queryable tables: clean, stage, enrich, build marts, publish."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cartwright.operators import quality
from cartwright.plans import enriched, marts, staging
from cartwright.sources import tables

# Staged tables that later meet on the order key.
_BY_ORDER = ("stg_orders", "stg_order_items", "stg_order_payments", "stg_order_reviews")


def build(
    spark: SparkSession,
    raw_base: str,
    database: str,
    as_of: str | None = None,
    buckets: int | None = None,
) -> dict[str, DataFrame]:
    """Build everything under ``database``; returns the stored marts and lazy views by name.

    Cleaned and typed rows are stored once as Parquet, because every later step reads them.
    With ``buckets`` the order tables are bucketed by order, and joins on the order need no
    shuffle. Intermediate frames stay views; the marts are tables.
    """
    raw = tables.read_all_raw(spark, raw_base)
    staged = {}
    for name, df in staging.all_staged(quality.clean_all(raw)).items():
        key = "order_id" if name in _BY_ORDER else None
        staged[name] = tables.save_mart(df, name, database, buckets if key else None, key)
    items, reviews = staged["stg_order_items"], staged["stg_order_reviews"]
    orders, customers = staged["stg_orders"], staged["stg_customers"]
    payments = staged["stg_order_payments"]
    paid = enriched.orders_with_payments(orders, payments)
    facts = tables.save_mart(
        marts.order_facts(paid, items, reviews, customers), "order_facts", database
    )
    views = {
        "int_orders_enriched": enriched.orders_enriched(orders, customers, payments),
        "int_order_items_enriched": enriched.order_items_enriched(
            items, staged["stg_products"], staged["stg_sellers"]
        ),
        "int_customer_orders": enriched.customer_rollup(facts, as_of),
    }
    tables.publish_views(views)
    dim = tables.save_mart(
        marts.dim_customers(views["int_customer_orders"]), "dim_customers", database
    )
    stored = {
        "order_facts": facts,
        "fct_orders": tables.save_mart(
            marts.fct_orders(paid, items, reviews, customers), "fct_orders", database
        ),
        "dim_customers": dim,
        "mart_customer_metrics": tables.save_mart(
            marts.customer_metrics(dim), "mart_customer_metrics", database
        ),
    }
    return {**staged, **views, **stored}
