"""Order fact, customer dimension and the customer feature table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwright.functions.arithmetic import ratio, rounded
from cartwright.functions.dates import iso_weekday
from cartwright.operators.selection import with_ntiles
from cartwright.plans.enriched import item_totals, with_children, with_customers
from cartwright.session import materialize

CUSTOMER_GRAIN = ("customer_unique_id", "customer_city", "customer_state")
_REPEAT_CHUNK = 10_000


def order_facts(
    paid: DataFrame, items: DataFrame, reviews: DataFrame, customers: DataFrame | None = None
) -> DataFrame:
    """The order fact at order grain, with the weight ``fan_out`` (see ``with_children``).

    ``paid`` are orders with payments. Without ``customers`` the customer columns are left out:
    reports that do not need them spare a shuffle of all orders. Customer keys are declared
    unique, so that join neither adds nor drops rows.
    """
    facts = with_children(paid, items, reviews).withColumns(_date_parts())
    return facts if customers is None else with_customers(facts, customers)


def _date_parts() -> dict[str, Column]:
    bought = F.col("purchased_at")
    return {
        "purchase_year": F.year(bought),
        "purchase_month": F.month(bought),
        "purchase_dow": iso_weekday(bought),
    }


def fct_orders(
    paid: DataFrame, items: DataFrame, reviews: DataFrame, customers: DataFrame
) -> DataFrame:
    """The order fact as published: one row per order and review.

    Reviews meet the order grouped by score, so an order with very many reviews stays a handful
    of join rows; the repetition is restored afterwards, a bounded chunk at a time.
    """
    scores = reviews.groupBy(
        "order_id",
        F.col("score").alias("review_score"),
        F.col("is_positive").alias("is_positive_review"),
    ).agg(F.count("*").alias("copies"))
    copies = F.coalesce(F.col("copies"), F.lit(1).cast("bigint"))
    chunk = F.lit(_REPEAT_CHUNK)
    scored = paid.join(item_totals(items), "order_id", "left").join(scores, "order_id", "left")
    return (
        with_customers(scored, customers)
        .withColumns(_date_parts())
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((copies - 1) / chunk))))
        .withColumn(
            "copy",
            F.explode(F.sequence(F.lit(1), F.least(chunk, copies - F.col("chunk") * chunk))),
        )
        .select(
            "order_id",
            "customer_id",
            "customer_unique_id",
            "status",
            "primary_payment_type",
            "max_installments",
            "item_count",
            "order_value",
            "total_payment",
            "purchased_at",
            "approved_at",
            "shipped_at",
            "delivered_at",
            "estimated_delivery_at",
            "purchase_year",
            "purchase_month",
            "purchase_dow",
            "delivery_days",
            "delivery_delay_days",
            "delivered_on_time",
            "customer_city",
            "customer_state",
            "review_score",
            "is_positive_review",
        )
    )


def segment(recency: Column, frequency: Column) -> Column:
    """First matching rule wins; the last one is reached by recency 3 with low frequency."""
    return (
        F.when((recency >= 4) & (frequency >= 4), "Champion")
        .when((recency >= 3) & (frequency >= 3), "Loyal")
        .when((recency >= 4) & (frequency <= 2), "New Customer")
        .when((recency <= 2) & (frequency >= 3), "At Risk")
        .when((recency <= 2) & (frequency <= 2), "Lost")
        .otherwise("Potential")
    )


def dim_customers(rollup: DataFrame) -> DataFrame:
    """Customer profile with recency, frequency and monetary quintiles (5 = best) and segment.

    The rollup is stored once; the quintile boundaries are selected on its narrow columns and
    the scores are a projection of it.
    """
    stored = materialize(rollup, "customer_rollup")
    scored = with_ntiles(
        stored,
        5,
        {
            "recency_score": (F.col("recency_days"), True),
            "frequency_score": (F.col("total_orders"), False),
            "monetary_score": (F.col("total_revenue"), False),
        },
        CUSTOMER_GRAIN,
    )
    return scored.withColumn(
        "customer_segment", segment(F.col("recency_score"), F.col("frequency_score"))
    )


def customer_metrics(customers: DataFrame) -> DataFrame:
    """Feature table per customer. ``is_churned`` marks customers with a single order."""
    orders, reviews = F.col("total_orders"), F.col("total_reviews")
    recency = F.col("recency_days")
    return customers.select(
        "customer_unique_id",
        "recency_days",
        "recency_score",
        F.when(recency <= 90, 1).otherwise(0).alias("active_last_90d"),
        F.when(recency <= 180, 1).otherwise(0).alias("active_last_180d"),
        "total_orders",
        "frequency_score",
        "total_items",
        rounded(ratio(orders * 30, F.col("customer_age_days")), 4).alias("orders_per_month"),
        "total_revenue",
        "monetary_score",
        "avg_order_value",
        "max_order_value",
        "avg_review_score",
        "total_reviews",
        rounded(ratio(F.col("positive_reviews"), reviews), 4).alias("positive_review_rate"),
        "avg_delivery_days",
        rounded(ratio(F.col("on_time_deliveries"), orders), 4).alias("on_time_rate"),
        "customer_state",
        "customer_segment",
        F.when(orders == 1, 1).otherwise(0).alias("is_churned"),
    )
