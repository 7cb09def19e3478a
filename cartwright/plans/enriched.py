"""Order-level and item-level joins, and the per-order and per-customer rollups.

Children of an order (payments, items, reviews) are aggregated before they meet it, so a single
order with a huge number of children is reduced map-side and never lands in one join task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwright.functions.arithmetic import mean, ratio, total
from cartwright.functions.dates import elapsed_days, reference_instant


def payment_totals(payments: DataFrame) -> DataFrame:
    """Per order; the primary type is that of the largest payment (ties: greater type name)."""
    largest = F.struct("payment_value", "payment_type")
    return payments.groupBy("order_id").agg(
        F.sum("payment_value").alias("total_payment"),
        F.max("installments").alias("max_installments"),
        F.count("payment_sequence").alias("payment_count"),
        F.max_by("payment_type", F.when(F.col("payment_value").isNotNull(), largest)).alias(
            "primary_payment_type"
        ),
    )


def item_totals(items: DataFrame) -> DataFrame:
    return items.groupBy("order_id").agg(
        F.count("*").alias("item_count"), F.sum("total_amount").alias("order_value")
    )


def review_totals(reviews: DataFrame) -> DataFrame:
    """Per order: how many reviews, and what their scores add up to."""
    return reviews.groupBy("order_id").agg(
        F.count("*").alias("review_count"),
        F.count("score").alias("scored_reviews"),
        F.sum("score").alias("score_sum"),
        F.count_if("is_positive").alias("positive_reviews"),
    )


def orders_with_payments(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Orders with payment and delivery facts, partitioned as the orders' key joins need it."""
    bought, delivered, due = (
        F.col("purchased_at"),
        F.col("delivered_at"),
        F.col("estimated_delivery_at"),
    )
    return orders.join(payment_totals(payments), "order_id", "left").withColumns(
        {
            "delivery_days": elapsed_days(bought, delivered),
            "delivery_delay_days": elapsed_days(due, delivered),
            "delivered_on_time": F.coalesce(delivered <= due, F.lit(False)),
        }
    )


def with_customers(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Add who bought and where. Done last: all joins on the order key then share one
    partitioning, and stored tables bucketed by order reach this point without any shuffle."""
    who = customers.select(
        "customer_id",
        F.col("unique_id").alias("customer_unique_id"),
        F.col("city").alias("customer_city"),
        F.col("state").alias("customer_state"),
    )
    return orders.join(who, "customer_id", "left")


def orders_enriched(orders: DataFrame, customers: DataFrame, payments: DataFrame) -> DataFrame:
    """Orders with customer, payment and delivery facts, one row per order."""
    return with_customers(orders_with_payments(orders, payments), customers).select(
        "order_id",
        "customer_id",
        "status",
        "purchased_at",
        "approved_at",
        "shipped_at",
        "delivered_at",
        "estimated_delivery_at",
        "customer_unique_id",
        "customer_city",
        "customer_state",
        "total_payment",
        "max_installments",
        "payment_count",
        "primary_payment_type",
        "delivery_days",
        "delivery_delay_days",
        "delivered_on_time",
    )


def items_with_category(items: DataFrame, products: DataFrame) -> DataFrame:
    """Items with their product's facts: all that reports by category need.

    Leaving the sellers out spares a shuffle of all items; seller keys are declared unique, so
    joining them neither adds nor drops rows.
    """
    what = products.select(
        "product_id",
        F.col("category").alias("product_category"),
        F.col("weight_g").alias("product_weight_g"),
        F.col("photos_qty").alias("product_photos_qty"),
    )
    return items.join(what, "product_id", "left")


def order_items_enriched(items: DataFrame, products: DataFrame, sellers: DataFrame) -> DataFrame:
    whose = sellers.select(
        "seller_id",
        F.col("city").alias("seller_city"),
        F.col("state").alias("seller_state"),
    )
    freight_share = F.try_divide(F.col("freight_value"), F.col("total_amount"))
    return (
        items_with_category(items, products)
        .join(whose, "seller_id", "left")
        .select(
            "order_id",
            "item_sequence",
            "product_id",
            "seller_id",
            "price",
            "freight_value",
            "total_amount",
            "shipping_limit_at",
            "product_category",
            "product_weight_g",
            "product_photos_qty",
            "seller_city",
            "seller_state",
            F.round(freight_share * 100, 2).alias("freight_pct"),
        )
    )


def with_children(orders: DataFrame, items: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row per order with item totals, review totals and its multiplicity ``fan_out``.

    The order fact repeats an order once per review. Carrying that number as a weight gives
    the same sums and averages without repeating any row.
    """
    return (
        orders.join(item_totals(items), "order_id", "left")
        .join(review_totals(reviews), "order_id", "left")
        .withColumn("fan_out", F.coalesce(F.col("review_count"), F.lit(1)).cast("int"))
    )


def customer_rollup(facts: DataFrame, as_of: str | None = None) -> DataFrame:
    """Delivered orders per (customer, city, state), each order counted ``fan_out`` times.

    ``facts`` are orders with their children; the status filter reaches the orders below the
    joins. Grouping combines map-side, so a customer with very many orders is no hot spot.
    """
    w = F.col("fan_out")
    value, bought = F.col("order_value"), F.col("purchased_at")
    first, last = F.min(bought), F.max(bought)
    return (
        facts.filter(F.col("status") == "delivered")
        .groupBy("customer_unique_id", "customer_city", "customer_state")
        .agg(
            F.sum(F.when(F.col("order_id").isNotNull(), w).otherwise(0)).alias("total_orders"),
            total(F.col("item_count"), w).alias("total_items"),
            total(value, w).alias("total_revenue"),
            mean(value, w).alias("avg_order_value"),
            F.min(value).alias("min_order_value"),
            F.max(value).alias("max_order_value"),
            first.alias("first_order_at"),
            last.alias("last_order_at"),
            elapsed_days(first, last).alias("customer_age_days"),
            elapsed_days(last, reference_instant(as_of)).alias("recency_days"),
            mean(F.col("delivery_days"), w).alias("avg_delivery_days"),
            F.sum(F.when(F.col("delivered_on_time"), w).otherwise(0)).alias("on_time_deliveries"),
            ratio(F.sum("score_sum"), F.sum("scored_reviews")).alias("avg_review_score"),
            F.coalesce(F.sum("positive_reviews"), F.lit(0)).alias("positive_reviews"),
            F.coalesce(F.sum("review_count"), F.lit(0)).alias("total_reviews"),
        )
    )
