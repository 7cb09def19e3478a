"""Business reports over the marts.

``facts`` is the order-grain fact with its weight ``fan_out``: every sum, average and row count
counts an order that often, every distinct count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwright.functions.arithmetic import mean, money, ratio, rounded, total
from cartwright.functions.dates import period_label
from cartwright.functions.text import money_label

# The stages of the order funnel, in order.
FUNNEL = ("approved", "invoiced", "processing", "shipped", "delivered", "canceled")
DELIVERY_RANGE = (1, 60)

def _w() -> Column:
    return F.col("fan_out")



def _delivered(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("status") == "delivered")


def _avg(c: Column, digits: int = 2) -> Column:
    return rounded(F.avg(c.cast("double")), digits)


def kpi_overview(facts: DataFrame) -> DataFrame:
    value = F.col("order_value")
    on_time = F.sum(F.when(F.col("delivered_on_time"), _w()).otherwise(0))
    return _delivered(facts).agg(
        F.count("order_id").alias("total_orders"),  # facts have one row per order
        F.countDistinct("customer_unique_id").alias("total_customers"),
        money(total(value, _w())).alias("total_revenue"),
        rounded(mean(value, _w()), 2).alias("avg_order_value"),
        rounded(ratio(F.sum("score_sum"), F.sum("scored_reviews")), 2).alias("avg_review_score"),
        rounded(ratio(on_time * 100, F.sum(_w())), 2).alias("on_time_pct"),
    )


def orders_by_status(facts: DataFrame) -> DataFrame:
    return (
        facts.groupBy("status")
        .agg(F.sum(_w()).alias("order_count"))
        .orderBy(F.desc("order_count"), "status")
    )


def revenue_by_month(facts: DataFrame) -> DataFrame:
    """Per month: revenue, orders, and fact rows (the dashboard's order count)."""
    return (
        _delivered(facts)
        .groupBy("purchase_year", "purchase_month")
        .agg(
            money(total(F.col("order_value"), _w())).alias("revenue"),
            F.count("order_id").alias("orders"),
            F.sum(_w()).alias("fact_rows"),
        )
        .select(
            period_label(F.col("purchase_year"), F.col("purchase_month")).alias("period"),
            "revenue",
            "orders",
            "fact_rows",
        )
        .orderBy("period")
    )


def category_revenue(items: DataFrame) -> DataFrame:
    return items.groupBy("product_category").agg(
        F.countDistinct("order_id").alias("orders"),
        money(F.sum("total_amount")).alias("revenue"),
    )


def top_categories(items: DataFrame, k: int = 10) -> DataFrame:
    return (
        category_revenue(items)
        .orderBy(F.desc_nulls_last("revenue"), F.asc_nulls_last("product_category"))
        .limit(k)
    )


def state_revenue(facts: DataFrame) -> DataFrame:
    return (
        _delivered(facts)
        .groupBy("customer_state")
        .agg(
            F.count("order_id").alias("orders"),
            money(total(F.col("order_value"), _w())).alias("revenue"),
        )
        .orderBy(F.desc_nulls_last("revenue"), F.asc_nulls_last("customer_state"))
    )


def top_states(facts: DataFrame, by: str = "orders", k: int = 10) -> DataFrame:
    return (
        state_revenue(facts)
        .orderBy(F.desc_nulls_last(by), F.asc_nulls_last("customer_state"))
        .limit(k)
    )


def state_labels(facts: DataFrame, k: int = 10) -> DataFrame:
    """Top states by revenue with a display label such as ``$1,234``."""
    return top_states(facts, "revenue", k).select(
        "customer_state", "revenue", money_label(F.col("revenue")).alias("label")
    )


def segment_summary(customers: DataFrame) -> DataFrame:
    """Customers without a segment are left out; revenue is averaged exactly from its sum.

    ``customers`` counts rows, ``identified`` those with an id.
    """
    return (
        customers.filter(F.col("customer_segment").isNotNull())
        .groupBy("customer_segment")
        .agg(
            F.count("*").alias("customers"),
            F.count("customer_unique_id").alias("identified"),
            rounded(ratio(F.sum("total_revenue"), F.count("total_revenue")), 2).alias(
                "avg_revenue"
            ),
            _avg(F.col("total_orders")).alias("avg_orders"),
            _avg(F.col("recency_days")).alias("avg_recency"),
            _avg(F.col("avg_review_score")).alias("avg_score"),
        )
        .orderBy(F.desc("customers"), "customer_segment")
    )


def segment_share(customers: DataFrame) -> DataFrame:
    """Segment sizes as percentages of all; the window runs over one row per segment."""
    sized = (
        customers.filter(F.col("customer_segment").isNotNull())
        .groupBy("customer_segment")
        .agg(
            F.count("*").alias("customers"),
            rounded(ratio(F.sum("total_revenue"), F.count("total_revenue")), 2).alias(
                "mean_revenue"
            ),
        )
    )
    everyone = F.sum("customers").over(Window.partitionBy())
    return sized.withColumn("share_pct", rounded(F.col("customers") * 100 / everyone, 1)).orderBy(
        F.desc("mean_revenue"), "customer_segment"
    )


def segment_points(customers: DataFrame) -> DataFrame:
    """Scatter data for all segments at once."""
    return customers.select(
        "customer_unique_id",
        "customer_segment",
        "recency_days",
        F.col("total_revenue").cast("double").alias("total_revenue"),
    )


def distinct_segments(customers: DataFrame) -> DataFrame:
    return customers.select("customer_segment").distinct()


def churn_summary(metrics: DataFrame) -> DataFrame:
    label = F.when(F.col("is_churned") == 1, "At Risk (1 order)").otherwise("Active (2+ orders)")
    return (
        metrics.groupBy("is_churned")
        .agg(
            F.count("*").alias("customers"),
            rounded(ratio(F.sum("total_revenue"), F.count("total_revenue")), 2).alias(
                "avg_revenue"
            ),
            _avg(F.col("total_orders")).alias("avg_orders"),
            _avg(F.col("recency_days"), 0).alias("avg_recency"),
        )
        .select("is_churned", label.alias("label"), "customers", "avg_revenue", "avg_orders",
                "avg_recency")
    )


# Display names of the churn and lifetime-value tables.
CHURN_HEADINGS = {
    "label": "Segment",
    "customers": "Customers",
    "avg_revenue": "Avg Revenue ($)",
    "avg_orders": "Avg Orders",
    "avg_recency": "Avg Recency (days)",
}
CLV_HEADINGS = {
    "customer_segment": "Segment",
    "customers": "Customers",
    "avg_clv": "Avg CLV ($)",
    "min_clv": "Min ($)",
    "max_clv": "Max ($)",
}


def with_headings(report: DataFrame, headings: dict[str, str]) -> DataFrame:
    """Only the named columns, under their display names."""
    return report.select(*headings).withColumnsRenamed(headings)


def clv_by_segment(metrics: DataFrame) -> DataFrame:
    revenue = F.col("total_revenue")
    return (
        metrics.groupBy("customer_segment")
        .agg(
            rounded(ratio(F.sum(revenue), F.count(revenue)), 2).alias("avg_clv"),
            money(F.min(revenue)).alias("min_clv"),
            money(F.max(revenue)).alias("max_clv"),
            F.count("*").alias("customers"),
        )
        .orderBy(F.desc_nulls_last("avg_clv"), "customer_segment")
    )


def status_funnel(facts: DataFrame) -> DataFrame:
    """Orders per status in funnel order; statuses outside the funnel are left out."""
    stage = None
    for place, name in enumerate(FUNNEL):
        hit = F.col("status") == name
        stage = F.when(hit, place) if stage is None else stage.when(hit, place)
    return (
        facts.groupBy("status")
        .agg(
            F.sum(_w()).alias("orders"),
            rounded(mean(F.col("order_value"), _w()), 2).alias("avg_order_value"),
            rounded(mean(F.col("delivery_days"), _w()), 2).alias("avg_delivery_days"),
        )
        .withColumn("order_rank", stage)
        .filter(F.col("order_rank").isNotNull())
        .orderBy("order_rank")
    )


def delivery_histogram(facts: DataFrame) -> DataFrame:
    return (
        _delivered(facts)
        .filter(F.col("delivery_days").isNotNull())
        .filter(F.col("delivery_days").between(*DELIVERY_RANGE))
        .groupBy("delivery_days")
        .agg(F.sum(_w()).alias("orders"))
        .orderBy("delivery_days")
    )


def delivery_mean_median(histogram: DataFrame) -> DataFrame:
    """Weighted mean, and the first day by which half of the orders have arrived.

    The histogram has at most one row per day of the delivery range, so one task is enough.
    """
    day, n = F.col("delivery_days"), F.col("orders")
    upto = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = histogram.select(
        day, n, F.sum(n).over(upto).alias("reached"), F.sum(n).over(Window.partitionBy()).alias("all")
    )
    return running.agg(
        rounded(ratio(F.sum(day * n), F.sum(n)), 1).alias("mean_days"),
        F.min(F.when(F.col("reached") >= F.col("all") / 2, day)).alias("median_days"),
    )


def payment_breakdown(facts: DataFrame) -> DataFrame:
    return (
        facts.groupBy(F.col("primary_payment_type").alias("payment_type"))
        .agg(
            F.sum(_w()).alias("orders"),
            money(total(F.col("order_value"), _w())).alias("total_revenue"),
            rounded(mean(F.col("max_installments"), _w()), 1).alias("avg_installments"),
            rounded(mean(F.col("order_value"), _w()), 2).alias("avg_order_value"),
        )
        .orderBy(F.desc("orders"), F.asc_nulls_last("payment_type"))
    )


def payment_reconciliation(payment_totals: DataFrame, item_totals: DataFrame) -> DataFrame:
    """Per order: what was paid against what the items add up to."""
    paid = F.coalesce(F.col("total_payment"), F.lit(0).cast("decimal(10,2)"))
    owed = F.coalesce(F.col("order_value"), F.lit(0).cast("decimal(10,2)"))
    return payment_totals.join(item_totals, "order_id", "full").select(
        "order_id",
        money(paid).alias("paid"),
        money(owed).alias("items_total"),
        money(paid - owed).alias("difference"),
    )


def zip_dimension(customers: DataFrame, sellers: DataFrame) -> DataFrame:
    """One row per zip code; customers' entries win over sellers', then the smallest city.

    Grouping with ``min`` combines map-side, so a zip shared by very many customers is cheap.
    """
    place = F.struct("source", "city", "state")
    both = customers.select("zip_code", "city", "state", F.lit(0).alias("source")).unionByName(
        sellers.select("zip_code", "city", "state", F.lit(1).alias("source"))
    )
    return (
        both.groupBy("zip_code")
        .agg(F.min(place).alias("first"))
        .select("zip_code", "first.city", "first.state")
    )
