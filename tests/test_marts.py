import datetime as dt
from decimal import Decimal

import pytest
from helpers import rows
from pyspark.sql import functions as F

from cartwright.plans import cohorts, enriched, marts, reports, staging
from cartwright.sources.schemas import RAW_TABLES

AS_OF = "2018-06-01 00:00:00"


def raw(spark, table, *records):
    return spark.createDataFrame(list(records), RAW_TABLES[table].schema)


@pytest.fixture(scope="module")
def staged(spark):
    """Four customers' orders with the awkward cases: see the comments."""
    bought, due = "2018-01-01 23:00:00", "2018-01-10 00:00:00"
    orders = raw(
        spark, "orders_dataset",
        # delivered exactly on the estimate; two reviews
        ("o1", "c1", "delivered", bought, bought, bought, due, due),
        # one calendar day more than elapsed days; late; no review
        ("o2", "c2", "delivered", bought, "", "", "2018-01-03 01:00:00", "2018-01-02 00:00:00"),
        # delivered without a date and without items
        ("o3", "c3", "delivered", "2018-03-05 10:00:00", "", "", "", due),
        # not delivered, on a Sunday
        ("o4", "c4", "processing", "2018-01-07 00:00:00", "", "", "", due),
        # status outside the funnel
        ("o5", "c4", "lost", "2018-01-07 00:00:00", "", "", "", due),
    )
    customers = raw(
        spark, "customers_dataset",
        ("c1", "u1", "01", "rio", "RJ"), ("c2", "u1", "02", "sampa", "SP"),
        ("c3", "u2", "03", "rio", "RJ"), ("c4", "u3", "03", "rio", "RJ"),
    )
    products = raw(
        spark, "products_dataset",
        ("p1", "bebes", "1", "2", "3", "4", "5", "6", "7"),
        ("p2", "desconhecido", "1", "2", "3", "4", "5", "6", "7"),
    )
    items = raw(
        spark, "order_items_dataset",
        ("o1", "1", "p1", "s1", bought, "10.00", "2.50"),
        ("o1", "2", "p2", "s1", bought, "20.00", "0.00"),
        ("o2", "1", "p1", "s1", "", "0.00", "0.00"),
        ("o4", "1", "p9", "s9", bought, "5.00", "5.00"),
    )
    payments = raw(
        spark, "order_payments_dataset",
        ("o1", "1", "voucher", "1", "50.00"), ("o1", "2", "credit_card", "3", "50.00"),
        ("o1", "3", "boleto", "1", "1.00"), ("o2", "1", "boleto", " ", "7.00"),
    )
    reviews = raw(
        spark, "order_reviews_dataset",
        ("r1", "o1", "5", "", "good", bought, ""), ("r2", "o1", "1", "", "bad", bought, bought),
        ("r3", "o4", "", "", "", bought, bought),
    )
    translation = raw(spark, "product_category_name_translation", ("bebes", "baby"))
    sellers = raw(spark, "sellers_dataset", ("s1", "02", "sampa", "SP"), ("s2", "09", "x", "XX"))
    return staging.all_staged({
        "orders_dataset": orders, "customers_dataset": customers, "products_dataset": products,
        "order_items_dataset": items, "order_payments_dataset": payments,
        "order_reviews_dataset": reviews, "sellers_dataset": sellers,
        "product_category_name_translation": translation,
    })


@pytest.fixture(scope="module")
def orders(staged):
    return enriched.orders_enriched(
        staged["stg_orders"], staged["stg_customers"], staged["stg_order_payments"]
    ).cache()


@pytest.fixture(scope="module")
def paid(staged):
    return enriched.orders_with_payments(staged["stg_orders"], staged["stg_order_payments"])


@pytest.fixture(scope="module")
def facts(staged, paid):
    return marts.order_facts(
        paid, staged["stg_order_items"], staged["stg_order_reviews"], staged["stg_customers"]
    ).cache()


def published(staged, paid, reviews=None):
    return marts.fct_orders(
        paid,
        staged["stg_order_items"],
        staged["stg_order_reviews"] if reviews is None else reviews,
        staged["stg_customers"],
    )


@pytest.fixture(scope="module")
def rollup(facts):
    return enriched.customer_rollup(facts, AS_OF).cache()


def by(df, key, *columns):
    return {r[key]: tuple(r[c] for c in columns) for r in df.collect()}


def test_staging_types_and_fallbacks(staged):
    assert by(staged["stg_products"], "product_id", "category") == {
        "p1": ("baby",), "p2": ("desconhecido",)
    }
    o = by(staged["stg_orders"], "order_id", "purchased_at", "approved_at")
    assert o["o2"] == (dt.datetime(2018, 1, 1, 23), None)
    kinds = dict(staged["stg_order_items"].dtypes)
    assert kinds["price"] == "decimal(10,2)" and kinds["total_amount"] == "decimal(11,2)"
    assert kinds["shipping_limit_at"] == "timestamp_ntz" and kinds["item_sequence"] == "string"
    r = by(staged["stg_order_reviews"], "review_id", "score", "is_positive")
    assert r == {"r1": (5, True), "r2": (1, False), "r3": (None, False)}


def test_delivery_facts(orders):
    got = by(orders, "order_id", "delivery_days", "delivery_delay_days", "delivered_on_time")
    assert got["o1"] == (8, 0, True)
    assert got["o2"] == (1, 1, False)
    assert got["o3"] == (None, None, False)


def test_primary_payment_is_the_largest_ties_to_the_greater_name(orders):
    got = by(orders, "order_id", "primary_payment_type", "total_payment", "max_installments",
             "payment_count")
    assert got["o1"] == ("voucher", Decimal("101.00"), 3, 3)
    assert got["o2"] == ("boleto", Decimal("7.00"), None, 1)
    assert got["o3"] == (None, None, None, None)


def test_freight_share_is_null_for_a_zero_total(staged):
    got = enriched.order_items_enriched(
        staged["stg_order_items"], staged["stg_products"], staged["stg_sellers"]
    )
    by_order = {(r["order_id"], r["item_sequence"]): r for r in got.collect()}
    assert float(by_order["o1", "1"]["freight_pct"]) == 20.0
    assert by_order["o2", "1"]["freight_pct"] is None
    assert by_order["o4", "1"]["product_category"] is None
    assert by_order["o4", "1"]["seller_city"] is None


def test_order_fact_repeats_an_order_per_review(staged, paid):
    fact = published(staged, paid)
    assert len(fact.columns) == 24
    got = sorted((r["order_id"], r["review_score"] or 0, r["order_value"]) for r in fact.collect())
    assert [g[:2] for g in got] == [("o1", 1), ("o1", 5), ("o2", 0), ("o3", 0), ("o4", 0), ("o5", 0)]
    assert got[0][2] == got[1][2] == Decimal("32.50")
    assert by(fact, "order_id", "purchase_dow")["o4"] == (7,)


def test_order_fact_restores_very_many_reviews(spark, paid, staged, monkeypatch):
    monkeypatch.setattr(marts, "_REPEAT_CHUNK", 7)
    many = staged["stg_order_reviews"].filter("review_id = 'r1'").crossJoin(spark.range(50)).drop("id")
    fact = published(staged, paid, many)
    assert fact.filter("order_id = 'o1'").count() == 50
    assert fact.count() == 54


def test_weighted_facts_agree_with_the_repeated_ones(staged, paid, facts):
    fact = published(staged, paid)
    plain = fact.groupBy("status").agg(F.count("*"), F.sum("order_value"))
    weighted = facts.groupBy("status").agg(
        F.sum("fan_out"), F.sum(F.col("order_value") * F.col("fan_out"))
    )
    assert rows(plain) == rows(weighted)


def test_customer_rollup_counts_an_order_per_review(rollup):
    got = {(r["customer_unique_id"], r["customer_city"]): r for r in rollup.collect()}
    assert set(got) == {("u1", "rio"), ("u1", "sampa"), ("u2", "rio")}
    rio = got["u1", "rio"]
    assert (rio["total_orders"], rio["total_items"], rio["total_reviews"]) == (2, 4, 2)
    assert rio["total_revenue"] == Decimal("65.00") and rio["avg_order_value"] == 32.5
    assert (rio["avg_review_score"], rio["positive_reviews"]) == (3.0, 1)
    assert (rio["customer_age_days"], rio["recency_days"], rio["on_time_deliveries"]) == (0, 150, 2)
    empty = got["u2", "rio"]
    assert empty["total_revenue"] is None and empty["avg_review_score"] is None
    assert (empty["total_items"], empty["total_reviews"], empty["on_time_deliveries"]) == (None, 0, 0)


def test_dimension_scores_and_metrics(rollup):
    dim = marts.dim_customers(rollup)
    scored = {(r["customer_unique_id"], r["customer_city"]): r for r in dim.collect()}
    assert scored["u2", "rio"]["monetary_score"] == 3  # a missing revenue ranks last
    assert scored["u2", "rio"]["recency_score"] == 3
    metrics = {r["total_orders"]: r for r in marts.customer_metrics(dim).collect()}
    assert metrics[2]["orders_per_month"] is None and metrics[2]["is_churned"] == 0
    assert metrics[1]["is_churned"] == 1
    assert (metrics[2]["active_last_90d"], metrics[2]["active_last_180d"]) == (0, 1)
    assert metrics[2]["positive_review_rate"] == 0.5 and metrics[2]["on_time_rate"] == 1.0


@pytest.mark.parametrize(
    ("r", "f", "name"),
    [(5, 4, "Champion"), (3, 3, "Loyal"), (4, 3, "Loyal"), (5, 1, "New Customer"),
     (1, 5, "At Risk"), (2, 2, "Lost"), (3, 1, "Potential")],
)
def test_segments(spark, r, f, name):
    assert spark.range(1).select(marts.segment(F.lit(r), F.lit(f))).first()[0] == name


def test_kpis_and_status_reports(facts):
    k = reports.kpi_overview(facts).first()
    assert (k["total_orders"], k["total_customers"]) == (3, 2)
    assert (k["total_revenue"], k["avg_order_value"]) == (65.0, 21.67)
    assert (k["avg_review_score"], k["on_time_pct"]) == (3.0, 50.0)
    assert by(reports.orders_by_status(facts), "status", "order_count")["delivered"] == (4,)
    funnel = [tuple(r) for r in reports.status_funnel(facts).collect()]
    assert [f[0] for f in funnel] == ["processing", "delivered"]
    assert funnel[1][1:] == (4, 21.67, 5.67, 4)


def test_month_category_state_and_payment_reports(staged, facts):
    months = by(reports.revenue_by_month(facts), "period", "revenue", "orders", "fact_rows")
    assert months == {"2018-01": (65.0, 2, 3), "2018-03": (None, 1, 1)}
    items = enriched.order_items_enriched(
        staged["stg_order_items"], staged["stg_products"], staged["stg_sellers"]
    )
    top = [tuple(r) for r in reports.top_categories(items, 2).collect()]
    assert top == [("desconhecido", 1, 20.0), ("baby", 2, 12.5)]
    assert [r["customer_state"] for r in reports.top_states(facts, "orders", 1).collect()] == ["RJ"]
    assert by(reports.state_labels(facts), "customer_state", "label")["RJ"] == ("$65",)
    paid = by(reports.payment_breakdown(facts), "payment_type", "orders", "avg_installments")
    assert paid["voucher"] == (2, 3.0) and paid[None] == (3, None)
    gaps = reports.payment_reconciliation(
        enriched.payment_totals(staged["stg_order_payments"]),
        enriched.item_totals(staged["stg_order_items"]),
    )
    assert by(gaps, "order_id", "difference") == {"o1": (68.5,), "o2": (7.0,), "o4": (-10.0,)}


def test_zip_dimension_prefers_customers(staged):
    zips = reports.zip_dimension(staged["stg_customers"], staged["stg_sellers"])
    assert by(zips, "zip_code", "state") == {
        "01": ("RJ",), "02": ("SP",), "03": ("RJ",), "09": ("XX",)
    }


def test_weighted_median_and_mean(spark):
    histogram = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "delivery_days long, orders long")
    assert tuple(reports.delivery_mean_median(histogram).first()) == (2.3, 2)


def test_delivery_histogram_keeps_the_range(spark):
    days = [(d, "delivered", 1) for d in (0, 1, 60, 61, None, 1)]
    df = spark.createDataFrame(days, "delivery_days long, status string, fan_out int")
    assert rows(reports.delivery_histogram(df)) == [(1, 2), (60, 1)]


def test_segment_reports(spark):
    df = spark.createDataFrame(
        [("a", "Lost", 10, 1, Decimal("2.00"), 5.0), ("b", "Lost", 20, 3, None, None),
         ("c", "Loyal", 5, 9, Decimal("8.00"), 4.0), ("d", None, 5, 9, Decimal("8.00"), 4.0)],
        "customer_unique_id string, customer_segment string, recency_days long, "
        "total_orders long, total_revenue decimal(38,2), avg_review_score double",
    )
    summary = by(reports.segment_summary(df), "customer_segment", "customers", "avg_revenue",
                 "avg_orders", "avg_recency", "avg_score")
    assert summary == {"Lost": (2, 2.0, 2.0, 15.0, 5.0), "Loyal": (1, 8.0, 9.0, 5.0, 4.0)}
    assert by(reports.segment_share(df), "customer_segment", "share_pct") == {
        "Lost": (66.7,), "Loyal": (33.3,)
    }
    headed = reports.with_headings(
        df.select(F.col("customer_segment").alias("label"), F.lit(1).alias("customers"),
                  F.lit(2.0).alias("avg_revenue"), F.lit(1).alias("avg_orders"),
                  F.lit(0).alias("avg_recency"), "recency_days"), reports.CHURN_HEADINGS)
    assert headed.columns == ["Segment", "Customers", "Avg Revenue ($)", "Avg Orders",
                              "Avg Recency (days)"]


def test_cohorts(spark):
    orders = [("a", "2018-01-31"), ("a", "2018-03-01"), ("a", "2018-03-09"), ("b", "2018-01-01"),
              ("c", "2018-02-01"), ("c", "2018-03-01"), (None, "2018-01-01")]
    df = spark.createDataFrame(orders, "customer_unique_id string, at string").select(
        "customer_unique_id", F.col("at").cast("timestamp_ntz").alias("purchased_at"),
        F.lit("delivered").alias("status"),
    )
    activity = cohorts.cohort_activity(df).cache()
    jan, feb = dt.date(2018, 1, 1), dt.date(2018, 2, 1)
    assert rows(activity) == [(jan, 0, 2), (jan, 2, 1), (feb, 0, 1), (feb, 1, 1)]
    rates = cohorts.retention(activity).cache()
    assert {(r["cohort"], r["period"]): r["retention_pct"] for r in rates.collect()} == {
        ("2018-01", 0): 100.0, ("2018-01", 2): 50.0, ("2018-02", 0): 100.0, ("2018-02", 1): 100.0
    }
    assert tuple(cohorts.retention_insight(rates).first()) == (100.0, 0.0, "2018-02")
    wide = cohorts.retention_matrix(rates)
    assert wide.columns == ["cohort_month", "m0", "m1", "m2"]
    assert rows(wide) == [(jan, 100.0, None, 50.0), (feb, 100.0, 100.0, None)]
