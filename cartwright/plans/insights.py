"""Business figures as short text documents, their embeddings, and top-k retrieval over them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwright.functions.embedding import hash_embedding
from cartwright.functions.text import fixed_digits
from cartwright.operators.similarity import nearest_lists
from cartwright.plans import reports
from cartwright.sources.tables import read_or_build

# What the documents and the customer figures behind them need of the order fact.
FACT_COLUMNS = (
    "order_id",
    "customer_unique_id",
    "customer_city",
    "customer_state",
    "status",
    "purchased_at",
    "primary_payment_type",
    "max_installments",
    "item_count",
    "order_value",
    "delivery_days",
    "delivered_on_time",
    "fan_out",
    "review_count",
    "scored_reviews",
    "score_sum",
    "positive_reviews",
)


def _line(*parts: str | Column) -> Column:
    """Text pieces and values side by side; a missing value reads ``None``."""
    pieces = [
        F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("None"))
        for p in parts
    ]
    return F.concat(*pieces)


def _amount(name: str) -> Column:
    return fixed_digits(F.col(name))


def _listing(
    name: str, heading: str, report: DataFrame, line: Column, *order: Column
) -> DataFrame:
    """One document: a heading and one line per report row (segments, types, or a top ten)."""
    ranked = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], line.alias("line"))
    lines = F.transform(F.sort_array(F.collect_list(ranked)), lambda x: x["line"])
    body = F.concat(F.lit(heading + "\n"), F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""))
    return report.agg(body.alias("text")).select(F.lit(name).alias("id"), "text")


def _kpis(facts: DataFrame) -> DataFrame:
    text = F.concat_ws(
        "\n        ",
        F.lit("Overall Business KPIs:"),
        _line("Total delivered orders: ", F.col("total_orders")),
        _line("Total unique customers: ", F.col("total_customers")),
        _line("Total revenue: R$ ", _amount("total_revenue")),
        _line("Average order value: R$ ", _amount("avg_order_value")),
        _line("Average review score: ", _amount("avg_review_score"), " out of 5"),
        _line("On-time delivery rate: ", _amount("on_time_pct"), "%"),
    )
    return reports.kpi_overview(facts).select(F.lit("kpi_overview").alias("id"), text.alias("text"))


def insight_documents(
    facts: DataFrame, customers: DataFrame, items: DataFrame, metrics: DataFrame
) -> DataFrame:
    """Six documents ``(id, text)``; every list in them is short by nature or a top ten.

    ``facts`` and ``customers`` feed several documents each; pass stored frames.
    """
    customer_word = F.when(F.col("is_churned") == 1, "Churned").otherwise("Active")
    documents = [
        _kpis(facts),
        _listing(
            "customer_segments",
            "Customer Segments:",
            reports.segment_summary(customers),
            _line("  ", F.col("customer_segment"), ": ", F.col("customers"),
                  " customers, avg revenue R$ ", _amount("avg_revenue"), ", avg ",
                  _amount("avg_orders"), " orders"),
            -F.col("avg_revenue"), F.col("customer_segment"),
        ),
        _listing(
            "top_categories",
            "Top 10 Product Categories by Revenue:",
            reports.top_categories(items, 10),
            _line("  ", F.col("product_category"), ": R$ ", _amount("revenue"), " from ",
                  F.col("orders"), " orders"),
            -F.col("revenue"), F.col("product_category"),
        ),
        _listing(
            "payment_types",
            "Payment Type Breakdown:",
            reports.payment_breakdown(facts),
            _line("  ", F.col("payment_type"), ": ", F.col("orders"), " orders, avg R$ ",
                  _amount("avg_order_value")),
            -F.col("orders"), F.col("payment_type"),
        ),
        _listing(
            "state_performance",
            "Top 10 States by Revenue:",
            reports.top_states(facts, "revenue", 10),
            _line("  ", F.col("customer_state"), ": R$ ", _amount("revenue"), " from ",
                  F.col("orders"), " orders"),
            -F.col("revenue"), F.col("customer_state"),
        ),
        _listing(
            "churn_stats",
            "Churn Analysis:",
            reports.churn_summary(metrics),
            _line("  ", customer_word, ": ", F.col("customers"), " customers, avg revenue R$ ",
                  _amount("avg_revenue")),
            F.col("is_churned"),
        ),
    ]
    return reduce(DataFrame.unionByName, documents)


def embedded(documents: DataFrame) -> DataFrame:
    """Documents ``(id, text)`` with their hash embedding; the text itself stays behind."""
    return documents.select("id", hash_embedding(F.col("text")).alias("embedding"))


def embedding_store(documents: DataFrame) -> DataFrame:
    """What is kept for retrieval: id, text and embedding."""
    return documents.select("id", "text", hash_embedding(F.col("text")).alias("embedding"))


def retrieve(questions: DataFrame, store: DataFrame, k: int = 3, **search) -> DataFrame:
    """For every question ``(id, embedding)`` the ``k`` closest stored documents by cosine."""
    asked = questions.select(F.col("id").alias("query_id"), F.col("embedding").alias("vec"))
    held = store.select(F.col("id").alias("item_id"), F.col("embedding").alias("vec"))
    return nearest_lists(
        asked.filter(F.col("vec").isNotNull()), held.filter(F.col("vec").isNotNull()), k, **search
    )


def _ranked(lists: DataFrame, query: str, item: str) -> DataFrame:
    return lists.select("query_id", F.posexplode("neighbours").alias("at", "n")).select(
        F.col("query_id").alias(query),
        (F.col("at") + 1).alias("place"),
        F.col("n.item_id").alias(item),
        F.col("n.similarity").alias("similarity"),
    )


def matches(lists: DataFrame) -> DataFrame:
    return _ranked(lists, "question_id", "document_id")


def nearest_others(vectors: DataFrame, k: int, **search) -> DataFrame:
    """Each stored vector's ``k`` nearest other vectors."""
    lists = retrieve(vectors, vectors, k + 1, item_vectors=False, **search)
    others = F.filter("neighbours", lambda x: x["item_id"] != F.col("query_id"))
    trimmed = lists.withColumn("neighbours", F.slice(others, 1, k))
    return _ranked(trimmed, "vec_id", "neighbour_id")


def context(found: DataFrame, documents: DataFrame) -> DataFrame:
    """Per question its documents' texts, best first, joined by blank lines."""
    texts = documents.select(F.col("id").alias("document_id"), "text")
    ordered = F.sort_array(F.collect_list(F.struct("place", "text")))
    return (
        found.join(texts, "document_id")
        .groupBy("question_id")
        .agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("context"))
    )


def stored_embeddings(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The embedding table at ``path``; made from ``build()``'s documents when it is missing."""
    return read_or_build(spark, path, lambda: embedding_store(build()))
