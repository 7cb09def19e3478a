"""Every registered query: ``(spark, folder of star tables) -> DataFrame``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwright.functions.dates import elapsed_days
from cartwright.operators import hyperplane, quality
from cartwright.plans import (
    cohorts,
    enriched,
    features,
    insights,
    marts,
    models,
    recommend,
    reports,
    staging,
)
from cartwright.session import materialize, shared_folder
from cartwright.sources import tables
from cartwright.sources.reuse import Store
from cartwright.sources.star import AS_OF, Star
from cartwright.sources.versions import VersionedTable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Callable[[Star], DataFrame]) -> Callable[[Star], DataFrame]:
    """Register a function of the bound star tables under its own name."""
    QUERIES[fn.__name__] = lambda spark, folder: fn(Star(spark, folder))
    return fn


def _as_double(df: DataFrame) -> DataFrame:
    """Exact decimals as doubles, the form in which results are compared."""
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name)
            if f.dataType.typeName() == "decimal"
            else F.col(f.name)
            for f in df.schema
        ]
    )


# ---- shared frames --------------------------------------------------------------------------


def _paid(s: Star) -> DataFrame:
    return enriched.orders_with_payments(s.orders, s.order_payments)


def _facts(s: Star) -> DataFrame:
    return marts.order_facts(_paid(s), s.order_items, s.order_reviews, s.customers)


def _facts_only(s: Star) -> DataFrame:
    """Without customer columns, for reports that need none."""
    return marts.order_facts(_paid(s), s.order_items, s.order_reviews)


def _items(s: Star) -> DataFrame:
    return enriched.order_items_enriched(s.order_items, s.products, s.sellers)


def _rollup(s: Star) -> DataFrame:
    return enriched.customer_rollup(_facts(s), AS_OF)


def _dim(s: Star) -> DataFrame:
    return marts.dim_customers(_rollup(s))


def _metrics(s: Star) -> DataFrame:
    return marts.customer_metrics(_dim(s))


def _clean(s: Star, table: str) -> DataFrame:
    return quality.clean(s.raw(table), table)


# ---- staging, enrichment, marts -------------------------------------------------------------


@query
def stg_orders(s: Star) -> DataFrame:
    return staging.orders(_clean(s, "orders_dataset"))


@query
def stg_customers(s: Star) -> DataFrame:
    return staging.customers(_clean(s, "customers_dataset"))


@query
def stg_sellers(s: Star) -> DataFrame:
    return staging.sellers(_clean(s, "sellers_dataset"))


@query
def stg_products(s: Star) -> DataFrame:
    return staging.products(
        _clean(s, "products_dataset"), _clean(s, "product_category_name_translation")
    )


@query
def stg_order_items(s: Star) -> DataFrame:
    return _as_double(staging.order_items(_clean(s, "order_items_dataset")))


@query
def stg_order_payments(s: Star) -> DataFrame:
    return _as_double(staging.order_payments(_clean(s, "order_payments_dataset")))


@query
def stg_order_reviews(s: Star) -> DataFrame:
    return staging.order_reviews(_clean(s, "order_reviews_dataset"))


@query
def orders_enriched(s: Star) -> DataFrame:
    return _as_double(enriched.orders_enriched(s.orders, s.customers, s.order_payments))


@query
def order_items_enriched(s: Star) -> DataFrame:
    return _as_double(_items(s))


@query
def fct_orders(s: Star) -> DataFrame:
    return _as_double(marts.fct_orders(_paid(s), s.order_items, s.order_reviews, s.customers))


@query
def customer_rollup(s: Star) -> DataFrame:
    return _as_double(_rollup(s))


@query
def dim_customers(s: Star) -> DataFrame:
    return _as_double(_dim(s))


@query
def customer_metrics(s: Star) -> DataFrame:
    return _as_double(_metrics(s))


# ---- reports --------------------------------------------------------------------------------


@query
def kpi_overview(s: Star) -> DataFrame:
    return reports.kpi_overview(_facts(s))


@query
def orders_by_status(s: Star) -> DataFrame:
    return reports.orders_by_status(_facts_only(s))


@query
def revenue_by_month(s: Star) -> DataFrame:
    return reports.revenue_by_month(_facts_only(s))


@query
def top_categories(s: Star) -> DataFrame:
    return reports.top_categories(enriched.items_with_category(s.order_items, s.products))


@query
def revenue_by_state(s: Star) -> DataFrame:
    return reports.state_revenue(_facts(s))


@query
def top_states_by_orders(s: Star) -> DataFrame:
    return reports.top_states(_facts(s), "orders")


@query
def state_labels(s: Star) -> DataFrame:
    return reports.state_labels(_facts(s))


@query
def rfm_scores(s: Star) -> DataFrame:
    return _as_double(
        _dim(s).select(
            "customer_unique_id",
            "recency_days",
            "total_orders",
            "total_revenue",
            "recency_score",
            "frequency_score",
            "monetary_score",
            "customer_segment",
            "customer_state",
        )
    )


@query
def segment_summary(s: Star) -> DataFrame:
    return reports.segment_summary(_dim(s))


@query
def segment_share(s: Star) -> DataFrame:
    return reports.segment_share(_dim(s))


@query
def segment_points(s: Star) -> DataFrame:
    return reports.segment_points(_dim(s))


@query
def distinct_segments(s: Star) -> DataFrame:
    return reports.distinct_segments(_dim(s))


@query
def churn_summary(s: Star) -> DataFrame:
    return reports.churn_summary(_metrics(s))


@query
def churn_table(s: Star) -> DataFrame:
    return reports.with_headings(reports.churn_summary(_metrics(s)), reports.CHURN_HEADINGS)


@query
def clv_table(s: Star) -> DataFrame:
    return reports.with_headings(reports.clv_by_segment(_metrics(s)), reports.CLV_HEADINGS)


@query
def clv_by_segment(s: Star) -> DataFrame:
    return reports.clv_by_segment(_metrics(s))


@query
def status_funnel(s: Star) -> DataFrame:
    return reports.status_funnel(_facts_only(s))


@query
def delivery_histogram(s: Star) -> DataFrame:
    return reports.delivery_histogram(_facts_only(s))


@query
def delivery_mean_median(s: Star) -> DataFrame:
    return reports.delivery_mean_median(reports.delivery_histogram(_facts_only(s)))


@query
def payment_breakdown(s: Star) -> DataFrame:
    return reports.payment_breakdown(_facts_only(s))


@query
def payment_reconciliation(s: Star) -> DataFrame:
    return reports.payment_reconciliation(
        enriched.payment_totals(s.order_payments), enriched.item_totals(s.order_items)
    )


@query
def zip_dimension(s: Star) -> DataFrame:
    return reports.zip_dimension(s.customers, s.sellers)


@query
def event_day_gaps(s: Star) -> DataFrame:
    first, last = F.min("ts"), F.max("ts")
    return (
        s.table("events")
        .groupBy("user_id")
        .agg(
            first.alias("first_at"),
            last.alias("last_at"),
            elapsed_days(first, last).alias("days_between"),
            F.count("*").alias("events"),
        )
    )


# ---- cohorts --------------------------------------------------------------------------------


def _activity(s: Star) -> DataFrame:
    return cohorts.cohort_activity(_facts(s), cohorts.month_span(s.orders))


@query
def cohort_activity(s: Star) -> DataFrame:
    return _activity(s)


@query
def cohort_matrix(s: Star) -> DataFrame:
    activity = materialize(_activity(s), "activity")
    return cohorts.matrix_cells(activity, values="customers")


@query
def retention_pct(s: Star) -> DataFrame:
    return cohorts.retention(_activity(s))


@query
def retention_insight(s: Star) -> DataFrame:
    return cohorts.retention_insight(cohorts.retention(_activity(s)))


# ---- data quality ---------------------------------------------------------------------------


@query
def quality_report(s: Star) -> DataFrame:
    return quality.quality_reports(s.raw_tables)


@query
def observed_quality_report(s: Star) -> DataFrame:
    """The same report, counted while the cleaned tables are written."""
    base = _folder(s, "cleaned")
    return quality.clean_and_report(s.raw_tables, lambda df, name: df.write.parquet(f"{base}/{name}"))


@query
def constraint_violations(s: Star) -> DataFrame:
    staged = staging.all_staged(quality.clean_all(s.raw_tables))
    # each frame is asked several times over, so its rows are cleaned once and stored
    checked = {m: materialize(staged[m].select(*quality.checked_columns(m)), m) for m in quality.CHECKED_MODELS}
    return quality.constraint_violations(checked)


# ---- files, tables and SQL text -------------------------------------------------------------


def _folder(s: Star, label: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_folder(s.spark)}/{s.spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


@query
def landed_quality_report(s: Star) -> DataFrame:
    """All raw tables written as CSV, found and read again, and reported on."""
    base = _folder(s, "landing")
    for name, df in s.raw_tables.items():
        tables.land_csv(df, base, name)
    return quality.quality_reports(tables.read_all_raw(s.spark, base))


@query
def registered_stg_orders(s: Star) -> DataFrame:
    """Orders landed as CSV, registered as an external table and read by SQL text."""
    base, database = _folder(s, "landing"), f"raw_{uuid.uuid4().hex}"
    tables.land_csv(s.raw("orders_dataset"), base, "orders_dataset")
    tables.register_raw(s.spark, base, database)
    raw = tables.run_sql(s.spark, f"select * from {database}.orders_dataset")
    staged = materialize(staging.orders(quality.clean(raw, "orders_dataset")), "registered")
    s.spark.sql(f"drop database {database} cascade")
    return staged


@query
def stored_embedding(s: Star) -> DataFrame:
    """Embeddings built and stored at the first call, found at the second."""
    path = _folder(s, "embeddings")
    documents = s.table("documents").select(F.col("doc_id").alias("id"), "text")
    for _ in range(2):
        held = tables.read_or_build(s.spark, path, lambda: insights.embedding_store(documents))
    return held.select(
        F.col("id").alias("doc_id"), F.posexplode("embedding").alias("component", "value")
    )


@query
def stored_recommendations(s: Star) -> DataFrame:
    """Recommendations written highest score first, and read again."""
    vectors, categories = recommend.prepared(_purchases(s))
    lists = recommend.neighbour_lists(vectors)
    path = tables.save_sorted(
        recommend.recommendations(lists, categories), _folder(s, "recommendations"), "score"
    )
    return s.spark.read.parquet(path)


@query
def viewed_stg_orders(s: Star) -> DataFrame:
    """Orders published as a view and read by SQL text; nothing is stored."""
    name = f"stg_orders_{uuid.uuid4().hex}"
    tables.publish_views({name: staging.orders(_clean(s, "orders_dataset"))})
    return tables.run_sql(s.spark, f"select * from {name}")


@query
def stored_matrix(s: Star) -> DataFrame:
    """Purchase counts by customer and category in their sparse form, stored and read again."""
    path = _folder(s, "matrix")
    recommend.matrix_cells(_purchases(s)).write.parquet(path)
    return s.spark.read.parquet(path)


@query
def segments_by_sql(s: Star) -> DataFrame:
    """A stored mart, asked by SQL text."""
    name = f"dim_customers_{uuid.uuid4().hex}"
    tables.save_mart(_dim(s), name)
    text = f"select customer_segment, count(*) as customers from {name} group by all"
    result, note = tables.try_sql(s.spark, text)
    if result is None:
        raise RuntimeError(note)
    found = materialize(result, "segments")
    result.unpersist()
    s.spark.sql(f"drop table {name}")
    return found


@query
def segments_of_versions(s: Star) -> DataFrame:
    """A mart stored, replaced by a newer version and asked by name, before and after."""
    held = VersionedTable(s.spark, _folder(s, "versions"))
    name = f"segments_{uuid.uuid4().hex}"
    old = held.replace(_dim(s).select("customer_unique_id", F.lit("older").alias("customer_segment")))
    held.publish(name)
    held.replace(_dim(s).select("customer_unique_id", "customer_segment"))
    held.publish(name)
    newer = tables.run_sql(s.spark, f"select customer_segment, count(*) as customers from {name} group by all")
    before = old.groupBy("customer_segment").agg(F.count(F.lit(1)).alias("customers"))  # still there
    found = materialize(newer.unionByName(before), "segments")
    s.spark.sql(f"drop table {name}")
    return found


# ---- recommender ----------------------------------------------------------------------------


def _purchases(s: Star) -> DataFrame:
    items = enriched.items_with_category(s.order_items, s.products_by_brand)
    return recommend.category_purchases(items, _facts(s))


@query
def category_purchases(s: Star) -> DataFrame:
    return _as_double(_purchases(s))


@query
def user_item_matrix(s: Star) -> DataFrame:
    stored = materialize(_purchases(s), "purchases")
    return recommend.user_item_matrix(stored, recommend.category_names(stored))


@query
def category_popularity(s: Star) -> DataFrame:
    return recommend.category_popularity(_purchases(s))


@query
def top_category_popularity(s: Star) -> DataFrame:
    return recommend.category_popularity(_purchases(s), 15)


@query
def matrix_stats(s: Star) -> DataFrame:
    return recommend.matrix_stats(_purchases(s))


@query
def similar_customers(s: Star) -> DataFrame:
    vectors, _ = recommend.prepared(_purchases(s))
    return recommend.similar_customers(recommend.neighbour_lists(vectors, item_vectors=False))


@query
def similar_customers_pruned(s: Star) -> DataFrame:
    """The same lists by the path that large tables take."""
    vectors, _ = recommend.prepared(_purchases(s))
    lists = recommend.neighbour_lists(
        vectors, block_rows=64, pivots=64, unpruned_blocks=0, sent_bytes=0, item_vectors=False
    )
    return recommend.similar_customers(lists)


@query
def similar_customers_sparse(s: Star) -> DataFrame:
    """The same lists from the filled cells alone, by inverted lists."""
    return recommend.similar_by_cells(_purchases(s))


@query
def recommendations(s: Star) -> DataFrame:
    vectors, categories = recommend.prepared(_purchases(s))
    return recommend.recommendations(recommend.neighbour_lists(vectors), categories)


@query
def recommendation_text(s: Star) -> DataFrame:
    vectors, categories = recommend.prepared(_purchases(s))
    shown = recommend.first_customers(vectors)
    return recommend.recommendation_text(
        recommend.neighbour_lists(vectors, wanted=shown), categories
    )


@query
def already_purchased(s: Star) -> DataFrame:
    return recommend.already_purchased(_purchases(s))


# ---- insight documents and retrieval --------------------------------------------------------


@query
def insight_documents(s: Star) -> DataFrame:
    facts = materialize(_facts(s).select(*insights.FACT_COLUMNS), "order_facts")
    customers = marts.dim_customers(enriched.customer_rollup(facts, AS_OF))
    return insights.insight_documents(
        facts,
        customers,
        enriched.items_with_category(s.order_items, s.products),
        marts.customer_metrics(customers),
    )


@query
def hash_embedding(s: Star) -> DataFrame:
    """Embedding of every document, one row per component."""
    docs = insights.embedded(s.table("documents").select(F.col("doc_id").alias("id"), "text"))
    return docs.select(
        F.col("id").alias("doc_id"), F.posexplode("embedding").alias("component", "value")
    )


@query
def vector_topk(s: Star) -> DataFrame:
    """The three nearest other vectors of every stored vector."""
    vectors = materialize(
        s.table("embeddings").select(
            F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")
        ),
        "vectors",
    )
    return insights.nearest_others(vectors, 3)


def _vectors(s: Star) -> DataFrame:
    vec = F.col("embedding").cast("array<double>").alias("vec")
    return materialize(s.table("embeddings").select(F.col("vec_id").alias("id"), vec), "vectors")


@query
def probed_topk_quality(s: Star) -> DataFrame:
    """The search by signatures against the exact one: vectors asked for, results whose score is not
    the true similarity, and whether nine in ten of the true results are found."""
    vectors = _vectors(s)
    found = materialize(hyperplane.nearest_others(vectors, 3), "probed")
    sides = [vectors.select(F.col("id").alias(i), F.col("vec").alias(v)) for i, v in (("id", "a"), ("neighbour", "b"))]
    dot, aa, bb = (
        F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda t, p: t + p)
        for x, y in (("a", "b"), ("a", "a"), ("b", "b"))
    )
    true = dot / F.sqrt(aa * bb)
    wrong = found.join(sides[0], "id").join(sides[1], "neighbour").agg(
        F.countDistinct("id").alias("queries"),
        F.count_if(F.abs(true - F.col("similarity")) > 1e-9).alias("wrong_scores"),
    )
    exact = insights.nearest_others(vectors.select("id", F.col("vec").alias("embedding")), 3)
    same = exact.select(F.col("vec_id").alias("id"), F.col("neighbour_id").alias("neighbour"))
    hits = same.join(found.withColumn("hit", F.lit(1)), ["id", "neighbour"], "left")
    recall = hits.agg((F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("recall_reached"))
    one = F.lit(1).alias("one")
    return wrong.select("*", one).join(recall.select("*", one), "one").drop("one")


def _retrieved(s: Star) -> DataFrame:
    documents = s.table("documents").select(F.col("doc_id").alias("id"), "text")
    questions = s.table("benchmark").select(F.col("item_id").alias("id"), "text")
    store = materialize(insights.embedded(documents), "document_embeddings")
    asked = materialize(insights.embedded(questions), "question_embeddings")
    return insights.retrieve(asked, store, 3)


@query
def question_matches(s: Star) -> DataFrame:
    """For each benchmark text as a question, the three closest documents."""
    return insights.matches(_retrieved(s))


@query
def question_context(s: Star) -> DataFrame:
    """The text handed on per question: its matches joined by blank lines."""
    documents = s.table("documents").select(F.col("doc_id").alias("id"), "text")
    context = insights.context(insights.matches(_retrieved(s)), documents)
    return context.select(
        "question_id", F.length("context").alias("n_chars"), F.md5("context").alias("context_md5")
    )


# ---- features and models --------------------------------------------------------------------

def _churn_frame(s: Star) -> DataFrame:
    return materialize(features.churn_frame(_metrics(s)), "churn_frame")


@query
def numeric_summary(s: Star) -> DataFrame:
    return features.numeric_summary(_churn_frame(s), features.CHURN_FEATURES)


@query
def imputed_features(s: Star) -> DataFrame:
    return features.impute_medians(_churn_frame(s), features.CHURN_FEATURES)


@query
def one_hot(s: Star) -> DataFrame:
    frame = _churn_frame(s).select("customer_unique_id", features.CATEGORY)
    return features.one_hot(frame, features.levels(frame))


@query
def feature_matrix(s: Star) -> DataFrame:
    """What the models see, one row per value that is not 0, whatever the number of categories."""
    return features.matrix_cells(_churn_frame(s), features.CHURN_FEATURES)


@query
def stratified_split(s: Star) -> DataFrame:
    frame = _churn_frame(s).select("customer_unique_id", features.CHURN_TARGET)
    return features.folds(features.split(frame, features.CHURN_TARGET), features.CHURN_TARGET)


@query
def base_rates(s: Star) -> DataFrame:
    return features.base_rates(features.split(_churn_frame(s), features.CHURN_TARGET))


@query
def revenue_stats(s: Star) -> DataFrame:
    return features.revenue_stats(materialize(features.clv_frame(_metrics(s)), "clv_frame"))


def _rule_scores(s: Star) -> DataFrame:
    """Fixed rules in place of a model, so that the measures can be checked by SQL."""
    return _metrics(s).select(
        "is_churned",
        (1 - F.col("active_last_180d")).alias("inactive"),
        "recency_days",
        F.col("total_revenue").cast("double").alias("total_revenue"),
        F.col("max_order_value").cast("double").alias("max_order_value"),
    )


@query
def confusion_matrix(s: Star) -> DataFrame:
    return models.confusion_matrix(_rule_scores(s), "is_churned", "inactive")


@query
def classification_report(s: Star) -> DataFrame:
    return models.classification_report(_rule_scores(s), "is_churned", "inactive")


@query
def roc_auc(s: Star) -> DataFrame:
    scores = _rule_scores(s)
    return models.roc_auc(scores, "is_churned", "recency_days")


@query
def regression_report(s: Star) -> DataFrame:
    known = _rule_scores(s).filter(F.col("total_revenue").isNotNull())
    return models.regression_report(known, "total_revenue", "max_order_value")


MODEL_LIFETIME = 3600  # seconds


def _trained(s: Star, kind: str) -> models.Trained:
    """The fitted model and its rows, reused while the tables it was made from stay as they are."""
    store, metrics = Store(s.spark), _metrics(s)
    held: list[models.Trained] = []

    def trained() -> models.Trained:
        if not held:
            held.append((models.train_churn if kind == "churn" else models.train_clv)(metrics))
        return held[0]

    rows = store.get(f"{kind}_rows", metrics, lambda: trained().rows, MODEL_LIFETIME)
    model = store.get(f"{kind}_model", metrics, lambda: models.as_row(trained()), MODEL_LIFETIME)
    return models.from_row(model, rows)


def _churn_scores(s: Star) -> DataFrame:
    return models.churn_scores(_trained(s, "churn"))


@query
def churn_model_scores(s: Star) -> DataFrame:
    return _churn_scores(s)


@query
def churn_model_heldout(s: Star) -> DataFrame:
    """Who the model is judged on, and what became of them."""
    return _churn_scores(s).select("customer_unique_id", "actual_churned")


@query
def churn_model_margins(s: Star) -> DataFrame:
    """Held-out customers by actual label, summed from the four cells of the model's own matrix."""
    cells = models.confusion_matrix(
        _churn_scores(s), "actual_churned", "predicted_churned"
    )
    return cells.groupBy("actual").agg(F.sum("rows").alias("rows"), F.count("*").alias("cells"))


@query
def churn_model_quality(s: Star) -> DataFrame:
    """The model's own area under the curve, precision, recall, F1 and four cells."""
    return models.quality(_churn_scores(s))


@query
def churn_model_consistency(s: Star) -> DataFrame:
    """Stored churn scores read again: their number, and how many break what must hold of them."""
    path = tables.save_sorted(_churn_scores(s), _folder(s, "churn_scores"), "churn_probability")
    stored = s.spark.read.parquet(path)
    p = F.col("churn_probability")
    decided = F.abs(p - 0.5) > 0.0001  # probabilities are rounded, decisions are not
    counts = stored.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~p.between(0, 1) | p.isNull()).alias("outside"),
        F.count_if(decided & ((p > 0.5).cast("int") != F.col("predicted_churned"))).alias("undecided"),
    )
    return tables.with_order_breaks(counts, stored, "churn_probability")


@query
def clv_model_consistency(s: Star) -> DataFrame:
    """The same of the stored amounts; errors must be the differences they claim to be."""
    path = tables.save_sorted(models.clv_scores(_trained(s, "clv")), _folder(s, "clv_scores"), "predicted_revenue")
    stored = s.spark.read.parquet(path)
    gap = F.col("error") - (F.col("predicted_revenue") - F.col("actual_revenue"))
    counts = stored.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.abs(gap) > 0.0151).alias("wrong_errors")
    )
    return tables.with_order_breaks(counts, stored, "predicted_revenue")


@query
def model_importance_totals(s: Star) -> DataFrame:
    """Features of each model, and what their importances add up to."""
    found = [
        (kind, len(shares), round(sum(x for _, x in shares), 6), sum(x < 0 for _, x in shares))
        for kind in ("churn", "clv")
        for shares in [_trained(s, kind).model.importances()]
    ]
    return s.spark.createDataFrame(found, "model string, features int, total double, negative int")


@query
def churn_model_importances(s: Star) -> DataFrame:
    return models.top_importances(_trained(s, "churn"))


@query
def churn_feature_effects(s: Star) -> DataFrame:
    return models.feature_effects(_trained(s, "churn"))


@query
def churn_cross_validation(s: Star) -> DataFrame:
    return models.cross_validate(models.churn_rows(_metrics(s)))


@query
def churn_split_gains(s: Star) -> DataFrame:
    """What every cut of every feature would gain at the root of the churn model."""
    return models.churn_split_gains(_metrics(s))


@query
def rule_importance(s: Star) -> DataFrame:
    """Permutation importance of the parts of a fixed rule, judged by churn."""
    rows = _metrics(s).select(
        "customer_unique_id",
        "is_churned",
        *[F.col(c).cast("double").alias(c) for c in ("recency_days", "total_items", "total_revenue")],
    )
    return models.rule_importance(
        rows,
        ("recency_days", "total_items", "total_revenue"),
        "is_churned",
        lambda c: c("recency_days") - 10 * c("total_items") - F.floor(c("total_revenue") / 1000),
    )


@query
def clv_model_scores(s: Star) -> DataFrame:
    return models.clv_scores(_trained(s, "clv"))


@query
def clv_model_heldout(s: Star) -> DataFrame:
    """Who the amounts are judged on, and the actual ones: a random split."""
    scores = models.clv_scores(_trained(s, "clv"))
    return scores.select("customer_unique_id", "actual_revenue")


@query
def clv_model_report(s: Star) -> DataFrame:
    scores = models.clv_scores(_trained(s, "clv"))
    return models.regression_report(scores, "actual_revenue", "predicted_revenue")


@query
def clv_feature_effects(s: Star) -> DataFrame:
    return models.feature_effects(_trained(s, "clv"))
