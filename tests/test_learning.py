import random

from dataclasses import replace

import pytest
from helpers import rows
from pyspark.sql import functions as F

from cartwright.plans import features, models

KINDS = ", ".join(f"{c} double" for c in features.CHURN_FEATURES)


@pytest.fixture(scope="module")
def metrics(spark):
    """Customers of three states; churn follows from the number of orders."""
    rng = random.Random(11)
    out = []
    for i in range(240):
        orders = float(rng.randrange(1, 6))
        numbers = {c: rng.random() * 10 for c in features.CHURN_FEATURES}
        numbers["total_orders"], numbers["total_revenue"] = orders, orders * 20 + rng.random()
        if i % 10 == 0:
            numbers["orders_per_month"] = None
        out.append((f"u{i:03d}", *[numbers[c] for c in features.CHURN_FEATURES],
                    "ABC"[i % 3], int(orders == 1)))
    schema = f"customer_unique_id string, {KINDS}, customer_state string, is_churned int"
    return spark.createDataFrame(out, schema).cache()


def test_imputation_uses_the_exact_median(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (None,)], "a double")
    assert rows(features.impute_medians(df, ["a"])) == [(1.0,), (10.0,), (2.0,), (2.0,)]


def test_one_hot_drops_the_first_level(spark):
    df = spark.createDataFrame([(1, "B"), (2, "A"), (3, None), (4, "C")], "i int, customer_state string")
    values = features.levels(df)
    got = features.one_hot(df, values)
    assert got.columns == ["i", "customer_state_B", "customer_state_C"]
    assert rows(got) == [(1, 1.0, 0.0), (2, 0.0, 0.0), (3, 0.0, 0.0), (4, 0.0, 1.0)]


def test_split_and_folds_are_exact_per_label(metrics):
    marked = features.folds(features.split(metrics, "is_churned"), "is_churned").cache()
    for label, n in metrics.groupBy("is_churned").count().collect():
        part = marked.filter(F.col("is_churned") == label)
        assert part.filter("is_test").count() == int(n * 0.2 + 0.5)
        sizes = [r["count"] for r in part.groupBy("fold").count().collect()]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    again = features.split(metrics, "is_churned").filter("is_test")
    assert rows(again.select("customer_unique_id")) == rows(
        marked.filter("is_test").select("customer_unique_id")
    )
    assert features.split(metrics).filter("is_test").count() == 48


def test_summary_and_rates(metrics):
    got = {r["feature"]: r for r in features.numeric_summary(metrics, features.CHURN_FEATURES).collect()}
    want = metrics.toPandas().describe().round(2)
    for c in features.CHURN_FEATURES:
        assert got[c]["count"] == want[c]["count"]
        for ours, theirs in [("mean", "mean"), ("std", "std"), ("q25", "25%"), ("median", "50%"),
                             ("q75", "75%"), ("max", "max"), ("min", "min")]:
            assert got[c][ours] == pytest.approx(want[c][theirs], abs=0.011)
    rates = features.base_rates(features.split(metrics, "is_churned")).first()
    assert rates["overall"] == pytest.approx(rates["test"], abs=0.02)


def test_churn_model_separates_and_reports(metrics):
    trained = models.train_churn(metrics, replace(models.CHURN, trees=30))
    scores = models.churn_scores(trained).cache()
    assert scores.columns == ["customer_unique_id", "actual_churned", "predicted_churned",
                              "churn_probability"]
    assert models.roc_auc(scores, "actual_churned", "churn_probability").first()["auc"] == 1.0
    assert models.quality(scores).first()["auc"] == 1.0
    cells = {(r["actual"], r["predicted"]): r["rows"] for r in
             models.confusion_matrix(scores, "actual_churned", "predicted_churned").collect()}
    assert cells[0, 1] == cells[1, 0] == 0 and sum(cells.values()) == scores.count()
    report = models.classification_report(scores, "actual_churned", "predicted_churned").first()
    assert tuple(report) == (1.0, 1.0, 1.0)
    assert models.top_importances(trained, 3).first()["feature"] == "total_orders"
    effects = models.feature_effects(trained).collect()
    assert [e["feature"] for e in effects].count(features.CATEGORY) == 1
    assert len(effects) == len(features.CHURN_FEATURES) + 1
    assert effects[0]["feature"] == "total_orders" and effects[0]["direction"] < 0
    assert effects[0]["importance"] > 0.1 >= abs(effects[-1]["importance"])
    held = models.from_row(models.as_row(trained), trained.rows)
    assert rows(models.churn_scores(held)) == rows(scores)


def test_cross_validation(metrics):
    marked = models.churn_rows(metrics)
    got = models.cross_validate(marked, replace(models.CHURN, trees=20), 3).first()
    assert got["folds"] == 3 and got["auc_mean"] == 1.0 and got["auc_std"] == 0.0


def test_revenue_model(metrics):
    trained = models.train_clv(metrics, replace(models.CLV, trees=60))
    scores = models.clv_scores(trained).cache()
    assert scores.count() == 48
    one = scores.first()
    assert one["error"] == pytest.approx(one["predicted_revenue"] - one["actual_revenue"], abs=0.011)
    report = models.regression_report(scores, "actual_revenue", "predicted_revenue").first()
    assert report["r2"] > 0.5 and report["rmse"] >= report["mae"]


def test_reports_on_hand_made_scores(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 3.0)], "y double, p double")
    assert tuple(models.regression_report(df, "y", "p").first()) == (1.0, 1.29, 0.375)
    ranked = spark.createDataFrame([(1, 0.9), (0, 0.9), (0, 0.1), (1, 0.5)], "y int, s double")
    assert models.roc_auc(ranked, "y", "s").first()["auc"] == pytest.approx(0.625)
