"""Boosted-tree churn classifier and lifetime-value regressor, scored and judged as frames."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwright.functions.arithmetic import ratio, rounded
from cartwright.operators import boosting, ordering
from cartwright.operators.boosting import Bins, Boosting, Forest
from cartwright.plans import features
from cartwright.session import materialize

# The settings of the two models.
CHURN = Boosting(trees=200, depth=4, positive_weight=2.0, classify=True)
CLV = Boosting(trees=300, depth=5)
ROOT_BINS = 16
KEY = "customer_unique_id"


@dataclass
class Trained:
    """A fitted model with its stored rows: features, target, weight, test mark."""

    model: Forest
    rows: DataFrame
    target: str

    @property
    def test(self) -> DataFrame:
        return self.rows.filter("is_test")


def as_row(trained: Trained) -> DataFrame:
    """The model as a table of one row."""
    spark = trained.rows.sparkSession
    return spark.createDataFrame([(trained.target, trained.model.to_json())], "target string, model string")


def from_row(model: DataFrame, rows: DataFrame) -> Trained:
    held = model.first()
    return Trained(Forest.from_json(held["model"]), rows, held["target"])


def _marked(frame: DataFrame, columns: tuple[str, ...], target: str, settings: Boosting) -> DataFrame:
    """Stored rows without missing numbers, with a class weight and the test mark."""
    whole = features.impute_medians(materialize(frame, "features"), columns)
    weight = F.when(F.col(target) == 1, settings.positive_weight).otherwise(1.0) if settings.classify else F.lit(1.0)
    label = target if settings.classify else None
    return materialize(features.split(whole.withColumn("weight", weight), label), "model_rows")


def _bins(rows: DataFrame, columns: tuple[str, ...], bins: int = boosting.BINS) -> Bins:
    return boosting.quantile_bins(rows, columns, features.CATEGORY, features.levels(rows), bins)


def churn_rows(metrics: DataFrame, settings: Boosting = CHURN) -> DataFrame:
    frame = features.churn_frame(metrics)
    return _marked(frame, features.CHURN_FEATURES, features.CHURN_TARGET, settings)


def train_churn(metrics: DataFrame, settings: Boosting = CHURN) -> Trained:
    rows = churn_rows(metrics, settings)
    known = rows.filter("not is_test")
    bins = _bins(known, features.CHURN_FEATURES)
    (model,) = boosting.fit(known, bins, features.CHURN_TARGET, settings, KEY, "weight")
    return Trained(model, rows, features.CHURN_TARGET)


def train_clv(metrics: DataFrame, settings: Boosting = CLV) -> Trained:
    rows = _marked(features.clv_frame(metrics), features.CLV_FEATURES, features.CLV_TARGET, settings)
    known = rows.filter("not is_test")
    (model,) = boosting.fit(known, _bins(known, features.CLV_FEATURES), features.CLV_TARGET, settings, KEY)
    return Trained(model, rows, features.CLV_TARGET)


def churn_split_gains(metrics: DataFrame, settings: Boosting = CHURN) -> DataFrame:
    """Gain of every feature and cut at the root of the churn model."""
    known = churn_rows(metrics, settings).filter("not is_test")
    bins = _bins(known, features.CHURN_FEATURES, ROOT_BINS)
    gains = boosting.root_gains(known, bins, features.CHURN_TARGET, settings, KEY, "weight")
    return gains.withColumn("gain", rounded(F.col("gain"), 3))


def churn_scores(trained: Trained) -> DataFrame:
    """Held-out customers, most likely to churn first."""
    scored = trained.test.withColumn("score", trained.model.score())
    return scored.select(
        KEY,
        F.col(trained.target).alias("actual_churned"),
        (F.col("score") > 0.5).cast("int").alias("predicted_churned"),
        rounded(F.col("score"), 4).alias("churn_probability"),
    ).orderBy(F.desc("churn_probability"), KEY)


def clv_scores(trained: Trained) -> DataFrame:
    actual, predicted = F.col(trained.target), F.col("score")
    scored = trained.test.withColumn("score", trained.model.score())
    return scored.select(
        KEY,
        rounded(actual, 2).alias("actual_revenue"),
        rounded(predicted, 2).alias("predicted_revenue"),
        rounded(predicted - actual, 2).alias("error"),
    ).orderBy(F.desc("predicted_revenue"), KEY)


def confusion_matrix(scores: DataFrame, actual: str, predicted: str) -> DataFrame:
    """All four cells, also the empty ones, from one pass."""
    cells = [
        F.struct(
            F.lit(a).alias("actual"),
            F.lit(p).alias("predicted"),
            F.count_if((F.col(actual) == a) & (F.col(predicted) == p)).alias("rows"),
        )
        for a in (0, 1)
        for p in (0, 1)
    ]
    return scores.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def classification_report(scores: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 of the positive class."""
    a, p = F.col(actual) == 1, F.col(predicted) == 1
    hits, claimed, real = F.count_if(a & p), F.count_if(p), F.count_if(a)
    return scores.agg(
        rounded(ratio(hits, claimed), 6).alias("precision"),
        rounded(ratio(hits, real), 6).alias("recall"),
        rounded(ratio(2 * hits, claimed + real), 6).alias("f1"),
    )


def quality(scores: DataFrame) -> DataFrame:
    """What a churn model is worth on the customers held out, in one row."""
    a, p = F.col("actual_churned") == 1, F.col("predicted_churned") == 1
    hits, claimed, real = F.count_if(a & p), F.count_if(p), F.count_if(a)
    counts = scores.agg(
        rounded(ratio(hits, claimed), 6).alias("precision"),
        rounded(ratio(hits, real), 6).alias("recall"),
        rounded(ratio(2 * hits, claimed + real), 6).alias("f1"),
        hits.alias("true_positives"),
        F.count_if(~a & p).alias("false_positives"),
        F.count_if(a & ~p).alias("false_negatives"),
        F.count_if(~a & ~p).alias("true_negatives"),
    )
    one = F.lit(1).alias("one")
    area = roc_auc(scores, "actual_churned", "churn_probability").select(one, "auc")
    return area.join(counts.select("*", one), "one").drop("one")


def roc_auc(scores: DataFrame, actual: str, score: str) -> DataFrame:
    """``auc``: the exact area under the ROC curve over all distinct scores, in one row."""
    area = ordering.roc_auc(scores, actual, score)
    return area.select(rounded(F.col("auc"), 6).alias("auc"))


def regression_report(scores: DataFrame, actual: str, predicted: str) -> DataFrame:
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    gap = p - a
    return scores.agg(
        rounded(F.avg(F.abs(gap)), 2).alias("mae"),
        rounded(F.sqrt(F.avg(gap * gap)), 2).alias("rmse"),
        rounded(1 - F.try_divide(F.avg(gap * gap), F.var_pop(a)), 4).alias("r2"),
    )


def cross_validate(rows: DataFrame, settings: Boosting = CHURN, n: int = 5) -> DataFrame:
    """``folds, auc_mean, auc_std`` over stratified folds, whose models are grown by the same jobs."""
    marked = materialize(features.folds(rows, features.CHURN_TARGET, n), "folds")
    bins = _bins(marked, features.CHURN_FEATURES)
    target = features.CHURN_TARGET
    models = boosting.fit(marked, bins, target, settings, KEY, "weight", "fold", range(n))
    scored = [
        marked.filter(F.col("fold") == k).select("fold", target, model.score().alias("score"))
        for k, model in enumerate(models)
    ]
    areas = ordering.roc_auc(reduce(DataFrame.unionByName, scored), target, "score", ["fold"])
    return areas.agg(
        F.lit(n).alias("folds"), F.avg("auc").alias("auc_mean"), F.stddev_pop("auc").alias("auc_std")
    )


def top_importances(trained: Trained, top: int = 15) -> DataFrame:
    """Mean gain per split of the features, the greatest first."""
    spark = trained.rows.sparkSession
    return (
        spark.createDataFrame(trained.model.importances(), "feature string, importance double")
        .orderBy(F.desc("importance"), "feature")
        .limit(top)
    )


def feature_effects(trained: Trained) -> DataFrame:
    """What each column is worth to the held-out scores, how much and which way it moves them."""
    model = trained.model
    worth = ordering.auc_worth if model.settings.classify else ordering.error_worth
    found = ordering.permutation_importance(
        trained.test, model.bins.inputs, trained.target, model.swapped, [KEY], worth
    )
    return found.orderBy(F.desc("importance"), "feature")


def rule_importance(rows: DataFrame, columns: tuple[str, ...], label: str, score) -> DataFrame:
    """The same for a fixed rule: ``score`` gives the score from a function of column names."""

    def scored(own: str, donor: str):
        sides = [lambda c: F.col(f"{own}.{c}")]
        for changed in columns:
            sides.append(lambda c, changed=changed: F.col(f"{donor if c == changed else own}.{c}"))
        return F.array(*[score(side) for side in sides])

    return ordering.permutation_importance(rows, columns, label, scored, [KEY], ordering.auc_worth)
