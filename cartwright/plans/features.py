"""Feature frames for the churn and lifetime-value models, their splits and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwright.functions.arithmetic import rounded
from cartwright.operators.selection import exact_medians, exact_quantiles
from cartwright.session import materialize

# Feature lists and targets of the two models.
CHURN_FEATURES = (
    "recency_days",
    "total_orders",
    "total_items",
    "total_revenue",
    "avg_order_value",
    "max_order_value",
    "orders_per_month",
    "avg_review_score",
    "positive_review_rate",
    "avg_delivery_days",
    "on_time_rate",
    "recency_score",
    "frequency_score",
    "monetary_score",
)
CHURN_TARGET = "is_churned"
CLV_FEATURES = (
    "recency_days",
    "total_orders",
    "total_items",
    "avg_order_value",
    "orders_per_month",
    "avg_review_score",
    "positive_review_rate",
    "avg_delivery_days",
    "on_time_rate",
    "recency_score",
    "frequency_score",
)
CLV_TARGET = "total_revenue"
CATEGORY = "customer_state"
SEED = 42
TEST_SHARE = 0.2
DRAW_BUCKETS = 4096  # three hexadecimal digits of a draw


def churn_frame(metrics: DataFrame) -> DataFrame:
    return _numeric(metrics, CHURN_FEATURES, F.col(CHURN_TARGET).cast("int"))


def clv_frame(metrics: DataFrame) -> DataFrame:
    """Only customers with positive revenue."""
    paying = metrics.filter(F.col(CLV_TARGET) > 0)
    return _numeric(paying, CLV_FEATURES, F.col(CLV_TARGET).try_cast("double").alias(CLV_TARGET))


def _numeric(metrics: DataFrame, features: Sequence[str], target: Column) -> DataFrame:
    """Projection by list; anything that is no number becomes NULL."""
    numbers = [F.col(c).try_cast("double").alias(c) for c in features]
    return metrics.select("customer_unique_id", *numbers, CATEGORY, target)


def impute_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULLs become the column's exact median. ``df`` is scanned twice; pass a stored frame."""
    medians = {c: m for c, m in exact_medians(df, columns).items() if m is not None}
    return df.na.fill(medians)


def levels(df: DataFrame, column: str = CATEGORY) -> list[str]:
    """Distinct values, alphabetical: the columns of the wide indicator form."""
    found = df.select(column).filter(F.col(column).isNotNull()).distinct()
    return sorted(row[0] for row in found.collect())


def one_hot(df: DataFrame, values: Sequence[str], column: str = CATEGORY) -> DataFrame:
    """0/1 columns for every value but the first; the original column is dropped."""
    flags = {
        f"{column}_{v}": F.coalesce((F.col(column) == F.lit(v)).cast("double"), F.lit(0.0))
        for v in values[1:]
    }
    return df.withColumns(flags).drop(column)


def matrix_cells(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``customer_unique_id, feature, value`` of every value that is not 0: numbers with medians for
    the missing ones, and a 1 for the customer's category unless it is the alphabetically first.

    The sparse form of the feature matrix; its columns stay three however many categories there are.
    """
    whole = impute_medians(frame, columns)
    first = frame.agg(F.min(CATEGORY)).first()[0]
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in columns]
    named = F.when(
        F.col(CATEGORY) != F.lit(first), F.concat(F.lit(f"{CATEGORY}_"), F.col(CATEGORY))
    )
    cells.append(F.struct(named.alias("feature"), F.lit(1.0).alias("value")))
    spread = whole.select("customer_unique_id", F.inline(F.array(*cells)))
    return spread.filter(F.col("feature").isNotNull() & (F.col("value") != 0))


def _draw(seed: int) -> Column:
    """A fixed pseudo-random text per customer."""
    return F.md5(F.concat(F.col("customer_unique_id").cast("string"), F.lit(f"#{seed}")))


def _with_cuts(
    df: DataFrame, label: str | None, shares: Sequence[float], seed: int
) -> DataFrame:
    """Add ``__cuts``: for the row's label value the draws at the given shares of its rows (NULL
    where a share comes to no row).

    Draws are counted by their first digits within each label value, map-side first; only the
    bucket that holds a cut is ranked. Any number of label values will do, NULL is one of them.
    """
    stratum = F.lit(0) if label is None else F.col(label)
    drawn = df.select(
        F.struct(stratum.alias("value")).alias("stratum"), _draw(seed).alias("draw")
    ).withColumn("bucket", F.conv(F.substring("draw", 1, 3), 16, 10).cast("int"))
    counts = drawn.groupBy("stratum", "bucket").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("stratum")
    upto = whole.orderBy("bucket")
    placed = counts.select(
        "stratum", "bucket", "n",
        F.sum("n").over(upto).alias("last"),
        F.sum("n").over(whole).alias("size"),
    )
    ranks = F.array(
        *[
            F.struct(F.lit(k).alias("k"), F.floor(F.col("size") * s + 0.5).alias("rank"))
            for k, s in enumerate(shares)
        ]
    )
    wanted = (
        placed.select("stratum", "bucket", "n", "last", F.inline(ranks))
        .filter((F.col("rank") >= 1) & (F.col("rank") <= F.col("last")))
        .filter(F.col("rank") > F.col("last") - F.col("n"))
        .select("stratum", "bucket", "k", (F.col("rank") - F.col("last") + F.col("n")).alias("place"))
    )
    buckets = wanted.groupBy("stratum", "bucket").agg(
        F.collect_list(F.struct("k", "place")).alias("places")
    )
    inside = Window.partitionBy("stratum", "bucket").orderBy("draw")
    cuts = (
        drawn.join(buckets, ["stratum", "bucket"])
        .withColumn("at", F.row_number().over(inside))
        .select("stratum", "draw", "at", F.explode("places").alias("p"))
        .filter(F.col("at") == F.col("p.place"))
        .groupBy("stratum")
        .agg(F.map_from_entries(F.collect_list(F.struct("p.k", "draw"))).alias("found"))
        .select("stratum", F.array(*[F.col("found")[k] for k in range(len(shares))]).alias("__cuts"))
        .withColumnRenamed("stratum", "__stratum")
    )
    own = F.struct(stratum.alias("value"))
    return df.join(cuts, own == F.col("__stratum"), "left").drop("__stratum")


def split(
    df: DataFrame, label: str | None = None, share: float = TEST_SHARE, seed: int = SEED
) -> DataFrame:
    """Add ``is_test`` for a fixed ``share`` of the rows, per label value if one is given.

    Rows of one customer stay on one side. A row is a test row when its draw is not above the
    exact order statistic of its stratum, the same on every run.
    """
    marked = _with_cuts(df, label, [share], seed)
    is_test = F.coalesce(_draw(seed) <= F.col("__cuts")[0], F.lit(False))
    return marked.withColumn("is_test", is_test).drop("__cuts")


def folds(df: DataFrame, label: str, n: int = 5, seed: int = SEED) -> DataFrame:
    """Add ``fold`` (0 ... n-1), equally filled within every label value."""
    marked = _with_cuts(df, label, [k / n for k in range(1, n)], seed)
    above = F.filter("__cuts", lambda cut: _draw(seed) > cut)
    return marked.withColumn("fold", F.coalesce(F.size(above), F.lit(0))).drop("__cuts")


def numeric_summary(df: DataFrame, columns: Sequence[str], digits: int = 2) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles per column, one row each."""
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    measures = []
    for c in columns:
        low, middle, high = (F.lit(q).cast("double") for q in quartiles[c])
        measures.append(
            F.struct(
                F.lit(c).alias("feature"),
                F.count(c).alias("count"),
                rounded(F.avg(c), digits).alias("mean"),
                rounded(F.stddev_samp(c), digits).alias("std"),
                rounded(F.min(c), digits).alias("min"),
                rounded(low, digits).alias("q25"),
                rounded(middle, digits).alias("median"),
                rounded(high, digits).alias("q75"),
                rounded(F.max(c), digits).alias("max"),
            )
        )
    return df.agg(F.array(*measures).alias("rows")).select(F.inline("rows"))


def revenue_stats(clv: DataFrame) -> DataFrame:
    median = exact_medians(clv, [CLV_TARGET])[CLV_TARGET]
    return clv.agg(
        rounded(F.avg(CLV_TARGET), 2).alias("mean_revenue"),
        rounded(F.lit(median).cast("double"), 2).alias("median_revenue"),
        rounded(F.max(CLV_TARGET), 2).alias("max_revenue"),
    )


def base_rates(marked: DataFrame, label: str = CHURN_TARGET) -> DataFrame:
    """Share of positives overall and on each side of the split, in one pass."""

    def rate(side: Column) -> Column:
        return rounded(F.avg(F.when(side, F.col(label))), 6)

    return marked.agg(
        rate(F.lit(True)).alias("overall"),
        rate(~F.col("is_test")).alias("train"),
        rate(F.col("is_test")).alias("test"),
        F.count_if("is_test").alias("test_rows"),
    )
