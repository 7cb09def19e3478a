"""Cohort retention: customers by month of first delivered order, tracked month by month."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartwright.functions.arithmetic import rounded
from cartwright.functions.dates import month_label, month_number, month_of


WORD = 62  # months of one whole number
MOST_WORDS = 32  # beyond some 165 years of months, sets of them instead of bits


def cohort_activity(facts: DataFrame, span: tuple[int, int] | None = None) -> DataFrame:
    """Active customers per (cohort month, months since).

    The months a customer ordered in are bits of a few whole numbers, put together map-side, so a
    customer is one row in the only shuffle of customers, however many orders there are. First
    month and periods are read from the bits. ``span`` gives the first and last month number that
    may occur (see :func:`month_span`); without it the facts are asked first. Orders without a
    known customer belong to no cohort.
    """
    months = facts.filter((F.col("status") == "delivered") & F.col("customer_unique_id").isNotNull()).select(
        "customer_unique_id", month_number(F.col("purchased_at")).alias("month")
    )
    months = months.filter(F.col("month").isNotNull())
    low, high = span or months.agg(F.min("month"), F.max("month")).first()
    low, high = low or 0, high or 0
    words = (high - low) // WORD + 1
    places = _month_bits(months, low, words) if words <= MOST_WORDS else _month_sets(months, low)
    first = F.array_min("places")
    return (
        places.select(first.alias("first"), F.explode(F.transform("places", lambda p: p - first)).alias("period"))
        .groupBy("first", "period")
        .agg(F.count("*").alias("customers"))
        .select(month_of(F.col("first") + F.lit(low)).alias("cohort_month"), "period", "customers")
    )


def month_span(orders: DataFrame) -> tuple[int, int] | None:
    """First and last month number of the orders, from one column alone; None without orders."""
    month = month_number(F.col("purchased_at"))
    found = orders.agg(F.min(month), F.max(month)).first()
    return None if found[0] is None else tuple(found)


def _month_bits(months: DataFrame, low: int, words: int) -> DataFrame:
    """``places``: the months of each customer, counted from ``low``, by bits."""
    at = F.col("month") - F.lit(low)
    placed = months.select(
        "customer_unique_id",
        F.floor(at / WORD).cast("int").alias("word"),
        F.expr(f"shiftleft(1L, cast(pmod(month - {low}, {WORD}) as int))").alias("bit"),
    )
    merged = placed.groupBy("customer_unique_id").agg(
        *[F.coalesce(F.bit_or(F.when(F.col("word") == w, F.col("bit"))), F.lit(0)).alias(f"w{w}") for w in range(words)]
    )
    held = [
        F.expr(f"transform(filter(sequence(0, {WORD - 1}), i -> getbit(w{w}, i) = 1), i -> i + {w * WORD})")
        for w in range(words)
    ]
    return merged.select(F.concat(*held).alias("places"))


def _month_sets(months: DataFrame, low: int) -> DataFrame:
    """The same by sets of months, for dates that lie very far apart."""
    return months.groupBy("customer_unique_id").agg(
        F.sort_array(F.collect_set(F.col("month") - F.lit(low))).alias("places")
    )


def retention(activity: DataFrame) -> DataFrame:
    """Each period as a percentage of the cohort's size (its period 0)."""
    size = F.max(F.when(F.col("period") == 0, F.col("customers"))).over(
        Window.partitionBy("cohort_month")
    )
    share = rounded(F.col("customers") / size, 4) * 100
    return activity.select(
        "cohort_month",
        month_label(F.col("cohort_month")).alias("cohort"),
        "period",
        rounded(share, 2).alias("retention_pct"),
    )


def periods_of(rates: DataFrame) -> list[int]:
    """The periods that occur in any cohort, ascending: at most one per month the data spans."""
    return sorted(r[0] for r in rates.select("period").distinct().collect())


def retention_matrix(
    rates: DataFrame, periods: Sequence[int] | None = None, values: str = "retention_pct"
) -> DataFrame:
    """Wide form: one row per cohort, a column ``m<period>`` for each period; absent cells are NULL.

    Without ``periods`` those that occur are looked up first, so pass a stored frame then.
    """
    periods = periods_of(rates) if periods is None else list(periods)
    wide = rates.groupBy("cohort_month").pivot("period", periods).agg(F.first(values))
    return wide.withColumnsRenamed({str(p): f"m{p}" for p in periods})


def matrix_cells(rates: DataFrame, values: str = "retention_pct") -> DataFrame:
    """The same matrix with fixed columns, one row per cell, empty ones too.

    ``place`` is the number of the matrix column, ``period`` its heading.
    """
    periods = periods_of(rates)
    wide = retention_matrix(rates, periods, values)
    cells = [
        F.struct(
            F.lit(at).alias("place"), F.lit(p).alias("period"), F.col(f"m{p}").alias(values)
        )
        for at, p in enumerate(periods)
    ]
    if not cells:  # no cohort at all
        return rates.select("cohort_month", F.lit(0).alias("place"), "period", values)
    return wide.select("cohort_month", F.inline(F.array(*cells)))


def retention_insight(rates: DataFrame) -> DataFrame:
    """Mean retention after one and three months over cohorts that have the month; best cohort.

    Ties for the best cohort go to the earliest.
    """
    after = {p: F.when(F.col("period") == p, F.col("retention_pct")) for p in (1, 3)}
    best = F.min_by("cohort", F.when(F.col("period") == 1, F.struct(-F.col("retention_pct"), "cohort")))
    return rates.agg(
        rounded(F.coalesce(F.avg(after[1]), F.lit(0.0)), 1).alias("avg_month_1"),
        rounded(F.coalesce(F.avg(after[3]), F.lit(0.0)), 1).alias("avg_month_3"),
        F.coalesce(best, F.lit("N/A")).alias("best_cohort"),
    )
