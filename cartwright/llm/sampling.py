"""Bounded, repeatable samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SPAN = float(1 << 32)


def share(key: str | Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone."""
    column = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(1 << 32)) / _SPAN


#: Labels that a sample is drawn for, those of the most distinct keys.
LABELS = 1000


def bounded(rows: DataFrame, label: str, key: str, each: int, seed: int = 1) -> DataFrame:
    """Of every value of ``label`` the ``each`` distinct keys of the smallest hashes, one row each.

    Rows of equal label and key collapse where they lie, and no task hands on more than ``each``
    rows of a label.
    """
    order = Window.partitionBy(label).orderBy("__draw", key)
    once = rows.withColumn("__draw", F.xxhash64(F.col(key), F.lit(seed))).dropDuplicates([label, "__draw"])
    placed = once.withColumn("__place", F.row_number().over(order))
    return placed.where(F.col("__place") <= each).drop("__draw", "__place")


def about(rows: DataFrame, label: str, key: str, each: int, seed: int = 1) -> DataFrame:
    """``each`` rows of distinct ``key`` for every value of ``label`` (all, if it has fewer), chosen
    by a hash of the key alone: never more, whatever ids or texts repeat.

    One sketch of the distinct keys per label decides a rate, with room to spare, at which rows are
    filtered where they lie; the choice is made among what is left. Rows without a label are left
    out, and labels beyond the ``LABELS`` most frequent ones.
    """
    known = rows.where(F.col(label).isNotNull())
    counts = (
        known.groupBy(label)
        .agg(F.approx_count_distinct(F.xxhash64(key)).alias("n"))
        .orderBy(F.desc("n"), label)
        .limit(LABELS)
        .collect()
    )
    rate = F.lit(0.0)
    for value, n in counts:
        rate = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, (1.5 * each + 50) / max(n, 1)))).otherwise(rate)
    drawn = known.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed + 1)), F.lit(1 << 32)) / _SPAN < rate)
    return bounded(drawn, label, key, each, seed)
