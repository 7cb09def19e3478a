"""Row numbers and running totals over a whole table, without one task that sees all of it.

The table is dealt out by ranges of its order and stored, so every range is sorted where it lies.
What stands before a range is the sum of the ranges before it: one small row per range (and group),
added up and joined back. Only those rows meet; the rows of the table stay in their ranges.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwright.functions.arithmetic import rounded
from cartwright.session import materialize

RANGE = "__range"


def _ranged(df: DataFrame, order: Sequence[Column], label: str) -> DataFrame:
    """The stored table with the number of each row's range. Equal keys share a range."""
    dealt = df.repartitionByRange(*order)
    return materialize(dealt.withColumn(RANGE, F.spark_partition_id()), label)


def with_row_numbers(df: DataFrame, order: Sequence[str], name: str = "number") -> DataFrame:
    """Adds ``name``: the row's place in the order, from 0; rows of equal keys in any order."""
    ranged = _ranged(df, [F.col(c) for c in order], "ranged")
    sizes = ranged.groupBy(RANGE).agg(F.count(F.lit(1)).alias("__size"))
    earlier = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(RANGE, F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy(RANGE).orderBy(*order)) - 1
    numbered = ranged.withColumn("__place", within).join(F.broadcast(starts), RANGE)
    return numbered.withColumn(name, F.col("__start") + F.col("__place")).drop(RANGE, "__start", "__place")


def with_running_totals(
    df: DataFrame, order: str, totals: dict[str, str], groups: Sequence[str] = ()
) -> DataFrame:
    """Adds, for each ``new: column`` of ``totals``, the sum of the column over all rows of the
    group before the row. Rows of equal order get different sums, so add them up beforehand."""
    ranged = _ranged(df, [F.col(c) for c in [*groups, order]], "ranged")
    keys = [RANGE, *groups]
    sums = ranged.groupBy(*keys).agg(*[F.sum(c).alias(f"__{new}") for new, c in totals.items()])
    # one row per range and group
    by_range = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    earlier = by_range.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(
        *keys, *[F.coalesce(F.sum(f"__{new}").over(earlier), F.lit(0)).alias(f"__{new}") for new in totals]
    )
    inside = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumns(
        {new: F.coalesce(F.sum(c).over(inside), F.lit(0)) for new, c in totals.items()}
    )
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    joined = local.alias("l").join(before.alias("b"), same)
    kept = [F.col(f"l.{c}") for c in df.columns if c not in totals]
    return joined.select(*kept, *[(F.col(f"l.{new}") + F.col(f"b.__{new}")).alias(new) for new in totals])


def roc_auc(scores: DataFrame, label: str, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """``auc`` per group: the exact area under the ROC curve by rank sums, NULL without both labels.

    Rows of equal score are one tie group, counted map-side, so only distinct scores are ordered.
    Rows with a missing label or score are left out. All sums are whole numbers; one division.
    """
    positive = F.col(label) == 1
    ties = (
        scores.where(F.col(label).isNotNull() & F.col(score).isNotNull())
        .groupBy(*groups, F.col(score).cast("double").alias("__score"))
        .agg(F.count_if(positive).alias("__pos"), F.count_if(~positive).alias("__neg"))
    )
    placed = with_running_totals(ties, "__score", {"__below": "__neg"}, groups)
    wide = "decimal(38,0)"
    # twice the number of pairs in the right order, ties counting half
    won = F.sum(F.col("__pos").cast("decimal(18,0)") * (2 * F.col("__below") + F.col("__neg")).cast("decimal(19,0)"))
    pairs = 2 * F.sum("__pos").cast("decimal(18,0)") * F.sum("__neg").cast("decimal(18,0)")
    area = F.try_divide(won.cast(wide).cast("double"), pairs.cast(wide).cast("double"))
    return placed.groupBy(*groups).agg(area.alias("auc"))


# ---- permuting one column by a bijection on row numbers ------------------------------------------


def bijection(n: int, key: int) -> tuple[int, int]:
    """``(a, b)`` such that number -> (a * number + b) mod n is a bijection on 0 ... n - 1.

    ``a`` is the first number from the golden section of n on that shares no factor with it, which
    parts neighbours widely; the key shifts.
    """
    a = math.floor(n * 0.6180339887) + 1
    while math.gcd(a, n) != 1:
        a += 1
    return a, key % n if n else 0


def with_donors(numbered: DataFrame, columns: Sequence[str], n: int, key: int) -> DataFrame:
    """Adds ``donor``, a struct of the columns of the row that the bijection sends to this one.

    One join by row number, whatever the number of columns; nothing else moves.
    """
    a, b = bijection(n, key)
    place = ((F.col("number").cast("decimal(19,0)") * a + b) % n).cast("bigint")
    donors = numbered.select(place.alias("number"), F.struct(*columns).alias("donor"))
    return numbered.join(donors, "number")


def permutation_importance(
    rows: DataFrame,
    features: Sequence[str],
    label: str,
    scored: Callable[[str, str], Column],
    order: Sequence[str],
    worth: Callable[[DataFrame], DataFrame],
    key: int = 42,
) -> DataFrame:
    """``feature, importance, mean_effect, direction`` of every feature.

    ``importance`` is what the scores lose in worth when the feature alone takes the values of other
    rows, ``mean_effect`` the mean size of the change of score, ``direction`` the correlation of the
    change of value with it (0 for what is no number). ``scored(own, donor)`` gives, as one array
    column, the score of the row and that with each feature in turn taken from the donor; both
    arguments name structs of the features, so a row travels with two values per feature.
    ``worth`` turns ``feature, label, score`` into ``feature, worth``; the scores nothing was changed
    for have no feature.
    """
    numbered = with_row_numbers(rows.select(*dict.fromkeys([*order, *features, label])), order)
    numbered = materialize(numbered, "numbered")
    met = with_donors(numbered, features, max(1, numbered.count()), key).select(
        F.col(label).alias("label"), F.struct(*features).alias("own"), "donor"
    )
    scores = met.withColumn("scores", scored("own", "donor"))

    def entry(name: Column, at: int, moved: Column) -> Column:
        score = F.col("scores")[at]
        change = (score - F.col("scores")[0]).alias("change")
        return F.struct(name.alias("feature"), score.alias("score"), change, moved.alias("moved"))

    def number(side: str, feature: str) -> Column:
        return F.col(f"{side}.{feature}").try_cast("double")

    entries = [entry(F.lit(None).cast("string"), 0, F.lit(0.0))]
    for k, f in enumerate(features):
        entries.append(entry(F.lit(f), k + 1, number("donor", f) - number("own", f)))
    tried = materialize(scores.select("label", F.inline(F.array(*entries))), "tried")
    found = materialize(worth(tried), "worth")  # a row per feature
    base = found.where("feature is null").first()
    spread = F.stddev_pop("moved") * F.stddev_pop("change")
    effects = (
        tried.where("feature is not null")
        .groupBy("feature")
        .agg(
            F.avg(F.abs("change")).alias("size"),
            F.coalesce(F.try_divide(F.covar_pop("moved", "change"), spread), F.lit(0.0)).alias("direction"),
        )
    )
    return found.join(effects, "feature").select(
        "feature",
        rounded(F.lit(base["worth"] if base else None).cast("double") - F.col("worth"), 6).alias("importance"),
        rounded(F.col("size"), 6).alias("mean_effect"),
        rounded(F.col("direction"), 4).alias("direction"),
    )


def auc_worth(tried: DataFrame) -> DataFrame:
    return roc_auc(tried, "label", "score", ["feature"]).withColumnRenamed("auc", "worth")


def error_worth(tried: DataFrame) -> DataFrame:
    """The smaller the root of the mean squared error, the more worth."""
    gap = F.col("score") - F.col("label")
    return tried.groupBy("feature").agg((-F.sqrt(F.avg(gap * gap))).alias("worth"))
