"""Cleaning of raw text tables, the issue report, and declared-constraint checks.

Cleaning order: strip and null-token normalisation, exact-duplicate removal, rows without their
required columns, timestamps, numbers. Nothing is collected; the report is a frame too.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cartwright.functions.text import is_number, stripped, without_tokens
from cartwright.sources.schemas import ACCEPTED, NOT_NULL, RAW_TABLES, UNIQUE, RawTable

ISSUES = {
    "duplicate_rows_removed": "duplicate rows removed",
    "required_rows_dropped": "null required rows dropped",
    "blank_timestamps": "empty timestamps fixed",
    "invalid_numbers": "invalid numeric values",
}


def _normalise(raw: DataFrame, spec: RawTable) -> DataFrame:
    # two steps, so that each text is stripped once
    texts = raw.select(*[stripped(F.col(c)).alias(c) for c in spec.columns])
    return texts.select(*[without_tokens(F.col(c)).alias(c) for c in spec.columns])


def _complete(spec: RawTable) -> Column:
    present = [F.col(c).isNotNull() for c in spec.required]
    return reduce(lambda a, b: a & b, present, F.lit(True))


def _invalid(c: str) -> Column:
    """Of a normalised column."""
    return F.col(c).isNotNull() & ~is_number(F.col(c))


def clean(raw: DataFrame, table: str) -> DataFrame:
    """The cleaned table, still text: repeated rows collapse map-side before the one shuffle.

    Rows lacking a required column are filtered ahead of that shuffle; the result is the same.
    """
    spec = RAW_TABLES[table]
    rows = _normalise(raw, spec).filter(_complete(spec)).dropDuplicates()
    return rows.withColumns({c: F.when(~_invalid(c), F.col(c)) for c in spec.numbers})


def clean_all(raw: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    return {name: clean(df, name) for name, df in raw.items()}


def _judged(raw: DataFrame, spec: RawTable) -> DataFrame:
    """The distinct normalised rows without their invalid numbers, how many ``copies`` there are of
    each, whether it is ``kept``, and how many of its values are ``blank`` times and ``invalid`` numbers.

    Every number is looked at once: what follows, rows or counts, reads the marks.
    """
    marks = {c: f"__invalid_{c}" for c in spec.numbers}

    def number_of(tests: list[Column]) -> Column:
        return reduce(lambda a, b: a + b, [t.cast("int") for t in tests], F.lit(0))

    distinct = _normalise(raw, spec).groupBy(*spec.columns).agg(F.count("*").alias("copies"))
    marked = distinct.withColumns({mark: _invalid(c) for c, mark in marks.items()})
    return marked.select(
        *[F.when(~F.col(marks[c]), F.col(c)).alias(c) if c in marks else F.col(c) for c in spec.columns],
        "copies",
        _complete(spec).alias("kept"),
        number_of([F.col(c).isNull() for c in spec.timestamps]).alias("blank"),
        number_of([F.col(mark) for mark in marks.values()]).alias("invalid"),
    )


def _counts() -> dict[str, Column]:
    """Aggregates over judged rows: every line of the report."""

    def among_kept(hits: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kept"), F.col(hits))), F.lit(0)).cast("bigint")

    zero = F.lit(0)
    return {
        "rows_before": F.coalesce(F.sum("copies"), zero),
        "duplicate_rows_removed": F.coalesce(F.sum(F.col("copies") - 1), zero),
        "required_rows_dropped": F.count_if(~F.col("kept")),
        "blank_timestamps": among_kept("blank"),
        "invalid_numbers": among_kept("invalid"),
        "rows_after": F.count_if("kept"),
    }


LABELS = {"rows_before": "rows before", **ISSUES, "rows_after": "rows after"}


def quality_report(raw: DataFrame, table: str) -> DataFrame:
    """Rows before and after cleaning and one count per kind of issue, in one pass.

    Grouping by the whole row gives the copies of each, so every count comes from one shuffle.
    """
    spec = RAW_TABLES[table]
    counts = _judged(raw, spec).agg(*[c.alias(name) for name, c in _counts().items()])
    lines = F.array(
        *[
            F.struct(F.lit(text).alias("measure"), F.col(c).cast("bigint").alias("count"))
            for c, text in LABELS.items()
        ]
    )
    return counts.select(F.lit(table).alias("table"), F.inline(lines))


def clean_and_report(
    raw: Mapping[str, DataFrame], store: Callable[[DataFrame, str], object]
) -> DataFrame:
    """Clean every table, hand it to ``store(frame, name)``, which writes it, and report on all.

    The counts are observed while the rows are written, so each table is read and shuffled once for
    both. They are taken in the last stage, whose tasks count once however often they are retried.
    """
    lines = []
    for name, df in raw.items():
        spec = RAW_TABLES[name]
        seen = Observation(f"quality of {name}")
        judged = _judged(df, spec).observe(seen, *[c.alias(k) for k, c in _counts().items()])
        store(judged.filter("kept").select(*spec.columns), name)
        lines += [(name, text, int(seen.get[k])) for k, text in LABELS.items()]
    issues = sum(n for _, text, n in lines if text in ISSUES.values())
    lines.append(("all tables", "total issues fixed", issues))
    spark = next(iter(raw.values())).sparkSession
    return spark.createDataFrame(lines, "table string, measure string, count bigint")


def quality_reports(raw: Mapping[str, DataFrame]) -> DataFrame:
    """The reports of all tables, plus the total number of issues fixed, in the same pass."""
    reports = reduce(
        DataFrame.unionByName, [quality_report(df, name) for name, df in raw.items()]
    )
    own = F.struct("table", "measure")
    overall = F.struct(
        F.lit("all tables").alias("table"), F.lit("total issues fixed").alias("measure")
    )
    places = F.when(F.col("measure").isin(*ISSUES.values()), F.array(own, overall)).otherwise(
        F.array(own)
    )
    return (
        reports.select(F.explode(places).alias("place"), "count")
        .groupBy("place")
        .agg(F.sum("count").alias("count"))
        .select("place.table", "place.measure", "count")
    )


CHECKED_MODELS = tuple(dict.fromkeys([*UNIQUE, *NOT_NULL, *ACCEPTED]))


def checked_columns(model: str) -> list[str]:
    """The columns of a model that some check asks for."""
    return list(dict.fromkeys([*UNIQUE.get(model, ()), *NOT_NULL.get(model, ()), *ACCEPTED.get(model, {})]))


def unique_violations(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once, with how often."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.col(column))
        .agg(F.count("*").alias("n_records"))
        .filter(F.col("n_records") > 1)
    )


def _line(model: str, column: str, rule: str, failures: Column) -> Column:
    return F.struct(
        F.lit(model).alias("model"),
        F.lit(column).alias("column_name"),
        F.lit(rule).alias("rule"),
        failures.alias("failures"),
    )


def constraint_violations(staged: Mapping[str, DataFrame]) -> DataFrame:
    """One row per declared check: how many values or rows break it (0 = passed).

    Per frame, one pass answers all null and value checks, and one grouping per unique column;
    pass stored frames.
    """
    checks = []
    for model, columns in UNIQUE.items():
        for c in columns:
            bad = unique_violations(staged[model], c).agg(F.count("*").alias("n"))
            checks.append(bad.select(F.inline(F.array(_line(model, c, "unique", F.col("n"))))))
    for model in dict.fromkeys([*NOT_NULL, *ACCEPTED]):
        counts, lines = [], []
        for c in NOT_NULL.get(model, ()):
            counts.append(F.count_if(F.col(c).isNull()).alias(f"missing_{c}"))
            lines.append(_line(model, c, "not_null", F.col(f"missing_{c}")))
        for c, values in ACCEPTED.get(model, {}).items():
            other = F.when(~F.col(c).isin(*values), F.col(c))
            counts.append(F.countDistinct(other).alias(f"other_{c}"))
            lines.append(_line(model, c, "accepted_values", F.col(f"other_{c}")))
        checks.append(staged[model].agg(*counts).select(F.inline(F.array(*lines))))
    return reduce(DataFrame.unionByName, checks)
