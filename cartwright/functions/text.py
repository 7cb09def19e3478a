"""Text clean-up, safe casts and display formatting as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters stripped from both ends, and texts that mean "missing".
WHITESPACE = " \t\n\r\f\v"
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null", "NaT",
)
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
PLAIN_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)\z"  # finite up to 300 characters


def stripped(c: Column) -> Column:
    """Most texts have nothing to strip, which their first and last characters tell at little cost."""
    padded = c < F.lit("!")  # a first character up to the blank, all whitespace among them
    for space in WHITESPACE:
        padded |= c.endswith(space)
    return F.when(padded, F.btrim(c, F.lit(WHITESPACE))).otherwise(c)


def without_tokens(s: Column) -> Column:
    """Stripped text, NULL for every missing-value token."""
    return F.when(~s.isin(*NULL_TOKENS), s)


def normalised(c: Column) -> Column:
    """Strip whitespace and turn every missing-value token into NULL."""
    return without_tokens(stripped(c))


def blank_to_null(c: Column) -> Column:
    return F.nullif(stripped(c), F.lit(""))


def as_timestamp(c: Column) -> Column:
    """Blank text is NULL; any other text must parse (raises under ANSI)."""
    return blank_to_null(c).cast("timestamp_ntz")


def as_money(c: Column) -> Column:
    return blank_to_null(c).cast("decimal(10,2)")


def as_int(c: Column) -> Column:
    return blank_to_null(c).cast("int")


def as_number(c: Column) -> Column:
    """Lenient numeric coercion: text that is no finite decimal number becomes NULL.

    Spark's own cast also takes type suffixes (``12d``), ``NaN`` and ``Infinity``.
    """
    s = stripped(c.cast("string"))
    return F.when(is_number(s), s.try_cast("double"))


def is_number(s: Column) -> Column:
    """Whether stripped text is a finite decimal number (NULL is none); most need one comparison."""
    plain = (F.octet_length(s) <= 300) & s.rlike(PLAIN_NUMBER)
    finite = s.rlike(NUMBER) & (F.abs(s.try_cast("double")) < F.lit(float("inf")))
    return F.when(plain, F.lit(True)).otherwise(F.coalesce(finite, F.lit(False)))


def title_label(c: Column) -> Column:
    """``bed_bath_table`` -> ``Bed Bath Table``."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def short_id(c: Column, length: int = 12, suffix: str = "...") -> Column:
    return F.concat(F.substring(c.cast("string"), 1, length), F.lit(suffix))


def money_label(c: Column, symbol: str = "$", digits: int = 0) -> Column:
    return F.concat(F.lit(symbol), F.format_number(c, digits))


def fixed_digits(c: Column, digits: int = 2) -> Column:
    """Plain decimal text with a fixed number of digits, no grouping."""
    return c.cast(f"decimal(38,{digits})").cast("string")


def comma_list(c: Column, first: int | None = None, empty: str | None = None) -> Column:
    """Join an array to ``a, b, c``; optionally only the first elements, or a word if empty."""
    text = F.array_join(c if first is None else F.slice(c, 1, first), ", ")
    return text if empty is None else F.coalesce(F.nullif(text, F.lit("")), F.lit(empty))
