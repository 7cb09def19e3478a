import datetime as dt
import hashlib

import pytest
from helpers import rows
from pyspark.sql import functions as F

from cartwright.functions import dates, text
from cartwright.functions.embedding import hash_embedding


def one(spark, expr):
    return spark.range(1).select(expr).first()[0]


def moment(value):
    return F.lit(value).cast("timestamp_ntz")


@pytest.mark.parametrize(
    ("start", "end", "days"),
    [
        ("2018-01-01 23:00:00", "2018-01-03 01:00:00", 1),
        ("2018-01-03 01:00:00", "2018-01-01 23:00:00", -1),
        ("2018-01-01 00:00:00", "2018-01-02 00:00:00", 1),
        ("2018-01-01 00:00:00", "2018-01-01 23:59:59", 0),
        ("2018-01-01 00:00:00", "2020-01-01 00:00:00", 730),
    ],
)
def test_elapsed_days_are_whole_24_hour_units(spark, start, end, days):
    assert one(spark, dates.elapsed_days(moment(start), moment(end))) == days


def test_elapsed_days_ignore_daylight_saving_of_the_session(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        got = one(
            spark, dates.elapsed_days(moment("2018-03-24 12:00:00"), moment("2018-03-26 12:00:00"))
        )
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == 2


@pytest.mark.parametrize(("day", "number"), [("2018-01-01", 1), ("2018-01-07", 7)])
def test_iso_weekday(spark, day, number):
    assert one(spark, dates.iso_weekday(moment(day))) == number


def test_month_arithmetic_and_labels(spark):
    a, b = moment("2017-11-30"), moment("2018-02-01")
    assert one(spark, dates.months_apart(a, b)) == 3
    assert one(spark, dates.month_start(a)) == dt.date(2017, 11, 1)
    assert one(spark, dates.month_label(dates.month_start(b))) == "2018-02"
    assert one(spark, dates.period_label(F.lit(2018), F.lit(2))) == "2018-02"


@pytest.mark.parametrize(
    ("raw", "want"),
    [(" None ", None), ("nan", None), ("", None), (" \t", None), ("a ", "a"), ("\nb c\v", "b c"),
     (None, None), ("N/A", None), ("Nan", "Nan")],
)
def test_normalised(spark, raw, want):
    assert one(spark, text.normalised(F.lit(raw).cast("string"))) == want


def test_stripping_and_numbers_take_every_text_as_before(spark):
    texts = ["", " ", "a", " a", "a\t", "\fa b\v", "\u00a0a\u00a0", "é\n", "\x01a", "\x1fa ", "!a", "\u2028a \u2028", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    plain = F.btrim("t", F.lit(text.WHITESPACE))
    assert [r[0] for r in df.select(text.stripped(F.col("t"))).collect()] == [r[0] for r in df.select(plain).collect()]
    numbers = {
        "1": 1.0, "+.5": 0.5, "-1.": -1.0, " 7\n": 7.0, "1e3": 1000.0, "9" * 300: float("9" * 300), "9" * 400: None,
        "0" * 400 + "1": 1.0, "1e999": None, "12\u2028": None, "12\u0085": None, ".": None, "-": None, "12d": None,
        "NaN": None, "Infinity": None, "0x10": None, "1 2": None, "١": None, "": None, None: None,
    }
    df = spark.createDataFrame([(t,) for t in numbers], "t string").coalesce(1)
    assert [r[0] for r in df.select(text.as_number(F.col("t"))).collect()] == list(numbers.values())


def test_casts_are_blank_safe_but_strict(spark):
    assert one(spark, text.as_timestamp(F.lit("  "))) is None
    assert one(spark, text.as_money(F.lit(""))) is None
    assert one(spark, text.as_int(F.lit(" 3 "))) == 3
    assert one(spark, text.as_number(F.lit("abc"))) is None
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        one(spark, text.as_int(F.lit("abc")))


def test_labels(spark):
    assert one(spark, text.title_label(F.lit("bed_bath_table"))) == "Bed Bath Table"
    assert one(spark, text.short_id(F.lit("00433698fcea99"), 12)) == "00433698fcea..."
    assert one(spark, text.money_label(F.lit(1234.4))) == "$1,234"
    names = F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d"))
    assert one(spark, text.comma_list(names, first=3)) == "a, b, c"
    assert one(spark, text.comma_list(F.array().cast("array<string>"), empty="none")) == "none"


def test_hash_embedding_equals_plain_digests(spark):
    texts = ["hi", "", "naïve café", "x" * 10_000]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "text string")
    got = {r[0]: r[1] for r in df.select("text", hash_embedding(F.col("text"))).collect()}
    assert got["hi"][:2] == [0.7856, 0.4886]
    assert got[None] is None
    for t in texts:
        want = [
            int(hashlib.md5(f"{t}{i}".encode()).hexdigest(), 16) % 10000 / 10000
            for i in range(64)
        ]
        assert list(got[t]) == want


def test_rows_helper_sorts(spark):
    assert rows(spark.createDataFrame([(2,), (1,)], "a int")) == [(1,), (2,)]
