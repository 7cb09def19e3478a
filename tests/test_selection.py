import random

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from cartwright.operators.selection import (
    exact_medians,
    exact_quantiles,
    select_ranks,
    with_ntiles,
)

relaxed = settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def built_in(df, tiles):
    up = Window.orderBy(F.asc_nulls_last("v"), "id", "city")
    down = Window.orderBy(F.desc_nulls_last("v"), "id", "city")
    return df.select("id", "city", F.ntile(tiles).over(up), F.ntile(tiles).over(down))


def distributed(df, tiles, sample):
    scored = with_ntiles(
        df, tiles, {"up": (F.col("v"), False), "down": (F.col("v"), True)}, ["id", "city"], sample
    )
    return scored.select("id", "city", "up", "down")


def frame(spark, values):
    data = [(i % max(1, len(values) - 2), f"c{i}", v) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "id long, city string, v long")


@relaxed
@given(st.lists(st.one_of(st.none(), st.integers(-3, 3)), min_size=1, max_size=40),
       st.sampled_from([4, 1000]))
def test_ntiles_equal_the_window_function(spark, values, sample):
    df = frame(spark, values).cache()
    a = sorted(map(tuple, built_in(df, 5).collect()))
    b = sorted(map(tuple, distributed(df, 5, sample).collect()))
    assert a == b


def test_ntiles_with_heavy_ties_need_several_narrowing_rounds(spark):
    rng = random.Random(5)
    values = [1] * 1500 + [rng.randrange(1000) for _ in range(1500)] + [None] * 200
    rng.shuffle(values)
    df = frame(spark, values).cache()
    a = sorted(map(tuple, built_in(df, 5).collect()))
    b = sorted(map(tuple, distributed(df, 5, 60).collect()))
    assert a == b


def test_ntiles_with_fewer_rows_than_tiles(spark):
    df = frame(spark, [30, 10, 20])
    assert sorted(r["up"] for r in distributed(df, 5, 100).collect()) == [1, 2, 3]


def test_select_ranks_finds_keys_of_any_type(spark):
    df = spark.createDataFrame([(f"k{i:03d}",) for i in range(200)], "k string").cache()
    assert select_ranks(df, [F.col("k")], [[1, 57, 200]], [200], sample=20) == [
        ["k000", "k056", "k199"]
    ]


@pytest.mark.parametrize("sample", [25, 10_000])
def test_quantiles_interpolate_like_a_sorted_column(spark, sample):
    rng = random.Random(1)
    data = [
        (float(rng.randrange(50)), rng.gauss(0, 9), None if i % 3 else rng.random())
        for i in range(501)
    ]
    df = spark.createDataFrame(data, "a double, b double, c double").cache()
    got = exact_quantiles(df, ["a", "b", "c"], [0.25, 0.5, 0.75], sample)
    want = pd.DataFrame(data, columns=["a", "b", "c"]).quantile([0.25, 0.5, 0.75])
    for c in "abc":
        assert got[c] == pytest.approx(list(want[c]))


def test_median_of_an_empty_column_is_none(spark):
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    assert exact_medians(df, ["a", "b"]) == {"a": None, "b": 1.0}
