import math
import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from cartwright.operators import ordering


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_row_numbers(spark, many_ranges):
    rng = random.Random(1)
    keys = rng.sample(range(10_000), 400)
    df = spark.createDataFrame([(k, f"v{k}") for k in keys], "k int, v string")
    got = ordering.with_row_numbers(df, ["k"])
    assert {r["k"]: r["number"] for r in got.collect()} == {k: i for i, k in enumerate(sorted(keys))}
    assert ordering.with_row_numbers(df.limit(0), ["k"]).collect() == []


def test_running_totals_over_ranges_and_groups(spark, many_ranges):
    rng = random.Random(2)
    held = [(rng.choice(["x", "y", None]), k, rng.randrange(-5, 9)) for k in rng.sample(range(5000), 500)]
    df = spark.createDataFrame(held, "g string, k int, v bigint")
    got = ordering.with_running_totals(df, "k", {"before": "v"}, ["g"])
    want = [(g, k, sum(v for h, j, v in held if h == g and j < k)) for g, k, _ in held]
    assert rows(got.select("g", "k", "before")) == sorted(want, key=repr)
    whole = ordering.with_running_totals(df.drop("g"), "k", {"before": "v"})
    assert rows(whole.select("k", "before")) == sorted([(k, sum(v for _, j, v in held if j < k)) for _, k, _ in held], key=repr)


def area(pairs):
    pos, neg = [s for y, s in pairs if y == 1], [s for y, s in pairs if y == 0]
    if not pos or not neg:
        return None
    return sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))


def test_area_under_the_curve(spark, many_ranges):
    rng = random.Random(3)
    held = [(rng.choice("ab"), int(rng.random() < 0.4), rng.choice([0.5, rng.random()])) for _ in range(600)]
    held += [("c", 1, 0.3), (None, 1, 0.9), (None, 0, 0.1), ("a", None, 0.2), ("a", 1, None)]
    df = spark.createDataFrame(held, "g string, y int, s double")
    got = {r["g"]: r["auc"] for r in ordering.roc_auc(df, "y", "s", ["g"]).collect()}
    for g in ("a", "b", "c", None):
        want = area([(y, s) for h, y, s in held if h == g and y is not None and s is not None])
        assert got[g] == want if want is None else math.isclose(got[g], want, abs_tol=1e-12)
    assert ordering.roc_auc(df.limit(0), "y", "s").collect()[0]["auc"] is None


@pytest.mark.parametrize("n", [1, 2, 3, 10, 997, 1000])
def test_bijection(n):
    a, b = ordering.bijection(n, 42)
    assert sorted((a * i + b) % n for i in range(n)) == list(range(n))


def test_permutation_importance(spark, many_ranges):
    rng = random.Random(4)
    held = []
    for k in range(400):
        a, b, c = rng.random(), rng.random(), rng.choice("pq")
        held.append((k, a, b, c, int(a + 0.1 * rng.random() > 0.55)))
    df = spark.createDataFrame(held, "id int, a double, b double, c string, y int")

    def scored(own, donor):
        def score(a):
            return a * 2 + (F.col(f"{own}.c") == "p").cast("int") * 0

        return F.array(score(F.col(f"{own}.a")), score(F.col(f"{donor}.a")), score(F.col(f"{own}.a")), score(F.col(f"{own}.a")))

    found = ordering.permutation_importance(df, ["a", "b", "c"], "y", scored, ["id"], ordering.auc_worth)
    got = {r["feature"]: r for r in found.collect()}
    step, shift = ordering.bijection(400, 42)
    donor = {(step * i + shift) % 400: i for i in range(400)}
    base = area([(h[4], 2 * h[1]) for h in held])
    swapped = area([(h[4], 2 * held[donor[i]][1]) for i, h in enumerate(held)])
    assert got["a"]["importance"] == pytest.approx(base - swapped, abs=1e-6)
    assert got["a"]["importance"] > 0.3 and got["a"]["direction"] == 1.0
    assert got["b"]["importance"] == got["c"]["importance"] == got["b"]["mean_effect"] == 0.0
    plan = ordering.with_donors(ordering.with_row_numbers(df, ["id"]), ["a"], 400, 1)
    assert plan.count() == 400
