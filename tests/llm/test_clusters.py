import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartwright.llm.bisector_clusters import (
    Bisectors,
    Clustering,
    _limbs,
    _number,
    cluster,
    with_inertia,
)

COLUMNS = "vec_id bigint, embedding array<double>, cluster string, distance int, key string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 0, "y") for i, v in rows], COLUMNS)


def brute(rows, plan):
    """The definition, row by row, in Python integers."""
    kept = []
    for i, v in rows:
        if v is None or len(v) != plan.dimensions or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, tuple(math.floor(plan.scale * x) for x in v)))

    def drawn(row):
        name = "" if row[0] is None else str(row[0])
        return hashlib.sha256(f"{plan.seed}:{name}".encode()).hexdigest(), row[1]

    centroids = [v for _, v in sorted(kept, key=drawn)[: plan.centroids]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))

    for _ in range(plan.rounds):
        own = {}
        for _, v in kept:
            own.setdefault(nearest(v)[1], []).append(v)
        centroids = [
            tuple(sum(x) // len(own[k]) for x in zip(*own[k])) if k in own else c
            for k, c in enumerate(centroids)
        ]
    out = [(i, *reversed(nearest(v))) for i, v in kept]
    sums = {}
    for _, c, d in out:
        sums[c] = sums.get(c, 0) + d
    named = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    whole = sum(sums.values())
    return [(i, c, d, sums[c], whole, named[c]) for i, c, d in out]


def held(number):
    return number if number is not None and number < 1 << 63 else None


def found(spark, rows, plan):
    df = with_inertia(*cluster(table(spark, rows), plan=plan))
    assert df.columns == ["key", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_definition(spark, seed):
    rng = random.Random(seed)
    plan = Clustering(centroids=5, rounds=3, dimensions=3, scale=4)
    rows = [(rng.randrange(200), [rng.gauss(0, 1) for _ in range(3)]) for _ in range(150)]
    rows += [(7, [0.5, 0.5, 0.5])] * 60 + [(None, [0.5, 0.25, 0.5])] * 3  # one hot vector
    rows += [(8, None), (9, []), (10, [1.0, 2.0]), (11, [1.0, None, 2.0]), (12, [1.0, float("nan"), 2.0]),
             (13, [1.0, float("-inf"), 2.0])]
    assert found(spark, rows, plan) == sorted(brute(rows, plan), key=repr)


def test_ties_favour_the_smaller_number():
    planes = Bisectors([(0, 0), (4, 0), (0, 4), (0, 0)])
    winner, distance = planes.nearest(np.array([[2, 0], [2, 2], [0, 0], [0, 4], [3, 0]]))
    assert winner.tolist() == [0, 0, 0, 2, 1]
    assert distance.tolist() == [4, 8, 0, 0, 1]


@pytest.mark.parametrize("k", [1, 2, 16])
def test_tournament_finds_the_nearest(k):
    rng = np.random.default_rng(k)
    centroids = [tuple(map(int, c)) for c in rng.integers(-9, 9, (k, 4))]
    vectors = rng.integers(-12, 12, (2000, 4))
    gaps = ((vectors[:, None, :] - np.array(centroids)[None]) ** 2).sum(axis=2)
    winner, distance = Bisectors(centroids).nearest(vectors)
    assert winner.tolist() == gaps.argmin(axis=1).tolist()
    assert distance.tolist() == gaps.min(axis=1).tolist()


def test_numbers_of_any_size(spark):
    for number in (0, 1, -1, 1 << 31, -(1 << 31), -(1 << 31) - 1, (1 << 200) + 5, -(1 << 200) - 5):
        assert _number(list(_limbs(number))) == number
    plan = Clustering(centroids=2, rounds=2, dimensions=2, scale=64)
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 5.0]), (3, [1e8, -1e8]), (4, [0.25, 1.0]), (5, [1e6, 3.5])]
    want = [(i, c, held(d), None if any(held(e[2]) is None for e in brute(rows, plan) if e[1] == c) else held(s), None, h)
            for i, c, d, s, _, h in brute(rows, plan)]
    assert found(spark, rows, plan) == sorted(want, key=repr)


def test_few_and_no_vectors(spark):
    plan = Clustering(centroids=16, dimensions=2)
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0])]
    assert found(spark, rows, plan) == sorted(brute(rows, plan), key=repr)
    for none in ([], [(1, None), (2, [1.0])]):
        df = with_inertia(*cluster(table(spark, none), plan=plan))
        assert df.collect() == []
        assert df.schema["cluster"].dataType.simpleString() == "int"
        assert df.schema["inertia"].dataType.simpleString() == "bigint"


def test_work_of_a_round_stays_in_its_tasks(spark):
    """What rounds bring together is a few numbers per centroid; no vector is shuffled."""
    rows = [(i, [float(i % 7), float(i % 3)]) for i in range(300)]
    df, _ = cluster(table(spark, rows).repartition(4), plan=Clustering(centroids=3, dimensions=2))
    assert df.where(F.col("distance").isNull()).count() == 0
    assert "Exchange" not in df._jdf.queryExecution().toString()
