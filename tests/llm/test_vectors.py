import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartwright.llm.projection_forest import Plan, neighbours

COLUMNS = "vec_id bigint, embedding array<float>, label int"


def brute(rows, k, step=20):
    """Best lists by comparing everything; rows of one id are one row."""
    good = {}
    for i, v, *_ in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        good.setdefault(i, set()).add(tuple(np.float32(x) for x in v))
    flat = [(i, np.array(v, float)) for i, vs in good.items() for v in vs]
    out = {}
    for q, x in flat:
        if q % step == 0:
            scored = sorted((-float(x @ y), i) for i, y in flat if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def found(df):
    lists = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        lists.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return lists


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], COLUMNS)


def unit(x):
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize("clustered", [True, False])
def test_recall_against_brute_force(spark, clustered):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2500, 24))
    if clustered:
        x = rng.standard_normal((40, 24))[rng.integers(0, 40, 2500)] + 0.2 * x
    rows = [(k, v.tolist()) for k, v in enumerate(unit(x))]
    got = found(neighbours(table(spark, rows), F.col("id") % 20 == 0, 20, plan=Plan(leaf=64)))
    want = brute(rows, 20)
    assert set(got) == set(want)
    hits = 0
    for q, best in want.items():
        assert len(got[q]) == 20
        hits += len({i for i, _ in got[q]} & {i for i, _ in best})
        exact = dict(got[q])
        assert all(exact[i] == pytest.approx(s, abs=1e-12) for i, s in best if i in exact)
        assert got[q] == sorted(got[q], key=lambda p: (-p[1], p[0]))
    assert hits / (20 * len(want)) >= 0.9


def test_lengths_differ(spark):
    rng = np.random.default_rng(2)
    x = (rng.standard_normal((600, 8)) * rng.uniform(0.1, 5, (600, 1))).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    got = found(neighbours(table(spark, rows), F.col("id") % 20 == 0, 10, plan=Plan(leaf=32)))
    want = brute(rows, 10)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in best}) for q, best in want.items())
    assert hits / (10 * len(want)) >= 0.9


def test_copies_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    hot = [1.0, 0.0, 0.0, 0.0]
    rows = [(k, hot) for k in range(200)]  # a third of all rows
    rows += [(1000 + k, v.tolist()) for k, v in enumerate(rng.standard_normal((300, 4)).astype(np.float32))]
    rows += [(0, hot), (20, hot)]  # repeated rows
    rows += [(5000, None), (5020, []), (5040, [0.0] * 4), (5060, [1.0, None, 0.0, 0.0]),
             (5080, [float("nan"), 0.0, 0.0, 1.0]), (5100, [float("inf"), 0.0, 0.0, 1.0]),
             (None, hot), (5120, [-0.0, 1.0, 0.0, 0.0])]
    got = found(neighbours(table(spark, rows), F.col("id") % 20 == 0, 20))
    want = brute(rows, 20)
    assert set(got) == set(want)
    for q, best in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in best]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in best], abs=1e-9)


def test_few_rows(spark):
    rows = [(0, [1.0, 2.0]), (20, [2.0, 1.0]), (3, [1.0, 1.0])]
    assert found(neighbours(table(spark, rows), F.col("id") % 20 == 0, 20)) == {
        0: [(20, 4.0), (3, 3.0)], 20: [(0, 4.0), (3, 3.0)],
    }
    alone = neighbours(table(spark, rows[:1]), F.col("id") % 20 == 0, 20)
    assert alone.collect() == []
    assert neighbours(table(spark, []), F.col("id") % 20 == 0, 20).collect() == []
    assert neighbours(table(spark, [(0, None)]), F.col("id") % 20 == 0, 20).collect() == []


def test_busy_leaves_are_shared_out(spark):
    rng = np.random.default_rng(4)
    rows = [(k * 20, v.tolist()) for k, v in enumerate(unit(rng.standard_normal((300, 6))))]
    plan = Plan(leaf=16, most_visits=20, most_items=8)
    got = found(neighbours(table(spark, rows), F.col("id") % 20 == 0, 5, plan=plan))
    want = brute(rows, 5)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in best}) for q, best in want.items())
    assert set(got) == set(want) and hits / (5 * len(want)) >= 0.9
