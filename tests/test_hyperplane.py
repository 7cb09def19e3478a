import numpy as np
import pytest
from pyspark.sql import functions as F

from cartwright.operators import hyperplane
from cartwright.operators.hyperplane import Planes
from cartwright.session import materialize


def brute(held, k):
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in held if v and any(v)}
    return {
        i: [j for _, j in sorted((-np.rint(a @ b * 1e10) / 1e10, j) for j, b in unit.items() if j != i)[:k]]
        for i, a in unit.items()
    }


def table(spark, held):
    return spark.createDataFrame(held, "id int, vec array<double>")


def clustered(seed, n, groups, dimensions=24, noise=0.25):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dimensions))
    return [(i, (centres[i % groups] + noise * rng.standard_normal(dimensions)).tolist()) for i in range(n)]


def test_recall_and_exact_scores(spark):
    held = clustered(1, 3000, 100)
    planes = Planes(bucket=64)
    got = hyperplane.nearest_others(table(spark, held).repartition(4), 5, planes).collect()
    want, by_id = brute(held, 5), dict(held)
    hits = sum(r["neighbour"] in want[r["id"]] for r in got)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for r in got[:500]:
        a, b = np.array(by_id[r["id"]]), np.array(by_id[r["neighbour"]])
        assert r["similarity"] == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-9)
    places = {}
    for r in got:
        places.setdefault(r["id"], []).append((r["place"], -r["similarity"], r["neighbour"]))
    for listed in places.values():
        listed.sort()
        assert [p for p, _, _ in listed] == list(range(1, len(listed) + 1))
        assert [x[1:] for x in listed] == sorted(x[1:] for x in listed)


def test_few_vectors_copies_and_odd_ones(spark):
    """With few vectors every bucket is probed, so the result is that of comparing all."""
    held = clustered(2, 40, 4, 6)
    held += [(100 + k, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0]) for k in range(30)]  # copies
    held += [(200 + k, [2.0, 4.0, 0.0, 0.0, 0.0, 2.0]) for k in range(5)]  # the same direction
    odd = [(300, None), (301, [0.0] * 6), (302, [1.0]), (303, [float("nan")] * 6), (None, [1.0] * 6)]
    got = {}
    for r in hyperplane.nearest_others(table(spark, held + odd), 4).collect():
        got.setdefault(r["id"], []).append((r["place"], r["neighbour"]))
    assert {i: [j for _, j in sorted(x)] for i, x in got.items()} == brute(held, 4)
    assert hyperplane.nearest_others(table(spark, []), 3).collect() == []
    assert hyperplane.nearest_others(table(spark, held[:1]), 3).collect() == []


def test_large_buckets_are_cut(spark, monkeypatch):
    monkeypatch.setattr(hyperplane, "BLOCK_ROWS", 16)
    held = clustered(3, 300, 3, 8)
    got = hyperplane.nearest_others(table(spark, held), 3, Planes(bits=1, tables=2, probes=2))
    want = brute(held, 3)
    assert all(r["neighbour"] in want[r["id"]] for r in got.collect()) and got.count() == 900
    rows = table(spark, held)
    blocks = hyperplane._blocks(hyperplane._dealt(rows.repartition(12), Planes(bits=1), 8, False))
    sizes = blocks.select(F.size("item_ids").alias("n"))
    assert sizes.agg(F.sum("n")).first()[0] == 8 * 300
    assert sizes.agg(F.max("n")).first()[0] < 60


def test_probes_come_in_order_of_doubt():
    away = np.array([[0.5, -0.1, 2.0]])
    signature = np.array([0b101])
    seen = hyperplane.probed(signature, away, 5)[0].tolist()
    assert seen[0] == 0b101 and seen[1] == 0b111 and seen[2] == 0b100  # the nearest plane, the next
    assert len(set(seen)) == 5
    assert sorted(hyperplane.probed(signature, away, 99)[0].tolist()) == list(range(8))


def test_visits_are_not_sent_through_the_driver(spark):
    """A copy per probe makes them far larger than the vectors the planner measures them by."""
    heads = materialize(table(spark, clustered(4, 50, 5)), "heads")
    planes = Planes().with_bits(50)
    blocks = materialize(hyperplane._blocks(hyperplane._dealt(heads, planes, 24, False)), "blocks")
    near = hyperplane._compared(hyperplane._dealt(heads, planes, 24, True), blocks, 3)
    assert "BroadcastHashJoin" not in near._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["int", "string"])
def test_queries_are_not_copied_to_the_buckets(spark, monkeypatch, kind):
    """Chunks read the buckets one after the other; the result is that of the join."""
    held = clustered(5, 1500, 40)
    held += [(2000 + k, held[k][1]) for k in range(60)]  # copies
    rows = table(spark, held).withColumn("id", F.col("id").cast(kind)).repartition(3)
    planes = Planes(bucket=64)
    want = sorted(map(tuple, hyperplane.nearest_others(rows, 5, planes).collect()))
    stored, kept = hyperplane.materialize, {}
    monkeypatch.setattr(hyperplane, "materialize", lambda df, name: kept.setdefault(name, stored(df, name)))
    monkeypatch.setattr(hyperplane, "_dealt", lambda *a, f=hyperplane._dealt: f(*a) if not a[3] else pytest.fail("copied"))
    monkeypatch.setattr(hyperplane, "JOINED_ROWS", 0)
    monkeypatch.setattr(hyperplane, "PACK_BYTES", 20_000)
    got = sorted(map(tuple, hyperplane.nearest_others(rows, 5, planes).collect()))
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=1e-9)
    assert kept["plane_queries"].agg(F.sum(F.size("ids"))).first()[0] == 1500
