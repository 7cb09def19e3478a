import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartwright.llm import mixture
from cartwright.llm.mixture import Recipe


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutations(n):
    one = mixture.permuted(np.arange(n), n, (1, 2, 3))
    assert sorted(one.tolist()) == list(range(n))
    assert one.tolist() == mixture.permuted(np.arange(n), n, (1, 2, 3)).tolist()
    if n > 60:
        assert one.tolist() != mixture.permuted(np.arange(n), n, (1, 2, 4)).tolist()


def reshared(sizes, weights, repeats):
    """Targets by sharing the excess again and again."""
    capped, out = set(), [0.0] * len(sizes)
    while True:
        free = [k for k in range(len(sizes)) if k not in capped]
        left = sum(sizes) - sum(repeats * sizes[k] for k in capped)
        total = sum(weights[k] for k in free)
        for k in free:
            out[k] = left * weights[k] / total
        over = [k for k in free if out[k] > repeats * sizes[k]]
        if not over:
            return out
        for k in over:
            out[k] = float(repeats * sizes[k])
            capped.add(k)


def test_targets_equal_resharing():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(1, 9)
        sizes = [rng.choice([0, 1, 5, 100, 3000, 100000]) for _ in range(n)]
        weights = [k % 3 + 1 for k in range(n)]
        got = mixture.targets(sizes, weights, 3)
        assert got == pytest.approx(reshared(sizes, weights, 3))
        assert sum(got) == pytest.approx(sum(sizes))


def rows_of(seed, n=600):
    rng = random.Random(seed)
    sources = ["hot"] * 12 + ["b", "c", "d", None, "tiny"]
    rows = []
    for k in range(n):
        source = rng.choice(sources) if k else "tiny"
        words = rng.choice([0, 1, 7, 40, 300])
        rows.append((k, " ".join(f"{k}w{i}" for i in range(words)) if words else None, "en", source, 0))
    return rows


def test_mix_meets_its_targets(make):
    rows = rows_of(2)
    recipe = Recipe(block_words=16, shard_slots=64)
    docs = make(rows, extra=True).repartition(3)
    got = mixture.mix(docs, recipe).taken().collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    source = {r[0]: r[3] for r in rows}
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        assert 0 <= r.taken <= 3 * r.size
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = mixture.targets([sizes[s] for s in names], [k % 3 + 1 for k in range(len(names))], 3)
    for name, goal in zip(names, want, strict=True):
        assert target[name] == pytest.approx(goal)
        assert abs(taken[name] - goal) <= max(32, 0.02 * goal)
    assert all(r.source_size == sizes[source[r.doc_id]] for r in got)
    again = mixture.mix(docs.repartition(5), recipe).taken().collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_mixed_texts_are_the_words_taken(make):
    rows = rows_of(3, 200)
    recipe = Recipe(block_words=16, shard_slots=64)
    docs = make(rows, extra=True)
    mixed = mixture.mixed_documents(docs, recipe)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        found = r.text.split()
        assert found and all(w.startswith(f"{r.doc_id}w") for w in found)
        assert len(set(found)) == len(found)  # a pass takes no word twice
        words[r.doc_id] += len(found)
    want = {r.doc_id: r.taken for r in mixture.mix(docs, recipe).taken().collect() if r.taken}
    assert words == want


def test_shards_hold_their_slots(make):
    recipe = Recipe(block_words=16, shard_slots=64)
    plan = mixture.mix(make(rows_of(4)), recipe)
    found = plan.slots.collect()
    total = sum(s["slots"] for s in plan.sources)
    assert len(found) == total
    assert len({(r.number, r.slot) for r in found}) == total
    uses = Counter((r.number, r["pass"], r.block) for r in found)
    assert max(uses.values()) == 1  # a pass is a permutation
    assert max(Counter(r.shard for r in found if r.shard < total // 64).values()) <= 64


def test_awkward_rows(make, awkward):
    got = mixture.mix(make(awkward, extra=True)).taken().collect()
    assert len(got) == len(awkward)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append((r.size, r.taken))
    assert by_id[2] == [(0, 0)] and by_id[3] == [(0, 0)]
    assert [s for s, _ in by_id[6]] == [6, 6]
    assert mixture.mixed_documents(make(awkward, extra=True)).where(F.length("text") == 0).count() == 0


def test_blank_and_empty_tables(make):
    blank = make([(1, None, "en", "a", 0), (2, " ", "en", "b", 0)])
    assert sorted((r.doc_id, r.target, r.taken) for r in mixture.mix(blank).taken().collect()) == [(1, 0.0, 0), (2, 0.0, 0)]
    assert mixture.mixed_documents(blank).collect() == []
    assert mixture.mix(make([])).taken().collect() == []
    assert mixture.mixed_documents(make([])).collect() == []


def test_slots_are_dealt_out_to_many_tasks(spark, monkeypatch):
    """Groups of shards, and so the work of a task, are bounded by slots; draws don't depend on it."""
    sources = [
        {"source": s, "number": k, "rows": 1, "size": 128 * 40_000, "blocks": 40_000, "target": 0.0, "slots": 30_000 + 9000 * k}
        for k, s in enumerate("abc")
    ]
    recipe = mixture.Recipe()
    docs = spark.range(1)

    def drawn():
        counts = mixture.shard_counts(docs, sources, recipe)
        made = mixture.slots(counts, sources, recipe)
        return made.withColumn("task", F.spark_partition_id()).cache()

    whole = drawn()
    monkeypatch.setattr(mixture, "TASK_SLOTS", 1 << 13)
    monkeypatch.setattr(mixture, "GROUP_SLOTS", 1 << 11)
    parted = drawn()
    assert whole.count() == parted.count() == 3 * 39_000
    assert whole.drop("task").exceptAll(parted.drop("task")).count() == 0
    sizes = [r["count"] for r in parted.groupBy("task").count().collect()]
    assert len(sizes) > 8 and max(sizes) < 2 * sum(sizes) / len(sizes)
