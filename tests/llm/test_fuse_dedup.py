import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartwright.llm.fuse_dedup import (
    FuseFilter,
    _snapshot,
    deduplicated,
    screened,
    take_in,
)

BLANK = str.maketrans("", "", " \t\n\x0b\x0c\r")


def brute(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault((text or "").translate(BLANK), []).append((i, len(text or "")))
    out = []
    for body, members in groups.items():
        order = sorted(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))
        keep = order[0][0]
        name = hashlib.sha256(body.encode()).digest()
        out += [(i, keep, len(members), at == 0, name) for at, (i, _) in enumerate(order)]
    return sorted(out, key=repr)


def found(df):
    assert df.columns == ["doc_id", "keep_id", "group_size", "kept", "digest"]
    return sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in df.collect()), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(["ab", "a b", "abc", "é ", " "]) for _ in range(rng.randrange(4))) for _ in range(60)]
    rows = [(rng.randrange(90), rng.choice(texts)) for _ in range(250)]
    rows += [(1000 + i, "one hot  text") for i in range(120)] + [(None, "onehottext")] * 3
    return rows + [(3, None), (4, ""), (5, " \n\t"), (None, None), (6, "x" * 200_000), (7, "x " * 200_000)]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 1000, 70_000])
def test_filter_holds_its_keys_and_few_others(n):
    rng = np.random.default_rng(n)
    keys, others = (rng.integers(-(2**63), 2**63 - 1, size) for size in (n, 40_000))
    made = FuseFilter.from_bytes(FuseFilter.build(np.concatenate([keys, keys[: n // 2]])).to_bytes())
    assert made.holds(keys).all()
    assert made.holds(others).mean() < 0.006
    if n > 50_000:
        assert 8 * len(made.slots) / n < 10


@pytest.mark.parametrize("deliveries", [1, 2, 4])
def test_equals_brute_force(spark, deliveries):
    rows = corpus(deliveries)
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id bigint, text string, digest string")
    assert found(deduplicated(docs.repartition(3), deliveries=deliveries)) == brute(rows)


@pytest.mark.parametrize("deliveries", [1, 3])
def test_bytes_decide_where_digests_collide(spark, deliveries):
    rows = corpus(9)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")

    def weak(data):
        return hashlib.sha256(data).digest()[:1]

    got = found(deduplicated(docs, deliveries=deliveries, digest=weak))
    assert sorted([r[:4] for r in got], key=repr) == sorted([r[:4] for r in brute(rows)], key=repr)


def test_awkward_rows_and_no_rows(make, awkward):
    docs = make(awkward, extra=True)
    assert found(deduplicated(docs)) == brute([(r[0], r[1]) for r in awkward])
    assert deduplicated(make([])).collect() == []


def _rows(spark, texts):
    rows = [(k, k, len(t), hashlib.sha256(t.encode()).digest(), t.encode()) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "row bigint, doc_id bigint, length bigint, digest binary, body binary").cache()


def test_snapshots_screen_what_they_lack(spark):
    """Hardly any digest that a snapshot lacks gets to its exact buckets, none it holds is missed,
    and taking in a delivery leaves it as it was."""
    first = _rows(spark, [f"text {k}" for k in range(3000)])
    groups, snapshot = take_in(first, [])
    assert groups.count() == 3000 and snapshot.groups.count() == 3000
    second = _rows(spark, [f"text {k}" for k in range(2900, 9000)])
    asked = second.select("digest")
    passed = {bytes(r[0]) for r in screened(asked, snapshot).collect()}
    known = {hashlib.sha256(f"text {k}".encode()).digest() for k in range(2900, 3000)}
    assert known <= passed
    assert len(passed) - len(known) < 0.01 * 6000
    _, newer = take_in(second.withColumn("row", F.col("row") + 10_000), [snapshot])
    assert newer.groups.count() == 6000
    assert snapshot.groups.count() == 3000


def test_buckets_without_a_filter_pass_nothing(spark):
    few = _rows(spark, ["a"])
    groups, _ = take_in(few, [])
    snapshot = _snapshot(few, groups)
    emptied = type(snapshot)(few, groups, snapshot.filters.limit(0), 8)
    assert screened(few.select("digest"), emptied).collect() == []
