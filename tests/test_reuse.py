import pathlib

import pytest

from cartwright.sources.reuse import Store


@pytest.fixture
def store(spark, tmp_path):
    clock = [1000.0]
    held = Store(spark, str(tmp_path / "reused"), lambda: clock[0])
    held.clock = clock
    return held


@pytest.fixture
def source(spark, tmp_path):
    path = str(tmp_path / "table")
    spark.range(5).write.parquet(path)
    return path


def test_results_are_reused_until_they_expire(spark, store, source):
    built = []

    def build():
        built.append(1)
        return spark.read.parquet(source).selectExpr("sum(id) as total")

    def get(lifetime=60.0):
        return store.get("total", spark.read.parquet(source), build, lifetime).first()["total"]

    assert [get(), get()] == [10, 10] and len(built) == 1
    store.clock[0] += 59
    assert get() == 10 and len(built) == 1
    store.clock[0] += 1
    assert get() == 10 and len(built) == 2
    assert len(store.entries()) == 1


def test_changed_inputs_and_plans_make_other_entries(spark, store, source):
    def total(rows):
        return store.get("total", rows, lambda: rows.selectExpr("sum(id) as t")).first()["t"]

    assert total(spark.read.parquet(source)) == 10
    assert total(spark.read.parquet(source).where("id > 2")) == 7
    spark.range(5, 7).write.mode("append").parquet(source)
    assert total(spark.read.parquet(source)) == 21  # not the old result
    before = len(store.entries())
    (part,) = [p for p in pathlib.Path(source).glob("*.parquet")][:1]
    spark.range(100, 101).write.mode("overwrite").parquet(source)
    assert total(spark.read.parquet(source)) == 100
    assert len(store.entries()) == before + 1
    assert part.name


def test_sweep_and_release(spark, store, source):
    for label, lifetime in (("short", 10.0), ("long", 1000.0)):
        store.get(label, spark.read.parquet(source), lambda: spark.range(1), lifetime)
    store.clock[0] += 20
    (gone,) = store.sweep()
    assert gone.startswith("short-") and len(store.entries()) == 1
    store.release()
    assert store.entries() == {} and store.sweep() == []


def test_an_unfinished_entry_is_not_used(spark, store, source):
    def fails():
        return spark.range(3).selectExpr("assert_true(id < 2) as x")

    rows = spark.read.parquet(source)
    with pytest.raises(Exception, match="not true"):
        store.get("x", rows, fails)
    assert store.entries() == {}
    assert store.get("x", rows, lambda: spark.range(3)).count() == 3
