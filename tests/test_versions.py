import pytest
from helpers import rows
from pyspark.sql import functions as F

from cartwright.plans import cohorts
from cartwright.sources.versions import VersionedTable


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "mart"))


def failing(spark):
    return spark.range(3).select(F.assert_true(F.col("id") < 2).alias("x"), F.lit(1).alias("id"))


def test_a_failed_write_leaves_the_old_version(spark, table):
    assert table.read() is None and table.versions() == []
    table.replace(spark.range(3))
    with pytest.raises(Exception, match="not true"):
        table.replace(failing(spark))
    assert rows(table.read()) == [(0,), (1,), (2,)]
    table.replace(spark.range(5))
    assert table.read().count() == 5


def test_readers_keep_what_they_began_with(spark, table):
    old = table.replace(spark.range(3))
    newer = table.replace(table.read().where("id > 0"))  # made from the one it replaces
    assert rows(old) == [(0,), (1,), (2,)] and rows(newer) == [(1,), (2,)]
    assert len(table.versions()) == 2
    table.replace(spark.range(1))
    assert rows(newer) == [(1,), (2,)] and len(table.versions()) == 2


def test_unfinished_and_old_versions_go(spark, table, tmp_path):
    with pytest.raises(Exception, match="not true"):
        table.replace(failing(spark))
    for n in (1, 2, 3):
        table.replace(spark.range(n))
    folders = [p.name for p in (tmp_path / "mart").iterdir() if p.is_dir()]
    assert sorted(folders) == sorted(table.versions()) and len(folders) == 2


def test_names_follow_the_newest_version(spark, table):
    table.replace(spark.range(3))
    table.publish("versions_test")
    assert spark.sql("select count(*) from versions_test").first()[0] == 3
    table.replace(spark.range(7))
    assert spark.sql("select count(*) from versions_test").first()[0] == 3
    table.publish("versions_test")
    assert spark.sql("select count(*) from versions_test").first()[0] == 7
    spark.sql("drop table versions_test")
    assert table.read().count() == 7
    assert table.read_or_build(lambda: spark.range(1)).count() == 7


def test_cohorts_by_bits_and_by_sets(spark, monkeypatch):
    """Months far apart need several words, very far ones sets; the cohorts are the same."""
    held = [(k % 40, f"{1990 + (k * 7) % 31}-{1 + k % 12:02d}-15") for k in range(400)] + [(None, "2001-01-01"), (3, None)]
    df = spark.createDataFrame(held, "customer_unique_id int, at string").select(
        "customer_unique_id", F.col("at").cast("timestamp_ntz").alias("purchased_at"), F.lit("delivered").alias("status")
    )
    bits = rows(cohorts.cohort_activity(df))
    assert cohorts.month_span(df) == (1990 * 12, 2020 * 12 + 11) or cohorts.month_span(df)[0] >= 1990 * 12
    want = {}
    months = {}
    for who, at in held:
        if who is not None and at is not None:
            months.setdefault(who, set()).add(int(at[:4]) * 12 + int(at[5:7]) - 1)
    for own in months.values():
        for m in own:
            want[min(own), m - min(own)] = want.get((min(own), m - min(own)), 0) + 1
    assert {(d.year * 12 + d.month - 1, p): n for d, p, n in bits} == want
    monkeypatch.setattr(cohorts, "MOST_WORDS", 1)
    assert rows(cohorts.cohort_activity(df)) == bits
    monkeypatch.undo()
    plan = cohorts.cohort_activity(df, (1990 * 12, 2021 * 12))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(customer_unique_id") == 1
    assert cohorts.cohort_activity(df.limit(0)).collect() == []
    assert cohorts.month_span(df.limit(0)) is None
