from types import SimpleNamespace

import pytest
from helpers import rows

import catalogue
from cartwright.operators import quality
from cartwright.plans import insights, staging
from cartwright.session import materialize, shared_folder
from cartwright.sources import tables
from cartwright.sources.schemas import RAW_TABLES


def raw(spark, table, *records):
    return spark.createDataFrame(list(records), RAW_TABLES[table].schema)


def items(spark):
    return raw(
        spark, "order_items_dataset",
        ("o1", "1", "p", "s", "2018-01-01 00:00:00", "1.5", "2"),
        ("o1 ", "1", "p", "s", "2018-01-01 00:00:00", "1.5", " 2"),
        ("o2", "x", "p", "s", "", "abc", None),
        ("", "1", "p", "s", "None", "1", "1"),
        ("o3", "1", "p", "s", "NaT", "nan", "1"),
    )


def test_cleaning_order_and_counts(spark):
    report = {r["measure"]: r["count"] for r in
              quality.quality_report(items(spark), "order_items_dataset").collect()}
    assert report == {
        "rows before": 5, "duplicate rows removed": 1, "null required rows dropped": 2,
        "empty timestamps fixed": 1, "invalid numeric values": 2, "rows after": 2,
    }
    cleaned = quality.clean(items(spark), "order_items_dataset")
    assert rows(cleaned) == [
        ("o1", "1", "p", "s", "2018-01-01 00:00:00", "1.5", "2"),
        ("o2", None, "p", "s", None, None, None),
    ]


def test_report_total_adds_issues_only(spark):
    reports = quality.quality_reports({
        "order_items_dataset": items(spark),
        "sellers_dataset": raw(spark, "sellers_dataset", ("s", "1", "c", "S"), (None, "1", "c", "S")),
    })
    total = reports.filter("table = 'all tables'").collect()
    assert [(r["measure"], r["count"]) for r in total] == [("total issues fixed", 7)]


def test_constraints(spark):
    sellers = raw(spark, "sellers_dataset", ("s", "1", "c", "S"), ("s", "1", "d", "S"),
                  (None, "1", "c", "S"))
    orders = raw(spark, "orders_dataset",
                 ("o1", None, "delivered", "2018-01-01", "", "", "", ""),
                 ("o2", "c", "odd", "2018-01-01", "", "", "", ""),
                 ("o3", "c", "odd", "2018-01-01", "", "", "", ""))
    empty = {t: raw(spark, t) for t in RAW_TABLES}
    staged = staging.all_staged({**empty, "sellers_dataset": sellers, "orders_dataset": orders})
    got = {(r["model"], r["column_name"], r["rule"]): r["failures"]
           for r in quality.constraint_violations(staged).collect()}
    assert len(got) == 16
    failed = {k: v for k, v in got.items() if v}
    assert failed == {
        ("stg_sellers", "seller_id", "unique"): 1,
        ("stg_sellers", "seller_id", "not_null"): 1,
        ("stg_orders", "customer_id", "not_null"): 1,
        ("stg_orders", "status", "accepted_values"): 1,
    }


def test_csv_round_trip_with_quotes_and_nulls(spark, tmp_path):
    reviews = raw(spark, "order_reviews_dataset",
                  ("r1", "o1", "5", None, 'said "fine", then left', "2018-01-01 00:00:00", None))
    tables.land_csv(reviews, str(tmp_path), "order_reviews_dataset")
    assert rows(tables.read_raw(spark, str(tmp_path), "order_reviews_dataset")) == rows(reviews)


def test_reading_foreign_csv(spark, tmp_path):
    header = ",".join(RAW_TABLES["order_reviews_dataset"].columns)
    (tmp_path / "order_reviews_dataset.csv").write_text(
        f'{header}\nr1,o1,5,"","x ""q"" y",2018-01-01 00:00:00,\n'
    )
    got = tables.read_all_raw(spark, str(tmp_path))
    assert list(got) == ["order_reviews_dataset"]
    row = got["order_reviews_dataset"].first()
    assert row["review_comment_message"] == 'x "q" y'
    assert row["review_answer_timestamp"] is None
    with pytest.raises(FileNotFoundError):
        tables.read_all_raw(spark, str(tmp_path / "nowhere"))


def test_line_breaks_inside_quotes(spark, tmp_path):
    name = "order_reviews_dataset"
    reviews = raw(spark, name,
                  ("r1", "o1", "5", None, 'first line\nsecond "line"\n\nlast', "2018-01-01 00:00:00", None),
                  ("r2", "o2", "4", "t", "one line", "2018-01-01 00:00:00", None))
    tables.land_csv(reviews, str(tmp_path), name)
    assert rows(tables.read_all_raw(spark, str(tmp_path))[name]) == rows(reviews)
    for other in RAW_TABLES:
        if other != name:
            tables.land_csv(raw(spark, other), str(tmp_path), other)
    tables.register_raw(spark, str(tmp_path), "raw_breaks")
    assert rows(spark.table(f"raw_breaks.{name}")) == rows(reviews)
    assert quality.clean(spark.table(f"raw_breaks.{name}"), name).count() == 2


def test_only_finite_decimal_numbers_are_numbers(spark):
    name = "order_items_dataset"
    prices = ["12.5", " 7 ", "-3", "1e3", ".5", "12d", "12f", "NaN", "Infinity", "-inf", "0x10", "<NA>", "1e999"]
    items = raw(spark, name, *[(f"o{k}", "1", "p", "s", "2018-01-01 00:00:00", p, "1") for k, p in enumerate(prices)])
    cleaned = {r["order_id"]: r["price"] for r in quality.clean(items, name).collect()}
    numbers = {f"o{k}": p.strip() for k, p in enumerate(prices[:5])}
    # NaN and <NA> mean missing, so those rows lack a required column
    assert cleaned == numbers | {f"o{k}": None for k in (5, 6, 8, 9, 10, 12)}
    report = {r["measure"]: r["count"] for r in quality.quality_report(items, name).collect()}
    assert report["invalid numeric values"] == 6 and report["null required rows dropped"] == 2
    assert staging.order_items(quality.clean(items, name)).agg({"price": "sum"}).first()[0] is not None


def test_registration_marts_and_sql(spark, tmp_path):
    for name in RAW_TABLES:
        tables.land_csv(raw(spark, name), str(tmp_path), name)
    tables.land_csv(raw(spark, "sellers_dataset", ("s1", "1", "c", "S")), str(tmp_path),
                    "sellers_dataset")
    names = tables.register_raw(spark, str(tmp_path), "raw_test")
    assert len(names) == 9
    assert tables.register_raw(spark, str(tmp_path), "raw_test") == names
    assert spark.table("raw_test.sellers_dataset").count() == 1
    tables.publish_views({"stg_sellers_v": staging.sellers(spark.table("raw_test.sellers_dataset"))})
    mart = tables.save_mart(spark.table("stg_sellers_v"), "sellers_mart", "marts_test")
    assert rows(mart) == [("s1", "c", "S", "1")]
    bucketed = tables.save_mart(
        spark.table("stg_sellers_v"), "sellers_bucketed", "marts_test", 2, "seller_id"
    )
    assert bucketed.count() == 1
    assert tables.run_sql(spark, "select count(*) n from marts_test.sellers_mart").first()["n"] == 1
    shown, note = tables.try_sql(spark, "select id from range(1000)")
    assert note == "1000 rows" and shown.count() == 1000
    shown, note = tables.try_sql(spark, "select id from range(1000)", rows=20)
    assert note == "1000 rows" and shown.count() == 20
    nothing, note = tables.try_sql(spark, "selec nonsense")
    assert nothing is None and note.startswith("error:")
    nothing, note = tables.try_sql(spark, "select 1 / 0 as x")
    assert nothing is None and "DIVIDE_BY_ZERO" in note


class Session:
    """Stands in for a session with given settings."""

    def __init__(self, master, named=None, folder=None):
        self.master, self.named, self.folder = master, named, folder
        self.conf = self.sparkContext = self

    def get(self, key, default=None):
        assert key == "spark.checkpoint.dir"
        return self.named or default

    def getCheckpointDir(self):  # noqa: N802
        return self.folder

    def setCheckpointDir(self, folder):  # noqa: N802
        self.folder = folder


def test_shared_folder_is_the_one_the_cluster_names():
    assert shared_folder(Session("yarn", named="hdfs:/shared")) == "hdfs:/shared"
    assert shared_folder(Session("yarn", folder="hdfs:/set")) == "hdfs:/set"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session("yarn"))
    made = Session("local[4]")
    assert shared_folder(made) == made.folder and "cartwright-" in made.folder


def test_materialize_reads_back_what_it_wrote(spark):
    stored = materialize(spark.range(3), "three")
    assert rows(stored) == [(0,), (1,), (2,)]
    assert stored.inputFiles()


def test_embedding_store_and_retrieval(spark, tmp_path):
    documents = spark.createDataFrame(
        [("a", "alpha"), ("b", "beta"), ("c", "gamma"), ("d", "beta")], "id string, text string"
    )
    path = str(tmp_path / "store")
    built = []

    def build():
        built.append(1)
        return documents

    store = insights.stored_embeddings(spark, path, build)
    again = insights.stored_embeddings(spark, path, build)
    assert rows(store) == rows(again) and len(built) == 1
    asked = spark.createDataFrame([(1, "beta"), (2, "alpha")], "id long, text string")
    lists = insights.retrieve(insights.embedded(asked).cache(), store, 3)
    found = insights.matches(lists).cache()
    top = {(r["question_id"], r["place"]): (r["document_id"], r["similarity"])
           for r in found.collect()}
    assert top[1, 1] == ("b", 1.0) and top[1, 2] == ("d", 1.0) and top[2, 1] == ("a", 1.0)
    context = {r["question_id"]: r["context"] for r in insights.context(found, documents).collect()}
    assert context[1].startswith("beta\n\nbeta\n\n") and context[2].startswith("alpha\n\n")


def test_predictions_are_saved_sorted(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.1), ("b", 0.9)], "id string, p double")
    path = tables.save_sorted(df, str(tmp_path / "p"), "p", csv=True)
    assert [r["id"] for r in spark.read.csv(path, header=True).collect()] == ["b", "a"]
    path = tables.save_sorted(df, str(tmp_path / "q"), "p")
    assert spark.read.parquet(path).count() == 2


def test_copies_are_deleted_on_release(spark, tmp_path, monkeypatch):
    from cartwright import session

    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    monkeypatch.setattr(session, "_announced", set())
    assert session.materialize(spark.range(5), "copy").count() == 5
    folder = tmp_path / spark.sparkContext.applicationId
    assert len(list(folder.glob("copy-*"))) == 1
    session.release(spark)
    assert not folder.exists()


def test_cleaning_and_report_of_one_pass(spark):
    raw = items(spark)
    stored = {}

    def store(df, name):
        stored[name] = df.collect()

    both = {"order_items_dataset": raw}
    report = quality.clean_and_report(both, store)
    assert rows(report) == rows(quality.quality_reports(both))
    assert sorted(map(tuple, stored["order_items_dataset"]), key=repr) == rows(
        quality.clean(raw, "order_items_dataset")
    )
    empty = {"order_items_dataset": raw.limit(0)}
    assert rows(quality.clean_and_report(empty, store)) == rows(quality.quality_reports(empty))


def test_report_strips_and_tests_each_text_once(spark):
    plans = []

    def store(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        df.collect()

    quality.clean_and_report({"order_items_dataset": items(spark)}, store)
    columns, numbers = (len(getattr(RAW_TABLES["order_items_dataset"], k)) for k in ("columns", "numbers"))
    assert plans[0].count("trim(") == columns
    assert plans[0].lower().count("rlike") == 2 * numbers  # the plain form, and the general one for other texts
    observed = next(line for line in plans[0].splitlines() if "CollectMetrics" in line)
    assert "rlike" not in observed.lower() and "trim" not in observed


def test_only_checked_columns_are_stored(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(catalogue, "materialize", lambda df, name: kept.setdefault(name, df))
    star = SimpleNamespace(raw_tables={t: raw(spark, t) for t in RAW_TABLES})
    assert catalogue.constraint_violations(star).count() == 16
    assert kept["stg_orders"].columns == ["order_id", "customer_id", "status"]
    assert kept["stg_sellers"].columns == ["seller_id"]
