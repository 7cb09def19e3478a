"""Second-order trees against a plain implementation, and their independence of the partitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartwright.operators import boosting
from cartwright.operators.boosting import Bins, Boosting, Forest


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    n = 600
    x = np.round(rng.normal(size=(n, 3)), 1)
    state = rng.integers(0, 4, n)
    noise = rng.normal(size=n) * 0.2
    y = (x[:, 0] + (state == 2) * 1.5 + noise > 0.5).astype(int)
    amount = np.round(10 * x[:, 1] + 5 * (state == 3) + noise, 3)
    held = [
        (k, *map(float, x[k]), f"s{state[k]}", int(y[k]), float(amount[k]), 1.0 + int(y[k]), k % 3)
        for k in range(n)
    ]
    kinds = "id int, a double, b double, c double, state string, y int, amount double, w double, fold int"
    return spark.createDataFrame(held, kinds).cache()


BINS = Bins(("a", "b", "c"), ((-1.0, 0.0, 0.5, 1.0), (-0.5, 0.2), (0.0,)), "state", ("s0", "s1", "s2", "s3"))


def flags(rows):
    """Features as numbers: the three, then indicators of all values but the first."""
    return [[r["a"], r["b"], r["c"], *[float(r["state"] == v) for v in ("s1", "s2", "s3")]] for r in rows]


def plain_trees(x, y, w, settings):
    """Depth-first greedy trees on the same cuts, all rows and features, in plain floats."""
    cuts = [*BINS.cuts, (0.0,), (0.0,), (0.0,)]
    base = np.average(y, weights=w)
    score = np.full(len(y), np.log(base / (1 - base)) if settings.classify else base)

    def leaf(g, h):
        return -g / (h + 1) * settings.step

    for _ in range(settings.trees):
        if settings.classify:
            p = 1 / (1 + np.exp(-score))
            g, h = w * (p - y), w * p * (1 - p)
        else:
            g, h = w * (score - y), w.copy()

        def grow(own, depth):
            total = leaf(g[own].sum(), h[own].sum())
            best = (1e-9, None, None)
            if depth:
                for f, options in enumerate(cuts):
                    for cut in options:
                        left, right = own & (x[:, f] <= cut), own & (x[:, f] > cut)
                        if min(h[left].sum(), h[right].sum()) < 1:
                            continue
                        gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, right))
                        gain -= g[own].sum() ** 2 / (h[own].sum() + 1)
                        if gain > best[0] + 1e-9:
                            best = (gain, left, right)
            if best[1] is None:
                score[own] += total
            else:
                grow(best[1], depth - 1)
                grow(best[2], depth - 1)

        grow(np.ones(len(y), bool), settings.depth)
    return 1 / (1 + np.exp(-score)) if settings.classify else score


@pytest.mark.parametrize("classify", [True, False])
def test_scores_are_those_of_plain_trees(table, classify):
    settings = Boosting(4, 3, 0.3, row_share=1.0, column_share=1.0, classify=classify)
    label, weight = ("y", "w") if classify else ("amount", None)
    (model,) = boosting.fit(table, BINS, label, settings, "id", weight)
    got = {r["id"]: r["p"] for r in table.select("id", model.score().alias("p")).collect()}
    rows = sorted(table.collect(), key=lambda r: r["id"])
    y = np.array([r[label] for r in rows], float)
    w = np.array([r["w"] for r in rows]) if classify else np.ones(len(rows))
    want = plain_trees(np.array(flags(rows)), y, w, settings)
    assert np.allclose([got[r["id"]] for r in rows], want, atol=1e-6)


def test_same_model_for_any_partitions_and_after_a_store(table, monkeypatch):
    settings = Boosting(7, 3, 0.3, classify=True)
    one, two, five = (
        boosting.fit(table, BINS, "y", settings, "id", "w", partitions=n)[0].to_json() for n in (1, 2, 5)
    )
    assert one == two == five
    monkeypatch.setattr(boosting, "REFRESH", 3)
    monkeypatch.setattr(boosting, "COLLECTED", 1)
    assert boosting.fit(table, BINS, "y", settings, "id", "w", partitions=3)[0].to_json() == one


def test_forgotten_scores_are_added_up_again(table, monkeypatch):
    settings = Boosting(4, 2, 0.3, classify=True)
    (block,) = (tuple(r) for r in boosting._blocks(table.repartition(1), BINS, "y", "w", None, "id").collect())
    (model,) = boosting.fit(table, BINS, "y", settings, "id", "w")
    job = boosting.Job("x", settings, 3, 4, BINS.width, [model.base], 2.0**-20, [-1], 0, [model.trees], [])
    first = job.scores(job.read(block)).copy()
    job.done = [model.trees[:2]]
    boosting._remembered.clear()
    job.scores(job.read(block))
    job.done = [model.trees]
    assert np.allclose(job.scores(job.read(block)), first, rtol=0, atol=1e-12)
    boosting._remembered.clear()


def test_folds_are_left_out(table):
    settings = Boosting(5, 2, 0.3, row_share=1.0, column_share=1.0, classify=True)
    together = boosting.fit(table, BINS, "y", settings, "id", "w", "fold", range(3))
    for k, model in enumerate(together):
        (apart,) = boosting.fit(table.where(F.col("fold") != k), BINS, "y", settings, "id", "w")
        (a, b) = (table.select("id", m.score().alias("p")) for m in (model, apart))
        met = a.join(b.withColumnRenamed("p", "q"), "id")
        assert met.where("abs(p - q) > 1e-6").count() == 0


def test_text_form_importances_and_swaps(table):
    (model,) = boosting.fit(table, BINS, "y", Boosting(5, 3, 0.3, classify=True), "id", "w")
    again = Forest.from_json(model.to_json())
    assert again.to_json() == model.to_json()
    shares = dict(model.importances())
    assert sum(shares.values()) == pytest.approx(1.0)
    assert shares["a"] > shares["c"] and shares["state_s2"] > shares["state_s1"]
    own = F.struct(*BINS.inputs).alias("own")
    other = F.struct(F.lit(9.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"), F.lit("s2").alias("state"))
    met = table.select("*", own, other.alias("donor")).withColumn("s", model.swapped("own", "donor"))
    raised = table.withColumn("a", F.lit(9.0)).select("id", model.score().alias("p"))
    moved = table.withColumn("state", F.lit("s2")).select("id", model.score().alias("q"))
    joined = met.join(raised, "id").join(moved, "id")
    assert joined.where("abs(s[1] - p) > 1e-12 or abs(s[4] - q) > 1e-12 or size(s) <> 5").count() == 0


def test_awkward_tables(spark, table):
    settings = Boosting(2, 2, classify=True)
    (none,) = boosting.fit(table.limit(0), BINS, "y", settings, "id", "w")
    assert none.trees == [] and table.select(none.score().alias("p")).distinct().count() == 1
    (same,) = boosting.fit(table.withColumn("y", F.lit(1)), BINS, "y", settings, "id")
    assert table.select(same.score().alias("p")).where("p < 0.99").count() == 0
    plain = Bins(("a",), ((),))  # no cut, no category
    (flat,) = boosting.fit(table, plain, "y", settings, "id")
    assert table.select(flat.score().alias("p")).distinct().count() == 1
    unknown = table.limit(3).withColumns({"state": F.lit(None).cast("string"), "a": F.lit(None).cast("double")})
    (model,) = boosting.fit(table, BINS, "y", settings, "id", "w")
    assert unknown.select(model.score().alias("p")).where("p is null").count() == 0


def test_bins_are_quantiles(spark):
    df = spark.range(1, 1001).select("id", (F.col("id") % 10).cast("double").alias("x"), F.lit(None).cast("double").alias("z"))
    bins = boosting.quantile_bins(df.withColumn("id", F.col("id").cast("double")), ["id", "x", "z"], bins=4)
    assert bins.cuts[0] == (250.0, 500.0, 750.0)
    assert len(bins.cuts[1]) == 3 and bins.cuts[2] == ()


def test_the_driver_gets_one_number_per_cell(spark, table, monkeypatch):
    """However many blocks there are, their sums are added up by tasks."""
    _, job, blocks = boosting._start(table, BINS, "y", Boosting(1, 2, classify=True), "id", "w", None, [-1], 6)
    held = boosting._persisted(blocks).repartition(6)
    want = sum(job.sums(job.read(r)) for r in held.collect())
    brought = []

    def collect(rdd, plain=type(held).collect):
        found = plain(rdd)
        brought.extend(found)
        return found

    monkeypatch.setattr("pyspark.rdd.RDD.collect", collect)
    monkeypatch.setattr(boosting, "PIECE_CELLS", 40)
    assert (boosting._total(held, job) == want).all()
    assert sum(piece.size for _, piece in brought) == want.size


def test_blocks_are_persisted_without_python(spark, table):
    """Tasks that persist blocks by a Python function and read them by another hold two workers each."""
    _, job, blocks = boosting._start(table, BINS, "y", Boosting(1, 2, classify=True), "id", "w", None, [-1], 3)
    held = boosting._persisted(blocks)
    assert b"PythonRDD" not in held.toDebugString()
    first = job.read(held.first())
    assert first.matrix.dtype == np.uint16  # as stored: no wider copy
    assert boosting._total(held, job).shape == job.shape
    held.unpersist()


def test_rows_left_out_are_not_summed_and_nodes_are_those_of_a_walk(monkeypatch):
    rng = np.random.default_rng(4)
    n, numbers, values, width = 4000, 3, 4, 9
    matrix = np.concatenate([rng.integers(0, 8, (numbers, n)), rng.integers(0, values + 1, (1, n))]).astype(np.uint16)
    label, fold = (rng.random(n) < 0.4).astype(float), rng.integers(0, 5, n).astype(np.int8)
    key = rng.integers(0, 2**63, n).astype(np.uint64)
    block = boosting.Block(0, matrix, label, np.where(label == 1, 2.0, 1.0), fold, key, np.zeros((2, n)))
    settings = Boosting(trees=3, depth=3, classify=True)
    trees = [boosting.Tree.empty(3) for _ in range(2)]
    job = boosting.Job("left out", settings, numbers, values, width, [0.1, 0.2], 2.0**-30, [1, -1], 0, [[], []], trees)
    binned, count = [], np.bincount
    monkeypatch.setattr(boosting.np, "bincount", lambda cell, *rest: binned.append(len(cell)) or count(cell, *rest))
    gains = [np.zeros((2, numbers + values - 1)) for _ in range(2)]
    boosting._grown(job, boosting._drawn_features(settings, numbers + values - 1), lambda: job.sums(block), gains)
    assert max(binned) < 0.85 * n and min(binned) < 0.7 * n
    for tree in job.done[0] + job.done[1]:
        assert (tree.feature >= 0).any()
        for levels in range(4):
            at = []
            for row in matrix.T.tolist():
                place = 0
                for level in range(levels):
                    feature, cut = tree.feature[place + (1 << level) - 1], tree.cut[place + (1 << level) - 1]
                    right = row[feature] > cut if feature < numbers else row[numbers] == feature - numbers + 2
                    place = 2 * place + bool(feature >= 0 and right)
                at.append(place)
            assert tree.nodes(matrix, numbers, levels).tolist() == at
