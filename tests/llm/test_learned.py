import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartwright.llm import language_id, quality_knn, sampling
from cartwright.llm.words import remainder

SYLLABLES = {
    "en": ["the", "ing", "and", "tion", "ed", "wh", "sh"],
    "fr": ["eau", "ou", "é", "que", "ment", "oi", "è"],
    "de": ["sch", "ung", "ein", "ß", "keit", "ü", "pf"],
}


def text_of(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def languages(make):
    rng = random.Random(1)
    rows = []
    for k in range(360):
        lang = ("en", "fr", "de")[k % 3]
        rows.append((k, text_of(rng, lang, rng.choice([3, 30, 200])), lang, "s", 0))
    return rows


def test_language_accuracy_on_held_out_rows(make, languages):
    docs = make(languages, extra=True)
    held_out = remainder("doc_id", 4) == 2
    network = language_id.fit(docs.where(~held_out))
    got = docs.where(held_out).select("lang", language_id.predictions(network, "text").alias("p")).collect()
    assert np.mean([r.lang == r.p.lang_pred for r in got]) > 0.95
    assert all(0 <= r.p.score <= 1 for r in got)


def test_language_of_awkward_rows(make, awkward, languages):
    network = language_id.fit(make(languages))
    got = make(awkward, extra=True).select("doc_id", "text", language_id.predictions(network, "text").alias("p")).collect()
    assert len(got) == len(awkward)
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.p.lang_pred == "und") == (not letters)


def test_language_windows_cover_the_text(languages, make):
    network = language_id.fit(make(languages))
    rng = random.Random(3)
    texts = [text_of(rng, lang, n) for lang in SYLLABLES for n in (1, 60, 61, 62, 900)]
    import pyarrow as pa

    data, ends = language_id._texts(pa.array(["x", *texts, ""]).slice(1, len(texts)))
    starts, counts = language_id._window_starts(ends)
    assert counts.sum() == len(starts)
    at = 0
    for k, text in enumerate(texts):
        size = len(text.encode())
        own = starts[at : at + counts[k]] - ends[k]
        at += counts[k]
        covered = {i for s in own for i in range(s, min(s + language_id.LENGTH, size))}
        assert covered == set(range(size))
        assert bytes(data[ends[k] : ends[k + 1]]).decode() == text
    # folded tables give what the layers give one after the other
    window = np.frombuffer(texts[1].encode().ljust(language_id.LENGTH, b"\0")[: language_id.LENGTH], np.uint8)
    embedded = network.embedding[window]
    for k, w in enumerate(language_id.WIDTHS):
        plain = np.array(
            [sum(embedded[i + j] @ network.filters[w][j] for j in range(w)) for i in range(len(window) - w + 1)]
        )
        f = plain.shape[1]
        want = np.maximum(plain.max(axis=0) + network.bias[w], 0)
        assert np.allclose(network.pooled(window[None])[0, k * f : (k + 1) * f], want, atol=1e-4)


def test_language_without_labels_and_without_rows(make):
    docs = make([(1, "text", None, "s", 0)])
    assert language_id.fit(docs) is None and language_id.fit(make([])) is None
    row = docs.select(language_id.predictions(None, "text").alias("p")).first()
    assert (row.p.lang_pred, row.p.score) == ("und", 0.0)
    one = make([(1, "text", "en", "s", 0)])
    network = language_id.fit(one)
    assert one.select(language_id.predictions(network, "text").alias("p")).first().p.lang_pred == "en"
    assert make([]).select(language_id.predictions(network, "text")).collect() == []


def junk(rng):
    kind = rng.randrange(3)
    words = text_of(rng, "en", 40).split()
    if kind == 0:
        return " ".join(w + "###" for w in words)
    if kind == 1:
        return " ".join(w.upper() + "!!" for w in words)
    return " ".join(w for w in words[:4] for _ in range(9))


@pytest.fixture(scope="module")
def rated(make, spark):
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(400):
        good = rng.random() < 0.8
        rows.append((k, text_of(rng, "en", 60) if good else junk(rng), "en", "s", 0))
        labels.append((k, int(good), 0))
    return rows, labels, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_quality_on_held_out_rows(make, rated):
    rows, labels, table = rated
    docs = make(rows, extra=True)
    held_out = remainder("doc_id", 5) == 0
    model = quality_knn.fit(docs, table.where(~held_out))
    got = {r.doc_id: r.s for r in docs.where(held_out).select("doc_id", quality_knn.score(model, "text").alias("s")).collect()}
    truth = {i: q for i, q, _ in labels}
    assert len(got) > 40
    assert np.mean([(s >= 0.3) == truth[i] for i, s in got.items()]) > 0.95


def test_votes_equal_brute_force(make, rated):
    rows, _, table = rated
    docs = make(rows)
    model = quality_knn.fit(docs, table)
    vectors = np.array([model.place(*quality_knn.terms(t)) for _, t, *_ in rows[:50]], np.float32)
    near = vectors @ model.vectors.T
    for row, got in zip(near, model.scores(vectors), strict=True):
        order = sorted(range(len(row)), key=lambda k: (-row[k], k))[: model.neighbours]
        weight = np.maximum(row[order], 0) + 1e-9
        assert got == pytest.approx((weight * model.votes[order]).sum() / weight.sum(), abs=1e-5)


def test_quality_of_awkward_rows_and_labels(spark, make, awkward, rated):
    rows, labels, table = rated
    odd = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (None, 1, 0), (2, None, 0), (3, 7, 0)], table.schema)
    model = quality_knn.fit(make(rows), table.union(odd))
    got = make(awkward, extra=True).select(quality_knn.score(model, "text").alias("s")).collect()
    assert len(got) == len(awkward) and all(0 <= r.s <= 1 for r in got)
    assert quality_knn.fit(make(rows), odd) is None and quality_knn.fit(make([]), table) is None
    assert make(rows[:1]).select(quality_knn.score(None, "text").alias("s")).first().s == 0.5
    assert make([]).select(quality_knn.score(model, "text")).collect() == []


def test_samples_are_bounded_and_repeatable(spark):
    rows = spark.range(20_000).select("id", (F.col("id") % 10 == 0).alias("label"))
    once = sampling.about(rows, "label", "id", 500).collect()
    assert sorted(once) == sorted(sampling.about(rows.repartition(7), "label", "id", 500).collect())
    for label in (True, False):
        assert 400 < sum(r.label == label for r in once) < 600


@pytest.mark.parametrize("seed", [1, 2, 3, 7, 11])
def test_samples_have_the_size_asked_for_whatever_repeats(spark, seed):
    """Rows without an id, copies and repeated ids neither empty nor flood a sample."""
    distinct = spark.range(20_000).selectExpr("cast(null as bigint) as id", "'en' as label", "concat('t', id) as text")
    copies = spark.range(30_000).selectExpr("id", "'en' as label", "'one text' as text")
    few = spark.range(40).selectExpr("1 as id", "'fr' as label", "concat('f', id) as text")
    other = spark.range(5).selectExpr("id", "cast(null as string) as label", "'n' as text")
    rows = distinct.union(copies).union(few).union(other)
    got = [tuple(r) for r in sampling.about(rows, "label", "text", 1500, seed).select("label", "text").collect()]
    assert len(set(got)) == len(got)
    assert sum(label == "en" for label, _ in got) == 1500
    assert sum(label == "fr" for label, _ in got) == 40
    assert {label for label, _ in got} == {"en", "fr"}
    again = sampling.about(rows.repartition(7), "label", "text", 1500, seed).select("label", "text")
    assert sorted(map(tuple, again.collect())) == sorted(got)


def test_a_labelled_id_of_very_many_documents(spark):
    """Documents of one id are taken up to the bound; contradicting labels teach nothing."""
    docs = spark.range(5000).selectExpr("1 as doc_id", "concat('good words here ', id) as text")
    docs = docs.union(spark.range(30).selectExpr("id + 2 as doc_id", "concat('#### @@ ', id) as text"))
    labels = spark.createDataFrame([(1, 1)] * 500 + [(k + 2, 0) for k in range(30)] + [(31, 1)], "doc_id bigint, quality int")
    size = quality_knn.Size(each=100)
    model = quality_knn.fit(docs, labels, size=size)
    assert len(model.votes) == 100 + 29
    assert sum(model.votes) == 100
