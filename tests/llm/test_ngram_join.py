import random
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cartwright.llm import graph, ngram_join
from cartwright.llm.ngram_join import linked, one_of_each

COLUMNS = "doc_id bigint, text string"


def shingle_set(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def brute(rows):
    """(id, size, component) of each row, by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * len(sets[a] | sets[b]):
                parent[top(a)] = top(b)
    groups = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        groups[top(k)].append(i)
    smallest = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return sorted(((i, len(sets[k]), smallest[top(k)]) for k, (i, _) in enumerate(rows)), key=repr)


def edited(rng, words, rate):
    return [rng.choice("abcdefgh") * 4 if rng.random() < rate else w for w in words]


def corpus(seed, families=12, members=14):
    """Families of near copies around the threshold, shared passages, copies, short texts."""
    rng = random.Random(seed)
    words = [a + b for a in "tkrmnpls" for b in ("an", "or", "ing", "e", "us", "ity", "ed")]
    passage = [rng.choice(words) for _ in range(40)]
    rows = []
    for _ in range(families):
        base = [rng.choice(words) for _ in range(rng.choice([6, 12, 40, 120]))]
        for _ in range(rng.randrange(1, members)):
            text = edited(rng, base, rng.choice([0, 0.01, 0.02, 0.03, 0.06]))
            rows.append(" ".join(text) if rng.random() < 0.7 else "  \n".join(text).upper())
    rows += [" ".join(passage + [rng.choice(words) for _ in range(n)]) for n in (1, 3, 8, 9, 10, 60, 90)]
    rows += ["one", "One", "two words", "two  WORDS", "", None, " \n", "É", "é", "a b c d", "a b c d e"]
    rng.shuffle(rows)
    return [(k * 3 + 1, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1])
def test_components_equal_brute_force(spark, seed):
    rows = corpus(seed)
    got = linked(spark.createDataFrame(rows, COLUMNS).repartition(3))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_components_of_another_corpus(spark, monkeypatch):
    """Whole table against brute force, with letters that don't link and families over chunks."""
    monkeypatch.setattr(ngram_join, "CHUNK_CLASSES", 12)
    texts = [t for _, t in corpus(2)] + letters(60, 28, 14) + letters(60, 16, 14, "d")
    rows = [(k * 3 + 1, t) for k, t in enumerate(texts)]
    got = linked(spark.createDataFrame(rows, COLUMNS).repartition(3))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_other_ways_give_the_same(spark, monkeypatch):
    rows = corpus(3)
    docs = spark.createDataFrame(rows, COLUMNS).repartition(2)
    monkeypatch.setattr(ngram_join, "SENT_ROWS", 0)  # ids are joined, not sent
    monkeypatch.setattr(ngram_join, "BUCKET_TOKENS", 50)  # many buckets
    monkeypatch.setattr(ngram_join, "CHUNK_TOKENS", 300)  # many chunks of a family
    assert sorted(map(tuple, linked(docs).collect()), key=repr) == brute(rows)


def test_chains_across_leaders(spark):
    """Neighbours in a chain link, its ends don't: one leader can't reach all."""
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[k * 8 : k * 8 + 100])) for k in range(20)]
    rows += [(100 + k, " ".join(words[k * 8 : k * 8 + 101])) for k in range(20)]
    got = linked(spark.createDataFrame(rows, COLUMNS))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_repeated_and_null_ids(spark):
    text = "the quick brown fox jumps over the lazy dog"
    rows = [(5, text), (5, text), (None, text), (None, text.upper()), (None, "else"), (None, None), (5, "other"), (9, "else")]
    got = linked(spark.createDataFrame(rows, COLUMNS))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("sent", [2_000_000, 0])
def test_one_id_for_many_texts(spark, monkeypatch, sent):
    """Each row meets the class it holds, not every class held by its id."""
    monkeypatch.setattr(ngram_join, "SENT_ROWS", sent)
    rows = [(None if k % 2 else 7, t) for k, t in enumerate(letters(300, 44, 22))]
    docs = spark.createDataFrame(rows, COLUMNS)
    held = ngram_join._signed(docs)
    assert ngram_join._chosen(docs, held.drop("n")).count() == 300
    got = linked(docs)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_one_row_of_each_group_stays(make, awkward):
    docs = make([*awkward, (0, "same words in this row here", "en", "q", 1)], extra=True)
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.source) for r in kept.collect()), key=repr)
    lone = [(1, "a"), (2, "a"), (3, None), (4, "a"), (5, "b"), (None, None), (7, "c"), (9, "c"), (0, "q")]
    assert got == sorted(lone, key=repr)


def test_repeated_heads_leave_one_row(make, awkward):
    kept = one_of_each(make(awkward)).where("lower(text) = 'same words in this row here'")
    assert [r.doc_id for r in kept.collect()] == [6]


def test_empty_table(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert linked(empty).collect() == [] and one_of_each(empty).collect() == []


def test_graph_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    links += [(1000 + k, 1001 + k) for k in range(60)]
    parent = {x: x for ab in links for x in ab}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    found = graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {r.node: r.component for r in found} == {x: top(x) for x in parent if any(x in ab and ab[0] != ab[1] for ab in links)}


def letters(n, words, place, name="c"):
    """Form letters that differ in one word: no two link, though most of their shingles are shared."""
    base = [f"w{k}" for k in range(words)]
    return [" ".join([*base[:place], f"{name}{k}", *base[place + 1 :]]) for k in range(n)]


def block(texts):
    found = [ngram_join.shingles(t) for t in texts]
    n, zero = len(found), np.zeros(len(found), np.int32)
    names = np.array([c for c, _ in found])
    return pa.table(
        {
            "family": np.zeros(n, np.int64), "low": zero, "high": zero, "chunk": zero,
            "class": names, "component": names, "tokens": pa.array([t for _, t in found], pa.list_(pa.int64())),
        }
    )


def test_memory_of_a_block_is_bounded():
    """Letters of 44 words share 35 of 40 shingles, 78 % of two sets: all link."""
    for texts, links in ((letters(3000, 28, 14), 0), (letters(3000, 44, 22), 2999)):
        table = block(texts)
        tracemalloc.start()
        found = ngram_join._block_links(table)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found.num_rows == links and peak < 120e6


def test_families_of_letters_equal_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    texts = letters(150, 28, 14) + letters(80, 16, 14, "d") + letters(60, 44, 22, "e")
    texts += [edited(rng, t.split(), 0.02) for t in rng.sample(texts, 60)]
    rows = [(k, t if isinstance(t, str) else " ".join(t)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    monkeypatch.setattr(ngram_join, "CHUNK_CLASSES", 20)  # a family over many chunks
    assert sorted(map(tuple, linked(docs).collect()), key=repr) == brute(rows)


def test_many_letters_of_one_form(spark, monkeypatch):
    met = []
    wrapped = ngram_join._large_families

    def watched(rows, large):
        met.append(wrapped(rows, large))
        return met[-1]

    monkeypatch.setattr(ngram_join, "_large_families", watched)
    texts = letters(20_000, 28, 14) + letters(40, 44, 22, "e")
    rows = [(k, t) for k, t in enumerate(texts)]
    got = linked(spark.createDataFrame(rows, COLUMNS).repartition(3)).collect()
    assert all(r.component_id == min(r.doc_id, 20_000) for r in got) and len(got) == len(rows)
    assert [m.count() for m in met] == [0]  # no two of its chunks can link
