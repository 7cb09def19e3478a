import math
import random
import re

import numpy as np
import pytest

from cartwright.llm.term_ranking import Block, Corpus, Item, ranked, terms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=20):
    """Every score of every pair, by the definition."""
    read = [(i, plain_terms(t)) for i, t in docs]
    n, total = sum(bool(t) for _, t in read), sum(len(t) for _, t in read)
    holding = {}
    for _, t in read:
        for term in set(t):
            holding[term] = holding.get(term, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for doc, t in read:
            m = 100 - 25 + (25 * len(t) * n) // max(total, 1)
            score = 0
            for term in plain_terms(text):
                tf = t.count(term)
                if tf:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * holding[term] + 1)))
                    score += w * ((1000000000 * tf) // (1000 * tf + 12 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, at + 1, s[3], -s[0]) for at, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k])]
    return sorted(out, key=repr)


def found(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=repr)


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    docs = [(rng.randrange(2 * n), " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40)))) for _ in range(n)]
    docs += [(5000 + k, "W1 w2, w3") for k in range(40)] + [(None, "w1 w2 w3")] * 2  # ties
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 12)))) for k in range(25)]
    items += [(3, "w1 w1 W1 nowhere"), (None, "w2 w3"), (90, None), (91, ""), (92, "nowhere at all"), (93, ".,;")]
    return docs, items


def tables(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id bigint, text string, n int"),
        spark.createDataFrame([(i, t, 2) for i, t in items], "item_id bigint, text string, rank int"),
    )


def test_terms():
    text = "Ab9_cd\x7fé日本-Ünï x\x00y Z`~[q]"
    assert [t.decode() for t in terms(text)] == plain_terms(text)
    assert terms("ÀÉ") == ["ÀÉ".encode()]  # only A-Z are lower-cased


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_scoring_everything(spark, seed):
    docs, items = corpus(seed)
    docs_df, items_df = tables(spark, docs, items)
    assert found(ranked(docs_df.repartition(4), items_df)) == brute(docs, items)


def test_portions_and_small_k(spark):
    docs, items = corpus(3)
    docs_df, items_df = tables(spark, docs, items)
    got = found(ranked(docs_df, items_df, k=3, portion_bytes=300))
    assert got == brute(docs, items, 3)


def test_awkward_rows_and_empty_tables(spark, make, awkward):
    items = [(1, "same words in this row here"), (2, "naïve 日本 x"), (3, "word"), (4, "a b")]
    _, items_df = tables(spark, [], items)
    assert found(ranked(make(awkward, extra=True), items_df)) == brute([(r[0], r[1]) for r in awkward], items)
    assert found(ranked(make([]), items_df)) == []
    assert found(ranked(make(awkward), items_df.limit(0))) == []


def test_accumulators_stop_and_results_stay():
    """A frequent term makes no accumulators once the rare ones have filled the list."""
    rng = np.random.default_rng(1)
    n, size = 2000, 40
    sets = [np.flatnonzero(rng.random(size) < 1 / (1 + np.arange(size))[::-1]) for _ in range(n)]
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    numbers = np.concatenate(sets)
    times = rng.integers(1, 4, len(numbers))
    lengths = np.array([len(s) * 3 + 1 for s in sets])
    corpus_ = Corpus(n, int(lengths.sum()))
    block = Block(lengths, offsets, numbers, times, corpus_, size)
    item = Item(0, list(range(size)), [3000 - 70 * t for t in range(size)])
    scratch = np.zeros(n, np.int64)
    documents, scores = block.best(item, 20, 0, scratch)
    assert not scratch.any()
    whole = np.zeros(n, np.int64)
    for t, w in zip(item.terms, item.weights):
        own = slice(block.begin[t], block.begin[t + 1])
        whole[block.documents[own]] += w * block.share[own]
    best = np.sort(whole)[-20:]
    assert len(documents) < np.count_nonzero(whole)
    assert np.array_equal(scores, whole[documents])
    assert np.array_equal(np.sort(scores)[-20:], best)
    assert set(np.flatnonzero(whole >= best[0])) <= set(documents.tolist())
