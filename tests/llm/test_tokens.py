import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cartwright.llm import bpe_transducer, token_counts
from cartwright.llm.words import id_and_text

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    return bpe_transducer.read_ranks(RANKS)


@pytest.fixture(scope="module")
def library(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder(ranks):
    return bpe_transducer.Encoder(ranks, PATTERN)


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


TEXTS = st.text(
    st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'▁aeiotnsr \x1c2Ⅷ")),
    max_size=60,
)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_ids_are_those_of_the_library(encoder, library, text):
    assert encoder.encode(text).tolist() == library.encode_ordinary(text)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_counts_are_those_of_the_library(pieces, text):
    assert token_counts._model(MODEL).count(text) == len(pieces.encode(text))


def test_runs_and_long_pieces(encoder, library, pieces):
    model = token_counts._model(MODEL)
    for text in ["a" * 9000, "ab" * 3000, " " * 700, "\n" * 400, "=-" * 300, "aaab" * 200, " \n  x" * 50]:
        assert encoder.encode(text).tolist() == library.encode_ordinary(text)
        assert model.count(text) == len(pieces.encode(text))


def test_stream_emits_within_its_lookahead(ranks, library):
    transducer = bpe_transducer.Transducer(ranks)
    rng = random.Random(1)
    text = "".join(rng.choice("etaoinshrdlu") for _ in range(5000)).encode()
    seen = []

    def watched():
        for k, byte in enumerate(text):
            seen.append(k)
            yield byte

    ids = transducer.stream(watched())
    first = next(ids)
    assert len(seen) < 5000  # before the input ends
    assert [first, *ids] == library._core_bpe.encode_single_piece(text)


def test_tables_may_be_emptied_at_any_time(ranks, library, monkeypatch):
    monkeypatch.setattr(bpe_transducer, "MAX_TRANSITIONS", 50)
    monkeypatch.setattr(bpe_transducer, "MAX_PAIRS", 20)
    monkeypatch.setattr(bpe_transducer, "MAX_KNOWN", 30)
    monkeypatch.setattr(bpe_transducer, "LONG_PIECE", 12)
    small = bpe_transducer.Encoder(ranks, PATTERN)
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("etaoins") for _ in range(9)) for _ in range(300))
    assert small.encode(text).tolist() == library.encode_ordinary(text)


def test_decoding_in_portions_equals_decoding_at_once(ranks):
    words = {rank: token for token, rank in ranks.items()}
    tables = ({}, {})
    rng = random.Random(3)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(50256), rng.randrange(256)]) for _ in range(rng.randrange(9))]
        stream = bpe_transducer.Utf8Stream(words, tables)
        got = "".join(stream.feed([i]) for i in ids) + stream.end()
        assert got == b"".join(words[i] for i in ids).decode("utf-8", "replace")
        whole = bpe_transducer.Utf8Stream(words, tables)
        assert whole.feed(ids) + whole.end() == got


def test_columns(make, awkward, library, pieces):
    docs = id_and_text(make(awkward, extra=True))
    trip = bpe_transducer.round_trip("text", RANKS, PATTERN)
    rows = docs.select(
        "text",
        trip.alias("t"),
        bpe_transducer.token_ids("text", RANKS, PATTERN).alias("ids"),
        token_counts.token_count("text", MODEL).alias("n"),
    )
    rows = rows.withColumn("back", bpe_transducer.decoded_text("ids", RANKS)).collect()
    assert len(rows) == len(awkward)
    for r in rows:
        assert r.ids == r.t.ids == library.encode_ordinary(r.text)
        assert r.back == r.t.decoded == r.text
        assert r.n == len(pieces.encode(r.text))


def test_empty_table(make):
    docs = id_and_text(make([]))
    trip = bpe_transducer.round_trip("text", RANKS, PATTERN)
    assert docs.select(trip, token_counts.token_count("text", MODEL)).collect() == []


def test_registered_queries(spark, tmp_path, make, awkward, library, pieces):
    from cartwright.llm.queries import QUERIES

    make(awkward).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(QUERIES["op1_bpe_transducer"](spark, str(tmp_path)).collect(), key=repr)
    want = []
    for doc_id, text, *_ in awkward:
        ids = library.encode_ordinary(text or "")
        listed = " ".join(map(str, ids)).encode()
        want.append(
            (doc_id, len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
        )
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    got = sorted(map(tuple, QUERIES["op7_token_counts"](spark, str(tmp_path)).collect()), key=repr)
    want = []
    for doc_id, text, *_ in awkward:
        n = len(pieces.encode(text or ""))
        want.append((doc_id, len((text or "").encode()), n, n > 4096))
    assert got == sorted(want, key=repr)
