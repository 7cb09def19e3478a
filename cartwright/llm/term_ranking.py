"""Ranked search by terms: whole-number scores, exact, with a limited set of accumulators.

Terms are runs of letters and digits of ASCII and of anything beyond it, A-Z lower-cased. A term's
weight falls with the documents that hold it; a document's score sums, over the item's terms, the
weight times a saturating share of its occurrences that is the less the longer the document.

Documents stay where they lie. One pass keeps, of each, its number of terms and the occurrences of
terms that items ask for; counts over all of it give the weights. A second pass searches block by
block: lists of the block's documents per term, then per item **term at a time, rarest first**.
An accumulator is the partial score of one document. Once what the remaining terms can add at
most, by the largest share any document of the block gets of each, is less than the k-th best
partial score, no document without an accumulator can reach the k best: none is made any more, and
those that exist are brought up to date exactly by looking them up in the remaining lists. The
k-th best score of a task's earlier blocks counts as well. A task hands on at most k rows per item and
block, so nothing is paired off and no term's list ever stands in one place.

Items are held by every task in portions of about ``PORTION_BYTES`` of text, one search pass for each.
Each row of items is an item of its own, also under a repeated or null id; terms an item repeats
count as often. A null text has no terms, a document without terms scores nowhere, and an item none of whose
terms occur gives no row. Equal scores go by the smaller id, a null id being the greatest; equal
rows of documents are ranked each. Empty tables give empty results; texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwright.llm.words import id_and_text
from cartwright.session import materialize

PORTION_BYTES = 4 << 20  # of item texts searched for in one pass, about
BLOCK = 1 << 15  # documents searched at once
SLICE_BYTES = 1 << 22  # of texts whose terms are held at once
#: Bytes that end a term become blanks, A-Z become a-z; bytes of other characters stay.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms(text: str) -> list[bytes]:
    """Terms of a text in their order."""
    return text.encode().translate(_FOLD).split()


def weight(documents: int, holding: int) -> int:
    """Of a term that so many of all documents with terms hold."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


# ---- first pass: occurrences of the terms asked for -------------------------------------------


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Parts of an array of texts of about ``SLICE_BYTES``, or of one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(texts):
        base = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
        yield texts.slice(begin, end - begin)
        begin = end


def _counted(rows: list[list[bytes]], number: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms per row, then per row the distinct known terms (offsets, numbers) and how often each."""
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    unknown = len(number)
    flat = np.fromiter((number.get(t, unknown) for row in rows for t in row), np.int64, int(lengths.sum()))
    owner = np.repeat(np.arange(len(rows)), lengths)
    known = flat < unknown
    pairs, counts = np.unique(owner[known] * (unknown + 1) + flat[known], return_counts=True)
    offsets = np.searchsorted(pairs, np.arange(len(rows) + 1) * (unknown + 1))
    return lengths, offsets, pairs % (unknown + 1), counts


def occurrences(text: Column, vocabulary: list[bytes]) -> Column:
    """``struct<n, terms, times>``: number of terms; numbers of those in the vocabulary, and how often each."""

    @F.arrow_udf("n bigint, terms array<int>, times array<int>")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        number = {t: k for k, t in enumerate(vocabulary)}
        for batch in batches:
            made = [pa.array([], pa.struct([("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))]))]
            for part in _slices(batch):
                n, offsets, found, times = _counted([terms(t.as_py() or "") for t in part], number)
                lists = [
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
                    for values in (found, times)
                ]
                made.append(pa.StructArray.from_arrays([pa.array(n), *lists], ["n", "terms", "times"]))
            yield pa.concat_arrays(made)

    return count(text)


# ---- second pass: accumulators ----------------------------------------------------------------


@dataclass(frozen=True)
class Corpus:
    """What scores need to know of all documents."""

    documents: int  # with a term
    terms: int  # all of them, repeats counted


@dataclass(frozen=True)
class Item:
    """The item's distinct terms, rarest first, each with its weight times its repeats."""

    row: int
    terms: list[int]
    weights: list[int]


class Block:
    """Lists of a block of documents: per term the documents that hold it and the share each gets."""

    def __init__(self, lengths: np.ndarray, offsets: np.ndarray, numbers: np.ndarray, times: np.ndarray, corpus: Corpus, size: int):
        owner = np.repeat(np.arange(len(lengths)), np.diff(offsets))
        m = 100 - 25 + 25 * lengths * corpus.documents // max(corpus.terms, 1)
        tf = times.astype(np.int64)
        share = 1_000_000_000 * tf // (1000 * tf + 12 * m[owner])
        order = np.argsort(numbers, kind="stable")  # documents stay ascending within a term
        self.documents, self.share = owner[order], share[order]
        self.begin = np.searchsorted(numbers[order], np.arange(size + 1))
        self.rows = len(lengths)
        self.most = np.zeros(size, np.int64)  # the largest share of each term
        held = np.flatnonzero(np.diff(self.begin))
        if len(held):
            self.most[held] = np.maximum.reduceat(self.share, self.begin[held])

    def best(self, item: Item, k: int, floor: int, scratch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents (places in the block) and scores of all that can be among the k best and
        score at least ``floor``; ``scratch`` is a zeroed array as long as the block, and stays so."""
        bounds = [w * int(self.most[t]) for t, w in zip(item.terms, item.weights, strict=True)]
        left = sum(bounds)
        met: np.ndarray = np.empty(0, np.int64)  # documents with an accumulator, ascending
        open_ = True
        for term, weight_, bound in zip(item.terms, item.weights, bounds, strict=True):
            if not bound:
                continue
            if open_ and left < floor:
                open_ = False
            elif open_ and len(met) >= k:
                partial = scratch[met]
                open_ = left >= max(floor, int(np.partition(partial, len(partial) - k)[len(partial) - k]))
            low, high = self.begin[term], self.begin[term + 1]
            documents, share = self.documents[low:high], self.share[low:high]
            if open_:
                scratch[documents] += weight_ * share
                met = np.union1d(met, documents)
            elif not len(met):
                break
            else:
                at = np.minimum(np.searchsorted(documents, met), len(documents) - 1)
                hit = documents[at] == met
                scratch[met[hit]] += weight_ * share[at[hit]]
            left -= bound
        scores = scratch[met]
        scratch[met] = 0
        good = (scores > 0) & (scores >= floor)
        return met[good], scores[good]


def _first(documents: np.ndarray, scores: np.ndarray, ids: list, k: int) -> list[tuple[int, object]]:
    """The k best as (score, id): highest score, then smallest id, a null one last."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = scores >= least
        documents, scores = documents[kept], scores[kept]
    found = [(int(s), ids[d]) for d, s in zip(documents.tolist(), scores.tolist(), strict=True)]
    return sorted(found, key=_place)[:k]


def _place(found: tuple[int, object]) -> tuple:
    score, doc_id = found
    return -score, doc_id is None, 0 if doc_id is None else doc_id


def _searched(rows: DataFrame, items: list[Item], corpus: Corpus, size: int, k: int) -> DataFrame:
    """``item, doc_id, score``: at most k rows per item and task, among them the k best of all."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    arrow = pa.schema([("item", pa.int64()), ("score", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, object]]] = [[] for _ in items]
        floors = [0] * len(items)
        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                lists, times = part.column(2), part.column(3)
                offsets = lists.offsets.to_numpy()
                block = Block(
                    part.column(1).to_numpy(), offsets - offsets[0], lists.flatten().to_numpy(),
                    times.flatten().to_numpy(), corpus, size,
                )
                ids = part.column(0).to_pylist()
                scratch = np.zeros(block.rows, np.int64)
                for number, item in enumerate(items):
                    documents, scores = block.best(item, k, floors[number], scratch)
                    if len(scores):
                        mine = _first(documents, scores, ids, k)
                        best[number] = sorted([*best[number], *mine], key=_place)[:k]
                        if len(best[number]) == k:
                            floors[number] = best[number][-1][0]
        found = [(item.row, s, d) for item, own in zip(items, best, strict=True) for s, d in own]
        if found:
            numbers, scores, ids = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers, arrow[0].type), pa.array(ids, id_type), pa.array(scores, arrow[1].type)],
                ["item", "doc_id", "score"],
            )

    return rows.select("doc_id", "n", "terms", "times").mapInArrow(search, f"item bigint, doc_id {kind}, score bigint")


def _portion(texts: list[tuple[int, str]], held: dict[int, int], number: dict[bytes, int], corpus: Corpus) -> list[Item]:
    items = []
    for row, text in texts:
        repeats: dict[int, int] = {}
        for t in terms(text):
            if number[t] in held:
                repeats[number[t]] = repeats.get(number[t], 0) + 1
        order = sorted(repeats, key=lambda t: (held[t], t))
        if order:
            items.append(Item(row, order, [repeats[t] * weight(corpus.documents, held[t]) for t in order]))
    return items


def ranked(
    docs: DataFrame,
    items: DataFrame,
    k: int = 20,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    portion_bytes: int = PORTION_BYTES,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: of each item the k documents of the highest scores above 0."""
    asked = materialize(
        items.select(
            F.monotonically_increasing_id().alias("item"),
            F.col(item_id).alias("item_id"),
            F.coalesce(F.col(item_text), F.lit("")).alias("text"),
        ),
        "items",
    )
    plain = id_and_text(docs, doc_id, text)
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    portions = max(1, math.ceil(size / portion_bytes))
    found = []
    for portion in range(portions):
        mine = asked.where(F.pmod(F.xxhash64("item"), F.lit(portions)) == portion)
        texts = [tuple(r) for r in mine.select("item", "text").collect()]
        vocabulary = sorted({t for _, text in texts for t in terms(text)})
        rows = materialize(
            plain.select("doc_id", occurrences(F.col("text"), vocabulary).alias("o")).select("doc_id", "o.*"),
            "occurrences",
        )
        n, total = rows.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        corpus = Corpus(n, total or 0)
        # as many rows as the portion has terms
        held = dict(
            map(tuple, rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        )
        number = {t: at for at, t in enumerate(vocabulary)}
        batch = _portion(texts, held, number, corpus)
        found.append(materialize(_searched(rows.where(F.size("terms") > 0), batch, corpus, len(vocabulary), k), "found"))
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    placed = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return placed.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
