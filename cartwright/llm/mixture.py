"""Mixing sources to target weights by index.

The words of each source, document after document, are packed into blocks of ``block_words``; a
block has an index within its source. The mix is a number of output shards of ``shard_slots`` slots. How many
slots of a shard each source gets is a multinomial draw by the shard's own random stream; the last shard
takes what the draws leave each source short of its share, and draws beyond the share are void, so that every
source ends at its target. The slots of a source are numbered through the shards; slot number
``j`` of a source with ``B`` blocks stands for block ``P(j mod B)`` in pass ``j div B``, where P is a pseudorandom
permutation of the indexes (a Feistel network) keyed by source and pass. Blocks then join slots by index. No shuffled list exists
anywhere and a rerun gives the same mix.

Targets: the sources, by code point with a missing one last, weigh as given, repeating; together
they share the total size. A target beyond ``repeats`` times the size of its source stops there
and the excess is shared by weight among the others until none is above. As slots never pass
``repeats`` passes, no word is taken more often.

Null and empty texts have size 0 and are never taken. Rows with the same or no id are rows of their
own; equal rows may exchange their places. An empty table gives an empty mix. Document order within a source is by a hash of id
and text. A source of any size is packed by bounded groups of documents: sums per group, then
sums within it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwright.llm.words import WORD, unused, whole_text
from cartwright.session import materialize

GROUP_ROWS = 4096  # documents of one source that are numbered together, about
WORD_AND_BLANKS = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
GROUP_SLOTS = 1 << 15  # slots of the shards that are drawn together, about
TASK_SLOTS = 1 << 17  # slots that one task places, about
ROUNDS = 4
MAX_SOURCES = 1_000_000  # rows of the driver's table of sources, about 100 bytes each
SENT_SOURCES = 100_000  # up to here the table goes to every task


@dataclass(frozen=True)
class Recipe:
    weights: tuple[float, ...] = (1, 2, 3)
    repeats: int = 3
    block_words: int = 128
    shard_slots: int = 1024
    seed: int = 17


def targets(sizes: list[int], weights: list[float], repeats: int) -> list[float]:
    """What each source contributes: shares of the total by weight, none above its limit."""
    limits = [repeats * s for s in sizes]
    # by the level at which a source reaches its limit: those before the common level are capped
    order = sorted(range(len(sizes)), key=lambda k: limits[k] / weights[k])
    left, weight = float(sum(sizes)), float(sum(weights))
    out = [0.0] * len(sizes)
    for k in order:
        share = left * weights[k] / weight if weight > 0 else 0.0
        out[k] = min(float(limits[k]), share)
        left -= out[k]
        weight -= weights[k]
    return out


def source_table(sized: DataFrame, recipe: Recipe) -> list[dict]:
    """One entry per source, in order: name, number, rows, size, blocks, target and slots."""
    found = (
        sized.groupBy("__source")
        .agg(F.sum("__size").alias("size"), F.count(F.lit(1)).alias("rows"))
        .limit(MAX_SOURCES + 1)
        .collect()
    )
    if len(found) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources: mix by a coarser column")
    found.sort(key=lambda r: (r[0] is None, r[0] or ""))
    weights = [recipe.weights[k % len(recipe.weights)] for k in range(len(found))]
    goals = targets([r["size"] for r in found], weights, recipe.repeats)
    out = []
    for k, (row, goal) in enumerate(zip(found, goals, strict=True)):
        blocks = -(-row["size"] // recipe.block_words)
        slots = min(recipe.repeats * blocks, round(goal * blocks / row["size"])) if blocks else 0
        out.append(
            {"source": row[0], "number": k, "rows": row["rows"], "size": row["size"],
             "blocks": blocks, "target": goal, "slots": slots}
        )
    return out


def permuted(index: np.ndarray, size: int, key: tuple[int, ...]) -> np.ndarray:
    """Image of ``index`` under the pseudorandom permutation of range(size) named by ``key``."""
    if size <= 1:
        return index.copy()
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = np.random.Generator(np.random.Philox(key=np.array(_folded(key), np.uint64))).integers(
        0, 1 << 63, ROUNDS, np.uint64
    )

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & low
        for k in keys:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ (mixed >> np.uint64(33) & low)
        return left << np.uint64(half) | right

    out = once(index.astype(np.uint64))
    outside = out >= size
    while outside.any():  # walk on along the cycle until back in the range
        out[outside] = once(out[outside])
        outside = out >= size
    return out.astype(np.int64)


def _folded(key: tuple[int, ...]) -> list[int]:
    folded = [0x243F6A8885A308D3, 0x13198A2E03707344]
    for k, part in enumerate(key):
        folded[k % 2] = (folded[k % 2] * 6364136223846793005 + part + 1) % (1 << 64)
    return folded


def _draws(shard: int, shares: np.ndarray, recipe: Recipe) -> np.ndarray:
    rng = np.random.Generator(np.random.Philox(key=np.array(_folded((recipe.seed, shard)), np.uint64)))
    return rng.multinomial(recipe.shard_slots, shares)


def shard_counts(docs: DataFrame, sources: list[dict], recipe: Recipe) -> DataFrame:
    """``shard, number, first, count``: slots of each source in each shard; ``first`` is the number
    of the shard's first slot among those of the source.

    Draws go by groups of shards: totals per group, running totals over the groups, then again
    within each group, so no table of all shards passes through one task.
    """
    spark = docs.sparkSession
    wanted = np.array([s["slots"] for s in sources], np.int64)
    total = int(wanted.sum())
    schema = "shard bigint, number int, first bigint, count bigint"
    if not total:
        return spark.createDataFrame([], schema)
    shares = wanted / total
    n_shards = total // recipe.shard_slots  # the last shard settles the rest
    # shards in a group: few enough that its counts and its slots are a small part of a task's work
    width = max(1, min(2_000_000 // max(1, len(sources)) // 8, GROUP_SLOTS // recipe.shard_slots))
    groups = spark.range(0, -(-n_shards // width)) if n_shards else spark.range(0, 1)

    def bounds(group: int) -> range:
        return range(group * width, min(n_shards, (group + 1) * width))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in batch.column(0).to_pylist():
                drawn = sum((_draws(s, shares, recipe) for s in bounds(group)), np.zeros(len(shares), np.int64))
                k = np.flatnonzero(drawn)
                yield pa.RecordBatch.from_pydict(
                    {"group": np.full(len(k), group), "number": k.astype(np.int32), "drawn": drawn[k]}
                )

    per_group = groups.mapInArrow(totals, "group bigint, number int, drawn bigint")
    before = Window.partitionBy("number").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(
        per_group.withColumn("before", F.coalesce(F.sum("drawn").over(before), F.lit(0))), "draws"
    )
    started = offsets.groupBy("group").agg(
        F.collect_list("number").alias("number"), F.collect_list("before").alias("before")
    )

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, number, begin in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                first = np.zeros(len(shares), np.int64)
                first[number] = begin
                for shard in bounds(group):
                    drawn = _draws(shard, shares, recipe)
                    valid = np.clip(wanted - first, 0, drawn)
                    k = np.flatnonzero(valid)
                    yield pa.RecordBatch.from_pydict(
                        {"shard": np.full(len(k), shard), "number": k.astype(np.int32), "first": first[k], "count": valid[k]}
                    )
                    first += drawn

    # by number, not by bytes: a short row of totals stands for a whole group of slots
    drawn = started.repartition(max(1, math.ceil(total / TASK_SLOTS))).mapInArrow(counts, schema)
    rest = {k: v for k, v in enumerate(wanted.tolist())}
    for row in offsets.groupBy("number").agg(F.sum("drawn").alias("n")).collect():
        rest[row["number"]] -= row["n"]
    last = [(n_shards, k, int(wanted[k] - n), n) for k, n in rest.items() if n > 0]
    return drawn.union(spark.createDataFrame(last, schema)) if last else drawn


SLOTS_PER_ROW = 1 << 16  # of one batch


def slots(counts: DataFrame, sources: list[dict], recipe: Recipe) -> DataFrame:
    """``shard, slot, number, pass, block``: the block that each slot of the mix stands for."""
    blocks = [s["blocks"] for s in sources]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, number, first, count in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for at in range(first, first + count, SLOTS_PER_ROW):
                    j = np.arange(at, min(at + SLOTS_PER_ROW, first + count))
                    turn, index = j // blocks[number], j % blocks[number]
                    block = np.empty_like(j)
                    for t in np.unique(turn):
                        own = turn == t
                        block[own] = permuted(index[own], blocks[number], (recipe.seed, number, int(t)))
                    n = len(j)
                    yield pa.RecordBatch.from_pydict(
                        {"shard": np.full(n, shard), "slot": j, "number": np.full(n, number, np.int32),
                         "pass": turn.astype(np.int32), "block": block}
                    )

    return counts.select("shard", "number", "first", "count").mapInArrow(
        place, "shard bigint, slot bigint, number int, pass int, block bigint"
    )


def _row_key(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id).cast("string"), whole_text(text))


def placed(rows: DataFrame, sources: list[dict]) -> DataFrame:
    """``rows(__source, __size, __place, ...)`` with ``number`` and ``begin``: where a document's
    words begin in the stream of its source."""
    table = rows.sparkSession.createDataFrame(
        [(s["source"], s["number"], s["rows"]) for s in sources],
        "__name string, number int, __rows bigint",
    )
    table = F.broadcast(table) if len(sources) <= SENT_SOURCES else table
    groups = F.greatest(F.lit(1), F.ceil(F.col("__rows") / GROUP_ROWS))
    grouped = (
        rows.join(table, F.col("__source").eqNullSafe(F.col("__name")))
        .withColumn("__group", F.pmod("__place", groups))
        .drop("__name", "__rows")
    )
    sums = grouped.groupBy("number", "__group").agg(F.sum("__size").alias("sum"))
    over = Window.partitionBy("number").orderBy("__group")
    starts = sums.select(
        "number", "__group", (F.sum("sum").over(over) - F.col("sum")).alias("__start")
    )
    within = Window.partitionBy("number", "__group").orderBy("__place")
    running = F.sum("__size").over(within.rowsBetween(Window.unboundedPreceding, 0))
    return (
        grouped.withColumn("__within", running - F.col("__size"))
        .join(starts, ["number", "__group"])
        .withColumn("begin", F.col("__start") + F.col("__within"))
        .drop("__start", "__within", "__group")
    )


@dataclass
class Mix:
    """The sources with their targets, the packed documents without their texts, and the slots."""

    sources: list[dict]
    documents: DataFrame  # doc_id, __place, __size, number, begin
    slots: DataFrame
    recipe: Recipe

    def pieces(self) -> DataFrame:
        """Each document's part of each block: ``number, block, begin, from_word, n_words``."""
        size, end = self.recipe.block_words, F.col("begin") + F.col("__size")
        blocks = F.sequence(F.floor(F.col("begin") / size), F.floor((end - 1) / size))
        whole = self.documents.where("__size > 0").withColumn("block", F.explode(blocks))
        low = F.greatest(F.col("begin"), F.col("block") * size)
        high = F.least(end, (F.col("block") + 1) * size)
        return whole.select(
            "number", "block", "begin", "__place",
            (low - F.col("begin")).alias("from_word"), (high - low).alias("n_words"),
        )

    def taken(self) -> DataFrame:
        """``doc_id, size, source_size, target, taken`` of every document."""
        uses = self.slots.groupBy("number", "block").agg(F.count(F.lit(1)).alias("uses"))
        words = (
            self.pieces()
            .join(uses, ["number", "block"])
            .groupBy("number", "begin")
            .agg(F.sum(F.col("n_words") * F.col("uses")).alias("taken"))
        )
        table = self.documents.sparkSession.createDataFrame(
            [(s["number"], s["size"], s["target"]) for s in self.sources],
            "number int, source_size bigint, target double",
        )
        table = F.broadcast(table) if len(self.sources) <= SENT_SOURCES else table
        found = self.documents.join(words, ["number", "begin"], "left").join(table, "number")
        taken = F.when(F.col("__size") > 0, F.coalesce("taken", F.lit(0))).otherwise(F.lit(0))
        return found.select(
            "doc_id", F.col("__size").alias("size"), "source_size", "target",
            taken.cast("long").alias("taken"),
        )


def mix(
    docs: DataFrame,
    recipe: Recipe | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> Mix:
    """Plan the mix of all documents. Texts are read once, for their sizes."""
    recipe = recipe or Recipe()
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).cast("string").alias("__source"),
        F.regexp_count(whole_text(text), F.lit(WORD)).cast("long").alias("__size"),
        _row_key(doc_id, text).alias("__place"),
    )
    rows = materialize(rows, "sizes")
    sources = source_table(rows, recipe)
    documents = materialize(placed(rows, sources).drop("__source"), "placed")
    counts = shard_counts(docs, sources, recipe)
    return Mix(sources, documents, materialize(slots(counts, sources, recipe), "slots"), recipe)


def mixed_documents(
    docs: DataFrame,
    recipe: Recipe | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """The mix as rows of ``docs``: one row for each document and pass over its source in which
    the mix takes some of its words, with just those words and the blanks after them.

    A document taken whole keeps its text as it is.
    """
    plan = mix(docs, recipe, doc_id, text, source)
    chosen = (
        plan.pieces()
        .join(plan.slots.select("number", "block", "pass"), ["number", "block"])
        .groupBy("number", "begin", "__place", "pass")
        .agg(F.sort_array(F.collect_list(F.struct("from_word", "n_words"))).alias("__parts"))
        .join(
            plan.documents.where("__size > 0").select("number", "begin", "__size"),
            ["number", "begin"],  # a row without words begins where the next one does
        )
    )
    # equal rows take turns, so that each has its own pieces
    turn = Window.partitionBy("__place").orderBy("number", "begin")
    key, row, place, nth, parts, size = unused(docs, "key", "row", "place", "nth", "parts", "size")
    chosen = chosen.select(
        F.col("__place").alias(place), F.dense_rank().over(turn).alias(nth),
        F.col("__parts").alias(parts), F.col("__size").alias(size),
    )
    rows = docs.withColumn(key, _row_key(doc_id, text))
    rows = rows.withColumn(row, F.row_number().over(Window.partitionBy(key).orderBy(key)))
    # the difference keeps the join on the key alone, as the rows are dealt out already
    both = rows.join(chosen, (F.col(key) == F.col(place)) & (F.col(row) - F.col(nth) == 0))
    words = F.regexp_extract_all(text, F.lit(WORD_AND_BLANKS), F.lit(0))
    taken = F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n + p["n_words"])
    cut = F.array_join(
        F.flatten(
            F.transform(
                parts,
                lambda p: F.slice(words, (p["from_word"] + 1).cast("int"), p["n_words"].cast("int")),
            )
        ),
        "",
    )
    whole = taken == F.col(size)
    return both.withColumn(text, F.when(whole, F.col(text)).otherwise(cut)).select(*docs.columns)
