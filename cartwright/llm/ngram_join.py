"""Join of documents by the Jaccard similarity of their word shingles, exact at any skew.

A document is the set of its shingles of ``SHINGLE`` words (its whole word sequence, if that is
shorter). Documents with the same word sequence are one class from the start. Two classes
link when their similarity is at least ``PERCENT``; the result is the partition that links span.

Candidates come from prefix filtering under several global token orders. Similar sets share so
many tokens that, however tokens are ordered, the first few tokens of the one hold a token among the first few
of the other. Hence, of two similar
sets,

1. with rare tokens first: each must have at least 75 % of its tokens in other classes. Tokens
   go, packed, to buckets by hash; a token met twice within one slice of rows is counted there
   and sent once, so a token of a third of all documents costs one entry per slice;
2. with tokens by hash: both must stand under a common token of the prefix index of what is left;
3. with tokens by their count among the classes still in question, the prefixes must meet again.

Groups are never paired off. Under order 2 every class is first verified against one leader, the
class whose tokens are the commonest among those it shares an index entry with, which joins dense
groups by as many pairs as they have members. What still spans two components passes order 1 once
more, counting only tokens that other components have. Of the classes of one leader, linked with it
or not, those that meet under order 3 are then compared by bounded blocks, a large family only where
the tokens its classes share leave a link possible, and classes of different leaders are paired
under order 3; only pairs across components are verified, which loses no component.

Tokens and classes are 64-bit hashes. Nulls, empty texts and texts without a word have no shingle and stay alone. Rows with
the same or no id are rows of their own; a class's component is the smallest id in it, null only
if all are. Long texts take memory in proportion to their size. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwright.llm.graph import components
from cartwright.llm.memory import give_back
from cartwright.llm.words import id_and_text, unused, whole_text
from cartwright.session import materialize

SHINGLE = 5
PERCENT = 75
BUCKET_TOKENS = 2_000_000  # about so many tokens are compared in one task
BYTES_PER_TOKEN = 7
CHUNK_TOKENS = 150_000  # of one family that are compared with as many others in one task
CHUNK_CLASSES = 4096  # likewise
TILE = 1024  # classes of a chunk that are compared at once
BLOCK_TOKENS = 4096
SENT_ROWS = 2_000_000  # ids (16 bytes each) go to every task up to here, else they are joined
SLICE_BYTES = 1 << 20  # of texts that are shingled together
PLACES = 64
_ODD = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD],
    np.uint64,
)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _numbers(name: bytes, n: int) -> np.ndarray:
    return np.frombuffer(hashlib.shake_256(name).digest(8 * n), np.uint64)


#: A number for each byte at each place of a word; a word's hash adds up those of its bytes.
_BYTES = _numbers(b"bytes of words", PLACES * 256)
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.int64)
_BLANK = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])


def _word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, which lie end to end, and where those of each text begin."""
    at = np.flatnonzero(~_BLANK[data])
    if not len(at):
        return np.empty(0, np.uint64), np.zeros(len(ends), np.int64)
    borders = np.zeros(len(data) + 1, bool)
    borders[ends] = True
    first = np.empty(len(at), bool)
    first[0] = True
    first[1:] = (np.diff(at) > 1) | borders[at[1:]]
    begin = np.flatnonzero(first)
    place = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
    part = _BYTES[(place % PLACES) << 8 | _FOLD[data[at]]]
    if place.max() >= PLACES:  # the numbers again, turned, for each further stretch of a long word
        far = np.flatnonzero(place >= PLACES)
        part[far] = _mixed(part[far] + (place[far] // PLACES).astype(np.uint64) * _ODD[0])
    return _mixed(np.add.reduceat(part, begin)), np.searchsorted(at[begin], ends)


def _slices(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes of texts of about ``SLICE_BYTES`` together, or of one text, and where each ends."""
    texts = texts.cast(pa.large_string())
    _, places, held = texts.buffers()
    ends = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(held, np.uint8) if held else np.empty(0, np.uint8)
    begin = 0
    while begin < len(texts):
        upto = int(np.searchsorted(ends, ends[begin] + SLICE_BYTES, "right")) - 1
        upto = max(begin + 1, upto)
        yield data[ends[begin] : ends[upto]], ends[begin : upto + 1] - ends[begin]
        begin = upto


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Of each text its class (0: no words) and its distinct shingle hashes, ascending as signed."""
    for data, ends in _slices(texts):
        words, first = _word_hashes(data, ends)
        count = np.diff(first)
        held = np.flatnonzero(count)
        names = np.zeros(len(count), np.int64)
        if len(held):
            place = (np.arange(len(words)) - np.repeat(first[:-1], count)).astype(np.uint64)
            total = np.add.reduceat(_mixed(words + place * _ODD[1]), first[:-1][held])
            names[held] = _mixed(total + count[held].astype(np.uint64) * _ODD[2]).view(np.int64)
            names[held] += names[held] == 0
        places = max(0, len(words) - SHINGLE + 1)
        mixed = words[:places] * _ODD[0]
        for k in range(1, SHINGLE):
            mixed = _mixed(mixed) + words[k : k + places] * _ODD[k]
        mixed = _mixed(mixed).view(np.int64)
        for name, begin, n in zip(names.tolist(), first.tolist(), count.tolist(), strict=False):
            if n >= SHINGLE:
                yield name, np.unique(mixed[begin : begin + n - SHINGLE + 1])
            else:
                yield name, np.array([name ^ n] if n else [], np.int64)


def shingles(text: str) -> tuple[int, np.ndarray]:
    return next(shingle_sets(pa.array([text])))


def signature(text: str | Column) -> Column:
    """``struct<class bigint, n bigint>``: class of the text's words (null: none), size of its set."""

    @F.arrow_udf("class bigint, n bigint")
    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [(name or None, len(tokens)) for name, tokens in shingle_sets(batch)]
            columns = [pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)]
            yield pa.StructArray.from_arrays(columns, ["class", "n"])
        give_back()

    return sign(whole_text(text))


def _sets(text: Column, name: Column) -> Column:
    """Shingle hashes of the texts whose class is ``name``, null for others."""

    @F.arrow_udf("array<bigint>")
    def spread(texts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, wanted in texts:
            found = zip(shingle_sets(text), wanted.to_pylist(), strict=True)
            rows = [s if k == w else None for (k, s), w in found]
            yield pa.array(rows, pa.list_(pa.int64()))

    return spread(text, name)


# ---- order 1: classes most of whose tokens stand elsewhere too --------------------------------

_PACKED = "bucket int, classes binary, groups binary, counts binary, tokens binary, repeated binary"
_FLAGGED = pa.schema(
    [("class", pa.int64()), ("n", pa.int64()), ("shared", pa.int64()), ("copies", pa.int64())]
)
SLICE = 2000  # rows packed together


def _texts_packed(n_buckets: int):
    """Packs the distinct classes of each slice of texts; every class is a group of its own."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                known: dict[int, np.ndarray] = {}
                for name, tokens in shingle_sets(batch.column(0).slice(at, SLICE)):
                    if name:
                        known.setdefault(name, tokens)
                if known:
                    classes = np.fromiter(known, np.int64, len(known))
                    yield _rows(classes, classes, list(known.values()), n_buckets)
        give_back()

    return pack


def _sets_packed(n_buckets: int):
    """Packs ``class, component, tokens``; the classes of a component are one group. With a fourth
    column, tokens of different families differ."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                tokens = [row.values.to_numpy() for row in part.column(2)]
                if part.num_columns > 3:
                    keys = _mixed(part.column(3).to_numpy().view(np.uint64)).view(np.int64)
                    tokens = [t ^ key for t, key in zip(tokens, keys, strict=True)]
                yield _rows(part.column(0).to_numpy(), part.column(1).to_numpy(), tokens, n_buckets)

    return pack


def _bucket_of(tokens: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((tokens >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64)


def _spanning(tokens: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token whether it stands in several groups, and those tokens, each once."""
    order = np.argsort(tokens)
    ranked, owner = tokens[order], groups[order]
    begins = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    several = np.minimum.reduceat(owner, begins) != np.maximum.reduceat(owner, begins)
    hit = np.empty(len(tokens), bool)
    hit[order] = np.repeat(several, np.diff(np.append(begins, len(tokens))))
    return hit, ranked[begins[several]]


def _rows(
    classes: np.ndarray, groups: np.ndarray, sets: list[np.ndarray], n_buckets: int
) -> pa.RecordBatch:
    """Tokens of a slice by bucket, those that several of its groups have only once, unowned.

    Bucket -1 - b holds, of the classes that hash to b, the set sizes and how many tokens the
    slice alone showed to be shared.
    """
    sizes = np.array([len(t) for t in sets], np.int64)
    tokens = np.concatenate(sets).view(np.uint64)
    owner = np.repeat(np.arange(len(classes)), sizes)
    hit, repeated = _spanning(tokens, groups[owner])
    local = np.bincount(owner[hit], minlength=len(classes)).astype(np.int64)
    tokens, owner = tokens[~hit], owner[~hit]
    own_groups = groups is not classes
    columns: list[list] = [[] for _ in range(6)]

    def put(bucket: int, rows: np.ndarray, *parts: np.ndarray) -> None:
        held = [classes[rows], groups[rows] if own_groups else classes[:0], *parts]
        for column, value in zip(columns, (bucket, *[p.tobytes() for p in held]), strict=True):
            column.append(value)

    home = _bucket_of(classes.view(np.uint64), n_buckets)
    for b in np.unique(home):
        own = np.flatnonzero(home == b)
        put(-1 - int(b), own, sizes[own], local[own], classes[:0])
    bucket, rep_bucket = _bucket_of(tokens, n_buckets), _bucket_of(repeated, n_buckets)
    order = np.argsort(bucket, kind="stable")  # owners stay ascending
    bucket, tokens, owner = bucket[order], tokens[order].astype(np.uint32), owner[order]
    order = np.argsort(rep_bucket, kind="stable")
    rep_bucket, repeated = rep_bucket[order], repeated[order].astype(np.uint32)
    edges = np.arange(n_buckets + 1)
    cuts, rep_cuts = np.searchsorted(bucket, edges), np.searchsorted(rep_bucket, edges)
    for b in range(n_buckets):
        lo, hi, rlo, rhi = cuts[b], cuts[b + 1], rep_cuts[b], rep_cuts[b + 1]
        if lo < hi or rlo < rhi:
            own, counts = np.unique(owner[lo:hi], return_counts=True)
            put(b, own, counts.astype(np.uint32), tokens[lo:hi], repeated[rlo:rhi])
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]],
        names=["bucket", "classes", "groups", "counts", "tokens", "repeated"],
    )


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _shared(table: pa.Table) -> pa.Table:
    found = _counted(table)
    give_back()
    return found


def _counted(table: pa.Table) -> pa.Table:
    """Of one bucket: for each class, how many of its tokens another group has too."""
    classes = _joined(table["classes"], np.int64)
    if table["bucket"][0].as_py() < 0:
        sizes, local = _joined(table["counts"], np.int64), _joined(table["tokens"], np.int64)
        return pa.table([classes, sizes, local, np.ones(len(classes), np.int64)], schema=_FLAGGED)
    groups = _joined(table["groups"], np.int64)
    counts = _joined(table["counts"], np.uint32)
    tokens = _joined(table["tokens"], np.uint32)
    if not len(tokens):
        return _FLAGGED.empty_table()
    hit, _ = _spanning(tokens, np.repeat(groups if len(groups) else classes, counts))
    hit |= np.isin(tokens, _joined(table["repeated"], np.uint32))
    names, found = np.unique(np.repeat(classes, counts)[hit], return_counts=True)
    zero = np.zeros(len(names), np.int64)
    return pa.table([names, zero, found.astype(np.int64), zero], schema=_FLAGGED)


def _questionable(packed: DataFrame) -> DataFrame:
    """``class, n, shared`` of classes with enough tokens in common with other groups to be similar."""
    shared = packed.groupBy("bucket").applyInArrow(
        _shared, "class bigint, n bigint, shared bigint, copies bigint"
    )
    # a class met in several slices was counted in each of them alike
    return (
        shared.groupBy("class")
        .agg(F.max("n").alias("n"), F.sum("shared").alias("shared"), F.sum("copies").alias("copies"))
        .where(F.col("shared") * 100 >= F.col("n") * F.col("copies") * PERCENT)
        .select("class", "n", "shared")
    )


def _buckets(tokens: int) -> int:
    return max(16, tokens // BUCKET_TOKENS)


# ---- orders 2 and 3 -------------------------------------------------------------------------


def _prefix_length(n: Column) -> Column:
    """How many first tokens of a set must hold one that a similar set has among its first."""
    return (n - F.ceil(n * PERCENT / 100) + 1).cast("int")


def _sizes_fit(a: Column, b: Column) -> Column:
    return (a * 100 >= b * PERCENT) & (b * 100 >= a * PERCENT)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links among ``pairs(a, b)``: prefixes under the hash order meet, then the sets are alike."""
    one = sets.select(F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("t_a"))
    two = sets.select(F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("t_b"))
    both = pairs.join(one, "a").join(two, "b")
    meet = F.arrays_overlap(
        F.slice("t_a", F.lit(1), _prefix_length(F.col("n_a"))),
        F.slice("t_b", F.lit(1), _prefix_length(F.col("n_b"))),
    )
    common = F.size(F.array_intersect("t_a", "t_b"))
    alike = common * 100 >= (F.col("n_a") + F.col("n_b") - common) * PERCENT
    return both.where(meet & _sizes_fit(F.col("n_a"), F.col("n_b"))).where(alike).select("a", "b")


def _leader_pairs(index: DataFrame) -> DataFrame:
    """Each class with the leader that stands highest among the entries they share."""
    support = index.groupBy("class").agg(F.sum("df").alias("support"))
    ranked = index.join(support, "class").withColumn(
        "rank", F.struct("support", F.xxhash64("class").alias("h"), F.col("class").alias("leader"), "n")
    )
    leaders = ranked.groupBy("token").agg(F.max("rank").alias("best"))
    return (
        index.join(leaders, "token")
        .where(F.col("class") != F.col("best.leader"))
        .where(_sizes_fit(F.col("n"), F.col("best.n")))
        .groupBy("class")
        .agg(F.max("best").alias("best"))
        .select(F.col("class").alias("a"), F.col("best.leader").alias("b"))
    )


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _tile_links(
    rows: np.ndarray, cols: np.ndarray, sets: list[np.ndarray], sizes: np.ndarray, groups: np.ndarray
) -> list[tuple[int, int]]:
    """Links that join the groups of two tiles; ``groups`` is brought up to date."""
    apart = groups[rows][:, None] != groups[cols][None, :]
    if not apart.any():
        return []
    places = np.intersect1d(
        np.concatenate([sets[i] for i in rows]), np.concatenate([sets[i] for i in cols])
    )
    total = (sizes[rows][:, None] + sizes[cols][None, :]).astype(np.float64)
    # whole numbers up to 2**24 are exact in single precision
    if PERCENT * total.max() < 1 << 24:
        total = total.astype(np.float32)
    shared = np.zeros_like(total)

    def entries(tile: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        owner = np.repeat(np.arange(len(tile)), [len(sets[i]) for i in tile])
        place = np.concatenate([sets[i] for i in tile])
        at = np.minimum(np.searchsorted(places, place), max(len(places) - 1, 0))
        known = places[at] == place if len(places) else np.zeros(len(place), bool)
        order = np.argsort(at[known], kind="stable")
        return owner[known][order], at[known][order]

    sides = [entries(rows), entries(cols)]
    for lo in range(0, len(places), BLOCK_TOKENS):
        width = min(BLOCK_TOKENS, len(places) - lo)
        parts = []
        for tile, (owner, at) in zip((rows, cols), sides, strict=True):
            begin, end = np.searchsorted(at, [lo, lo + width])
            part = np.zeros((len(tile), width), np.float32)
            part[owner[begin:end], at[begin:end] - lo] = 1
            parts.append(part)
        shared += parts[0] @ parts[1].T
    alike = apart & (100 * shared >= PERCENT * (total - shared))
    found = []
    for k in np.flatnonzero(alike.any(axis=1)):
        i = rows[k]
        near = cols[alike[k]]
        _, first = np.unique(groups[near], return_index=True)
        for j in near[first]:
            if groups[i] != groups[j]:
                groups[groups == groups[j]] = groups[i]
                found.append((i, j))
    return found


def _reach[T: (int, np.ndarray, Column)](shared: T, n_a: T, n_b: T) -> T:
    """Whether sets of at least ``n_a`` and ``n_b`` tokens can link by ``shared`` tokens."""
    return shared * 100 >= (n_a + n_b - shared) * PERCENT


def _block_links(table: pa.Table) -> pa.Table:
    """Of two chunks of a family: links that join its components, no more than it takes.

    Tiles of classes are compared, so memory depends on neither their number nor their links.
    """
    low, high = table["low"][0].as_py(), table["high"][0].as_py()
    classes, chunk = table["class"].to_numpy(), table["chunk"].to_numpy()
    _, groups = np.unique(table["component"].to_numpy(), return_inverse=True)
    lists = table["tokens"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    owner = np.repeat(np.arange(len(classes)), sizes)
    tokens = lists.flatten().to_numpy().view(np.uint64)
    hit, repeated = _spanning(tokens, groups[owner])
    shared = np.bincount(owner[hit], minlength=len(classes))
    place = np.searchsorted(repeated, tokens[hit])
    sets = np.split(place, np.cumsum(shared)[:-1])
    # of similar size and chance stand together, so whole tiles can be left out
    order = np.lexsort((shared, sizes))
    order = order[_reach(shared, sizes, shared)[order]]
    tiles = [
        [own[at : at + TILE] for at in range(0, len(own), TILE)]
        for own in (order[chunk[order] == c] for c in (low, high))
    ]
    found = []
    for a, rows in enumerate(tiles[0]):
        for cols in tiles[1][a if low == high else 0 :]:
            most = min(shared[rows].max(), shared[cols].max())
            if _reach(most, sizes[rows[0]], sizes[cols[0]]):
                found += _tile_links(rows, cols, sets, sizes, groups)
    return pa.table([pa.array([classes[p[k]] for p in found], pa.int64()) for k in (0, 1)], schema=_LINKS)


def _large_families(rows: DataFrame, large: DataFrame) -> DataFrame:
    """``low, high, chunk`` and the classes of every two chunks that may link.

    A class of ``n`` tokens, ``shared`` of which another component of its family has, links by no
    more than ``shared``. Chunks follow (n, shared), rounded so that a family has few such cells,
    and two chunks meet only if their largest ``shared`` and least ``n`` leave a link possible.
    """
    members = rows.join(large.select("family"), "family")
    total = members.agg(F.sum("n")).first()[0] or 0
    packed = members.select("class", "component", "tokens", "family").mapInArrow(
        _sets_packed(_buckets(total)), _PACKED
    )
    members = materialize(
        members.join(_questionable(packed).select("class", "shared"), "class")
        .withColumn("size", F.floor(F.log(F.col("n")) * 20))
        .withColumn("part", F.floor(F.col("shared") * 20 / F.col("n"))),
        "members",
    )
    cells = members.groupBy("family", "size", "part").agg(F.sum(_weight()).alias("weight"))
    earlier = Window.partitionBy("family").orderBy("size", "part").rowsBetween(Window.unboundedPreceding, -1)
    cells = materialize(
        cells.withColumn("before", F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))), "cells"
    )
    within = F.pmod(F.xxhash64("class"), F.lit(1 << 20)) / (1 << 20)
    chunked = members.join(cells, ["family", "size", "part"]).withColumn(
        "chunk", F.floor(F.col("before") + F.col("weight") * within).cast("int")
    )
    chunks = chunked.groupBy("family", "chunk").agg(
        F.min("n").alias("n"), F.max("shared").alias("shared"),
        F.min("component").alias("first"), F.max("component").alias("last"),
    )
    chunks = materialize(chunks, "chunks")
    other = chunks.toDF("family", "high", "n_2", "shared_2", "first_2", "last_2")
    pairs = (
        chunks.withColumnRenamed("chunk", "low")
        .join(other, "family")
        .where("low <= high and least(first, first_2) != greatest(last, last_2)")
        .where(_reach(F.least("shared", "shared_2"), F.col("n"), F.col("n_2")))
        .select("family", "low", "high")
    )
    met = pairs.withColumn("chunk", F.col("low")).union(
        pairs.where("low != high").withColumn("chunk", F.col("high"))
    )
    return chunked.join(met, ["family", "chunk"]).select(*_BLOCK)


_BLOCK = ("family", "low", "high", "chunk", "class", "component", "tokens")


def _weight() -> Column:
    """Share of a chunk that a class takes."""
    return F.col("n") / CHUNK_TOKENS + F.lit(1 / CHUNK_CLASSES)


def _family_links(rows: DataFrame) -> DataFrame:
    """Links across components within families ``(family, class, component, n, tokens)``.

    A family is cut into chunks of about ``CHUNK_TOKENS`` tokens or ``CHUNK_CLASSES`` classes at
    most; two chunks meet in a task and are compared by matrix products, so no pair of classes
    becomes a row.
    """
    size = materialize(
        rows.groupBy("family")
        .agg(
            F.sum(_weight()).alias("weight"),
            F.min("component").alias("first"), F.max("component").alias("last"),
        )
        .where("first != last"),
        "families",
    )
    one = F.lit(0)
    blocks = rows.join(size.where("weight <= 1").select("family"), "family").select(
        "family", one.alias("low"), one.alias("high"), one.alias("chunk"), "class", "component", "tokens"
    )
    large = size.where("weight > 1")
    if not large.isEmpty():
        blocks = blocks.union(_large_families(rows, large))
    return blocks.groupBy("family", "low", "high").applyInArrow(_block_links, "a bigint, b bigint")


def _met_again(entries: DataFrame) -> DataFrame:
    """Classes with a prefix entry that another component of their family has too."""
    meeting = (
        entries.groupBy("family", "token")
        .agg(F.min("component").alias("first"), F.max("component").alias("last"))
        .where("first != last")
        .select("family", "token")
    )
    return entries.join(meeting, ["family", "token"]).select("class").distinct()


def _crossing(index: DataFrame, sets: DataFrame, leaders: DataFrame, found: DataFrame) -> DataFrame:
    """Links between classes in different components that share entries under orders 2 and 3:
    within a family (the classes of one leader, linked with it or not) and between families."""
    named = found.select(F.col("node").alias("class"), "component")
    placed = index.join(named, "class", "left").withColumn("component", F.coalesce("component", "class"))
    spanning = (
        placed.groupBy("token")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low != high")
    )
    near = placed.join(spanning, "token").select("class", "component").distinct()
    near_sets = materialize(near.join(sets, "class").select("class", "component", "tokens"), "near")
    # order 1 again, now against the classes of other components
    total = near_sets.agg(F.sum(F.size("tokens"))).first()[0] or 0
    packed = near_sets.mapInArrow(_sets_packed(_buckets(total)), _PACKED)
    led = leaders.select(F.col("a").alias("class"), F.col("b").alias("leader"))
    heads = led.select("leader").distinct().withColumn("heads", F.lit(True))
    open_sets = materialize(
        near_sets.join(_questionable(packed).drop("shared"), "class")
        .join(led, "class", "left")
        # a class that leads others is of its own family
        .join(heads.withColumnRenamed("leader", "class"), "class", "left")
        .withColumn(
            "family", F.when(F.col("heads"), F.col("class")).otherwise(F.coalesce("leader", "class"))
        )
        .select("family", "class", "component", "n", "tokens"),
        "open",
    )
    tokens = materialize(
        open_sets.select("family", "class", "component", "n", F.explode("tokens").alias("token")),
        "tokens",
    )
    df = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    listed = (
        tokens.join(df, "token")
        .groupBy("family", "class", "component", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("common"))
    )
    # tokens that no other class has come first under this order
    room = _prefix_length(F.col("n")) - (F.col("n") - F.size("common"))
    entries = listed.where(room > 0).select(
        "family", "class", "component", "n",
        F.explode(F.slice(F.col("common")["token"], F.lit(1), room.cast("int"))).alias("token"),
    )
    entries = materialize(entries, "entries")
    again = materialize(open_sets.join(_met_again(entries), "class"), "again")
    within = materialize(_family_links(again), "within")
    # a token's largest family meets the others but is not paired with itself
    most = (
        entries.groupBy("token", "family")
        .count()
        .groupBy("token")
        .agg(F.max(F.struct("count", "family")).alias("most"), F.count(F.lit(1)).alias("families"))
        .where("families > 1")
        .select("token", F.col("most.family").alias("most"))
    )
    ranked = materialize(
        entries.join(most, "token").withColumn("main", F.col("family") == F.col("most")).drop("most"), "ranked"
    )
    other = ranked.select(
        "token", *[F.col(c).alias(f"{c}_2") for c in ("family", "class", "component", "n", "main")]
    )
    pairs = (
        ranked.where("not main")
        .join(other, "token")
        .where("(main_2 or class < class_2) and component != component_2 and family != family_2")
        .where(_sizes_fit(F.col("n"), F.col("n_2")))
        .select(F.least("class", "class_2").alias("a"), F.greatest("class", "class_2").alias("b"))
        .distinct()
    )
    return within.union(_verified(pairs, sets))


def _chosen(docs: DataFrame, holders: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are the holder ``(class, doc_id, hash)`` of a class; several only if
    they have one id and one text. The hash keeps apart texts whose ids are null or alike."""
    few = holders.limit(SENT_ROWS + 1).count() <= SENT_ROWS
    wanted = holders.select(
        F.col("class").alias("__class"), F.col("doc_id").alias("__id"), F.col("hash").alias("__hash")
    )
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (_text_hash() == F.col("__hash"))
    return docs.join(F.broadcast(wanted) if few else wanted, same)


def _text_hash() -> Column:
    return F.xxhash64("text")


def class_components(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """``class, component`` of the classes that link with another one.

    ``docs(doc_id, text)`` are the documents, ``signed(doc_id, hash, class, n)`` their signatures.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    packed = docs.select("text").mapInArrow(_texts_packed(_buckets(size // BYTES_PER_TOKEN)), _PACKED)
    asked = materialize(_questionable(packed).drop("shared"), "questionable")
    holders = (
        signed.join(asked.select("class"), "class")
        .groupBy("class")
        .agg(F.min(F.struct("doc_id", "hash")).alias("held"))
        .select("class", "held.*")
    )
    texts = _chosen(docs, materialize(holders, "holders"))
    sets = materialize(
        texts.select(F.col("__class").alias("class"), _sets(F.col("text"), F.col("__class")).alias("tokens"))
        .groupBy("class")
        .agg(F.first("tokens", ignorenulls=True).alias("tokens"))
        .select("class", F.size("tokens").cast("long").alias("n"), "tokens"),
        "sets",
    )
    entries = sets.select(
        "class", "n", F.explode(F.slice("tokens", F.lit(1), _prefix_length(F.col("n")))).alias("token")
    )
    df = entries.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    index = materialize(entries.join(df, "token"), "index")
    leaders = materialize(_leader_pairs(index), "leaders")
    led = materialize(_verified(leaders, sets), "led")
    crossing = _crossing(index, sets, leaders, components(led))
    return components(led.union(crossing)).select(F.col("node").alias("class"), "component")


def _heads(signed: DataFrame, found: DataFrame) -> DataFrame:
    """``class, head``: the smallest id in the component of each class."""
    grouped = signed.where("class is not null").join(found, "class", "left")
    smallest = grouped.groupBy("class", F.coalesce("component", "class").alias("group")).agg(
        F.min("doc_id").alias("own")
    )
    heads = smallest.groupBy("group").agg(F.min("own").alias("head"))
    return materialize(smallest.join(heads, "group").select("class", "head"), "heads")


def _signed(rows: DataFrame) -> DataFrame:
    named = rows.select("doc_id", _text_hash().alias("hash"), signature("text").alias("s"))
    named = named.select("doc_id", "hash", "s.*")
    return materialize(named, "signed")


def linked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row."""
    rows = id_and_text(docs, doc_id, text)
    signed = _signed(rows)
    by_class = _heads(signed, class_components(rows, signed))
    return signed.join(by_class, "class", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("head")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay when one row of each component does: that of the smallest id (a null
    id is the greatest). Of several rows with that id in the component, one stays. Rows without
    words all stay."""
    rows = id_and_text(docs, doc_id, text)
    signed = _signed(rows)
    found = class_components(rows, signed)
    # the class that holds the smallest id; of several, the one of smallest number
    per_class = (
        signed.where("class is not null")
        .groupBy("class")
        .agg(F.min("doc_id").alias("own"), F.count(F.lit(1)).alias("rows"))
        .join(found, "class", "left")
        .withColumn("group", F.coalesce("component", "class"))
    )
    order = F.struct(F.col("own").isNull(), F.col("own"), F.col("class"), F.col("rows"))
    kept = materialize(
        per_class.groupBy("group").agg(F.min(order).alias("best")).select("best.class", "best.own", "best.rows"),
        "kept",
    )
    few = kept.limit(SENT_ROWS + 1).count() <= SENT_ROWS
    repeated = not kept.where("rows > 1").isEmpty()
    name, kept_name, own, n = unused(docs, "class", "kept", "own", "rows")
    kept = kept.toDF(kept_name, own, n)
    named = docs.withColumn(name, signature(text)["class"])
    joined = named.join(F.broadcast(kept) if few else kept, F.col(name) == F.col(kept_name), "left")
    head = F.col(kept_name).isNotNull() & F.col(doc_id).eqNullSafe(F.col(own))
    out = joined.where(F.col(name).isNull() | (head & (F.col(n) == 1)))
    if repeated:  # several rows of one word sequence: any of those with the smallest id
        out = out.unionByName(joined.where(head & (F.col(n) > 1)).dropDuplicates([name]))
    return out.select(docs.columns)
