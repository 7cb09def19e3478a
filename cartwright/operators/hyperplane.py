"""Approximate cosine top-k by hyperplane signatures with several probes, scored exactly.

The sides of random hyperplanes a vector lies on are the bits of its signature; vectors at a small
angle share most of them. Each of ``tables`` sets of planes deals the items into buckets by signature.
A query looks into its own bucket and into those that differ in the bits it is least sure of, the
planes it lies nearest to, the least sum of squared distances first. What stands in these buckets is
compared exactly; the score of a result is its true similarity, only that a near one may be missed.

Vectors that point the same way are indexed once, so copies fill no bucket. Buckets are cut into
blocks of bounded size, packed one to a row. A few queries travel to them packed by bucket, shared out by
the join. More are packed into chunks, and a task reads the blocks of all buckets for one chunk after the
other, as a copy of a query for every bucket it looks into would fill disks. No pair of vectors becomes
a row. The number of bits follows the number of items, so buckets stay about as large at every size.

Zero vectors have no direction: they neither ask nor answer, nor do vectors that are missing or of
another length than most. Ids are distinct.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartwright.operators.blockwise import Nearest, by_chunk, chunk_rows, file_per_row, gathered, meet, one
from cartwright.operators.similarity import direction
from cartwright.session import materialize

BLOCK_ROWS = 4096
QUERY_TILE = 256
JOINED_ROWS = 2_048  # queries that are copied to the buckets they look into
PACK_BYTES = 8 << 20  # of the blocks of buckets that are read together
CHUNK_BYTES = 32 << 20  # of the query vectors of a chunk
_DIGITS = 1e10
_ROOM = 1 << 20


@dataclass(frozen=True)
class Planes:
    """How signatures are made: tables, bits of each, buckets a query looks into per table."""

    tables: int = 8
    probes: int = 24
    bucket: int = 256  # items of a bucket, about
    bits: int | None = None
    seed: int = 1

    def with_bits(self, n: int) -> Planes:
        bits = self.bits or max(1, min(30, math.ceil(math.log2(max(2, n / self.bucket)))))
        return Planes(self.tables, self.probes, self.bucket, bits, self.seed)

    def normals(self, dimensions: int) -> np.ndarray:
        """(table, bit, dimension), the same in every task."""
        rng = np.random.default_rng([self.seed, self.bits, dimensions])
        return rng.standard_normal((self.tables, self.bits, dimensions))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)


def _signatures(vectors: np.ndarray, normals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (row, table), and the distances to the planes (row, table, bit)."""
    away = np.einsum("nd,tbd->ntb", vectors, normals)
    powers = 1 << np.arange(normals.shape[1])
    return ((away > 0) * powers).sum(axis=2), away


def probe_sets(bits: int, probes: int) -> np.ndarray:
    """Sets of flipped bits as masks over the bits in order of doubt, likeliest to help first.

    The r-th most doubtful plane is taken to cost r (r + 1): a fixed order that needs no search
    per query.
    """
    sets: list[tuple[int, int]] = [(0, 0)]
    for r in range(bits):
        sets += [(cost + (r + 1) * (r + 2), mask | 1 << r) for cost, mask in sets]
        sets = sorted(sets)[: 4 * probes]
    return np.array([mask for _, mask in sorted(sets)[:probes]], np.int64)


def probed(signature: np.ndarray, away: np.ndarray, probes: int) -> np.ndarray:
    """(row, probe) signatures of one table: the own one first, then by rising doubt."""
    bits = away.shape[1]
    order = np.argsort(np.abs(away), axis=1)
    masks = probe_sets(bits, min(probes, 1 << bits))
    flips = np.zeros((len(away), len(masks)), np.int64)
    for r in range(bits):
        chosen = (masks >> r & 1).astype(bool)
        flips[:, chosen] |= (1 << order[:, r])[:, None]
    return signature[:, None] ^ flips


def _dealt(rows: DataFrame, planes: Planes, dimensions: int, looking: bool) -> DataFrame:
    """``bucket, ids, vecs``: the rows of a task that belong to each bucket, packed."""
    kind = rows.schema["id"].dataType.simpleString()
    out = f"bucket bigint, ids array<{kind}>, vecs array<array<double>>"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normals = planes.normals(dimensions)
        for batch in batches:
            signature, away = _signatures(_matrix(batch.column(1)), normals)
            for t in range(planes.tables):
                if looking:
                    seen = probed(signature[:, t], away[:, t], planes.probes)
                else:
                    seen = signature[:, t : t + 1]
                bucket = (seen << 8 | t).ravel()
                row = np.repeat(np.arange(len(seen)), seen.shape[1])
                order = np.argsort(bucket, kind="stable")
                names, begin = np.unique(bucket[order], return_index=True)
                sizes = np.diff(np.append(begin, len(order)))
                chosen = pa.array(row[order])
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                columns = [
                    pa.ListArray.from_arrays(offsets, batch.column(c).take(chosen)) for c in (0, 1)
                ]
                # some buckets at a time, so that no batch grows with the number of probes
                for at in range(0, len(names), 512):
                    part = slice(at, at + 512)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[part]), *[c.slice(at, 512) for c in columns]], ["bucket", "ids", "vecs"]
                    )

    return rows.select("id", "vec").mapInArrow(deal, out)


def _blocks(dealt: DataFrame) -> DataFrame:
    """Packed parts of a bucket put together into blocks of about ``BLOCK_ROWS``."""
    sized = dealt.withColumn("at", F.sum(F.size("ids")).over(
        Window.partitionBy("bucket").orderBy(F.xxhash64("ids")).rowsBetween(Window.unboundedPreceding, -1)
    ))
    block = F.floor(F.coalesce("at", F.lit(0)) / BLOCK_ROWS)
    return sized.groupBy("bucket", block.alias("block")).agg(
        F.flatten(F.collect_list("ids")).alias("item_ids"), F.flatten(F.collect_list("vecs")).alias("item_vecs")
    )


def _compared(visits: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """``query, item, similarity``: the k best of each query in each block it looks into."""
    kinds = [f.schema[c].dataType.elementType.simpleString() for f, c in ((visits, "ids"), (blocks, "item_ids"))]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, vecs, items, item_vecs = (batch.column(c)[r].values for c in range(4))
                order = pc.sort_indices(items)
                items, right = items.take(order), _matrix(item_vecs.take(order))
                left = _matrix(vecs)
                for top in range(0, len(left), QUERY_TILE):
                    q, i, s = _best(left[top : top + QUERY_TILE], right, k)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(top + q)), items.take(pa.array(i)), pa.array(s)],
                        ["query", "item", "similarity"],
                    )

    # the planner takes visits for as small as the vectors they are made of, a copy for every probe
    # more: merged by bucket, neither side is ever sent through the driver
    met = visits.join(blocks.hint("merge"), "bucket").select("ids", "vecs", "item_ids", "item_vecs")
    return met.mapInArrow(compare, f"query {kinds[0]}, item {kinds[1]}, similarity double")


def _packs(blocks: DataFrame) -> DataFrame:
    """``buckets, sizes, item_ids, item_vecs``: blocks put together, each in the order of its ids."""
    kind = blocks.schema["item_ids"].dataType.elementType.simpleString()

    def put(held: list[tuple[int, pa.Array, bytes]]) -> pa.RecordBatch:
        names, ids, vecs = zip(*held, strict=True)
        sizes = pa.array([len(i) for i in ids], pa.int32())
        columns = [one(pa.array(names, pa.int64())), one(sizes), one(pa.concat_arrays(ids)), pa.array([b"".join(vecs)])]
        return pa.RecordBatch.from_arrays(columns, ["buckets", "sizes", "item_ids", "item_vecs"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, pa.Array, bytes]] = []
        size = 0
        for batch in batches:
            for r in range(batch.num_rows):
                ids, vecs = batch.column(1)[r].values, batch.column(2)[r].values
                order = pc.sort_indices(ids)
                held.append((batch.column(0)[r].as_py(), ids.take(order), _matrix(vecs.take(order)).tobytes()))
                size += len(held[-1][2])
                if size >= PACK_BYTES:
                    yield put(held)
                    held, size = [], 0
        if held:
            yield put(held)

    kinds = f"buckets array<bigint>, sizes array<int>, item_ids array<{kind}>, item_vecs binary"
    return blocks.select("bucket", "item_ids", "item_vecs").mapInArrow(pack, kinds)


def _chunks(heads: DataFrame, n: int, dimensions: int) -> DataFrame:
    """``chunk, ids, vecs``: queries packed."""
    kind = heads.schema["id"].dataType.simpleString()
    rows = max(1, min(chunk_rows(heads.sparkSession, n), CHUNK_BYTES // (8 * dimensions)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(batches, rows):
            vecs = pa.array([_matrix(part.column(1)).tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([one(part.column(0)), vecs], ["ids", "vecs"])

    dealt = heads.select("id", "vec").repartition(max(1, math.ceil(n / rows)), "id")
    packed = dealt.mapInArrow(pack, f"ids array<{kind}>, vecs binary")
    return packed.select(F.monotonically_increasing_id().alias("chunk"), "*")


def _streamed(chunks: DataFrame, packs: DataFrame, planes: Planes, dimensions: int, k: int) -> DataFrame:
    """``query, item, similarity``: the k best of each query among the buckets it looks into."""
    kinds = [f.schema[c].dataType.elementType.simpleString() for f, c in ((chunks, "ids"), (packs, "item_ids"))]

    class Chunk:
        def __init__(self, batch: pa.RecordBatch, r: int):
            self.ids = batch.column(1)[r].values
            self.vectors = np.frombuffer(batch.column(2)[r].as_buffer(), np.float64).reshape(len(self.ids), -1).copy()
            self.best, self.item_type = Nearest(len(self.ids), k, distinct=True), None
            # per table the buckets looked into, rising, and who looks
            self.looks = []
            for t, normals in enumerate(planes.normals(dimensions)):
                away = np.einsum("nd,bd->nb", self.vectors, normals)
                own = ((away > 0) * (1 << np.arange(normals.shape[0]))).sum(axis=1)
                seen = probed(own, away, planes.probes)
                bucket = (seen << 8 | t).ravel()
                order = np.argsort(bucket, kind="stable")
                self.looks.append((bucket[order], (order // seen.shape[1]).astype(np.int32)))

        def __call__(self, batch: pa.RecordBatch, r: int) -> None:
            buckets, sizes, items = (batch.column(c)[r].values for c in (3, 4, 5))
            self.item_type = items.type
            buckets, ends = buckets.to_numpy(), np.cumsum(sizes.to_numpy())
            vectors = np.frombuffer(batch.column(6)[r].as_buffer(), np.float64).reshape(len(items), -1)
            found = []
            for bucket, end, size in zip(buckets.tolist(), ends.tolist(), sizes.to_numpy().tolist(), strict=True):
                names, rows = self.looks[bucket & 255]
                low, high = np.searchsorted(names, bucket), np.searchsorted(names, bucket, "right")
                right = vectors[end - size : end]
                for top in range(low, high, QUERY_TILE):
                    own = rows[top : min(top + QUERY_TILE, high)]
                    q, i, s = _best(self.vectors[own], right, k)
                    near = s >= self.best.floors[own[q]]
                    found.append((own[q][near], i[near] + end - size, s[near]))
            if found:
                q, i, s = (np.concatenate(x) for x in zip(*found, strict=True))
                self.best.add(q, items.to_numpy(zero_copy_only=False)[i], s)

    def closed(chunk: Chunk) -> Iterator[pa.RecordBatch]:
        return chunk.best.rows(chunk.ids, chunk.item_type, ["query", "item", "similarity"])

    schema = f"query {kinds[0]}, item {kinds[1]}, similarity double"
    return meet(chunks, packs, None, by_chunk(Chunk, closed), schema, "plane_found")


def _best(queries: np.ndarray, items: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, item, similarity of each query's k best; ties to the earlier item."""
    scale = np.sqrt(np.outer((queries * queries).sum(axis=1), (items * items).sum(axis=1)))
    keys = np.rint(queries @ items.T / scale * _DIGITS).astype(np.int64) * _ROOM
    keys += _ROOM - 1 - np.arange(len(items))
    if keys.shape[1] > k:
        keys = np.partition(keys, keys.shape[1] - k, axis=1)[:, -k:]
    rows = np.repeat(np.arange(len(keys)), keys.shape[1])
    flat = keys.ravel()
    return rows, _ROOM - 1 - flat % _ROOM, (flat // _ROOM) / _DIGITS


def nearest_others(vectors: DataFrame, k: int, planes: Planes | None = None) -> DataFrame:
    """``id, place, neighbour, similarity``: of every vector up to k others found to be nearest.

    ``vectors`` has ``id`` and ``vec`` (an array of doubles).
    """
    planes = planes or Planes()
    whole = vectors.where(F.col("id").isNotNull() & F.exists("vec", lambda x: x != 0)).where(
        F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    common = whole.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    dimensions = common["n"] if common else 1
    pointed = whole.where(F.size("vec") == dimensions).select("id", "vec", direction(F.col("vec")).alias("direction"))
    firsts = Window.partitionBy("direction").orderBy("id")
    # of one direction only the first k + 1 ids can be results, and one asks for all
    kept = pointed.withColumn("at", F.row_number().over(firsts)).where(F.col("at") <= k + 1)
    kept = materialize(kept, "kept_directions")
    heads = materialize(kept.where("at = 1").select("id", "vec", "direction"), "directions")
    n = heads.count()
    planes = planes.with_bits(n)
    blocks = _blocks(_dealt(heads, planes, dimensions, False))
    if n <= JOINED_ROWS:
        blocks = materialize(blocks, "plane_buckets")
        near = _compared(_dealt(heads, planes, dimensions, True), blocks, k + 1)
    else:
        with file_per_row(heads.sparkSession):
            packs = materialize(_packs(blocks), "plane_buckets")
            chunks = materialize(_chunks(heads, n, dimensions), "plane_queries")
        near = _streamed(chunks, packs, planes, dimensions, k + 1)
    near = near.distinct()  # found in several tables
    best = Window.partitionBy("query").orderBy(F.desc("similarity"), "item")
    found = near.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1)
    # back from directions to the ids that have them
    item_of = heads.select(F.col("id").alias("item"), F.col("direction").alias("item_direction"))
    members = kept.select(F.col("direction").alias("item_direction"), F.col("id").alias("neighbour"))
    listed = found.join(item_of, "item").join(members, "item_direction").select("query", "similarity", "neighbour")
    entry = F.struct((-F.col("similarity")).alias("far"), F.col("neighbour").alias("id"))
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour")
    lists = (
        listed.withColumn("at", F.row_number().over(order))
        .where(F.col("at") <= k + 1)
        .groupBy(F.col("query").alias("head"))
        .agg(F.sort_array(F.collect_list(entry)).alias("near"))
    )
    asked = heads.select(F.col("id").alias("head"), "direction").join(lists, "head").select("direction", "near")
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)
    return (
        pointed.select("id", "direction")
        .join(asked, "direction")
        .select("id", F.posexplode(others).alias("at", "n"))
        .select("id", (F.col("at") + 1).alias("place"), F.col("n.id").alias("neighbour"), (-F.col("n.far")).alias("similarity"))
    )
