"""Centroid clustering with the nearest centroid found by a tournament of bisectors.

Vectors become whole numbers, ``floor(scale * x)`` of every component. The bisector of two
centroids is a plane with a whole-number normal and threshold, so the side a vector lies on is the
sign of an exact dot product, zero favouring the centroid of smaller number. For ``k`` centroids all
``k (k - 1) / 2`` planes are computed once per round; a vector then meets centroid after centroid,
keeps the winner of each test and has its nearest after ``k - 1`` of them. Only the distance to
that one is computed. Rounds sum components per centroid within each task; what leaves a task is a
few numbers per centroid, whatever the number of vectors, so one vector repeated very often costs
nothing extra. The centroids (``k`` vectors) are the only thing sent to every task.

Vectors take part if they have exactly ``dimensions`` components, none null or non-finite; others
give no row. Rows of one id are rows of their own, a null id hashes as empty text. With fewer
vectors than ``k`` there are fewer centroids; an empty table gives an empty result. Numbers beyond
``EXACT`` go through Python integers; a distance or inertia beyond 64 bits is null.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwright.session import materialize

#: Products and sums of 64-bit integers stay exact while components are at most this large.
EXACT = 1 << 24
#: Vectors compared at once.
BLOCK = 4096
LONG = (1 << 63) - 1

Centroid = tuple[int, ...]


@dataclass(frozen=True)
class Clustering:
    """How many centroids, how many rounds, and how vectors become whole numbers."""

    centroids: int = 16
    rounds: int = 3
    dimensions: int = 64
    scale: int = 64
    seed: int = 1


def whole_numbers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)``: 64-bit integers, or Python integers where some are beyond ``EXACT``."""
    scaled = vectors.astype(np.float64) * scale
    if np.abs(scaled).max(initial=0) <= EXACT:
        return np.floor(scaled).astype(np.int64)
    exact = [[math.floor(scale * int(x)) if x.is_integer() else math.floor(x * scale) for x in row]
             for row in vectors.astype(np.float64).tolist()]
    return np.array(exact, object).reshape(vectors.shape)


class Bisectors:
    """Normals and thresholds of the planes half-way between every two centroids.

    A vector x is nearer to centroid j than to centroid i if ``normal[i, j] . x > threshold[i, j]``,
    where the normal is 2 (c_j - c_i) and the threshold |c_j|**2 - |c_i|**2.
    """

    def __init__(self, centroids: list[Centroid]):
        small = all(abs(x) <= EXACT for c in centroids for x in c)
        self.centroids = np.array(centroids, np.int64 if small else object)
        self.normal = 2 * (self.centroids[None, :, :] - self.centroids[:, None, :])
        length = (self.centroids * self.centroids).sum(axis=1)
        self.threshold = length[None, :] - length[:, None]

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid of each vector, and the squared distance to it."""
        winner = np.zeros(len(vectors), np.int64)
        exact = vectors.dtype == object or self.centroids.dtype == object
        for challenger in range(1, len(self.centroids)):
            normal = self.normal[winner, challenger]
            if exact:
                side = (normal.astype(object) * vectors.astype(object)).sum(axis=1)
            else:
                side = np.einsum("nd,nd->n", normal, vectors)
            winner[(side > self.threshold[winner, challenger]).astype(bool)] = challenger
        gap = vectors - self.centroids[winner]
        return winner, (gap * gap).sum(axis=1)


def _limbs(number: int) -> Iterator[tuple[int, int]]:
    """A whole number of any size as ``(place, digit)`` to the base 2**32, the last digit signed."""
    place = 0
    while not -(1 << 31) <= number < 1 << 31:
        yield place, number & 0xFFFFFFFF
        number >>= 32
        place += 1
    yield place, number


def _number(limbs: list[tuple[int, int]]) -> int:
    return sum(int(digit) << 32 * place for place, digit in limbs)


def _blocks(batch: pa.RecordBatch, plan: Clustering) -> Iterator[tuple[int, np.ndarray]]:
    """Whole-number vectors of a batch, some at a time, and where each block begins."""
    values = batch.column(batch.num_columns - 1).flatten().to_numpy()
    vectors = values.reshape(batch.num_rows, plan.dimensions)
    for at in range(0, len(vectors), BLOCK):
        yield at, whole_numbers(vectors[at : at + BLOCK], plan.scale)


def kept_vectors(vectors: DataFrame, plan: Clustering, key: str, value: str) -> DataFrame:
    """``key, vector`` of the vectors that take part."""
    sound = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.col(value).isNotNull() & (F.size(value) == plan.dimensions) & sound
    return vectors.where(whole).select(F.col(key).alias("key"), F.col(value).alias("vector"))


def first_centroids(kept: DataFrame, plan: Clustering) -> list[Centroid]:
    """The vectors whose ids have the smallest hashes, in their order; equal hashes by vector."""
    name = F.coalesce(F.col("key").cast("string"), F.lit(""))
    drawn = F.sha2(F.concat(F.lit(f"{plan.seed}:"), name), 256)
    rows = kept.select(drawn.alias("h"), "vector").orderBy("h", "vector").limit(plan.centroids)
    vectors = [r["vector"] for r in rows.collect()]
    if not vectors:
        return []
    return [tuple(map(int, v)) for v in whole_numbers(np.array(vectors, np.float64), plan.scale)]


def _sums(kept: DataFrame, centroids: list[Centroid], plan: Clustering) -> dict[int, Centroid]:
    """For each centroid that has vectors, the floored mean of their components."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = Bisectors(centroids)
        counts = [0] * len(centroids)
        totals = [[0] * plan.dimensions for _ in centroids]
        for batch in batches:
            for _, block in _blocks(batch, plan):
                winner, _ = planes.nearest(block)
                for c in np.unique(winner).tolist():
                    own = block[winner == c]
                    counts[c] += len(own)
                    totals[c] = [a + int(b) for a, b in zip(totals[c], own.sum(axis=0), strict=True)]
        rows = [
            (c, d, place, digit)
            for c, total in enumerate(totals)
            if counts[c]
            for d, number in enumerate([*total, counts[c]])
            for place, digit in _limbs(number)
        ]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        names = ["cluster", "component", "place", "digit"]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    partial = kept.select("vector").mapInArrow(
        add, "cluster bigint, component bigint, place bigint, digit bigint"
    )
    exact = F.sum(F.col("digit").cast("decimal(20,0)"))
    found: dict[tuple[int, int], list[tuple[int, int]]] = {}
    # at most centroids x (dimensions + 1) x (digits of the largest number) rows
    for c, d, place, digit in partial.groupBy("cluster", "component", "place").agg(exact).collect():
        found.setdefault((c, d), []).append((place, digit))
    numbers = {at: _number(limbs) for at, limbs in found.items()}
    return {
        c: tuple(numbers[c, d] // numbers[c, plan.dimensions] for d in range(plan.dimensions))
        for c in {c for c, _ in numbers}
    }


def assigned(kept: DataFrame, centroids: list[Centroid], plan: Clustering) -> DataFrame:
    """``key, cluster, distance`` of every vector; a distance beyond 64 bits is null."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = Bisectors(centroids)
        for batch in batches:
            for at, block in _blocks(batch, plan):
                winner, distance = planes.nearest(block)
                held = [int(d) if d <= LONG else None for d in distance.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(block)), pa.array(winner, pa.int32()), pa.array(held, pa.int64())],
                    ["key", "cluster", "distance"],
                )

    kind = kept.schema["key"].dataType.simpleString()
    return kept.mapInArrow(nearest, f"key {kind}, cluster int, distance bigint")


def cluster(
    vectors: DataFrame, key: str = "vec_id", value: str = "embedding", plan: Clustering | None = None
) -> tuple[DataFrame, list[Centroid]]:
    """``key, cluster, distance`` of the vectors that take part (a stored frame), and the centroids."""
    plan = plan or Clustering()
    kept = kept_vectors(vectors, plan, key, value)
    centroids = first_centroids(kept, plan)
    for _ in range(plan.rounds if centroids else 0):
        moved = _sums(kept, centroids, plan)
        centroids = [moved.get(number, c) for number, c in enumerate(centroids)]
    if not centroids:
        nothing = kept.select("key", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"))
        return nothing.limit(0), []
    return materialize(assigned(kept, centroids, plan), "clusters"), centroids


def _name(centroid: Centroid) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def with_inertia(rows: DataFrame, centroids: list[Centroid]) -> DataFrame:
    """Adds ``cluster_inertia, inertia, centroid_sha256``; there are as many sums as centroids."""
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    beyond = F.count_if(F.col("distance").isNull())
    sums = {c: None if n else int(s) for c, s, n in rows.groupBy("cluster").agg(exact, beyond).collect()}
    whole = None if None in sums.values() else sum(sums.values())

    def long(number: int | None) -> Column:
        return F.lit(number if number is not None and number <= LONG else None).cast("bigint")

    def listed(values: list[Column], kind: str) -> Column:
        return F.get(F.array(*values) if values else F.array().cast(f"array<{kind}>"), F.col("cluster"))

    numbers = range(len(centroids))
    return rows.withColumns(
        {
            "cluster_inertia": listed([long(sums.get(c, 0)) for c in numbers], "bigint"),
            "inertia": long(whole),
            "centroid_sha256": listed([F.lit(_name(c)) for c in centroids], "string"),
        }
    )
