"""Every packed row of one frame with every packed row of another, and what is left of it.

Rows that hold thousands of vectors each are compared pair by pair where they lie: a task takes one
row of the left side, reads the rows of the right side one after the other and keeps the best of each
query. Neither side is copied per pair, so disk grows with the vectors and not with the pairs, and
memory is bounded by a few packed rows.

Packed rows are stored a file each and read a file per partition. Pairs come in the order of the left
rows where files lie on no particular host; in another order some lists are cut into parts, which the
caller puts together anyway.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession

from cartwright.session import materialize, with_settings

TASKS_PER_CORE = 3
LEAST_CHUNK, LARGEST_CHUNK = 1_024, 16_384  # queries of a packed row
HELD_CHUNKS = 4  # whose lists a task keeps at once
# a partition is full with one file, however small
_FILE_PER_PARTITION = {
    "spark.sql.files.maxPartitionBytes": str(1 << 30),
    "spark.sql.files.openCostInBytes": str(1 << 30),
    "spark.sql.files.minPartitionNum": "1",
}


def file_per_row(spark: SparkSession):
    """While packed rows are stored: one to a file."""
    return with_settings(spark, {"spark.sql.files.maxRecordsPerFile": "1"})


def chunk_rows(spark: SparkSession, n: int) -> int:
    """How many of n queries make a packed row: every core gets some, none gets too many."""
    share = math.ceil(n / (TASKS_PER_CORE * spark.sparkContext.defaultParallelism))
    return max(LEAST_CHUNK, min(LARGEST_CHUNK, share))


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of a task again, at least so many and less than twice as many at once, if there are."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        while sum(b.num_rows for b in held) >= 2 * rows:
            whole = pa.Table.from_batches(held)
            yield whole.slice(0, rows).combine_chunks().to_batches()[0]
            held = whole.slice(rows).to_batches()
    if any(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def one(values: pa.Array) -> pa.ListArray:
    """All values as one packed entry."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def meet(left: DataFrame, right: DataFrame, wanted: Column | None, work: Callable, schema, label: str) -> DataFrame:
    """``work`` over the stored pairs of rows that are ``wanted`` (all, if None), itself stored.

    The condition only spares reading; ``work`` is a ``mapInArrow`` function over left columns, then
    right ones.
    """
    spark = left.sparkSession
    other = right.hint("shuffle_replicate_nl")
    pairs = left.crossJoin(other) if wanted is None else left.join(other, wanted)
    tasks = max(left.count(), TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    with with_settings(spark, _FILE_PER_PARTITION):
        return materialize(pairs.coalesce(tasks).mapInArrow(work, schema), label)


class Nearest:
    """The k best items so far of each of n queries; ties to the smaller id."""

    def __init__(self, n: int, k: int, floors: np.ndarray | None = None, distinct: bool = False):
        self.n, self.k, self.distinct = n, k, distinct
        self.floors = np.full(n, -2.0) if floors is None else floors.astype(float)
        self.query = np.empty(0, np.int64)
        self.item: np.ndarray | None = None
        self.similarity = np.empty(0)

    def add(self, query: np.ndarray, item: np.ndarray, similarity: np.ndarray) -> None:
        near = similarity >= self.floors[query]
        query, item, similarity = query[near], item[near], similarity[near]
        if not len(query):
            return
        if self.item is None:
            self.item = item[:0]
        touched = np.zeros(self.n, bool)
        touched[query] = True
        mine = touched[self.query]
        q = np.concatenate([self.query[mine], query])
        i = np.concatenate([self.item[mine], item])
        s = np.concatenate([self.similarity[mine], similarity])
        place = np.unique(i, return_inverse=True)[1] if i.dtype == object else i
        order = np.lexsort((place, -s, q))
        if self.distinct:
            a, b = order[1:], order[:-1]
            order = order[np.append(True, (q[a] != q[b]) | (s[a] != s[b]) | (place[a] != place[b]))]
        q, i, s = q[order], i[order], s[order]
        counts = np.bincount(q, minlength=self.n)
        rank = np.arange(len(q)) - (np.cumsum(counts) - counts)[q]
        last = rank == self.k - 1
        self.floors[q[last]] = np.maximum(self.floors[q[last]], s[last])
        kept = rank < self.k
        self.query = np.concatenate([self.query[~mine], q[kept]])
        self.item = np.concatenate([self.item[~mine], i[kept]])
        self.similarity = np.concatenate([self.similarity[~mine], s[kept]])

    def rows(self, ids: pa.Array, item_type: pa.DataType, names: list[str]) -> Iterator[pa.RecordBatch]:
        if self.item is not None and len(self.query):
            columns = [ids.take(pa.array(self.query)), pa.array(self.item, item_type), pa.array(self.similarity)]
            yield pa.RecordBatch.from_arrays(columns, names)


def by_chunk(opened: Callable, closed: Callable) -> Callable:
    """A ``mapInArrow`` function over pairs, whose first column tells the left row.

    ``opened(batch, r)`` makes what a task keeps of a left row; called with ``(batch, r)`` that meets
    the right row, and ``closed`` gives its batches when the task is done with it.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict = OrderedDict()
        for batch in batches:
            for r in range(batch.num_rows):
                name = batch.column(0)[r].as_py()
                if name not in held:
                    if len(held) >= HELD_CHUNKS:
                        yield from closed(held.popitem(last=False)[1])
                    held[name] = opened(batch, r)
                held.move_to_end(name)
                held[name](batch, r)
        for chunk in held.values():
            yield from closed(chunk)

    return work
