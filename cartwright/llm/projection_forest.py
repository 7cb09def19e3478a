"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

**Index.** Each tree halves a bounded sample (``Plan.sample_numbers`` numbers in all) at the median of its projections on
the direction between two random members, down to leaves that hold about ``Plan.leaf`` vectors of the whole
table; the sample decides nothing but the trees' planes. All vectors then fall into a leaf of every tree.
Inner products become distances by one further component that evens the lengths out.

**Search.** One priority queue serves all trees of a query: the next leaf is the one whose path
crosses planes by the least margin. The first ``Plan.probes`` leaves give a distance within which
the answer lies. The search goes on through the leaves whose margin is at most
``Plan.reach`` times the typical projection of that distance: few for a query in a dense spot, many for
one without near neighbours, where no index can tell the nearest from the rest. Found candidates
are ranked by exact inner products of the original vectors in double precision.

Equal vectors are one item with its smallest ``k + 1`` ids, which is all that a list of ``k`` can use, so no copy is
compared twice and no leaf grows with copies. Vectors that are null, zero or hold a null or non-finite component, rows
without an id, and vectors of another length than the commonest take no part. Rows of one id
are that id's own and never each other's neighbours. An empty table gives an empty result. Leaves
that many queries visit, and leaves over ``Plan.most_items``, are shared out over tasks.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwright.llm import sampling
from cartwright.session import materialize


@dataclass(frozen=True)
class Plan:
    trees: int = 4
    leaf: int = 512  # vectors in a leaf, about
    probes: int = 6
    reach: float = 0.9
    sample_numbers: int = 4_000_000
    sample_leaf: int = 8  # sample members that a leaf needs
    most_items: int = 4096  # vectors compared at once in a task
    most_visits: int = 20_000  # queries compared at once in a task
    seed: int = 5


@dataclass
class Forest:
    """Planes of complete trees: node i has the children 2 i + 1 and 2 i + 2."""

    planes: np.ndarray  # (trees, nodes, dimensions + 1)
    cuts: np.ndarray  # (trees, nodes)
    depth: int
    top: float  # greatest squared length
    spread: float  # effective dimension

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree: (trees, vectors)."""
        rest = np.sqrt(np.maximum(self.top - (vectors**2).sum(axis=1), 0))
        longer = np.concatenate([vectors, rest[:, None]], axis=1)
        out = np.zeros((len(self.planes), len(vectors)), np.int64)
        for t in range(len(self.planes)):
            node = np.zeros(len(vectors), np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", longer, self.planes[t][node]) > self.cuts[t][node]
                node = 2 * node + 1 + side
            out[t] = node - ((1 << self.depth) - 1)
        return out

    def queue(self, query: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """Leaves of all trees as (margin, tree, leaf), the least margin first."""
        longer = np.append(query, 0.0)
        margins = self.planes @ longer - self.cuts
        inner = (1 << self.depth) - 1
        waiting = [(0.0, t, 0) for t in range(len(self.planes))]
        while waiting:
            crossed, t, node = heapq.heappop(waiting)
            while node < inner:
                m = float(margins[t, node])
                near, far = (2 * node + 2, 2 * node + 1) if m > 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(waiting, (max(crossed, abs(m)), t, far))
                node = near
            yield crossed, t, node - inner


def build(sample: np.ndarray, items: int, plan: Plan) -> Forest:
    """Trees over the sample for a table of ``items`` vectors."""
    lengths = (sample**2).sum(axis=1)
    top = float(lengths.max())
    longer = np.concatenate([sample, np.sqrt(np.maximum(top - lengths, 0))[:, None]], axis=1)
    values = np.maximum(np.linalg.eigvalsh(np.cov(longer.T)), 0) if len(sample) > 1 else np.ones(1)
    spread = float(values.sum() ** 2 / max((values**2).sum(), 1e-30)) or 1.0
    wanted = max(1.0, min(items / plan.leaf, len(sample) / plan.sample_leaf))
    depth = math.ceil(math.log2(wanted))
    nodes = (1 << depth) - 1
    planes = np.zeros((plan.trees, nodes, longer.shape[1]))
    cuts = np.zeros((plan.trees, nodes))
    for t in range(plan.trees):
        rng = np.random.default_rng([plan.seed, t])
        members = {0: np.arange(len(sample))}
        for node in range(nodes):
            own = members.pop(node)
            plane = np.zeros(longer.shape[1])
            if len(own) > 1:
                a, b = rng.choice(len(own), 2, replace=False)
                plane = longer[own[a]] - longer[own[b]]
            size = np.linalg.norm(plane)
            if size == 0:
                plane = rng.standard_normal(longer.shape[1])
                size = np.linalg.norm(plane)
            planes[t, node] = plane / size
            along = longer[own] @ planes[t, node]
            cuts[t, node] = np.median(along) if len(own) else 0.0
            members[2 * node + 1] = own[along <= cuts[t, node]]
            members[2 * node + 2] = own[along > cuts[t, node]]
    return Forest(planes, cuts, depth, top, max(spread, 1.0))


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    odd = F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )
    return vector.isNotNull() & ~odd & F.exists(vector, lambda x: x != 0)


def _add_square(total: Column, x: Column) -> Column:
    return total + x.cast("double") * x.cast("double")


def distinct_vectors(rows: DataFrame, k: int, queries: Column) -> tuple[DataFrame, DataFrame]:
    """``item, vector, ids`` per distinct vector (its smallest id, its smallest k + 1 ids), and
    ``query, item`` of the rows that ask. Only k + 1 ids per vector and task are shuffled."""
    order = Window.partitionBy("vector").orderBy("id")
    ranked = rows.select("vector", "id").distinct().withColumn("nth", F.row_number().over(order))
    items = (
        ranked.where(F.col("nth") <= k + 1)
        .groupBy("vector")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .select(F.col("ids")[0].alias("item"), "vector", "ids")
    )
    asking = rows.where(queries).select("vector", F.col("id").alias("query")).distinct()
    return items, asking


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0)
    return lists.flatten().to_numpy().astype(np.float64).reshape(len(lists), -1)


def _placed(items: DataFrame, forest: Forest, chunks: int) -> DataFrame:
    """Each item in its leaf of every tree."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            item = batch.column(0).to_numpy()
            leaf = forest.leaves(_matrix(pa.chunked_array([batch.column(1)])))
            for t in range(len(leaf)):
                n = len(item)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, t, np.int32)), pa.array(leaf[t]), pa.array((item % chunks).astype(np.int32)),
                     batch.column(0), batch.column(1)],
                    names=["tree", "leaf", "chunk", "item", "vector"],
                )

    kind = items.schema["vector"].dataType.simpleString()
    return items.select("item", "vector").mapInArrow(
        place, f"tree int, leaf bigint, chunk int, item bigint, vector {kind}"
    )


def _visits(queries: DataFrame, forest: Forest, plan: Plan, chunks: int, first: bool) -> DataFrame:
    """Leaves to search: the first few, or with ``queries(..., bound)`` the further ones in reach."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.to_pydict()
            for at, query in enumerate(columns["asker"]):
                vector = np.array(columns["vector"][at])
                reach = math.inf
                if not first and columns["bound"][at] is not None:
                    near = (vector**2).sum() + forest.top - 2 * columns["bound"][at]
                    reach = plan.reach * math.sqrt(max(0.0, near) / forest.spread)
                found = []
                for n, (margin, tree, leaf) in enumerate(forest.queue(vector)):
                    if (first and n >= plan.probes) or margin > reach:
                        break
                    if first or n >= plan.probes:
                        found += [(tree, leaf, c) for c in range(chunks)]
                if found:
                    tree, leaf, chunk = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(tree, pa.int32()), pa.array(leaf, pa.int64()), pa.array(chunk, pa.int32()),
                         pa.array([query] * len(found), pa.int64())],
                        names=["tree", "leaf", "chunk", "asker"],
                    )

    found = queries.select("asker", "vector", "bound").mapInArrow(
        walk, "tree int, leaf bigint, chunk int, asker bigint"
    )
    return materialize(found, "visits")


_FOUND = pa.schema([("asker", pa.int64()), ("items", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])


def _compared(
    visits: DataFrame, askers: DataFrame, placed: DataFrame, keep: int, plan: Plan
) -> DataFrame:
    """Best items of each visited leaf: ``asker, items, scores``, at most ``keep`` per visit."""
    place = ["tree", "leaf", "chunk"]
    busy = materialize(
        visits.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / plan.most_visits).alias("parts")),
        "busy",
    )
    parted = (
        visits.join(busy, place)
        .withColumn("part", F.pmod(F.xxhash64("asker"), F.col("parts")))
        .drop("parts")
        .join(askers, "asker")
    )
    copied = placed.join(busy, place).withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))
    ).drop("parts")

    def best(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return _FOUND.empty_table()
        item = held["item"].to_numpy()
        vectors = _matrix(held["vector"]).T
        bounds = asked["bound"].to_numpy(zero_copy_only=False)
        queries = _matrix(asked["vector"])
        names, items, scores = [], [], []
        for at in range(0, len(queries), 256):
            block = queries[at : at + 256] @ vectors
            n = min(keep, block.shape[1])
            top = np.argpartition(-block, n - 1, axis=1)[:, :n]
            for row, chosen in enumerate(top):
                value = block[row, chosen]
                good = np.ones(n, bool) if np.isnan(bounds[at + row]) else value >= bounds[at + row] - 1e-9
                if good.any():
                    names.append(asked["asker"][at + row].as_py())
                    items.append(item[chosen[good]])
                    scores.append(value[good])
        return pa.table([pa.array(names, pa.int64()), pa.array(items, _FOUND[1].type), pa.array(scores, _FOUND[2].type)], schema=_FOUND)

    keys = [*place, "part"]
    return (
        parted.groupBy(*keys)
        .cogroup(copied.groupBy(*keys))
        .applyInArrow(best, "asker bigint, items array<bigint>, scores array<double>")
    )


def _best(found: DataFrame, keep: int) -> DataFrame:
    """``asker, best``: the best items found over all visits, each once, best first."""
    pairs = F.transform(
        F.arrays_zip("scores", "items"), lambda x: F.struct((-x["scores"]).alias("s"), x["items"].alias("i"))
    )
    each = found.groupBy("asker").agg(F.sort_array(F.flatten(F.collect_list(pairs))).alias("p"))
    once = F.array_distinct(F.transform("p", lambda x: x["i"]))
    return each.select("asker", F.slice(once, 1, keep).alias("best"))


def neighbours(
    table: DataFrame,
    queries: Column,
    k: int = 20,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    plan: Plan | None = None,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that satisfies ``queries`` (a condition on
    the column ``id``) the ``k`` nearest other rows found, nearest first, ties to the smaller id."""
    plan = plan or Plan()
    rows = table.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector")))
    spark = table.sparkSession
    nothing = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    facts = (
        rows.groupBy(F.size("vector").alias("length"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max(F.aggregate("vector", F.lit(0.0), _add_square)).alias("top"),
        )
        .orderBy(F.desc("n"), F.desc("length"))
        .first()
    )
    if facts is None:
        return nothing
    rows = rows.where(F.size("vector") == facts["length"])
    items, asking = distinct_vectors(rows, k, queries)
    items = materialize(items, "items")
    asking = materialize(
        asking.join(items.select("vector", "item"), "vector").select("query", F.col("item").alias("asker")), "asking"
    )
    n_items = items.count()
    # distinct vectors, by their own hash: ids and copies don't matter
    share = plan.sample_numbers / facts["length"] / n_items
    chosen = items.where(sampling.share("vector", plan.seed) < share).select("vector").toArrow()
    if not chosen.num_rows:
        return nothing
    points = np.unique(_matrix(chosen["vector"]), axis=0)
    forest = build(points, n_items, plan)
    forest.top = max(forest.top, facts["top"])
    chunks = max(1, math.ceil(n_items / (1 << forest.depth) / plan.most_items))
    placed = materialize(_placed(items, forest, chunks), "placed")
    askers = materialize(
        items.join(asking.select(F.col("asker").alias("item")).distinct(), "item").select(
            F.col("item").alias("asker"), "vector", F.lit(None).cast("double").alias("bound")
        ),
        "askers",
    )
    keep = k + 5
    first = _visits(askers, forest, plan, chunks, True)
    probed = materialize(_compared(first, askers, placed, keep, plan), "probed")
    # the k-th best of distinct items bounds what the other leaves can add
    level = probed.select("asker", F.explode(F.arrays_zip("items", "scores")).alias("x")).groupBy("asker", "x.items").agg(
        F.max("x.scores").alias("score")
    )
    order = Window.partitionBy("asker").orderBy(F.desc("score"))
    level = (
        level.withColumn("nth", F.row_number().over(order))
        .where(F.col("nth") == k + 1)
        .select("asker", F.col("score").alias("level"))
    )
    bounded = materialize(
        askers.drop("bound").join(level, "asker", "left").select("asker", "vector", F.col("level").alias("bound")),
        "bounded",
    )
    further = _compared(_visits(bounded, forest, plan, chunks, False), bounded, placed, keep, plan)
    return _ranked(_best(probed.union(further), keep), items, asking, k)


def _ranked(best: DataFrame, items: DataFrame, asking: DataFrame, k: int) -> DataFrame:
    """Exact scores of the items found, and their ids for every query."""
    one = items.select(F.col("item").alias("asker"), F.col("vector").alias("v"))
    product = F.aggregate(
        F.zip_with("v", "vector", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda total, x: total + x
    )
    scored = (
        best.select("asker", F.explode("best").alias("item"))
        .join(items, "item")
        .join(one, "asker")
        .select("asker", product.alias("score"), F.explode("ids").alias("vec_id"))
    )
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    lists = scored.join(asking, "asker").where("query != vec_id")
    return (
        lists.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select(F.col("query").alias("query_id"), "rank", "vec_id", "score")
    )
