"""Second-order boosted trees over distributed histograms.

Every feature is cut into bins once, at its quantiles. A level of a tree is one job: each
task adds up gradients and Hessians by (node, feature, bin) over its rows, the sums come together,
and the driver, which sees those sums only, takes the split of most gain for every node:

    gain = GL^2 / (HL + r) + GR^2 / (HR + r) - G^2 / (H + r),      leaf = -G / (H + r) * step

with ``r`` the regularisation. Levels depend on each other, so jobs are kept short: rows stand in
persisted blocks of small integers, and a worker remembers the scores of the blocks it has seen. That
memory is a cache: scores are a function of the trees, and a worker without them (a lost executor, a
moved block) adds up the trees again. Every ``REFRESH`` trees scores are stored with the blocks, which
bounds that. Rows that fill no more than one block need no bringing together, so the task that holds
it grows all trees in one job; the trees are the same.

Gradients are whole multiples of a small power of two, so sums are exact and the model is the same
for any number of partitions and any order of arrival. Indicators of one category share a single
histogram. Several models, each leaving out the rows of one fold, are grown by the same jobs.
"""

from __future__ import annotations

import json
import math
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwright.session import materialize

BINS = 32
ACCURACY = 10_000
BLOCK_ROWS = 1 << 16  # of a block, about
LARGEST_BLOCK = 2 * BLOCK_ROWS
REFRESH = 25  # trees between two stores of the scores
REMEMBERED = 64 << 20  # bytes of scores that a worker remembers
COLLECTED = 64  # pieces of the sums that are added up side by side, at most
PIECE_CELLS = 1 << 16  # of a piece, about


@dataclass(frozen=True)
class Boosting:
    trees: int
    depth: int
    step: float = 0.05
    row_share: float = 0.8
    column_share: float = 0.8
    positive_weight: float = 1.0
    regularisation: float = 1.0
    least_hessian: float = 1.0
    classify: bool = False
    seed: int = 42


@dataclass(frozen=True)
class Bins:
    """How columns become small integers: cuts per number, and the values of one category.

    A number's bin counts the cuts below it. A category's code is the place of its value in
    ``values`` from 1 on; code 0 is for missing and unknown ones. The features are the numbers,
    then an indicator for every value but the first.
    """

    numbers: tuple[str, ...]
    cuts: tuple[tuple[float, ...], ...]
    category: str | None = None
    values: tuple[str, ...] = ()

    @property
    def names(self) -> list[str]:
        return [*self.numbers, *[f"{self.category}_{v}" for v in self.values[1:]]]

    @property
    def width(self) -> int:
        return max([len(c) + 1 for c in self.cuts] + [len(self.values) + 1, 2])

    def columns(self, within: str = "") -> list[Column]:
        """Bins of the numbers (missing ones first), then the category's code; of the columns of a
        frame or of the fields of the struct ``within``."""
        inside = f"{within}." if within else ""
        out = []
        for name, cuts in zip(self.numbers, self.cuts, strict=True):
            out.append(_cuts_below(F.col(inside + name), cuts) if cuts else F.lit(0))
        if self.category:
            known = F.array(*[F.lit(v) for v in self.values])
            place = F.array_position(known, F.col(inside + self.category))
            out.append(F.coalesce(place, F.lit(0)).cast("int"))
        return out

    @property
    def inputs(self) -> list[str]:
        """The columns that bins are made of."""
        return [*self.numbers, *([self.category] if self.category else [])]


def _cuts_below(value: Column, cuts: Sequence[float]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda cut: value > cut))


def quantile_bins(
    rows: DataFrame, numbers: Sequence[str], category: str | None = None, values: Sequence[str] = (), bins: int = BINS
) -> Bins:
    """Bins of about equally many rows, in one scan; cuts are values of the column.

    The sketches are exact up to ``ACCURACY`` rows and off by a share of 1 / ``ACCURACY`` beyond.
    """
    shares = [k / bins for k in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(c, shares, ACCURACY).alias(f"q{k}") for k, c in enumerate(numbers)]).first()
    cuts = tuple(tuple(sorted({float(v) for v in found[f"q{k}"] or ()})) for k in range(len(numbers)))
    return Bins(tuple(numbers), cuts, category if len(values) else None, tuple(values))


# ---- trees ----------------------------------------------------------------------------------


@dataclass
class Tree:
    """Nodes in heap order: the children of node k are 2 k + 1 and 2 k + 2. A node without a feature
    (-1) sends all to the left. Rows whose bin is above the cut go to the right."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        inner = (1 << depth) - 1
        return cls(np.full(inner, -1, np.int16), np.zeros(inner, np.int16), np.zeros(inner + 1))

    def nodes(self, matrix: np.ndarray, numbers: int, levels: int) -> np.ndarray:
        """Place of every row among the nodes of the level after so many splits.

        A node compares one column as a whole, which is much faster than looking up the column and
        the cut of every row.
        """
        at = np.zeros(matrix.shape[1], np.min_scalar_type((1 << levels) - 1))
        for level in range(levels):
            right = np.zeros(len(at), bool)
            for place in range(1 << level):
                node = place + (1 << level) - 1
                feature, cut = int(self.feature[node]), self.cut[node]
                if feature < 0:
                    continue
                # an indicator asks for its code: the first one's is 2, as the first value has none
                own = matrix[feature] > cut if feature < numbers else matrix[numbers] == feature - numbers + 2
                right |= own & (at == place) if level else own
            at <<= 1
            at |= right
        return at

    def scores(self, matrix: np.ndarray, numbers: int) -> np.ndarray:
        depth = len(self.leaf).bit_length() - 1
        return self.leaf[self.nodes(matrix, numbers, depth)]


@dataclass
class Forest:
    """A fitted model. ``gains`` are the total gain and the number of splits of every feature."""

    settings: Boosting
    bins: Bins
    base: float
    trees: list[Tree] = field(default_factory=list)
    gains: np.ndarray | None = None

    def score(self) -> Column:
        """Probability of label 1, or the predicted amount, of rows with the bins' columns."""
        forest = self

        @F.arrow_udf("double")
        def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                matrix = batch.flatten().to_numpy().reshape(len(batch), -1).T
                yield pa.array(forest.scored(np.ascontiguousarray(matrix)))

        return predict(F.array(*self.bins.columns()))

    def swapped(self, own: str, donor: str) -> Column:
        """``array<double>``: the score of a row, then that with each input in turn taken from the
        donor; both are structs of the inputs."""
        forest = self

        @F.arrow_udf("array<double>")
        def predict(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for own, donor in batches:
                mine, other = (
                    np.ascontiguousarray(b.flatten().to_numpy().reshape(len(own), -1).T) for b in (own, donor)
                )
                scores = [forest.scored(mine)]
                for c in range(len(mine)):
                    mixed = mine.copy()
                    mixed[c] = other[c]
                    scores.append(forest.scored(mixed))
                offsets = np.arange(len(own) + 1, dtype=np.int32) * len(scores)
                yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.stack(scores, axis=1).ravel()))

        return predict(F.array(*self.bins.columns(own)), F.array(*self.bins.columns(donor)))

    def scored(self, matrix: np.ndarray) -> np.ndarray:
        total = np.full(matrix.shape[1], self.base)
        for tree in self.trees:
            total += tree.scores(matrix, len(self.bins.numbers))
        return 1 / (1 + np.exp(-total)) if self.settings.classify else total

    def to_json(self) -> str:
        """The model as text, for a table or a file."""
        trees = [{k: getattr(t, k).tolist() for k in ("feature", "cut", "leaf")} for t in self.trees]
        parts = {"base": self.base, "gains": self.gains.tolist(), "trees": trees}
        return json.dumps({"settings": asdict(self.settings), "bins": asdict(self.bins), **parts})

    @classmethod
    def from_json(cls, text: str) -> Forest:
        held = json.loads(text)
        b = held["bins"]
        bins = Bins(tuple(b["numbers"]), tuple(map(tuple, b["cuts"])), b["category"], tuple(b["values"]))
        trees = [
            Tree(np.array(t["feature"], np.int16), np.array(t["cut"], np.int16), np.array(t["leaf"]))
            for t in held["trees"]
        ]
        return cls(Boosting(**held["settings"]), bins, held["base"], trees, np.array(held["gains"]))

    def importances(self) -> list[tuple[str, float]]:
        """Mean gain per split of every feature, as a share of their sum."""
        total, splits = self.gains
        mean = np.divide(total, splits, out=np.zeros(len(total)), where=splits > 0)
        whole = mean.sum()
        return list(zip(self.bins.names, (mean / whole if whole else mean).tolist(), strict=True))


# ---- sums in tasks ----------------------------------------------------------------------------

_remembered: OrderedDict[tuple, tuple[int, np.ndarray]] = OrderedDict()


@dataclass
class Block:
    """Some rows: bins (column x row), label, weight, fold, a hash of the row's key, stored scores."""

    number: int
    matrix: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    fold: np.ndarray
    key: np.ndarray
    scores: np.ndarray  # model x row

    @classmethod
    def read(cls, row: tuple, columns: int, models: int) -> Block:
        number, n, matrix, label, weight, fold, key, scores = row
        stored = np.frombuffer(scores, np.float64)
        return cls(
            number, np.frombuffer(matrix, np.uint16).reshape(columns, n),
            np.frombuffer(label, np.float64), np.frombuffer(weight, np.float64), np.frombuffer(fold, np.int8),
            np.frombuffer(key, np.uint64), stored.reshape(models, n) if len(stored) else np.zeros((models, n)),
        )


@dataclass
class Job:
    """What tasks of one level need: settings, the trees since the last store, the tree in growth."""

    name: str
    settings: Boosting
    numbers: int  # columns of the blocks that are numbers
    values: int  # of the category, which is their last column; 0: there is none
    width: int
    bases: list[float]
    unit: float
    folds: list[int]
    stored: int  # trees in the stored scores
    done: list[list[Tree]]  # since then, per model
    growing: list[Tree]
    level: int = 0

    def read(self, row: tuple) -> Block:
        return Block.read(row, self.numbers + (self.values > 0), len(self.folds))

    def scores(self, block: Block) -> np.ndarray:
        """Scores by all finished trees, remembered if they can be."""
        at = (self.name, block.number)
        count, held = _remembered.pop(at, (0, None))
        upto = self.stored + len(self.done[0])
        if held is None or not self.stored <= count <= upto:
            count, held = self.stored, block.scores.copy()
        for m, trees in enumerate(self.done):
            for tree in trees[count - self.stored :]:
                held[m] += tree.scores(block.matrix, self.numbers)
        _remembered[at] = (upto, held)
        while sum(h.nbytes for _, h in _remembered.values()) > REMEMBERED and len(_remembered) > 1:
            _remembered.popitem(last=False)
        return held

    def drawn(self, block: Block) -> np.ndarray:
        """The rows of this tree: a hash of row and tree decides."""
        if self.settings.row_share >= 1:
            return np.ones(len(block.key), bool)
        tree = self.stored + len(self.done[0])
        mark = np.uint64((tree * 0x9E3779B97F4A7C15 + self.settings.seed) % (1 << 64))
        h = block.key ^ mark
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (h >> np.uint64(11)) * 2.0**-53 < self.settings.row_share

    def gradients(self, block: Block, model: int, score: np.ndarray, rows: np.ndarray) -> Iterator[np.ndarray]:
        """First and second derivatives of the loss at some rows, in whole units."""
        score = score[rows] + self.bases[model]
        label, weight = block.label[rows], block.weight[rows]
        if self.settings.classify:
            p = 1 / (1 + np.exp(-score))
            first, second = weight * (p - label), weight * p * (1 - p)
        else:
            first, second = weight * (score - label), weight
        return (np.rint(x / self.unit) for x in (first, second))

    @property
    def shape(self) -> tuple[int, ...]:
        """Of the sums: model, 2, column, node, bin."""
        return len(self.folds), 2, self.numbers + (self.values > 0), 1 << self.level, self.width

    def sums(self, block: Block) -> np.ndarray:
        """(model, 2, column, node, bin): gradients and Hessians of the block, in units."""
        nodes = 1 << self.level
        out = np.zeros(self.shape)
        drawn = self.drawn(block)
        for m, score in enumerate(self.scores(block)):
            # rows that are left out of the tree or the model add nothing
            rows = np.flatnonzero(drawn & (block.fold != self.folds[m]) if self.folds[m] >= 0 else drawn)
            both = list(self.gradients(block, m, score, rows))
            base = self.growing[m].nodes(block.matrix, self.numbers, self.level)[rows] * np.int64(self.width)
            for c, column in enumerate(block.matrix):
                cell = base + column[rows]
                for k in (0, 1):
                    out[m, k, c] = np.bincount(cell, both[k], nodes * self.width).reshape(nodes, self.width)
        return out

    def run(self, rows: Iterator[tuple]) -> Iterator[np.ndarray]:
        total = None
        for row in rows:
            found = self.sums(self.read(row))
            total = found if total is None else total + found
        if total is not None:
            yield total


def _packed(rows: pa.Table) -> pa.RecordBatch:
    key, label, weight, fold = [c.to_numpy() for c in rows.columns[:4]]
    matrix = np.empty((rows.num_columns - 4, rows.num_rows), np.uint16)
    for at, column in zip(matrix, rows.columns[4:], strict=True):
        at[:] = column.to_numpy()
    parts = [matrix, label, weight, fold.astype(np.int8), key.view(np.uint64)]
    return pa.RecordBatch.from_arrays(
        [pa.array([rows.num_rows], pa.int32()), *[pa.array([p.tobytes()], pa.binary()) for p in parts]],
        ["n", "matrix", "label", "weight", "fold", "key"],
    )


def _blocks(rows: DataFrame, bins: Bins, label: str, weight: str | None, fold: str | None, key: str) -> DataFrame:
    """Rows packed into blocks, a row of bytes each."""
    columns = bins.columns()
    ready = rows.select(
        F.xxhash64(key).alias("key"), F.col(label).cast("double").alias("label"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"),
        (F.col(fold).cast("int") if fold else F.lit(-1)).alias("fold"), *[c.alias(f"b{k}") for k, c in enumerate(columns)],
    )
    kinds = "n int, matrix binary, label binary, weight binary, fold binary, key binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= LARGEST_BLOCK:
                whole = pa.Table.from_batches(held)
                yield _packed(whole.slice(0, LARGEST_BLOCK))
                held = whole.slice(LARGEST_BLOCK).to_batches()
        if any(b.num_rows for b in held):
            yield _packed(pa.Table.from_batches(held))

    packed = ready.mapInArrow(pack, kinds)
    return packed.select(F.monotonically_increasing_id().alias("number"), "*", F.lit(b"").alias("scores"))


# ---- splits on the driver ---------------------------------------------------------------------


def split_gains(sums: np.ndarray, numbers: int, values: int, r: float, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gains (node, feature, cut) with the left sums of gradient and Hessian of every cut.

    ``sums`` is (2, column, node, bin): numbers, then the category, whose codes from 2 on are
    indicators with a single cut. Impossible cuts, and those a side of which has too little
    Hessian, have gain minus infinity.
    """
    _, columns, nodes, width = sums.shape
    features = numbers + max(0, values - 1)
    left = np.zeros((2, nodes, features, width - 1))
    real = np.zeros((features, width - 1), bool)
    if numbers:
        left[:, :, :numbers] = np.cumsum(sums[:, :numbers], axis=3)[..., :-1].transpose(0, 2, 1, 3)
        real[:numbers] = True
    whole = sums[:, 0].sum(axis=2)  # (2, node)
    if values > 1:
        left[:, :, numbers:, 0] = whole[:, :, None] - sums[:, numbers, :, 2 : values + 1]
        real[numbers:, 0] = True
    right = whole[:, :, None, None] - left
    valid = real & (left[1] >= least) & (right[1] >= least)

    def worth(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return np.divide(g * g, h + r, out=np.zeros_like(g), where=h + r > 0)

    gain = worth(*left) + worth(*right) - worth(*whole)[:, None, None]
    return np.where(valid, gain, -np.inf), left[0], left[1]


def _grow(tree: Tree, level: int, sums: np.ndarray, job: Job, chosen: np.ndarray, gains: np.ndarray) -> None:
    """Take the best split of each node of the level; after the last level, set the leaves."""
    s = job.settings
    gain, g_left, h_left = split_gains(sums, job.numbers, job.values, s.regularisation, s.least_hessian)
    gain[:, ~chosen] = -np.inf
    nodes = 1 << level
    flat = gain.reshape(nodes, -1)
    best = flat.argmax(axis=1)  # of equal gains the first feature and lowest cut
    feature, cut = np.divmod(best, gain.shape[2])
    whole = sums[:, 0].sum(axis=2)
    every = np.arange(nodes)
    split = flat[every, best] > 0
    at = every + nodes - 1
    tree.feature[at] = np.where(split, feature, -1)
    tree.cut[at] = np.where(split, cut, 0)
    np.add.at(gains[0], feature[split], flat[every, best][split])
    np.add.at(gains[1], feature[split], 1)
    if level + 1 == s.depth:
        g = np.where(split, g_left[every, feature, cut], whole[0])
        h = np.where(split, h_left[every, feature, cut], whole[1])
        sides = np.stack([g, whole[0] - g], axis=1), np.stack([h, whole[1] - h], axis=1)
        weight = sides[1] + s.regularisation
        tree.leaf[:] = np.divide(-sides[0] * s.step, weight, out=np.zeros_like(weight), where=weight > 0).ravel()


def _start(
    rows: DataFrame, bins: Bins, label: str, settings: Boosting, key: str,
    weight: str | None, fold: str | None, folds: Sequence[int], partitions: int | None,
) -> tuple[list[Forest], Job, DataFrame | None]:
    """Models of no tree yet, the first job, and the stored blocks (None without rows)."""
    usable = rows.where(F.col(label).isNotNull())
    y, w = F.col(label).cast("double"), F.col(weight).cast("double") if weight else F.lit(1.0)
    out = [(F.col(fold) != k) if fold and k >= 0 else F.lit(True) for k in folds]
    facts = usable.agg(
        F.count(F.lit(1)).alias("n"), F.min(y).alias("low"), F.max(y).alias("high"), F.max(w).alias("w"),
        *[F.sum(F.when(o, y * w)).alias(f"y{k}") for k, o in enumerate(out)],
        *[F.sum(F.when(o, w)).alias(f"w{k}") for k, o in enumerate(out)],
    ).first()
    n = facts["n"]
    means = [(facts[f"y{k}"] or 0.0) / (facts[f"w{k}"] or 1.0) for k in range(len(folds))]
    if settings.classify:
        bounded = [min(max(p, 1e-6), 1 - 1e-6) for p in means]
        bases, span = [math.log(p / (1 - p)) for p in bounded], 1.0
    else:
        bases, span = means, max(2 * ((facts["high"] or 0) - (facts["low"] or 0)), 1.0)
    # sums of n whole numbers of this size stay below 2**53
    bits = max(8, 52 - math.ceil(math.log2(n + 1)))
    unit = 2.0 ** (math.ceil(math.log2(span * (facts["w"] or 1.0))) - bits)
    job = Job(
        uuid.uuid4().hex, settings, len(bins.numbers), len(bins.values), bins.width, bases, unit,
        list(folds), 0, [[] for _ in folds], [Tree.empty(settings.depth) for _ in folds],
    )
    forests = [Forest(settings, bins, b, [], np.zeros((2, len(bins.names)))) for b in bases]
    if not n:
        return forests, job, None
    # about one block per task; rows are dealt out by their key
    wanted = math.ceil(n / BLOCK_ROWS) if partitions is None else partitions
    dealt = usable.repartition(wanted, key)
    return forests, job, materialize(_blocks(dealt, bins, label, weight, fold, key), "blocks")


def root_gains(
    rows: DataFrame, bins: Bins, label: str, settings: Boosting, key: str, weight: str | None = None
) -> DataFrame:
    """``feature, cut, gain`` of every cut the first node of the first tree could be split at."""
    _, job, blocks = _start(rows, bins, label, replace(settings, row_share=1.0), key, weight, None, [-1], None)
    found = []
    if blocks is not None:
        held = _persisted(blocks)
        sums = (_total(held, job) * job.unit)[0]
        held.unpersist()
        gain, _, _ = split_gains(sums, job.numbers, job.values, settings.regularisation, settings.least_hessian)
        for name, own, cuts in zip(bins.names, gain[0], [*bins.cuts, *[(0.0,)] * len(bins.names)], strict=False):
            found += [(name, float(cut), float(g)) for cut, g in zip(cuts, own, strict=False) if g > -math.inf]
    return rows.sparkSession.createDataFrame(found, "feature string, cut double, gain double")


def fit(
    rows: DataFrame, bins: Bins, label: str, settings: Boosting, key: str,
    weight: str | None = None, fold: str | None = None, folds: Sequence[int] = (-1,), partitions: int | None = None,
) -> list[Forest]:
    """A model for each of ``folds``, trained on the rows of all other folds (-1: on all rows).

    Rows without a label are left out. Nothing but sums of gradients comes to the driver.
    """
    forests, job, blocks = _start(rows, bins, label, settings, key, weight, fold, folds, partitions)
    if blocks is None:
        return forests
    draws = _drawn_features(settings, len(bins.names))
    held = _persisted(blocks)
    if blocks.count() == 1:  # nothing to bring together: the one task that holds the block goes on
        trees, gains = held.mapPartitions(lambda part: _alone(job, draws, part)).collect()[0]
        for m, forest in enumerate(forests):
            forest.trees = trees[m]
            forest.gains += gains[m] if gains else 0
    else:
        for begin in range(0, settings.trees, REFRESH):
            part = draws[begin : begin + REFRESH]
            _grown(job, part, lambda: _total(held, job), [f.gains for f in forests])
            for m, forest in enumerate(forests):
                forest.trees += job.done[m]
            if begin + REFRESH < settings.trees:
                blocks = materialize(_rescored(blocks, job), "blocks")
                held.unpersist()
                held = _persisted(blocks)
                job.stored += len(part)
                job.done = [[] for _ in folds]
    held.unpersist()
    return forests


def _drawn_features(settings: Boosting, features: int) -> list[np.ndarray]:
    """Which features each tree may use."""
    rng = np.random.default_rng(settings.seed)
    taken = max(1, round(settings.column_share * features))
    draws = []
    for _ in range(settings.trees):
        chosen = np.zeros(features, bool)
        chosen[rng.choice(features, taken, replace=False)] = True
        draws.append(chosen)
    return draws


def _grown(
    job: Job, draws: Sequence[np.ndarray], sums: Callable[[], np.ndarray], gains: list[np.ndarray]
) -> None:
    """Adds a tree to ``job.done`` for each draw, and each split to the gains of its model.

    ``sums`` gives the sums of the job's level, wherever they come from.
    """
    for chosen in draws:
        job.growing = [Tree.empty(job.settings.depth) for _ in job.folds]
        for job.level in range(job.settings.depth):
            found = sums() * job.unit
            for m, tree in enumerate(job.growing):
                _grow(tree, job.level, found[m], job, chosen, gains[m])
        for m, tree in enumerate(job.growing):
            job.done[m].append(tree)


def _alone(job: Job, draws: Sequence[np.ndarray], rows: Iterator[tuple]) -> Iterator[tuple]:
    for row in rows:
        block = job.read(row)
        gains = [np.zeros((2, len(draws[0]))) for _ in job.folds] if draws else []
        _grown(job, draws, lambda: job.sums(block), gains)
        yield job.done, gains


def _persisted(blocks: DataFrame):
    """The blocks as an RDD, persisted as the JVM hands them out: were they persisted by a Python
    function, the first task on each would hold two Python workers, and idle ones keep their memory."""
    return blocks.rdd.persist(StorageLevel.MEMORY_AND_DISK)


def _total(held, job: Job) -> np.ndarray:
    """Sums over all blocks; being whole numbers, they don't depend on the order.

    Each core adds up its blocks, and these sums are added up in pieces by tasks, so the driver gets
    one number per cell, however many blocks there are.
    """
    parts = min(held.getNumPartitions(), held.context.defaultParallelism)
    sums = held.coalesce(parts).mapPartitions(job.run)
    if parts == 1:
        return sum(sums.collect())
    pieces = max(1, min(parts, COLLECTED, math.prod(job.shape) // PIECE_CELLS))
    cut = sums.flatMap(lambda whole: enumerate(np.array_split(whole.ravel(), pieces)))
    added = dict(cut.reduceByKey(np.add, pieces).collect())
    return np.concatenate([added[p] for p in range(pieces)]).reshape(job.shape)


def _rescored(blocks: DataFrame, job: Job) -> DataFrame:
    """The blocks with the scores of all finished trees."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [tuple(r.values()) for r in batch.to_pylist()]
            scores = [job.scores(job.read(r)).tobytes() for r in rows]
            at = batch.schema.get_field_index("scores")
            yield batch.set_column(at, "scores", pa.array(scores, pa.binary()))

    return blocks.mapInArrow(add, blocks.schema)
