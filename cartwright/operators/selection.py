"""Exact order statistics and exact n-tiles without a global sort.

A window without ``partitionBy`` sends every row to one task, and exact percentile aggregates
buffer every distinct value in one task. Only a few rows decide the answer, though: the rows at
the boundary ranks. They are found by sampled selection (Floyd and Rivest, 1975): a small sample
of the open interval that still holds the wanted rank gives two pivots around it, one scan counts
the rows on either side, and the interval shrinks. Scans use map-side aggregation only; the
sample is bounded, and the answer is exact whatever the sample was.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

SAMPLE = 10_000


@dataclass
class Probe:
    """The search for the row of one rank (from 1) in one ordering.

    Rows strictly between ``low`` and ``high`` are still in question; ``below`` rows come
    before them and ``size`` is how many they are.
    """

    ordering: int
    rank: int
    below: int
    size: int
    low: object = None
    high: object = None
    answer: object = None
    done: bool = False
    pivots: tuple = field(default=())

    @property
    def interval(self) -> tuple:
        return (self.ordering, self.low, self.high)


def _literal(value: object, kind: DataType) -> Column:
    """A sort key taken from a row, as a constant of exactly its column type."""
    if isinstance(kind, StructType):
        return F.struct(
            *[_literal(v, f.dataType).alias(f.name) for v, f in zip(value, kind.fields)]
        )
    return F.lit(value).cast(kind)


def select_ranks(
    df: DataFrame,
    orderings: Sequence[Column],
    ranks: Sequence[Sequence[int]],
    sizes: Sequence[int],
    sample: int = SAMPLE,
) -> list[list[object]]:
    """For each ordering, the sort keys found at the given ranks (1 = smallest).

    ``df`` is scanned a few times, so pass a stored frame. Rows whose key is NULL are not ranked;
    ``sizes`` gives the number of ranked rows per ordering.
    """
    keyed = df.select(*[k.alias(f"k{i}") for i, k in enumerate(orderings)])
    kinds = [keyed.schema[f"k{i}"].dataType for i in range(len(orderings))]
    keys = [F.col(f"k{i}") for i in range(len(orderings))]
    probes = [
        Probe(i, rank, 0, sizes[i]) for i, wanted in enumerate(ranks) for rank in wanted
    ]
    turn = 0
    while open_probes := [p for p in probes if not p.done]:
        turn += 1
        _choose_pivots(keyed, keys, kinds, open_probes, sample, turn)
        undecided = [p for p in open_probes if not p.done]
        if undecided:
            _narrow(keyed, keys, kinds, undecided)
    found: list[list[object]] = [[] for _ in orderings]
    for p in probes:
        found[p.ordering].append(p.answer)
    return found


def _inside(key: Column, kind: DataType, probe: Probe) -> Column:
    test = key.isNotNull()
    if probe.low is not None:
        test = test & (key > _literal(probe.low, kind))
    if probe.high is not None:
        test = test & (key < _literal(probe.high, kind))
    return test


def _choose_pivots(keyed, keys, kinds, probes, sample, turn) -> None:
    """Sample every open interval once; take the two pivots around each wanted rank."""
    intervals: dict[tuple, list[Probe]] = {}
    for p in probes:
        intervals.setdefault(p.interval, []).append(p)
    samples, picks = [], []
    for n, group in enumerate(intervals.values()):
        first = group[0]
        key = keys[first.ordering]
        keep = _inside(key, kinds[first.ordering], first)
        share = min(1.0, sample / first.size)
        if share < 1.0:
            keep = keep & (F.col("u") < share)
        samples.append(F.sort_array(F.collect_list(F.when(keep, key))).alias(f"s{n}"))
        got = F.col(f"s{n}")
        count = F.size(got)
        for m, p in enumerate(group):
            wanted = p.rank - p.below
            if share < 1.0 and m and 0 <= p.rank - group[m - 1].rank <= 1:
                p.pivots = group[m - 1].pivots  # next-door ranks lie between the same pivots
                continue
            if share == 1.0:
                places = (F.lit(wanted), F.lit(wanted))
            else:
                middle = wanted / p.size
                slack = 4 * math.sqrt(middle * (1 - middle) / sample) + 2 / sample
                places = (
                    F.floor(count * (middle - slack)) + 1,
                    F.ceil(count * (middle + slack)) + 1,
                )
            for side, place in zip("ab", places):
                bounded = F.greatest(F.lit(1), F.least(place.cast("int"), count))
                picks.append(F.try_element_at(got, bounded).alias(f"p{n}_{m}{side}"))
            p.pivots = (f"p{n}_{m}a", f"p{n}_{m}b")
            p.done = share == 1.0
    drawn = keyed.withColumn("u", F.rand(seed=1009 * turn))
    row = drawn.agg(*samples).select(*picks).first()
    for p in probes:
        p.pivots = tuple(row[name] for name in p.pivots)
        if p.done:
            p.answer = p.pivots[0]


def _narrow(keyed, keys, kinds, probes) -> None:
    """Count the rows around the pivots of all open probes in one scan, then shrink them.

    The pivots of an ordering cut it into cells: before the first, equal to it, between it and
    the next, and so on. One row per (ordering, cell) comes back.
    """
    pivots: dict[int, list] = {}
    for p in probes:
        if p.pivots[0] is not None:  # an empty sample: this probe tries again with a new seed
            pivots.setdefault(p.ordering, []).extend(p.pivots)
    if not pivots:
        return
    located = []
    for i, values in pivots.items():
        values[:] = sorted(set(values), key=_python_order)
        cell = F.lit(0)
        for v in values:
            at = _literal(v, kinds[i])
            cell = cell + (keys[i] >= at).cast("int") + (keys[i] > at).cast("int")
        located.append(F.struct(F.lit(i).alias("ordering"), cell.alias("cell")))
    counted = (
        keyed.select(F.inline(F.array(*located)))
        .filter(F.col("cell").isNotNull())
        .groupBy("ordering", "cell")
        .agg(F.count("*").alias("n"))
        .collect()
    )
    cells = {(row["ordering"], row["cell"]): row["n"] for row in counted}
    around: dict[tuple, tuple[int, int]] = {}
    for i, values in pivots.items():
        before = 0
        for j, v in enumerate(values):
            before += cells.get((i, 2 * j), 0)
            equal = cells.get((i, 2 * j + 1), 0)
            around[i, v] = (before, before + equal)
            before += equal
    for p in probes:
        if p.pivots[0] is not None:
            _shrink(p, [(v, *around[p.ordering, v]) for v in p.pivots])


def _python_order(value: object) -> tuple:
    """Python's order of sort keys made equal to Spark's: NULL first."""
    parts = value if isinstance(value, tuple) else (value,)
    return tuple((x is not None, x) for x in parts)


def _shrink(p: Probe, marks: list[tuple]) -> None:
    """Keep the part of the open interval with the wanted rank, or the pivot that has it."""
    for pivot, less, upto in marks:
        if less < p.rank <= upto:
            p.done, p.answer = True, pivot
            return
    end = p.below + p.size
    starts = [(p.low, p.below), *[(pivot, upto) for pivot, _, upto in marks]]
    stops = [*[(pivot, less) for pivot, less, _ in marks], (p.high, end)]
    for (low, before), (high, until) in zip(starts, stops):
        if before < p.rank <= until:
            p.low, p.high, p.below, p.size = low, high, before, until - before
            return


def with_ntiles(
    df: DataFrame,
    tiles: int,
    scores: dict[str, tuple[Column, bool]],
    tie_break: Sequence[str],
    sample: int = SAMPLE,
) -> DataFrame:
    """Add ``ntile(tiles)`` columns, equal to a window over the whole frame, NULLs last.

    ``scores`` maps an output column to (numeric sort value, descending?). ``tie_break`` columns
    make the order total. ``df`` is scanned several times, so pass a stored frame. The result is
    a projection of ``df``: no shuffle.
    """
    orderings = []
    for value, descending in scores.values():
        directed = -value if descending else value
        orderings.append(
            F.struct(
                value.isNull().alias("missing"),
                directed.alias("value"),
                *[F.col(c) for c in tie_break],
            )
        )
    n = df.count()
    cuts = _tile_ends(n, tiles)
    boundaries = select_ranks(df, orderings, [cuts] * len(orderings), [n] * len(orderings), sample)
    out = df
    keyed = df.select(*[k.alias(f"k{i}") for i, k in enumerate(orderings)]).schema
    columns = []
    for i, name in enumerate(scores):
        kind = keyed[f"k{i}"].dataType
        tile = F.lit(1)
        for end in boundaries[i]:
            tile = tile + (orderings[i] > _literal(end, kind)).cast("int")
        columns.append(tile.cast("bigint").alias(name))
    return out.select("*", *columns)


def _tile_ends(n: int, tiles: int) -> list[int]:
    """Last rank of every tile but the last; the first ``n % tiles`` tiles hold one row more."""
    size, larger = divmod(n, tiles)
    ends = [t * size + min(t, larger) for t in range(1, tiles)]
    return [e for e in ends if 0 < e < n] if n > tiles else list(range(1, n))


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], shares: Sequence[float], sample: int = SAMPLE
) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation, NULLs left out, for several numeric columns."""
    counted = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    sizes = [counted[c] for c in columns]
    ranks = []
    for n in sizes:
        spots = {r for s in shares for r in _neighbours(n, s)} if n else set()
        ranks.append(sorted(spots))
    filled = [i for i, n in enumerate(sizes) if n]
    found = select_ranks(
        df,
        [F.col(columns[i]) for i in filled],
        [ranks[i] for i in filled],
        [sizes[i] for i in filled],
        sample,
    )
    out: dict[str, list[float | None]] = {c: [None] * len(shares) for c in columns}
    for i, values in zip(filled, found):
        at = dict(zip(ranks[i], values))
        for j, s in enumerate(shares):
            low, high = _neighbours(sizes[i], s)
            part = s * (sizes[i] - 1) - (low - 1)
            a, b = float(at[low]), float(at[high])
            out[columns[i]][j] = a + (b - a) * part
    return out


def _neighbours(n: int, share: float) -> tuple[int, int]:
    place = share * (n - 1)
    return math.floor(place) + 1, math.ceil(place) + 1


def exact_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    return {c: v[0] for c, v in exact_quantiles(df, columns, [0.5]).items()}
