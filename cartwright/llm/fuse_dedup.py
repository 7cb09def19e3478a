"""Exact duplicates of texts, delivery by delivery, screened by static binary-fuse filters.

Two texts are equal when the same bytes are left without the six ASCII blanks. A delivery of
documents is taken in against immutable snapshots of those before it:

1. equal texts within the delivery are grouped on their own, by digest and then by their bytes;
2. the digests of these groups run past the snapshots' binary-fuse filters (Graf and Lemire, 2022:
   three slots per key in neighbouring segments, one byte per slot, about 9 bits a key). A filter
   covers one bucket of digests, so its size is bounded; digests go to the filter of their bucket;
3. only the digests that pass meet the snapshot's exact buckets, where bytes are compared; groups
   with the bytes of a standing group join it, whatever their digests say about others;
4. what is new becomes the next snapshot, with filters of its own. Snapshots never change.

The digest alone never decides: different texts of one digest stay different groups (tests use a
digest of one byte). Groups of more than a thousandth of all rows, at most a thousand of them, are
handled apart with a broadcast of that bound, so no task holds the rows of one large group.

A null text counts as empty; texts of blanks only are equal to it. Of equal texts the row with the
most code points stays, then the smallest id, a null id being the greatest; of rows alike in both,
one stays. Rows of one id are rows of their own. Long texts are compared whole. An empty table gives
an empty result, and columns beyond id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwright.llm.words import id_and_text, remainder
from cartwright.session import materialize

BLANKS = b" \t\n\x0b\x0c\r"
BUCKET_KEYS = 1 << 16  # keys of one filter, about
SLICE_KEYS = 1 << 20  # digests that run past one copy of a filter, about
SENT_ROWS = 500_000  # digests sent to every task up to here, else they are joined
HOT_SHARE = 1000  # a group of more than one in so many rows is handled apart
_HEAD = struct.Struct("<QII")


def sha256(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


# ---- binary-fuse filters --------------------------------------------------------------------


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64(seed)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@dataclass(frozen=True)
class FuseFilter:
    """A set of 64-bit keys that holds all it was built from, and one in 256 others by mistake."""

    seed: int
    segment: int  # slots, a power of two
    segments: int  # that a key's first slot may lie in
    slots: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        """A filter of the keys; a seed that leaves a cycle is replaced by the next."""
        keys = np.unique(keys.view(np.uint64))
        n = len(keys)
        segment = 1 << max(2, min(18, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
        factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
        seed = 0
        while True:
            segments = max(1, -(-int(n * factor) // segment) - 2)
            empty = cls(seed * 0x9E3779B97F4A7C15 % (1 << 64), segment, segments, np.zeros((segments + 2) * segment, np.uint8))
            if empty._fill(keys):
                return empty
            seed += 1
            factor *= 1.02

    def _places(self, hashed: np.ndarray) -> np.ndarray:
        """The three slots of each key, one in each of three adjacent segments."""
        room = np.uint64(self.segments * self.segment)
        first = ((hashed >> np.uint64(32)) * room) >> np.uint64(32)
        mask, step = np.uint64(self.segment - 1), np.uint64(self.segment)
        second = (first + step) ^ ((hashed >> np.uint64(14)) & mask)
        third = (first + step + step) ^ (hashed & mask)
        return np.stack([first, second, third], axis=1).astype(np.int64)

    def _fill(self, keys: np.ndarray) -> bool:
        """Set the slots. Keys that hold a slot alone are taken away, wave after wave, and given
        that slot in the opposite order; False if some keys never stand alone."""
        hashed = _mixed(keys, self.seed)
        places = self._places(hashed)
        count = np.bincount(places.ravel(), minlength=len(self.slots))
        owners = np.zeros(len(self.slots), np.int64)  # sum of the keys' numbers
        for k in range(3):
            np.add.at(owners, places[:, k], np.arange(len(keys)))
        waves, left = [], len(keys)
        alone = np.flatnonzero(count == 1)
        while len(alone):
            taken, at = np.unique(owners[alone], return_index=True)
            waves.append((taken, alone[at]))
            left -= len(taken)
            touched = places[taken].ravel()
            np.subtract.at(count, touched, 1)
            np.subtract.at(owners, touched, np.repeat(taken, 3))
            touched = np.unique(touched)
            alone = touched[count[touched] == 1]
        if left:
            return False
        marks = self._marks(hashed)
        for taken, slot in reversed(waves):
            others = np.bitwise_xor.reduce(self.slots[places[taken]], axis=1)  # its own is 0 yet
            self.slots[slot] = marks[taken] ^ others
        return True

    @staticmethod
    def _marks(hashed: np.ndarray) -> np.ndarray:
        return (hashed ^ (hashed >> np.uint64(40))).astype(np.uint8)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        hashed = _mixed(keys.view(np.uint64), self.seed)
        found = np.bitwise_xor.reduce(self.slots[self._places(hashed)], axis=1)
        return found == self._marks(hashed)

    def to_bytes(self) -> bytes:
        return _HEAD.pack(self.seed, self.segment, self.segments) + self.slots.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> FuseFilter:
        return cls(*_HEAD.unpack_from(data), np.frombuffer(data, np.uint8, offset=_HEAD.size))


# ---- rows, groups, snapshots ----------------------------------------------------------------


@dataclass(frozen=True)
class Snapshot:
    """An immutable set of texts: ``rows(row, doc_id, length, digest, body)``, of which each of
    ``groups(digest, holder, copies, best)`` holds one as its text, and ``filters(bucket, filter)``."""

    rows: DataFrame
    groups: DataFrame
    filters: DataFrame
    buckets: int


def signature(text: str, digest: Callable[[bytes], bytes]) -> Column:
    """``struct<length, digest, body>`` of each text; ``body`` is the text without blanks."""

    @F.arrow_udf("length bigint, digest binary, body binary")
    def signed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch]
            bodies = [t.encode().translate(None, BLANKS) for t in texts]
            columns = [
                pa.array(list(map(len, texts)), pa.int64()),
                pa.array(list(map(digest, bodies)), pa.binary()),
                pa.array(bodies, pa.binary()),
            ]
            yield pa.StructArray.from_arrays(columns, ["length", "digest", "body"])

    return signed(F.col(text))


def _key() -> Column:
    return F.xxhash64("digest")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest", F.lit(1)), F.lit(buckets)).cast("int")


def _snapshot(rows: DataFrame, groups: DataFrame) -> Snapshot:
    """Freeze new groups: a filter for each bucket of their digests."""
    groups = materialize(groups, "groups")
    buckets = max(1, math.ceil(groups.count() / BUCKET_KEYS))

    def build(table: pa.Table) -> pa.Table:
        made = FuseFilter.build(table["key"].combine_chunks().to_numpy(zero_copy_only=False))
        return pa.table(
            {"bucket": table["bucket"].slice(0, 1).cast(pa.int32()), "filter": pa.array([made.to_bytes()], pa.binary())}
        )

    keyed = groups.select(_bucket(buckets).alias("bucket"), _key().alias("key"))
    filters = keyed.groupBy("bucket").applyInArrow(build, "bucket int, filter binary")
    return Snapshot(rows, groups, materialize(filters, "filters"), buckets)


def screened(groups: DataFrame, snapshot: Snapshot) -> DataFrame:
    """``digest`` of the groups that the snapshot may hold: all it does hold, and few others.

    Digests stream past the filter of their bucket. Where a delivery has many more digests than
    the snapshot has buckets for, several copies of a filter share them.
    """
    copies = max(1, math.ceil(groups.count() / (snapshot.buckets * SLICE_KEYS)))
    filters = snapshot.filters.select(
        "bucket", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("part"), "filter",
        F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("bigint").alias("key"),
    )
    asked = groups.select(
        _bucket(snapshot.buckets).alias("bucket"),
        F.pmod(F.xxhash64("digest", F.lit(2)), F.lit(copies)).cast("int").alias("part"),
        F.lit(None).cast("binary").alias("filter"), "digest", _key().alias("key"),
    )

    def pass_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, filter_ = None, None
        for batch in batches:
            buckets, parts = (batch.column(k).to_numpy() for k in (0, 1))
            is_filter = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            change = (buckets[1:] != buckets[:-1]) | (parts[1:] != parts[:-1]) | (is_filter[1:] != is_filter[:-1])
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for begin, end in zip(edges, edges[1:], strict=False):
                if begin == end:
                    continue
                at = (int(buckets[begin]), int(parts[begin]))
                if is_filter[begin]:
                    place, filter_ = at, FuseFilter.from_bytes(batch.column(2)[begin].as_py())
                elif at == place:
                    hit = filter_.holds(batch.column(4).slice(begin, end - begin).to_numpy())
                    chosen = batch.column(3).slice(begin, end - begin).filter(pa.array(hit))
                    yield pa.RecordBatch.from_arrays([chosen], ["digest"])

    # a filter, being the row without a digest, comes before the digests of its bucket
    dealt = filters.unionByName(asked).repartition("bucket", "part")
    return dealt.sortWithinPartitions("bucket", "part", F.col("filter").isNull()).mapInArrow(
        pass_by, "digest binary"
    )


def _few(rows: DataFrame) -> DataFrame:
    """Rows for a join: sent to every task if they are few, by count."""
    return F.broadcast(rows) if rows.limit(SENT_ROWS + 1).count() <= SENT_ROWS else rows


def _hot(groups: DataFrame, total: int) -> tuple[Column, DataFrame]:
    """The test for large groups, of which there are at most ``HOT_SHARE``, and their digests."""
    large = F.col("copies") * HOT_SHARE > total
    return large, F.broadcast(groups.where(large).select("digest").distinct())


def _order() -> Column:
    """The row that stays has the least of these."""
    return F.struct(
        (-F.col("length")).alias("shorter"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row"
    )


def _members() -> list[Column]:
    return [F.count(F.lit(1)).alias("copies"), F.min("row").alias("holder")]


def _local_groups(batch: DataFrame) -> DataFrame:
    """``digest, holder, copies, best`` of the equal texts within one delivery.

    Bytes are compared by grouping on them, copies collapsing map-side; only repeated digests need it.
    """
    heads = materialize(batch.groupBy("digest").agg(*_members(), F.min(_order()).alias("best")), "heads")
    total = heads.agg(F.sum("copies")).first()[0] or 0
    large, hot = _hot(heads, total)
    repeated = materialize(heads.where("copies > 1").select("digest", "copies"), "repeated")
    narrow = batch.select("digest", "row", "body")
    rest = _few(repeated.where(~large).select("digest"))
    kinds = [
        narrow.join(digests, "digest", "left_semi").groupBy("digest", "body").agg(F.min("row").alias("holder"))
        for digests in (hot, rest)
    ]
    bodies = kinds[0].unionByName(kinds[1])
    split = materialize(bodies.groupBy("digest").count().where("count > 1").select("digest"), "split")
    if split.isEmpty():
        return heads
    apart = batch.join(split, "digest", "left_semi").groupBy("digest", "body")
    exact = apart.agg(*_members(), F.min(_order()).alias("best")).drop("body")
    return materialize(heads.join(split, "digest", "left_anti").unionByName(exact), "local")


def _bodies(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """``digest, holder, body`` of the groups."""
    held = _few(groups.select("holder"))
    return rows.select("digest", F.col("row").alias("holder"), "body").join(held, "holder", "left_semi")


def take_in(batch: DataFrame, standing: list[Snapshot]) -> tuple[DataFrame, Snapshot]:
    """The delivery's groups, under the holder of a standing group if there is one, and the snapshot
    of the new ones. ``batch`` is a stored frame of ``row, doc_id, length, digest, body``."""
    local = _local_groups(batch)
    merged = local.withColumn("known", F.lit(False))
    for snapshot in standing:
        flagged = materialize(screened(local.select("digest").distinct(), snapshot), "flagged")
        passed = _few(flagged)
        new = _bodies(local.join(passed, "digest", "left_semi"), batch)
        old = _bodies(snapshot.groups.join(passed, "digest", "left_semi"), snapshot.rows)
        same = new.join(old.withColumnRenamed("holder", "older"), ["digest", "body"]).select("holder", "older")
        merged = (
            merged.join(same, "holder", "left")
            .withColumn("known", F.col("known") | F.col("older").isNotNull())
            .withColumn("holder", F.coalesce("older", "holder"))
            .drop("older")
        )
    merged = materialize(merged.select("digest", "holder", "copies", "best", "known"), "merged")
    return merged.drop("known"), _snapshot(batch, merged.where("not known").drop("known"))


def deduplicated(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    deliveries: int = 2,
    digest: Callable[[bytes], bytes] = sha256,
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, digest`` of each row.

    The rows come in so many deliveries (by a hash of the id), each screened by the snapshots of
    the ones before; the result doesn't depend on their number.
    """
    plain = id_and_text(docs, doc_id, text)
    rows = materialize(
        plain.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            remainder("doc_id", deliveries).alias("delivery"),
            signature("text", digest).alias("s"),
        ).select("row", "doc_id", "delivery", "s.*"),
        "rows",
    )
    snapshots: list[Snapshot] = []
    found = []
    for number in range(deliveries):
        groups, snapshot = take_in(rows.where(F.col("delivery") == number).drop("delivery"), snapshots)
        snapshots.append(snapshot)
        found.append(groups)
    totals = materialize(
        reduce(DataFrame.unionByName, found)
        .groupBy("digest", "holder")
        .agg(F.sum("copies").alias("copies"), F.min("best").alias("best")),
        "totals",
    )
    split = materialize(totals.groupBy("digest").count().where("count > 1").select("digest"), "split")
    several = not split.isEmpty()
    single = totals.join(split, "digest", "left_anti") if several else totals
    narrow = rows.select("row", "doc_id", "digest")
    large, hot = _hot(single, rows.count())
    parts = [
        narrow.join(F.broadcast(single.where(large)), "digest"),
        narrow.join(hot, "digest", "left_anti").join(single.where(~large), "digest"),
    ]
    if several:  # different texts of one digest: rows find their group by their bytes
        bodies = _bodies(totals.join(split, "digest", "left_semi"), rows).join(totals, ["digest", "holder"])
        whole = rows.select("row", "doc_id", "digest", "body").join(split, "digest", "left_semi")
        parts.append(whole.join(bodies, ["digest", "body"]).select(parts[0].columns))
    return reduce(DataFrame.unionByName, parts).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("copies").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        "digest",
    )
