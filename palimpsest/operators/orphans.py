"""References to records that do not exist.

Keys are 16-byte digests, spread evenly, so their leading bits cut them into key ranges of known size. References and the
rows they may refer to are first reduced, in the map, to one row per key, side and period, then sorted inside key ranges.
A range's task numbers its keys in order, which is the range's dictionary, and builds over these integers one compressed
bitmap per period of the references, one of all parents, and one per period of the parents that are there by its end.
Reference AND-NOT parent leaves what refers to nothing; reference AND parent AND-NOT parents there by then what refers to
something that came in a later period; inside the period in which a parent came, times are compared, aligned by integer.
The surviving bits are decoded to keys and joined back to the referring rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.bitmap import Bitmap
from palimpsest.operators.current import current_rows, normal_hash
from palimpsest.sources.scratch import materialize

RANGE_KEYS = 50_000  # keys of a range, on average
SURVIVOR = "key binary, period string, finding string, parent_at long"
ABSENT, LATER = "absent", "later"
_NO_TIME = -(2**63) + 1  # a parent without time isn't after anything


def _key(*columns):
    """16 bytes from the columns' values; null and '' differ."""
    return F.unhex(F.md5(F.to_json(F.array(*[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]))))


class _Range:
    """One key range: its dictionary and, by period, what is referenced and what is there."""

    def __init__(self) -> None:
        self.keys: list[bytes] = []
        self.periods: dict[str, int] = {}
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, part: pa.RecordBatch) -> None:
        """Rows in order of key."""
        keys = part.column("key").to_pylist()
        ordinals = np.empty(len(keys), np.int64)
        last, n = (self.keys[-1] if self.keys else None), len(self.keys) - 1
        for i, k in enumerate(keys):
            if k != last:
                self.keys.append(k)
                last, n = k, n + 1
            ordinals[i] = n
        told = part.column("period").dictionary_encode()
        codes = np.array([self.periods.setdefault(p, len(self.periods)) for p in told.dictionary.to_pylist()], np.int64)
        self.rows.append((ordinals, part.column("parent").to_numpy(False).astype(bool), codes[told.indices.to_numpy()], part.column("at").to_numpy(False)))

    def survivors(self) -> Iterator[tuple[str, str, np.ndarray, np.ndarray | None]]:
        """(period, finding, ordinals, parents' times)."""
        if not self.rows:
            return
        names = sorted(self.periods)
        rank = np.empty(len(names), np.int64)
        rank[[self.periods[p] for p in names]] = np.arange(len(names))
        ordinal, parent, period, at = (np.concatenate(c) for c in zip(*self.rows))
        period = rank[period]  # periods by their place in time
        never = np.iinfo(np.int64).max
        born, first = np.full(len(self.keys), never), np.full(len(self.keys), never)
        np.minimum.at(born, ordinal[parent], at[parent])
        earliest = parent & (at == born[ordinal])
        np.minimum.at(first, ordinal[earliest], period[earliest])  # the period of each parent's earliest time
        parents = Bitmap.of(np.unique(ordinal[parent]))
        there, done = Bitmap(), -1
        for p in np.unique(period[~parent]).tolist():
            mine = ~parent & (period == p)
            referenced = Bitmap.of(ordinal[mine])
            yield names[p], ABSENT, referenced.andnot(parents).ordinals(), None
            if not names[p]:
                continue  # a reference without time is never early
            there = there | Bitmap.of(np.flatnonzero((first > done) & (first <= p)))
            done = p
            late = (referenced & parents).andnot(there)
            inside = (referenced & Bitmap.of(np.flatnonzero(first == p))).ordinals()
            early = np.full(len(self.keys), never)
            early[ordinal[mine]] = at[mine]
            late = late | Bitmap.of(inside[early[inside] < born[inside]])
            yield names[p], LATER, late.ordinals(), born


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Survivors of the ranges of a task; rows come in order of range and key."""
    held, last = _Range(), None

    def end() -> Iterator[pa.RecordBatch]:
        for period, finding, ordinals, born in held.survivors():
            if n := len(ordinals):
                keys = pa.array([held.keys[o] for o in ordinals.tolist()], pa.binary())
                at = pa.array(born[ordinals]) if born is not None else pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([keys, pa.array([period] * n), pa.array([finding] * n), at], ["key", "period", "finding", "parent_at"])

    for batch in batches:
        ranges = batch.column("range").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(ranges)) + 1).tolist(), len(ranges)]
        for a, b in zip(cuts, cuts[1:]):
            if b == a:
                continue
            if last is not None and ranges[a] != last:
                yield from end()
                held = _Range()
            last = ranges[a]
            part = batch.slice(a, b - a)
            held.add(part)
    yield from end()


def dangling(references: DataFrame, parents: DataFrame, keys: int) -> DataFrame:
    """SURVIVOR rows: (key, period) of references (key, period, at) that are ``absent`` from parents (key, period, at), or
    of which one is ``later``: earlier than all parents with its key. Keys are binary, periods sortable text, '' for no
    time, at microseconds. ``keys``: about how many keys there are.
    """
    # leading bits of the key name its range
    bits = min(28, max(0, (keys // RANGE_KEYS).bit_length()))
    both = references.select("key", "period", "at", F.lit(False).alias("parent")).unionByName(parents.select("key", "period", "at", F.lit(True).alias("parent")))
    by = both.groupBy("key", "parent", "period").agg(F.min("at").alias("at"))
    of = F.shiftright(F.conv(F.substring(F.hex("key"), 1, 7), 16, 10).cast("int"), 28 - bits)
    ranged = by.withColumn("range", of).repartition("range").sortWithinPartitions("range", "key")
    return ranged.mapInArrow(_resolve, SURVIVOR)


def orphan_references(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, id, reason, month) of current rows whose previous_hash names no fitting row of their own history.

    Only current rows of the same table, entity_type and entity_id are looked up. reason: ``missing`` if none has the
    hash, else ``misplaced`` if none of those is the version before, else ``later`` if all of those were created after
    the row. month is that of the row's created_at. Unset hashes neither refer nor are found; null entity ids are one
    entity; a row without version is the version before of none and refers to none, so it is misplaced if its hash
    exists; without created_at it is never ``later`` and its month is null. Empty tables give no rows.
    """
    rows = None
    for name, df in tables.items():
        part = df.select(F.lit(name).alias("table_name"), "id", "created_at", "entity_type", "entity_id", "version", normal_hash("hash").alias("h"), normal_hash("previous_hash").alias("p"))
        rows = part if rows is None else rows.unionByName(part)
    entity = ["table_name", "entity_type", "entity_id"]
    known = F.col("version").isNotNull()
    keyed = rows.select(
        "table_name", "id", "created_at",
        F.when(F.col("h").isNotNull(), _key(*entity, "h")).alias("own_hash"), F.when(F.col("h").isNotNull() & known, _key(*entity, "h", "version")).alias("own"),
        F.when(F.col("p").isNotNull(), _key(*entity, "p")).alias("ref_hash"), F.when(F.col("p").isNotNull() & known, _key(*entity, "p", F.col("version") - 1)).alias("ref"),
    )
    log = materialize(current_rows(keyed, *[F.col(c) for c in ("own_hash", "own", "ref_hash", "ref")], key=("table_name", "id")), "references")
    n = log.count()
    month = F.date_format("created_at", "yyyy-MM")
    timed = log.select("*", month.alias("month"), F.coalesce(month, F.lit("")).alias("period"), F.unix_micros("created_at").alias("us"))
    refs = timed.where(F.col("ref_hash").isNotNull())
    known_at = F.coalesce("us", F.lit(_NO_TIME)).alias("at")

    def found(ref: str, own: str, of: DataFrame) -> DataFrame:
        """What dangles, by (``ref``, period)."""
        wanted = of.where(F.col(ref).isNotNull()).select(F.col(ref).alias("key"), "period", F.coalesce("us", F.lit(2**62)).alias("at"))
        return dangling(wanted, timed.where(F.col(own).isNotNull()).select(F.col(own).alias("key"), "period", known_at), n).withColumnRenamed("key", ref)

    # nearly every row is settled here: the version before is there and in time
    loose = refs.join(found("ref", "own", refs), ["ref", "period"], "left").where((F.col("finding") == ABSENT) | (F.col("us") < F.col("parent_at")) | F.col("ref").isNull())
    loose = materialize(loose.select("table_name", "id", "month", "period", "us", "ref_hash", "finding"), "loose")
    unplaced = loose.where(F.coalesce(F.col("finding") != LATER, F.lit(True)))
    unknown = found("ref_hash", "own_hash", unplaced).where(F.col("finding") == ABSENT).select("ref_hash", "period", F.lit(True).alias("gone"))
    first = unplaced.join(unknown, ["ref_hash", "period"], "left").select("table_name", "id", F.when(F.col("gone"), F.lit("missing")).otherwise(F.lit("misplaced")).alias("reason"), "month")
    return first.unionByName(loose.where(F.col("finding") == LATER).select("table_name", "id", F.lit("later").alias("reason"), "month"))
