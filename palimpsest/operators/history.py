"""History of changing entity attributes: for each entity the states it had and the period each was valid.

``change_log`` reduces version records to slim raw changes (a 16-byte digest stands for the state). ``build_chains``
orders them by entity and time across the whole cluster: the range partitioning cuts hot entities into pieces too, each
task derives the periods inside its piece in one pass, and what is open at either end (two fragments a task at most) is
stitched afterwards. ``rebuild_chains`` handles late and corrected rows: raw changes and chains lie in buckets of entities,
so only the touched buckets' folders are read; the touched entities' raw changes are retrieved, all their periods built
anew, and their chains replaced in one published step that writes these buckets only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from palimpsest.functions import arrow, jsonval
from palimpsest.operators.current import current_rows
from palimpsest.sources.scratch import BUCKET, buckets_of, materialize, materialize_buckets, new_path, publish_buckets, read_buckets, with_bucket

ENTITY = ["entity_type", "entity_id"]
PIECE = "entity_type string, entity_id string, first_version long, valid_from_us long, valid_to_us long, piece int, place int, first_state binary, second_us long, last_version long, last_us long, last_state binary"
CHAIN = ["entity_type", "entity_id", "first_version", "valid_from_us", "valid_to_us"]
OPEN = -1
BUCKETS = 32  # of entities, in which raw changes and chains are kept


@F.arrow_udf(BinaryType())
def _digests(texts: pa.Array) -> pa.Array:
    return jsonval.digests(texts)


def change_log(df: DataFrame, entity_types: tuple[str, ...] | None, late: Column | None = None) -> DataFrame:
    """Raw changes of the current rows: entity, version, id, created_at in microseconds, state, late.

    state is null where the row has no data. Written once, as it is read for the first build and for rebuilds.
    """
    wanted = F.col("entity_type").isin(*entity_types) if entity_types else F.lit(True)
    late = F.coalesce(late, F.lit(False)) if late is not None else F.lit(False)
    rows = df.select("id", "created_at", F.when(wanted, F.col("entity_type")).alias("entity_type"), F.when(wanted, F.col("entity_id")).alias("entity_id"), F.col("version").cast("long").alias("version"), wanted.alias("wanted"), late.alias("late"), _digests(F.when(wanted, F.col("data"))).alias("state"))
    rows = current_rows(rows, *[F.col(c) for c in (*ENTITY, "version", "wanted", "late", "state")]).where("wanted and created_at is not null")
    slim = rows.select(*ENTITY, "version", "id", F.unix_micros("created_at").alias("us"), "state", "late")
    return materialize_buckets(with_bucket(slim, BUCKETS, *ENTITY), "changes")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    piece, place = TaskContext.get().partitionId(), 0
    schema = arrow.schema(PIECE)
    out: list[tuple] = []
    entity = first = second = last = None  # boundaries (version, us, state) of the entity's part in this piece
    opening = True  # in the piece's first entity

    def row(now: tuple) -> None:
        nonlocal first, second, last
        if first is None:
            first = last = now
        elif now[2] != last[2]:
            if second is None:
                second = now
                if not opening and first[2] is not None:
                    out.append((*entity, first[0], first[1], now[1], *[None] * 7))
            elif last[2] is not None:
                out.append((*entity, last[0], last[1], now[1], *[None] * 7))
            last = now

    def end(closing: bool) -> None:
        nonlocal opening, place
        if entity is None:
            return
        if opening or closing:
            # the first period is told by the fragment, unless it is out already
            told = not opening and second is not None
            start = last if told else first
            out.append((*entity, start[0], start[1], None, piece, place, start[2], None if told or second is None else second[1], last[0], last[1], last[2]))
            place += 1
        elif last[2] is not None:
            out.append((*entity, last[0], last[1], OPEN, *[None] * 7))
        opening = False

    def flush():
        rows = arrow.batch(out, schema)
        out.clear()
        return rows

    for batch in batches:
        for t, e, us, v, s in zip(*(batch.column(c).to_pylist() for c in (*ENTITY, "us", "version", "state"))):
            if (t, e) != entity:
                end(False)
                entity, first, second, last = (t, e), None, None, None
            row((v, us, s))
        if len(out) >= 10_000:
            yield flush()
    end(True)
    yield flush()


def _stitch(fragments: list) -> Iterator[tuple]:
    """Periods from fragments in order of piece and place."""
    entity = run = None

    def close(until: int):
        if run is not None and run[2] is not None:
            yield (*entity, run[0], run[1], until)

    for f in fragments:
        if (f.entity_type, f.entity_id) != entity:
            if entity:
                yield from close(OPEN)
            entity, run = (f.entity_type, f.entity_id), None
        if run is None or run[2] != f.first_state:
            yield from close(f.valid_from_us)
            run = f.first_version, f.valid_from_us, f.first_state
        if f.second_us is not None:
            yield from close(f.second_us)
            run = f.last_version, f.last_us, f.last_state
    if entity:
        yield from close(OPEN)


def build_chains(log: DataFrame) -> DataFrame:
    """CHAIN rows of a change log. valid_to_us is -1 while open.

    If a version has several ids, the row with the greatest time, then id, counts; of one time only the highest version.
    """
    spark = log.sparkSession
    one = log.groupBy(*ENTITY, "version").agg(F.max(F.struct("us", "id", "state")).alias("r")).select(*ENTITY, "version", "r.us", "r.state")
    one = one.groupBy(*ENTITY, "us").agg(F.max(F.struct("version", "state")).alias("r")).select(*ENTITY, "us", "r.version", "r.state")
    one = materialize(one, "versions")  # the range partitioning reads it twice, to sample and to sort
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = one.repartitionByRange(n, *ENTITY, "us").sortWithinPartitions(*ENTITY, "us")
    pieces = materialize(ordered.mapInArrow(_pieces, PIECE), "periods")
    fragments = pieces.where("piece is not null").collect()  # two for each of the n tasks at most
    stitched = list(_stitch(sorted(fragments, key=lambda f: (f.piece, f.place))))
    rows = spark.createDataFrame(stitched, "entity_type string, entity_id string, first_version long, valid_from_us long, valid_to_us long")
    return pieces.where("piece is null").select(*CHAIN).unionByName(rows)


def rebuild_chains(chains: DataFrame, log: DataFrame, touched: DataFrame) -> tuple[DataFrame, list[int]]:
    """(rows, buckets): what the buckets of the touched entities hold once these entities' chains are built anew.

    Raw changes and chains of other buckets are not read; inside the buckets only the touched entities' changes are used,
    all of them, and the other entities' chains stay.
    """
    keys = materialize(touched.select(*ENTITY, BUCKET).distinct(), "touched")
    buckets = buckets_of(keys)
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ENTITY]
    mine = F.col(BUCKET).isin(buckets)
    raw = log.where(mine).alias("a").join(keys.alias("b"), on[0] & on[1], "left_semi")
    kept = chains.where(mine).alias("a").join(keys.alias("b"), on[0] & on[1], "left_anti")
    return kept.select(*CHAIN, BUCKET).unionByName(with_bucket(build_chains(raw), BUCKETS, *ENTITY)), buckets


def history(df: DataFrame, entity_types: tuple[str, ...] | None = None, late_by: str = "1 hour", root: str | None = None) -> DataFrame:
    """Valid periods (CHAIN) of each entity's states: load what came in time, then fold in the late rows.

    Order is that of created_at. A row with data starts a period unless its data equals that of the running one; a
    period ends where the next starts or at a row with no data. A row is late if created_at is more than ``late_by``
    behind metadata.timestamp: such rows come as a second delivery, which touches their entities only. The result is
    published under ``root`` in one step and read back. Rows without created_at have no place in time and are left out;
    null entity ids are one entity; repeated rows don't matter; text that is not JSON is a state of its own; empty tables
    give no rows; other columns are not read.
    """
    spark = df.sparkSession
    root = root or new_path(spark, "history")
    log = change_log(df, entity_types, F.col("created_at") > F.col("metadata.timestamp") + F.expr(f"interval {late_by}"))
    publish_buckets(with_bucket(build_chains(log.where("not late")), BUCKETS, *ENTITY), root)
    apply_late(spark, root, log, log.where("late"))
    return read_buckets(spark, root).select(*CHAIN)


def apply_late(spark: SparkSession, root: str, log: DataFrame, delivery: DataFrame) -> int:
    """Fold a delivery of late or corrected changes, which ``log`` holds too, into the published chains in one step.

    Its cost grows with the buckets that the delivery touches; the others' files stay as they are.
    """
    rows, buckets = rebuild_chains(read_buckets(spark, root), log, delivery)
    return publish_buckets(rows, root, replaced=buckets)
