"""Rebuilding states from snapshots and deltas, and compacting long runs of deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.model import ENTITY, FULL
from palimpsest.operators.change_feed import rebuild_state
from palimpsest.plans.blocks import Blocks
from palimpsest.sources.scratch import materialize


def reconstruct(df: DataFrame, target: int | None = None) -> DataFrame:
    """Leaves (entity_type, entity_id, path, new_value) of each entity's state at a version (null: the latest).

    The nearest full version at or before the target, then each later delta: the change feed operator does both, with the
    change's place in its delta as its sequence. Entities without a snapshot give no row; null and empty deltas change
    nothing.
    """
    rows = df if target is None else df.where(F.col("version") <= target)
    at = F.col("created_at").cast("timestamp")
    # nothing before the nearest full version matters, so no more than the last deltas of an entity travel
    base = rows.where(F.col("strategy") == FULL).groupBy(*ENTITY).agg(F.max(F.struct("version", at.alias("received_at"), F.col("data").alias("new_value"))).alias("b"))
    base = materialize(base.select(*ENTITY, "b.*"), "snapshots")
    whole = base.select(*ENTITY, "version", F.lit(0).alias("change_seq"), F.lit(0).cast("short").alias("strategy"), F.lit("").alias("path"), "new_value", "received_at", F.lit(0).cast("long").alias("feed_id"))
    later = rows.where((F.col("strategy") != FULL) & (F.size("delta") > 0)).select(*ENTITY, "version", at.alias("received_at"), "delta")
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ENTITY]
    later = later.alias("l").join(base.select(*ENTITY, F.col("version").alias("_base")).alias("b"), [*on, F.col("l.version") > F.col("b._base")]).select("l.*")
    parts = later.select(*ENTITY, "version", "received_at", F.posexplode("delta").alias("change_seq", "c"))
    parts = parts.select(*ENTITY, "version", "change_seq", F.lit(1).cast("short").alias("strategy"), F.col("c.path").alias("path"), F.col("c.new_value").alias("new_value"), "received_at", F.lit(0).cast("long").alias("feed_id"))
    return rebuild_state(whole.unionByName(parts))


def compaction_plan(df: DataFrame, most: int = 50, by: list[str] = ENTITY) -> DataFrame:
    """df with ``compact``: true where a version that would be the ``most``-th delta in a row becomes full.

    Closed form of the walk: inside each run of deltas after a full version, every ``most``-th row. Runs go on across
    blocks of versions.
    """
    b = Blocks(df, by, ["version"], dense="version")
    full = F.col("strategy") == FULL
    rows = b.rows.withColumn("_deltas", F.sum((~full).cast("long")).over(b.running))
    # deltas of the block up to its last full version so far
    rows = rows.withColumn("_base", F.max(F.when(full, F.col("_deltas"))).over(b.running))
    rows = b.carry(
        rows,
        {"_all": F.max("_deltas"), "_tail": F.max("_deltas") - F.max(F.when(full, F.col("_deltas")))},
        {"_before": F.last("_upto"), "_mark": F.max(F.col("_upto") - F.col("_tail"))},
        through={"_upto": F.sum("_all")},
    )
    since = F.when(F.col("_base").isNotNull(), F.col("_deltas") - F.col("_base")).otherwise(F.col("_deltas") + F.coalesce("_before", F.lit(0)) - F.coalesce("_mark", F.lit(0)))
    return b.done(rows.withColumn("compact", ~full & (since % most == 0)), "compact")


def compact(df: DataFrame, most: int = 50) -> DataFrame:
    """Version records after compaction: chosen rows full and without delta; hashes stay, as data doesn't change."""
    rows = compaction_plan(df, most)
    delta = F.when(~F.col("compact"), F.col("delta"))
    return rows.withColumns({"strategy": F.when(F.col("compact"), FULL).otherwise(F.col("strategy")).cast("short"), "delta": delta}).drop("compact")
