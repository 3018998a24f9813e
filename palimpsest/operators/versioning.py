"""Giving versions to incoming states: number, strategy, delta, fallback to full, record.

Numbers, previous states and deltas come from the same windows over the incoming states, with the stored latest state of
each entity as row zero; the windows run in pieces of histories (plans/blocks.py), so a hot entity is spread like others.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.canon import json_text, let
from palimpsest.model import CONTENT_TYPES, DELTA, ENTITY, FULL, HYBRID, DiffFallback, record_id
from palimpsest.operators.diff import CHANGE_TYPE, changes, valid
from palimpsest.plans.blocks import Blocks
from palimpsest.plans.registry import EntityType, flags_of

log = logging.getLogger("palimpsest")

DEFAULT_INTERVAL = 10


def number_versions(incoming: DataFrame, stored: DataFrame | None, order: list[str], by: list[str] = ENTITY) -> DataFrame:
    """incoming with ``version``: 1, 2, ... after the greatest stored version of the entity, in the given order."""
    b = Blocks(incoming, by, order, slice_by=order[0])
    rows = b.rows.withColumn("_n", F.row_number().over(b.inside))
    rows = b.carry(rows, {"_count": F.count("*")}, {"_before": F.sum("_count")})
    rows = b.done(rows.withColumn("version", F.col("_n") + F.coalesce("_before", F.lit(0))), "version")
    if stored is None:
        return rows
    latest = stored.groupBy(*by).agg(F.max("version").alias("_latest"))
    return rows.join(latest, by, "left").withColumn("version", F.col("version") + F.coalesce("_latest", F.lit(0))).drop("_latest")


def select_strategy(version: Column, default: int | Column, override: Column | None = None, interval: int = DEFAULT_INTERVAL) -> Column:
    """The first version is full; then the override or default decides; hybrid is full where version mod interval is 1.

    The stored value is never hybrid. An interval under 2 is taken as 10.
    """
    n = interval if interval >= 2 else DEFAULT_INTERVAL
    default = F.lit(default) if isinstance(default, int) else default
    chosen = F.coalesce(override, default) if override is not None else default
    hybrid = F.when(version % n == 1, FULL).otherwise(DELTA)
    return F.when(version == 1, FULL).when(chosen == HYBRID, hybrid).otherwise(chosen).cast("short")


def visible_fields(entity: EntityType, keep_ignored: bool = False) -> list[T.StructField]:
    return [f for f in entity.schema.fields if keep_ignored or "ignore" not in flags_of(f)]


def visible(c: Column, fields: list[T.StructField]) -> Column:
    return F.when(c.isNotNull(), F.struct(*[c[f.name].alias(f.name) for f in fields]))


def payload(entity: EntityType, state: Column, keep_ignored: bool = False) -> Column:
    """The JSON text that is stored of a state; types that have no canonical text are written as Spark writes them."""
    fields = visible_fields(entity, keep_ignored)
    now = visible(state, fields)
    try:
        return json_text(now, T.StructType(fields))
    except DiffFallback:
        return F.to_json(now, {"ignoreNullFields": "false"})


def stored_form(version: Column, then: Column, now: Column, shape: T.StructType, default: int = HYBRID, override: Column | None = None, interval: int = DEFAULT_INTERVAL, validate: bool = True) -> Column:
    """struct<strategy, delta> of a version that follows a state.

    Stored full, without delta: where the strategy says so, where the state before is missing, where the delta doesn't
    lead from it to the new state (``validate``), and all versions of types that can't be compared (DiffFallback).
    """
    wanted = F.when(then.isNull(), FULL).otherwise(select_strategy(version, default, override, interval))
    try:
        delta = F.when(wanted != FULL, changes(then, now, shape))
        holds = (lambda d: valid(then, now, d, shape)) if validate else (lambda d: F.lit(True))
    except DiffFallback as e:
        log.warning("versions are stored full: %s", e)
        return F.struct(F.lit(FULL).cast("short").alias("strategy"), F.lit(None).cast(CHANGE_TYPE).alias("delta"))

    def form(d: Column) -> Column:
        full = (wanted == FULL) | ~F.coalesce((F.size(d) == 0) | holds(d), F.lit(False))
        return F.struct(F.when(full, FULL).otherwise(wanted).cast("short").alias("strategy"), F.when(~full & (F.size(d) > 0), d).cast(CHANGE_TYPE).alias("delta"))

    return let(delta, form)


def version_batch(incoming: DataFrame, entity: EntityType, order: list[str], latest: DataFrame | None = None, default: int = HYBRID, interval: int = DEFAULT_INTERVAL, validate: bool = True, at: str = "created_at", keep_ignored: bool = False) -> DataFrame:
    """Version records (without hashes) of states.

    incoming: entity_id, state (struct of the entity's schema), ``at``, optionally metadata and strategy (an override).
    latest: entity_id, version, state of stored entities. What is stored as delta says ``stored_form``. Fields flagged
    ``ignore`` stay out of data unless ``keep_ignored``; then a change of one makes its version full. States that must
    not be stored have to be taken out before: each one here is numbered and is the next one's predecessor.
    """
    start = incoming.withColumn("_new", F.lit(1))
    if latest is not None:
        rows = latest.select("entity_id", "state", F.lit(0).alias("_new"), F.col("version").alias("_base"))
        start = start.withColumn("_base", F.lit(None).cast("long")).unionByName(rows, allowMissingColumns=True)
    else:
        start = start.withColumn("_base", F.lit(0).cast("long"))
    b = Blocks(start.withColumn("_at", F.col(order[0])), ["entity_id"], ["_new", *order], slice_by="_at")
    rows = b.rows.withColumn("_row", F.row_number().over(b.inside)).withColumn("_lag", F.lag(F.struct("state")).over(b.inside)).withColumn("_sum", F.sum("_new").over(b.running)).withColumn("_stored", F.max("_base").over(b.running))
    # the stored row comes first, so its version is in an earlier block or before in this one
    rows = b.carry(rows, {"_count": F.sum("_new"), "_most": F.max("_base"), "_end": F.max_by(F.struct("state"), "_row")}, {"_before": F.sum("_count"), "_held": F.max("_most"), "_prior": F.last("_end")})
    version = F.coalesce(F.greatest("_stored", "_held"), F.lit(0)) + F.coalesce("_before", F.lit(0)) + F.col("_sum")
    previous = F.when(F.col("_row") == 1, F.col("_prior")).otherwise(F.col("_lag"))
    rows = b.done(rows.withColumn("version", version).withColumn("previous", previous["state"]), "version", "previous").where("_new = 1").drop("_new", "_base", "_at")
    fields = visible_fields(entity, keep_ignored)
    rows = rows.withColumn("_now", visible(F.col("state"), fields)).withColumn("_then", visible(F.col("previous"), fields))
    override = F.col("strategy") if "strategy" in incoming.columns else None
    rows = rows.withColumn("_form", stored_form(F.col("version"), F.col("_then"), F.col("_now"), T.StructType(fields), default, override, interval, validate))
    name = F.lit(entity.name)
    meta = F.col("metadata") if "metadata" in incoming.columns else F.lit(None).cast("string")
    return rows.select(
        record_id(name, F.col("entity_id"), F.col("version")).alias("id"), name.alias("entity_type"), "entity_id", "version", F.col("_form.strategy").alias("strategy"), F.lit(1).alias("schema_version"),
        payload(entity, F.col("state"), keep_ignored).alias("data"), F.lit(CONTENT_TYPES["json"]).alias("content_type"), F.col("_form.delta").alias("delta"), meta.alias("metadata"),
        F.lit("").alias("hash"), F.lit("").alias("previous_hash"), F.col(at).alias("created_at"),
    )


def reject_invalid(incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``error``): states without entity id or without state are not versioned."""
    error = F.when(F.coalesce(F.trim("entity_id"), F.lit("")) == "", "validation: empty entity id").when(F.col("state").isNull(), "configuration: no state")
    marked = incoming.withColumn("error", error)
    return marked.where("error is null").drop("error"), marked.where("error is not null")
