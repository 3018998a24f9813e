"""Hash chains over version histories."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.canon import chain_parts, chain_payload
from palimpsest.model import ENTITY
from palimpsest.plans.blocks import with_previous


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes along sorted rows; one entity's chain is sequential by nature, but nothing of it is held."""
    entity, previous = None, ""
    for batch in batches:
        hashes, before = [], []
        for t, e, head, seed in zip(*(batch.column(c).to_pylist() for c in ("entity_type", "entity_id", "_head", "_seed"))):
            if (t, e) != entity:
                entity, previous = (t, e), seed or ""
            before.append(previous)
            previous = sha256(f'{head}{previous}"}}'.encode()).hexdigest()
            hashes.append(previous)
        keep = [n for n in batch.schema.names if not n.startswith("_")]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(hashes), pa.array(before)], [*keep, "hash", "previous_hash"])


def hash_chain(df: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """df with hash and previous_hash computed in order of version, entity by entity.

    ``seeds``: entity_type, entity_id, hash of stored histories that df continues. Payloads are prepared in the JVM; the
    fold streams over sorted partitions, so a long chain needs time but no memory.
    """
    rows = df.drop("hash", "previous_hash")
    head, tail = chain_parts(F.col("entity_type"), F.col("entity_id"), F.col("data"))
    joined = rows.withColumn("_seed", F.lit(None).cast("string")) if seeds is None else rows.join(seeds.select(*ENTITY, F.col("hash").alias("_seed")), ENTITY, "left")
    ready = joined.withColumn("_head", F.concat(head, F.col("version").cast("string"), tail, F.lit('"'))).repartition(*ENTITY).sortWithinPartitions(*ENTITY, "version")
    kept = [f for f in ready.schema.fields if not f.name.startswith("_")]
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", hash string, previous_hash string"
    return ready.mapInArrow(_fold, out)


def check_chain(df: DataFrame, anchored: bool = False) -> DataFrame:
    """df with ``error``: null, ``pointer`` (previous_hash isn't the hash before) or ``hash`` (not that of the content).

    All rows at once: the hash is recomputed from the row's own previous_hash, the pointer compared with the row before.
    ``anchored``: the first surviving version may point to one that retention removed.
    """
    rows = with_previous(df, ENTITY, "version", ["hash"], "_before")
    pointer = F.coalesce(F.col("previous_hash"), F.lit("")) == F.coalesce(F.col("_before.hash"), F.lit(""))
    if anchored:
        pointer = pointer | F.col("_before").isNull()
    own = F.sha2(chain_payload(F.col("entity_type"), F.col("entity_id"), F.col("version"), F.col("data"), F.col("previous_hash")), 256)
    return rows.withColumn("error", F.when(~pointer, "pointer").when(~own.eqNullSafe(F.col("hash")), "hash")).drop("_before")


def verify_chains(df: DataFrame, anchored: bool = False) -> DataFrame:
    """(entity_type, entity_id, ok, first_bad_version, error) of each entity."""
    bad = F.when(F.col("error").isNotNull(), F.struct("version", "error"))
    by = check_chain(df, anchored).groupBy(*ENTITY).agg(F.min(bad).alias("b"))
    return by.select(*ENTITY, F.col("b").isNull().alias("ok"), F.col("b.version").alias("first_bad_version"), F.col("b.error").alias("error"))
