"""Versioning, merging and windows over streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from palimpsest.functions.canon import chain_parts
from palimpsest.model import FULL, HYBRID
from palimpsest.operators.diff import CHANGE_TYPE
from palimpsest.operators.versioning import DEFAULT_INTERVAL, stored_form, visible_fields
from palimpsest.plans.registry import EntityType

CHAINED = "entity_type string, entity_id string, id string, version long, data string, created_at timestamp, hash string, previous_hash string, previous_data string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Versioner(StatefulProcessor):
    """Keeps of each entity its last version number, hash and payload."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "version long, hash string, data string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:  # noqa: N802
        version, previous, payload = tuple(self.last.get()) if self.last.exists() else (0, "", None)
        # a micro-batch's rows of one entity come in any order; the source's trigger options bound how many there are
        pending = pd.concat(list(rows)).sort_values(["created_at", "id"], kind="stable")
        out = []
        for row in pending.itertuples(index=False):
            if row.data == payload:
                continue
            version += 1
            own = sha256(f'{row.head}{version}{row.tail}"{previous}"}}'.encode()).hexdigest()
            out.append((key[0], key[1], row.id, version, row.data, row.created_at, own, previous, payload))
            previous, payload = own, row.data
        self.last.update((version, previous, payload))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHAINED.split(", ")])

    def close(self) -> None:
        pass


def version_stream(states: DataFrame, kind: EntityType | None = None, interval: int = DEFAULT_INTERVAL, delay: str | None = None, default: int = HYBRID) -> DataFrame:
    """Version records for a stream of (entity_type, entity_id, id, data, created_at), as the batch would write them.

    Columns: entity_type, entity_id, id, version, strategy, data, delta, created_at, hash, previous_hash. Repeats of an id
    are dropped (within ``delay`` of event time, if given); states equal to the one before and rows without data give no
    version. Numbers and hash chain go on across micro-batches and restarts: they are in the state store. ``kind``: the
    entities' type, whose schema the deltas follow; without it all versions are stored full.
    """
    states.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    once = states.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["id"]) if delay else states
    head, tail = chain_parts(F.col("entity_type"), F.col("entity_id"), F.col("data"))
    ready = once.where("data is not null").select("entity_type", "entity_id", "id", "data", "created_at", head.alias("head"), tail.alias("tail"))
    chained = ready.groupBy("entity_type", "entity_id").transformWithStateInPandas(_Versioner(), CHAINED, "Append", "None")
    if kind is None:
        form = F.struct(F.lit(FULL).cast("short").alias("strategy"), F.lit(None).cast(CHANGE_TYPE).alias("delta"))
    else:
        shape = T.StructType(visible_fields(kind))
        then, now = (F.from_json(c, shape) for c in ("previous_data", "data"))
        form = stored_form(F.col("version"), then, now, shape, default, interval=interval)
    formed = chained.withColumn("_form", form)
    return formed.select("entity_type", "entity_id", "id", "version", "_form.strategy", "data", "_form.delta", "created_at", "hash", "previous_hash")


def change_windows(events: DataFrame, at: str, width: str, slide: str | None = None, by: list[str] | None = None, delay: str = "10 minutes") -> DataFrame:
    """Changes per tumbling or sliding window of event time; rows later than ``delay`` are left out."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    timed = timed.withWatermark(at, delay) if timed.isStreaming else timed
    grouped = timed.groupBy(w.alias("w"), *(by or [])).agg(F.count("*").alias("changes"))
    return grouped.select(*(by or []), F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "changes")


def sessions(events: DataFrame, at: str, gap: str, by: list[str], delay: str = "10 minutes") -> DataFrame:
    """Bursts of changes: sessions that end after a gap."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    timed = timed.withWatermark(at, delay) if timed.isStreaming else timed
    grouped = timed.groupBy(F.session_window(at, gap).alias("w"), *by).agg(F.count("*").alias("changes"))
    return grouped.select(*by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "changes")


def fan_out(*sinks: Callable[[DataFrame, int], None], seconds: float = 5.0, log: Callable[[str], None] = print) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that gives each micro-batch to all sinks at once; failures and timeouts are isolated.

    The first sink is the store: its failure fails the batch, so it is tried again.
    """
    def run(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            sinks[0](batch, number)
            pool = ThreadPoolExecutor(max(1, len(sinks) - 1))
            waiting = [pool.submit(s, batch, number) for s in sinks[1:]]
            for f in waiting:
                try:
                    f.result(timeout=seconds)
                except Exception as e:
                    log(f"batch {number}: a subscriber failed: {e!r}")
            pool.shutdown(wait=False, cancel_futures=True)
        finally:
            batch.unpersist()

    return run
