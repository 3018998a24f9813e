"""The library's front: versioning states of registered types into a store, and reading their histories."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from threading import BoundedSemaphore

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.metadata import Context
from palimpsest.model import ENTITY, HYBRID, ConfigurationError, NotFound, ValidationError
from palimpsest.operators import integrity, query, reconstruct, redact
from palimpsest.operators.guardrails import split_by_size, tenant_scope
from palimpsest.operators.versioning import payload, reject_invalid, version_batch
from palimpsest.plans.hooks import Hooks
from palimpsest.plans.migrations import Migrations
from palimpsest.plans.registry import EntityType, Registry
from palimpsest.sources.scratch import current, materialize
from palimpsest.sources.store import VersionStore
from palimpsest.streaming.monitor import Meter


QUEUED = 100  # submitted calls that wait or run


class Auditor:
    """Set-at-a-time: a call versions or reads any number of entities."""

    def __init__(self, spark: SparkSession, root: str, strategy: int = HYBRID, interval: int = 10, chain: bool = True, max_entity: int = 0, max_metadata: int = 0):
        self.spark, self.store = spark, VersionStore(spark, root)
        self.registry, self.hooks, self.migrations = Registry(), Hooks(), Migrations()
        self.meter = Meter()
        self._pool, self._waiting = ThreadPoolExecutor(1), BoundedSemaphore(QUEUED)
        self.strategy, self.interval, self.chain = strategy, interval, chain
        self.max_entity, self.max_metadata = max_entity, max_metadata
        self.store.migrate()

    def register(self, name: str, schema) -> EntityType:
        return self.registry.register(name, schema)

    def version(self, entity_type: str, states: DataFrame, context: Context | None = None, order: tuple[str, ...] = ("created_at",)) -> DataFrame:
        """Version the states (entity_id, state, created_at); returns the rows that were rejected, with ``error``.

        One snapshot is published for all of them, or none. What is too large is refused before it is numbered: it is no
        version and no later state is compared with it.
        """
        with self.meter.span("audit.version", entity_type=entity_type):
            return self._version(entity_type, states, context, order)

    def _version(self, entity_type: str, states: DataFrame, context: Context | None, order: tuple[str, ...]) -> DataFrame:
        kind = self.registry.get(entity_type)
        if states is None:
            raise ValidationError("no states")
        states = self.hooks.writing(states)
        if "metadata" not in states.columns:
            states = states.withColumn("metadata", (context or Context()).metadata(F.col("created_at")))
        good, bad = reject_invalid(states)
        large = None
        if self.max_entity > 0 or self.max_metadata > 0:
            good, large = split_by_size(good.withColumn("data", payload(kind, F.col("state"))), self.max_entity, self.max_metadata)
        latest = query.latest_versions(self.store.read().where(F.col("entity_type") == kind.name))
        stored = latest.select("entity_id", "version", F.from_json("data", kind.schema).alias("state"))
        records = version_batch(good.drop("data"), kind, list(order), stored, self.strategy, self.interval)
        if self.chain:
            records = integrity.hash_chain(records, latest.select(*ENTITY, "hash"))
        with self.meter.span("audit.store.write", entity_type=entity_type):
            self.store.append(materialize(records, "versions"), strict=True)
        refused = bad if large is None else bad.unionByName(large, allowMissingColumns=True)
        return refused.select(F.lit(kind.name).alias("entity_type"), "entity_id", "error")

    def submit(self, entity_type: str, states: DataFrame, context: Context | None = None, order: tuple[str, ...] = ("created_at",)) -> Future:
        """``version`` in the background, one call after the other; its result or error is the future's.

        Blocks while ``QUEUED`` calls wait. The queue is this process's: what must survive it goes to a log first.
        """
        self._waiting.acquire()
        try:
            call = self._pool.submit(self.version, entity_type, states, context, order)
        except RuntimeError:
            self._waiting.release()
            raise
        call.add_done_callback(lambda _: self._waiting.release())
        return call

    def close(self) -> None:
        """Ends when all submitted calls are done; no more are taken."""
        self._pool.shutdown(wait=True)

    def records(self, entity_type: str | None = None, tenant: str | None = None) -> DataFrame:
        """All records the hooks and the tenant let through, migrated to the latest schema_version."""
        df = tenant_scope(self.hooks.reading(self.store.read()), tenant)
        df = df if entity_type is None else df.where(F.col("entity_type") == self.registry.get(entity_type).name)
        return self.migrations.read(df)

    def states(self, entity_type: str, tenant: str | None = None) -> DataFrame:
        return self.records(entity_type, tenant).withColumn("state", F.from_json("data", self.registry.get(entity_type).schema))

    def get_version(self, entity_type: str, entity_id: str, version: int, tenant: str | None = None) -> DataFrame:
        return query.get_version(query.entity(self.records(entity_type, tenant), entity_type, entity_id), version)

    def get_latest(self, entity_type: str, entity_id: str | None = None, tenant: str | None = None) -> DataFrame:
        df = self.records(entity_type, tenant)
        return query.latest_versions(df if entity_id is None else query.entity(df, entity_type, entity_id))

    def get_at_time(self, entity_type: str, at: str, entity_id: str | None = None, tenant: str | None = None) -> DataFrame:
        df = self.records(entity_type, tenant)
        return query.state_at_time(df if entity_id is None else query.entity(df, entity_type, entity_id), at)

    def get_bulk_at_time(self, entity_type: str, ids: list[str], at: str) -> DataFrame:
        wanted = self.spark.createDataFrame([(n, entity_type, i) for n, i in enumerate(ids)], "position int, entity_type string, entity_id string")
        return query.bulk_state_at_time(self.records(entity_type), wanted.withColumn("at", F.lit(at).cast("timestamp")))

    def list_versions(self, entity_type: str, entity_id: str | None = None, limit: int = query.PAGE, offset: int = 0, ascending: bool = False, tenant: str | None = None) -> DataFrame:
        df = self.records(entity_type, tenant)
        return query.list_versions(df if entity_id is None else query.entity(df, entity_type, entity_id), limit, offset, ascending)

    def compare(self, entity_type: str, v1: int, v2: int, entity_id: str | None = None) -> DataFrame:
        df = self.states(entity_type)
        if entity_id is not None:
            df = query.entity(df, entity_type, entity_id)
            if df.where(F.col("version").isin(v1, v2)).select("version").distinct().count() < len({v1, v2}):
                raise NotFound(f"{entity_type} {entity_id} has no versions {v1} and {v2}")
        return query.compare_versions(df, self.registry.get(entity_type), v1, v2)

    def find_changes(self, entity_type: str, path: str, entity_id: str | None = None) -> DataFrame:
        df = self.states(entity_type)
        return query.find_changes(df if entity_id is None else query.entity(df, entity_type, entity_id), self.registry.get(entity_type), path)

    def find_by_actor(self, entity_type: str, actor: str, limit: int | None = None) -> DataFrame:
        return query.find_by_actor(self.records(entity_type), actor, limit)

    def reconstruct(self, entity_type: str, version: int | None = None) -> DataFrame:
        return reconstruct.reconstruct(self.records(entity_type), version)

    def compact(self, most: int = 50) -> int:
        rows = materialize(reconstruct.compaction_plan(self.store.read(), most).where("compact").drop("compact"), "compacted")
        self.meter.record("audit.compaction.versions_merged", rows.count())
        with self.meter.span("audit.compaction"):
            return self.store.update(rows.withColumns({"strategy": F.lit(0).cast("short"), "delta": F.lit(None).cast(rows.schema["delta"].dataType)}), ("strategy", "delta"))

    def verify_integrity(self, entity_type: str | None = None, anchored: bool = False) -> DataFrame:
        if not self.chain:
            raise ConfigurationError("hash chains are off")
        df = self.hooks.reading(self.store.read())
        return integrity.verify_chains(df if entity_type is None else df.where(F.col("entity_type") == entity_type), anchored)

    def redact_field(self, entity_type: str, path: str, entity_id: str | None = None, rechain: bool = False) -> int:
        """Redact a field in all versions; returns how many changed. ``rechain`` computes the hashes anew."""
        df = self.store.read().where(F.col("entity_type") == entity_type)
        df = df if entity_id is None else df.where(F.col("entity_id") == entity_id)
        n = redact.count_redacted(df, path)
        if n:
            done = redact.redact_field(df, path)
            self.store.update(integrity.hash_chain(done) if rechain else done, ("data", "delta", "hash", "previous_hash"))
        return n

    def health(self, **probes: Callable[[], object]) -> DataFrame:
        """(name, healthy, error, millis) of the store and of further probes, which fail by raising or by saying False."""
        rows = []
        for name, probe in {"store": lambda: current(self.spark, self.store.root), **probes}.items():
            begun, error = time.time(), ""
            try:
                error = "unhealthy" if probe() is False else ""
            except Exception as e:
                error = str(e)
            rows.append((name, not error, error, round(1000 * (time.time() - begun))))
        return self.spark.createDataFrame(rows, "name string, healthy boolean, error string, millis long")
