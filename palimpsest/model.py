"""The version record, its enumerations and the errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHANGE = T.StructType([T.StructField(n, T.StringType()) for n in ("path", "old_value", "new_value")])
METADATA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("actor_id", "actor_type", "reason", "correlation_id", "trace_id", "span_id", "source")]
    + [T.StructField("custom", T.MapType(T.StringType(), T.StringType())), T.StructField("timestamp", T.TimestampType())]
)
RECORD = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("entity_type", T.StringType()),
        T.StructField("entity_id", T.StringType()),
        T.StructField("version", T.LongType()),
        T.StructField("strategy", T.ShortType()),
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("data", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("delta", T.ArrayType(CHANGE)),
        T.StructField("metadata", METADATA),
        T.StructField("hash", T.StringType()),
        T.StructField("previous_hash", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)
KEY = ["entity_type", "entity_id", "version"]
ENTITY = KEY[:2]

FULL, DELTA, HYBRID = 0, 1, 2
# The names of the codes.
STRATEGIES = {FULL: "full", DELTA: "delta", HYBRID: "hybrid"}
ACTOR_TYPES = {0: "human", 1: "system", 2: "service"}
CONTENT_TYPES = {"json": "application/json", "msgpack": "application/msgpack"}


def _name(code: Column, names: dict[int, str]) -> Column:
    out = F.lit("unknown")
    for k, v in names.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def strategy_name(code: Column) -> Column:
    return _name(code, STRATEGIES)


def strategy_code(name: Column) -> Column:
    """Null for an unknown name."""
    return F.coalesce(*[F.when(name == v, F.lit(k)) for k, v in STRATEGIES.items()]).cast("short")


def actor_type_name(code: Column) -> Column:
    return _name(code, ACTOR_TYPES)


def record_id(entity_type: Column, entity_id: Column, version: Column) -> Column:
    """The same id for the same version, however often a job is retried."""
    return F.sha2(F.concat_ws("\0", entity_type, entity_id, version.cast("string")), 256)


def cache_key(entity_type: Column, entity_id: Column, version: Column) -> Column:
    return F.concat_ws(":", entity_type, entity_id, version.cast("string"))


def cold_key(entity_type: Column, entity_id: Column, version: Column) -> Column:
    return F.concat_ws("/", entity_type, entity_id, version.cast("string"))


class AuditError(Exception):
    """Of any operation on version records."""


class StorageError(AuditError):
    pass


class DiffError(AuditError):
    pass


class SerializationError(AuditError):
    pass


class ValidationError(AuditError):
    pass


class ConfigurationError(AuditError):
    pass


class WALError(AuditError):
    pass


class MigrationError(AuditError):
    pass


class DiffFallback(AuditError):
    """The field type can't be compared; the version is stored whole."""


class DuplicateVersion(StorageError):
    pass


class NotFound(AuditError):
    pass
