"""Entity types: their schema and what their fields' flags say.

A field's flags are a comma-separated text in its metadata under ``version``: ``id`` (exactly one), ``tracked``,
``ignore``, ``normalized`` (a list whose order doesn't count) and ``redactable``. A struct marked ``embedded`` has its
fields promoted to the level above. Unknown flags are ignored.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.sql import types as T

from palimpsest.model import ConfigurationError

FLAGS = frozenset({"id", "tracked", "ignore", "normalized", "redactable", "embedded"})
# Fixed value.
MAX_PAYLOAD = 5 * 1024 * 1024


def tagged(name: str, kind: T.DataType, flags: str = "", nullable: bool = True) -> T.StructField:
    return T.StructField(name, kind, nullable, {"version": flags} if flags else {})


def flags_of(f: T.StructField) -> frozenset[str]:
    return frozenset(x.strip() for x in f.metadata.get("version", "").split(",")) & FLAGS


@dataclass(frozen=True)
class EntityType:
    name: str
    schema: T.StructType
    id_field: str

    def paths(self, flag: str) -> list[str]:
        """Dotted paths of the fields with a flag."""
        def walk(s: T.StructType, prefix: str):
            for f in s.fields:
                path = prefix + f.name
                if flag in flags_of(f):
                    yield path
                if isinstance(f.dataType, T.StructType):
                    yield from walk(f.dataType, prefix if "embedded" in flags_of(f) else path + ".")

        return list(walk(self.schema, ""))


@dataclass
class Registry:
    """``strict``: binary fields that are not ignored are an error, else a warning. ``max_payload`` 0: no limit."""

    guardrails: bool = False
    strict: bool = False
    max_payload: int = MAX_PAYLOAD
    types: dict[str, EntityType] = field(default_factory=dict)

    def register(self, name: str, schema: T.StructType) -> EntityType:
        key = name.lower()
        if not key:
            raise ConfigurationError("an entity type needs a name")
        if key in self.types:
            raise ConfigurationError(f"{key} is registered already")
        ids = [f.name for f in schema.fields if "id" in flags_of(f)]
        if len(ids) != 1:
            raise ConfigurationError(f"{key} must have one id field, it has {len(ids)}")
        self._check(key, schema)
        self.types[key] = EntityType(key, schema, ids[0])
        return self.types[key]

    def get(self, name: str) -> EntityType:
        if name.lower() not in self.types:
            raise ConfigurationError(f"{name} is not registered")
        return self.types[name.lower()]

    def names(self) -> list[str]:
        return sorted(self.types)

    def _check(self, name: str, schema: T.StructType) -> None:
        for f in schema.fields:
            if isinstance(f.dataType, (T.CalendarIntervalType, T.NullType)):
                raise ConfigurationError(f"{name}.{f.name}: {f.dataType.simpleString()} can't be versioned")
            if self.guardrails and isinstance(f.dataType, T.BinaryType) and "ignore" not in flags_of(f):
                if self.strict:
                    raise ConfigurationError(f"{name}.{f.name} is binary and not ignored")
                warnings.warn(f"{name}.{f.name} is binary and not ignored", stacklevel=3)
            if isinstance(f.dataType, T.StructType):
                self._check(f"{name}.{f.name}", f.dataType)
