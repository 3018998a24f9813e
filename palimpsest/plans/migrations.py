"""Migrations of stored payloads from one schema_version to the next, applied when records are read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.model import MigrationError


class Migrations:
    """Steps are functions from the payload Column to the payload Column of the next schema_version."""

    def __init__(self) -> None:
        self._steps: dict[tuple[str, int], Callable[[Column], Column]] = {}

    def register(self, entity_type: str, older: int, newer: int, step: Callable[[Column], Column]) -> None:
        if step is None or older < 1 or newer != older + 1:
            raise MigrationError(f"{entity_type}: a step goes from n to n + 1, n at least 1, not from {older} to {newer}")
        if (entity_type, older) in self._steps:
            raise MigrationError(f"{entity_type}: there is a step from {older} already")
        self._steps[entity_type, older] = step

    def latest(self, entity_type: str) -> int:
        return max((n + 1 for t, n in self._steps if t == entity_type), default=1)

    def has(self, entity_type: str) -> bool:
        return any(t == entity_type for t, _ in self._steps)

    def migrate(self, entity_type: str, data: Column, older: int, newer: int) -> Column:
        """data through all steps; unchanged if newer isn't greater."""
        for n in range(older, newer):
            if (entity_type, n) not in self._steps:
                raise MigrationError(f"{entity_type}: no step from {n} to {n + 1}")
            data = self._steps[entity_type, n](data)
        return data

    def read(self, df: DataFrame) -> DataFrame:
        """Records of types with steps in their latest schema_version; a CASE for each stored version, no UDF."""
        data, version = F.col("data"), F.col("schema_version")
        for t in {t for t, _ in self._steps}:
            last = self.latest(t)
            for n in range(last - 1, 0, -1):
                if all((t, k) in self._steps for k in range(n, last)):
                    hit = (F.col("entity_type") == t) & (F.col("schema_version") == n)
                    data = F.when(hit, self.migrate(t, F.col("data"), n, last)).otherwise(data)
                    version = F.when(hit, F.lit(last)).otherwise(version)
        return df.withColumns({"data": data, "schema_version": version.cast("int")})
