"""Callbacks before reads and writes, run on the driver while the plan is made."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from palimpsest.model import AuditError, ValidationError

Hook = Callable[[DataFrame], "DataFrame | None"]


class Hooks:
    """Hooks run in order of registration; a hook may return a DataFrame that takes the place of what it got.

    The first that raises stops the operation; anything but an AuditError becomes a ValidationError.
    """

    def __init__(self) -> None:
        self._read: list[Hook] = []
        self._write: list[Hook] = []

    def before_read(self, hook: Hook) -> None:
        self._read.append(hook)

    def before_write(self, hook: Hook) -> None:
        self._write.append(hook)

    @staticmethod
    def _run(hooks: list[Hook], df: DataFrame) -> DataFrame:
        for hook in hooks:
            try:
                df = hook(df) or df
            except AuditError:
                raise
            except Exception as e:
                raise ValidationError(f"hook: {e}") from e
        return df

    def reading(self, df: DataFrame) -> DataFrame:
        return self._run(self._read, df)

    def writing(self, df: DataFrame) -> DataFrame:
        return self._run(self._write, df)
