"""Current rows: of several rows with one key the one with the greatest created_at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def current_rows(df: DataFrame, *columns: Column, key: tuple[str, ...] = ("id",), order: str = "created_at") -> DataFrame:
    """One row per key: the key, ``order`` and the given columns of the row with the greatest ``order``.

    An aggregate, so repeated rows shrink before the shuffle and a hot key never gathers in one task. Rows tied in
    ``order`` are told apart by the columns' values; a null ``order`` is less than any other; null keys are one key.
    """
    best = F.max(F.struct(F.col(order), *columns)).alias("_best")
    return df.groupBy(*key).agg(best).select(*key, "_best.*")


def normal_hash(c: Column | str) -> Column:
    """Hashes compare without letter case and outer blanks; unset is null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.lower(F.btrim(c, F.lit(" \t\r\n"))), F.lit(""))
