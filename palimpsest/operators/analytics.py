"""Aggregates over version records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes_per_day(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    day = F.date_format("created_at", "yyyy-MM-dd").alias("day")
    return df.groupBy(*(by or []), day).agg(F.count("*").alias("changes"))


def changes_by_actor(df: DataFrame, actor: str = "metadata.actor_id") -> DataFrame:
    return df.groupBy(F.col(actor).alias("actor_id")).agg(F.count("*").alias("changes"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


def distinct_entities(df: DataFrame, by: str, approximate: bool = False, error: float = 0.02) -> DataFrame:
    count = F.approx_count_distinct("entity_id", error) if approximate else F.countDistinct("entity_id")
    return df.groupBy(by).agg(count.alias("entities"))


def changes_rollup(df: DataFrame, *columns: str) -> DataFrame:
    """Counts for each prefix of the columns; ``level`` is the number of columns rolled up."""
    marks = [F.grouping(c).cast("int") for c in columns]
    return df.rollup(*columns).agg(F.count("*").alias("changes"), sum(marks[1:], marks[0]).alias("level"))


def changes_cube(df: DataFrame, *columns: str) -> DataFrame:
    return df.cube(*columns).agg(F.count("*").alias("changes"), F.grouping_id().alias("grouping_id"))
