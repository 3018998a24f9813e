"""Retention, tiers and merging of superseded rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.model import KEY

# Ages at which records leave a tier.
WARM_DAYS, COLD_DAYS = 90, 730


def _cutoff(now: str | Column, days: int | Column) -> Column:
    t = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    return t - F.make_interval(days=F.lit(days) if isinstance(days, int) else days)


def retention_split(df: DataFrame, days: dict[str, int], now: str | Column) -> DataFrame:
    """df with ``expired``: created_at strictly before ``now`` minus the type's days. Types without (or with 0) days stay."""
    out = F.lit(False)
    for name, n in days.items():
        if n > 0:
            out = F.when(F.col("entity_type") == name, F.col("created_at") < _cutoff(now, n)).otherwise(out)
    return df.withColumn("expired", F.coalesce(out, F.lit(False)))


def retain(df: DataFrame, days: dict[str, int], now: str | Column) -> tuple[DataFrame, DataFrame]:
    """(rows to keep, (entity_type, deleted) counts)."""
    marked = retention_split(df, days, now)
    return marked.where("not expired").drop("expired"), marked.where("expired").groupBy("entity_type").agg(F.count("*").alias("deleted"))


def tier(created_at: Column, now: str | Column, warm_days: int = WARM_DAYS, cold_days: int = COLD_DAYS) -> Column:
    """hot, warm (older than ``warm_days``) or cold (older than ``cold_days``)."""
    return F.when(created_at < _cutoff(now, cold_days), "cold").when(created_at < _cutoff(now, warm_days), "warm").otherwise("hot")


def tier_assignment(df: DataFrame, now: str | Column, warm_days: int = WARM_DAYS, cold_days: int = COLD_DAYS) -> DataFrame:
    return df.withColumn("tier", tier(F.col("created_at"), now, warm_days, cold_days))


def write_tiers(df: DataFrame, root: str, now: str, warm_days: int = WARM_DAYS, cold_days: int = COLD_DAYS) -> None:
    """Copies of the records by tier and type; the source keeps its rows. One pass, zstd for all of them."""
    tier_assignment(df, now, warm_days, cold_days).write.partitionBy("tier", "entity_type").option("compression", "zstd").mode("append").parquet(root)


def merge_superseded(df: DataFrame, key: list[str] = KEY) -> DataFrame:
    """The row of each key that was created last (then the greatest id), as a replacing merge leaves it."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("created_at", "id")).alias("_r"))
    return best.select(*key, "_r.*").select(*df.columns)


def union_tiers(hot: DataFrame, *colder: DataFrame, key: list[str] = KEY) -> DataFrame:
    """One view over tiers: a version that several tiers hold comes from the hottest."""
    both = None
    for n, part in enumerate((hot, *colder)):
        part = part.withColumn("_tier", F.lit(n))
        both = part if both is None else both.unionByName(part, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*key, "_tier")]
    best = both.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct("_tier", "id")).alias("_r"))
    return best.select(*key, "_r.*").select(*[c for c in both.columns if c != "_tier"])
