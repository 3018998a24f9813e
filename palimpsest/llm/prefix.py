"""Running sums inside groups of any size, without a task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 20_000


def running(df: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over the rows of the same group that come before the row.

    Rows come in order of a hash block, then of ``order``, which must tell rows of a group apart or their places are
    arbitrary. A group gets as many blocks as its size asks for; only blocks are sorted in one task, and blocks' sums,
    one for each ``BLOCK_ROWS`` rows, are added up.
    """
    sizes = df.groupBy(*group).agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("_blocks"))
    on = [df[g].eqNullSafe(F.col(f"_g_{g}")) for g in group]
    rows = df.join(sizes.select("_blocks", *[F.col(g).alias(f"_g_{g}") for g in group]), on, "left").drop(*[f"_g_{g}" for g in group])
    rows = rows.withColumn("_block", F.pmod(F.xxhash64(*order), F.greatest(F.col("_blocks"), F.lit(1)))).withColumn("_value", value)
    before = Window.partitionBy(*group, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("_inside", F.coalesce(F.sum("_value").over(before), F.lit(0)))
    earlier = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*group, "_block").agg(F.sum("_value").alias("_sum")).withColumn("_start", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    starts = starts.select("_start", F.col("_block").alias("_b"), *[F.col(g).alias(f"_g_{g}") for g in group])
    on = [inside[g].eqNullSafe(F.col(f"_g_{g}")) for g in group]
    joined = inside.join(starts, [*on, inside["_block"] == F.col("_b")])
    return joined.withColumn(name, F.col("_inside") + F.col("_start")).drop("_blocks", "_block", "_value", "_inside", "_start", "_b", *[f"_g_{g}" for g in group])
