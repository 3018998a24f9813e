"""Windows over histories of any length, without gathering a history in one task.

Histories are cut into blocks: by the order's values, where that is a dense integer; else only those that are found to be
long, at quantiles of their order. Windows run inside blocks; a row a block is summed up, and what earlier blocks hold is
handed to each block by a second window over these summaries. Rows are shuffled by key and block once; the join with the
summaries finds them in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.sources.scratch import materialize

BLOCK = 4096
LONG_ROWS, SLICES = 1_000_000, 256  # rows of a history that is cut at quantiles, and into how many blocks
BROADCAST_KEYS = 10_000  # long histories whose quantiles (2 KB each) are broadcast; more are joined like any table


class Blocks:
    """``rows``: df with key and block columns; ``inside`` and ``running``: windows inside a block; null keys are one key.

    ``dense``: the first of ``order`` is an integer without big gaps (null counts as 0) and cuts the blocks.
    ``descending``: blocks come from the greatest down; the columns of ``order`` must say so themselves.
    ``slice_by``: without ``dense``, the column of ``order`` (a time or a number) whose quantiles cut long histories; rows
    in front of it in the order must have it null. One pass over keys counts which are long.
    """

    def __init__(self, df: DataFrame, by: list[str], order: list, dense: str | None = None, descending: bool = False, block: int | None = None, slice_by: str | None = None):
        self.columns = df.columns
        self.keys = [f"_k{n}" for n in range(len(by))]
        # text that is never null, so that rows and summaries join in place by plain equality
        rows = df.withColumns({k: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for k, c in zip(self.keys, by)})
        self.cut = True
        if dense:
            at = F.floor(F.coalesce(F.col(dense).cast("long"), F.lit(0)) / (block or BLOCK))
            self.rows = rows.withColumn("_block", -at if descending else at)
        else:
            self.rows, self.cut = self._sliced(rows, slice_by) if slice_by else (rows, False)
        at = ["_block"] if self.cut else []
        self.inside = Window.partitionBy(*self.keys, *at).orderBy(*order)
        self.running = self.inside.rowsBetween(Window.unboundedPreceding, 0)
        self.earlier = Window.partitionBy(*self.keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)

    def _sliced(self, rows: DataFrame, slice_by: str) -> tuple[DataFrame, bool]:
        kind = rows.schema[slice_by].dataType.typeName()
        if kind not in ("timestamp", "timestamp_ntz", "date", "long", "integer", "short", "byte", "double", "float"):
            return rows, False
        hot = materialize(rows.groupBy(*self.keys).count().where(F.col("count") > LONG_ROWS).select(*self.keys), "long-histories")
        n = hot.count()
        if not n:
            return rows, False
        place = F.col(slice_by)
        cuts = rows.join(F.broadcast(hot) if n <= BROADCAST_KEYS else hot, self.keys, "left_semi").groupBy(*self.keys).agg(F.percentile_approx(place, [k / SLICES for k in range(1, SLICES)], 10_000).alias("_cuts"))
        cuts = materialize(cuts, "quantiles")
        joined = rows.join(F.broadcast(cuts) if n <= BROADCAST_KEYS else cuts, self.keys, "left")
        return joined.withColumn("_block", F.coalesce(F.size(F.filter("_cuts", lambda c: c < place)), F.lit(0))).drop("_cuts"), True

    def carry(self, rows: DataFrame, summaries: dict[str, Column], carried: dict[str, Column], through: dict[str, Column] | None = None) -> DataFrame:
        """rows with ``carried``: Columns over the ``summaries`` (aggregates of a block) of the earlier blocks of the key,
        null in the first. ``through``: aggregates over the summaries up to and with a block, for ``carried`` to use."""
        if not self.cut:
            kinds = rows.groupBy().agg(*[c.alias(n) for n, c in summaries.items()]).select(*[c.over(Window.orderBy(F.lit(1))).alias(n) for n, c in carried.items()]).schema
            return rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in kinds})
        sums = rows.groupBy(*self.keys, "_block").agg(*[c.alias(n) for n, c in summaries.items()])
        upto = self.earlier.rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumns({n: c.over(upto) for n, c in (through or {}).items()})
        told = sums.select(*self.keys, "_block", *[c.over(self.earlier).alias(n) for n, c in carried.items()])
        return rows.join(told, [*self.keys, "_block"])

    def done(self, rows: DataFrame, *names: str) -> DataFrame:
        return rows.select(*self.columns, *names)


def with_previous(df: DataFrame, by: list[str], order: str, columns: list[str], name: str = "previous", block: int | None = None) -> DataFrame:
    """df with ``name``: a struct of ``columns`` of the row before in ``order`` (a dense integer) inside ``by``; null at first."""
    b = Blocks(df, by, [order], dense=order, block=block)
    value = F.struct(*columns)
    rows = b.rows.withColumn("_n", F.row_number().over(b.inside)).withColumn("_inside", F.lag(value).over(b.inside))
    rows = b.carry(rows, {"_end": F.max_by(value, "_n")}, {"_prior": F.last("_end")})
    return b.done(rows.withColumn(name, F.when(F.col("_n") == 1, F.col("_prior")).otherwise(F.col("_inside"))), name)


def ranked(df: DataFrame, by: list[str], order: str, ascending: bool = True, name: str = "_rank", block: int | None = None) -> DataFrame:
    """df with ``name``: 1, 2, ... in ``order`` (a dense integer) inside ``by``."""
    b = Blocks(df, by, [F.col(order).asc() if ascending else F.col(order).desc()], dense=order, descending=not ascending, block=block)
    rows = b.rows.withColumn("_n", F.row_number().over(b.inside))
    rows = b.carry(rows, {"_count": F.count("*")}, {"_before": F.sum("_count")})
    return b.done(rows.withColumn(name, F.col("_n") + F.coalesce("_before", F.lit(0))), name)
