"""Reading version records: one version, the latest, the state at a time, pages, comparisons, the history of a field.

Every operator runs over all entities of a DataFrame; for one entity, filter the DataFrame first (the filter reaches the
scan). Latest and state-at-a-time are aggregates, not sorts: repeated and old versions shrink before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.model import ENTITY
from palimpsest.operators.diff import changes, explode_changes, history_changes
from palimpsest.plans.blocks import Blocks, ranked
from palimpsest.plans.registry import EntityType

PAGE = 50


def entity(df: DataFrame, entity_type: str, entity_id: str) -> DataFrame:
    return df.where((F.col("entity_type") == entity_type) & (F.col("entity_id") == entity_id))


def get_version(df: DataFrame, version: int | Column) -> DataFrame:
    return df.where(F.col("version") == version)


def _top(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in by and c not in order]
    best = df.groupBy(*by).agg(F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("_r"))
    return best.select(*by, "_r.*").select(*df.columns)


def latest_versions(df: DataFrame, by: list[str] = ENTITY) -> DataFrame:
    """The row with the greatest version of each entity."""
    return _top(df, by, ["version"])


def state_at_time(df: DataFrame, at: str | Column, by: list[str] = ENTITY) -> DataFrame:
    """Of each entity, the row created last up to and including a time; of equal times the greatest version."""
    t = F.lit(at).cast("timestamp") if isinstance(at, str) else at
    return _top(df.where(F.col("created_at") <= t), by, ["created_at", "version"])


def list_versions(df: DataFrame, limit: int = PAGE, offset: int = 0, ascending: bool = False, by: list[str] = ENTITY) -> DataFrame:
    """A page of each entity's versions, newest first; a limit of 0 or less is unlimited. The limit is the feature."""
    rows = ranked(df, by, "version", ascending, "_n")
    page = (F.col("_n") > offset) & (F.lit(True) if limit <= 0 else F.col("_n") <= offset + limit)
    return rows.where(page).sortWithinPartitions(*by, "_n").drop("_n")


def olap_page(df: DataFrame, entity_type: str, limit: int = PAGE, offset: int = 0, ascending: bool = False) -> DataFrame:
    """A page over all entities of a type by version, entity and id."""
    order = [F.col(c).asc() if ascending else F.col(c).desc() for c in ("version", "entity_id", "id")]
    return df.where(F.col("entity_type") == entity_type).orderBy(*order).offset(offset).limit(limit)


def bulk_state_at_time(df: DataFrame, wanted: DataFrame, by: list[str] = ENTITY) -> DataFrame:
    """The state of each wanted (``by``, position, at): missing entities give no row, repeated ones repeat."""
    hit = wanted.join(df, by).where(F.col("created_at") <= F.col("at"))
    return _top(hit, ["position", *by], ["created_at", "version"])


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, values: list[str], tie: str) -> DataFrame:
    """left with ``values`` of the right row that is the last at or before it; null if there is none.

    One union, one window: no rows are paired; long histories are cut at quantiles of their times. Of right rows at one
    time the greatest ``tie`` counts; a right row without time comes before all others, a left one has only such.
    """
    carried = F.struct(*values)
    l = left.select("*", F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"), F.lit(None).cast(right.select(carried.alias("v")).schema["v"].dataType).alias("_v"))
    r = right.select(*by, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), carried.alias("_v"))
    b = Blocks(l.unionByName(r, allowMissingColumns=True), by, ["_at", "_side", "_tie"], slice_by="_at")
    rows = b.rows.withColumn("_n", F.row_number().over(b.inside)).withColumn("_own", F.last("_v", ignorenulls=True).over(b.running))
    rows = b.carry(rows, {"_end": F.max_by("_own", "_n")}, {"_prior": F.last("_end", ignorenulls=True)})
    rows = rows.where("_side = 1").withColumn("_v", F.coalesce("_own", "_prior"))
    return rows.select(*left.columns, "_v.*")


def compare_versions(states: DataFrame, kind: EntityType, v1: int, v2: int, by: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    """(by, position, path, old_value, new_value) from version v1 to v2, of entities that have both."""
    side = lambda v, n: states.where(F.col("version") == v).select(*by, F.col("state").alias(n))
    both = side(v1, "a").join(side(v2, "b"), list(by))
    return explode_changes(both.withColumn("delta", changes(F.col("a"), F.col("b"), kind.schema)), *by)


def find_changes(states: DataFrame, kind: EntityType, path: str, first: int | None = None, by: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    """Each change of one field: (by, version, old_value, new_value). ``first``: only each entity's first versions.

    A top-level field is diffed alone; the other fields are never read.
    """
    rows = states
    if first is not None:
        rows = ranked(rows, list(by), "version", name="_n").where(F.col("_n") <= first).drop("_n")
    head = path.split(".", 1)[0]
    chosen = [f for f in kind.schema.fields if f.name == head]
    if chosen:
        kind = EntityType(kind.name, type(kind.schema)(chosen), kind.id_field)
        rows = rows.withColumn("state", F.struct(F.col(f"state.{head}").alias(head)))
    return explode_changes(history_changes(rows, kind, by=by), *by, "version", path=path).drop("position", "path")


def find_by_actor(df: DataFrame, actor: str, limit: int | None = None, filter_first: bool = True, by: list[str] = ENTITY, column: str = "metadata.actor_id") -> DataFrame:
    """An actor's versions. With a limit, the page is taken of the actor's versions, or before the filter."""
    mine = F.col(column) == actor
    if limit is None:
        return df.where(mine)
    return list_versions(df.where(mine), limit, by=by) if filter_first else list_versions(df, limit, by=by).where(mine)
