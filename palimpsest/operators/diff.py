"""Field-level differences of two states, as one Column built from the schema.

The plan of a diff is made once per entity type; what runs is one expression per row inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.canon import json_text, let
from palimpsest.model import CHANGE
from palimpsest.plans.blocks import with_previous
from palimpsest.plans.registry import EntityType, flags_of

_NONE = "array<struct<path:string,old_value:string,new_value:string>>"


def _no_change() -> Column:
    return F.array().cast(_NONE)


def _change(path: Column, old: Column, new: Column) -> Column:
    return F.array(F.struct(path.alias("path"), old.alias("old_value"), new.alias("new_value")))


def _value(c: Column, kind: T.DataType) -> Column:
    return F.when(c.isNotNull(), json_text(c, kind))


def _comparable(c: Column, kind: T.DataType) -> Column:
    """Something that ``<=>`` works on: maps and variants have no equality of their own."""
    if isinstance(kind, T.VariantType) or "map" in kind.simpleString() or "variant" in kind.simpleString():
        return json_text(c, kind)
    return c


def normalized(c: Column, kind: T.ArrayType) -> Column:
    """The list in order of its elements' JSON."""
    keyed = F.transform(c, lambda e: F.struct(json_text(e, kind.elementType).alias("k"), e.alias("e")))
    return F.transform(F.array_sort(keyed), lambda s: s["e"])


def _map_changes(a: Column, b: Column, kind: T.MapType, path: Column) -> Column:
    none = F.from_json(F.lit("{}"), kind)
    x, y = F.coalesce(a, none), F.coalesce(b, none)

    def of(k: Column) -> Column:
        p = F.concat(path, F.lit("."), k)
        there, here = F.map_contains_key(x, k), F.map_contains_key(y, k)
        old, new = F.element_at(x, k), F.element_at(y, k)
        text = lambda c: json_text(c, kind.valueType)
        if isinstance(kind.valueType, T.MapType):
            differ = F.when(there & here, _map_changes(old, new, kind.valueType, p)).otherwise(_change(p, F.when(there, text(old)), F.when(here, text(new))))
        else:
            differ = F.when(there & here & text(old).eqNullSafe(text(new)), _no_change()).otherwise(_change(p, F.when(there, text(old)), F.when(here, text(new))))
        return differ

    return F.flatten(F.transform(F.array_sort(F.array_union(F.map_keys(x), F.map_keys(y))), of))


def _field_changes(a: Column, b: Column, f: T.StructField, path: Column, tracked_only: bool) -> Column:
    kind, flags = f.dataType, flags_of(f)
    if isinstance(kind, T.StructType):
        inside = _struct_changes(a, b, kind, path, tracked_only if "embedded" in flags else None)
        whole = _change(path, _value(a, kind), _value(b, kind))
        return F.when(a.isNull() & b.isNull(), _no_change()).when(a.isNull() | b.isNull(), whole).otherwise(inside)
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        return _map_changes(a, b, kind, path)
    if isinstance(kind, T.ArrayType) and "normalized" in flags:
        a, b = normalized(a, kind), normalized(b, kind)
    return F.when(_comparable(a, kind).eqNullSafe(_comparable(b, kind)), _no_change()).otherwise(_change(path, _value(a, kind), _value(b, kind)))


def compared_fields(schema: T.StructType, tracked_only: bool | None = None) -> list[T.StructField]:
    """Fields a diff looks at: neither id nor ignored; only tracked ones if any is tracked. Embedded structs always."""
    fields = [f for f in schema.fields if not flags_of(f) & {"id", "ignore"}]
    only = any("tracked" in flags_of(f) for f in fields) if tracked_only is None else tracked_only
    return [f for f in fields if not only or flags_of(f) & {"tracked", "embedded"}]


def _struct_changes(a: Column, b: Column, schema: T.StructType, prefix: Column | None, tracked_only: bool | None = None) -> Column:
    only = any("tracked" in flags_of(f) for f in schema.fields) if tracked_only is None else tracked_only
    parts = []
    for f in compared_fields(schema, tracked_only):
        embedded = "embedded" in flags_of(f)
        path = F.lit(f.name) if prefix is None else F.concat(prefix, F.lit("." + f.name))
        if embedded:
            parts.append(_struct_changes(a[f.name], b[f.name], f.dataType, prefix, only))
        else:
            parts.append(_field_changes(a[f.name], b[f.name], f, path, only))
    return F.concat(*parts) if parts else _no_change()


def changes(previous: Column, current: Column, schema: T.StructType) -> Column:
    """array<struct<path, old_value, new_value>> in order of declaration, depth first, map keys sorted.

    Values are JSON text; a null old value means added, a null new value removed. A struct that is null on one side is
    one change; maps compare key by key (null and empty are alike), lists whole (null and empty differ), timestamps as
    instants. NaN equals NaN. Neither state may be null.
    """
    return _struct_changes(previous, current, schema, None)


def _parse(text: Column, kind: T.DataType) -> Column:
    wrapped = F.concat(F.lit('{"v":'), text, F.lit("}"))
    return F.from_json(wrapped, T.StructType([T.StructField("v", kind)]))["v"]


def _apply(state: Column, delta: Column, f: T.StructField, path: Column, prefix: Column | None) -> Column:
    kind = f.dataType
    if "embedded" in flags_of(f):
        return F.struct(*[_apply(state[g.name], delta, g, F.lit(g.name) if prefix is None else F.concat(prefix, F.lit("." + g.name)), prefix).alias(g.name) for g in kind.fields])
    own = F.try_element_at(F.filter(delta, lambda c: c["path"] == path), F.lit(-1))
    hit = F.exists(delta, lambda c: c["path"] == path)
    if isinstance(kind, T.StructType):
        start = F.when(hit, _parse(own["new_value"], kind)).otherwise(state)
        below = F.exists(delta, lambda c: c["path"].startswith(F.concat(path, F.lit("."))))

        def inside(s: Column) -> Column:
            members = F.struct(*[_apply(s[g.name], delta, g, F.concat(path, F.lit("." + g.name)), path).alias(g.name) for g in kind.fields])
            return F.when(s.isNull() & ~below, F.lit(None).cast(kind)).otherwise(members)

        return let(start, inside)
    if isinstance(kind, T.MapType):
        return F.when(hit, _parse(own["new_value"], kind)).otherwise(_apply_map(state, delta, kind, path))
    return F.when(hit, _parse(own["new_value"], kind)).otherwise(state)


def _apply_map(state: Column, delta: Column, kind: T.MapType, path: Column) -> Column:
    inside = F.concat(path, F.lit("."))
    mine = F.filter(delta, lambda c: c["path"].startswith(inside))
    key = lambda c: F.substring(c["path"], F.length(inside) + 1, F.length(c["path"]))
    base = F.coalesce(state, F.from_json(F.lit("{}"), kind))
    if isinstance(kind.valueType, T.MapType):
        first = lambda c: F.substring_index(key(c), ".", 1)
        gone = F.transform(F.filter(mine, lambda c: c["new_value"].isNull() & ~F.contains(key(c), F.lit("."))), key)
        keys = F.array_except(F.array_union(F.map_keys(base), F.transform(mine, first)), gone)

        def value(k: Column) -> Column:
            p = F.concat(inside, k)
            whole = F.try_element_at(F.filter(mine, lambda c: c["path"] == p), F.lit(-1))
            start = F.coalesce(_parse(whole["new_value"], kind.valueType), F.element_at(base, k))
            return _apply_map(start, delta, kind.valueType, p)

        built = F.map_from_entries(F.transform(keys, lambda k: F.struct(k, value(k))))
    else:
        named = F.transform(mine, key)
        kept = F.map_filter(base, lambda k, _: ~F.array_contains(named, k))
        put = F.filter(mine, lambda c: c["new_value"].isNotNull())
        built = F.map_concat(kept, F.map_from_entries(F.transform(put, lambda c: F.struct(key(c), _parse(c["new_value"], kind.valueType)))))
    return F.when(F.size(mine) > 0, built).otherwise(state)


def apply(state: Column, delta: Column, schema: T.StructType) -> Column:
    """The state after a delta: null new values leave a field null (or take a map key out); missing structs are made."""
    d = F.coalesce(delta, _no_change())
    return F.struct(*[_apply(state[f.name], d, f, F.lit(f.name), None).alias(f.name) for f in schema.fields])


def valid(previous: Column, current: Column, delta: Column, schema: T.StructType) -> Column:
    """Whether the delta really leads from one state to the other, by their canonical JSON."""
    reached, now = apply(previous, delta, schema), json_text(current, schema)
    if all(isinstance(f.dataType, (T.StringType, T.BooleanType, T.IntegralType)) for f in schema.fields):
        return json_text(reached, schema) == now  # small enough to stay in generated code
    return let(reached, lambda s: json_text(s, schema)) == now


def history_changes(states: DataFrame, entity: EntityType, state: str = "state", by: tuple[str, ...] = ("entity_id",), order: str = "version") -> DataFrame:
    """states with ``previous`` (the state before, null at first) and ``delta`` (null at first); ``order`` is an integer."""
    rows = with_previous(states, list(by), order, [state]).withColumn("previous", F.col(f"previous.{state}"))
    return rows.withColumn("delta", F.when(F.col("previous").isNotNull(), changes(F.col("previous"), F.col(state), entity.schema)))


def explode_changes(rows: DataFrame, *keep: str, path: str | None = None) -> DataFrame:
    """One row per change; ``path`` keeps that field's only (exact match)."""
    out = rows.select(*keep, F.posexplode("delta").alias("position", "change")).select(*keep, "position", "change.*")
    return out if path is None else out.where(F.col("path") == path)


CHANGE_TYPE = T.ArrayType(CHANGE)
