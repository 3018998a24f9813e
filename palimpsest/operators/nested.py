"""Nested records to related flat tables.

Each object that is an element of an array becomes one row that knows its record, path, position and nearest enclosing
such object. Its place without positions (``data.Items[].Parts[]``) is its supertype, its state in the tree automaton
of plans/shapes.py its variant. Variants of one supertype whose columns agree make a subtype: its table has a typed column
for each member, inferred from the states, beside the key columns that all tables share. Nodes are routed to these tables
in one write, a folder a table; what all of them have in common (``rows``) is read across the folders.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import arrow, jsonval
from palimpsest.functions.canon import fit
from palimpsest.operators.current import current_rows
from palimpsest.plans import shapes
from palimpsest.sources.scratch import materialize, new_path

OUT_ROWS = 5_000  # nodes per Arrow batch
MOST_FORMS, MOST_TABLES = 2_000, 200  # forms that get a typed table, the most frequent first, and tables; the rest shares one of JSON text
NODES = "id string, node_path string, parent_path string, supertype string, position int, variant string, shape string, form string, form_key string, body string"
KEYS = ["id", "node_path", "parent_path"]
OTHER = -1  # the table of forms without a typed one


def _walk(value, path: str) -> Iterator[tuple[str, str, str, int, dict]]:
    """(path, parent, supertype, position, object) of each object that is an element of an array."""
    todo: list[tuple] = [(value, path, path, "")]
    while todo:
        x, at, kind, parent = todo.pop()
        if isinstance(x, dict):
            todo += [(c, f"{at}.{k}", f"{kind}.{k}", parent) for k, c in x.items() if isinstance(c, (dict, list))]
        elif isinstance(x, list):
            for n, c in enumerate(x):
                if isinstance(c, dict):
                    here = f"{at}[{n}]"
                    yield here, parent, f"{kind}[]", n, c
                    todo.append((c, here, f"{kind}[]", here))
                elif isinstance(c, list):
                    todo.append((c, f"{at}[{n}]", f"{kind}[]", parent))


def _flattener(spelled: str | None):
    schema = arrow.schema(NODES)

    def roots(data, custom) -> Iterator[tuple[str, object]]:
        value = jsonval.load_any(data)
        if isinstance(value, dict) and spelled in value:
            x = value[spelled]
            if isinstance(x, str):
                try:
                    x = jsonval.load(x)
                except ValueError:
                    pass
            value[spelled] = [x] if isinstance(x, dict) else x
        yield "data", value
        for k, text in custom or ():
            try:
                yield f"custom.{k}", jsonval.load(text)
            except (ValueError, TypeError):
                pass

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flush():
            rows = arrow.batch(out, schema)
            out.clear()
            return rows

        for batch in batches:
            for key, data, custom in zip(*(batch.column(c).to_pylist() for c in ("id", "data", "custom"))):
                for name, value in roots(data, custom):
                    known: dict = {}
                    for path, parent, kind, n, x in _walk(value, name):
                        known = known or shapes.classify(value)
                        variant, form, *_ = known[id(x)]
                        out.append((key, path, parent, kind, n, variant, shapes.member_shape(x), form, shapes.digest(kind, form), shapes.body(x, known)))
                        if len(out) >= OUT_ROWS:
                            yield flush()
        yield flush()

    return run


def nodes(df: DataFrame, spelled: str | None = None) -> DataFrame:
    """Rows of NODES for the current rows of a version table.

    Roots are data and each metadata.custom value that is valid JSON. ``spelled``: a top-level member of data that may be
    an array written as JSON text or, for one element, the bare object. Elements that are not objects keep their index
    but give no row. Invalid JSON, no data and null maps give no rows; null ids stay; empty tables give no rows; records
    nest as deep as they like.
    """
    text = F.col("data")
    # only texts that can hold such an object travel
    data = F.when(text.contains("[") | text.contains("\\u") | (text.contains(spelled) if spelled else F.lit(False)), text)
    custom = F.filter(F.map_entries("metadata.custom"), lambda e: e["value"].contains("["))
    rows = current_rows(df.select("id", "created_at", data.alias("data"), F.when(F.size(custom) > 0, custom).alias("custom")), F.col("data"), F.col("custom"))
    # entries travel as structs; Arrow hands them over as dicts
    rows = rows.where("data is not null or custom is not null").select("id", "data", F.transform("custom", lambda e: F.array(e["key"], e["value"])).alias("custom"))
    return rows.mapInArrow(_flattener(spelled), NODES)


@dataclass(frozen=True)
class Subtype:
    """A table: variants of one supertype whose columns agree."""

    number: int
    supertype: str
    schema: T.StructType


def plan_tables(forms: list[tuple[str, str, str]]) -> tuple[list[Subtype], dict[str, int]]:
    """(tables, form_key -> number of its table) of (supertype, form, form_key), the most frequent first.

    A form joins the first table of its supertype none of whose columns contradicts it, else it opens one.
    """
    merged: list[tuple[str, dict]] = []
    of: dict[str, list[int]] = defaultdict(list)
    where: dict[str, int] = {}
    for supertype, text, key in forms:
        form = json.loads(text)
        kind = shapes.spark_type(form) if isinstance(form, dict) else None
        if form and kind is not None and not shapes.plain(kind):
            continue
        if not isinstance(form, dict):
            continue
        for n in of[supertype]:
            both = shapes.merge(merged[n][1], form)
            fits = shapes.spark_type(both) if both is not None else None
            if both is not None and (not isinstance(fits, T.StructType) or shapes.plain(fits)):
                merged[n], where[key] = (supertype, both), n
                break
        else:
            if len(merged) < MOST_TABLES:
                of[supertype].append(len(merged))
                where[key] = len(merged)
                merged.append((supertype, form))
    kinds = [(s, shapes.spark_type(f)) for s, f in merged]
    return [Subtype(n, s, k if isinstance(k, T.StructType) else T.StructType()) for n, (s, k) in enumerate(kinds)], where


def _fit(value: Column, have: T.DataType, kind: str) -> Column:
    """The value in a type; null if it has no such form."""
    return fit(F.to_json(value) if isinstance(have, (T.ArrayType, T.StructType)) else value.cast("string"), kind)


@dataclass(frozen=True)
class Subtypes:
    """The written tables. ``rows``: what all have in common (KEYS, supertype, position, variant, shape, subtype)."""

    stored: DataFrame
    tables: list[Subtype]

    @property
    def rows(self) -> DataFrame:
        return self.stored.select(*KEYS, "supertype", "position", "variant", "shape", "subtype")

    def table(self, number: int) -> DataFrame:
        """A typed table: KEYS, position, then its columns. Only its folder is read."""
        mine = self.stored.where(F.col("subtype") == number).select(*KEYS, "position", *([f"t{number}.*"] if self.tables[number].schema.fields else []))
        return mine

    def of(self, supertype: str) -> list[Subtype]:
        return [t for t in self.tables if t.supertype == supertype]

    def members(self, supertype: str, columns: dict[str, str]) -> DataFrame:
        """All nodes of a supertype, from its typed tables and from OTHER: KEYS, position, a column per (member -> Spark type).

        Names match in letter case too. Members that a node lacks, or that don't fit the type, are null; fractions
        become whole numbers by rounding, halves away from zero; objects and arrays become JSON text (a typed table doesn't
        tell their null members from absent ones), but arrays that hold objects are null, as they are tables of their own.
        """
        tables = self.of(supertype)
        rows = self.stored.where(F.col("subtype").isin(OTHER, *(t.number for t in tables)) & (F.col("supertype") == supertype))
        return rows.select(*KEYS, "position", *[self._member(tables, name, kind).alias(name) for name, kind in columns.items()])

    @staticmethod
    def _member(tables: list[Subtype], name: str, kind: str) -> Column:
        value = F.when(F.col("subtype") == OTHER, _fit(F.get_json_object("body", f"$['{name}']"), T.StringType(), kind))
        for t in tables:
            for f in t.schema.fields:
                if f.name == name:
                    value = value.when(F.col("subtype") == t.number, _fit(F.col(f"t{t.number}.`{name}`"), f.dataType, kind))
        return value


def subtypes(df: DataFrame, spelled: str | None = None) -> Subtypes:
    """The current rows' nodes in their typed tables.

    Types follow from the values: whole numbers are long, others double, numbers that no double holds exactly text as
    spelled; arrays of one kind of scalar are arrays, mixed ones JSON text; objects are structs. Forms beyond the
    MOST_FORMS most frequent or MOST_TABLES tables, and those with names that differ in case only, share the table OTHER,
    whole, as JSON text in ``body``: how many names records hold knows no bound.
    """
    spark = df.sparkSession
    flat = materialize(nodes(df, spelled), "nodes")
    often = flat.groupBy("supertype", "form", "form_key").count().orderBy(F.desc("count"), "supertype", "form_key").limit(MOST_FORMS)
    tables, where = plan_tables([(r.supertype, r.form, r.form_key) for r in often.collect()])
    placed = flat
    if where:
        placed = flat.join(spark.createDataFrame(list(where.items()), "form_key string, subtype int"), "form_key", "left")
    else:
        placed = flat.withColumn("subtype", F.lit(None).cast("int"))
    placed = placed.withColumn("subtype", F.coalesce("subtype", F.lit(OTHER)))
    typed = [F.when(F.col("subtype") == t.number, F.from_json("body", t.schema)).alias(f"t{t.number}") for t in tables if t.schema.fields]
    out = placed.select("subtype", *KEYS, "supertype", "position", "variant", "shape", F.when(F.col("subtype") == OTHER, F.col("body")).alias("body"), *typed)
    path = new_path(spark, "subtypes")
    out.hint("rebalance", "subtype").write.partitionBy("subtype").option("compression", "zstd").parquet(path)
    return Subtypes(spark.read.schema(out.schema).parquet(path), tables)


def subtype_store(df: DataFrame, spelled: str | None = None) -> DataFrame:
    """The rows that all subtype tables have in common, read from them."""
    return subtypes(df, spelled).rows


def variants(all_nodes: DataFrame) -> DataFrame:
    """(supertype, variant, shape, n): how many nodes take which shape where."""
    return all_nodes.groupBy("supertype", "variant", "shape").agg(F.count("*").alias("n"))


def subtype_table(all_nodes: DataFrame, supertype: str, columns: dict[str, str], variant: str | None = None) -> DataFrame:
    """A table of a supertype of ``nodes`` with types of the caller's: key columns, then a column per (member -> Spark type).

    Members that a variant lacks, or that don't fit the type, are null.
    """
    rows = all_nodes.where((F.col("supertype") == supertype) & (F.lit(True) if variant is None else F.col("variant") == variant))
    typed = [F.expr(f"try_cast(get_json_object(body, '$.{m}') as {t})").alias(m) for m, t in columns.items()]
    return rows.select("id", "node_path", "parent_path", "position", "variant", *typed)
