"""Schemas that drift between versions: profile them, find the edit scripts, bring all records into the newest shape.

1. Current rows give partial counts of each field's presence and type. One record of each version is kept, spread by
   entity and block of versions, so that no history gathers in one task, and scanned in order of version for the pairs
   of records between which an entity goes from one schema_version to another. Blocks' ends are stitched afterwards.
2. Fields that a quarter of a schema_version's records have are its schema; the number of such fields is bounded by what
   records hold, so schemas are the driver's. For removed and added fields the pairs tell how often values stay equal.
3. The tree edit distance between neighbouring schemas gives a minimum-cost script of changes (plans/tree_edit.py), and
   scripts compose into one projection per schema_version that is applied to every record.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import arrow, jsonval
from palimpsest.functions.canon import fit
from palimpsest.operators.current import current_rows
from palimpsest.plans.tree_edit import Step, edit_script, new_path, renames
from palimpsest.sources.scratch import materialize

BLOCK = 4096  # versions of an entity that are scanned by one task
KEPT_COUNTS = 100_000  # partial counts held before they are handed on
SCAN = "kind string, entity_type string, entity_id string, block long, older int, newer int, path string, json_kind string, n long, old_data string, new_data string"
EVIDENCE = "entity_type string, older int, newer int, gone string, fresh string, both long, same long"


def fields(value, closed: frozenset[str]) -> Iterator[tuple[str, object]]:
    """(dotted path, value) of members of an object and of objects inside it; not inside arrays and closed members."""
    todo = [("", value)] if isinstance(value, dict) else []
    while todo:
        path, at = todo.pop()
        for k, x in at.items():
            p = f"{path}.{k}" if path else k
            yield p, x
            if isinstance(x, dict) and k not in closed:
                todo.append((p, x))


def _profiler(closed: frozenset[str]):
    """Partial counts of a task's records."""
    schema = arrow.schema(SCAN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush():
            rows = arrow.batch([("count", t, None, None, None, s, p, k, n, None, None) for (t, s, p, k), n in counts.items()], schema)
            counts.clear()
            return rows

        for batch in batches:
            for t, s, data in zip(*(batch.column(c).to_pylist() for c in ("entity_type", "schema_version", "data"))):
                value = jsonval.load_any(data)
                if value is None:
                    continue
                counts[t, s, None, None] += 1
                for p, x in fields(value, closed):
                    counts[t, s, p, jsonval.kind(x)] += 1
            if len(counts) > KEPT_COUNTS:
                yield flush()
        yield flush()

    return run


def _pairer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring records of different schema_versions, and the first and last record of each entity's block."""
    schema = arrow.schema(SCAN)
    out: list[tuple] = []
    block = last = None  # last: (schema_version, data)
    for batch in batches:
        for t, e, b, s, data in zip(*(batch.column(c).to_pylist() for c in ("entity_type", "entity_id", "block", "schema_version", "data"))):
            if (t, e, b) != block:
                if last:
                    out.append(("last", *block, last[0], None, None, None, None, last[1], None))
                block, last = (t, e, b), None
                out.append(("first", *block, s, None, None, None, None, data, None))
            elif last[0] != s:
                out.append(("pair", *block, last[0], s, None, None, None, last[1], data))
            last = s, data
        if len(out) > 2000:
            yield arrow.batch(out, schema)
            out = []
    if last:
        out.append(("last", *block, last[0], None, None, None, None, last[1], None))
    yield arrow.batch(out, schema)


def scan(df: DataFrame, closed: frozenset[str]) -> DataFrame:
    """Rows of SCAN: counts of fields and types, and pairs of records at a change of schema_version."""
    columns = [F.col(c) for c in ("entity_type", "entity_id", "version", "schema_version", "data")]
    rows = current_rows(df.select("id", "created_at", *columns), *columns)
    counted = rows.select("entity_type", "schema_version", "data").mapInArrow(_profiler(closed), SCAN)
    # one record a version, however often it was saved
    known = rows.where(F.btrim("data", F.lit(jsonval.BLANKS)).isin("", "null") == F.lit(False))
    one = known.groupBy("entity_type", "entity_id", "version").agg(F.max(F.struct("created_at", "id", "schema_version", "data")).alias("r"))
    one = one.select("entity_type", "entity_id", F.floor(F.coalesce("version", F.lit(0)) / BLOCK).alias("block"), "version", "r.schema_version", "r.data")
    blocks = one.repartition("entity_type", "entity_id", "block").sortWithinPartitions("entity_type", "entity_id", "block", "version")
    paired = blocks.select("entity_type", "entity_id", "block", "schema_version", "data").mapInArrow(_pairer, SCAN)
    return materialize(counted.unionByName(paired), "scan")


def _pairs(scanned: DataFrame) -> DataFrame:
    inner = scanned.where("kind = 'pair'").select("entity_type", "older", "newer", "old_data", "new_data")
    # an entity's block ends where its next block begins; 'first' sorts before 'last'
    w = Window.partitionBy("entity_type", "entity_id").orderBy("block", "kind")
    ends = scanned.where("kind in ('first', 'last')").select("*", F.lag("kind").over(w).alias("k"), F.lag("older").over(w).alias("s"), F.lag("old_data").over(w).alias("d"))
    across = ends.where("kind = 'first' and k = 'last' and s is distinct from older").select("entity_type", F.col("s").alias("older"), F.col("older").alias("newer"), F.col("d").alias("old_data"), F.col("old_data").alias("new_data"))
    return inner.unionByName(across)


def _evidence(candidates: dict, closed: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, same = Counter(), Counter()
        for batch in batches:
            for t, lo, hi, a, b in zip(*(batch.column(c).to_pylist() for c in ("entity_type", "older", "newer", "old_data", "new_data"))):
                gone, fresh = candidates.get((t, lo, hi), ((), ()))
                if not gone or not fresh:
                    continue
                x = {p: jsonval.dump(v) for p, v in fields(jsonval.load_any(a), closed) if p in gone and v is not None}
                y = {p: jsonval.dump(v) for p, v in fields(jsonval.load_any(b), closed) if p in fresh and v is not None}
                for g, v in x.items():
                    for f, w in y.items():
                        both[t, lo, hi, g, f] += 1
                        same[t, lo, hi, g, f] += v == w
        yield arrow.batch([(*k, n, same[k]) for k, n in both.items()], arrow.schema(EVIDENCE))

    return run


def schemas(scanned: DataFrame, least_share: float) -> dict[str, dict[int, dict[str, str]]]:
    """entity_type -> schema_version -> path -> type. Bounded by the fields that records of a version hold."""
    counts = scanned.where("kind = 'count'").groupBy("entity_type", F.col("newer").alias("schema_version"), "path", "json_kind").agg(F.sum("n").alias("n"))
    by = counts.groupBy("entity_type", "schema_version", "path").agg(F.sum("n").alias("n"), F.max(F.struct(F.when(F.col("json_kind") != "", F.col("n")).alias("k"), F.when(F.col("json_kind") != "", F.col("json_kind")).alias("json_kind"))).alias("best"))
    totals = by.where("path is null").select("entity_type", "schema_version", F.col("n").alias("total"))
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("entity_type", "schema_version")]
    kept = by.where("path is not null").alias("a").join(totals.alias("b"), on[0] & on[1], "right").where((F.col("a.path").isNull()) | (F.col("n") >= least_share * F.col("total")))
    out: dict = defaultdict(lambda: defaultdict(dict))
    for t, s, p, k in kept.select("b.entity_type", "b.schema_version", "path", "best.json_kind").collect():
        out[t][s] |= {p: k or ""} if p is not None else {}
    return out


@dataclass(frozen=True)
class Drift:
    """From a schema_version to the next: both schemas (path -> type), how alike pairs of fields are, and the script."""

    old: dict[str, str]
    new: dict[str, str]
    alike: dict[tuple[str, str], float]
    script: list[Step]

    def changes(self) -> list[tuple[str, str, str]]:
        """(change_kind, old_field, new_field): the script's steps field by field.

        Members carried by a renamed object are named like it. A pair of fields is renamed if its values are equal in
        most cases; of one that the script maps for its place only, one field is removed and one added.
        """
        moved, gone = renames(self.script), {s.old for s in self.script if s.kind == "removed"}
        pairs = {p: new_path(p, moved) for p in self.old.keys() - self.new.keys() - gone}
        pairs = {p: q for p, q in pairs.items() if (p, q) in self.alike}
        out = [("renamed", p, q) for p, q in pairs.items()]
        out += [("removed", p, "") for p in self.old.keys() - self.new.keys() - pairs.keys()]
        out += [("added", "", q) for q in self.new.keys() - self.old.keys() - set(pairs.values())]
        return out + [(s.kind, s.old, s.new) for s in self.script if s.kind == "retyped"]


def drifts(df: DataFrame, closed: tuple[str, ...] = (), least_share: float = 0.25) -> dict[tuple[str, int, int], Drift]:
    """(entity_type, older, newer schema_version) -> Drift, for each schema_version and the one below it.

    A field is the dotted path of a member of data or of an object inside it (arrays and ``closed`` members are not
    entered). It belongs to a schema_version if ``least_share`` of its current rows with data have it, null included;
    its type is that of most of its non-null values, of equally frequent ones the last by name. Rename and move need equal values in more than half of the
    steps of an entity from the older to the newer version in which both are non-null; of several rows of one version the
    one created last takes part. Rows without data don't count; data that is not an object has no fields; rows with null
    schema_version form no version. Empty tables give no scripts.
    """
    shut = frozenset(closed)
    scanned = scan(df, shut)
    found = {t: {s: f for s, f in vs.items() if s is not None} for t, vs in schemas(scanned, least_share).items()}
    steps = {(t, lo, hi): (vs[lo], vs[hi]) for t, vs in found.items() for lo, hi in zip(sorted(vs), sorted(vs)[1:])}
    candidates = {k: (frozenset(a) - frozenset(b), frozenset(b) - frozenset(a)) for k, (a, b) in steps.items()}
    alike: dict = defaultdict(dict)
    if any(g and f for g, f in candidates.values()):
        rows = _pairs(scanned).mapInArrow(_evidence(candidates, shut), EVIDENCE)
        for t, lo, hi, g, f, both, same in rows.groupBy("entity_type", "older", "newer", "gone", "fresh").agg(F.sum("both"), F.sum("same")).collect():
            if 2 * same > both:
                alike[t, lo, hi][g, f] = same / both
    return {k: Drift(a, b, alike[k], edit_script(a, b, alike[k])) for k, (a, b) in steps.items()}


def edit_scripts(df: DataFrame, **options) -> dict[tuple[str, int, int], list[Step]]:
    """(entity_type, older, newer schema_version) -> edit script."""
    return {k: d.script for k, d in drifts(df, **options).items()}


def drift_report(df: DataFrame, **options) -> DataFrame:
    """(entity_type, schema_version, change_kind, old_field, new_field) of each field that changes; a move is reported as renamed."""
    rows = [(t, hi, *change) for (t, _, hi), d in drifts(df, **options).items() for change in d.changes()]
    return df.sparkSession.createDataFrame(rows, "entity_type string, schema_version int, change_kind string, old_field string, new_field string")


@dataclass(frozen=True)
class Projection:
    """From a schema_version to the newest: ``moves`` (its field -> the newest name, None if removed; what lies below
    goes along) and ``casts`` (newest name -> type); unchanged fields are left out."""

    moves: dict[str, str | None]
    casts: dict[str, str]

    @cached_property
    def above(self) -> tuple[frozenset[str], frozenset[str]]:
        """Objects inside which something moves (by old name), and those inside which something changes type (by newest)."""
        prefixes = lambda names: frozenset(m[:n] for m in names for n in range(len(m)) if m[n] == ".")
        return prefixes(self.moves), prefixes(self.casts)


def _nearest(path: str, among) -> str | None:
    """The path or the nearest one above it that is among these."""
    while path:
        if path in among:
            return path
        path = path.rpartition(".")[0]
    return None


def _follow(path: str, moves: dict[str, str | None]) -> str | None:
    up = _nearest(path, moves)
    return path if up is None else None if moves[up] is None else moves[up] + path[len(up) :]


def compile_projections(scripts: dict[tuple[str, int, int], list[Step]]) -> dict[tuple[str, int], Projection]:
    """(entity_type, schema_version) -> Projection, composed from the newest script down."""
    out: dict[tuple[str, int], Projection] = {}
    for t in {k[0] for k in scripts}:
        moves: dict[str, str | None] = {}
        casts: dict[str, str] = {}
        for _, lo, hi in sorted((k for k in scripts if k[0] == t), reverse=True):
            script, before, casts = scripts[t, lo, hi], moves, dict(casts)
            came, gone = {s.new: s.old for s in script if s.kind in ("renamed", "moved")}, renames(script)
            fresh = {s.new for s in script if s.kind == "added"}
            moves = {}
            for path, target in before.items():  # later moves, under the names that this version has for them
                up = _nearest(path, came.keys() | fresh)
                if up is None:
                    if _nearest(path, gone) is None:
                        moves[path] = target
                elif up in came:
                    moves[came[up] + path[len(up) :]] = target
            for s in script:
                if s.kind in ("renamed", "moved"):
                    moves[s.old] = _follow(s.new, before)
                    if s.to and moves[s.old] is not None:
                        casts.setdefault(moves[s.old], s.to)
                elif s.kind == "removed":
                    moves[s.old] = None
                elif s.kind == "retyped" and (name := _follow(s.new, before)) is not None:
                    casts.setdefault(name, s.to)
            out[t, lo] = Projection(moves, casts)
    return out


def convert(value, kind: str):
    """The value in another JSON type; ValueError if it has no such form. Lists of strings are joined by commas."""
    have = jsonval.kind(value)
    if have in ("", kind):
        return value
    if kind == "string" and have in ("number", "boolean"):
        return jsonval.dump(value)
    if kind == "string" and have == "array" and all(isinstance(x, str) for x in value):
        return ",".join(value)
    if have == "string" and kind in ("number", "boolean"):
        read = jsonval.load(value.strip())
        if jsonval.kind(read) == kind:
            return read
    if have == "string" and kind == "array":
        return [x for x in re.split(r"\s*[,;]\s*", value.strip()) if x]
    raise ValueError(f"no {kind}")


def _project(value: dict, by: Projection, closed: frozenset[str]) -> dict:
    """The record under the newest names and types; what has no place or form there is kept aside, no value is dropped.

    Where a member that takes a newer name meets one that has it already, the former stays unless it is null.
    """
    result: dict = {}
    took: set[tuple[str, ...]] = set()  # names whose value came from another name

    def put(to: tuple[str, ...], x, moved: bool) -> None:
        path = ".".join(to)
        if path in by.casts:
            try:
                x = convert(x, by.casts[path])
            except ValueError:
                result.setdefault("_unconverted", {})[path] = x
                return
        at = result
        *head, tail = to
        for p in head:
            at = at.setdefault(p, {})
            if not isinstance(at, dict):
                result.setdefault("_removed", {})[path] = x
                return
        if isinstance(x, dict) and isinstance(at.get(tail), dict):
            at[tail] |= x
            return
        have = at.get(tail)
        if have is not None and (x is None or to in took and not moved):
            have, x = x, have
        elif moved and x is not None:
            took.add(to)
        at[tail] = x
        if have is not None:
            result.setdefault("_removed", {})[path] = have

    inside_moves, inside_casts = by.above
    todo: list[tuple[dict, str, tuple[str, ...] | None]] = [(value, "", ())]  # object, its old path, its newest (None: removed)
    while todo:
        node, path, target = todo.pop(0)
        for k, x in node.items():
            p = f"{path}.{k}" if path else k
            if p in by.moves:
                to = None if by.moves[p] is None else tuple(by.moves[p].split("."))
            else:
                to = None if target is None else (*target, k)
            if isinstance(x, dict) and x and k not in closed and (p in inside_moves or (to and ".".join(to) in inside_casts)):
                todo.append((x, p, to))
            elif to is None:
                result.setdefault("_removed", {})[p] = x
            else:
                put(to, x, ".".join(to) != p)
    return result


def unify(df: DataFrame, scripts: dict[tuple[str, int, int], list[Step]], closed: tuple[str, ...] = (), entity_type: str | None = None) -> DataFrame:
    """Current rows with data in the newest schema of their type: (id, entity_type, entity_id, version, schema_version, data).

    data is canonical JSON under the newest names and types. Members of removed fields go to ``_removed`` under their old
    path, values that the newest type can't hold to ``_unconverted``, and values whose newest name another one has taken to
    ``_removed`` under that name. Data that is not an object stays as it is. ``entity_type``: only current rows of this type.
    """
    projections, shut = compile_projections(scripts), frozenset(closed)
    none = Projection({}, {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for t, s, text in zip(*(batch.column(c).to_pylist() for c in ("entity_type", "schema_version", "data"))):
                value = jsonval.load_any(text)
                texts.append(None if value is None else jsonval.dump(_project(value, projections.get((t, s), none), shut)) if isinstance(value, dict) else text)
            yield batch.set_column(batch.schema.get_field_index("data"), "data", pa.array(texts, pa.string()))

    columns = [F.col(c) for c in ("entity_type", "entity_id", "version", "schema_version", "data")]
    rows = df.select("id", "created_at", *columns)
    if entity_type is not None:  # texts of other types don't travel
        rows = rows.withColumn("data", F.when(F.col("entity_type") == entity_type, F.col("data")))
    rows = current_rows(rows, *columns).drop("created_at")
    if entity_type is not None:
        rows = rows.where(F.col("entity_type") == entity_type)
    return rows.mapInArrow(run, rows.schema).where("data is not null")


def unified_table(df: DataFrame, scripts: dict[tuple[str, int, int], list[Step]], entity_type: str, columns: dict[str, str], closed: tuple[str, ...] = ()) -> DataFrame:
    """One typed table of a type's current records: a column for each (dotted field -> Spark type), null where it doesn't fit.

    A field that is asked for keeps its name, so steps that remove, rename or move it or what it lies in are left out; a
    value that its newest JSON type can't hold is read as it was. Fractions become whole numbers by rounding, halves away from zero.
    """
    lost = lambda s: s.kind in ("removed", "renamed", "moved") and any(c == s.old or c.startswith(s.old + ".") for c in columns)
    rows = unify(df, {k: [s for s in steps if not lost(s)] for k, steps in scripts.items()}, closed, entity_type)
    value = lambda path: F.coalesce(F.get_json_object("data", f"$.{path}"), F.get_json_object("data", f"$._unconverted['{path}']"))
    return rows.select("id", "entity_id", "version", "schema_version", *[fit(value(p), kind).alias(p.replace(".", "_")) for p, kind in columns.items()])
