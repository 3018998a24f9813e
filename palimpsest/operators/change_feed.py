"""Applying a change feed of inserts, updates and deletes to rebuild the current state.

Each task runs an embedded DuckDB with keyed tables, and every delivery is an upsert whose conflict update is conditional
on the stored sequence, so order and repetition of deliveries don't matter:

* ``events``, keyed by entity, version and change_seq: the delivery received last wins. It runs on buckets of event keys,
  so the history of a hot entity, or of one hot version, is spread over all tasks; deliveries of one event that lie in
  one batch of the input are reduced before, so a hot event shrinks before the shuffle.
* ``state``, keyed by entity and path: the event latest in (version, change_seq) wins; removals stay as tombstones, and a
  set leaves on each object above it the mark that it had to be an object then. It runs on the same buckets, then on
  buckets of entities, which get at most one row per bucket and path, however long the history.

An entity is then the last whole value and the later events at its paths, assembled from the shallowest path down. An
entity with very many changes is cut by the first member of their paths: its last whole value is found apart and each of
its members goes to the later events below that member. Bucket results are staged and published in one step.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import arrow, jsonval
from palimpsest.sources.scratch import materialize, new_path, publish, read_snapshot

BUCKET_ROWS, BUCKET_BYTES = 100_000, 64 << 20  # what a bucket's embedded tables get, on average; their number follows
HOT_ROWS = 500_000  # changes of an entity that is cut by the members of its paths
NULL = "\0"  # stands for a null key column inside the keyed tables
EVENT = "entity_type string, entity_id string, version long, change_seq int, received_at long, feed_id long, strategy short, path string, new_value string"
STATE = "entity_type string, entity_id string, path string, version long, change_seq int, kind string, new_value string"
LEAF = "entity_type string, entity_id string, path string, new_value string"

_EVENTS = """create table events (entity_type varchar, entity_id varchar, version bigint, change_seq integer, received_at bigint, feed_id bigint,
  strategy smallint, path varchar, new_value varchar, primary key (entity_type, entity_id, version, change_seq))"""
_TAKE_EVENTS = """insert into events select * from delivered
  qualify row_number() over (partition by entity_type, entity_id, version, change_seq order by received_at desc, feed_id desc) = 1
  on conflict do update set received_at = excluded.received_at, feed_id = excluded.feed_id, strategy = excluded.strategy, path = excluded.path, new_value = excluded.new_value
  where (excluded.received_at, excluded.feed_id) > (events.received_at, events.feed_id)"""
# kind: w whole value or its tombstone, s set, r removed, o an object by then
_STATE = """create table state (entity_type varchar, entity_id varchar, path varchar, slot varchar, version bigint, change_seq integer,
  kind varchar, new_value varchar, primary key (entity_type, entity_id, path, slot))"""
_TAKE_STATE = """insert into state select entity_type, entity_id, path, if(kind = 'o', 'o', 'v'), version, change_seq, kind, new_value from changed
  qualify row_number() over (partition by entity_type, entity_id, path, kind = 'o' order by version desc, change_seq desc) = 1
  on conflict do update set version = excluded.version, change_seq = excluded.change_seq, kind = excluded.kind, new_value = excluded.new_value
  where (excluded.version, excluded.change_seq) > (state.version, state.change_seq)"""
_CHANGES = """select entity_type, entity_id, if(strategy = 0, '', path) as path, version, change_seq,
  if(strategy = 0, 'w', if(new_value is null, 'r', 's')) as kind, new_value from events
  union all
  select entity_type, entity_id, array_to_string(parts[:n], '.'), version, change_seq, 'o', null
  from (select *, string_split(path, '.') as parts, unnest(generate_series(1, len(string_split(path, '.')) - 1)) as n from events where strategy <> 0 and new_value is not null)"""
_EXPORT_STATE = "select entity_type, entity_id, path, version, change_seq, kind, new_value from state order by entity_type, entity_id, path"


def _open(*tables: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect(config={"threads": 1, "temp_directory": ""})
    _clear(db, *tables)
    return db


def _clear(db, *tables: str) -> None:
    """Empty tables; new ones, as deleting from an index costs as much as filling it."""
    for t in tables:
        db.execute(t.replace("create table", "create or replace table", 1))


def _export(db, sql: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in db.sql(sql).to_arrow_table().cast(schema).to_batches(max_chunksize=10_000):
        yield batch


def _take(db, name: str, batch: pa.RecordBatch, sql: str) -> None:
    db.register(name, pa.Table.from_batches([batch]))
    db.execute(sql)
    db.unregister(name)


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the deliveries of one event in a batch the last. ``event`` is a digest of the key."""
    for batch in batches:
        events = batch.column("event").to_numpy()
        order = np.argsort(events, kind="stable")
        if len(order) and (np.diff(events[order]) == 0).any():
            keys = ["entity_type", "entity_id", "version", "change_seq"]
            by = [("event", "ascending"), *[(k, "ascending") for k in keys], ("received_at", "descending"), ("feed_id", "descending")]
            batch = batch.take(pc.sort_indices(batch, by))
            first = np.ones(batch.num_rows, bool)
            first[1:] = np.logical_or.reduce([pc.not_equal(batch.column(k).slice(1), batch.column(k).slice(0, batch.num_rows - 1)).to_numpy(False) for k in keys])
            batch = batch.filter(pa.array(first))
        yield batch


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Slices of one bucket each, of batches in order of bucket; and whether the slice begins a bucket."""
    last = None
    for batch in batches:
        buckets = batch.column("bucket").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
        rows = batch.drop_columns("bucket")
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield rows.slice(a, b - a), buckets[a] != last
                last = buckets[a]


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state of each bucket of events."""
    db = _open(_EVENTS, _STATE)

    def export():
        db.execute(_TAKE_STATE.replace("from changed", f"from ({_CHANGES})"))
        yield from _export(db, _EXPORT_STATE, arrow.schema(STATE))
        _clear(db, _EVENTS, _STATE)

    for n, (rows, begins) in enumerate(_by_bucket(batches)):
        if begins and n:
            yield from export()
        _take(db, "delivered", rows, _TAKE_EVENTS)
    yield from export()


class _Number(str):
    """A number as it was spelled."""


def _refuse(name: str):
    raise ValueError(name)


_decode = json.JSONDecoder(parse_float=_Number, parse_int=_Number, parse_constant=_refuse).decode


def _leaf(value) -> str:
    return str(value) if isinstance(value, _Number) else json.dumps(value, ensure_ascii=False)


def _leaves(value, path: str) -> Iterator[tuple[str, str]]:
    todo = [(path, value)]
    while todo:
        at, x = todo.pop()
        if isinstance(x, dict) and x:
            todo += [(f"{at}.{k}" if at else k, c) for k, c in x.items()]
        else:
            yield at, jsonval.spell(x, _leaf) if isinstance(x, (dict, list)) else _leaf(x)


def _value(text: str):
    try:
        return jsonval.load(text, _decode, (_Number, _Number))
    except ValueError:
        return text


def assemble(rows: list[tuple]) -> Iterator[tuple[str, str]]:
    """(path, JSON text) of each leaf from one entity's state rows (path, version, change_seq, kind, new_value)."""
    whole = next((r for r in rows if r[3] == "w"), None)
    if whole is None or whole[4] is None:
        return
    base = whole[1:3]
    root = _value(whole[4])
    # what is latest at or above a path decides; deeper events older than it are gone with it
    later = sorted((r for r in rows if r[3] != "w" and r[1:3] > base), key=lambda r: r[1:3])
    for path, _, _, kind, text in later:
        *head, tail = path.split(".")
        if not isinstance(root, dict):
            if kind == "r":
                continue
            root = {}
        at = root
        for p in head:
            below = at.get(p)
            if not isinstance(below, dict):
                if kind == "r":
                    break
                below = at[p] = {}
            at = below
        else:
            if kind == "r":
                at.pop(tail, None)
            elif kind == "s":
                at[tail] = _value(text)
            elif not isinstance(at.get(tail), dict):
                at[tail] = {}
    yield from _leaves(root, "")


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The leaves of each bucket of entities."""
    db, schema = _open(_STATE), arrow.schema(LEAF)
    out: list[tuple] = []

    def export():
        entity, rows = None, []
        for batch in _export(db, _EXPORT_STATE, arrow.schema(STATE)):
            for t, e, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (t, e) != entity:
                    out.extend((*entity, *leaf) for leaf in assemble(rows))
                    entity, rows = (t, e), []
                rows.append(tuple(row))
            if len(out) >= 10_000:
                yield arrow.batch(out, schema)
                out.clear()
        out.extend((*entity, *leaf) for leaf in assemble(rows))
        _clear(db, _STATE)

    for n, (rows, begins) in enumerate(_by_bucket(batches)):
        if begins and n:
            yield from export()
        _take(db, "changed", rows, _TAKE_STATE)
    yield from export()
    yield arrow.batch(out, schema)


MEMBER = "entity_type string, entity_id string, version long, change_seq int, member string, new_value string"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each member of whole values as an object of its own; a value that is no object under the member null."""
    for batch in batches:
        out = []
        for t, e, v, q, text in zip(*(c.to_pylist() for c in batch.columns)):
            value = _value(text)
            parts = [(k, jsonval.spell({k: x}, _leaf)) for k, x in value.items()] if isinstance(value, dict) else [(None, text)]
            out += [(t, e, v, q, k.split(".", 1)[0] if k is not None else None, x) for k, x in parts]
        yield arrow.batch(out, arrow.schema(MEMBER))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Objects with one member each, joined to one object."""
    for batch in batches:
        texts = ["{" + ",".join(x[1:-1] for x in parts if x != "{}") + "}" for parts in batch.column("parts").to_pylist()]
        yield batch.drop_columns("parts").append_column("new_value", pa.array(texts, pa.string()))


def _apart(state: DataFrame, bucketed) -> DataFrame:
    """LEAF rows of entities whose state rows are too many for one task, cut by the first member of their paths."""
    entity = ["entity_type", "entity_id"]
    state = materialize(state, "hot-state")
    last = state.where("kind = 'w'").groupBy(*entity).agg(F.max(F.struct("version", "change_seq", "new_value")).alias("w")).select(*entity, "w.*").where("new_value is not null")
    last = materialize(last, "hot-wholes")  # a row for each of these entities
    later = state.where("kind <> 'w'").join(last.select(*entity, F.col("version").alias("_v"), F.col("change_seq").alias("_q")), entity)
    later = later.where((F.col("version") > F.col("_v")) | ((F.col("version") == F.col("_v")) & (F.col("change_seq") > F.col("_q"))))
    later = materialize(later.withColumn("member", F.substring_index("path", ".", 1)).drop("_v", "_q"), "hot-changes")
    members = materialize(last.select(*entity, "version", "change_seq", "new_value").mapInArrow(_members, MEMBER), "hot-members")
    # every member that is there or changes begins as an object with it or without
    begun = later.select(*entity, "member", F.lit("{}").alias("part")).distinct().unionByName(members.where("member is not null").select(*entity, "member", F.col("new_value").alias("part")))
    begun = begun.groupBy(*entity, "member").agg(F.array_sort(F.collect_list("part")).alias("parts")).mapInArrow(_merged, "entity_type string, entity_id string, member string, new_value string")
    base = begun.join(last.select(*entity, "version", "change_seq"), entity).select(*entity, "member", F.lit("").alias("path"), "version", "change_seq", F.lit("w").alias("kind"), "new_value")
    split = "\x01"
    shards = base.unionByName(later).withColumn("entity_id", F.concat("entity_id", F.lit(split), F.hex("member"))).drop("member")
    leaves = bucketed(shards, *entity).mapInArrow(_entities, LEAF).withColumn("entity_id", F.expr(f"left(entity_id, length(entity_id) - locate('{split}', reverse(entity_id)))"))
    leaves = materialize(leaves.where("path <> '' or new_value <> '{}'"), "hot-leaves")  # what is left of a member that went
    # entities without any leaf: the whole value if it is no object and nothing was set, else the empty object
    changed = later.where("kind = 's' or kind = 'o'").select(*entity).distinct().withColumn("_set", F.lit(True))
    bare = last.join(leaves.select(*entity).distinct(), entity, "left_anti").join(changed, entity, "left").join(members.where("member is null").select(*entity, F.col("new_value").alias("_plain")), entity, "left")
    text = F.when(F.col("_set").isNull() & F.col("_plain").isNotNull(), F.col("_plain")).otherwise(F.lit("{}"))
    return leaves.unionByName(bare.select(*entity, F.lit("").alias("path"), text.alias("new_value")).mapInArrow(_spelled, LEAF))


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [next(_leaves(_value(t), ""))[1] for t in batch.column("new_value").to_pylist()]
        yield batch.set_column(3, "new_value", arrow.array(texts, pa.string()))


def rebuild_state(feed: DataFrame) -> DataFrame:
    """(entity_type, entity_id, path, new_value) of each leaf of the entities that exist after all changes.

    feed: entity_type, entity_id, version, change_seq, strategy, path, new_value, received_at, feed_id; other columns are
    not read. Of several rows with one (entity, version, change_seq) the one received last counts, then the greatest
    feed_id. Strategy 0 replaces the whole entity, null deletes it; any other strategy sets the member at the dotted path
    or, null, removes it. Null version, change_seq, received_at or feed_id come before all others; null strategy is 0
    where the path is empty, else 1; null entity keys are one key; a null or empty path of a partial change names the
    member ''. A new_value that is not JSON is taken as a string. Numbers keep their spelling.
    """
    early = -(2**62)
    path = F.coalesce("path", F.lit(""))
    rows = feed.select(
        F.coalesce("entity_type", F.lit(NULL)).alias("entity_type"), F.coalesce("entity_id", F.lit(NULL)).alias("entity_id"),
        F.coalesce(F.col("version").cast("long"), F.lit(early)).alias("version"), F.coalesce(F.col("change_seq").cast("int"), F.lit(-(2**31))).alias("change_seq"),
        F.coalesce(F.unix_micros(F.col("received_at").cast("timestamp")), F.lit(early)).alias("received_at"), F.coalesce(F.col("feed_id").cast("long"), F.lit(early)).alias("feed_id"),
        F.coalesce(F.col("strategy"), F.when(path == "", 0).otherwise(1)).cast("short").alias("strategy"), path.alias("path"), "new_value",
    )
    sizes = rows.groupBy("entity_type", "entity_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("new_value")).alias("bytes"))
    count, size, most = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0)), F.max("n")).first()
    # tasks are the session's matter; buckets inside a task are as many as memory asks
    tasks = int(feed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = tasks * (1 + max(count // BUCKET_ROWS, size // BUCKET_BYTES) // tasks)

    def bucketed(df: DataFrame, *key: str) -> DataFrame:
        of = df.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)))
        return of.repartitionById(tasks, F.pmod("bucket", F.lit(tasks)).cast("int")).sortWithinPartitions("bucket")

    key = ["entity_type", "entity_id", "version", "change_seq"]
    deliveries = rows.withColumn("event", F.xxhash64(*key)).mapInArrow(_combine, EVENT + ", event long").drop("event")
    state = bucketed(deliveries, *key).mapInArrow(_bucket, STATE)
    if (most or 0) > HOT_ROWS:
        state = materialize(state, "state")
        hot = materialize(sizes.where(F.col("n") > HOT_ROWS).select("entity_type", "entity_id"), "hot-entities")
        rest = state.join(hot, ["entity_type", "entity_id"], "left_anti")
        leaves = bucketed(rest, "entity_type", "entity_id").mapInArrow(_entities, LEAF).unionByName(_apart(state.join(hot, ["entity_type", "entity_id"], "left_semi"), bucketed))
    else:
        leaves = bucketed(state, "entity_type", "entity_id").mapInArrow(_entities, LEAF)
    return leaves.select(F.nullif("entity_type", F.lit(NULL)).alias("entity_type"), F.nullif("entity_id", F.lit(NULL)).alias("entity_id"), "path", "new_value")


def apply_feed(feed: DataFrame, root: str | None = None) -> DataFrame:
    """``rebuild_state``, published as the current snapshot of ``root`` and read back from it."""
    root = root or new_path(feed.sparkSession, "entities")
    publish(rebuild_state(feed), root)
    return read_snapshot(feed.sparkSession, root)
