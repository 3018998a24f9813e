"""Queries for the version-history operators, each over a whole log derived from the test tables, with their SQL.

Two logs: ``user`` versions are the events of a user, ``customer`` versions the orders of a customer (FIXTURES.md).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.auditor import Auditor
from palimpsest.functions import canon, metadata, msgpack
from palimpsest.model import ENTITY, cache_key, cold_key, record_id, strategy_name
from palimpsest.operators import analytics, diff, guardrails, integrity, lifecycle, query, reconstruct, redact, versioning
from palimpsest.plans.hooks import Hooks
from palimpsest.plans.migrations import Migrations
from palimpsest.plans.registry import EntityType, Registry, tagged
from palimpsest.sources import wal
from palimpsest.sources.scratch import materialize, new_path, write_bytes
from palimpsest.sources.store import ColdStore, Router, VersionStore, decode, encode
from palimpsest.streaming import versioner

USER = EntityType("user", T.StructType([tagged("ID", T.StringType(), "id"), tagged("Status", T.StringType(), "tracked"), tagged("Cents", T.LongType(), "tracked"), tagged("K", T.LongType(), "tracked")]), "ID")
NOW = "2024-07-01 00:00:00"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_U = """u as (select concat('ev-', cast(event_id as varchar)) as id, 'user' as entity_type, cast(user_id as varchar) as entity_id,
  cast(row_number() over (partition by user_id order by ts, event_id) as bigint) as version, event_type as status,
  cast(round(value * 100) as bigint) as cents, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k,
  concat('actor-', cast(event_id % 7 as varchar)) as actor_id, case event_id % 3 when 0 then 'human' when 1 then 'system' else 'service' end as actor_type,
  concat('tenant-', cast(user_id % 4 as varchar)) as tenant_id, ts as created_at,
  concat('{"ID":"', cast(user_id as varchar), '","Status":"', event_type, '","Cents":', cast(cast(round(value * 100) as bigint) as varchar), ',"K":', regexp_extract(props, '([0-9]+)', 1), '}') as data
  from events)"""
_C = """c as (select concat('o-', cast(o_orderkey as varchar)) as id, 'customer' as entity_type, cast(o_custkey as varchar) as entity_id,
  cast(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as bigint) as version, o_orderstatus as status, o_orderpriority as priority,
  cast(round(o_totalprice * 100) as bigint) as cents, concat('actor-', cast(o_orderkey % 11 as varchar)) as actor_id, o_orderdate as created_at from orders)"""


def _query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{d}/{name}.parquet")


def _text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def users(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "events").withColumn("entity_id", _text("user_id"))
    n = F.row_number().over(Window.partitionBy("entity_id").orderBy("ts", "event_id")).cast("long")
    cents, k = F.round(F.col("value") * 100).cast("long"), F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    rows = e.select(
        F.concat(F.lit("ev-"), _text("event_id")).alias("id"), F.lit("user").alias("entity_type"), "entity_id", n.alias("version"), F.col("event_type").alias("status"), cents.alias("cents"), k.alias("k"),
        F.concat(F.lit("actor-"), _text(F.col("event_id") % 7)).alias("actor_id"), F.element_at(F.array(*[F.lit(x) for x in ("human", "system", "service")]), (F.col("event_id") % 3 + 1).cast("int")).alias("actor_type"),
        F.concat(F.lit("tenant-"), _text(F.col("user_id") % 4)).alias("tenant_id"), F.col("ts").cast("timestamp").alias("created_at"),
    )
    state = F.struct(F.col("entity_id").alias("ID"), F.col("status").alias("Status"), F.col("cents").alias("Cents"), F.col("k").alias("K"))
    return rows.withColumn("state", state).withColumn("data", canon.json_text(F.col("state"), USER.schema))


def customers(spark: SparkSession, d: str) -> DataFrame:
    o = _table(spark, d, "orders").withColumn("entity_id", _text("o_custkey"))
    n = F.row_number().over(Window.partitionBy("entity_id").orderBy("o_orderdate", "o_orderkey")).cast("long")
    return o.select(F.concat(F.lit("o-"), _text("o_orderkey")).alias("id"), F.lit("customer").alias("entity_type"), "entity_id", n.alias("version"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), F.concat(F.lit("actor-"), _text(F.col("o_orderkey") % 11)).alias("actor_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"))


# reads


@_query(f"with {_U} select id, entity_id, version, status, cents, k from u where version = 37")
def get_version(spark, d):
    return query.get_version(users(spark, d), 37).select("id", "entity_id", "version", "status", "cents", "k")


@_query(f"with {_U} select entity_id, id, version, status, cents, k from u qualify row_number() over (partition by entity_id order by version desc) = 1")
def latest_versions(spark, d):
    return query.latest_versions(users(spark, d).select("entity_type", "entity_id", "version", "id", "status", "cents", "k")).select("entity_id", "id", "version", "status", "cents", "k")


@_query(f"with {_C} select entity_id, id, version, status, cents from c where created_at <= timestamp '1996-06-30' qualify row_number() over (partition by entity_id order by created_at desc, version desc) = 1")
def state_at_time(spark, d):
    rows = customers(spark, d).select("entity_type", "entity_id", "created_at", "version", "id", "status", "cents")
    return query.state_at_time(rows, "1996-06-30 00:00:00").select("entity_id", "id", "version", "status", "cents")


@_query(f"with {_U} select entity_id, version, id from u qualify row_number() over (partition by entity_id order by version desc) between 11 and 60")
def list_versions_page(spark, d):
    return query.list_versions(users(spark, d).select("entity_type", "entity_id", "version", "id"), limit=50, offset=10).select("entity_id", "version", "id")


@_query(f"with {_U} select version, entity_id, id from u order by version desc, entity_id desc, id desc limit 50 offset 100")
def olap_page(spark, d):
    return query.olap_page(users(spark, d).select("entity_type", "version", "entity_id", "id"), "user", 50, 100).drop("entity_type")


_WANTED = "wanted as (select cast(c_custkey % 5 as bigint) as position, cast(c_custkey as varchar) as entity_id, timestamp '1995-01-01' + to_days(cast(c_custkey % 1000 as integer)) as asked from customer)"


@_query(f"with {_C}, {_WANTED} select position, entity_id, id, version from wanted join c using (entity_id) where created_at <= asked qualify row_number() over (partition by position, entity_id order by created_at desc, version desc) = 1")
def bulk_state_at_time(spark, d):
    key = F.col("c_custkey")
    at = F.lit("1995-01-01").cast("timestamp") + F.make_interval(days=(key % 1000).cast("int"))
    wanted = _table(spark, d, "customer").select((key % 5).cast("long").alias("position"), F.lit("customer").alias("entity_type"), _text(key).alias("entity_id"), at.alias("at"))
    return query.bulk_state_at_time(customers(spark, d).select(*ENTITY, "created_at", "version", "id"), wanted).select("position", "entity_id", "id", "version")


@_query(f"""with {_U}, p as (select cast(event_id as bigint) as event_id, cast(user_id as varchar) as entity_id, ts + interval 1 hour as at from events where event_type = 'purchase'),
  q as (select * from u where status <> 'purchase')
  select p.event_id, p.entity_id, q.version, q.status from p asof left join q on p.entity_id = q.entity_id and p.at >= q.created_at""")
def asof_join(spark, d):
    e = _table(spark, d, "events").where("event_type = 'purchase'")
    probes = e.select("event_id", _text("user_id").alias("entity_id"), (F.col("ts").cast("timestamp") + F.expr("interval 1 hour")).alias("at"))
    states = users(spark, d).where("status <> 'purchase'").select("entity_id", "created_at", "version", "status")
    return query.asof_join(probes, states, ["entity_id"], "at", "created_at", ["version", "status"], "version").drop("at")


# versioning


@_query("""with s as (select user_id, count(*) as n from events where event_id % 2 = 0 group by 1)
  select cast(e.event_id as bigint) as event_id, cast(e.user_id as varchar) as entity_id,
    cast(coalesce(s.n, 0) + row_number() over (partition by e.user_id order by e.ts, e.event_id) as bigint) as version
  from events e left join s using (user_id) where e.event_id % 2 = 1""")
def version_sequence(spark, d):
    """The even events are stored already, the odd ones come in: numbering goes on after each entity's greatest."""
    e = _table(spark, d, "events").withColumn("entity_id", _text("user_id"))
    stored = versioning.number_versions(e.where("event_id % 2 = 0"), None, ["ts", "event_id"], ["entity_id"])
    return versioning.number_versions(e.where("event_id % 2 = 1"), stored, ["ts", "event_id"], ["entity_id"]).select("event_id", "entity_id", "version")


@_query(f"""with {_U} select entity_id, version, case when version = 1 then 'full' when status = 'error' then 'full' when version % 10 = 1 then 'full' else 'delta' end as strategy from u""")
def strategy_selection(spark, d):
    code = versioning.select_strategy(F.col("version"), 2, F.when(F.col("status") == "error", F.lit(0)))
    return users(spark, d).select("entity_id", "version", strategy_name(code).alias("strategy"))


_CHANGED = """l as (select *, lag(status) over w as p_status, lag(cents) over w as p_cents, lag(k) over w as p_k from u window w as (partition by entity_id order by version)),
  ch as (select entity_id, version, 0 as o, 'Status' as path, concat('"', p_status, '"') as old_value, concat('"', status, '"') as new_value from l where version > 1 and p_status <> status
    union all select entity_id, version, 1, 'Cents', cast(p_cents as varchar), cast(cents as varchar) from l where version > 1 and p_cents <> cents
    union all select entity_id, version, 2, 'K', cast(p_k as varchar), cast(k as varchar) from l where version > 1 and p_k <> k)"""


def _batch(spark, d, **options) -> DataFrame:
    incoming = users(spark, d).select("entity_id", "state", "created_at", "id")
    return versioning.version_batch(incoming, USER, ["created_at", "id"], **options)


@_query(f"""with {_U}, {_CHANGED}, n as (select entity_id, version, count(*) as n from ch group by all)
  select entity_id, version, case when version % 10 = 1 then 'full' else 'delta' end as strategy, case when version % 10 = 1 then 0 else coalesce(n, 0) end as changes, data
  from u left join n using (entity_id, version)""")
def validated_strategy(spark, d):
    """The whole write pipeline: number, strategy, diff, validation, payload."""
    rows = _batch(spark, d)
    return rows.select("entity_id", "version", strategy_name(F.col("strategy")).alias("strategy"), F.coalesce(F.size("delta"), F.lit(0)).cast("long").alias("changes"), "data")


_GUARDED = f"""{_U}, ok as (select *, row_number() over (partition by entity_id order by created_at, id) as n from u where strlen(data) <= 49), g as (select * replace (cast(n as bigint) as version) from ok)"""


def _guarded(spark: SparkSession, d: str) -> Auditor:
    """An auditor that refuses payloads of more than 49 bytes, which hits a third of the states or so."""
    audit = Auditor(spark, new_path(spark, "guarded"), max_entity=49)
    audit.register("user", USER.schema)
    audit.version("user", users(spark, d).select("entity_id", "state", "created_at", "id"), order=("created_at", "id"))
    return audit


@_query(f"with {_GUARDED}, {_CHANGED.replace('from u window', 'from g window')}, n as (select entity_id, version, count(*) as n from ch group by all) select g.entity_id, g.version, case when g.version % 10 = 1 then 0 else 1 end as strategy, case when g.version % 10 = 1 then 0 else coalesce(n.n, 0) end as changes, g.data, true as ok from g left join n using (entity_id, version)")
def guarded_versions(spark, d):
    """Refused states are no versions: numbers have no holes, deltas lead from one accepted state to the next, chains hold."""
    audit = _guarded(spark, d)
    return audit.store.read().join(audit.verify_integrity().select("entity_id", "ok"), "entity_id").select("entity_id", "version", F.col("strategy").cast("int").alias("strategy"), F.coalesce(F.size("delta"), F.lit(0)).cast("long").alias("changes"), "data", "ok")


@_query(f"with {_GUARDED}, t as (select * from g qualify row_number() over (partition by entity_id order by version desc) = 1) select entity_id, 'ID' as path, concat('\"', entity_id, '\"') as new_value from t union all select entity_id, 'Status', concat('\"', status, '\"') from t union all select entity_id, 'Cents', cast(cents as varchar) from t union all select entity_id, 'K', cast(k as varchar) from t")
def guarded_reconstruct(spark, d):
    """What is rebuilt from snapshots and deltas after refusals is the last accepted state."""
    stored = _guarded(spark, d).store.read()
    return reconstruct.reconstruct(stored.withColumn("data", F.when(F.col("strategy") == 0, F.col("data")))).select("entity_id", "path", "new_value")


# differences


@_query(f"with {_U}, {_CHANGED} select entity_id, version, cast(row_number() over (partition by entity_id, version order by o) - 1 as integer) as position, path, old_value, new_value from ch")
def field_changes(spark, d):
    return diff.explode_changes(diff.history_changes(users(spark, d), USER), "entity_id", "version")


@_query(f"with {_U}, {_CHANGED} select entity_id, version, old_value, new_value from ch where path = 'Status'")
def find_changes(spark, d):
    return query.find_changes(users(spark, d), USER, "Status")


@_query(f"with {_U}, {_CHANGED} select entity_id, version, old_value, new_value from ch where path = 'Status' and version <= 50")
def find_changes_first50(spark, d):
    return query.find_changes(users(spark, d), USER, "Status", first=50)


@_query(f"""with {_U}, a as (select * from u where version = 5), b as (select * from u where version = 40), j as (select b.*, a.status as s, a.cents as c, a.k as q from a join b using (entity_id))
  , ch as (select entity_id, 0 as o, 'Status' as path, concat('"', s, '"') as old_value, concat('"', status, '"') as new_value from j where s <> status
  union all select entity_id, 1, 'Cents', cast(c as varchar), cast(cents as varchar) from j where c <> cents
  union all select entity_id, 2, 'K', cast(q as varchar), cast(k as varchar) from j where q <> k)
  select entity_id, cast(row_number() over (partition by entity_id order by o) - 1 as integer) as position, path, old_value, new_value from ch""")
def compare_versions(spark, d):
    return query.compare_versions(users(spark, d), USER, 5, 40)


_SHAPES = T.StructType(
    [
        tagged("ID", T.StringType(), "id"),
        tagged("Terms", T.StructType([T.StructField("Status", T.StringType()), T.StructField("Urgency", T.StructType([T.StructField("Priority", T.StringType()), T.StructField("Rank", T.LongType())]))]), "tracked"),
        tagged("Money", T.StructType([T.StructField("Cents", T.LongType())]), "tracked"),
        tagged("Note", T.StringType(), "tracked"),
        tagged("Tags", T.MapType(T.StringType(), T.LongType()), "tracked"),
        tagged("Deep", T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType())), "tracked"),
        tagged("Codes", T.ArrayType(T.LongType()), "tracked"),
        tagged("Bag", T.ArrayType(T.LongType()), "tracked,normalized"),
        tagged("Lines", T.ArrayType(T.StructType([T.StructField("N", T.LongType()), T.StructField("S", T.StringType())])), "tracked"),
        tagged("Stamp", T.StructType([tagged("By", T.StringType(), "tracked"), tagged("Junk", T.StringType())]), "embedded"),
        tagged("At", T.TimestampType(), "tracked"),
        tagged("Hidden", T.StringType(), "ignore"),
        tagged("Untracked", T.StringType()),
    ]
)
_SHAPED = """l as (select *, lag(status) over w as p_status, lag(priority) over w as p_priority, lag(cents) over w as p_cents, lag(actor_id) over w as p_actor, lag(created_at) over w as p_at, version > 1 as known from c window w as (partition by entity_id order by version)),
  ch as (select entity_id, version, 0 as o, 'Terms.Status' as path, '"' || p_status || '"' as old_value, '"' || status || '"' as new_value from l where known and p_status <> status
    union all select entity_id, version, 1, 'Terms.Urgency.Priority', '"' || p_priority || '"', '"' || priority || '"' from l where known and p_priority <> priority
    union all select entity_id, version, 2, 'Terms.Urgency.Rank', substr(p_priority, 1, 1), substr(priority, 1, 1) from l where known and substr(p_priority, 1, 1) <> substr(priority, 1, 1)
    union all select entity_id, version, 3, case when p_cents % 5 = 0 or cents % 5 = 0 then 'Money' else 'Money.Cents' end,
      case when p_cents % 5 = 0 then null when cents % 5 = 0 then '{"Cents":' || p_cents || '}' else p_cents::varchar end, case when cents % 5 = 0 then null when p_cents % 5 = 0 then '{"Cents":' || cents || '}' else cents::varchar end
      from l where known and not (p_cents % 5 = 0 and cents % 5 = 0) and (p_cents <> cents or p_cents % 5 = 0 or cents % 5 = 0)
    union all select entity_id, version, 4, 'Note', x, y from (select *, case when p_cents % 3 > 0 then '"' || p_status || '"' end as x, case when cents % 3 > 0 then '"' || status || '"' end as y from l) where known and x is distinct from y
    union all select entity_id, version, 5, 'Tags.' || status, case when p_status = status then (p_cents % 4)::varchar end, (cents % 4)::varchar from l where known and (p_status <> status or p_cents % 4 <> cents % 4)
    union all select entity_id, version, 5, 'Tags.' || p_status, (p_cents % 4)::varchar, null from l where known and p_status <> status
    union all select entity_id, version, 6, 'Deep.' || status || '.p', '"' || p_priority || '"', '"' || priority || '"' from l where known and p_status = status and p_priority <> priority
    union all select entity_id, version, 6, 'Deep.' || status, null, '{"p":"' || priority || '"}' from l where known and p_status <> status
    union all select entity_id, version, 6, 'Deep.' || p_status, '{"p":"' || p_priority || '"}', null from l where known and p_status <> status
    union all select entity_id, version, 7, 'Codes', x, y from (select *, '[' || p_cents % 2 || ',' || p_cents % 3 || ']' as x, '[' || cents % 2 || ',' || cents % 3 || ']' as y from l) where known and x <> y
    union all select entity_id, version, 8, 'Bag', x, y from (select *, '[' || least(p_cents % 2, p_cents % 3) || ',' || greatest(p_cents % 2, p_cents % 3) || ']' as x, '[' || least(cents % 2, cents % 3) || ',' || greatest(cents % 2, cents % 3) || ']' as y from l) where known and x <> y
    union all select entity_id, version, 9, 'Lines', x, y from (select *, case when p_cents % 7 > 0 then '[{"N":' || p_cents % 4 || ',"S":"' || p_status || '"}]' else '[]' end as x, case when cents % 7 > 0 then '[{"N":' || cents % 4 || ',"S":"' || status || '"}]' else '[]' end as y from l) where known and x <> y
    union all select entity_id, version, 10, 'By', '"' || p_actor || '"', '"' || actor_id || '"' from l where known and p_actor <> actor_id
    union all select entity_id, version, 11, 'At', strftime(p_at, '"%Y-%m-%dT%H:%M:%SZ"'), strftime(created_at, '"%Y-%m-%dT%H:%M:%SZ"') from l where known and p_at <> created_at)"""


def _shaped(spark: SparkSession, d: str) -> DataFrame:
    """Orders as versions of a customer with fields of every kind."""
    cents, status, priority = F.col("cents"), F.col("status"), F.col("priority")
    pair = F.array(cents % 2, cents % 3)
    values = {
        "ID": F.col("entity_id"), "Terms": F.struct(status, F.struct(priority, F.substring(priority, 1, 1).cast("long"))), "Money": F.when(cents % 5 != 0, F.struct(cents)), "Note": F.when(cents % 3 > 0, status), "Tags": F.create_map(status, cents % 4),
        "Deep": F.create_map(status, F.create_map(F.lit("p"), priority)), "Codes": pair, "Bag": F.when(F.col("version") % 2 == 0, F.reverse(pair)).otherwise(pair), "Lines": F.when(cents % 7 > 0, F.array(F.struct((cents % 4).alias("N"), status.alias("S")))).otherwise(F.array().cast(_SHAPES["Lines"].dataType)),
        "Stamp": F.struct(F.col("actor_id"), F.col("id")), "At": F.col("created_at"), "Hidden": F.col("id"), "Untracked": F.col("id"),
    }
    return customers(spark, d).select("entity_id", "version", F.struct(*[values[f.name].cast(f.dataType).alias(f.name) for f in _SHAPES.fields]).alias("state"))


@_query(f"with {_C}, {_SHAPED} select entity_id, version, cast(row_number() over (partition by entity_id, version order by o, path) - 1 as integer) as position, path, old_value, new_value from ch")
def nested_changes(spark, d):
    """Differences of structs in structs, null structs and values, maps, maps of maps, lists, lists without order, embedded fields and times."""
    return diff.explode_changes(diff.history_changes(_shaped(spark, d), EntityType("customer", _SHAPES, "ID")), "entity_id", "version")


@_query(f"with {_C} select entity_id, version, true as same from c where version > 1")
def applied_changes(spark, d):
    """Each state's delta, applied to the state before, leads to the state (in what is compared; the rest stays as it was)."""
    rows = diff.history_changes(_shaped(spark, d), EntityType("customer", _SHAPES, "ID")).where("version > 1")
    reached = diff.apply(F.col("previous"), F.col("delta"), _SHAPES)
    seen = lambda c: F.struct(*[(c["Stamp"]["By"] if f.name == "Stamp" else F.array_sort(c["Bag"]) if f.name == "Bag" else canon.json_text(c[f.name], f.dataType)).alias(f.name) for f in _SHAPES.fields if f.name not in ("Hidden", "Untracked")])
    return rows.select("entity_id", "version", (seen(reached) == seen(F.col("state"))).alias("same"))


# actors and tenants


@_query(f"with {_U} select entity_id, version, id from u where actor_id = 'actor-3'")
def find_by_actor(spark, d):
    return query.find_by_actor(users(spark, d), "actor-3", column="actor_id").select("entity_id", "version", "id")


@_query(f"with {_U}, p as (select * from u qualify row_number() over (partition by entity_id order by version desc) <= 50) select entity_id, version, id from p where actor_id = 'actor-3'")
def find_by_actor_paged(spark, d):
    return query.find_by_actor(users(spark, d), "actor-3", 50, filter_first=False, column="actor_id").select("entity_id", "version", "id")


@_query("select distinct on (id) id, entity_id, version from audit_versions where metadata.custom['tenant_id'] = 'tenant-03' order by id")
def tenant_list(spark, d):
    return guardrails.tenant_scope(_table(spark, d, "audit_versions"), "tenant-03").select("id", "entity_id", "version").dropDuplicates(["id"])


# integrity

_CHAIN = f"""recursive {_U}, h as (select entity_id, version, data, sha256(concat('{{"entity_type":"user","entity_id":"', entity_id, '","version":', cast(version as varchar), ',"data":"', to_base64(data::blob), '","previous_hash":""}}')) as hash, '' as previous_hash from u where version = 1
  union all select u.entity_id, u.version, u.data, sha256(concat('{{"entity_type":"user","entity_id":"', u.entity_id, '","version":', cast(u.version as varchar), ',"data":"', to_base64(u.data::blob), '","previous_hash":"', h.hash, '"}}')), h.hash
  from h join u on u.entity_id = h.entity_id and u.version = h.version + 1)"""


def _chained(spark, d) -> DataFrame:
    return integrity.hash_chain(users(spark, d).select("entity_type", "entity_id", "version", "data"))


@_query(f"with {_CHAIN} select entity_id, version, hash, previous_hash from h")
def hash_chain(spark, d):
    return _chained(spark, d).select("entity_id", "version", "hash", "previous_hash")


@_query(f"with {_U} select entity_id, bool_and(not (cast(entity_id as bigint) % 3 = 0 and version = 20)) as ok from u group by 1")
def verify_chain(spark, d):
    """Chains are computed, the payload of one version of each third entity is changed, and all are verified."""
    changed = (F.col("entity_id").cast("long") % 3 == 0) & (F.col("version") == 20)
    return integrity.verify_chains(_chained(spark, d).withColumn("data", F.when(changed, F.concat("data", F.lit(" "))).otherwise(F.col("data")))).select("entity_id", "ok")


@_query(f"""with {_U}, t as (select entity_id, min(version) filter (version % 17 = 5 and k % 3 = 0) as d, min(version) filter (version % 23 = 7 and k % 2 = 0) as p from u group by 1)
  select entity_id, least(coalesce(d, 1000000), coalesce(p, 1000000)) as first_bad_version, case when coalesce(p, 1000000) <= coalesce(d, 1000000) then 'pointer' else 'hash' end as error from t where d is not null or p is not null""")
def detect_tampering(spark, d):
    """Payloads and pointers of some versions are changed afterwards; the first bad version of each entity is found."""
    rows = integrity.hash_chain(users(spark, d).select("entity_type", "entity_id", "version", "data", "k"))
    broken = (F.col("version") % 17 == 5) & (F.col("k") % 3 == 0)
    cut = (F.col("version") % 23 == 7) & (F.col("k") % 2 == 0)
    rows = rows.withColumns({"data": F.when(broken, F.concat("data", F.lit(" "))).otherwise(F.col("data")), "previous_hash": F.when(cut, F.lit("0")).otherwise(F.col("previous_hash"))})
    return integrity.verify_chains(rows).where("not ok").select("entity_id", "first_bad_version", "error")


# reconstruction


@_query(f"""with {_U}, t as (select * from u where version <= 45 qualify row_number() over (partition by entity_id order by version desc) = 1)
  select entity_id, 'ID' as path, concat('"', entity_id, '"') as new_value from t union all select entity_id, 'Status', concat('"', status, '"') from t
  union all select entity_id, 'Cents', cast(cents as varchar) from t union all select entity_id, 'K', cast(k as varchar) from t""")
def reconstruct_state(spark, d):
    """From snapshots and deltas as the write pipeline stores them; deltas' data is taken away first."""
    rows = materialize(_batch(spark, d).withColumn("data", F.when(F.col("strategy") == 0, F.col("data"))), "stored")
    return reconstruct.reconstruct(rows, 45).select("entity_id", "path", "new_value")


@_query(f"""with {_U}, s as (select entity_id, version, case when version = 1 or status = 'error' then 0 else 1 end as strategy from u), g as (select *, sum(1 - strategy) over (partition by entity_id order by version) as run from s),
  r as (select *, sum(strategy) over (partition by entity_id, run order by version) as n from g) select entity_id, version, strategy = 1 and n % 5 = 0 as compact from r""")
def compaction_plan(spark, d):
    code = F.when((F.col("version") == 1) | (F.col("status") == "error"), 0).otherwise(1)
    return reconstruct.compaction_plan(users(spark, d).select("entity_type", "entity_id", "version", code.alias("strategy")), 5).select("entity_id", "version", "compact")


@_query(f"""with {_U}, t as (select * from u qualify row_number() over (partition by entity_id order by version desc) = 1)
  select entity_id, 'ID' as path, concat('"', entity_id, '"') as new_value from t union all select entity_id, 'Status', concat('"', status, '"') from t
  union all select entity_id, 'Cents', cast(cents as varchar) from t union all select entity_id, 'K', cast(k as varchar) from t""")
def compacted_reconstruct(spark, d):
    """States are the same after compaction has made each third delta in a row full."""
    rows = reconstruct.compact(_batch(spark, d), 3)
    return reconstruct.reconstruct(materialize(rows.withColumn("data", F.when(F.col("strategy") == 0, F.col("data"))), "compacted")).select("entity_id", "path", "new_value")


@_query(f"with {_U} select entity_id, bool_and(not (cast(entity_id as bigint) % 4 = 1 and version = 30)) as ok, max(case when cast(entity_id as bigint) % 4 = 1 and version = 30 then 'pointer' end) as error from u where version > 10 group by 1")
def verify_anchored(spark, d):
    """Chains whose first versions retention removed hold; a pointer that was changed is found."""
    cut = (F.col("entity_id").cast("long") % 4 == 1) & (F.col("version") == 30)
    rows = _chained(spark, d).where("version > 10").withColumn("previous_hash", F.when(cut, F.lit("0")).otherwise(F.col("previous_hash")))
    return integrity.verify_chains(rows, anchored=True).select("entity_id", "ok", "error")


# redaction, metadata, guardrails


@_query(f"with {_U} select entity_id, true as ok, count(*) as versions from u group by 1")
def redact_rechain(spark, d):
    """Redacted records with a chain computed anew verify; none keeps the value."""
    rows = integrity.hash_chain(redact.redact_field(_chained(spark, d), "Status"))
    whole = rows.groupBy("entity_id").agg(F.sum((F.get_json_object("data", "$.Status") == "[REDACTED]").cast("long")).alias("versions"))
    return integrity.verify_chains(rows).select("entity_id", "ok").join(whole, "entity_id")


@_query("""select cast(o_orderkey as bigint) as key, concat('{"Price":', regexp_replace(cast(o_totalprice as varchar), '\\.0$', ''), ',"At":"', strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ'), '","Text":"', o_orderpriority, '","Raw":"', to_base64(o_orderpriority::blob), '","None":null,"List":["', o_orderstatus, '",null]}') as text from orders""")
def canonical_text(spark, d):
    """JSON text of floats, times, texts, bytes, nulls and lists."""
    kind = T.StructType([T.StructField("Price", T.DoubleType()), T.StructField("At", T.TimestampType()), T.StructField("Text", T.StringType()), T.StructField("Raw", T.BinaryType()), T.StructField("None", T.LongType()), T.StructField("List", T.ArrayType(T.StringType()))])
    values = (F.col("o_totalprice"), F.col("o_orderdate").cast("timestamp"), F.col("o_orderpriority"), F.col("o_orderpriority").cast("binary"), F.lit(None).cast("long"), F.array("o_orderstatus", F.lit(None).cast("string")))
    rows = _table(spark, d, "orders").select("o_orderkey", F.struct(*[v.alias(f.name) for v, f in zip(values, kind.fields)]).alias("v"))
    return rows.select(F.col("o_orderkey").alias("key"), canon.json_text(F.col("v"), kind).alias("text"))


@_query("""select id, version, concat_ws(':', entity_type, entity_id, version) as cached, concat_ws('/', entity_type, entity_id, version) as cold, case strategy when 0 then 'full' when 1 then 'delta' when 2 then 'hybrid' else 'unknown' end as strategy, count(*) as copies from audit_versions group by all""")
def record_keys(spark, d):
    key = [F.col(c) for c in ("entity_type", "entity_id", "version")]
    rows = _table(spark, d, "audit_versions").select("id", "version", cache_key(*key).alias("cached"), cold_key(*key).alias("cold"), strategy_name(F.col("strategy")).alias("strategy"))
    return rows.groupBy("id", "version", "cached", "cold", "strategy").agg(F.count("*").alias("copies"))


@_query("""select id, coalesce(metadata.actor_id, '') as actor_id, coalesce(metadata.reason, '') as reason, coalesce(len(delta), 0) as changes, coalesce(epoch_us(metadata.timestamp), -1) as at_us, coalesce(cardinality(metadata.custom), 0)::integer as customs, count(*) as copies from audit_versions group by all""")
def flat_rows(spark, d):
    """Records written as rows of a flat table, metadata and delta as JSON, and read back."""
    back = decode(encode(_table(spark, d, "audit_versions")))
    rows = back.select("id", F.coalesce("metadata.actor_id", F.lit("")).alias("actor_id"), F.coalesce("metadata.reason", F.lit("")).alias("reason"), F.coalesce(F.size("delta"), F.lit(0)).cast("long").alias("changes"), F.coalesce(F.unix_micros("metadata.timestamp"), F.lit(-1)).alias("at_us"), F.coalesce(F.size("metadata.custom"), F.lit(0)).alias("customs"))
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))


@_query(f"""with {_U} select id, case when version % 9 = 0 or version % 9 = 1 then 'validation: empty entity id' when version % 9 = 2 then 'configuration: no state' end as error from u where version % 9 < 3""")
def invalid_rejects(spark, d):
    n = F.col("version") % 9
    rows = users(spark, d).select("id", F.when(n == 0, " ").when(n != 1, F.col("entity_id")).alias("entity_id"), F.when(n != 2, F.col("state")).alias("state"))
    return versioning.reject_invalid(rows)[1].select("id", "error")


@_query(f"""with {_U} select id, actor_id, case when actor_type = 'system' then 'system' when actor_type = 'service' then 'service' else 'human' end as actor_type, case when k % 3 = 0 then id else concat('c-', entity_id) end as correlation_id, tenant_id as trace_id, '' as span_id, 'grpc' as source from u""")
def grpc_metadata(spark, d):
    pairs = F.create_map(
        F.lit("x-actor-id"), F.array("actor_id", F.lit("second")), F.lit("x-actor-type"), F.array("actor_type"), F.lit("x-correlation-id"), F.array(F.when(F.col("k") % 3 == 0, "").otherwise(F.concat(F.lit("c-"), F.col("entity_id")))),
        F.lit("x-request-id"), F.array("id"), F.lit("x-trace-id"), F.array("tenant_id"), F.lit("x-span-id"), F.array().cast("array<string>"),
    )
    return users(spark, d).select("id", metadata.from_grpc(pairs).alias("m")).select("id", "m.actor_id", "m.actor_type", "m.correlation_id", "m.trace_id", "m.span_id", "m.source")


@_query(f"""with {_U} select entity_id, version, concat('{{"Cents":', cast(cents as varchar), ',"ID":"', entity_id, '","K":', cast(k as varchar), ',"Status":"[REDACTED]"}}') as data from u""")
def redact_field(spark, d):
    return redact.redact_field(users(spark, d).select("entity_id", "version", "data"), "Status")


@_query(f"""with {_U}, {_CHANGED} select entity_id, version, path, case when path = 'Status' then '"[REDACTED]"' else old_value end as old_value, case when path = 'Status' then '"[REDACTED]"' else new_value end as new_value from ch""")
def redact_deltas(spark, d):
    """Redaction reaches the changes that deltas hold."""
    rows = diff.history_changes(users(spark, d), USER).select("entity_id", "version", "data", "delta")
    return diff.explode_changes(redact.redact_field(rows, "Status"), "entity_id", "version").drop("position")


@_query(f"""with {_U} select id, case when lower(concat('X-Auth-', actor_type)) like '%auth%' then '[REDACTED]' end as auth, tenant_id as tenant, '[REDACTED]' as api, status as note from u""")
def sanitize_metadata(spark, d):
    custom = F.create_map(F.concat(F.lit("X-Auth-"), F.col("actor_type")), F.col("actor_id"), F.lit("tenant_id"), F.col("tenant_id"), F.lit("My_API_KEY"), F.col("id"), F.lit("note"), F.col("status"))
    rows = users(spark, d).withColumn("c", metadata.sanitize(custom))
    return rows.select("id", F.element_at("c", F.concat(F.lit("X-Auth-"), F.col("actor_type"))).alias("auth"), F.element_at("c", "tenant_id").alias("tenant"), F.element_at("c", "My_API_KEY").alias("api"), F.element_at("c", "note").alias("note"))


@_query(f"""with {_U}, t as (select *, concat('00-', md5(id), '-', substr(md5(entity_id), 1, 16), '-01') as tp from u)
  select id, case when k % 5 = 0 then '' else substr(tp, 4, 32) end as trace_id, case when k % 5 = 0 then '' else substr(tp, 37, 16) end as span_id,
    case when k % 2 = 0 then id else concat('req-', entity_id) end as correlation_id, actor_id, case when k % 4 = 1 then 'human' else actor_type end as actor_type, 'http' as source from t""")
def traceparent_parse(spark, d):
    tp = F.concat(F.lit("00-"), F.md5("id"), F.lit("-"), F.substring(F.md5("entity_id"), 1, 16), F.lit("-01"))
    headers = F.create_map(
        F.lit("x-actor-id"), F.col("actor_id"), F.lit("X-ACTOR-TYPE"), F.when(F.col("k") % 4 == 1, "robot").otherwise(F.col("actor_type")), F.lit("X-Correlation-ID"), F.when(F.col("k") % 2 == 0, F.col("id")).otherwise(""),
        F.lit("X-Request-Id"), F.concat(F.lit("req-"), F.col("entity_id")), F.lit("Traceparent"), F.when(F.col("k") % 5 == 0, "00-short").otherwise(tp),
    )
    return users(spark, d).select("id", metadata.from_http(headers).alias("m")).select("id", "m.trace_id", "m.span_id", "m.correlation_id", "m.actor_id", "m.actor_type", "m.source")


@_query("select distinct on (id) id, entity_id, 'entity too large' as error from audit_versions where strlen(data) > 300 order by id")
def guardrail_rejects(spark, d):
    rows = _table(spark, d, "audit_versions").select("id", "entity_id", "data").dropDuplicates(["id", "data"])
    return guardrails.split_by_size(rows, max_entity=300)[1].select("id", "entity_id", "error").dropDuplicates(["id"])


@_query(f"""with {_U} select id, 'me' as actor_id, 'service' as actor_type, 'nightly' as reason, 'c-1' as correlation_id, 'acme' as tenant_id, 'last' as twice, epoch_us(created_at) as at_us from u""")
def context_metadata(spark, d):
    """A request's context stamped on a batch: NUL bytes go, of custom entries with one name the last stays."""
    context = metadata.Context().actor("m\0e", "service").reason("nightly").correlation("c-1").custom(twice="first").custom(twice="last").tenant("acme")
    rows = users(spark, d).select("id", context.metadata(F.col("created_at")).alias("m"))
    return rows.select("id", "m.actor_id", "m.actor_type", "m.reason", "m.correlation_id", F.element_at("m.custom", "tenant_id").alias("tenant_id"), F.element_at("m.custom", "twice").alias("twice"), F.unix_micros("m.timestamp").alias("at_us"))


@_query(f"with {_U} select id, status from u where status <> 'error' and k % 2 = 0")
def hooked_reads(spark, d):
    """Hooks before reads, in order: one narrows, one only looks, one narrows what the first left."""
    hooks, seen = Hooks(), []
    hooks.before_read(lambda df: df.where("status <> 'error'"))
    hooks.before_read(lambda df: seen.append(df.columns))
    hooks.before_read(lambda df: df.where("k % 2 = 0"))
    return hooks.reading(users(spark, d)).select("id", "status")


@_query("select id, version, json_extract_string(data, '$.ID') as entity, len(json_keys(data)) as members, count(*) as copies from audit_versions where json_valid(data) and json_type(data) = 'OBJECT' group by all")
def msgpack_payloads(spark, d):
    """Payloads as MessagePack and back."""
    rows = _table(spark, d, "audit_versions").withColumn("data", msgpack.from_msgpack(msgpack.to_msgpack("data"))).where("json_object_keys(data) is not null")
    return rows.groupBy("id", "version", F.get_json_object("data", "$.ID").alias("entity"), F.size(F.json_object_keys("data")).cast("long").alias("members")).agg(F.count("*").alias("copies"))


@_query("select id, version, sha256(concat_ws(chr(0), entity_type, entity_id, cast(version as varchar))) as made, count(*) as copies from audit_versions group by all")
def record_ids(spark, d):
    rows = _table(spark, d, "audit_versions").select("id", "version", record_id(F.col("entity_type"), F.col("entity_id"), F.col("version")).alias("made"))
    return rows.groupBy("id", "version", "made").agg(F.count("*").alias("copies"))


@_query(f"""with {_U} select entity_id, version, concat('{{"Cents":"[REDACTED]","ID":"', entity_id, '","K":', cast(k as varchar), ',"Status":"[REDACTED]"}}') as data from u""")
def redact_flagged(spark, d):
    """All fields that the registered type flags as redactable."""
    registry = Registry()
    kind = registry.register("user", T.StructType([tagged("ID", T.StringType(), "id"), tagged("Status", T.StringType(), "tracked,redactable"), tagged("Cents", T.LongType(), "redactable"), tagged("K", T.LongType(), "tracked")]))
    rows = users(spark, d).select("entity_id", "version", "data")
    for path in kind.paths("redactable"):
        rows = redact.redact_field(rows, path)
    return rows


# lifecycle


@_query("""select entity_type, count(*) as deleted from audit_versions where entity_type in ('orderentity', 'userentity') and created_at < timestamptz '2024-07-01 00:00:00+00' - case entity_type when 'orderentity' then interval 365 day else interval 30 day end group by 1""")
def retention_counts(spark, d):
    return lifecycle.retain(_table(spark, d, "audit_versions").select("entity_type", "created_at"), {"orderentity": 365, "userentity": 30, "company": 0}, NOW)[1]


@_query(f"""with {_C} select case when created_at < timestamp '1998-08-01' - interval 730 day then 'cold' when created_at < timestamp '1998-08-01' - interval 90 day then 'warm' else 'hot' end as tier, entity_type, count(*) as records, sum(cents) as cents from c group by all""")
def tier_files(spark, d):
    """Records written by tier and type, and read back by folder."""
    at = new_path(spark, "tiers")
    lifecycle.write_tiers(customers(spark, d).select("id", "entity_type", "created_at", "cents"), at, "1998-08-01 00:00:00")
    return spark.read.parquet(at).groupBy("tier", "entity_type").agg(F.count("*").alias("records"), F.sum("cents").alias("cents"))


@_query("""select id, version, entity_type, coalesce(case entity_type when 'orderentity' then created_at < timestamptz '2024-07-01 00:00:00+00' - interval 365 day when 'userentity' then created_at < timestamptz '2024-07-01 00:00:00+00' - interval 30 day end, false) as expired,
  count(*) as copies from audit_versions group by all""")
def retention_split(spark, d):
    rows = lifecycle.retention_split(_table(spark, d, "audit_versions").select("id", "version", "entity_type", "created_at"), {"orderentity": 365, "userentity": 30, "company": 0}, NOW)
    return rows.groupBy("id", "version", "entity_type", "expired").agg(F.count("*").alias("copies"))


@_query(f"""with {_C} select id, case when created_at < timestamp '1998-08-01' - interval 730 day then 'cold' when created_at < timestamp '1998-08-01' - interval 90 day then 'warm' else 'hot' end as tier from c""")
def tier_assignment(spark, d):
    return lifecycle.tier_assignment(customers(spark, d).select("id", "created_at"), "1998-08-01 00:00:00").select("id", "tier")


@_query("select distinct on (entity_type, entity_id, version) entity_type, entity_id, version, id from audit_versions_olap order by entity_type, entity_id, version, created_at desc, id desc")
def olap_dedup_latest(spark, d):
    rows = _table(spark, d, "audit_versions_olap").select("entity_type", "entity_id", "version", "id", "created_at")
    return lifecycle.merge_superseded(rows).drop("created_at")


@_query(f"with {_U} select id from u where not exists (select 1 from events e where concat('ev-', cast(e.event_id as varchar)) = u.id and e.event_id % 3 <> 0)")
def wal_unacked(spark, d):
    acks = _table(spark, d, "events").where("event_id % 3 <> 0").select(F.concat(F.lit("ev-"), _text("event_id")).alias("id"))
    return wal.unacknowledged(users(spark, d).select("id", "created_at"), acks).select("id")


@_query("select concat('n-', n_nationkey) as id, n_name as name, cast(n_regionkey as bigint) as region from nation where n_nationkey % 3 <> 0")
def wal_files(spark, d):
    """A log file of frames, one damaged and the last cut off, and its acknowledgements: what is open is replayed."""
    rows = _table(spark, d, "nation").orderBy("n_nationkey").collect()  # a fixed table
    frames = [wal.frame({"id": f"n-{r.n_nationkey}", "record": {"name": r.n_name, "region": r.n_regionkey}, "created_at": "t"}) for r in rows]
    damaged = bytearray(wal.frame({"id": "damaged", "record": {}}))
    damaged[-1] ^= 1
    at = new_path(spark, "frames")
    write_bytes(spark, f"{at}/1.wal", b"".join(frames[:9]) + bytes(damaged) + b"".join(frames[9:]) + frames[0][:-3])
    write_bytes(spark, f"{at}/acks", "".join(f"n-{r.n_nationkey}\n" for r in rows if r.n_nationkey % 3 == 0).encode())
    left = wal.unacknowledged(wal.read_files(spark, f"{at}/*.wal"), wal.read_acks(spark, f"{at}/acks"))
    return left.select("id", F.get_json_object("record", "$.name").alias("name"), F.get_json_object("record", "$.region").cast("long").alias("region"))


@_query(f"""with {_U}, e as (select * from u where substr(id, 4)::bigint % 3 = 0) select case when version <= 30 then 'skipped' else 'replayed' end as outcome, count(*) as entries from e group by 1""")
def wal_recover_counts(spark, d):
    rows = users(spark, d).select("id", "entity_type", "entity_id", "version")
    return wal.recover_counts(rows.where("cast(substring(id, 4) as long) % 3 = 0"), rows.where("version <= 30"))


@_query(f"""with {_U} select id, 3 as schema_version, case when version % 3 = 0 then data when version % 3 = 1 then replace(replace(data, '"Status":', '"State":'), '"Cents":', '"Amount":') else replace(data, '"Cents":', '"Amount":') end as data from u""")
def migrate_v1_to_v3(spark, d):
    steps = Migrations()
    steps.register("user", 1, 2, lambda c: F.replace(c, F.lit('"Status":'), F.lit('"State":')))
    steps.register("user", 2, 3, lambda c: F.replace(c, F.lit('"Cents":'), F.lit('"Amount":')))
    stored = F.when(F.col("version") % 3 == 0, 3).when(F.col("version") % 3 == 1, 1).otherwise(2)
    return steps.read(users(spark, d).select("id", "entity_type", "version", stored.alias("schema_version"), "data")).select("id", "schema_version", "data")


@_query(f"with {_U} select id from u where substr(id, 4)::bigint % 3 = 0")
def wal_table_replay(spark, d):
    """A staging-table log: entries in two appends, acknowledgements in one, what is open is replayed."""
    log = wal.TableLog(spark, new_path(spark, "log"))
    rows = users(spark, d).select("id", F.to_json(F.struct("entity_id", "version")).alias("record"), F.col("created_at").cast("string").alias("created_at"))
    log.append(rows.where("version % 2 = 0"))
    log.append(rows.where("version % 2 = 1"))
    log.ack(rows.where("cast(substring(id, 4) as long) % 3 <> 0"))
    return log.replay().select("id")


@_query(f"""with {_U} select entity_id, version, data from u where version in (1, 20)""")
def cold_reads(spark, d):
    """Payloads archived by key come back as they went."""
    cold = ColdStore(spark, new_path(spark, "cold"))
    rows = users(spark, d)
    cold.put(rows.select("entity_type", "entity_id", "version", "data"))
    return cold.read().where("version in (1, 20)").select("entity_id", "version", "data")


@_query(f"""with {_U} select entity_id, version, case when version % 5 = 0 then 'analytics' else 'main' end as tier from u""")
def tiers_union(spark, d):
    """One view over two stores that overlap: a version that both hold comes from the main one."""
    rows = users(spark, d).select("id", "entity_type", "entity_id", "version", "created_at")
    main, olap = VersionStore(spark, new_path(spark, "main")), VersionStore(spark, new_path(spark, "olap"))
    main.append(rows.where("version % 5 <> 0").withColumn("data", F.lit("main")))
    olap.append(rows.where("version % 5 = 0 or version % 2 = 0").withColumn("data", F.lit("analytics")))
    return Router(main, olap).read().select("entity_id", "version", F.col("data").alias("tier"))


@_query(f"""with {_U} select entity_id, version, case when version % 4 = 1 then 'changed' else data end as data from u where version % 7 <> 0""")
def store_writes(spark, d):
    """Appends that repeat records, an update and a deletion, each of which writes only what it touches."""
    store = VersionStore(spark, new_path(spark, "store"))
    rows = users(spark, d).select("id", "entity_type", "entity_id", "version", "created_at", "data")
    store.append(rows.where("version <= 40"))
    store.append(rows.where("version > 30").withColumn("data", F.when(F.col("version") <= 40, "again").otherwise(F.col("data"))))
    store.update(rows.where("version % 4 = 1").withColumn("data", F.lit("changed")), ("data",))
    store.delete(F.col("version") % 7 == 0)
    return store.read().select("entity_id", "version", "data")


# analytics


@_query("select strftime(created_at at time zone 'UTC', '%Y-%m-%d') as day, entity_type, count(*) as changes from audit_versions group by all")
def changes_per_day(spark, d):
    return analytics.changes_per_day(_table(spark, d, "audit_versions"), ["entity_type"])


@_query("select metadata.actor_id as actor_id, count(*) as changes, min(epoch_us(created_at)) as first_us, max(epoch_us(created_at)) as last_us from audit_versions group by 1")
def changes_by_actor(spark, d):
    return analytics.changes_by_actor(_table(spark, d, "audit_versions")).select("actor_id", "changes", F.unix_micros("first_at").alias("first_us"), F.unix_micros("last_at").alias("last_us"))


@_query("select entity_type, count(distinct entity_id) as entities from audit_versions group by 1")
def distinct_entities(spark, d):
    return analytics.distinct_entities(_table(spark, d, "audit_versions"), "entity_type")


@_query("select entity_type, cast(strategy as integer) as strategy, metadata.source as source, count(*) as changes, cast(grouping(entity_type) + grouping(strategy) + grouping(metadata.source) as integer) as level from audit_versions group by rollup (entity_type, strategy, metadata.source)")
def changes_rollup(spark, d):
    rows = _table(spark, d, "audit_versions").select("entity_type", F.col("strategy").cast("int").alias("strategy"), F.col("metadata.source").alias("source"))
    return analytics.changes_rollup(rows, "entity_type", "strategy", "source")


@_query("select entity_type, metadata.source as source, count(*) as changes, cast(grouping_id(entity_type, metadata.source) as bigint) as grouping_id from audit_versions group by cube (entity_type, metadata.source)")
def changes_cube(spark, d):
    rows = _table(spark, d, "audit_versions").select("entity_type", F.col("metadata.source").alias("source"))
    return analytics.changes_cube(rows, "entity_type", "source")


@_query("""with w as (select event_type, unnest([time_bucket(interval 30 minute, ts), time_bucket(interval 30 minute, ts) - interval 30 minute]) as s from events)
  select event_type, epoch_us(s) as from_us, count(*) as changes from w group by all""")
def sliding_windows(spark, d):
    out = versioner.change_windows(_table(spark, d, "events"), "ts", "1 hour", "30 minutes", by=["event_type"])
    return out.select("event_type", F.unix_micros("window_start").alias("from_us"), "changes")


@_query("""with g as (select user_id, ts, case when ts - lag(ts) over w < interval 6 hour then 0 else 1 end as begins from events window w as (partition by user_id order by ts)),
  s as (select *, sum(begins) over (partition by user_id order by ts rows unbounded preceding) as n from g)
  select user_id, epoch_us(min(ts)) as from_us, epoch_us(max(ts) + interval 6 hour) as to_us, count(*) as changes from s group by user_id, n""")
def change_sessions(spark, d):
    out = versioner.sessions(_table(spark, d, "events"), "ts", "6 hours", ["user_id"])
    return out.select("user_id", F.unix_micros("session_start").alias("from_us"), F.unix_micros("session_end").alias("to_us"), "changes")


# streams


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The table's files as a stream."""
    rows = _table(spark, d, name)
    return spark.readStream.schema(rows.schema).option("pathGlobFilter", "*.parquet").parquet(_as_glob(spark, d, name))


def _as_glob(spark: SparkSession, d: str, name: str) -> str:
    """The table's path as a glob: a stream reads folders, and the table may be one file."""
    return f"{d}/{name}.parquet*"


def _drain(spark: SparkSession, out: DataFrame, mode: str = "append") -> DataFrame:
    at = new_path(spark, "stream")
    out.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/log").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/rows")


_STREAMED = f"""{_U}, x as (select *, lag(data) over (partition by entity_id order by created_at, id) as before from u), v as (select * replace (cast(row_number() over (partition by entity_id order by created_at, id) as bigint) as version) from x where before is null or before <> data)"""


@_query(f"""with recursive {_STREAMED}, {_CHANGED.replace('from u window', 'from v window')}, n as (select entity_id, version, count(*) as n from ch group by all),
  h as (select entity_id, id, version, sha256(concat('{{"entity_type":"user","entity_id":"', entity_id, '","version":1,"data":"', to_base64(data::blob), '","previous_hash":""}}')) as hash, '' as previous_hash from v where version = 1
  union all select v.entity_id, v.id, v.version, sha256(concat('{{"entity_type":"user","entity_id":"', v.entity_id, '","version":', cast(v.version as varchar), ',"data":"', to_base64(v.data::blob), '","previous_hash":"', h.hash, '"}}')), h.hash
  from h join v on v.entity_id = h.entity_id and v.version = h.version + 1)
  select h.entity_id, h.id, h.version, case when h.version % 10 = 1 then 0 else 1 end as strategy, case when h.version % 10 = 1 then 0 else coalesce(n, 0) end as changes, hash, previous_hash from h left join n using (entity_id, version)""")
def stream_versions(spark, d):
    """Stateful versioning of the event stream: numbers, strategies, deltas and hash chain are those of the batch."""
    e = _stream(spark, d, "events")
    cents = _text(F.round(F.col("value") * 100).cast("long"))
    data = F.concat(F.lit('{"ID":"'), _text("user_id"), F.lit('","Status":"'), F.col("event_type"), F.lit('","Cents":'), cents, F.lit(',"K":'), F.regexp_extract("props", "([0-9]+)", 1), F.lit("}"))
    states = e.select(F.lit("user").alias("entity_type"), _text("user_id").alias("entity_id"), F.concat(F.lit("ev-"), _text("event_id")).alias("id"), data.alias("data"), F.col("ts").cast("timestamp").alias("created_at"))
    out = _drain(spark, versioner.version_stream(states, USER))
    return out.select("entity_id", "id", "version", F.col("strategy").cast("int").alias("strategy"), F.coalesce(F.size("delta"), F.lit(0)).cast("long").alias("changes"), "hash", "previous_hash")


@_query("""with w as (select event_type, time_bucket(interval 1 hour, ts) as s, count(*) as changes, max(ts) as m from events group by all)
  select event_type, strftime(s, '%Y-%m-%d %H') as hour, changes from w where s + interval 1 hour <= (select max(ts) - interval 10 minute from events)""")
def stream_change_windows(spark, d):
    """Tumbling windows of the stream; windows that the watermark hasn't passed are not out yet."""
    out = versioner.change_windows(_stream(spark, d, "events"), "ts", "1 hour", by=["event_type"])
    return _drain(spark, out).select("event_type", F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "changes")
