"""The queries of problems 1 to 6 over the tables of a directory, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import change_feed, differences, history, nested, orphans, schema_drift
from palimpsest.operators.current import normal_hash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _versions(spark, d):
    return table(spark, d, "audit_versions")


def _olap(spark, d):
    return table(spark, d, "audit_versions_olap")


ITEMS = "Items"  # may be an array, its JSON text or, for one element, the bare object
CLOSED = ("Tags", "Settings", "Nested", "Items")  # members whose inside is data, not schema


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return differences.compare_copies(_versions(spark, d), _olap(spark, d), scalars={"hash": lambda df: normal_hash("hash")})


def p1_presence(spark: SparkSession, d: str) -> DataFrame:
    return differences.presence(_versions(spark, d), _olap(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.drift_report(_versions(spark, d), closed=CLOSED)


def p2_unified(spark: SparkSession, d: str) -> DataFrame:
    df = _versions(spark, d)
    return schema_drift.unify(df, schema_drift.edit_scripts(df, closed=CLOSED), CLOSED)


def p2_users(spark: SparkSession, d: str) -> DataFrame:
    """All records of one type in one typed table, whatever their schema_version.

    Its columns id and ID differ in letter case only, so the session tells such names apart from here on; otherwise Spark
    neither writes nor reads the table.
    """
    df = _versions(spark, d)
    spark.conf.set("spark.sql.caseSensitive", "true")
    columns = {"ID": "string", "Name": "string", "EmailAddress": "string", "Address.City": "string", "Address.Postcode": "string", "Quota": "bigint", "Locale": "string"}
    return schema_drift.unified_table(df, schema_drift.edit_scripts(df, closed=CLOSED), "userentity", columns, CLOSED)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.subtypes(_versions(spark, d), ITEMS).rows.select(*nested.KEYS)


def p3_variants(spark: SparkSession, d: str) -> DataFrame:
    return nested.variants(nested.subtypes(_versions(spark, d), ITEMS).rows)


def p3_shapes(spark: SparkSession, d: str) -> DataFrame:
    """How many nodes of each place have which members of which kinds."""
    rows = nested.subtypes(_versions(spark, d), ITEMS).rows
    return rows.groupBy("supertype", "shape").agg(F.count("*").alias("n"))


def p3_order_items(spark: SparkSession, d: str) -> DataFrame:
    """The items of orders, from their typed tables and, for forms without one, from the table of JSON text."""
    return nested.subtypes(_versions(spark, d), ITEMS).members("data.Items[]", {"SKU": "string", "Quantity": "bigint", "Price": "double"})


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return change_feed.apply_feed(table(spark, d, "field_changes"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return history.history(_versions(spark, d), ("orderentity", "fixtureaddress", "flatentity"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references({"audit_versions": _versions(spark, d), "audit_versions_olap": _olap(spark, d)})


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return p6_found(spark, d).groupBy("table_name", "month", "reason").count().withColumnRenamed("count", "n")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_presence, p2_found, p2_unified, p2_users, p3_found, p3_variants, p3_shapes, p3_order_items, p4_found, p5_found, p6_found, p6_report)
}

_ORPHANS = """with t as (
  select 'audit_versions' as table_name, id, entity_type, entity_id, version, hash, previous_hash, created_at from audit_versions
  union all select 'audit_versions_olap', id, entity_type, entity_id, version, hash, previous_hash, created_at from audit_versions_olap),
cur as (select distinct on (table_name, id) table_name, id, entity_type, entity_id, version, created_at,
  nullif(lower(trim(hash, E' \\t\\r\\n')), '') as h, nullif(lower(trim(previous_hash, E' \\t\\r\\n')), '') as p from t order by table_name, id, created_at desc),
j as (select r.table_name, r.id, r.created_at, count(q.id) as found, count(q.id) filter (q.version = r.version - 1) as placed,
    min(q.created_at) filter (q.version = r.version - 1) as earliest
  from cur r left join cur q on q.table_name = r.table_name and q.entity_type = r.entity_type and q.entity_id = r.entity_id and q.h = r.p
  where r.p is not null group by all),
found as (select table_name, id, case when found = 0 then 'missing' when placed = 0 then 'misplaced' when earliest > created_at then 'later' end as reason,
  strftime(created_at at time zone 'UTC', '%Y-%m') as month from j)
"""

#: A scalar of a JSON tree by its value.
_ATOM = "concat(j.fullkey, ' ', case when j.type in ('DOUBLE', 'BIGINT', 'UBIGINT') then 'NUMBER ' || cast(cast(j.atom as double) as varchar) else j.type || ' ' || coalesce(cast(j.atom as varchar), '') end)"

_DIFFERENCES = f"""with a as (select distinct on (id) id, hash, data from audit_versions order by id, created_at desc),
b as (select distinct on (id) id, hash, data from audit_versions_olap order by id, created_at desc),
unlike as (select a.id, a.data as x, b.data as y from a join b on a.id = b.id where a.data is distinct from b.data),
both_sides as (select 0 as side, id, x as data from unlike union all select 1, id, y from unlike),
n as (select side, both_sides.id, regexp_replace(j.fullkey, '\\[.*$', '') as p, max(j.type) filter (not contains(j.fullkey, '[')) as kind, max(j.path) filter (not contains(j.fullkey, '[')) as up, string_agg({_ATOM}, chr(1) order by j.fullkey) as sig
  from both_sides, json_tree(both_sides.data) j where coalesce(trim(data), '') not in ('', 'null') group by all),
l as (select * from n where side = 0 and p <> '$'), r as (select * from n where side = 1 and p <> '$'),
m as (select coalesce(l.id, r.id) as id, coalesce(l.p, r.p) as p, coalesce(l.up, r.up) as up, l.kind as lk, r.kind as rk, l.sig as ls, r.sig as rs from l full join r on l.id = r.id and l.p = r.p),
c as (select * from m where not (lk is not null and rk is not null) or (not (lk = 'OBJECT' and rk = 'OBJECT') and ls <> rs))
select a.id, 'only_primary' as finding from a anti join b on a.id = b.id
union all select b.id, 'only_olap' from b anti join a on a.id = b.id
union all select a.id, 'hash' from a join b on a.id = b.id where coalesce(lower(trim(a.hash)), '') <> coalesce(lower(trim(b.hash)), '')
union all select c.id, replace('data' || substr(c.p, 2), '"', '') from c left join m u on u.id = c.id and u.p = c.up
  where (c.lk is not null and c.rk is not null) or c.up = '$' or (u.lk = 'OBJECT' and u.rk = 'OBJECT')"""

_NODES = """with cur as (select distinct on (id) id, data, metadata.custom as custom from audit_versions order by id, created_at desc),
roots as (select id, 'data' as root, data as j from cur where json_valid(data)
  union all select id, 'custom.' || e.key, e.value from (select id, unnest(map_entries(custom)) as e from cur) where json_valid(e.value)),
fixed as (select id, root, case when root = 'data' and json_type(j, '$.Items') = 'OBJECT' then cast(json_merge_patch(j, json_object('Items', json_array(json_extract(j, '$.Items')))) as varchar)
  when root = 'data' and json_type(j, '$.Items') = 'VARCHAR' and json_valid(json_extract_string(j, '$.Items')) then cast(json_merge_patch(j, json_object('Items', json(json_extract_string(j, '$.Items')))) as varchar) else j end as j from roots),
nodes as (select fixed.id, replace(fixed.root || substr(t.fullkey, 2), '"', '') as node_path from fixed, json_tree(fixed.j) t where t.type = 'OBJECT' and t.fullkey like '%]')
"""

_HISTORY = f"""with cur as (select distinct on (id) id, entity_type, entity_id, version, data, created_at from audit_versions order by id, created_at desc),
v as (select * from cur where entity_type in ('orderentity', 'fixtureaddress', 'flatentity') qualify row_number() over (partition by entity_type, entity_id, version order by created_at desc, id desc) = 1),
t as (select * from v qualify row_number() over (partition by entity_type, entity_id, created_at order by version desc) = 1),
sig as (select t.id, string_agg({_ATOM}, chr(1) order by j.fullkey) as s from t, json_tree(t.data) j where coalesce(trim(data), '') not in ('', 'null') group by 1),
s as (select t.*, sig.s as state from t left join sig using (id)),
g as (select *, lag(state) over (partition by entity_type, entity_id order by created_at) as before from s),
b as (select *, lead(created_at) over (partition by entity_type, entity_id order by created_at) as following from g where state is distinct from before)
select entity_type, entity_id, version as first_version, epoch_us(created_at) as valid_from_us, coalesce(epoch_us(following), -1) as valid_to_us from b where state is not null"""

#: Values by sequence; a later event at or above a path ends what was there, a later set below it makes it an object.
_FEED = """with best as (select distinct on (entity_type, entity_id, version, change_seq) *, version::hugeint * 4294967296 + change_seq as q, coalesce(strategy, case when coalesce(path, '') = '' then 0 else 1 end) as st from field_changes
  order by entity_type, entity_id, version, change_seq, received_at desc, feed_id desc),
w as (select distinct on (entity_type, entity_id) entity_type, entity_id, q, new_value from best where st = 0 order by entity_type, entity_id, q desc),
e as (select b.entity_type, b.entity_id, b.q, b.path, b.new_value from best b join w using (entity_type, entity_id) where b.st <> 0 and b.q > w.q and w.new_value is not null),
v as (select entity_type, entity_id, q, '' as base, new_value from w where new_value is not null union all select entity_type, entity_id, q, path, new_value from e where new_value is not null),
n as (select v.entity_type, v.entity_id, v.q, ltrim(base || replace(substr(j.fullkey, 2), '"', ''), '.') as path, j.type, cast(j.value as varchar) as text from v, json_tree(v.new_value) j where not contains(j.fullkey, '[')),
o as (select entity_type, entity_id, q, path from n where type = 'OBJECT'
  union all select entity_type, entity_id, q, array_to_string(string_split(path, '.')[:k], '.') from (select *, unnest(range(len(string_split(path, '.')))) as k from e where new_value is not null)),
leaves as (select * from n l where type <> 'OBJECT' and not exists (select 1 from e where e.entity_type = l.entity_type and e.entity_id = l.entity_id and e.q > l.q
  and (e.path = l.path or starts_with(l.path, e.path || '.') or (e.new_value is not null and (l.path = '' or starts_with(e.path, l.path || '.')))))),
objects as (select distinct entity_type, entity_id, path from o where not exists (select 1 from e where e.entity_type = o.entity_type and e.entity_id = o.entity_id and e.q > o.q and (e.path = o.path or starts_with(o.path, e.path || '.')))),
filled as (select entity_type, entity_id, path from leaves union all select * from objects)
select entity_type, entity_id, path, text as new_value from leaves
union all select entity_type, entity_id, path, '{}' from objects p where not exists (select 1 from filled x where x.entity_type = p.entity_type and x.entity_id = p.entity_id and x.path <> p.path and (p.path = '' or starts_with(x.path, p.path || '.')))"""

_DRIFT = f"""with cur as (select distinct on (id) * from audit_versions order by id, created_at desc), d as (select * from cur where coalesce(trim(data), '') not in ('', 'null')),
n as (select d.id, entity_type, entity_id, version, schema_version, created_at, replace(substr(j.fullkey, 3), '"', '') as path, j.fullkey as k, case j.type when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'array' when 'OBJECT' then 'object' when 'NULL' then '' else 'number' end as kind
  from d, json_tree(d.data) j where j.fullkey <> '$' and not contains(j.fullkey, '[') and not regexp_matches(j.fullkey, '[.](Tags|Settings|Nested|Items)[.]')),
total as (select entity_type, schema_version, count(*) as rows from d group by all),
f as (select entity_type, schema_version, path, any_value(rows) as rows, count(*) as c, count(*) filter (kind <> '') as known from n join total using (entity_type, schema_version) group by all having 4 * count(*) >= any_value(rows)),
kinds as (select entity_type, schema_version, path, arg_max(kind, (c, kind)) as kind from (select entity_type, schema_version, path, kind, count(*) as c from n where kind <> '' group by all) group by all),
steps as (select entity_type, lag(schema_version) over (partition by entity_type order by schema_version) as lo, schema_version as hi from total),
a as (select entity_type, hi, path from steps join f using (entity_type) where f.schema_version = lo), b as (select entity_type, hi, path from steps join f using (entity_type) where f.schema_version = hi and lo is not null),
gone as (select * from a except select * from b), fresh as (select * from b except select * from a),
one as (select distinct on (entity_type, entity_id, version) id, entity_type, entity_id, version, schema_version from d order by entity_type, entity_id, version, created_at desc, id desc),
t as (select *, lag(id) over w as before, lag(schema_version) over w as lo from one window w as (partition by entity_type, entity_id order by version)),
p as (select entity_type, before, id, lo, schema_version as hi from t where lo < schema_version and (entity_type, lo, schema_version) in (select (entity_type, lo, hi) from steps)),
atoms as (select d.id, j.fullkey, {_ATOM} as atom from d, json_tree(d.data) j where d.id in (select before from p union all select id from p)),
sig as (select n.id, n.path, string_agg(replace(atoms.atom, n.k, '$'), chr(1) order by atoms.fullkey) as sig from n join atoms on atoms.id = n.id and (atoms.fullkey = n.k or starts_with(atoms.fullkey, n.k || '.') or starts_with(atoms.fullkey, n.k || '[')) where n.kind <> '' group by all),
pairs as (select p.entity_type, p.hi, g.path as g, r.path as r, count(*) as both_there, count(*) filter (x.sig = y.sig) as same from p join gone g on g.entity_type = p.entity_type and g.hi = p.hi join fresh r on r.entity_type = p.entity_type and r.hi = p.hi
  join sig x on x.id = p.before and x.path = g.path join sig y on y.id = p.id and y.path = r.path group by all having 2 * count(*) filter (x.sig = y.sig) > count(*))
select entity_type, hi as schema_version, 'renamed' as change_kind, g as old_field, r as new_field from pairs
union all select entity_type, hi, 'removed', path, '' from gone where (entity_type, hi, path) not in (select (entity_type, hi, g) from pairs)
union all select entity_type, hi, 'added', '', path from fresh where (entity_type, hi, path) not in (select (entity_type, hi, r) from pairs)
union all select s.entity_type, s.hi, 'retyped', x.path, x.path from steps s join f x on x.entity_type = s.entity_type and x.schema_version = s.lo join f y on y.entity_type = s.entity_type and y.schema_version = s.hi and y.path = x.path
  join kinds k on k.entity_type = s.entity_type and k.schema_version = s.lo and k.path = x.path join kinds m on m.entity_type = s.entity_type and m.schema_version = s.hi and m.path = x.path where k.kind <> m.kind"""

ORACLES = {
    "p2_found": _DRIFT,
    "p4_found": _FEED,
    "p1_found": _DIFFERENCES,
    "p3_found": _NODES + "select id, node_path, regexp_extract(node_path, '^(.*\\])\\.', 1) as parent_path from nodes",
    "p3_order_items": _NODES.replace("select fixed.id, replace", "select fixed.id, t.value, replace") + """select id, node_path, '' as parent_path, cast(regexp_extract(node_path, '([0-9]+)\\]$', 1) as integer) as position, json_extract_string(value, '$.SKU') as SKU, try_cast(json_extract_string(value, '$.Quantity') as bigint) as Quantity, try_cast(json_extract_string(value, '$.Price') as double) as Price
from nodes where regexp_full_match(node_path, 'data\\.Items\\[[0-9]+\\]')""",
    "p3_shapes": _NODES.replace("select fixed.id, replace", "select fixed.id, t.value, replace") + """select regexp_replace(node_path, '\\[[0-9]+\\]', '[]', 'g') as supertype, array_to_string(list_transform(list_sort(json_keys(value)), lambda k: k || ':' ||
  case json_type(value, '$."' || k || '"') when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'array' when 'OBJECT' then 'object' when 'NULL' then 'null' else 'number' end), ',') as shape, count(*) as n from nodes group by all""",
    "p5_found": _HISTORY,
    "p1_presence": """with a as (select distinct id from audit_versions), b as (select distinct id from audit_versions_olap)
select (select count(*) from a) as n_left, (select count(*) from b) as n_right, count(*) filter (a.id is not null and b.id is not null) as n_both,
  count(*) filter (b.id is null) as n_only_left, count(*) filter (a.id is null) as n_only_right from a full join b on a.id = b.id""",
    "p2_users": """with cur as (select distinct on (id) * from audit_versions order by id, created_at desc)
select id, entity_id, version, schema_version, json_extract_string(data, '$.ID') as "ID", json_extract_string(data, '$.Name') as "Name",
  coalesce(case when schema_version < 2 then json_extract_string(data, '$.Email') end, json_extract_string(data, '$.EmailAddress')) as "EmailAddress", json_extract_string(data, '$.Address.City') as "Address_City",
  coalesce(case when schema_version < 4 then json_extract_string(data, '$.Address.ZipCode') end, json_extract_string(data, '$.Address.Postcode')) as "Address_Postcode",
  try_cast(json_extract_string(data, '$.Quota') as bigint) as "Quota", json_extract_string(data, '$.Locale') as "Locale"
from cur where entity_type = 'userentity' and coalesce(trim(data), '') not in ('', 'null')""",
    "p6_found": _ORPHANS + "select table_name, id, reason, month from found where reason is not null",
    "p6_report": _ORPHANS + "select table_name, month, reason, count(*) as n from found where reason is not null group by all",
}
