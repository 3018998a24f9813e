"""Tables in which one id, one entity or one event holds a third of all rows, against the SQL twins."""

import duckdb
import pytest

import __spark_entry__ as entry

HOT_VERSIONS = """copy (with x as (select *, dense_rank() over (order by id) as n, dense_rank() over (order by created_at, id) as v from '{source}')
  select * exclude (n, v) replace (case when n % 3 = 0 then 'hot' else id end as id, case when n % 3 = 1 then 'flatentity' else entity_type end as entity_type, case when n % 3 = 1 then 'hot' else entity_id end as entity_id,
    case when n % 3 = 1 then n else version end as version, case when n % 3 = 0 then created_at + to_microseconds(v) else created_at end as created_at) from x) to '{target}' (row_group_size 2048)"""
HOT_FEED = """copy (with x as (select *, row_number() over (order by feed_id) as n from '{source}')
  select * exclude (n) replace (case when n % 3 = 0 then 'event' when n % 3 = 1 then 'entity' else entity_id end as entity_id, case when n % 3 < 2 then 'userentity' else entity_type end as entity_type,
    case when n % 3 = 0 then 7 else version end as version, case when n % 3 = 0 then 1 else change_seq end as change_seq) from x) to '{target}' (row_group_size 2048)"""


@pytest.fixture(scope="module")
def hot(tmp_path_factory, data):
    at, c = tmp_path_factory.mktemp("hot"), duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for table, sql in (("audit_versions", HOT_VERSIONS), ("audit_versions_olap", HOT_VERSIONS), ("field_changes", HOT_FEED)):
        c.execute(sql.format(source=f"{data.replace('sf0.001', 'sf0.01')}/{table}.parquet", target=f"{at}/{table}.parquet"))
        c.execute(f"create view {table} as select * from '{at}/{table}.parquet'")
    return at, c


@pytest.mark.parametrize("name", ["p1_found", "p1_presence", "p2_found", "p3_found", "p4_found", "p5_found", "p6_found"])
def test_a_third_of_the_rows(name, spark, hot):
    at, c = hot
    df = entry.queries()[name](spark, str(at))
    columns = sorted(df.columns)
    result = c.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    want = sorted(repr(tuple(r[names.index(x)] for x in columns)) for r in result.fetchall())
    assert sorted(repr(tuple(r[x] for x in columns)) for r in df.collect()) == want and want
