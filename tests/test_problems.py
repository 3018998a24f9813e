"""Problems 1 to 6 against plain readings of their statements, on the test tables and on hostile small ones."""

import json
from datetime import datetime, timedelta, timezone

import brute
import duckdb
import pytest
from pyspark.sql import functions as F

from palimpsest import general_queries as g
from palimpsest.model import RECORD
from palimpsest.operators import change_feed, differences, history, nested, orphans, schema_drift
from palimpsest.operators.current import normal_hash
from palimpsest.sources.scratch import current, new_path, publish, read_snapshot

HASH = {"hash": lambda df: normal_hash("hash")}
T0 = datetime(2024, 1, 1)


def utc(t):
    return t.replace(tzinfo=timezone.utc) if t and t.tzinfo is None else t


def rows(df):
    out = []
    for r in df.collect():
        r = r.asDict(recursive=True)
        for k in ("created_at", "received_at"):
            if r.get(k):
                r[k] = utc(r[k])
        out.append(r)
    return out


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def want(cases):
    return sorted(map(tuple, cases), key=str)


def record(spark, *values, **same):
    """Version records from dicts; what isn't named is null."""
    names = RECORD.fieldNames()
    schema = type(RECORD)([type(f)(f.name, f.dataType, True) for f in RECORD.fields])
    return spark.createDataFrame([tuple((same | v).get(n) for n in names) for v in values], schema).withColumns({c: F.lit("clash") for c in ("key", "side", "row", "l", "r", "period", "parent", "block", "n", "kind", "month", "piece", "late", "us", "state", "value", "_at", "_best")})


@pytest.fixture(scope="module")
def tables(spark, data):
    return {n: g.table(spark, data, n) for n in ("audit_versions", "audit_versions_olap", "field_changes")}


def test_differences_of_the_tables(tables, spark, data):
    assert got(g.p1_found(spark, data)) == want(brute.p1(rows(tables["audit_versions"]), rows(tables["audit_versions_olap"])))


def test_drift_of_the_tables(tables, spark, data):
    assert got(g.p2_found(spark, data)) == want(brute.p2(rows(tables["audit_versions"])))


def test_nodes_of_the_tables(tables, spark, data):
    assert got(g.p3_found(spark, data)) == want(brute.p3(rows(tables["audit_versions"])))


def test_state_of_the_tables(tables, spark, data):
    assert got(g.p4_found(spark, data)) == want(brute.p4(rows(tables["field_changes"])))


def test_history_of_the_tables(tables, spark, data):
    assert got(g.p5_found(spark, data)) == want(brute.p5(rows(tables["audit_versions"])))


def test_orphans_of_the_tables(tables, spark, data):
    names = ("audit_versions", "audit_versions_olap")
    assert got(g.p6_found(spark, data)) == want(x for n in names for x in brute.p6(n, rows(tables[n])))


def test_empty_tables(spark, tables):
    none = {n: t.limit(0) for n, t in tables.items()}
    a, o = none["audit_versions"], none["audit_versions_olap"]
    assert got(differences.compare_copies(a, o, scalars=HASH)) == []
    assert differences.presence(a, o).first() == (0, 0, 0, 0, 0)
    assert got(schema_drift.drift_report(a)) == [] == got(schema_drift.unify(a, {}))
    assert got(nested.nodes(a)) == []
    assert got(change_feed.apply_feed(none["field_changes"])) == []
    assert got(history.history(a)) == []
    assert got(orphans.orphan_references({"a": a, "o": o})) == []
    n = differences.compare_copies(tables["audit_versions"], o, scalars=HASH)
    assert {r.finding for r in n.collect()} == {"only_primary"}


def test_differences_of_hostile_rows(spark):
    at, later = T0, T0 + timedelta(seconds=1)
    long = json.dumps({"t": "x" * 200_000})
    left = record(
        spark, {"id": "a", "hash": " AB ", "data": '{"x":2.50,"y":{"z":[1,2]}}', "created_at": at}, {"id": "a", "hash": "zz", "data": "{}", "created_at": T0 - timedelta(1)}, {"id": "b", "data": "", "created_at": at}, {"id": "c", "data": "{cut", "created_at": at},
        {"id": "d", "data": None, "hash": "", "created_at": at}, {"id": "e", "data": long, "created_at": at}, {"id": None, "data": "{}", "created_at": None}, {"id": "f", "data": "[1]", "created_at": at}, {"id": "g", "created_at": at},
        {"id": "h", "data": '{"a.b":1}', "created_at": at}, {"id": "h", "data": '{"a.b":1}', "created_at": at}, {"id": "k", "data": '{"x":{"y":1}}', "created_at": at},
    )
    right = record(
        spark, {"id": "a", "hash": "ab", "data": '{"y":{"z":[2,1]},"x":25e-1}', "created_at": later}, {"id": "b", "data": '{"n":null}', "created_at": at}, {"id": "c", "data": "{cut", "created_at": at}, {"id": "d", "data": "null", "created_at": at},
        {"id": "e", "data": long.replace("x" * 200_000, "x" * 199_999 + "y"), "created_at": at}, {"id": None, "data": '{"q":1}'}, {"id": "f", "data": "[1.0]", "created_at": at}, {"id": "z", "created_at": None}, {"id": "h", "data": "{}", "created_at": at},
        {"id": "k", "data": '{"x":5}', "created_at": at},
    )
    assert got(differences.compare_copies(left, right, scalars=HASH)) == want([("a", "data.y.z"), ("b", "data.n"), ("e", "data.t"), (None, "data.q"), ("g", "only_primary"), ("z", "only_olap"), ("h", "data.a.b"), ("k", "data.x")])
    assert differences.presence(left, right).first() == (10, 10, 9, 1, 1)


def test_other_keys_and_names(spark):
    a = spark.createDataFrame([(1, 5, "x"), (2, 5, None)], "key long, seq int, hash string")
    b = spark.createDataFrame([(2, 5, "y"), (3, 5, "x")], "key long, seq int, hash string")
    out = differences.compare_copies(a, b, key="key", order="seq", scalars={"hash": lambda df: F.col("hash")}, documents=(), only_left="left", only_right="right")
    assert got(out) == want([(1, "left"), (2, "hash"), (3, "right")])


def test_drift_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(schema_drift, "BLOCK", 2)
    values = []
    for e in range(6):
        for v in range(1, 9):
            s = 1 if v <= 2 + e % 3 else 2
            data = {"ID": e, "Old" if s == 1 else "New": f"v{e}", "Tags": {f"k{v}": 1}, "Deep": {"In": 1 if s == 1 else "1", "Items": {"no": v}}}
            values.append({"id": f"{e}-{v}", "entity_type": "t", "entity_id": str(e), "version": v, "schema_version": s, "data": json.dumps(data), "created_at": T0 + timedelta(hours=v)})
    values.append({"id": "x", "entity_type": "t", "entity_id": "9", "version": 1, "schema_version": 1, "data": "{bad", "created_at": T0})
    values.append({"id": "y", "entity_type": None, "schema_version": None, "data": '{"a":1}', "created_at": None})
    df = record(spark, *values)
    assert got(schema_drift.drift_report(df, closed=("Tags", "Items"))) == want([("t", 2, "renamed", "Old", "New"), ("t", 2, "retyped", "Deep.In", "Deep.In")])


def test_projections_compose(spark):
    from palimpsest.plans.tree_edit import Step

    scripts = {
        ("t", 1, 2): [Step("renamed", "A", "B", 0.5), Step("moved", "P.x", "y", 0.5), Step("removed", "Gone", "", 1), Step("retyped", "N", "N", 0.5, "string"), Step("added", "", "New", 1)],
        ("t", 2, 4): [Step("moved", "B", "Q.C", 0.5), Step("retyped", "N", "N", 0.5, "number"), Step("retyped", "R", "R", 0.5, "array"), Step("removed", "New", "", 1)],
    }
    old = {"A": 1, "P": {"x": 2, "z": 3}, "Gone": {"g": 1}, "N": 5, "R": "u; v", "New": "other", "Tags": {"A": 1}}
    rows = [{"id": "1", "entity_type": "t", "version": 1, "schema_version": 1, "data": json.dumps(old)}, {"id": "2", "entity_type": "t", "version": 2, "schema_version": 2, "data": '{"B":1,"N":"x","New":7,"R":{}}'}, {"id": "3", "entity_type": "t", "schema_version": 4, "data": '{"Q":{"C":1}}'}, {"id": "4", "entity_type": "t", "schema_version": 1, "data": "[1]"}]
    out = {r.id: json.loads(r.data) for r in schema_drift.unify(record(spark, *rows), scripts, ("Tags",)).collect()}
    assert out["1"] == {"Q": {"C": 1}, "P": {"z": 3}, "y": 2, "N": 5, "R": ["u", "v"], "New": "other", "Tags": {"A": 1}, "_removed": {"Gone": {"g": 1}}}
    assert out["2"] == {"Q": {"C": 1}, "_removed": {"New": 7}, "_unconverted": {"N": "x", "R": {}}}
    assert out["3"] == {"Q": {"C": 1}} and out["4"] == [1]


def test_unified_records(spark, data):
    df = g.table(spark, data, "audit_versions")
    scripts = schema_drift.edit_scripts(df, closed=g.CLOSED)
    out = schema_drift.unify(df, scripts, g.CLOSED)
    newest = {t: max(s for u, _, s in scripts if u == t) for t, _, _ in scripts}
    have = {(t, s) for t, _, s in scripts}
    assert out.count() == len([r for r in brute.current(rows(df)).values() if brute.value(r["data"]) is not None])
    users = out.where("entity_type = 'userentity' and schema_version = 1").collect()
    assert newest["userentity"] >= 2 and have
    assert not any("Email" in json.loads(r.data) for r in users if any(s.old == "Email" for k, sc in scripts.items() if k[0] == "userentity" for s in sc))
    table = schema_drift.unified_table(df, scripts, "userentity", {"EmailAddress": "string", "Address.City": "string", "Age": "int"})
    assert table.columns == ["id", "entity_id", "version", "schema_version", "EmailAddress", "Address_City", "Age"]
    assert table.where("Age is not null and EmailAddress is not null").count() > 0


HOSTILE_USERS = [
    (1, '{"ID":"a","Email":"old","EmailAddress":"new","Quota":1.5}'), (1, '{"ID":"b","EmailAddress":"new","Email":null}'), (1, '{"EmailAddress":"new","Email":"old"}'), (3, '{"ID":"e","Address":{"Postcode":"p","ZipCode":"z","City":null}}'),
    (3, '{"Address":{"ZipCode":null,"Postcode":"p"}}'), (4, '{"Quota":"2.5","Address":"text"}'), (4, '{"Quota":-2.5,"Address":{"City":"a"},"Address.City":"b","Name":true}'), (4, '{"ID":5,"Quota":true,"Name":["x",1]}'), (4, "[1]"), (4, "null"), (4, " "),
    (None, '{"ID":"n","Email":"e","EmailAddress":"f"}'), (7, '{"ID":"y","Email":"e7","Address":{"Postcode":"p7"},"Quota":"12"}'), (0, '{"ID":"z","Email":"e0"}'), (4, '{"id":"lower","ID":"upper"}'),
]


def test_table_of_hostile_users(spark, data, tmp_path):
    """p2_users is written, read back and what SQL gives; a few records of a newer schema_version take no field away."""
    real = g.table(spark, data, "audit_versions")
    found = spark.createDataFrame([(f"odd{n}", s, x, T0) for n, (s, x) in enumerate(HOSTILE_USERS)], "id string, schema_version int, data string, created_at timestamp")
    found = found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in found.columns else F.lit("userentity" if f.name == "entity_type" else None).cast(f.dataType).alias(f.name) for f in real.schema])
    gone = real.where("entity_type = 'userentity'").orderBy("id").limit(5).withColumns({"entity_type": F.lit("other"), "created_at": F.lit(datetime(2100, 1, 1)).cast(real.schema["created_at"].dataType)})
    real.unionByName(found).unionByName(gone).write.parquet(f"{tmp_path}/audit_versions.parquet")
    spark.conf.set("spark.sql.caseSensitive", "false")
    g.p2_users(spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    table = spark.read.parquet(f"{tmp_path}/out")
    result = duckdb.sql(g.ORACLES["p2_users"].replace("from audit_versions", f"from '{tmp_path}/audit_versions.parquet/*.parquet'"))
    assert table.columns == result.columns
    assert got(table) == want(result.fetchall())
    assert table.where("id like 'odd%'").count() == 13


def test_unified_records_against_a_plain_reading(spark, data):
    """Renames of brute.p2, applied one after the other, lead to the same values."""
    df = g.table(spark, data, "audit_versions")
    changes = brute.p2(rows(df))
    newest = {t: max(hi for u, hi, *_ in changes if u == t) for t, *_ in changes}
    records = {i: r for i, r in brute.current(rows(df)).items() if brute.value(r["data"]) is not None}
    seen = 0
    for r in g.p2_unified(spark, data).collect():
        new, t = brute.fields(brute.parse(r.data)), r.entity_type
        for p, v in brute.fields(brute.parse(records[r.id]["data"])).items():
            q, removed, retyped = p, False, False
            for hi in range(r.schema_version + 1, newest.get(t, 0) + 1):
                step = {o: n for u, h, kind, o, n in changes if u == t and h == hi and kind == "renamed"}
                removed = removed or any((t, hi, "removed", up, "") in changes for up in (q, q.rpartition(".")[0]))
                q = step.get(q, q)
                retyped = retyped or (t, hi, "retyped", q, q) in changes
            if not (removed or retyped or isinstance(v, dict)):
                assert q in new and brute.same(new[q], v), (r.id, p, q)
                seen += 1
    assert seen > 1000


def test_tree_edit_scripts():
    from palimpsest.plans.tree_edit import edit_script

    old = {"A": "object", "A.x": "string", "A.y": "number", "B": "string", "K": "object", "K.p": "string"}
    new = {"Z": "object", "Z.x": "string", "Z.y": "number", "K": "object", "K.c": "object", "K.c.p": "string", "B": "string"}
    steps = edit_script(old, new, {("A", "Z"): 1.0, ("A.x", "Z.x"): 1.0, ("A.y", "Z.y"): 0.9, ("K.p", "K.c.p"): 1.0})
    assert [(s.kind, s.old, s.new) for s in steps] == [("renamed", "A", "Z"), ("moved", "K.p", "K.c.p"), ("added", "", "K.c")]  # a renamed object carries its members
    # members whose values change keep their object's partner; a member renamed inside has a step of its own
    steps = edit_script({"A": "object", "A.x": "string", "A.y": "string"}, {"Z": "object", "Z.x": "string", "Z.w": "string"}, {("A.y", "Z.w"): 0.8})
    assert [(s.kind, s.old, s.new) for s in steps] == [("renamed", "A", "Z"), ("renamed", "A.y", "Z.w")]
    # values decide between candidates, over all pairs together
    steps = edit_script({"a": "string", "b": "string"}, {"c": "string", "d": "string"}, {("a", "c"): 1.0, ("a", "d"): 0.9, ("b", "c"): 0.8})
    assert {(s.kind, s.old, s.new) for s in steps} == {("renamed", "a", "d"), ("renamed", "b", "c")}
    # moved to where nothing else changes
    steps = edit_script({"P": "object", "P.v": "string"}, {"P": "object", "v": "string"}, {("P.v", "v"): 1.0})
    assert [(s.kind, s.old, s.new) for s in steps] == [("moved", "P.v", "v")]
    # an equal name below another parent is no reason to move a value
    assert [s.kind for s in edit_script({"x": "string"}, {"B": "object", "B.x": "string"}, {})] == ["removed", "added", "added"]
    assert edit_script({}, {}, {}) == [] and [s.kind for s in edit_script({"a": "string"}, {"b": "string"}, {})] == ["removed", "added"]


def test_tree_distance_is_minimal():
    """Against all mappings of small random trees that keep ancestors."""
    import itertools
    import random

    from palimpsest.plans.tree_edit import Node, _Distance

    rng = random.Random(5)

    def grow(n, names):
        nodes = [Node("", "", "object")]
        for i in range(n):
            up = rng.choice(nodes)
            nodes.append(Node(f"{up.path}.{i}{names[i]}", names[i], "object"))
            up.children.append(nodes[-1])
        for x in reversed(nodes):
            x.size = 1 + sum(c.size for c in x.children)
        return nodes

    def above(x, y):
        return y.path.startswith(x.path + ".")

    for _ in range(60):
        a, b = grow(rng.randint(1, 4), "pqrs"), grow(rng.randint(1, 4), "pqtu")
        alike = {(x.path, y.path): rng.choice([0.6, 0.8, 1.0]) for x in a[1:] for y in b[1:] if rng.random() < 0.4}
        d = _Distance(alike)
        cost, _ = d.children(a[0].children, b[0].children, False)
        least = float(len(a) + len(b) - 2)
        for size in range(1, min(len(a), len(b))):
            for xs in itertools.combinations(a[1:], size):
                for ys in itertools.permutations(b[1:], size):
                    if all(above(xs[i], xs[j]) == above(ys[i], ys[j]) for i in range(size) for j in range(size) if i != j):
                        c = sum(d.pair(x, y, True) for x, y in zip(xs, ys)) + len(a) + len(b) - 2 - 2 * size
                        least = min(least, c)
        assert cost >= least - 1e-9  # the restricted distance is never below the unrestricted one
        assert cost <= len(a) + len(b) - 2
        held = d.mapped(d.children(a[0].children, b[0].children, False)[1])
        up = {c.path: x.path for t in (a, b) for x in t for c in x.children}
        ways = {(x.path, y.path) for x, y in held}
        inside = [bool(up[x.path] and up[y.path] and (up[x.path], up[y.path]) in ways) for x, y in held]
        assert abs(sum(d.pair(x, y, i) for (x, y), i in zip(held, inside)) + len(a) + len(b) - 2 - 2 * len(held) - cost) < 1e-9


def test_a_renamed_object_is_reported_field_by_field(spark):
    values = []
    for e in range(8):
        for v, name in ((1, "Home"), (2, "Address")):
            data = {"ID": e, name: {"City": f"c{e}", "Zip": e, "Seen": v}, "Deep": {"In": {"Home" if v == 1 else "Near": {"a": f"a{e}", "b": [e]}}}}
            values.append({"id": f"{e}-{v}", "entity_type": "t", "entity_id": str(e), "version": v, "schema_version": v, "data": json.dumps(data), "created_at": T0 + timedelta(hours=v)})
    df = record(spark, *values)
    d = schema_drift.drifts(df)["t", 1, 2]
    assert [(s.kind, s.old, s.new) for s in d.script] == [("renamed", "Deep.In.Home", "Deep.In.Near"), ("renamed", "Home", "Address")]
    expected = [(2, k, o, n) for k, o, n in [("renamed", "Deep.In.Home", "Deep.In.Near"), ("renamed", "Deep.In.Home.a", "Deep.In.Near.a"), ("renamed", "Deep.In.Home.b", "Deep.In.Near.b"), ("renamed", "Home.City", "Address.City"), ("renamed", "Home.Zip", "Address.Zip"), ("removed", "Home", ""), ("added", "", "Address"), ("removed", "Home.Seen", ""), ("added", "", "Address.Seen")]]
    assert got(schema_drift.drift_report(df).drop("entity_type")) == want(expected) == want(x[1:] for x in brute.p2(rows(df)))
    out = {r.id: json.loads(r.data) for r in schema_drift.unify(df, {("t", 1, 2): d.script}).collect()}
    assert out["3-1"] == {"ID": 3, "Address": {"City": "c3", "Zip": 3, "Seen": 1}, "Deep": {"In": {"Near": {"a": "a3", "b": [3]}}}}


def test_nodes_of_hostile_rows(spark):
    deep = "[" * 5000 + "]" * 5000
    values = [
        {"id": "a", "data": '{"A":[{"B":[1,{"c":[[{"d":1}]]}]},null]}', "created_at": T0}, {"id": "b", "data": '{"Items":"[{\\"x\\":[{}]}]"}', "created_at": T0}, {"id": "c", "data": '{"Items":{"x":1}}', "created_at": T0},
        {"id": "d", "data": '{"Items":"no json ["}', "metadata": {"custom": {"ok": '[{"a":[{}]}]', "cut": '[{"a":', "nan": "[{}, NaN]", "text": "x[", "nul": None}}, "created_at": T0},
        {"id": "e", "data": "[{}]", "created_at": None}, {"id": "f", "data": deep, "created_at": T0}, {"id": None, "data": '{"x":[{}]}', "created_at": T0}, {"id": "g", "data": None, "created_at": T0}, {"id": "h", "data": "", "metadata": None},
        {"id": "i", "data": '{"x":[{}]}', "created_at": T0}, {"id": "i", "data": '{"x":[]}', "created_at": T0 + timedelta(1)}, {"id": "j", "data": '{"x":{"Items":{"y":1}},"\\u0049tems":{"z":1}}', "created_at": T0},
    ]
    df = record(spark, *values)
    expected = [
        ("a", "data.A[0]", ""), ("a", "data.A[0].B[1]", "data.A[0]"), ("a", "data.A[0].B[1].c[0][0]", "data.A[0].B[1]"), ("b", "data.Items[0]", ""), ("b", "data.Items[0].x[0]", "data.Items[0]"), ("c", "data.Items[0]", ""),
        ("d", "custom.ok[0]", ""), ("d", "custom.ok[0].a[0]", "custom.ok[0]"), ("e", "data[0]", ""), (None, "data.x[0]", ""), ("j", "data.Items[0]", ""),
    ]
    full = nested.subtype_store(df, "Items")
    assert got(full.select("id", "node_path", "parent_path")) == want(expected)
    assert full.where("node_path = 'data.A[0].B[1].c[0][0]'").select("supertype", "position", "shape").first() == ("data.A[].B[].c[][]", 0, "d:number")


def test_variants_and_subtype_tables(spark):
    df = record(spark, {"id": "a", "data": '{"Items":[{"SKU":"x","Price":1.5},{"SKU":"y"},{"Price":2,"SKU":"z"}]}', "created_at": T0})
    n = nested.nodes(df)
    assert sorted((r.supertype, r.shape, r.n) for r in nested.variants(n).collect()) == [("data.Items[]", "Price:number,SKU:string", 2), ("data.Items[]", "SKU:string", 1)]
    t = nested.subtype_table(n, "data.Items[]", {"SKU": "string", "Price": "double"})
    assert sorted((r.position, r.SKU, r.Price) for r in t.collect()) == [(0, "x", 1.5), (1, "y", None), (2, "z", 2.0)]


def test_typed_tables_of_the_variants(spark):
    items = [{"SKU": "x", "Price": 1.5, "Gift": {"On": True, "Notes": [{"n": 1}]}}, {"SKU": "y", "Tags": ["a"], "Mixed": [1, "b"]}, {"Price": 2, "SKU": None}, {"SKU": 7}, {"sku": "a", "SKU": "b"}, {}]
    wide = '{"Items":[{"Price":123456789012345678.123456789,"N":12345678901234567890,"M":[1,2.5]}]}'
    df = record(spark, {"id": "a", "data": json.dumps({"Items": items}), "created_at": T0}, {"id": "b", "data": wide, "created_at": T0})
    store = nested.subtypes(df)
    assert got(store.rows.select(*nested.KEYS)) == got(nested.nodes(df).select(*nested.KEYS))
    tables = {t.number: store.table(t.number) for t in store.of("data.Items[]")}
    cells = {(r.id, r.position): r.asDict(recursive=True) for t in tables.values() for r in t.collect()}
    assert cells["a", 0]["Price"] in (1.5, "1.5") and cells["a", 0]["Gift"] == {"On": True} and cells["a", 1]["Tags"] == ["a"] and json.loads(cells["a", 1]["Mixed"]) == [1, "b"]
    assert cells["b", 0]["Price"] == "123456789012345678.123456789" and cells["b", 0]["N"] == "12345678901234567890" and cells["b", 0]["M"] == [1.0, 2.5]
    assert cells["a", 3]["SKU"] == 7 and len({k for k in cells}) == 6  # a number and a string don't share a column
    rest = store.stored.where(f"subtype = {nested.OTHER}").collect()
    assert [json.loads(r.body) for r in rest] == [{"sku": "a", "SKU": "b"}]  # names that differ in case only
    inner = store.of("data.Items[].Gift.Notes[]")
    assert [tuple(r) for r in store.table(inner[0].number).collect()] == [("a", "data.Items[0].Gift.Notes[0]", "data.Items[0]", 0, 1)]


def test_more_forms_than_tables(spark, monkeypatch):
    monkeypatch.setattr(nested, "MOST_TABLES", 2)
    df = record(spark, *[{"id": str(n), "data": json.dumps({f"m{n % 5}": [{"x": n}]}), "created_at": T0} for n in range(20)])
    store = nested.subtypes(df)
    assert store.rows.count() == 20 and len(store.tables) == 2 and store.stored.where("body is not null").count() == 12


@pytest.mark.parametrize("forms", [0, 2, nested.MOST_FORMS])
def test_items_without_a_typed_table(spark, monkeypatch, tmp_path, forms):
    """Whatever the number of forms that get typed tables, the items are those that SQL gives."""
    monkeypatch.setattr(nested, "MOST_FORMS", forms)
    items = [{"SKU": f"s{n}", "Quantity": n, "Price": n + 0.5, f"m{n}": 1} for n in range(6)]
    items += [{"SKU": 7, "Quantity": "2", "Price": "2.5"}, {"SKU": "x", "Quantity": True, "Price": "1d"}, {"sku": "a", "SKU": "b"}, {"sku": "c"}, {"SKU": ["q", 1], "Quantity": 2.5, "Price": "no"}, {"Quantity": -1.5, "Price": None}, {}, {"Quantity": 12345678901234567890, "Price": 12345678901234567890}]
    df = record(spark, {"id": "a", "data": json.dumps({"Items": items}), "created_at": T0}, {"id": "b", "data": json.dumps({"Items": {"SKU": "bare"}, "Others": [{"SKU": "no"}]}), "created_at": T0}, {"id": "c", "data": "{}", "created_at": T0})
    df.write.parquet(f"{tmp_path}/some/audit_versions.parquet")
    df.limit(0).write.parquet(f"{tmp_path}/none/audit_versions.parquet")
    found = g.p3_order_items(spark, f"{tmp_path}/some")
    sql = g.ORACLES["p3_order_items"].replace("from audit_versions", f"from '{tmp_path}/some/audit_versions.parquet/*.parquet'")
    result = duckdb.sql(sql)
    assert found.columns == result.columns and found.count() == 15
    assert got(found) == want(result.fetchall())
    assert got(g.p3_order_items(spark, f"{tmp_path}/none")) == []


@pytest.mark.parametrize("levels", [500, 2000])
def test_very_deep_records(spark, levels):
    """A text nested thousands of levels deep is JSON like any other."""
    text = '{"a":[' * levels + "1" + "]}" * levels
    other = text.replace("1", "1.0")
    df = record(spark, {"id": "x", "data": text, "created_at": T0})
    assert nested.subtypes(df).rows.count() == levels - 1
    assert got(differences.compare_copies(df, df.withColumn("data", F.lit(other)), scalars=HASH)) == []
    assert got(differences.compare_copies(df, df.withColumn("data", F.lit(text.replace("1", "2"))), scalars=HASH)) == [("x", "data.a")]
    objects = '{"a":' * levels + "1" + "}" * levels
    row = record(spark, {"id": "x", "data": objects, "created_at": T0})
    assert got(differences.compare_copies(row, row.withColumn("data", F.lit(objects.replace("1", "2"))), scalars=HASH)) == [("x", "data" + ".a" * levels)]
    fed = feed(spark, [("e", 1, 0, 0, "", '{"k":' + text + ',"o":' + objects + "}", T0)])
    assert got(change_feed.apply_feed(fed).select("path", "new_value")) == want([("k.a", text[5:-1]), ("o" + ".a" * levels, "1")])
    assert history.history(record(spark, {"id": "x", "entity_type": "t", "data": text, "created_at": T0})).count() == 1
    assert got(schema_drift.drift_report(record(spark, {"id": "x", "entity_type": "t", "schema_version": 1, "data": objects, "created_at": T0}))) == []


FEED = "feed_id long, entity_type string, entity_id string, version long, strategy short, op string, change_seq int, path string, old_value string, new_value string, created_at timestamp, received_at timestamp, kind string, slot string"


def feed(spark, changes):
    return spark.createDataFrame([(n, "t", *c[:3], None, *c[3:5], None, c[5], None, c[6], "clash", "clash") for n, c in enumerate(changes)], FEED)


@pytest.mark.parametrize("hot", [10**9, 0])
def test_feed_semantics(spark, monkeypatch, hot):
    monkeypatch.setattr(change_feed, "HOT_ROWS", hot)
    t = lambda n: T0 + timedelta(minutes=n)
    changes = [
        ("a", 1, 0, 0, "", '{"x":{"y":1},"k":2.50,"é":"ü"}', t(0)), ("a", 2, 1, 0, "x.z", "5", t(9)), ("a", 2, 1, 0, "x.q", "6", t(3)),  # the delivery received last counts, though its path is another
        ("a", 3, 1, 0, "x", "7", t(4)), ("a", 4, 1, 0, "x.w", "8", t(2)), ("a", 5, 1, 0, "x.w", None, t(1)),  # an object without members stays
        ("b", 1, 0, 0, "", '{"p":{"q":{"r":1}}}', t(0)), ("b", 2, 1, 0, "p.q.r", None, t(0)), ("b", 3, 1, 0, "p.q.s.t", "[1, {}]", t(0)), ("b", 3, 1, 1, "p.n", "null", t(0)),
        ("c", 1, 0, 0, "", '{"x":1}', t(0)), ("c", 2, 0, 0, "", None, t(0)), ("c", 3, 1, 0, "x", "2", t(0)),  # deleted, and then changed
        ("d", 1, 1, 0, "x", "2", t(0)),  # never there
        ("e", 2, 0, 0, "", '{"x":1}', t(5)), ("e", 1, 1, 0, "x", "9", t(6)), ("e", 2, 0, 0, "", '{"x":3}', t(5)),  # a tie: the later delivery
        ("f", 1, 0, 0, "", "{}", t(0)), ("g", 1, 0, 0, "", "[]", t(0)), ("h", 1, 0, 0, "", '{"x":5}', t(0)), ("h", 2, 1, 0, "x.y", None, t(0)), ("h", 3, 1, 0, "u.v", None, t(0)),
    ]
    out = [r[1:] for r in got(change_feed.apply_feed(feed(spark, changes)))]
    assert out == want([("a", "k", "2.50"), ("a", "x", "{}"), ("a", "é", '"ü"'), ("b", "p.q.s.t", "[1,{}]"), ("b", "p.n", "null"), ("e", "x", "3"), ("f", "", "{}"), ("g", "", "[]"), ("h", "x", "5")])


@pytest.mark.parametrize("hot", [10**9, 60, 0])
def test_feed_in_any_order(spark, monkeypatch, hot):
    import random

    monkeypatch.setattr(change_feed, "BUCKET_ROWS", 40)
    monkeypatch.setattr(change_feed, "HOT_ROWS", hot)
    rng = random.Random(3)
    changes = []
    for e in "abcd":
        for v in range(1, 60 if e == "a" else 12):
            if v == 1 or rng.random() < 0.05:
                changes.append((e, v, 0, 0, "", json.dumps({"x": {"y": v}, "z": v}) if rng.random() < 0.9 else None, T0))
            for s in range(rng.randint(0, 3)):
                path = rng.choice(["x", "x.y", "x.y.w", "z", "z.a.b", "n"])
                changes.append((e, v, 1, s + 1, path, rng.choice([None, "1", '{"y":{"w":2}}', "[]", "null"]), T0 + timedelta(minutes=rng.randint(0, 3))))
    changes += rng.choices(changes, k=60)
    rng.shuffle(changes)
    df = feed(spark, changes)
    assert got(change_feed.apply_feed(df)) == want(brute.p4(rows(df)))


def test_numbers_keep_their_spelling_and_half_characters_do_no_harm(spark):
    t = T0
    changes = [("a", 1, 0, 0, "", '{"a":23.0,"b":[1e2, 2.50,{"c":1}],"d":"\\ud83d x","e":"\\u00e9"}', t)]
    assert [r[2:] for r in got(change_feed.apply_feed(feed(spark, changes)))] == want([("a", "23.0"), ("b", '[1e2,2.50,{"c":1}]'), ("d", '"\ufffd x"'), ("e", '"é"')])
    df = record(spark, {"id": "a", "data": '{"\\ud83d":[{"x":"\\ud83d"}]}', "created_at": T0})
    assert nested.nodes(df).first().node_path == "data.\ufffd[0]"
    assert differences.compare_copies(df, df.withColumn("data", F.lit("{}")), scalars=HASH).first().finding == "data.\ufffd"


def test_feed_with_nulls(spark):
    df = spark.createDataFrame([(None, None, None, None, None, None, None, None, None, '{"a":1}', None, None, "", ""), (1, None, None, 1, None, None, 0, "b", None, "not json", None, None, "", "")], FEED)
    assert got(change_feed.apply_feed(df)) == want([(None, None, "a", "1"), (None, None, "b", '"not json"')])


def test_snapshots_are_published_whole(spark):
    root = new_path(spark, "t")
    assert current(spark, root) is None
    publish(spark.range(3), root)
    publish(spark.range(5), root)
    assert current(spark, root) == 2
    assert read_snapshot(spark, root).count() == 5 and read_snapshot(spark, root, 1).count() == 3
    with pytest.raises(Exception):
        publish(spark.range(3).select(F.raise_error(F.lit("lost")).alias("x")), root)
    assert read_snapshot(spark, root).count() == 5


def chain(spark, *values):
    return record(spark, *[{"id": i, "entity_type": "t", "entity_id": e, "version": v, "data": d, "created_at": T0 + timedelta(hours=h) if h is not None else None, "metadata": {"timestamp": T0 + timedelta(hours=(h or 0) - lag)}} for i, e, v, d, h, lag in values])


def periods(df):
    base = round(T0.replace(tzinfo=timezone.utc).timestamp() * 10**6)
    hour = lambda us: us if us == -1 else (us - base) // (3600 * 10**6)
    return want((r.entity_id, r.first_version, hour(r.valid_from_us), hour(r.valid_to_us)) for r in df.collect())


def test_history_of_hostile_rows(spark):
    df = chain(
        spark, ("1", "a", 1, '{"x":1}', 0, 0), ("2", "a", 2, '{"x":1.0}', 1, 0), ("3", "a", 3, None, 2, 0), ("4", "a", 4, "", 3, 0), ("5", "a", 5, '{"x":1}', 4, 0), ("6", "a", 6, '{"x":2}', 5, 0), ("6", "a", 6, '{"x":2}', 5, 0),
        ("7", "a", 7, '{"x":3}', 5, 0), ("8", "a", 8, '{"x":9}', 1, 30), ("9", "b", 1, "null", 0, 0), ("10", "c", 1, "{bad", 0, 0), ("11", "c", 1, "{bad", 2, 0), ("12", "c", 1, "{worse", 2, 0), ("13", "d", None, "[]", 1, 0), ("14", None, 1, "{}", 1, 0), ("15", "e", 1, "{}", None, 0),
    )
    expected = [("a", 1, 0, 1), ("a", 8, 1, 2), ("a", 5, 4, 5), ("a", 7, 5, -1), ("c", 1, 2, -1), ("d", None, 1, -1), (None, 1, 1, -1)]
    assert periods(history.history(df)) == want(expected)


def test_history_is_the_same_however_it_is_cut(spark):
    import random

    rng = random.Random(1)
    values = [(f"{n}", rng.choice("aaaaaab"), n % 150, rng.choice([None, "{}", '{"x":1}', '{ "x": 1 }', '{"x":2}']), rng.randint(0, 120), rng.choice([0, 0, 0, 5])) for n in range(400)]
    df = chain(spark, *values).cache()
    expected = want(x for x in brute.p5(rows(df), ("t",)))
    for n in ("1", "2", "7", "60"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        assert got(history.history(df)) == expected, n
    spark.conf.set("spark.sql.shuffle.partitions", "3")


def test_rebuild_replaces_touched_chains_only(spark):
    df = chain(spark, ("1", "a", 1, '{"x":1}', 0, 0), ("2", "a", 2, '{"x":2}', 5, 0), ("3", "b", 1, '{"x":1}', 0, 0))
    late = chain(spark, ("4", "a", 3, '{"x":3}', 2, 0))
    log = history.change_log(df, None)
    chains = history.build_chains(log).withColumn("valid_to_us", F.when(F.col("entity_id") == "b", 77).otherwise(F.col("valid_to_us")))
    everything = history.change_log(df.unionByName(late), None)
    chains, touched = (history.with_bucket(x, history.BUCKETS, "entity_type", "entity_id") for x in (chains, late))
    out, buckets = history.rebuild_chains(chains, everything, touched)
    assert buckets == history.buckets_of(touched)
    out = out.unionByName(chains.where(~F.col("_bucket").isin(buckets)))
    assert [r[:3] for r in periods(out.where("entity_id = 'a'"))] == [("a", 1, 0), ("a", 2, 5), ("a", 3, 2)]
    assert out.where("entity_id = 'b'").first().valid_to_us == 77


def test_a_late_delivery_writes_its_buckets_only(spark):
    df = chain(spark, *[(f"{e}{v}", f"e{e}", v, json.dumps({"x": v}), v, 0) for e in range(60) for v in range(3)])
    late = chain(spark, ("new", "e7", 9, '{"x":"late"}', 1, 30))
    root = new_path(spark, "chains")
    log = history.change_log(df, None)
    history.publish_buckets(history.with_bucket(history.build_chains(log), history.BUCKETS, "entity_type", "entity_id"), root)
    before = history.read_buckets(spark, root)
    everything = history.change_log(df.unionByName(late), None)
    history.apply_late(spark, root, everything, everything.where("id = 'new'"))
    after = history.read_buckets(spark, root)
    assert len(set(after.inputFiles()) - set(before.inputFiles())) == 1 and len(set(before.inputFiles()) - set(after.inputFiles())) == 1
    assert periods(after.where("entity_id <> 'e7'")) == periods(before.where("entity_id <> 'e7'"))
    assert [r[1:3] for r in periods(after.where("entity_id = 'e7'"))] == [(0, 0), (2, 2), (9, 1)]


def test_orphans_of_hostile_rows(spark):
    h = lambda n: T0 + timedelta(hours=n)
    e = {"entity_type": "t", "entity_id": "a"}
    df = record(
        spark, {"id": "1", "version": 1, "hash": "AA", "previous_hash": "", "created_at": h(0), **e}, {"id": "2", "version": 2, "hash": "bb", "previous_hash": " aa ", "created_at": h(1), **e}, {"id": "3", "version": 3, "hash": "", "previous_hash": "nope", "created_at": h(2), **e},
        {"id": "4", "version": 5, "hash": "cc", "previous_hash": "aa", "created_at": h(3), **e}, {"id": "5", "version": 6, "hash": "dd", "previous_hash": "cc", "created_at": h(2), **e}, {"id": "6", "version": 2, "previous_hash": "aa", "created_at": None, **e},
        {"id": "7", "version": 2, "previous_hash": "aa", "created_at": h(1), "entity_type": "t", "entity_id": "other"}, {"id": "8", "version": 1, "hash": "ee", "created_at": h(9)}, {"id": "9", "version": 2, "previous_hash": "ee", "created_at": h(8)},
        {"id": "10", "version": None, "previous_hash": "aa", "created_at": h(1), **e}, {"id": "2", "version": 9, "previous_hash": "zz", "created_at": h(0), **e}, {"id": None, "version": 3, "previous_hash": "zz", "created_at": h(0), **e},
    )
    expected = [("3", "missing", "2024-01"), ("4", "misplaced", "2024-01"), ("5", "later", "2024-01"), ("7", "missing", "2024-01"), ("9", "later", "2024-01"), ("10", "misplaced", "2024-01"), (None, "missing", "2024-01")]
    assert got(orphans.orphan_references({"t": df}).drop("table_name")) == want(expected)


def test_references_without_versions_and_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(orphans, "RANGE_KEYS", 3)
    e = {"entity_type": "t", "entity_id": "a"}
    lost = record(spark, {"id": "1", "version": None, "hash": "x", "created_at": T0, **e}, {"id": "2", "version": None, "previous_hash": "x", "created_at": T0, **e}, {"id": "3", "version": 1, "hash": "y", "created_at": T0, **e}, {"id": "4", "version": None, "previous_hash": "y", "created_at": T0, **e})
    assert got(orphans.orphan_references({"t": lost}).select("id", "reason")) == [("2", "misplaced"), ("4", "misplaced")]
    import random

    rng = random.Random(8)
    values = []
    for n in range(600):
        v = rng.randint(1, 9)
        values.append({"id": str(n % 550), "version": v, "hash": rng.choice(["", f"h{v}", f"h{v}-{n % 3}", None]), "previous_hash": rng.choice([None, f"h{v - 1}", f"h{v - 1}-{n % 3}", "h4", "gone"]), "created_at": T0 + timedelta(days=rng.randint(0, 200), seconds=n), "entity_type": "t", "entity_id": rng.choice("aaab")})
    df = record(spark, *values)
    assert got(orphans.orphan_references({"t": df})) == want(brute.p6("t", rows(df)))
