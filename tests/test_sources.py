"""Stores, logs, streams and the library's front."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest import model
from palimpsest.auditor import Auditor
from palimpsest.functions.metadata import Context
from palimpsest.operators import integrity, reconstruct, redact
from palimpsest.plans.registry import EntityType, tagged
from palimpsest.sources import wal
from palimpsest.sources.scratch import new_path
from palimpsest.sources.store import ColdStore, Router, VersionStore, decode, encode, jdbc_options, read_jdbc, read_objects, write_jdbc
from palimpsest.streaming import versioner

T0 = datetime(2024, 1, 1)
SCHEMA = T.StructType([tagged("ID", T.StringType(), "id"), tagged("Name", T.StringType(), "tracked"), tagged("Age", T.LongType(), "tracked")])

PERSON = EntityType("person", SCHEMA, "ID")


def record(spark, *keys, data="{}"):
    rows = [(f"{e}-{v}", "t", e, v, 0, 1, data, "application/json", None, None, "", "", T0) for e, v in keys]
    return spark.createDataFrame(rows, T.StructType([T.StructField(f.name, f.dataType) for f in model.RECORD.fields]))


def test_store(spark):
    store = VersionStore(spark, new_path(spark, "store"))
    assert store.migrate() == 1 == store.migrate()
    store.append(record(spark, ("a", 1), ("a", 2)))
    store.append(record(spark, ("a", 2), ("a", 3), ("a", 3), data='{"x":1}'))
    assert {(r.version, r.data) for r in store.read().collect()} == {(1, "{}"), (2, "{}"), (3, '{"x":1}')}
    with pytest.raises(model.DuplicateVersion):
        store.append(record(spark, ("a", 1)), strict=True)
    with pytest.raises(model.NotFound):
        store.update(record(spark, ("b", 1)))
    store.update(record(spark, ("a", 1), data="new"), ("data",))
    assert store.read().where("version = 1").first().data == "new" and store.read(2).count() == 2
    store.delete(F.col("version") < 3)
    assert store.read().count() == 1


def test_an_append_writes_its_rows_only(spark):
    store = VersionStore(spark, new_path(spark, "store"), buckets=8)
    store.append(record(spark, *[(f"e{n}", 1) for n in range(40)]))
    files = set(store.read().inputFiles())
    store.append(record(spark, ("e3", 2)))
    more = set(store.read().inputFiles())
    assert files < more and len(more - files) == 1
    store.update(record(spark, ("e3", 1), data="new"), ("data",))
    touched = set(store.read().inputFiles())
    assert len(touched - more) == 1 and len(more - touched) == 2 and store.read().count() == 41
    store.delete(F.col("entity_id") == "nobody")
    assert set(store.read().inputFiles()) == touched
    store.tidy()
    assert store.read().count() == 41 and store.vacuum() > 0 and store.read().count() == 41


def test_no_local_folder_on_a_cluster(spark):
    from palimpsest.sources import scratch

    class Conf:
        def get(self, name, default=None):
            return {"spark.master": "spark://there:7077"}.get(name, default)

    class Session:
        conf = Conf()

    with pytest.raises(RuntimeError):
        scratch.shared_dir(Session())


def test_tiers(spark):
    main, olap = VersionStore(spark, new_path(spark, "main")), VersionStore(spark, new_path(spark, "olap"))
    router = Router(main, olap)
    router.append(record(spark, ("a", 1)))
    olap.append(record(spark, ("a", 0)))
    assert router.read().count() == 2 and router.read_main().count() == 1 and router.read_analytics().count() == 2
    broken = Router(main, VersionStore(spark, "nowhere://x/y"))
    broken.append(record(spark, ("a", 5)))
    assert len(broken.errors) == 1 and main.read().count() == 2
    cold = ColdStore(spark, new_path(spark, "cold"))
    cold.put(main.read())
    assert cold.get("t", "a", 1).first().data == "{}" and cold.get("t", "a", 9).count() == 0


def test_flat_rows(spark):
    df = record(spark, ("a", 1)).withColumn("metadata", F.struct(*[F.lit("x" if f.dataType == T.StringType() else None).cast(f.dataType).alias(f.name) for f in model.METADATA.fields]))
    flat = encode(df)
    assert flat.schema["metadata"].dataType == T.StringType() == flat.schema["delta"].dataType
    assert decode(flat).first().metadata.actor_id == "x"
    with pytest.raises(Exception):
        decode(flat.withColumn("metadata", F.lit("{bad"))).collect()
    assert jdbc_options("mysql", "jdbc:mysql://h/d", "t")["driver"].startswith("com.mysql")
    with pytest.raises(model.StorageError):
        jdbc_options("paper", "", "")


def test_jdbc_round_trip(spark):
    """Through the embedded database that comes with Spark."""
    url = "jdbc:derby:memory:records;create=true"
    try:
        spark._jvm.java.lang.Class.forName("org.apache.derby.iapi.jdbc.AutoloadedDriver")
    except Exception:
        pytest.skip("no embedded database")
    meta = F.struct(*[F.lit("x" if f.dataType == T.StringType() else None).cast(f.dataType).alias(f.name) for f in model.METADATA.fields])
    change = F.array(F.struct(F.lit("a.b").alias("path"), F.lit("1").alias("old_value"), F.lit(None).cast("string").alias("new_value")))
    df = record(spark, *[("a", v) for v in range(1, 41)], data='{"x":"é"}').withColumns({"metadata": meta, "delta": F.when(F.col("version") % 2 == 0, change)})
    options = jdbc_options("derby", url, "records")
    write_jdbc(df.where("version <= 20"), options)
    write_jdbc(df.where("version > 20"), options)
    back = read_jdbc(spark, options, '"version"', (1, 40), 4)
    assert back.rdd.getNumPartitions() == 4 and back.count() == 40
    rows = {r.version: r for r in back.collect()}
    assert rows[2].metadata.actor_id == "x" and [tuple(c) for c in rows[2].delta] == [("a.b", "1", None)] and rows[3].delta is None and rows[40].data == '{"x":"é"}' and rows[7].created_at == T0
    assert back.where("version = 3").count() == 1


def test_log_files(spark, tmp_path):
    good = [wal.frame({"id": str(n), "record": {"n": n}, "created_at": "t"}) for n in range(3)]
    bad = bytearray(good[1])
    bad[6] ^= 1
    (tmp_path / "a.wal").write_bytes(good[0] + bytes(bad) + good[2] + good[0][:-2])
    (tmp_path / "b.wal").write_bytes(b"")
    (tmp_path / "ack").write_text("2\n\n")
    entries = wal.read_files(spark, str(tmp_path / "*.wal"))
    assert {(r.id, r.record) for r in entries.collect()} == {("0", '{"n": 0}'), ("2", '{"n": 2}')}
    assert [r.id for r in wal.unacknowledged(entries, wal.read_acks(spark, str(tmp_path / "ack"))).collect()] == ["0"]


def test_recover(spark):
    stored = record(spark, ("a", 1))
    entries = record(spark, ("a", 1), ("a", 2), ("b", 1)).unionByName(record(spark, ("a", 2)).withColumn("id", F.lit("zz")))
    replay, outcome = wal.recover(entries, stored)
    assert sorted(r.id for r in replay.collect()) == ["a-2", "b-1"]
    assert {(r.id, r.outcome) for r in outcome.collect()} == {("a-1", "skipped"), ("a-2", "replayed"), ("zz", "skipped"), ("b-1", "replayed")}


def people(spark, *rows):
    return spark.createDataFrame([(i, (i, n, a), T0 + timedelta(minutes=m)) for i, n, a, m in rows], T.StructType([T.StructField("entity_id", T.StringType()), T.StructField("state", SCHEMA), T.StructField("created_at", T.TimestampType())]))


def test_auditor(spark):
    audit = Auditor(spark, new_path(spark, "audit"), interval=3, max_entity=100)
    audit.register("person", SCHEMA)
    me = Context().actor("me").tenant("t1")
    rejected = audit.version("person", people(spark, ("a", "x", 1, 0), ("a", "y", 1, 1), ("b", "q", 1, 0), (None, "z", 1, 0), ("c", "w" * 200, 1, 0)), me)
    assert sorted(r.error for r in rejected.collect()) == ["entity too large", "validation: empty entity id"]
    audit.version("person", people(spark, ("a", "y", 2, 5), ("a", "z", 2, 6)), Context().actor("you"))
    assert [(r.version, r.strategy) for r in audit.list_versions("person", "a", ascending=True).orderBy("version").collect()] == [(1, 0), (2, 1), (3, 1), (4, 0)]
    assert audit.get_latest("person", "a").first().version == 4 and audit.get_version("person", "a", 2).count() == 1
    assert audit.get_at_time("person", "2024-01-01 00:01:30", "a").first().version == 2
    assert [r.entity_id for r in audit.get_bulk_at_time("person", ["b", "nobody", "a", "b"], "2024-01-02").orderBy("position").collect()] == ["b", "a", "b"]
    assert {(r.version, r.old_value, r.new_value) for r in audit.find_changes("person", "Name", "a").collect()} == {(2, '"x"', '"y"'), (4, '"y"', '"z"')}
    assert [tuple(r)[2:] for r in audit.compare("person", 1, 3, "a").orderBy("position").collect()] == [("Name", '"x"', '"y"'), ("Age", "1", "2")]
    with pytest.raises(model.NotFound):
        audit.compare("person", 1, 9, "a")
    assert audit.find_by_actor("person", "me").count() == 3 and audit.records("person", tenant="t1").count() == 3
    assert audit.verify_integrity().where("ok").count() == 2
    assert {(r.path, r.new_value) for r in audit.reconstruct("person", 3).where("entity_id = 'a'").collect()} == {("ID", '"a"'), ("Name", '"y"'), ("Age", "2")}
    assert audit.compact(2) and audit.verify_integrity().where("ok").count() == 2
    assert audit.redact_field("person", "Name", rechain=True) == 5
    assert audit.verify_integrity().where("ok").count() == 2 and '"[REDACTED]"' in audit.get_latest("person", "b").first().data
    assert audit.health().first().healthy
    with pytest.raises(model.ConfigurationError):
        audit.version("nobody", people(spark, ("a", "x", 1, 0)))


def _files(spark, path, *batches):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, "entity_type string, entity_id string, id string, data string, created_at timestamp").coalesce(1).write.parquet(f"{path}/{n}")


def test_versions_go_on_after_a_restart(spark):
    at = new_path(spark, "stream")
    schema = "entity_type string, entity_id string, id string, data string, created_at timestamp"

    def run():
        q = versioner.version_stream(spark.readStream.schema(schema).parquet(f"{at}/in/*"), PERSON, interval=2)
        q.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()

    def state(e, n):
        return f'{{"ID":"{e}","Name":"{n}","Age":1}}'

    _files(spark, f"{at}/in", [("t", "a", "1", state("a", "x"), T0), ("t", "a", "2", state("a", "y"), T0 + timedelta(1)), ("t", "b", "3", state("b", "x<\n\u00e9"), T0), ("t", "b", "9", None, T0)])
    run()
    spark.createDataFrame([("t", "a", "4", state("a", "y"), T0 + timedelta(2)), ("t", "a", "5", state("a", "z"), T0 + timedelta(3))], schema).coalesce(1).write.parquet(f"{at}/in/9")
    run()
    stored = spark.read.parquet(f"{at}/out")
    out = stored.orderBy("entity_id", "version").collect()
    assert [(r.entity_id, r.version, r.id, r.strategy) for r in out] == [("a", 1, "1", 0), ("a", 2, "2", 1), ("a", 3, "5", 0), ("b", 1, "3", 0)]
    assert out[0].previous_hash == "" and out[1].previous_hash == out[0].hash and out[2].previous_hash == out[1].hash
    assert [tuple(c) for c in out[1].delta] == [("Name", '"x"', '"y"')] and out[2].delta is None
    assert integrity.verify_chains(stored).where("ok").count() == 2  # the chain is the one the batch verifies
    leaves = reconstruct.reconstruct(stored.withColumn("data", F.when(F.col("strategy") == 0, F.col("data"))), 2)
    assert {(r.path, r.new_value) for r in leaves.where("entity_id = 'a'").collect()} == {("ID", '"a"'), ("Name", '"y"'), ("Age", "1")}
    plain = versioner.version_stream(spark.readStream.schema(schema).parquet(f"{at}/in/*"))
    plain.writeStream.format("memory").queryName("plain").option("checkpointLocation", f"{at}/log2").trigger(availableNow=True).start().awaitTermination()
    assert {(r.strategy, r.delta) for r in spark.table("plain").collect()} == {(0, None)}


def test_refused_states_leave_no_trace(spark):
    """A state over the limit is not numbered, and the next state's delta leads from the version before it."""
    audit = Auditor(spark, new_path(spark, "audit"), max_entity=60)
    audit.register("person", SCHEMA)
    refused = audit.version("person", people(spark, ("a", "x", 1, 0), ("a", "y" * 80, 2, 1), ("a", "x", 2, 2)))
    assert [tuple(r) for r in refused.collect()] == [("person", "a", "entity too large")]
    records = audit.list_versions("person", "a", ascending=True).orderBy("version").collect()
    assert [(r.version, r.strategy) for r in records] == [(1, 0), (2, 1)] and [tuple(c) for c in records[1].delta] == [("Age", "1", "2")]
    assert audit.verify_integrity().first().ok
    leaves = audit.reconstruct("person")
    assert {(r.path, r.new_value) for r in leaves.collect()} == {("ID", '"a"'), ("Name", '"x"'), ("Age", "2")}
    assert audit.meter.counts["audit.version.duration"] > 0 and audit.meter.counts["audit.store.write.error_total"] == 0
    probes = {r.name: (r.healthy, r.error) for r in audit.health(cache=lambda: False, queue=lambda: 1 / 0, olap=lambda: True).collect()}
    assert probes["store"][0] and probes["olap"][0] and probes["cache"] == (False, "unhealthy") and "zero" in probes["queue"][1]


def test_submitted_calls(spark):
    audit = Auditor(spark, new_path(spark, "audit"))
    audit.register("person", SCHEMA)
    calls = [audit.submit("person", people(spark, ("a", f"n{n}", n, n))) for n in range(3)] + [audit.submit("nobody", people(spark, ("a", "x", 1, 0)))]
    assert [c.result().count() for c in calls[:3]] == [0, 0, 0]
    with pytest.raises(model.ConfigurationError):
        calls[3].result()
    audit.close()
    with pytest.raises(RuntimeError):
        audit.submit("person", people(spark, ("a", "x", 1, 0)))
    assert [r.version for r in audit.list_versions("person", "a", ascending=True).orderBy("version").collect()] == [1, 2, 3]


def test_types_that_cannot_be_compared_are_stored_full(spark):
    kind = T.StructType([tagged("ID", T.StringType(), "id"), tagged("Took", T.DayTimeIntervalType(), "tracked"), tagged("N", T.LongType(), "tracked")])
    audit = Auditor(spark, new_path(spark, "audit"))
    audit.register("odd", kind)
    states = spark.createDataFrame([("a", ("a", timedelta(seconds=n), n), T0 + timedelta(minutes=n)) for n in range(3)], T.StructType([T.StructField("entity_id", T.StringType()), T.StructField("state", kind), T.StructField("created_at", T.TimestampType())]))
    assert audit.version("odd", states).count() == 0
    assert [(r.strategy, r.delta) for r in audit.get_latest("odd").collect()] == [(0, None)] and '"N":2' in audit.get_latest("odd").first().data


def test_table_log(spark):
    log = wal.TableLog(spark, new_path(spark, "log"), buckets=4)
    assert log.replay().count() == 0
    rows = lambda *ids: spark.createDataFrame([(i, "{}", "t") for i in ids], wal.ENTRY)
    log.append(rows("1", "2", "3"))
    log.append(rows("3", "4"))
    log.ack(rows("1", "4"))
    assert sorted(r.id for r in log.replay().collect()) == ["2", "3"]
    with pytest.raises(model.WALError):
        log.append(rows(""))
    assert log.purge() == 2 and sorted(r.id for r in log.replay().collect()) == ["2", "3"]
    log.append(rows("1"))
    assert log.replay().count() == 3


def test_objects_of_a_bucket(spark, tmp_path):
    import gzip

    for e, v, text in (("a", 1, '{"x":"é"}'), ("a", 2, "{}"), ("b", 1, "")):
        (tmp_path / "t" / e).mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / e / str(v)).write_bytes(gzip.compress(text.encode()))
    out = read_objects(spark, f"file://{tmp_path}", compression="gzip")
    assert {tuple(r) for r in out.collect()} == {("t", "a", 1, '{"x":"é"}'), ("t", "a", 2, "{}"), ("t", "b", 1, "")}
    assert read_objects(spark, f"file://{tmp_path}", "t", "a", 2, "gzip").first().data == "{}"


def test_redaction_keeps_numbers(spark):
    text = '{"b":1e400,"a":{"x":"secret","n":12345678901234567.123456789}}'
    assert redact.redact_json(text, "a.x") == '{"a":{"n":12345678901234567.123456789,"x":"[REDACTED]"},"b":1e400}'
    deep = '{"a":' * 3000 + "1" + "}" * 3000
    assert redact.redact_json(deep, "a.a") == '{"a":{"a":"[REDACTED]"}}' and redact.redact_json("{bad", "a") == "{bad"


def test_fan_out_isolates_subscribers(spark):
    seen, said = [], []
    run = versioner.fan_out(lambda b, n: seen.append(b.count()), lambda b, n: 1 / 0, lambda b, n: seen.append("s"), log=said.append)
    run(spark.range(4), 7)
    assert seen == [4, "s"] and len(said) == 1
    with pytest.raises(ZeroDivisionError):
        versioner.fan_out(lambda b, n: 1 / 0)(spark.range(1), 1)


def test_windows_of_a_batch(spark):
    df = spark.createDataFrame([("a", T0 + timedelta(minutes=m)) for m in (0, 5, 59, 61, 300)], "k string, ts timestamp")
    assert sorted(r.changes for r in versioner.change_windows(df, "ts", "1 hour", by=["k"]).collect()) == [1, 1, 3]
    assert len(versioner.change_windows(df, "ts", "1 hour", "30 minutes").collect()) == 6
    assert sorted(r.changes for r in versioner.sessions(df, "ts", "30 minutes", ["k"]).collect()) == [1, 2, 2]


def test_file_log(tmp_path):
    log = wal.FileLog(str(tmp_path / "w"))
    for n in range(3):
        log.append({"id": str(n), "record": {"é": n}})
    log.ack("1")
    assert [e["id"] for e in log.replay()] == ["0", "2"]
    log.close()
    again = wal.FileLog(str(tmp_path / "w"))
    assert len(again.replay()) == 2
    with pytest.raises(model.WALError):
        again.append({})
    again.close()


def test_msgpack(spark):
    import json

    from palimpsest.functions import msgpack

    value = {"a": [0, 127, 128, 255, 256, 65535, 65536, 2**32, 2**63, -1, -32, -33, -128, -129, -32769, -(2**31) - 1, -(2**63)], "f": 1.5, "s": "é" * 40, "l": list(range(40)), "n": None, "t": True, "d": {str(i): i for i in range(20)}, "long": "x" * 70_000}
    assert msgpack.unpack(msgpack.pack(value)) == value
    assert msgpack.pack({"a": 1}) == b"\x81\xa1a\x01" and msgpack.unpack(msgpack.pack(b"xyz")) == b"xyz"
    for bad in (b"", b"\xc1", b"\xa5ab", b"\x01\x01", b"\x81\x90\x01"):
        with pytest.raises(model.SerializationError):
            msgpack.unpack(bad)
    df = spark.createDataFrame([('{"a":[1,2.5,"x"]}',), ("{bad",), (None,)], "j string").withColumn("m", msgpack.to_msgpack("j"))
    got = [r[0] for r in df.select(msgpack.from_msgpack("m")).collect()]
    assert json.loads(got[0]) == {"a": [1, 2.5, "x"]} and got[1:] == [None, None]


def test_point_cache():
    from palimpsest.sources.cache import PointCache

    cache = PointCache(2)
    for v in (1, 2, 3):
        cache.put("t", "a", v, v)
    assert cache.get("t", "a", 1) is None and cache.get("t", "a", 2) == 2
    cache.put("t", "b", 1, 1)
    assert cache.get("t", "a", 3) is None and len(cache) == 2 and cache.invalidate("t", "a") == 1 and len(cache) == 1


def test_repeated_jobs_survive_failures():
    import time

    from palimpsest.streaming.monitor import Repeat

    runs = []
    job = Repeat(lambda: runs.append(1) or 1 / 0, 0.01)
    time.sleep(0.2)
    job.stop()
    n = len(runs)
    time.sleep(0.05)
    assert n >= 2 and len(runs) == n


def test_monitor_and_buffer(spark):
    from palimpsest.streaming.monitor import Monitor, buffered

    at, got, watch = new_path(spark, "buffer"), [], Monitor()
    spark.range(10).write.parquet(f"{at}/in")
    spark.streams.addListener(watch)
    q = buffered(spark.readStream.schema("id long").parquet(f"{at}/in"), lambda b, n: got.append(b.count()), f"{at}/log", "1 second")
    q.processAllAvailable()
    q.stop()
    spark.streams.removeListener(watch)
    assert sum(got) == 10
