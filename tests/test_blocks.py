"""Windows in blocks give what windows over whole histories give."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.operators import query, reconstruct, versioning
from palimpsest.plans import blocks

T0 = datetime(2024, 1, 1)


@pytest.fixture
def cut(monkeypatch):
    """One entity holds nearly all rows, and its history is cut into many blocks."""
    monkeypatch.setattr(blocks, "BLOCK", 7)
    monkeypatch.setattr(blocks, "LONG_ROWS", 50)
    monkeypatch.setattr(blocks, "SLICES", 9)


def rows(spark, n=400, seed=1):
    rng = random.Random(seed)
    version: dict = {}
    out = []
    for i in range(n):
        e = rng.choice(["hot"] * 12 + ["b", None])
        version[e] = version.get(e, 0) + 1 + (rng.random() < 0.05) * 30
        out.append(("t", e, version[e], rng.choice([0] + [1] * 9), T0 + timedelta(seconds=rng.randint(0, n // 2)) if rng.random() < 0.98 else None, i))
    return spark.createDataFrame(out, "entity_type string, entity_id string, version long, strategy int, created_at timestamp, n int")


def same(a, b):
    assert a.columns == b.columns
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_previous_and_rank(spark, cut):
    df = rows(spark)
    w = Window.partitionBy("entity_type", "entity_id").orderBy("version")
    same(blocks.with_previous(df, ["entity_type", "entity_id"], "version", ["n"]), df.withColumn("previous", F.lag(F.struct("n")).over(w)))
    for up in (True, False):
        o = Window.partitionBy("entity_id").orderBy(F.col("version").asc() if up else F.col("version").desc())
        same(blocks.ranked(df, ["entity_id"], "version", up), df.withColumn("_rank", F.row_number().over(o).cast("long")))
    page = df.withColumn("_n", F.row_number().over(w.orderBy(F.desc("version")))).where("_n between 31 and 90").drop("_n")
    same(query.list_versions(df, 60, 30), page)


def test_compaction_runs_across_blocks(spark, cut):
    df = rows(spark, seed=2)
    w = Window.partitionBy("entity_type", "entity_id").orderBy("version")
    run = df.withColumn("r", F.sum((F.col("strategy") == 0).cast("int")).over(w))
    k = F.sum((F.col("strategy") != 0).cast("int")).over(Window.partitionBy("entity_type", "entity_id", "r").orderBy("version"))
    for most in (1, 3, 11):
        same(reconstruct.compaction_plan(df, most), run.withColumn("compact", (F.col("strategy") != 0) & (k % most == 0)).drop("r"))


def test_numbers_of_a_hot_entity(spark, cut):
    df = rows(spark, seed=3).drop("version")
    stored = spark.createDataFrame([("t", "hot", 40), ("t", "hot", 41)], "entity_type string, entity_id string, version long")
    n = F.row_number().over(Window.partitionBy("entity_type", "entity_id").orderBy("created_at", "n")) + F.when(F.col("entity_id") == "hot", 41).otherwise(0)
    same(versioning.number_versions(df, stored, ["created_at", "n"]).orderBy("n"), df.withColumn("version", n.cast("long")).orderBy("n").select("entity_type", "entity_id", *[c for c in df.columns if c not in ("entity_type", "entity_id")], "version"))
    same(versioning.number_versions(df, None, ["n", "created_at"]), df.withColumn("version", F.row_number().over(Window.partitionBy("entity_type", "entity_id").orderBy("n")).cast("long")))


def test_asof_of_a_hot_entity(spark, cut):
    left, right = rows(spark, 300, 4), rows(spark, 300, 5).select("entity_id", "created_at", "version", F.col("n").alias("value"))
    out = query.asof_join(left.select("entity_id", "created_at", "n"), right, ["entity_id"], "created_at", "created_at", ["value"], "version")
    have = right.collect()
    low = datetime(1, 1, 1)
    for r in out.collect():
        best = max((x for x in have if x.entity_id == r.entity_id and (x.created_at or low) <= (r.created_at or low)), key=lambda x: (x.created_at or low, x.version), default=None)
        assert r.value == (best.value if best else None), r
    assert out.count() == 300
