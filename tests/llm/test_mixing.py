"""Mixtures: flows against brute force, shares and repeats against their bounds."""

from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.llm import mixing

SOURCES = "abc"
patterns = st.dictionaries(st.sampled_from([p for n in (1, 2) for p in product(SOURCES, repeat=n) if list(p) == sorted(set(p))]), st.integers(1, 5).map(float), min_size=1, max_size=4)


@given(patterns, st.tuples(st.integers(1, 3), st.integers(1, 3), st.integers(1, 3)), st.integers(1, 8))
@settings(max_examples=100, deadline=None)
def test_routes_respect_all_bounds(patterns, repeats, total):
    here = sorted({x for p in patterns for x in p})
    targets = {x: (1 / len(here), repeats[SOURCES.index(x)]) for x in here}
    most, _ = mixing.route(patterns, targets)
    want = min(float(total), most)
    _, flows = mixing.route(patterns, targets, want)
    for x in here:
        assert sum(v for (p, y), v in flows.items() if y == x) == pytest.approx(want / len(here), rel=1e-4, abs=1e-6)
    for p, size in patterns.items():
        used = {x: flows[p, x] / size for x in p}
        assert all(v <= targets[x][1] + 1e-6 for x, v in used.items())
        assert sum(used.values()) <= max(targets[x][1] for x in p) + 1e-6


def test_routes_are_cheapest():
    """Everything once before anything twice: the shared pattern helps the poor source."""
    flows = mixing.route({("a",): 10.0, ("a", "b"): 10.0, ("b",): 2.0}, {"a": (0.5, 5), "b": (0.5, 5)}, 20.0)[1]
    assert flows[("a",), "a"] == pytest.approx(10) and flows[("b",), "b"] + flows[("a", "b"), "b"] == pytest.approx(10)
    assert flows[("a", "b"), "a"] + flows[("a", "b"), "b"] <= 10 + 1e-6
    flows = mixing.route({("a",): 10.0, ("a", "b"): 10.0, ("b",): 2.0}, {"a": (0.5, 5), "b": (0.5, 5)}, 22.0)[1]
    assert flows[("b",), "b"] == pytest.approx(2)
    flows = mixing.route({("a",): 4.0}, {"a": (1.0, 3)}, 10.0)[1]
    assert flows[("a",), "a"] == pytest.approx(10)
    assert mixing.route({("a",): 4.0, ("b",): 1.0}, {"a": (0.5, 1), "b": (0.5, 2)})[0] == pytest.approx(4.0)


def corpus(spark, n=2000):
    source = F.element_at(F.array(*[F.lit(x) for x in ("Big-One", "big_one ", "BIG ONE", "small", None, "other")]), (F.when(F.col("id") % 10 < 7, F.col("id") % 3).otherwise(F.col("id") % 10 - 4) + 1).cast("int"))
    return spark.range(n).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), (F.col("id") % 13 + 1).cast("int")).alias("text"), source.alias("source"), F.lit("clash").alias("pattern"), F.lit(1).alias("n_tokens"))


def targets(spark, *rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_shares_and_repeats(spark):
    t = targets(spark, ("big-one", 0.5, 1), ("Small", 0.5, 4), ("none", 0.0, 1), (None, 0.3, 1))
    mixture, shares = mixing.mix(corpus(spark), t)
    got = {r.source: r for r in shares.collect()}
    assert set(got) == {"big-one", "Small"}
    assert all(abs(r.actual_share - 0.5) < 0.01 for r in got.values())
    rows = mixture.collect()
    assert all(1 <= r.repeats <= (1 if r.source == "big-one" else 4) for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    small = corpus(spark).where("source = 'small'").count()
    assert got["Small"].documents == small and {r.repeats for r in rows if r.source == "Small"} == {4}  # the scarce source is used up
    again = mixing.mix(corpus(spark), t)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))
    other = mixing.mix(corpus(spark), t, seed=2)[0]
    assert sorted(map(tuple, other.collect())) != sorted(map(tuple, rows))


def test_smaller_totals_use_texts_once(spark):
    mixture, _ = mixing.mix(corpus(spark), targets(spark, ("big-one", 0.5, 2), ("small", 0.5, 4)), total=2000.0)
    assert {r.repeats for r in mixture.collect()} == {1}


def test_overlapping_sources(spark):
    df = corpus(spark).withColumn("sources", F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("a"), F.lit("B"))).otherwise(F.array(F.lit("A "))))
    mixture, shares = mixing.mix(df, targets(spark, ("a", 0.6, 1), ("b", 0.4, 1)), sources=F.col("sources"))
    got = {r.source: r.actual_share for r in shares.collect()}
    assert got["a"] == pytest.approx(0.6, abs=0.01) and got["b"] == pytest.approx(0.4, abs=0.01)
    uses = mixture.groupBy("doc_id").agg(F.sum("repeats").alias("n"))
    assert uses.where("n > 1").count() == 0


def test_missing_sources_and_empty_tables(spark):
    df = corpus(spark)
    mixture, shares = mixing.mix(df, targets(spark, ("small", 0.5, 1), ("absent", 0.5, 1)))
    assert {r.source: r.actual_share for r in shares.collect()} == {"small": 1.0, "absent": 0.0}
    assert mixing.mix(df.limit(0), targets(spark, ("small", 0.5, 1)))[0].count() == 0
    assert mixing.mix(df, targets(spark).limit(0))[0].count() == 0
    blank = spark.createDataFrame([(1, None, "small"), (2, "", "small"), (3, "x", None)], "doc_id long, text string, source string")
    assert mixing.mix(blank, targets(spark, ("small", 0.5, 1)))[0].count() == 0


def test_settling_goes_on_until_nothing_helps(spark):
    """Long texts at the edge of the draw leave much to settle; many short ones fill it to the token."""
    rows = [(n, "word " * 4000 if n < 6 else "word", "a" if n % 2 else "b") for n in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixture, shares = mixing.mix(df, targets(spark, ("a", 0.7, 1), ("b", 0.3, 1)))
    got = {r.source: r for r in shares.collect()}
    assert abs(got["a"].actual_share - 0.7) < 0.0005 and abs(got["b"].actual_share - 0.3) < 0.0005
    assert mixture.where("repeats <> 1").count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_shared_texts_keep_their_bounds(spark, seed):
    kinds = [["a"], ["b"], ["a", "b"], ["b", "c"], ["a", "b", "c"], []]
    df = spark.createDataFrame([(n, "word " * (n * 7919 % 211 + 1), kinds[n * seed % 6]) for n in range(900)], "doc_id long, text string, sources array<string>")
    most = {"a": 1, "b": 2, "c": 3}
    mixture, shares = mixing.mix(df, targets(spark, ("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3)), sources=F.col("sources"), seed=seed)
    uses = {}
    for r in mixture.collect():
        assert r.source in kinds[r.doc_id * seed % 6] and r.repeats <= most[r.source]
        uses[r.doc_id] = uses.get(r.doc_id, 0) + r.repeats
    assert all(n <= max(most[x] for x in kinds[d * seed % 6]) for d, n in uses.items())
    for r in shares.collect():
        assert abs(r.actual_share - r.target_share) < 0.002, r


def test_papers_in_several_sources(spark):
    df = spark.createDataFrame([(1, "x", "A", "p"), (2, "x", " a ", "p"), (3, "x", "B", "p"), (4, "x", "b", None), (5, "x", "other", "q"), (6, "x", None, "q")], "doc_id long, text string, source string, paper_key string")
    out = mixing.memberships(df, targets(spark, ("a", 0.5, 1), ("b", 0.5, 1)), "paper_key")
    assert {r.doc_id: sorted(x for x in r.sources if x) for r in out.collect()} == {1: ["a", "b"], 2: ["a", "b"], 3: ["a", "b"], 4: ["b"], 5: [], 6: []}
