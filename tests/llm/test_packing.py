"""Packing: buckets against brute force, plans and placements against their rules."""

from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.llm import packing, prefix, tokens


def padding(counts, bounds):
    return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in counts.items())


counts = st.dictionaries(st.integers(0, 40), st.integers(1, 9), min_size=1, max_size=9)


@given(counts, st.integers(1, 5))
@settings(max_examples=200, deadline=None)
def test_buckets_minimise_padding(counts, k):
    bounds = packing.optimal_buckets(counts, k)
    lengths = sorted(counts)
    assert len(bounds) <= k and bounds[-1] == lengths[-1] and bounds == sorted(set(bounds))
    best = min(padding(counts, [*c, lengths[-1]]) for n in range(min(k, len(lengths))) for c in combinations(lengths[:-1], n))
    assert padding(counts, bounds) == best


@given(st.dictionaries(st.integers(0, 50), st.integers(1, 30), max_size=15), st.booleans())
@settings(max_examples=200, deadline=None)
def test_plans_place_every_item_once(counts, across):
    slots, used = packing.plan(counts, 50, packing.optimal_buckets(counts, 4), across)
    by, load, places = {}, {}, set()
    for s in slots:
        by.setdefault(s.length, []).append(s)
    for length, n in counts.items():
        mine = by[length]
        assert [s.first for s in mine] == sorted(s.first for s in mine) and mine[0].first == 0
        for rank in range(n):
            s = [x for x in mine if x.first <= rank][-1]
            c, p = s.container + (rank - s.first) // s.each, s.position + (rank - s.first) % s.each
            assert (c, p) not in places and 0 <= c < used
            places.add((c, p))
            load[c] = load.get(c, 0) + length
    assert len(load) == used and all(x <= 50 for x in load.values())
    for c in load:  # positions have no holes
        mine = sorted(p for d, p in places if d == c)
        assert mine == list(range(len(mine)))
    total = sum(x * n for x, n in counts.items())
    if across and total:
        assert used - (0 in counts) <= 2 * total / 50 + 1


@given(st.dictionaries(st.integers(1, 32), st.integers(1, 40), min_size=1, max_size=20), st.sampled_from([32, 24, 30]))
@settings(max_examples=200, deadline=None)
def test_bucket_mates_leave_nothing_unused(counts, capacity):
    counts = {x: n for x, n in counts.items() if x <= capacity}
    bounds = packing.optimal_buckets(counts, 4)
    slots, used, taken = packing.mates(counts, capacity, bounds)
    load, buckets = {}, {}
    for s in slots:
        n = min([x.container for x in slots if x.container > s.container], default=used) - s.container
        for c in range(s.container, s.container + n):
            load[c] = load.get(c, 0) + s.each * s.length
            buckets.setdefault(c, set()).add(min(b for b in bounds if b >= s.length))
    assert len(load) == used and all(x == capacity for x in load.values()) and all(len(b) == 1 for b in buckets.values())
    assert all(0 <= taken[x] <= n for x, n in counts.items())
    if bounds:
        assert packing.plan(counts, capacity, bounds)[1] <= packing._fit(counts, capacity, bounds, True)[1]


def documents(spark, *texts):
    rows = [(n, t, "clash", "x", 1) for n, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, rest string, spec_name string, rank int")


def test_pieces_hold_all_tokens(spark):
    texts = ["word " * n for n in (1, 3, 10, 25, 80, 80, 7, 7)] + ["", None, "a" * 5000]
    specs = [("s", 16), ("l", 64)]
    df = documents(spark, *texts)
    pieces = packing.pack(df, specs).collect()
    sizes = [tokens.count(t) for t in texts]
    for spec, capacity in specs:
        mine = [p for p in pieces if p.spec_name == spec]
        for n, size in enumerate(sizes):
            parts = sorted((p.start_token, p.n_tokens, p.piece) for p in mine if p.doc_id == n)
            assert sum(p[1] for p in parts) == size and len(parts) >= 1
            at = 0
            for k, (start, length, piece) in enumerate(parts):
                assert (start, piece) == (at, k)
                at += length
            assert len(parts) == max(1, -(-size // capacity))  # split only as often as needed
        load = {}
        for p in mine:
            load.setdefault(p.container, []).append(p)
        for ps in load.values():
            assert sum(p.n_tokens for p in ps) <= capacity
            assert sorted(p.position for p in ps) == list(range(len(ps)))
    fills = packing.fill(packing.pack(df, specs), specs)
    assert fills.where("fill > 1 or fill < 0").count() == 0


def test_no_documents_and_bad_capacities(spark):
    assert packing.pack(documents(spark, "x").limit(0), [("s", 5)]).count() == 0
    assert packing.pack(documents(spark, "x"), []).count() == 0
    with pytest.raises(ValueError):
        packing.pack(documents(spark, "x"), [("s", 0)])


def test_fill_of_the_corpus(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet")
    specs = [("short", 512), ("wide", 8192)]
    f = packing.fill(packing.pack(df, specs), specs)
    by = {r.spec_name: (r.n, r.least) for r in f.groupBy("spec_name").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("least")).collect()}
    n = by["short"]
    assert n[0] <= 1.02 * n[1] / 512 + 1
    assert by["short"][1] == by["wide"][1] == sum(tokens.count(r.text) for r in df.select("text").collect())
    apart = packing.fill(packing.pack(df, specs, across=False), specs).where("spec_name = 'short'").count()
    assert apart >= n[0]


def test_token_counts(spark):
    assert tokens.count("Hello world") == 2 and tokens.count(None) == 0 == tokens.count("")
    df = documents(spark, "Hello world", None, "<|endoftext|>", "é" * 3, "x" * 100_000)
    got = [r[0] for r in df.orderBy("doc_id").select(tokens.n_tokens("text")).collect()]
    assert got[:2] == [2, 0] and got[2] > 1 and got[4] > 1000


def test_shipped_vocabularies(spark):
    name = tokens.ship(spark)
    assert "/" not in name
    assert [r[0] for r in documents(spark, "Hello world").select(tokens.n_tokens("text", name)).collect()] == [2]


def test_running_sums(spark, monkeypatch):
    monkeypatch.setattr(prefix, "BLOCK_ROWS", 7)
    df = spark.range(200).select("id", F.when(F.col("id") % 3 > 0, "hot").alias("g"), (F.col("id") % 5).alias("v"))
    rows = prefix.running(df, ["g"], ["id"], F.col("v"), "before").collect()
    assert len(rows) == 200
    for g in ("hot", None):
        mine = sorted((r.before, r.v) for r in rows if r.g == g)
        at = 0
        todo = {}
        for b, v in mine:
            todo.setdefault(b, []).append(v)
        while todo:  # the sums chain: each starts where another ends
            vs = todo[at]
            v = vs.pop(vs.index(0)) if 0 in vs else vs.pop()
            if not vs:
                del todo[at]
            at += v
        assert at == sum(r.v for r in rows if r.g == g)
