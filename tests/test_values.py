"""JSON values, bitmaps and edit scripts."""

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.functions import jsonval
from palimpsest.functions.bitmap import Bitmap
from palimpsest.plans import shapes
from palimpsest.plans.tree_edit import distance, edit_script


@pytest.mark.parametrize("a, b", [("2.5", "25e-1"), ("2.50", "2.5"), ("100", "1e2"), ("-0", "0"), ("0.1", "1.0E-1"), ('{"a":1,"b":2}', ' {"b":2.0 , "a":1}'), ('"\\u00e9"', '"é"'), ("[1,2]", "[ 1 , 2 ]"), ("1e400", "10e399"), ("12345678901234567890.10", "12345678901234567890.1")])
def test_equal_spellings(a, b):
    assert jsonval.digest(a) == jsonval.digest(b)
    assert jsonval.equal(jsonval.load(a), jsonval.load(b))


@pytest.mark.parametrize("a, b", [("1", "true"), ("0", "false"), ('"1"', "1"), ("[1,2]", "[2,1]"), ('"A"', '"a"'), ('{"a":null}', "{}"), ("0.1", "0.10000000000000001"), ("[true]", "[1]"), ("12345678901234567890", "12345678901234567891"), ("1e400", "2e400")])
def test_unequal_values(a, b):
    assert jsonval.digest(a) != jsonval.digest(b)
    assert not jsonval.equal(jsonval.load(a), jsonval.load(b))


@pytest.mark.parametrize("text", [None, "", "  \n", "null", " null "])
def test_no_data(text):
    assert jsonval.digest(text) is None


@pytest.mark.parametrize("text", ["{", "NaN", "[1,]", '{"a":1} x', "[" * 100_000, "'a'", "-", "1" * 5000 + "x"])
def test_not_json(text):
    assert type(jsonval.load_any(text)) is jsonval.Invalid
    assert jsonval.digest(text) == jsonval.digest(text) != jsonval.digest(text + " ")


def test_long_number():
    assert jsonval.digest("1" * 6000) == jsonval.digest("1" * 6000 + ".0")


json_values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text(), c, max_size=4), max_leaves=12)


@given(json_values)
@settings(max_examples=200, deadline=None)
def test_dump_is_stable(v):
    text = json.dumps(v)
    again = jsonval.dump(jsonval.load(text))
    assert jsonval.dump(jsonval.load(again)) == again
    assert jsonval.digest(json.dumps(v, indent=2, sort_keys=True)) == jsonval.digest(text)
    assert shapes.state(v) == shapes.state(json.loads(text))


ordinals = st.lists(st.integers(0, 400_000) | st.integers(0, 200), max_size=300)


@given(ordinals, ordinals, st.integers(0, 300_000), st.integers(0, 70_000))
@settings(max_examples=100, deadline=None)
def test_bitmaps_are_sets(a, b, start, run):
    a = [*a, *range(start, start + run)]
    x, y = Bitmap.of(a), Bitmap.of(b)
    a, b = set(a), set(b)
    for got, want in ((x, a), (x & y, a & b), (x | y, a | b), (x.andnot(y), a - b), (Bitmap.from_bytes(x.to_bytes()), a)):
        assert got.ordinals().tolist() == sorted(want)
        assert len(got) == len(want)


def test_bitmaps_choose_their_form():
    assert len(Bitmap.of(range(65_536)).to_bytes()) < 40
    assert len(Bitmap.of(range(0, 65_536, 2)).to_bytes()) < 8_300
    assert len(Bitmap.of([5]).to_bytes()) < 40
    assert len(Bitmap.of(np.zeros(0, int))) == 0


def _brute_script(old, new, alike):
    """Cost of the best of all pairings."""
    gone, fresh = [p for p in old if p not in new], [p for p in new if p not in old]

    def best(i, free):
        if i == len(gone):
            return float(len(free))
        least = 1 + best(i + 1, free)
        for f in free:
            if (gone[i], f) in alike:
                least = min(least, 1 - alike[gone[i], f] / 2 + best(i + 1, free - {f}))
        return least

    return best(0, frozenset(fresh)) + sum(0.5 for p in old if p in new and old[p] != new[p])


@given(st.data())
@settings(max_examples=150, deadline=None)
def test_edit_scripts_are_cheapest(data):
    names = [f"{a}.{b}" for a in "xy" for b in "abcd"]
    old = {p: data.draw(st.sampled_from(["string", "number"])) for p in data.draw(st.sets(st.sampled_from(names)))}
    new = {p: data.draw(st.sampled_from(["string", "number"])) for p in data.draw(st.sets(st.sampled_from(names)))}
    alike = {(g, f): data.draw(st.sampled_from([0.6, 0.75, 1.0])) for g in old for f in new if g not in new and f not in old and data.draw(st.booleans())}
    steps = edit_script(old, new, alike)
    assert distance(steps) == pytest.approx(_brute_script(old, new, alike))
    after = dict(old)
    for s in steps:
        if s.old and s.kind != "retyped":
            after.pop(s.old)
    for s in steps:
        if s.new:
            after[s.new] = new[s.new]
    assert after == new


def test_moves_are_told_from_renames():
    steps = edit_script({"A.x": "string", "B": "string"}, {"x": "string", "C": "string"}, {("A.x", "x"): 1.0, ("B", "C"): 0.9})
    assert {(s.kind, s.old, s.new) for s in steps} == {("moved", "A.x", "x"), ("renamed", "B", "C")}
