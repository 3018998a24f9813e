"""A bottom-up tree automaton over JSON values, and the column types that follow from its states.

Every value gets a state from its kind and the states of its children: an object's from its members' names and states,
an array's from the set of its elements' states. A state's name is a digest of that rule, so equal shapes get equal
states in every task, with nothing to agree on. A null member counts as present with state ``z``. Beside the state goes
its *form*, the part of the rule that decides how the value is stored in a flat table: finer in numbers (whole, double,
wider than that), coarser in arrays that hold objects, which are tables of their own.
"""

from __future__ import annotations

import json
from decimal import Decimal
from functools import lru_cache
from hashlib import blake2b

from pyspark.sql import types as T

from palimpsest.functions.jsonval import kind, spell

LEVELS = 8  # objects inside objects that become structs; deeper ones are columns of JSON text
_SAFE = 1 << 53  # whole numbers up to here are exact as doubles too
CHILD, TEXT = "#", "j"  # forms: an array that holds objects; a value kept as JSON text


_quoted = lru_cache(1 << 16)(json.dumps)


def _name(rule: str) -> str:
    return blake2b(rule.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def digest(*parts: str) -> str:
    return _name("\0".join(parts))


def member_shape(value: dict) -> str:
    """Names and kinds of an object's own members, in order of name."""
    return ",".join(f"{k}:{kind(value[k]) or 'null'}" for k in sorted(value))


def _number_form(x) -> str:
    return "f" if type(x) is float else "w" if type(x) is Decimal or abs(x) > _SAFE else "i"


_LEAVES = {type(None): ("z", '"z"', 0, False), str: ("s", '"s"', 0, False), bool: ("b", '"b"', 0, False)} | {f: ("n", f'"{f}"', 0, False) for f in "ifw"}


def classify(value) -> dict[int, tuple[str, str, int, bool]]:
    """id -> (state, form, levels, holds an object as an element) of each object and array in the value, children first."""
    out: dict[int, tuple[str, str, int, bool]] = {}

    def known(x) -> tuple[str, str, int, bool]:
        kind_of = type(x)
        if kind_of is dict or kind_of is list:
            return out[id(x)]
        return _LEAVES[kind_of] if kind_of in _LEAVES else _LEAVES[_number_form(x)]

    todo = [(value, False)]
    while todo:
        x, ready = todo.pop()
        if not isinstance(x, (dict, list)) or id(x) in out:
            continue
        if not ready:
            todo.append((x, True))
            todo += [(c, False) for c in (x.values() if isinstance(x, dict) else x) if isinstance(c, (dict, list))]
        elif isinstance(x, dict):
            names = sorted(x)
            parts = [known(x[k]) for k in names]
            deep = 1 + max((p[2] for p in parts), default=0)
            form = f'"{TEXT}"' if deep > LEVELS else "{" + ",".join(f"{_quoted(k)}:{p[1]}" for k, p in zip(names, parts)) + "}"
            out[id(x)] = _name("{" + ",".join(f"{k!r}:{p[0]}" for k, p in zip(names, parts)) + "}"), form, deep, False
        else:
            parts = {known(c) for c in x}
            holds = any(isinstance(c, dict) for c in x) or any(p[3] for p in parts)
            deep = 1 + max((p[2] for p in parts), default=0)
            form = f'"{CHILD}"' if holds else f'"{TEXT}"' if deep > LEVELS else "[" + ",".join(sorted({p[1] for p in parts})) + "]"
            out[id(x)] = _name("[" + "|".join(sorted({p[0] for p in parts})) + "]"), form, 0 if holds else deep, holds
    return out


def state(value) -> str:
    """The value's state."""
    return classify([value])[id(value)][0] if isinstance(value, (dict, list)) else _LEAVES.get(type(value), ("n",))[0]


def _leaf(x) -> str:
    return json.dumps(str(x)) if kind(x) == "number" and _number_form(x) == "w" else json.dumps(x)


def body(value: dict, known: dict[int, tuple[str, str, int, bool]]) -> str:
    """The object's JSON text without arrays that hold objects; numbers wider than a double are spelled in strings."""
    form = known[id(value)][1]

    def own(x, level: int):
        if isinstance(x, dict) and level <= LEVELS:
            return {k: own(c, level + 1) for k, c in x.items() if not (isinstance(c, list) and known[id(c)][3])}
        return x

    if CHILD in form:
        value = own(value, 1)
    # most forms say that nothing needs care
    return spell(value, _leaf) if '"w"' in form or f'"{TEXT}"' in form else json.dumps(value, separators=(",", ":"))


def merge(a, b):
    """The form that holds values of either form; None if a column can't hold both."""
    if a == b or b == "z":
        return a
    if a == "z":
        return b
    if isinstance(a, str) and isinstance(b, str) and a in "ifw" and b in "ifw":
        return max(a, b, key="ifw".index)
    if isinstance(a, list) and isinstance(b, list):
        return a + [x for x in b if x not in a]
    if isinstance(a, dict) and isinstance(b, dict):
        out = dict(a)
        for k, x in b.items():
            out[k] = merge(a[k], x) if k in a else x
            if out[k] is None:
                return None
        return out
    if [] in (a, b) and CHILD in (a, b):
        return CHILD  # an array without elements has no rows in the child table
    return None


def spark_type(form) -> T.DataType | None:
    """The column type of a form; None where the value is in a table of its own."""
    if isinstance(form, dict):
        fields = [T.StructField(k, t) for k, x in sorted(form.items()) if (t := spark_type(x)) is not None]
        return T.StructType(fields) if fields else None if form else T.StringType()
    if isinstance(form, list):
        one = "z"
        for x in form:
            one = merge(one, x) if isinstance(x, str) else None
            if one is None:
                return T.StringType()
        return T.ArrayType(spark_type(one))
    return None if form == CHILD else {"b": T.BooleanType(), "i": T.LongType(), "f": T.DoubleType()}.get(form, T.StringType())


def plain(kind_of: T.StructType) -> bool:
    """Whether the names of all fields are told apart without letter case."""
    names = [f.name.lower() for f in kind_of.fields]
    return len(set(names)) == len(names) and all(names) and all(plain(f.dataType) for f in kind_of.fields if isinstance(f.dataType, T.StructType))
