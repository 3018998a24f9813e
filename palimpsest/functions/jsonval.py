"""JSON values compared by what they mean, not by how they are spelled.

``load`` maps every spelling of a number to one Python object (an int where the value is integral, else the shortest
float with that exact value, else a Decimal), so ``dump`` gives equal text for equal values: key order, blanks, escapes
and number spelling vanish; array order, letter case, types and null against absent stay.
"""

from __future__ import annotations

import json
import re
from decimal import Decimal, InvalidOperation
from hashlib import blake2b
from json.decoder import scanstring

import pyarrow as pa

BLANKS = " \t\r\n"


class Invalid:
    """A text that is not JSON; equal only to the same text."""

    __slots__ = ("text",)

    def __init__(self, text: str):
        self.text = text


def _refuse(name: str):
    raise ValueError(name)


def _int(text: str):
    return int(text) if len(text) < 4000 else _wide(text)


def _float(text: str):
    if len(text) <= 15:
        f = float(text)
        return int(f) if f.is_integer() and abs(f) < 1e15 else f if 1e-290 < abs(f) < 1e290 else _wide(text)
    return _wide(text)


def _wide(text: str):
    try:
        d = Decimal(text)
    except InvalidOperation:
        raise ValueError(text) from None
    if not d:
        return 0
    sign, digits, exp = d.as_tuple()
    if len(digits) + exp < 4000 and (exp >= 0 or -exp < len(digits) and not any(digits[exp:])):
        return int(d)
    f = float(d)
    if f and f not in (float("inf"), float("-inf")) and Decimal(repr(f)) == d:
        return f
    tail = len(digits)
    while digits[tail - 1] == 0:
        tail -= 1
    return Decimal((sign, digits[:tail], exp + len(digits) - tail))


_BLANK, _WORD, _WORDS = re.compile(r"[ \t\r\n]*"), re.compile("true|false|null"), {"true": True, "false": False, "null": None}
_NUMBER = re.compile(r"(-?(?:0|[1-9][0-9]*))(\.[0-9]+)?([eE][-+]?[0-9]+)?")
_decode = json.JSONDecoder(parse_float=_float, parse_int=_int, parse_constant=_refuse).decode
_encode = json.JSONEncoder(ensure_ascii=True, sort_keys=True, separators=(",", ":"), default=lambda d: {"\0number": str(d)}).encode


def load(text: str, decode=None, number=(_int, _float)):
    """The value of a JSON text, nested however deep; ValueError if it is none."""
    try:
        return (decode or _decode)(text)
    except RecursionError:
        return _deep(text, *number)


def _deep(text: str, read_int, read_float):
    """The same with a stack of open containers in place of recursion."""
    root: list = []
    stack: list = [root]
    names: list = [None]  # the member of each open container that waits for its value
    at, wants = 0, "value"
    while True:
        at = _BLANK.match(text, at).end()
        c = text[at : at + 1]
        if wants == "end":
            if c:
                raise ValueError("text after the value")
            return root[0]
        top = stack[-1]
        if wants in ("value", "first value") and c != "]":
            if c == '"':
                value, at = scanstring(text, at + 1, True)
            elif c in ("{", "["):
                value, at = ({} if c == "{" else []), at + 1
            elif m := _NUMBER.match(text, at):
                value, at = (read_float if m[2] or m[3] else read_int)(m[0]), m.end()
            elif m := _WORD.match(text, at):
                value, at = _WORDS[m[0]], m.end()
            else:
                raise ValueError(f"no value at {at}")
            if isinstance(top, dict):
                top[names[-1]] = value
            else:
                top.append(value)
            wants = "end" if top is root else "next"
            if c in ("{", "["):
                stack.append(value)
                names.append(None)
                wants = "first name" if c == "{" else "first value"
        elif wants in ("name", "first name") and c == '"':
            names[-1], at = scanstring(text, at + 1, True)
            at = _BLANK.match(text, at).end()
            if text[at : at + 1] != ":":
                raise ValueError(f"no colon at {at}")
            at, wants = at + 1, "value"
        elif wants == "next" and c == ",":
            at, wants = at + 1, "name" if isinstance(top, dict) else "value"
        elif wants.startswith(("first", "next")) and c == ("}" if isinstance(top, dict) else "]") and top is not root:
            stack.pop()
            names.pop()
            at, wants = at + 1, "end" if stack[-1] is root else "next"
        else:
            raise ValueError(f"unexpected {c!r} at {at}")


def load_any(text: str | None):
    """The value; None for no data (null, blank or JSON null); Invalid for a text that is not JSON."""
    if text is None or not text.strip(BLANKS):
        return None
    try:
        return load(text)
    except ValueError:
        return Invalid(text)


def dump(value) -> str:
    """Canonical text: equal values give equal text."""
    if type(value) is Invalid:
        return "\0" + value.text
    try:
        return _encode(value)
    except RecursionError:
        return spell(value, _encode, True)


class _Raw(str):
    """Text between values."""


def spell(value, leaf, in_order: bool = False) -> str:
    """JSON text without blanks, however deep; ``leaf`` spells names and what is neither object nor array."""
    out: list[str] = []
    todo: list = [value]
    while todo:
        x = todo.pop()
        if type(x) is _Raw:
            out.append(x)
        elif isinstance(x, dict):
            out.append("{")
            todo.append(_Raw("}"))
            keys = sorted(x) if in_order else list(x)
            for n in range(len(keys) - 1, -1, -1):
                todo += [x[keys[n]], _Raw(("," if n else "") + leaf(keys[n]) + ":")]
        elif isinstance(x, list):
            out.append("[")
            todo.append(_Raw("]"))
            for n in range(len(x) - 1, -1, -1):
                todo.append(x[n])
                if n:
                    todo.append(_Raw(","))
        else:
            out.append(leaf(x))
    return "".join(out)


def equal(a, b) -> bool:
    if type(a) is not type(b):
        return False
    return a == b if type(a) in (str, int, float, bool, type(None)) else dump(a) == dump(b)


def kind(value) -> str:
    """The JSON type's name; '' for null."""
    t = type(value)
    return "string" if t is str else "boolean" if t is bool else "object" if t is dict else "array" if t is list else "" if value is None else "number"


def digest(text: str | None) -> bytes | None:
    """16 bytes that are equal for equal values; None for no data."""
    value = load_any(text)
    return None if value is None else blake2b(dump(value).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def digests(texts: pa.Array) -> pa.Array:
    return pa.array([digest(t) for t in texts.to_pylist()], pa.binary())
