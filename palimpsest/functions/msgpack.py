"""MessagePack payloads: JSON values to bytes and back, as Arrow UDFs."""

from __future__ import annotations

import base64
import json
import struct

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from palimpsest.model import SerializationError


def _sized(n: int, small: tuple[int, int] | None, wide: list[tuple[int, str]]) -> bytes:
    """Head of a value with a size: in the code byte if it is small, else after it."""
    if small and n <= small[1]:
        return bytes([small[0] | n])
    for code, form in wide:
        if n < 1 << 8 * struct.calcsize(form):
            return bytes([code]) + struct.pack(form, n)
    raise SerializationError(f"a size of {n} can't be written")


def pack(v) -> bytes:
    if v is None or isinstance(v, bool):
        return {None: b"\xc0", False: b"\xc2", True: b"\xc3"}[v]
    if isinstance(v, int):
        if 0 <= v < 128 or -32 <= v < 0:
            return struct.pack("b" if v < 0 else "B", v)
        for codes, forms in ((range(0xCC, 0xD0), ">B >H >I >Q"), (range(0xD0, 0xD4), ">b >h >i >q")):
            for code, form in zip(codes, forms.split()):
                try:
                    return bytes([code]) + struct.pack(form, v)
                except struct.error:
                    continue
        raise SerializationError(f"{v} has more than 64 bits")
    if isinstance(v, float):
        return b"\xcb" + struct.pack(">d", v)
    if isinstance(v, str):
        raw = v.encode("utf-8", "surrogatepass")
        return _sized(len(raw), (0xA0, 31), [(0xD9, ">B"), (0xDA, ">H"), (0xDB, ">I")]) + raw
    if isinstance(v, (bytes, bytearray)):
        return _sized(len(v), None, [(0xC4, ">B"), (0xC5, ">H"), (0xC6, ">I")]) + bytes(v)
    if isinstance(v, (list, tuple)):
        return _sized(len(v), (0x90, 15), [(0xDC, ">H"), (0xDD, ">I")]) + b"".join(map(pack, v))
    if isinstance(v, dict):
        return _sized(len(v), (0x80, 15), [(0xDE, ">H"), (0xDF, ">I")]) + b"".join(pack(k) + pack(v[k]) for k in v)
    raise SerializationError(f"{type(v).__name__} can't be written")


_NUMBERS = dict(zip(range(0xCA, 0xD4), (">f", ">d", ">B", ">H", ">I", ">Q", ">b", ">h", ">i", ">q")))
_SIZES = {0xC4: ("bin", ">B"), 0xC5: ("bin", ">H"), 0xC6: ("bin", ">I"), 0xD9: ("str", ">B"), 0xDA: ("str", ">H"), 0xDB: ("str", ">I"), 0xDC: ("list", ">H"), 0xDD: ("list", ">I"), 0xDE: ("map", ">H"), 0xDF: ("map", ">I")}


def _read(raw: bytes, at: int):
    code = raw[at]
    at += 1
    if code < 0x80 or code >= 0xE0:
        return code - 256 * (code >= 0xE0), at
    if code in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[code], at
    if code in _NUMBERS:
        form = _NUMBERS[code]
        return struct.unpack_from(form, raw, at)[0], at + struct.calcsize(form)
    if code < 0xC0:
        kind, n = ("map", code & 15) if code < 0x90 else ("list", code & 15) if code < 0xA0 else ("str", code & 31)
    elif code in _SIZES:
        kind, form = _SIZES[code]
        n = struct.unpack_from(form, raw, at)[0]
        at += struct.calcsize(form)
    else:
        raise SerializationError(f"code {code:#x} isn't supported")
    if kind in ("str", "bin"):
        if at + n > len(raw):
            raise SerializationError("cut off")
        body = raw[at : at + n]
        return (body.decode("utf-8", "surrogatepass") if kind == "str" else body), at + n
    out = []
    for _ in range(n * (1 + (kind == "map"))):
        v, at = _read(raw, at)
        out.append(v)
    return (dict(zip(out[::2], out[1::2])) if kind == "map" else out), at


def unpack(raw: bytes):
    try:
        value, end = _read(raw, 0)
    except (IndexError, struct.error, TypeError, UnicodeDecodeError) as e:
        raise SerializationError("no MessagePack") from e
    if end != len(raw):
        raise SerializationError("bytes are left over")
    return value


def _packed(text):
    try:
        return None if text is None else pack(json.loads(text))
    except (ValueError, SerializationError, RecursionError):
        return None


def _unpacked(raw):
    try:
        return None if raw is None else json.dumps(unpack(raw), ensure_ascii=False, separators=(",", ":"), default=lambda b: base64.b64encode(b).decode())
    except (SerializationError, TypeError, RecursionError):
        return None


@F.arrow_udf(BinaryType())
def to_msgpack(texts: pa.Array) -> pa.Array:
    """Bytes of JSON texts; null for what isn't JSON."""
    return pa.array([_packed(t) for t in texts.to_pylist()], pa.binary())


@F.arrow_udf(StringType())
def from_msgpack(raws: pa.Array) -> pa.Array:
    """JSON texts of bytes (binary members as base64); null for what isn't MessagePack."""
    return pa.array([_unpacked(r) for r in raws.to_pylist()], pa.string())
