"""Arrow batches from rows."""

from __future__ import annotations

import pyarrow as pa

_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "short": pa.int16(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}


def schema(ddl: str) -> pa.Schema:
    """Of a DDL with plain types; needs no session, so it works in Python workers."""
    return pa.schema([(n, _KINDS[t]) for n, t in (c.split() for c in ddl.split(", "))])


def array(values, kind: pa.DataType) -> pa.Array:
    """pa.array, but halves of surrogate pairs, which JSON escapes can spell and UTF-8 can't, become U+FFFD."""
    try:
        return pa.array(values, kind)
    except UnicodeEncodeError:
        return pa.array([v.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if isinstance(v, str) else v for v in values], kind)


def batch(rows: list[tuple], of: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(of)
    return pa.RecordBatch.from_arrays([array(c, f.type) for c, f in zip(columns, of)], schema=of)
