"""Removing values from stored records."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from palimpsest.functions import arrow, jsonval

REDACTED = "[REDACTED]"


class _Number(str):
    """A number as it was spelled."""


def _refuse(name: str):
    raise ValueError(name)


_decode = json.JSONDecoder(parse_float=_Number, parse_int=_Number, parse_constant=_refuse).decode


def _leaf(value) -> str:
    return str(value) if isinstance(value, _Number) else json.dumps(value, ensure_ascii=False)


def redact_json(text: str | None, path: str) -> str | None:
    """The text with the member at the dotted path replaced; unchanged if there is none or it is no JSON object.

    Names come out sorted, numbers as they were spelled.
    """
    try:
        value = jsonval.load(text, _decode, (_Number, _Number)) if text else None
    except ValueError:
        return text
    *head, tail = path.split(".")
    at = value
    for p in head:
        at = at.get(p) if isinstance(at, dict) else None
    if not isinstance(at, dict) or tail not in at:
        return text
    at[tail] = REDACTED
    return jsonval.spell(value, _leaf, True)


def redact_text(c: Column | str, path: str) -> Column:
    """Rows whose text can't hold the member's name don't go to Python."""
    @F.arrow_udf(StringType())
    def run(texts: pa.Array) -> pa.Array:
        return arrow.array([redact_json(t, path) for t in texts.to_pylist()], pa.string())

    c = F.col(c) if isinstance(c, str) else c
    name = path.rsplit(".", 1)[-1]
    hit = c.contains(name) | c.contains("\\u")
    return F.when(hit, run(F.when(hit, c))).otherwise(c)


def redact_field(df: DataFrame, path: str, deltas: bool = True) -> DataFrame:
    """All version records with the field's value replaced, in data and (``deltas``) in the changes that hold it.

    Hashes are kept, so a chain over redacted records no longer verifies; compute it anew if it has to.
    """
    out = df.withColumn("data", redact_text("data", path))
    if deltas and "delta" in df.columns:
        mark = F.lit(json.dumps(REDACTED))
        hide = lambda v: F.when(v.isNotNull(), mark)
        mine = lambda c: (c["path"] == path) | c["path"].startswith(path + ".")
        holds = lambda c: F.lit(path).startswith(F.concat(c["path"], F.lit(".")))
        inner = F.transform("delta", lambda c: F.struct(c["path"].alias("path"), F.when(mine(c) | holds(c), hide(c["old_value"])).otherwise(c["old_value"]).alias("old_value"), F.when(mine(c) | holds(c), hide(c["new_value"])).otherwise(c["new_value"]).alias("new_value")))
        out = out.withColumn("delta", inner)
    return out


def count_redacted(before: DataFrame, path: str) -> int:
    return before.where(~redact_text("data", path).eqNullSafe(F.col("data"))).count()
