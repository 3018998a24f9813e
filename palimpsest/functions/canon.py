"""Canonical JSON text, hash payloads and codecs as Columns.

``json_text`` writes struct fields in order of declaration, map keys sorted, nulls kept, integral floats without a
fraction, other floats in their shortest form (exponent below 1e-6 and from 1e21 on), and <, > and & escaped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.model import DiffFallback


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once and written once, where it is long and body uses it often."""
    return F.transform(F.array(value), body)[0]


def fit(text: Column, kind: str) -> Column:
    """The text in a Spark type; null if it has no such form. Fractions are rounded to whole numbers, halves away from zero."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.round(text.try_cast("decimal(38,18)")).try_cast(kind)
    if kind in ("float", "double"):
        # Java takes 1d and 0x1p3 for numbers
        return F.when(~text.rlike(r"[0-9.][dDfF]\s*$|[xX]"), text).try_cast(kind)
    return text.try_cast(kind)


def json_string(c: Column) -> Column:
    """A JSON string literal; null for null. Texts without special characters, nearly all, are just quoted."""
    text = F.to_json(c.cast("variant"))
    for raw, escaped in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return F.when(c.rlike(r'["\\<>&\x00-\x1f\x7f\u2028\u2029]'), text).otherwise(F.concat(F.lit('"'), c, F.lit('"')))


def _float(c: Column) -> Column:
    size = F.abs(c)
    text = size.cast("string")
    parts = F.split(text, "E")
    exponent = F.try_element_at(parts, F.lit(2)).cast("int")
    digits = F.rtrim(F.replace(parts[0], F.lit("."), F.lit("")), F.lit("0"))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    large = F.when(F.length(digits) <= exponent + 1, F.rpad(digits, exponent + 1, F.lit("0"))).otherwise(F.concat(F.substring(digits, F.lit(1), exponent + 1), F.lit("."), F.substring(digits, exponent + 2, F.length(digits))))
    mantissa = F.regexp_replace(parts[0], r"\.0$", "")
    power = F.concat(mantissa, F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    plain = F.when(exponent.isNull(), F.regexp_replace(text, r"\.0$", "")).when((exponent < 0) & (exponent >= -6), small).when((exponent >= 0) & (exponent < 21), large).otherwise(power)
    return F.concat(F.when((c < 0) | (c.cast("string") == "-0.0"), "-").otherwise(""), plain)


def json_text(c: Column, kind: T.DataType) -> Column:
    """JSON text of a value of the given type; ``null`` for null."""
    if isinstance(kind, T.StringType):
        text = json_string(c)
    elif isinstance(kind, (T.BooleanType, T.IntegralType, T.DecimalType)):
        text = c.cast("string")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = _float(c)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        stamp = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        text = F.concat(F.lit('"'), F.regexp_replace(stamp, r"\.?0+$", ""), F.lit('Z"'))
        text = F.when(F.date_format(c, "SSSSSS") == "000000", F.concat(F.lit('"'), F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit('Z"'))).otherwise(text)
    elif isinstance(kind, T.DateType):
        text = F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    elif isinstance(kind, T.BinaryType):
        text = F.concat(F.lit('"'), base64(c), F.lit('"'))
    elif isinstance(kind, T.VariantType):
        text = F.to_json(c)
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda e: json_text(e, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        keys = F.array_sort(F.map_keys(c))
        members = F.transform(keys, lambda k: F.concat(json_string(k), F.lit(":"), json_text(F.element_at(c, k), kind.valueType)))
        text = F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))
    elif isinstance(kind, T.StructType):
        members = [F.concat(F.lit('"' + f.name + '":'), json_text(c[f.name], f.dataType)) for f in kind.fields]
        text = F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))
    else:
        raise DiffFallback(f"no JSON form for {kind.simpleString()}")
    return F.when(c.isNull(), F.lit("null")).otherwise(text)


def base64(c: Column) -> Column:
    """Without the line breaks that Spark puts after every 76 characters."""
    return F.translate(F.base64(c), "\r\n", "")


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def crc32(c: Column) -> Column:
    return F.crc32(c)


def strip_nul(c: Column) -> Column:
    return F.translate(c, "\0", "")


def chain_parts(entity_type: Column, entity_id: Column, data: Column) -> tuple[Column, Column]:
    """What a version's hash is taken of, before its version and between its version and the hash before."""
    head = F.concat(F.lit('{"entity_type":'), json_string(entity_type), F.lit(',"entity_id":'), json_string(entity_id), F.lit(',"version":'))
    return head, F.concat(F.lit(',"data":"'), base64(F.coalesce(data.cast("binary"), F.lit(b""))), F.lit('","previous_hash":'))


def chain_payload(entity_type: Column, entity_id: Column, version: Column, data: Column, previous_hash: Column) -> Column:
    """What a version's hash is taken of. data goes in as base64; the first version's previous_hash as ''."""
    head, tail = chain_parts(entity_type, entity_id, data)
    return F.concat(head, version.cast("string"), tail, json_string(F.coalesce(previous_hash, F.lit(""))), F.lit("}"))
