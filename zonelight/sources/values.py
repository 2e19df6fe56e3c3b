"""Typed single values: comparison, their bytes as bounds, and their bytes under a hash.

A value is a pair (kind, payload): int, float, bool, bytes, date (days), time and ts (microseconds) hold
Python numbers or bytes; decimal holds (unscaled, scale); null holds None.
"""

from __future__ import annotations

import datetime as dt
import math
import re
import struct
from decimal import Decimal
from typing import Any, NamedTuple

from pyspark.sql import types as T

from ..errors import MissingType, Truncated


class Value(NamedTuple):
    kind: str
    v: Any


NULL = Value("null", None)
_EPOCH = dt.datetime(1970, 1, 1)
_FIXED = {"boolean": ("<?", "bool"), "int": ("<i", "int"), "long": ("<q", "int"), "float": ("<f", "float"), "double": ("<d", "float"), "date": ("<i", "date"), "time": ("<q", "time"), "timestamp": ("<q", "ts"), "timestamptz": ("<q", "ts")}
_FALLBACK = {"int": "long", "float": "double", "bool": "boolean", "date": "date", "time": "time", "ts": "timestamp", "bytes": "string"}


def decimal_scale(kind: str) -> int | None:
    """The scale of a type written decimal(p,s) or decimal(s)."""
    m = re.fullmatch(r"decimal\((?:\d+ *, *)?(\d+)\)", kind)
    return int(m[1]) if m else None


def type_of_spark(t: T.DataType) -> str | None:
    """The table type of a Spark type, None where it can't be indexed."""
    if isinstance(t, T.DecimalType):
        return f"decimal({t.precision},{t.scale})"
    if isinstance(t, T.StringType):
        return "string" if getattr(t, "collation", "UTF8_BINARY") in (None, "UTF8_BINARY") else None
    return {T.BooleanType: "boolean", T.IntegerType: "int", T.LongType: "long", T.FloatType: "float", T.DoubleType: "double", T.DateType: "date", T.TimestampNTZType: "timestamp", T.TimestampType: "timestamptz", T.BinaryType: "binary"}.get(type(t))


def compare(a: Value, b: Value) -> int | None:
    """-1, 0 or 1; None where the two can't be ordered: other kinds, null, NaN, decimals of unequal scale."""
    if a.kind != b.kind or a.kind == "null":
        return None
    x, y = a.v, b.v
    if a.kind == "decimal":
        if x[1] != y[1]:
            return None
        x, y = x[0], y[0]
    if a.kind == "float" and (math.isnan(x) or math.isnan(y)):
        return None
    return (x > y) - (x < y)


def integer_bytes(n: int) -> bytes:
    """Two's complement, big-endian, as few bytes as keep the sign."""
    size = (n if n >= 0 else ~n).bit_length() // 8 + 1
    return n.to_bytes(size, "big", signed=True)


def bound_bytes(value: Value, kind: str | None = None) -> bytes:
    """Bytes of a bound of a field of type ``kind``; empty for null.

    A value that doesn't fit the type is written as its own kind says.
    """
    if value.kind == "null":
        return b""
    if value.kind == "decimal":
        return integer_bytes(value.v[0])
    if value.kind == "bytes":
        return value.v
    if kind not in _FIXED or _FIXED[kind][1] != value.kind:
        kind = _FALLBACK[value.kind]
    return struct.pack(_FIXED[kind][0], value.v)


def bound_value(raw: bytes, kind: str | None) -> Value:
    """The bound that bytes of a field of type ``kind`` stand for; empty bytes are an absent bound."""
    if not raw:
        return NULL
    if kind is None:
        raise MissingType("a bound of a field without a type")
    if kind in ("string", "binary"):
        return Value("bytes", bytes(raw))
    scale = decimal_scale(kind)
    if scale is not None:
        return Value("decimal", (int.from_bytes(raw, "big", signed=True), scale))
    if kind not in _FIXED:
        raise MissingType(kind)
    form, own = _FIXED[kind]
    if len(raw) != struct.calcsize(form):
        raise Truncated(f"{len(raw)} bytes of a {kind}")
    return Value(own, struct.unpack(form, raw)[0])


def hash_bytes(value: Value) -> bytes | None:
    """Bytes that a Bloom filter hashes: integers and floats as 8 bytes; None for null.

    Equal values must hash alike, so -0.0 counts as 0.0 and all NaN as one.
    """
    k, v = value
    if k == "null":
        return None
    if k == "bytes":
        return v
    if k == "decimal":
        return integer_bytes(v[0])
    if k == "float":
        return struct.pack("<d", math.nan if math.isnan(v) else v + 0.0)
    return struct.pack({"int": "<q", "bool": "<?", "date": "<i", "time": "<q", "ts": "<q"}[k], v)


def microseconds(t: dt.datetime) -> int:
    d = (t.astimezone(dt.timezone.utc).replace(tzinfo=None) if t.tzinfo else t) - _EPOCH
    return (d.days * 86400 + d.seconds) * 1_000_000 + d.microseconds


def literal(x: Any, kind: str | None = None) -> Value | None:  # noqa: ANN401
    """The value of a Python literal compared with a column of type ``kind``; None where it can't be told exactly.

    Decimals take the column's scale if that loses nothing.
    """
    if x is None:
        return None
    scale = decimal_scale(kind or "")
    if scale is not None and isinstance(x, (int, Decimal)) and not isinstance(x, bool):
        shifted = Decimal(x).scaleb(scale)
        return Value("decimal", (int(shifted), scale)) if shifted == int(shifted) else None
    if isinstance(x, bool):
        return Value("bool", x)
    if isinstance(x, int):
        if kind in ("float", "double"):
            return Value("float", float(x)) if int(float(x)) == x else None
        return Value("int", x) if kind in (None, "int", "long") and -(1 << 63) <= x < 1 << 63 else None
    if isinstance(x, float):
        return Value("float", x) if kind in (None, "float", "double") else None
    if isinstance(x, Decimal):
        return Value("decimal", (int(x.scaleb(-x.as_tuple().exponent)), -x.as_tuple().exponent))
    if isinstance(x, str):
        return Value("bytes", x.encode())
    if isinstance(x, (bytes, bytearray)):
        return Value("bytes", bytes(x))
    if isinstance(x, dt.datetime):
        return Value("ts", microseconds(x))
    if isinstance(x, dt.date):
        return Value("date", (x - dt.date(1970, 1, 1)).days)
    if isinstance(x, dt.time):
        return Value("time", ((x.hour * 60 + x.minute) * 60 + x.second) * 1_000_000 + x.microsecond)
    return None
