"""arrow_cast(x, 'Type'): casts whose type is written as an Arrow type."""

from __future__ import annotations

import re

from ..errors import UnsupportedType
from .calls import Call, rewritten, text_of

# Names of Arrow types, and what Spark calls them.
TYPES = {"Boolean": "BOOLEAN", "Int8": "TINYINT", "Int16": "SMALLINT", "Int32": "INT", "Int64": "BIGINT", "Float32": "FLOAT", "Float64": "DOUBLE", "Utf8": "STRING", "LargeUtf8": "STRING", "Utf8View": "STRING", "Binary": "BINARY", "LargeBinary": "BINARY", "Date32": "DATE"}
_UNITS = {"Second": 1, "Millisecond": 1_000, "Microsecond": 1_000_000}
_TIMESTAMP = re.compile(r"Timestamp\(\s*(\w+)\s*,\s*(?:None|Some\(\s*\"([^\"]*)\"\s*\))\s*\)$")
_DECIMAL = re.compile(r"Decimal(?:32|64|128)\(\s*(\d+)\s*,\s*(\d+)\s*\)$")
_WHOLE = re.compile(r"\s*[+-]?\d+[lL]?\s*$")


def cast_text(value: str, kind: str) -> str:
    """SQL that casts an expression to an Arrow type.

    A whole number written out is a count of units since 1970 where the type is a timestamp, as Spark itself would
    count seconds; other expressions are cast as they are.
    """
    kind = kind.strip()
    if kind in TYPES:
        return f"CAST({value} AS {TYPES[kind]})"
    if m := _DECIMAL.match(kind):
        return f"CAST({value} AS DECIMAL({m[1]},{m[2]}))"
    if (m := _TIMESTAMP.match(kind)) and m[1] in _UNITS:
        target, epoch = ("TIMESTAMP", "TIMESTAMP '1970-01-01 00:00:00Z'") if m[2] else ("TIMESTAMP_NTZ", "TIMESTAMP_NTZ '1970-01-01 00:00:00'")
        if _WHOLE.match(value):
            return f"({epoch} + make_dt_interval(0, 0, 0, CAST(CAST({value} AS DECIMAL(20,0)) / {_UNITS[m[1]]} AS DECIMAL(18,6))))"
        return f"CAST({value} AS {target})"
    raise UnsupportedType(f"arrow_cast to {kind}")


def rewrite_casts(sql: str, spans: list[tuple[int, int]]) -> str:
    """SQL with arrow_cast calls spelt as Spark's casts."""

    def new(call: Call) -> str | None:
        kind = text_of(call.args[1]) if len(call.args) == 2 else None
        return None if kind is None else cast_text(call.args[0].strip(), kind)

    return rewritten(sql, spans, "arrow_cast", new)
