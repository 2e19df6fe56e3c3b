"""get_json_object on paths of the forms $, .key, [n], ['key'] and ["key"], blanks inside brackets allowed."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .calls import Call, rewritten, text_of

_STEP = re.compile(r"\.([^.\[]+)|\[\s*(?:'([^\]]*)'|\"([^\]]*)\"|(\d+))\s*\]")


def normal_path(path: str) -> str | None:
    """The path as Spark's built-in wants it; None where the result is NULL for every document."""
    if not path.startswith("$"):
        return None
    at, out = 1, "$"
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            return None
        dotted, single, double, index = m.groups()
        if index is not None:
            out += f"[{int(index)}]"
        else:
            key = next(k for k in (dotted, single, double) if k is not None)
            if "'" in key or key == "*" or not key:
                return None
            out += f"['{key}']"
        at = m.end()
    return out


#: What a whole path must look like, and how quoted steps come to be as Spark's built-in wants them.
_WHOLE = r"""^[$](?:[.][^.\[]+|\[\s*(?:'[^'\]*]+'|"[^"'\]*]+"|[0-9]+)\s*\])*$"""
_QUOTED = r"""\[\s*["']([^"'\]]+)["']\s*\]"""
_INDEX = r"\[\s*0*([0-9]+)\s*\]"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def path_sql(json: str, path: str) -> str:
    """SQL of get_json_object where the path is an expression: made normal row by row, NULL where it is none."""
    normal = f"regexp_replace(regexp_replace({path}, {_sql(_QUOTED)}, {_sql("['$1']")}), {_sql(_INDEX)}, '[$1]')"
    return f"CASE WHEN {path} RLIKE {_sql(_WHOLE)} THEN get_json_object({json}, {normal}) END"


def get_json_object(json: Column | str, path: str | Column) -> Column:
    """Strings without quotes, other leaves and documents as compact JSON; NULL for what is missing, null or no JSON.

    The path is text, or a column with a path for each row.
    """
    if isinstance(path, Column):
        normal = F.regexp_replace(F.regexp_replace(path, _QUOTED, "['$1']"), _INDEX, "[$1]")
        return F.when(path.rlike(_WHOLE), F.call_function("get_json_object", F.col(json) if isinstance(json, str) else json, normal))
    p = normal_path(path)
    return F.lit(None).cast("string") if p is None else F.get_json_object(json, p)


def rewrite_paths(sql: str, spans: list[tuple[int, int]]) -> str:
    """SQL with the paths of get_json_object calls made normal.  spans: string literals and comments, which calls don't start in."""

    def new(call: Call) -> str | None:
        if len(call.args) != 2:
            return None
        json, path = (x.strip() for x in call.args)
        text = text_of(path)
        if text is None:
            return path_sql(json, path)
        p = normal_path(text)
        return "CAST(NULL AS STRING)" if p is None else f"get_json_object({json}, {_sql(p)})"

    return rewritten(sql, spans, "get_json_object", new)
