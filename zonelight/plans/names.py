"""SQL text: where its literals, comments and table names are."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession

_QUIET = re.compile(r"'(?:[^'\\]|''|\\.)*'|\"(?:[^\"\\]|\"\"|\\.)*\"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/", re.S)
_ALIAS = re.compile(r"\s*(?:(?:AS\s+)?(`(?:[^`]|``)+`|[A-Za-z_]\w*))", re.I)
#: Words that may follow a table name and are no alias of it.
_CLAUSES = set("ON USING WHERE GROUP HAVING ORDER LIMIT OFFSET UNION INTERSECT EXCEPT MINUS JOIN INNER LEFT RIGHT FULL CROSS NATURAL SEMI ANTI LATERAL WINDOW CLUSTER DISTRIBUTE SORT TABLESAMPLE PIVOT UNPIVOT SET VERSION TIMESTAMP FOR SYSTEM_TIME SYSTEM_VERSION AND OR THEN WITH SELECT FROM QUALIFY".split())


#: Expressions that hold a plan.
_SUBQUERIES = {"ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"}


def quiet_spans(sql: str) -> list[tuple[int, int]]:
    """Spans of string literals, quoted names and comments."""
    return [m.span() for m in _QUIET.finditer(sql)]


@dataclass(frozen=True)
class Occurrence:
    """A table name in a statement: its parts and its place."""

    parts: tuple[str, ...]
    start: int
    stop: int


def _seq(s: Any) -> list:  # noqa: ANN401
    return [s.apply(i) for i in range(s.size())]


def parse(spark: SparkSession, sql: str) -> Any:  # noqa: ANN401
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)


def occurrences(plan: Any) -> list[Occurrence]:  # noqa: ANN401
    """The tables that a parsed statement names, without those that a visible CTE defines."""
    found: dict[tuple[int, int], Occurrence] = {}

    def walk(node: Any, defined: frozenset) -> None:  # noqa: ANN401
        name = node.getClass().getSimpleName()
        if name == "UnresolvedWith":
            inner = defined
            for r in _seq(node.cteRelations()):
                walk(r._2(), inner)
                inner = inner | {r._1().lower()}
            walk(node.child(), inner)
            return
        if name == "UnresolvedRelation":
            parts = tuple(_seq(node.multipartIdentifier()))
            origin = node.origin()
            if not (len(parts) == 1 and parts[0].lower() in defined) and origin.startIndex().isDefined():
                at = Occurrence(parts, origin.startIndex().get(), origin.stopIndex().get() + 1)
                found[at.start, at.stop] = at
        for c in _seq(node.children()):
            walk(c, defined)
        for e in _seq(node.expressions()):
            walk_expression(e, defined)

    def walk_expression(e: Any, defined: frozenset) -> None:  # noqa: ANN401
        if e.getClass().getSimpleName() in _SUBQUERIES:
            walk(e.plan(), defined)
        for c in _seq(e.children()):
            walk_expression(c, defined)

    walk(plan, frozenset())
    return sorted(found.values(), key=lambda o: o.start)


def spliced(sql: str, names: dict[Occurrence, str]) -> str:
    """SQL with each occurrence replaced by a view, aliased to its last part where it has no alias."""
    out = sql
    for at in sorted(names, key=lambda o: -o.start):
        after = _ALIAS.match(sql, at.stop)
        aliased = bool(after) and after[1].upper() not in _CLAUSES
        new = f"`{names[at]}`" + ("" if aliased else f" AS `{at.parts[-1]}`")
        out = out[: at.start] + new + out[at.stop :]
    return out
