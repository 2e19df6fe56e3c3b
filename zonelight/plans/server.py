"""A small HTTP endpoint: POST /sql and GET /health."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..sources.resolvers import HttpFileLists, HttpResolver, IndexStrategy, SnapshotResolver
from .session import ZoneSession

#: Bookkeeping columns that answers leave out.
RESERVED = ("__row_index", "__row_id", "__created_at")


def rows_as_json(df: DataFrame) -> list[dict[str, Any]]:
    """Rows as objects; null fields are left out."""
    return [json.loads(x) for x in df.toJSON().collect()] if df.columns else []


def answer(session: ZoneSession, sql: str) -> dict[str, Any]:
    """Columns and rows of a statement without the reserved columns."""
    result = session.run(sql)
    df = result.df.drop(*RESERVED)
    return {"columns": [{"name": c.name, "type": c.type} for c in result.columns if c.name not in RESERVED], "rows": rows_as_json(df)}


class SqlService:
    """Answers requests; every request has a Spark session and a resolver of its own."""

    def __init__(self, spark: SparkSession, resolver: Callable[[dict[str, tuple[str, str]]], SnapshotResolver], strategy: IndexStrategy | None = None, folder: str | None = None) -> None:
        self.spark, self.resolver, self.strategy, self.folder = spark, resolver, strategy, folder

    @staticmethod
    def over_http(spark: SparkSession, base_url: str, token: str = "") -> SqlService:
        return SqlService(spark, lambda tables: HttpResolver(HttpFileLists(base_url, token), tables))

    def handle(self, body: dict[str, Any]) -> tuple[int, Any]:
        """Status and answer of a request {sql, tables: {name: {dataset_id, namespace}}, limit?, user?}."""
        try:
            tables = {k.lower(): (v.get("namespace", "datasets"), v["dataset_id"]) for k, v in (body.get("tables") or {}).items()}
            session = ZoneSession.from_snapshots(self.spark.newSession(), self.resolver(tables), self.strategy, self.folder)
            out = answer(session, body["sql"])
        except Exception as e:  # noqa: BLE001  whatever binding or execution raises is the client's answer
            return 400, {"error": f"{type(e).__name__}: {e}".splitlines()[0]}
        try:
            json.dumps(out)
        except (TypeError, ValueError) as e:
            return 500, {"error": str(e)}
        return 200, out


def server(service: SqlService, host: str | None = None, port: int | None = None) -> ThreadingHTTPServer:
    """A server bound to ZONELIGHT_BIND (host:port), else to PORT, else to 0.0.0.0:8088."""
    bind = os.environ.get("ZONELIGHT_BIND") or f"0.0.0.0:{os.environ.get('PORT', '8088')}"
    own_host, _, own_port = bind.rpartition(":")

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, content: bytes, kind: str) -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(content)))
            self.end_headers()
            self.wfile.write(content)

        def do_GET(self) -> None:
            if self.path == "/health":
                self._send(200, b"ok", "text/plain")
            else:
                self._send(404, b"", "text/plain")

        def do_POST(self) -> None:
            if self.path != "/sql":
                return self._send(404, b"", "text/plain")
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))
            except ValueError as e:
                return self._send(400, json.dumps({"error": str(e)}).encode(), "application/json")
            status, out = service.handle(body)
            return self._send(status, json.dumps(out).encode(), "application/json")

        def log_message(self, *_: Any) -> None:  # noqa: ANN401
            pass

    return ThreadingHTTPServer((host or own_host, own_port and int(own_port) if port is None else port), Handler)
