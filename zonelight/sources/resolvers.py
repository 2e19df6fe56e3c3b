"""Where tables come from: names to files."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import SparkSession

from ..errors import ConfigError
from ..operators.build import IndexField, listed
from ..operators.scan import ZoneTable
from .avro import read_avro
from .files import S3Config, normal_uri, opened


@dataclass(frozen=True)
class ResolvedSnapshot:
    """The data files of one version of a table, and the store they lie in."""

    files: list[str]
    store: S3Config | None = None
    has_deletes: bool = False


class SnapshotResolver(Protocol):
    """Between a catalog and the reader: a table's name to its files."""

    def resolve(self, table: str) -> ResolvedSnapshot | None: ...


class TableResolver(Protocol):
    """A full name (catalog.schema.table) to a table; None if it is absent or not to be seen."""

    def resolve_table(self, fqn: str) -> ZoneTable | None: ...


class IndexStrategy(Protocol):
    """Which columns of a table to index."""

    def fields(self, fqn: str) -> list[IndexField]: ...


class NoIndex:
    def fields(self, fqn: str) -> list[IndexField]:  # noqa: ARG002
        return []


@dataclass
class FixedIndex:
    """The same fields for all tables, or by the last part of their names."""

    default: list[IndexField] = field(default_factory=list)
    by_table: dict[str, list[IndexField]] = field(default_factory=dict)

    def fields(self, fqn: str) -> list[IndexField]:
        return self.by_table.get(fqn.rpartition(".")[2], self.default)


@dataclass
class FileListResolver:
    """Tables by full or last name (in any case), as lists of file URIs."""

    tables: dict[str, list[str]]
    store: S3Config | None = None

    def resolve(self, table: str) -> ResolvedSnapshot | None:
        known = {k.lower(): v for k, v in self.tables.items()}
        files = known.get(table.lower(), known.get(table.rpartition(".")[2].lower()))
        return ResolvedSnapshot([normal_uri(f) for f in files], self.store) if files is not None else None


@dataclass
class SnapshotTableResolver:
    """Tables from snapshots, indexed as a strategy says.  Only absence is absence; failures are raised."""

    spark: SparkSession
    snapshots: SnapshotResolver
    strategy: IndexStrategy = field(default_factory=NoIndex)
    folder: str | None = None

    def resolve_table(self, fqn: str) -> ZoneTable | None:
        found = self.snapshots.resolve(fqn)
        if found is None:
            return None
        if found.has_deletes:
            raise ConfigError(f"{fqn} has delete files, which this reader doesn't apply")
        if not found.files:
            raise ConfigError(f"{fqn} has no data files")
        table = ZoneTable(self.spark, found.files, self.strategy.fields(fqn), self.folder, found.store)
        table.index()
        return table


@dataclass
class HttpFileLists:
    """A service that plans files: POST {base}/lakehouse/plan-files with a bearer token."""

    base_url: str
    token: str = ""
    timeout: float = 30.0
    post: Callable[[str, dict, dict], dict] | None = None

    def plan_files(self, namespace: str, dataset_id: str) -> list[str]:
        url, body = f"{self.base_url.rstrip('/')}/lakehouse/plan-files", {"namespace": namespace, "dataset_id": dataset_id}
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})
        if self.post:
            return list(self.post(url, body, head).get("files", []))
        request = urllib.request.Request(url, json.dumps(body).encode(), head)  # noqa: S310
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:  # noqa: S310
            return list(json.load(answer).get("files", []))


@dataclass
class HttpResolver:
    """Snapshots of the tables that a request names: {table: (namespace, dataset id)}."""

    service: HttpFileLists
    tables: dict[str, tuple[str, str]]
    store: S3Config | None = None

    def resolve(self, table: str) -> ResolvedSnapshot | None:
        known = self.tables.get(table.lower()) or self.tables.get(table.rpartition(".")[2].lower())
        if known is None:
            return None
        files = self.service.plan_files(*known)
        return ResolvedSnapshot([normal_uri(f) for f in files], self.store) if files else None


@dataclass
class RestCatalogResolver:
    """Tables of an Iceberg REST catalog, by the names in it: the data files of a table's current snapshot.

    The catalog gives a table's metadata; the manifest list is read here, the manifests by the executors.  A name has
    as many parts as the catalog's namespaces need; ``skip`` leading parts (a catalog's own name, say) are left out.
    A table that the catalog doesn't have is None; any other failure is raised.
    """

    spark: SparkSession
    base_url: str
    token: str = ""
    warehouse: str = ""
    store: S3Config | None = None
    skip: int = 0
    timeout: float = 30.0
    get: Callable[[str, dict], dict | None] | None = None
    _prefix: str | None = None

    def _get(self, path: str) -> dict | None:
        url, head = f"{self.base_url.rstrip('/')}/v1/{path}", {"Authorization": f"Bearer {self.token}"} if self.token else {}
        if self.get:
            return self.get(url, head)
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=head), timeout=self.timeout) as answer:  # noqa: S310
                return json.load(answer)
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return None
            raise

    def resolve(self, table: str) -> ResolvedSnapshot | None:
        if self._prefix is None:
            found = self._get("config" + (f"?warehouse={quote(self.warehouse, safe='')}" if self.warehouse else "")) or {}
            self._prefix = {**found.get("defaults", {}), **found.get("overrides", {})}.get("prefix", "")
        *space, name = table.split(".")[self.skip :]
        if not space:
            raise ConfigError(f"{table} has no namespace")
        lead = f"{self._prefix}/" if self._prefix else ""
        loaded = self._get(f"{lead}namespaces/{quote(chr(0x1F).join(space), safe='')}/tables/{quote(name, safe='')}")
        if loaded is None:
            return None
        meta = loaded["metadata"]
        current = next((x for x in meta.get("snapshots", []) if x["snapshot-id"] == meta.get("current-snapshot-id")), None)
        if current is None:
            return ResolvedSnapshot([], self.store)
        manifests = self._manifests(current)
        rows = self._entries(manifests)
        return ResolvedSnapshot([normal_uri(p) for p, content in rows if content == 0], self.store, any(content != 0 for _, content in rows))

    def _manifests(self, snapshot: dict) -> list[str]:
        if "manifest-list" not in snapshot:
            return list(snapshot.get("manifests", []))
        fs, path = opened(snapshot["manifest-list"], self.store)
        with fs.open_input_file(path) as f:
            return [m["manifest_path"] for m in read_avro(f.read())]

    def _entries(self, manifests: list[str]) -> list[tuple[str, int]]:
        """(path, content) of every live file: 0 for data, others for deletes."""
        if not manifests:
            return []
        store = self.store

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for uri in batch.column("uri").to_pylist():
                    fs, path = opened(uri, store)
                    with fs.open_input_file(path) as f:
                        live = [e["data_file"] for e in read_avro(f.read()) if e["status"] != 2]
                    yield pa.record_batch([pa.array([d["file_path"] for d in live], pa.string()), pa.array([d.get("content") or 0 for d in live], pa.int32())], names=["path", "content"])

        rows = listed(self.spark, manifests).mapInArrow(run, "path string, content int").collect()
        return sorted((r["path"], r["content"]) for r in rows)


@dataclass
class CatalogResolver:
    """Tables of a catalog that the session has a Spark catalog for (its connector must be on the class path)."""

    spark: SparkSession
    catalog: str

    def resolve(self, table: str) -> ResolvedSnapshot | None:
        if not self.spark.conf.get(f"spark.sql.catalog.{self.catalog}", None):
            raise ConfigError(f"no Spark catalog {self.catalog} is set up")
        name = ".".join(f"`{p}`" for p in [self.catalog, *table.split(".")[-2:]])
        rows = self.spark.sql(f"SELECT content, file_path FROM {name}.files").collect()
        return ResolvedSnapshot([normal_uri(r["file_path"]) for r in rows if r["content"] == 0], None, any(r["content"] != 0 for r in rows))
