"""Pruned scans.

Tier A re-plans: a query is planned over all files, the filters that Spark pushed to each scan are
translated and held against the sidecars, and the scan is repeated over the files that survive.  Spark
applies every filter again, so rows are the same with or without an index; row groups within surviving files
are pruned by the reader itself.  Tier C reads exactly the surviving row groups through a data source that
gets their list when it is loaded; one load serves one occurrence of a table in one query.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from ..sources.files import S3Config, opened, reachable
from ..sources.values import Value, literal
from .build import IndexField, Sidecar, build_index, build_sidecar, listed, load_sidecar, surviving_groups
from .prune import FLIPPED, Predicate

_JVM_OPS = {"EqualTo": "=", "EqualNullSafe": "=", "LessThan": "<", "LessThanOrEqual": "<=", "GreaterThan": ">", "GreaterThanOrEqual": ">="}
OCCURRENCE = "zonelight.occurrence"


def _seq(s: Any) -> list:  # noqa: ANN401
    return [s.apply(i) for i in range(s.size())]


def _jvm_value(expr: Any, kind: str | None) -> Value | None:  # noqa: ANN401
    """The value of a literal expression of the plan."""
    if expr.getClass().getSimpleName() != "Literal":
        return None
    return _catalyst_value(expr.value(), expr.dataType().typeName(), kind)


def _catalyst_value(v: Any, name: str, kind: str | None) -> Value | None:  # noqa: ANN401
    """A value as plans hold it, of the type of that name."""
    if v is None:
        return None
    if name in ("string", "varchar", "char") or name.startswith("string"):
        return Value("bytes", v.toString().encode())
    if name.startswith("decimal"):
        return literal(Decimal(v.toString()), kind)
    if name == "date":
        return Value("date", int(v))
    if name in ("timestamp", "timestamp_ntz"):
        return Value("ts", int(v))
    if isinstance(v, (bool, int, float, str)):
        return literal(v, kind)
    return None


def jvm_predicates(expr: Any, types: dict[str, tuple[int, str]]) -> list[Predicate]:  # noqa: ANN401
    """Predicates that a filter of the plan implies; what can't be translated implies none.

    types: field id and table type of each indexed column.
    """
    name = expr.getClass().getSimpleName()
    children = _seq(expr.children())
    if name == "And":
        return [p for c in children for p in jvm_predicates(c, types)]

    def column(e: Any) -> tuple[int, str] | None:  # noqa: ANN401
        return types.get(e.name()) if e.getClass().getSimpleName() == "AttributeReference" else None

    if name in _JVM_OPS and len(children) == 2:
        left, right = children
        for c, v, op in ((left, right, _JVM_OPS[name]), (right, left, FLIPPED[_JVM_OPS[name]])):
            if (known := column(c)) and (value := _jvm_value(v, known[1])):
                return [Predicate.of(known[0], op, value)]
    elif name in ("In", "InSet") and (known := column(children[0])):
        if name == "In":
            values = [_jvm_value(v, known[1]) for v in children[1:]]
        else:  # what a long list becomes
            kind, found, values = children[0].dataType().typeName(), expr.hset().iterator(), []
            while found.hasNext():
                values.append(_catalyst_value(found.next(), kind, known[1]))
        if values and all(values):
            return [Predicate.of(known[0], "IN", *values)]
    return []


def python_predicates(filters: list[tuple], field_ids: dict[str, int], types: dict[int, str]) -> list[Predicate]:
    """Predicates of filters given as (column, op, literal), op one of = < <= > >= IN; others are ignored."""
    out = []
    for name, op, x in filters:
        fid = field_ids.get(name)
        if fid is None:
            continue
        values = [literal(v, types.get(fid)) for v in (x if op == "IN" else [x])]
        if values and all(v is not None for v in values) and op in (*FLIPPED, "IN"):
            out.append(Predicate.of(fid, op, *values))
    return out


#: Files up to which the driver prunes by itself, holding their bounds; more are pruned on the executors.
LOCAL_FILES = 64


@dataclass
class ZoneTable:
    """A set of Parquet files with their sidecars: one table of one snapshot.

    The driver holds file names and, of at most LOCAL_FILES files, their bounds; Bloom filters are read where they are
    asked and kept nowhere.  Beyond that many files the executors read the sidecars, each its share, and the driver
    gets the row groups that survive.  Files that only Spark's own file systems reach have no index and are read whole.
    """

    spark: SparkSession
    uris: list[str]
    fields: list[IndexField] = field(default_factory=list)
    folder: str | None = None
    store: S3Config | None = None
    pruning: bool = True
    #: What the last pruned scan read: row groups by file.
    last_scan: dict[str, list[int]] = field(default_factory=dict)
    #: Row groups of each indexed file, as far as pruning has met them.
    group_counts: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        #: Bounds by file; whole sidecars where no folder keeps them.
        self._sidecars: dict[str, Sidecar] = {}
        self._schema: StructType | None = None
        self._indexed = bool(self.fields) and all(reachable(u, self.store) for u in self.uris[:1])

    @property
    def schema(self) -> StructType:
        """The schema of the first file, which all files share."""
        if self._schema is None:
            if not self.uris:
                self._schema = StructType()
            elif self._native:
                self._schema = self.spark.read.options(**self._options).parquet(self.uris[0]).schema
            else:
                fs, path = opened(self.uris[0], self.store)
                with fs.open_input_file(path) as f:
                    self._schema = from_arrow_schema(pq.read_schema(f))
        return self._schema

    @property
    def _options(self) -> dict[str, str]:
        return self.store.read_options() if self.store else {}

    @property
    def _native(self) -> bool:
        """Whether Spark's own reader can open the files: those of an object store need its connector."""
        if not self.uris or not self.uris[0].startswith("s3"):
            return True
        try:
            self.spark._jvm.java.lang.Thread.currentThread().getContextClassLoader().loadClass("org.apache.hadoop.fs.s3a.S3AFileSystem")
        except Py4JJavaError:
            return False
        return True

    @property
    def _local(self) -> bool:
        return self.folder is None or len(self.uris) <= LOCAL_FILES

    def index(self) -> None:
        """Make sure that every file has a fresh sidecar; builds the missing ones on the executors."""
        if not self._indexed:
            return
        if self.folder is None:
            for u in self.uris:
                if u not in self._sidecars:
                    self._sidecars[u] = build_sidecar(u, self.fields, store=self.store)
            return
        stale = self._stale()
        build_index(self.spark, stale, self.fields, self.folder, store=self.store)
        if self._local:
            for u in stale:
                self._sidecars[u] = load_sidecar(u, self.folder, self.store, blooms=False)

    def _stale(self) -> list[str]:
        """Files without a fresh sidecar of all fields."""
        wanted, folder, store = {f.field_id for f in self.fields}, self.folder, self.store
        if self._local:
            self._sidecars = {u: s for u in self.uris if (s := load_sidecar(u, folder, store, blooms=False)) and wanted <= set(s.types)}
            return [u for u in self.uris if u not in self._sidecars]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [u for u in batch.column("uri").to_pylist() if not ((s := load_sidecar(u, folder, store, blooms=False)) and wanted <= set(s.types))]
                yield pa.record_batch([pa.array(out, pa.string())], names=["uri"])

        return sorted(r["uri"] for r in listed(self.spark, self.uris).mapInArrow(run, "uri string").collect())

    def sidecar(self, uri: str) -> Sidecar | None:
        """The whole index of one file, for inspection."""
        if not self._indexed:
            return None
        if self.folder is None:
            self.index()
            return self._sidecars.get(uri)
        return load_sidecar(uri, self.folder, self.store)

    def _bounds(self, uri: str) -> Sidecar | None:
        if self._indexed and uri not in self._sidecars:
            if self._local:
                self.index()
            else:
                return load_sidecar(uri, self.folder, self.store, blooms=False)
        return self._sidecars.get(uri)

    def types(self) -> dict[str, tuple[int, str]]:
        """Field id and type of each indexed column."""
        first = self._bounds(self.uris[0]) if self.uris else None
        return {n: (i, first.types[i]) for n, i in first.field_ids.items()} if first else {}

    def survivors(self, predicates: list[Predicate]) -> dict[str, list[int] | None]:
        """Row groups of each file that may hold matching rows; None for a file without an index."""
        predicates = predicates if self.pruning else []
        if not self._indexed:
            return dict.fromkeys(self.uris)
        if not self._local:
            return self._survivors_by_task(predicates)
        out: dict[str, list[int] | None] = {}
        for u in self.uris:
            side = self._bounds(u)
            if side is None:
                out[u] = None
                continue
            self.group_counts[u] = len(side.zone_map.zones)
            if kept := surviving_groups(side, predicates, self.folder, self.store):
                out[u] = kept
        return out

    def _survivors_by_task(self, predicates: list[Predicate]) -> dict[str, list[int] | None]:
        folder, store = self.folder, self.store

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for uri in batch.column("uri").to_pylist():
                    side = load_sidecar(uri, folder, store, blooms=False)
                    kept = None if side is None else surviving_groups(side, predicates, folder, store)
                    if kept is None or kept:
                        rows.append((uri, kept, 0 if side is None else len(side.zone_map.zones)))
                uris, zones, counts = list(zip(*rows, strict=True)) or [(), (), ()]
                yield pa.record_batch([pa.array(uris, pa.string()), pa.array(zones, pa.list_(pa.int32())), pa.array(counts, pa.int32())], names=["uri", "zones", "groups"])

        found = {r["uri"]: r for r in listed(self.spark, self.uris).mapInArrow(run, "uri string, zones array<int>, groups int").collect()}
        self.group_counts |= {u: r["groups"] for u, r in found.items() if r["zones"] is not None}
        return {u: found[u]["zones"] for u in self.uris if u in found}

    def zone_stats(self) -> DataFrame:
        """(uri, zone_id, row_count, field_id, null_count, value_count) of every row group and indexed column, read by the executors."""
        self.index()
        folder, store, own = self.folder, self.store, self._sidecars if self.folder is None else {}
        schema = "uri string, zone_id int, row_count long, field_id int, null_count long, value_count long"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for uri in batch.column("uri").to_pylist():
                    side = own.get(uri) or load_sidecar(uri, folder, store, blooms=False)
                    rows = [(uri, z.zone_id, z.row_count, c.field_id, c.null_count, c.value_count) for z in side.zone_map.zones for c in z.columns.values()]
                    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                    columns = list(zip(*rows, strict=True)) or [()] * 6
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

        return listed(self.spark, self.uris).mapInArrow(run, schema)

    def frame(self, uris: list[str] | None = None, occurrence: str = "") -> DataFrame:
        """A native scan of the files (all, or those given); without a connector for their store, one by row groups."""
        uris = self.uris if uris is None else uris
        if not uris:
            return self.spark.createDataFrame([], self.schema)
        if not self._native:
            return self.exact(dict.fromkeys(uris))
        return self.spark.read.schema(self.schema).options(**self._options).option(OCCURRENCE, occurrence).parquet(*uris)

    def exact(self, zones: dict[str, list[int] | None], columns: list[str] | None = None) -> DataFrame:
        """A scan of just these row groups, and of just these columns."""
        schema = StructType([f for f in self.schema.fields if columns is None or f.name in columns])
        units = [(u, k) for u, ks in zones.items() for k in (ks if ks is not None else [-1])]
        if not units:
            return self.spark.createDataFrame([], schema)
        source = RowGroupSource.of(self.store)
        self.spark.dataSource.register(source)
        return self.spark.read.format(source.name()).schema(schema).option("units", json.dumps(units)).load()

    def scan(self, filters: list[tuple], columns: list[str] | None = None, exact: bool = False) -> DataFrame:
        """Rows that meet all (column, op, literal) filters, read from what survives them."""
        from pyspark.sql import functions as F

        zones = self.survivors(python_predicates(filters, {n: i for n, (i, _) in self.types().items()}, {i: t for i, t in self.types().values()}))
        self.last_scan = {u: zones.get(u, []) for u in self.uris}
        wanted = None if columns is None else [*dict.fromkeys([*columns, *(f[0] for f in filters)])]
        df = self.exact(zones, wanted) if exact else self.frame(list(zones))
        for name, op, x in filters:
            c = F.col(name)
            df = df.where(c.isin(list(x)) if op == "IN" else {"=": c == x, "<": c < x, "<=": c <= x, ">": c > x, ">=": c >= x}[op])
        return df if columns is None else df.select(*columns)


class RowGroupSource(DataSource):
    """Reads listed row groups, one partition each.  Nothing is pushed to it: what it reads is fixed at load."""

    store: S3Config | None = None

    @staticmethod
    def of(store: S3Config | None) -> type[RowGroupSource]:
        """The source for files of a store, whose keys stay out of options and plans."""
        return RowGroupSource if store is None else type("RowGroupSource", (RowGroupSource,), {"store": store})

    @classmethod
    def name(cls) -> str:
        return "zonelight_row_groups" + (f"_{hashlib.sha256(repr(cls.store).encode()).hexdigest()[:12]}" if cls.store else "")

    def schema(self) -> str:
        raise ValueError("the schema is given by the caller")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _RowGroupReader(schema, json.loads(self.options["units"]), self.store)


@dataclass
class _Unit(InputPartition):
    uri: str
    group: int


class _RowGroupReader(DataSourceReader):
    def __init__(self, schema: StructType, units: list, store: S3Config | None) -> None:
        self.names, self.store = [f.name for f in schema.fields], store
        from pyspark.sql.pandas.types import to_arrow_schema

        self.arrow = to_arrow_schema(schema)
        self.units = units

    def partitions(self) -> list[InputPartition]:
        return [_Unit(u, k) for u, k in self.units]

    def read(self, partition: _Unit) -> Iterator[pa.RecordBatch]:
        fs, path = opened(partition.uri, self.store)
        with fs.open_input_file(path) as f:
            file = pq.ParquetFile(f)
            groups = range(file.num_row_groups) if partition.group < 0 else [partition.group]
            for k in groups:
                for batch in file.iter_batches(row_groups=[k], columns=self.names):
                    yield pa.record_batch([batch.column(n).cast(self.arrow.field(n).type) for n in self.names], schema=self.arrow)


def scans_of(df: DataFrame) -> list[tuple[str, list]]:
    """Of each native file scan in a query's plan: the occurrence it was read for, and the filters pushed to it.

    A scan inside a subquery that is not planned yet has no filters, so nothing is pruned for it.
    """
    out = []

    def walk(node: Any) -> None:  # noqa: ANN401
        name = node.getClass().getSimpleName()
        if name in ("FileSourceScanExec", "LogicalRelation"):
            relation = node.relation()
            if "options" in dir(relation):
                key = relation.options().get(OCCURRENCE)
                out.append((key.get() if key.isDefined() else "", _seq(node.dataFilters()) if name == "FileSourceScanExec" else []))
        for c in [*_seq(node.children()), *_seq(node.subqueries())]:
            walk(c)

    walk(df._jdf.queryExecution().sparkPlan())
    return out
