"""Builds sidecars: the zone map and Bloom filters of each data file, in a Puffin container.

Row groups are the unit of work.  Executors read footers, then one row group at a time and only its
indexed columns, so memory is bounded by a row group; the sidecar of a file is put together where its zones
meet and written next to nothing else.  The driver sees one row for each file.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import MissingColumn, UnsupportedType
from ..sources import bloom as blooms_
from ..sources import zonemap as zones_
from ..sources.bloom import BITS_PER_VALUE, Bloom, ZoneBlooms, blocks_for, hash_raw, hash_words
from ..sources.files import S3Config, fingerprint, footer, opened, sidecar_name
from ..sources.puffin import Blob, first_of_type, read_footer, read_puffin, write_puffin
from ..sources.values import NULL, Value, bound_value, integer_bytes
from ..sources.zonemap import ColumnStats, Zone, ZoneMap
from .prune import Predicate, surviving_zones, survives


@dataclass(frozen=True)
class IndexField:
    """A column to index: bounds always, a Bloom filter if asked for."""

    name: str
    field_id: int
    bloom: bool = False


@dataclass
class Sidecar:
    """The index of one data file."""

    uri: str
    types: dict[int, str]
    field_ids: dict[str, int]
    zone_map: ZoneMap
    blooms: ZoneBlooms = field(default_factory=ZoneBlooms)
    fingerprint: str = ""

    def to_puffin(self) -> bytes:
        blobs = [Blob(zones_.BLOB_TYPE, sorted(self.types), self.zone_map.encode(self.types))]
        if self.blooms.entries:
            blobs.append(Blob(blooms_.BLOB_TYPE, sorted({f for _, f in self.blooms.entries}), self.blooms.encode(), properties={"places": json.dumps(self.blooms.places())}))
        return write_puffin(blobs, {"uri": self.uri, "fingerprint": self.fingerprint, "types": json.dumps(self.types), "field-ids": json.dumps(self.field_ids)})

    @staticmethod
    def from_puffin(data: bytes) -> Sidecar:
        blobs, props = read_puffin(data)
        types = {int(k): v for k, v in json.loads(props.get("types", "{}")).items()}
        zone_blob, bloom_blob = first_of_type(blobs, zones_.BLOB_TYPE), first_of_type(blobs, blooms_.BLOB_TYPE)
        zone_map = ZoneMap.decode(zone_blob.data, types) if zone_blob else ZoneMap()
        blooms = ZoneBlooms.decode(bloom_blob.data) if bloom_blob else ZoneBlooms()
        return Sidecar(props.get("uri", ""), types, json.loads(props.get("field-ids", "{}")), zone_map, blooms, props.get("fingerprint", ""))


def arrow_type(t: pa.DataType, name: str) -> str:
    """The table type of an Arrow type that can be indexed."""
    if pa.types.is_decimal128(t):
        return f"decimal({t.precision},{t.scale})"
    if pa.types.is_timestamp(t) and t.unit == "us":
        return "timestamptz" if t.tz else "timestamp"
    known = {pa.bool_(): "boolean", pa.int32(): "int", pa.int64(): "long", pa.float32(): "float", pa.float64(): "double", pa.date32(): "date", pa.string(): "string", pa.large_string(): "string"}
    if t not in known:
        raise UnsupportedType(f"{name}: {t}")
    return known[t]


def _value(scalar: pa.Scalar, kind: str) -> Value:
    if not scalar.is_valid:
        return NULL
    if kind.startswith("decimal"):
        d = scalar.as_py()
        scale = scalar.type.scale
        return Value("decimal", (int(d.scaleb(scale)), scale))
    if kind in ("date", "timestamp", "timestamptz"):
        return Value("date" if kind == "date" else "ts", scalar.value)
    x = scalar.as_py()
    return Value({"boolean": "bool", "int": "int", "long": "int", "float": "float", "double": "float"}.get(kind, "bytes"), x.encode() if isinstance(x, str) else x)


def column_stats(column: pa.ChunkedArray, field_id: int, kind: str) -> ColumnStats:
    """Bounds and counts.  A zone that holds NaN has no upper bound: Spark orders NaN above all numbers."""
    nulls, values = column.null_count, len(column) - column.null_count
    if not values:
        return zones_.absent(field_id, nulls)
    has_nan = False
    if kind in ("float", "double"):
        nan = pc.is_nan(column)
        has_nan = bool(pc.any(nan).as_py())
        column = column.filter(pc.invert(nan)) if has_nan else column
    both = pc.min_max(column)
    low, high = (_value(both[k], kind) for k in ("min", "max"))
    return ColumnStats(field_id, low, NULL if has_nan else high, nulls, values)


def column_bloom(column: pa.ChunkedArray, kind: str, bits_per_value: int = BITS_PER_VALUE) -> Bloom:
    """A filter over the distinct values, sized by their number."""
    uniq = column.unique().drop_null()
    if kind in ("int", "long", "timestamp", "timestamptz"):
        hashes = hash_words(uniq.cast(pa.int64()).to_numpy(zero_copy_only=False).view(np.uint64))
    elif kind in ("float", "double"):
        x = uniq.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
        x[np.isnan(x)] = np.nan
        hashes = np.unique(hash_words(x.view(np.uint64)))
    elif kind.startswith("decimal"):
        hashes = hash_raw([integer_bytes(int(d.scaleb(uniq.type.scale))) for d in uniq.to_pylist()])
    elif kind == "date":
        hashes = hash_raw([int(x).to_bytes(4, "little", signed=True) for x in uniq.cast(pa.int32()).to_pylist()])
    elif kind == "boolean":
        hashes = hash_raw([bytes([x]) for x in uniq.to_pylist()])
    else:
        hashes = hash_raw([x.encode() for x in uniq.to_pylist()])
    out = Bloom.empty(blocks_for(len(hashes), bits_per_value))
    out.insert(hashes)
    return out


def resolve_types(schema: pa.Schema, fields: list[IndexField]) -> dict[int, str]:
    for f in fields:
        if schema.get_field_index(f.name) < 0:
            raise MissingColumn(f.name)
    return {f.field_id: arrow_type(schema.field(f.name).type, f.name) for f in fields}


def footer_stats(meta: pq.RowGroupMetaData, at: int, field_id: int, kind: str) -> ColumnStats | None:
    """Bounds and counts from a file's own footer, where they are exact: whole numbers, dates and times in microseconds."""
    found = meta.column(at).statistics if kind in ("int", "long", "date", "timestamp", "timestamptz") else None
    if found is None or not found.has_null_count:
        return None
    values = meta.num_rows - found.null_count
    if not values:
        return zones_.absent(field_id, found.null_count)
    if not found.has_min_max or found.physical_type not in ("INT32", "INT64"):
        return None
    of = {"int": "int", "long": "int", "date": "date"}.get(kind, "ts")
    return ColumnStats(field_id, Value(of, int(found.min_raw)), Value(of, int(found.max_raw)), found.null_count, values)


def zone_of(table: pa.Table, zone_id: int, row_offset: int, fields: list[IndexField], types: dict[int, str], bits_per_value: int = BITS_PER_VALUE, known: dict[int, ColumnStats] | None = None) -> tuple[Zone, ZoneBlooms]:
    """The index of one row group; known: stats that the table's columns need not be read for."""
    known = known or {}
    zone = Zone(zone_id, row_offset, table.num_rows, {f.field_id: known.get(f.field_id) or column_stats(table.column(f.name), f.field_id, types[f.field_id]) for f in fields})
    entries = {(zone_id, f.field_id): column_bloom(table.column(f.name), types[f.field_id], bits_per_value) for f in fields if f.bloom}
    return zone, ZoneBlooms(entries)


def _zone_in(file: pq.ParquetFile, k: int, row_offset: int, fields: list[IndexField], types: dict[int, str], bits_per_value: int) -> tuple[Zone, ZoneBlooms]:
    """The index of a row group of a file; only columns that the footer doesn't tell enough of are read."""
    meta, at = file.metadata.row_group(k), {file.metadata.schema.column(c).path: c for c in range(file.metadata.num_columns)}
    known = {f.field_id: s for f in fields if (s := footer_stats(meta, at[f.name], f.field_id, types[f.field_id]))}
    names = [f.name for f in fields if f.bloom or f.field_id not in known]
    if not names:
        return Zone(k, row_offset, meta.num_rows, {f.field_id: known[f.field_id] for f in fields}), ZoneBlooms()
    return zone_of(file.read_row_group(k, columns=names), k, row_offset, fields, types, bits_per_value, known)


def build_sidecar(uri: str, fields: list[IndexField], bits_per_value: int = BITS_PER_VALUE, store: S3Config | None = None) -> Sidecar:
    """Index one file here, a row group at a time."""
    fs, path = opened(uri, store)
    with fs.open_input_file(path) as f:
        file = pq.ParquetFile(f)
        types = resolve_types(file.schema_arrow, fields)
        out = Sidecar(uri, types, {x.name: x.field_id for x in fields}, ZoneMap(), ZoneBlooms(), fingerprint(uri, store))
        at = 0
        for k in range(file.num_row_groups):
            zone, blooms = _zone_in(file, k, at, fields, types, bits_per_value)
            out.zone_map.zones.append(zone)
            out.blooms.entries |= blooms.entries
            at += zone.row_count
    return out


def _row_groups(store: S3Config | None):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                meta = footer(uri, store)
                rows = [meta.row_group(k).num_rows for k in range(meta.num_row_groups)]
                n = max(1, len(rows))
                yield pa.record_batch([pa.array([uri] * n), pa.array(range(n) if rows else [-1], pa.int32()), pa.array(np.concatenate([[0], np.cumsum(rows)[:-1]]) if rows else [0], pa.int64())], names=["uri", "zone_id", "row_offset"])

    return run


def _zones(fields: list[IndexField], bits_per_value: int, store: S3Config | None):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, handle, file, types = None, None, None, {}
        for batch in batches:
            for uri, k, at in zip(*(batch.column(c).to_pylist() for c in ("uri", "zone_id", "row_offset")), strict=True):
                if uri != now:  # the footer of a file is read once for row groups that come in a row
                    if handle:
                        handle.close()
                    fs, path = opened(uri, store)
                    now, handle = uri, fs.open_input_file(path)
                    file = pq.ParquetFile(handle)
                    types = resolve_types(file.schema_arrow, fields)
                zone_map, blooms = ZoneMap(), ZoneBlooms()
                if k >= 0:
                    zone, blooms = _zone_in(file, k, at, fields, types, bits_per_value)
                    zone_map.zones.append(zone)
                yield pa.record_batch([pa.array([uri]), pa.array([k], pa.int32()), pa.array([json.dumps(types)]), pa.array([zone_map.encode(types)], pa.binary()), pa.array([blooms.encode()], pa.binary())], names=["uri", "zone_id", "types", "zones", "blooms"])
        if handle:
            handle.close()

    return run


def _assembled(fields: list[IndexField], folder: str, store: S3Config | None):  # noqa: ANN202
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["zone_id"])
        uri, types = rows[0]["uri"], {int(k): v for k, v in json.loads(rows[0]["types"]).items()}
        out = Sidecar(uri, types, {x.name: x.field_id for x in fields}, ZoneMap(), ZoneBlooms(), fingerprint(uri, store))
        for r in rows:
            out.zone_map.zones += ZoneMap.decode(r["zones"], types).zones
            out.blooms.entries |= ZoneBlooms.decode(r["blooms"]).entries
        write_sidecar(out, folder, store)
        return pa.table({"uri": [uri], "zones": pa.array([len(out.zone_map.zones)], pa.int64())})

    return run


def write_sidecar(sidecar: Sidecar, folder: str, store: S3Config | None = None) -> str:
    """Write below folder under a name that the data file's URI gives; replaces an older one as a whole."""
    fs, root = opened(folder, store)
    fs.create_dir(root, recursive=True)
    name = f"{root}/{sidecar_name(sidecar.uri)}"
    temp = f"{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(temp) as f:
        f.write(sidecar.to_puffin())
    fs.move(temp, name)
    return name


def load_sidecar(uri: str, folder: str, store: S3Config | None = None, blooms: bool = True) -> Sidecar | None:
    """The stored index of a data file, with its Bloom filters or without; None if there is none or the file has changed since."""
    fs, root = opened(folder, store)
    try:
        with fs.open_input_file(f"{root}/{sidecar_name(uri)}") as f:
            if blooms:
                out = Sidecar.from_puffin(f.read())
            else:
                metas, props = read_footer(f.size(), _reads(f))
                zones = [m for m in metas if m["type"] == zones_.BLOB_TYPE]
                types = {int(k): v for k, v in json.loads(props.get("types", "{}")).items()}
                zone_map = ZoneMap.decode(_reads(f)(zones[0]["offset"], zones[0]["length"]), types) if zones else ZoneMap()
                out = Sidecar(props.get("uri", ""), types, json.loads(props.get("field-ids", "{}")), zone_map, fingerprint=props.get("fingerprint", ""))
    except FileNotFoundError:
        return None
    return out if out.fingerprint == fingerprint(uri, store) else None


def _reads(file: pa.NativeFile):  # noqa: ANN202
    def read(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    return read


def load_blooms(uri: str, folder: str, store: S3Config | None, wanted: set[tuple[int, int]]) -> ZoneBlooms:
    """The Bloom filters of some (zone, field) of a data file; only their bytes are read where the container tells places."""
    fs, root = opened(folder, store)
    out = ZoneBlooms()
    with fs.open_input_file(f"{root}/{sidecar_name(uri)}") as f:
        read = _reads(f)
        for m in read_footer(f.size(), read)[0]:
            if m["type"] != blooms_.BLOB_TYPE:
                continue
            places = (m.get("properties") or {}).get("places")
            if places is None:
                return ZoneBlooms({k: b for k, b in ZoneBlooms.decode(read(m["offset"], m["length"])).entries.items() if k in wanted})
            for zone_id, field_id, at, blocks in json.loads(places):
                if (zone_id, field_id) in wanted:
                    out.entries[zone_id, field_id] = Bloom(np.frombuffer(read(m["offset"] + at, 32 * blocks), "<u4").reshape(-1, 8))
    return out


def surviving_groups(side: Sidecar, predicates: list[Predicate], folder: str | None, store: S3Config | None) -> list[int]:
    """Row groups of a file that may hold matching rows: by bounds, then by the Bloom filters of what they leave.

    Of a stored sidecar only the filters that an equality asks are read, and they are not kept.
    """
    zones = side.zone_map.zones
    kept = surviving_zones(side.zone_map, None, predicates)
    asked = {p.field_id for p in predicates if p.op in ("=", "IN")}
    if kept and asked:
        blooms = side.blooms if folder is None else load_blooms(side.uri, folder, store, {(zones[i].zone_id, f) for i in kept for f in asked})
        kept = [i for i in kept if all(survives(zones[i], blooms, p) for p in predicates)]
    return [zones[i].zone_id for i in kept]


def build_index(spark: SparkSession, uris: list[str], fields: list[IndexField], folder: str, bits_per_value: int = BITS_PER_VALUE, store: S3Config | None = None) -> DataFrame:
    """Index all files on the executors and write a sidecar for each; returns (uri, zones)."""
    if not uris:
        return spark.createDataFrame([], "uri string, zones long")
    files = listed(spark, uris)
    groups = files.mapInArrow(_row_groups(store), "uri string, zone_id int, row_offset long")
    # row groups are dealt out evenly whatever files they lie in; a given number of partitions is not coalesced
    tasks = min(100_000, max(len(uris), 4 * spark.sparkContext.defaultParallelism))
    dealt = groups.repartition(tasks, F.xxhash64("uri", "zone_id")).sortWithinPartitions("uri", "zone_id")
    zones = dealt.mapInArrow(_zones(fields, bits_per_value, store), "uri string, zone_id int, types string, zones binary, blooms binary")
    done = zones.groupBy("uri").applyInArrow(_assembled(fields, folder, store), "uri string, zones long").collect()
    return spark.createDataFrame([tuple(r) for r in done], "uri string, zones long")


def listed(spark: SparkSession, uris: list[str]) -> DataFrame:
    """A row for each file, dealt out to tasks of at most a few hundred."""
    return spark.createDataFrame([(u,) for u in uris], "uri string").repartition(min(len(uris), max(4096, len(uris) // 256)))
