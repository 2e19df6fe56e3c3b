"""Zone maps: for each zone of a data file, the bounds and counts of its indexed columns.

Layout, all little-endian: ``u8 version, u32 zones, { u32 zone id, u64 first row, u64 rows, u32 columns,
{ i32 field id, u64 nulls, u64 values, u32 + bytes min, u32 + bytes max } }``.  Bounds carry no type; types come
from a map of field ids when they are read.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from ..errors import BadVersion, Truncated
from .values import NULL, Value, bound_bytes, bound_value

VERSION = 1
BLOB_TYPE = "zone-map-v1"
_ZONE, _COLUMN, _LEN = struct.Struct("<IQQI"), struct.Struct("<iQQ"), struct.Struct("<I")


@dataclass(frozen=True)
class ColumnStats:
    field_id: int
    min: Value
    max: Value
    null_count: int
    value_count: int


@dataclass
class Zone:
    zone_id: int
    row_offset: int
    row_count: int
    columns: dict[int, ColumnStats] = field(default_factory=dict)


@dataclass
class ZoneMap:
    zones: list[Zone] = field(default_factory=list)

    def encode(self, types: dict[int, str] | None = None) -> bytes:
        """The payload; field types decide how wide bounds are written."""
        types, out = types or {}, bytearray(struct.pack("<BI", VERSION, len(self.zones)))
        for z in self.zones:
            out += _ZONE.pack(z.zone_id, z.row_offset, z.row_count, len(z.columns))
            for c in z.columns.values():
                out += _COLUMN.pack(c.field_id, c.null_count, c.value_count)
                for bound in (c.min, c.max):
                    raw = bound_bytes(bound, types.get(c.field_id))
                    out += _LEN.pack(len(raw)) + raw
        return bytes(out)

    @staticmethod
    def decode(data: bytes, types: dict[int, str]) -> ZoneMap:
        reader = Reader(data)
        if (version := reader.take("<B")[0]) != VERSION:
            raise BadVersion(f"zone map version {version}")
        out = ZoneMap()
        for _ in range(reader.take("<I")[0]):
            zone_id, row_offset, row_count, columns = reader.take(_ZONE.format)
            zone = Zone(zone_id, row_offset, row_count)
            for _ in range(columns):
                field_id, nulls, values = reader.take(_COLUMN.format)
                low, high = (bound_value(reader.sized(), types.get(field_id)) for _ in range(2))
                zone.columns[field_id] = ColumnStats(field_id, low, high, nulls, values)
            out.zones.append(zone)
        return out


class Reader:
    """Reads a layout from bytes and says where they end too early."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = memoryview(data), 0

    def take(self, form: str) -> tuple:
        size = struct.calcsize(form)
        return struct.unpack(form, self.raw(size))

    def raw(self, size: int) -> bytes:
        if size < 0 or self.at + size > len(self.data):
            raise Truncated(f"{size} bytes wanted at {self.at} of {len(self.data)}")
        out = bytes(self.data[self.at : self.at + size])
        self.at += size
        return out

    def sized(self) -> bytes:
        return self.raw(self.take("<I")[0])


def absent(field_id: int, nulls: int) -> ColumnStats:
    """Stats of a zone in which a column has no value."""
    return ColumnStats(field_id, NULL, NULL, nulls, 0)
