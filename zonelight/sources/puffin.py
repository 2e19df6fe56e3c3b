"""Puffin containers: blobs, and a JSON footer that says what and where they are.

``PFA1, blobs, PFA1, JSON, i32 size of the JSON, 4 flag bytes, PFA1``.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from ..errors import BadContainer, UnsupportedCodec

MAGIC = b"PFA1"
#: Snapshot id and sequence number of an index that belongs to no snapshot.
UNBOUND = -1


@dataclass
class Blob:
    type: str
    fields: list[int]
    data: bytes
    snapshot_id: int = UNBOUND
    sequence_number: int = UNBOUND
    properties: dict[str, str] = field(default_factory=dict)


def write_puffin(blobs: list[Blob], properties: dict[str, str] | None = None) -> bytes:
    out, listed = bytearray(MAGIC), []
    for b in blobs:
        meta: dict[str, Any] = {"type": b.type, "fields": b.fields, "snapshot-id": b.snapshot_id, "sequence-number": b.sequence_number, "offset": len(out), "length": len(b.data)}
        if b.properties:
            meta["properties"] = b.properties
        listed.append(meta)
        out += b.data
    footer: dict[str, Any] = {"blobs": listed}
    if properties:
        footer["properties"] = properties
    raw = json.dumps(footer, separators=(",", ":")).encode()
    return bytes(out + MAGIC + raw + struct.pack("<i4s", len(raw), b"\0\0\0\0") + MAGIC)


def read_puffin(data: bytes) -> tuple[list[Blob], dict[str, str]]:
    """Blobs with their bytes, and the file's properties."""
    metas, properties = read_footer(len(data), lambda at, n: data[at : at + n])
    return [_blob(m, data[m["offset"] : m["offset"] + m["length"]]) for m in metas], properties


def _blob(meta: dict[str, Any], data: bytes) -> Blob:
    return Blob(meta["type"], list(meta["fields"]), data, meta["snapshot-id"], meta["sequence-number"], meta.get("properties") or {})


def read_footer(n: int, read: Callable[[int, int], bytes]) -> tuple[list[dict[str, Any]], dict[str, str]]:
    """What the footer of a container of n bytes says of its blobs, and the file's properties; ``read`` gets offset and length."""
    if n < 20 or read(0, 4) != MAGIC:
        raise BadContainer("magic bytes are missing")
    tail = read(n - 12, 12)
    if tail[-4:] != MAGIC:
        raise BadContainer("magic bytes are missing")
    size, flags = struct.unpack("<i4s", tail[:8])
    if flags[0] & 1:
        raise UnsupportedCodec("the footer is compressed")
    start = n - 12 - size
    if size < 0 or start < 8 or read(start - 4, 4) != MAGIC:
        raise BadContainer("the footer doesn't begin where it should")
    try:
        footer = json.loads(read(start, size))
        for m in footer["blobs"]:
            if m.get("compression-codec"):
                raise UnsupportedCodec(m["compression-codec"])
            if m["offset"] < 4 or m["length"] < 0 or m["offset"] + m["length"] > start - 4:
                raise BadContainer("a blob lies outside the file")
            _blob(m, b"")
        return footer["blobs"], footer.get("properties") or {}
    except (KeyError, TypeError, ValueError) as e:
        raise BadContainer(f"the footer can't be read: {e}") from e


def first_of_type(blobs: list[Blob], kind: str) -> Blob | None:
    return next((b for b in blobs if b.type == kind), None)
