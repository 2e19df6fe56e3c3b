"""Reads Avro object container files: what table catalogs keep their lists of files in.

Blocks are plain, deflated or Zstandard-compressed.  Records come back as dictionaries, unions as the value itself.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from typing import Any

from ..errors import BadContainer, Truncated, UnsupportedCodec

MAGIC = b"Obj\x01"
_FIXED = {"float": ("<f", 4), "double": ("<d", 8)}


class _Cursor:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def raw(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise Truncated(f"{n} bytes wanted at {self.at} of {len(self.data)}")
        self.at += n
        return self.data[self.at - n : self.at]

    def long(self) -> int:
        """A zigzag integer of seven bits a byte."""
        n = shift = 0
        while True:
            b = self.raw(1)[0]
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return (n >> 1) ^ -(n & 1)

    def sized(self) -> bytes:
        return self.raw(self.long())

    def items(self) -> Iterator[None]:
        """One step for each item of an array or a map, which come in counted blocks."""
        while n := self.long():
            if n < 0:
                n, _ = -n, self.long()
            for _ in range(n):
                yield


def _named(schema: Any, names: dict[str, Any]) -> None:  # noqa: ANN401
    """Note the schemas that others refer to by name."""
    if isinstance(schema, list):
        for s in schema:
            _named(s, names)
    elif isinstance(schema, dict):
        kind = schema.get("type")
        if kind in ("record", "enum", "fixed"):
            space = schema.get("namespace")
            names[schema["name"]] = schema
            if space:
                names[f"{space}.{schema['name']}"] = schema
            for f in schema.get("fields", []):
                _named(f["type"], names)
        elif kind in ("array", "map"):
            _named(schema["items" if kind == "array" else "values"], names)
        elif isinstance(kind, (dict, list)):
            _named(kind, names)


def _read(c: _Cursor, schema: Any, names: dict[str, Any]) -> Any:  # noqa: ANN401
    if isinstance(schema, list):
        return _read(c, schema[c.long()], names)
    if isinstance(schema, dict):
        kind = schema["type"]
        if kind == "record":
            return {f["name"]: _read(c, f["type"], names) for f in schema["fields"]}
        if kind == "array":
            return [_read(c, schema["items"], names) for _ in c.items()]
        if kind == "map":
            return {c.sized().decode(): _read(c, schema["values"], names) for _ in c.items()}
        if kind == "fixed":
            return c.raw(schema["size"])
        if kind == "enum":
            return schema["symbols"][c.long()]
        return _read(c, kind, names)
    match schema:
        case "null":
            return None
        case "boolean":
            return c.raw(1) != b"\0"
        case "int" | "long":
            return c.long()
        case "float" | "double":
            form, n = _FIXED[schema]
            return struct.unpack(form, c.raw(n))[0]
        case "bytes":
            return c.sized()
        case "string":
            return c.sized().decode()
    if schema in names:
        return _read(c, names[schema], names)
    raise BadContainer(f"unknown type {schema}")


def read_avro(data: bytes) -> Iterator[Any]:
    """The records of a container file."""
    c = _Cursor(data)
    if c.raw(4) != MAGIC:
        raise BadContainer("not an Avro container")
    meta = {}
    for _ in c.items():
        key = c.sized().decode()
        meta[key] = c.sized()
    sync = c.raw(16)
    try:
        schema = json.loads(meta["avro.schema"])
    except (KeyError, ValueError) as e:
        raise BadContainer("no schema") from e
    names: dict[str, Any] = {}
    _named(schema, names)
    codec = meta.get("avro.codec", b"null").decode()
    while c.at < len(data):
        n, body = c.long(), c.sized()
        if c.raw(16) != sync:
            raise BadContainer("a block doesn't end where it should")
        if codec == "deflate":
            body = zlib.decompress(body, -15)
        elif codec == "zstandard":
            import zstandard

            body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
        elif codec != "null":
            raise UnsupportedCodec(codec)
        block = _Cursor(body)
        for _ in range(n):
            yield _read(block, schema, names)
