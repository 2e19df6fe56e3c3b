"""Split-block Bloom filters over XXH64, one for each zone and column.

A filter is an array of blocks of eight 32-bit words.  The high half of a value's hash picks the block, the
low half sets one bit in each word.  Layout, little-endian: ``u8 version, u32 entries, { u32 zone id,
i32 field id, u32 blocks, words }``.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np
import xxhash

from ..errors import BadVersion, Truncated
from .values import Value, hash_bytes
from .zonemap import Reader

VERSION = 1
BLOB_TYPE = "bloom-filter-v1"
BITS_PER_VALUE = 16
# The eight odd multipliers of split-block Bloom filters in the Parquet format.
SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], dtype=np.uint32)
# The five primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return x << np.uint64(n) | x >> np.uint64(64 - n)


def hash_words(words: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of many values of 8 bytes each, given as unsigned 64-bit integers."""
    k = _rotated(words.astype(np.uint64) * _P2, 31) * _P1
    h = _rotated((_P5 + np.uint64(8)) ^ k, 27) * _P1 + _P4
    h = (h ^ h >> np.uint64(33)) * _P2
    h = (h ^ h >> np.uint64(29)) * _P3
    return h ^ h >> np.uint64(32)


def hash_value(value: Value) -> int | None:
    raw = hash_bytes(value)
    return None if raw is None else xxhash.xxh64_intdigest(raw, 0)


def hash_raw(raws: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(r, 0) for r in raws], dtype=np.uint64)


def blocks_for(values: int, bits_per_value: int = BITS_PER_VALUE) -> int:
    return max(1, -(-values * bits_per_value // 256))


class Bloom:
    """One filter: ``words`` has a row of eight for each block."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    @staticmethod
    def empty(blocks: int) -> Bloom:
        return Bloom(np.zeros((max(1, blocks), 8), np.uint32))

    @staticmethod
    def build(values: list[Value], bits_per_value: int = BITS_PER_VALUE) -> Bloom:
        raws = {r for v in values if (r := hash_bytes(v)) is not None}
        out = Bloom.empty(blocks_for(len(raws), bits_per_value))
        out.insert(hash_raw(sorted(raws)))
        return out

    def _masks(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        block = ((hashes >> np.uint64(32)) * np.uint64(len(self.words)) >> np.uint64(32)).astype(np.int64)
        low = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        bits = np.uint32(1) << ((low[:, None] * SALTS[None, :]) >> np.uint32(27))
        return block, bits

    def insert(self, hashes: np.ndarray) -> None:
        block, bits = self._masks(np.asarray(hashes, np.uint64))
        np.bitwise_or.at(self.words, block, bits)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        block, bits = self._masks(np.asarray(hashes, np.uint64))
        return ((self.words[block] & bits) == bits).all(axis=1)

    def might_contain(self, value: Value) -> bool:
        """False only if the value is surely not in the zone; null may always be."""
        h = hash_value(value)
        return True if h is None else bool(self.contains(np.array([h], np.uint64))[0])


@dataclass
class ZoneBlooms:
    """Filters by (zone id, field id)."""

    entries: dict[tuple[int, int], Bloom] = field(default_factory=dict)

    def might_contain(self, zone_id: int, field_id: int, value: Value) -> bool:
        bloom = self.entries.get((zone_id, field_id))
        return True if bloom is None else bloom.might_contain(value)

    def encode(self) -> bytes:
        out = bytearray(struct.pack("<BI", VERSION, len(self.entries)))
        for (zone_id, field_id), bloom in self.entries.items():
            out += struct.pack("<IiI", zone_id, field_id, len(bloom.words)) + bloom.words.astype("<u4").tobytes()
        return bytes(out)

    def places(self) -> list[list[int]]:
        """[zone id, field id, offset in the encoded blob, blocks] of every filter."""
        out, at = [], 5
        for (zone_id, field_id), bloom in self.entries.items():
            out.append([zone_id, field_id, at + 12, len(bloom.words)])
            at += 12 + 32 * len(bloom.words)
        return out

    @staticmethod
    def decode(data: bytes) -> ZoneBlooms:
        reader = Reader(data)
        if (version := reader.take("<B")[0]) != VERSION:
            raise BadVersion(f"Bloom filter version {version}")
        out = ZoneBlooms()
        for _ in range(reader.take("<I")[0]):
            zone_id, field_id, blocks = reader.take("<IiI")
            if not blocks:
                raise Truncated("a filter without blocks")
            out.entries[zone_id, field_id] = Bloom(np.frombuffer(reader.raw(32 * blocks), "<u4").reshape(-1, 8).copy())
        return out
