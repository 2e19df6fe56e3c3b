"""Bytes of bounds, zone maps, Bloom filters and containers."""

from __future__ import annotations

import math
import struct

import numpy as np
import pytest
import xxhash

from zonelight.errors import BadContainer, BadVersion, MissingType, Truncated, UnsupportedCodec
from zonelight.sources.bloom import Bloom, ZoneBlooms, hash_value, hash_words
from zonelight.sources.puffin import MAGIC, Blob, first_of_type, read_puffin, write_puffin
from zonelight.sources.values import NULL, Value, bound_bytes, bound_value, hash_bytes, integer_bytes, literal
from zonelight.sources.zonemap import ColumnStats, Zone, ZoneMap

DAY = Value("date", -1)
# The zones, filter keys and probes that writers of these formats are held against.
GOLDEN_TYPES = {1: "long", 2: "string", 5: "double", 6: "double", 7: "boolean", 10: "decimal(10,2)", 11: "date", 12: "time", 13: "timestamp"}


def golden() -> ZoneMap:
    c = lambda f, n, v, lo, hi: (f, ColumnStats(f, lo, hi, n, v))
    i, s, d = (lambda x: Value("int", x)), (lambda x: Value("bytes", x.encode())), (lambda x: Value("float", x))
    return ZoneMap(
        [
            Zone(0, 0, 100, dict([c(1, 3, 97, i(0), i(10)), c(2, 0, 100, s("alpha"), s("mid")), c(5, 0, 100, d(-1.5), d(3.25)), c(6, 100, 0, NULL, NULL), c(7, 0, 100, Value("bool", False), Value("bool", True))])),
            Zone(1, 100, 50, dict([c(1, 0, 50, i(20), i(30))])),
            Zone(2, 150, 25, dict([c(10, 0, 25, Value("decimal", (-10050, 2)), Value("decimal", (999999, 2))), c(11, 0, 25, Value("date", -1), Value("date", 19723)), c(12, 0, 25, Value("time", 0), Value("time", 86399999999)), c(13, 0, 25, Value("ts", 1672531200000000), Value("ts", 1704067200000000))])),
        ]
    )


def test_golden_zone_map_bytes_follow_the_layout():
    want = struct.pack("<BI", 1, 3) + struct.pack("<IQQI", 0, 0, 100, 5)

    def col(f, n, v, lo, hi):
        return struct.pack("<iQQ", f, n, v) + struct.pack("<I", len(lo)) + lo + struct.pack("<I", len(hi)) + hi

    want += col(1, 3, 97, struct.pack("<q", 0), struct.pack("<q", 10)) + col(2, 0, 100, b"alpha", b"mid") + col(5, 0, 100, struct.pack("<d", -1.5), struct.pack("<d", 3.25)) + col(6, 100, 0, b"", b"") + col(7, 0, 100, b"\0", b"\1")
    want += struct.pack("<IQQI", 1, 100, 50, 1) + col(1, 0, 50, struct.pack("<q", 20), struct.pack("<q", 30))
    want += struct.pack("<IQQI", 2, 150, 25, 4) + col(10, 0, 25, (-10050).to_bytes(2, "big", signed=True), (999999).to_bytes(3, "big", signed=True))
    want += col(11, 0, 25, struct.pack("<i", -1), struct.pack("<i", 19723)) + col(12, 0, 25, struct.pack("<q", 0), struct.pack("<q", 86399999999)) + col(13, 0, 25, struct.pack("<q", 1672531200000000), struct.pack("<q", 1704067200000000))
    assert golden().encode(GOLDEN_TYPES) == want
    assert ZoneMap.decode(want, GOLDEN_TYPES) == golden()


def test_zone_map_errors():
    raw = golden().encode(GOLDEN_TYPES)
    with pytest.raises(BadVersion):
        ZoneMap.decode(b"\2" + raw[1:], GOLDEN_TYPES)
    for cut in (1, 5, 40, len(raw) - 1):
        with pytest.raises(Truncated):
            ZoneMap.decode(raw[:cut], GOLDEN_TYPES)
    with pytest.raises(MissingType):
        ZoneMap.decode(raw, {})


@pytest.mark.parametrize("n", [0, 1, -1, 127, 128, -128, -129, 255, 256, 32767, 32768, -32768, -32769, 10**37, -(10**37)])
def test_integers_take_the_fewest_bytes(n):
    raw = integer_bytes(n)
    assert int.from_bytes(raw, "big", signed=True) == n
    if len(raw) > 1:
        with pytest.raises(OverflowError):
            n.to_bytes(len(raw) - 1, "big", signed=True)


@pytest.mark.parametrize(
    ("value", "kind"),
    [(Value("int", -5), "int"), (Value("int", 2**40), "long"), (Value("float", 1.5), "float"), (Value("float", -2.25), "double"), (Value("bool", True), "boolean"), (Value("bytes", "é".encode()), "string"), (Value("bytes", b"\0\xff"), "binary"), (Value("date", -400), "date"), (Value("time", 5), "time"), (Value("ts", -7), "timestamptz"), (Value("decimal", (-(10**37), 4)), "decimal(38,4)")],
)
def test_bounds_round_trip(value, kind):
    assert bound_value(bound_bytes(value, kind), kind) == value


def test_empty_string_bound_reads_as_absent():
    assert bound_bytes(Value("bytes", b""), "string") == b""
    assert bound_value(b"", "string") == NULL


def test_hash_vectors():
    assert xxhash.xxh64_intdigest(b"", 0) == 0xEF46DB3751D8E999
    assert hash_value(Value("bytes", b"")) == 0xEF46DB3751D8E999
    words = np.array([0, 1, 2**63, 2**64 - 1, 123456789], np.uint64)
    assert hash_words(words).tolist() == [xxhash.xxh64_intdigest(int(w).to_bytes(8, "little"), 0) for w in words]


def test_hashed_bytes():
    assert hash_bytes(Value("int", 7)) == struct.pack("<q", 7)
    assert hash_bytes(Value("float", -0.0)) == hash_bytes(Value("float", 0.0))
    assert hash_bytes(Value("float", math.nan)) == hash_bytes(Value("float", -math.nan))
    assert hash_bytes(DAY) == struct.pack("<i", -1)
    assert hash_bytes(NULL) is None
    assert hash_bytes(Value("decimal", (5, 2))) == b"\5"


def test_bloom_has_no_false_negatives_and_few_false_positives():
    values = [Value("bytes", f"k-{i}".encode()) for i in range(500)]
    bloom = Bloom.build(values)
    assert all(bloom.might_contain(v) for v in values)
    assert sum(bloom.might_contain(Value("bytes", f"q-{i}".encode())) for i in range(5000)) < 250
    assert bloom.might_contain(NULL)
    assert not Bloom.build([]).might_contain(Value("int", 1))


def test_bloom_layout():
    # Keys and probes, as above.
    zone0 = [Value("bytes", f"u-{i:02d}".encode()) for i in range(20)]
    zone1 = [Value("bytes", f"v-{i:02d}".encode()) for i in range(10)]
    blooms = ZoneBlooms({(0, 3): Bloom.build(zone0), (1, 3): Bloom.build(zone1)})
    raw = blooms.encode()
    assert raw[:5] == struct.pack("<BI", 1, 2)
    assert raw[5:17] == struct.pack("<IiI", 0, 3, 2)  # 20 values of 16 bits: two blocks of 256
    assert len(raw) == 5 + 12 + 64 + 12 + 32
    back = ZoneBlooms.decode(raw)
    for probe in ("u-05", "u-19"):
        assert back.might_contain(0, 3, Value("bytes", probe.encode()))
    for probe in ("v-00", "v-07"):
        assert back.might_contain(1, 3, Value("bytes", probe.encode()))
    for probe in ("u-99", "v-99", "zzz-absent", "nope"):
        assert not back.might_contain(0, 3, Value("bytes", probe.encode()))
    assert back.might_contain(9, 3, Value("bytes", b"x"))  # no filter: maybe
    # one bit in each word of one block, by the definition
    h = xxhash.xxh64_intdigest(b"v-00", 0)
    words = np.frombuffer(raw[-32:], "<u4")
    salts = [0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31]
    for w, s in zip(words.tolist(), salts, strict=True):
        assert w >> (((h & 0xFFFFFFFF) * s % 2**32) >> 27) & 1


def test_bloom_errors():
    raw = ZoneBlooms({(0, 3): Bloom.empty(1)}).encode()
    with pytest.raises(BadVersion):
        ZoneBlooms.decode(b"\7" + raw[1:])
    with pytest.raises(Truncated):
        ZoneBlooms.decode(raw[:-1])
    with pytest.raises(Truncated):
        ZoneBlooms.decode(raw[:5] + struct.pack("<IiI", 0, 3, 0))


def test_container_round_trip_and_errors():
    blobs = [Blob("zone-map-v1", [1, 2], b"abc"), Blob("bloom-filter-v1", [2], b"", properties={"x": "y"})]
    raw = write_puffin(blobs, {"uri": "a"})
    back, props = read_puffin(raw)
    assert back == blobs and props == {"uri": "a"}
    assert first_of_type(back, "bloom-filter-v1").fields == [2]
    assert first_of_type(back, "other") is None
    assert raw[:4] == MAGIC and raw[-4:] == MAGIC and back[0].snapshot_id == -1
    for broken in (b"", b"PFA1" * 4, b"x" * 40, raw[:-1] + b"x", b"XFA1" + raw[4:]):
        with pytest.raises(BadContainer):
            read_puffin(broken)
    with pytest.raises(BadContainer):
        read_puffin(raw.replace(b'"length":3', b'"length":9'))
    with pytest.raises(BadContainer):
        read_puffin(raw[:-12] + struct.pack("<i4s", -1, b"\0" * 4) + MAGIC)
    with pytest.raises(UnsupportedCodec):
        read_puffin(raw[:-8] + b"\1\0\0\0" + MAGIC)
    coded = raw.replace(b'"type":"zone-map-v1"', b'"compression-codec":"lz4","type":"zone-map-v1"')
    size = struct.unpack_from("<i", raw, len(raw) - 12)[0] + len(coded) - len(raw)
    with pytest.raises(UnsupportedCodec):
        read_puffin(coded[:-12] + struct.pack("<i4s", size, b"\0" * 4) + MAGIC)


def test_literals_take_the_columns_scale_exactly():
    from decimal import Decimal

    assert literal(Decimal("1.5"), "decimal(10,2)") == Value("decimal", (150, 2))
    assert literal(Decimal("1.005"), "decimal(10,2)") is None
    assert literal(3, "decimal(10,2)") == Value("decimal", (300, 2))
    assert literal(None) is None
    assert literal(2**70, "long") is None
    assert literal(1.5, "long") is None
