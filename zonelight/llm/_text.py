"""Vectorised text kernels shared by the operators of this folder.

Everything works on Arrow string columns as flat byte buffers: words, word hashes and shingle
hashes of a whole batch come from a few NumPy passes, not from a Python loop over words.
Temporaries are bounded: buffers are walked in segments of about ``SEGMENT`` bytes that end at
white space or at the end of a text.
"""

from __future__ import annotations

import contextlib
import ctypes
import inspect
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT = 1 << 20
BATCH_BYTES = 1 << 22
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE_BYTES = b" \t\n\x0b\x0c\r"

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (xor-shift-multiply finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 4096)
        table = np.full(size, _R, dtype=np.uint64)
        table[0] = 1
        _powers = np.multiply.accumulate(table)
    return _powers


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Flat UTF-8 bytes and int64 offsets (n + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    off = np.frombuffer(offsets, dtype=np.int64, count=n + 1, offset=8 * column.offset) if n else np.zeros(1, np.int64)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    flat = np.frombuffer(data, dtype=np.uint8, count=int(off[-1] - off[0]), offset=int(off[0]))
    return flat, off - off[0]


def row_slices(offsets: np.ndarray, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each (one row at least)."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi
        lo = hi


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of some texts: byte span, row and hash of each.

    The hash is a 64-bit polynomial over the bytes (lower-cased A-Z if ``lower``) and the length.
    """

    __slots__ = ("bounds", "ends", "hashes", "starts")

    def __init__(self, flat: np.ndarray, offsets: np.ndarray, lower: bool = True) -> None:
        starts, ends, hashes = [], [], []
        n, lo = len(flat), 0
        edges = np.zeros(n + 1, dtype=bool)
        edges[offsets] = True
        while lo < n:
            hi = min(n, lo + SEGMENT)
            while hi < n:
                window = SPACE[flat[hi : hi + SEGMENT]] | edges[hi : min(n, hi + SEGMENT)]
                k = int(window.argmax())
                if window[k]:
                    hi += k
                    break
                hi = min(n, hi + SEGMENT)
            s, e, h = self._segment(flat[lo:hi], edges[lo : hi + 1], lower)
            starts.append(s + lo)
            ends.append(e + lo)
            hashes.append(h)
            lo = hi
        empty = np.zeros(0, np.int64)
        self.starts = np.concatenate(starts) if starts else empty
        self.ends = np.concatenate(ends) if ends else empty
        self.hashes = np.concatenate(hashes) if hashes else empty.astype(np.uint64)
        #: words of row i: bounds[i] to bounds[i + 1]
        self.bounds = np.searchsorted(self.starts, offsets, "left")

    @staticmethod
    def _segment(flat: np.ndarray, edges: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        solid = ~SPACE[flat]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1] | edges[1 : len(flat)]
        s = np.flatnonzero(begins)
        if not len(s):
            return s, s, s.astype(np.uint64)
        finish = solid.copy()
        finish[:-1] &= ~solid[1:] | edges[1 : len(flat)]
        e = np.flatnonzero(finish) + 1
        lens = e - s
        table = _power_table(int(lens.max()))
        if len(s) == 1 or int(lens.sum()) == len(flat):
            body = flat[s[0] : e[-1]] if len(s) == 1 else flat
        else:
            body = flat[solid]
        at = np.cumsum(lens) - lens
        inside = np.arange(len(body)) - np.repeat(at, lens)
        part = (LOWER[body] if lower else body).astype(np.uint64)
        part += np.uint64(1)
        part *= table[inside]
        h = np.add.reduceat(part, at)
        return s, e, mix64(h + mix64(lens.astype(np.uint64)))

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


_COEF = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9C6E6877736C46E3, 0x83A3CF7C1B9D8A4F], dtype=np.uint64)


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram at each position (the last n - 1 positions have none)."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out += hashes[k : k + size] * _COEF[k % 8]
    return mix64(out + np.uint64(n))


def shingle_sets(words: Words, n: int = 5) -> list[np.ndarray]:
    """Sorted distinct n-word shingle hashes of each row; fewer words count as one shingle, none as the empty set."""
    whole = ngram_hashes(words.hashes, n)
    out = []
    for lo, hi in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        if hi - lo >= n:
            a = np.sort(whole[lo : hi - n + 1])
            out.append(a[np.concatenate(([True], a[1:] != a[:-1]))])
        elif hi > lo:
            out.append(ngram_hashes(words.hashes[lo:hi], hi - lo))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def ragged_take(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenation of flat[starts[i] : starts[i] + lens[i]]."""
    total = int(lens.sum())
    at = np.cumsum(lens) - lens
    return flat[np.repeat(starts - at, lens) + np.arange(total)]


class WordCache:
    """Ids of words by word hash, kept by a worker from batch to batch; beyond ``limit`` words it starts anew.

    ``encode`` gets distinct words as bytes and returns their ids in order (int32) and how many each has.  The cache only saves
    time: results don't depend on what it holds.
    """

    def __init__(self, encode, limit: int) -> None:  # noqa: ANN001
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.starts, self.lens = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.table, self.used = np.zeros(1024, np.int32), 0

    def _add(self, hashes: np.ndarray, words: list[bytes]) -> None:
        flat, lens = self.encode(words)
        starts = self.used + np.cumsum(lens) - lens
        total = int(lens.sum())
        if self.used + total > len(self.table):
            self.table = np.concatenate([self.table[: self.used], np.zeros(max(total, self.used), np.int32)])
        if total:
            self.table[self.used : self.used + total] = flat
        self.used += total
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.starts, self.lens = (np.insert(a, at, b) for a, b in ((self.hashes, hashes), (self.starts, starts), (self.lens, lens)))

    def ids(self, words: Words, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in the order of the text, and the bounds of each row's ids."""
        uniq, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        if len(self.hashes) + len(uniq) > self.limit:
            self._clear()
        at = np.minimum(np.searchsorted(self.hashes, uniq), max(0, len(self.hashes) - 1))
        miss = np.flatnonzero(self.hashes[at] != uniq) if len(self.hashes) else np.arange(len(uniq))
        if len(miss):
            spans = zip(words.starts[first[miss]].tolist(), words.ends[first[miss]].tolist(), strict=True)
            body = flat.tobytes()
            self._add(uniq[miss], [body[a:b] for a, b in spans])
            at = np.searchsorted(self.hashes, uniq)
        if not len(uniq):
            return np.zeros(0, np.int32), np.zeros(len(words.bounds), np.int64)
        starts, lens = self.starts[at][inverse], self.lens[at][inverse]
        return ragged_take(self.table, starts, lens), np.concatenate([[0], np.cumsum(lens)])[words.bounds]


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder, as a URI or path, that driver and executors share: below spark.checkpoint.dir.

    Where the session names none, a temporary folder takes its place on one machine; on a cluster that is an error,
    as no other machine would see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "local")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(shared_dir, "own", None) or "file://" + tempfile.mkdtemp(prefix="zonelight-")
        shared_dir.own = base
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


#: Rows of an Arrow batch: whole texts by the thousand are some megabytes in the JVM and in a worker.
BATCH_ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    """Have texts sent to workers in small batches, unless the session asks for another size than Spark's own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


#: Seconds between releases of a long task.
RELEASE_S = 0.5


def _release() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not all systems have it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable) -> Callable:
    """An Arrow function that gives freed memory back to the system now and then, and when it ends: workers stay for later tasks."""

    def over_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        since = time.monotonic()
        try:
            for out in run(batches):
                yield out
                if time.monotonic() - since > RELEASE_S:
                    _release()
                    since = time.monotonic()
        finally:
            _release()

    def over_group(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            _release()

    def over_groups(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(left, right)
        finally:
            _release()

    if inspect.isgeneratorfunction(run):
        return over_batches
    return over_group if len(inspect.signature(run).parameters) == 1 else over_groups


def saved(df: DataFrame, what: str) -> DataFrame:
    """Write to a Parquet table in the shared folder and read it back: a cut in the lineage that outlives executors."""
    small_batches(df.sparkSession)
    path = shared_dir(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Delete tables made by ``saved`` that nothing reads any more."""
    for t in tables:
        if t is not None and hasattr(t, "saved_at"):
            remove(t.sparkSession, t.saved_at)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders below the shared folder through Spark's own file system layer."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


#: Bytes up to which a table is sent to all executors, by an estimate from its rows.
BROADCAST_BYTES = 32_000_000


def _bytes_of(column: str, kind: str):  # noqa: ANN202
    """About the bytes that a value takes in a row or a hash table."""
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if kind.startswith("array<"):
        return F.coalesce(F.greatest(F.size(column), F.lit(0)), F.lit(0)) * 8 + 24
    return F.lit(8)


def bounded(table: DataFrame) -> DataFrame:
    """A table for a join: marked for broadcast if it takes at most BROADCAST_BYTES, else as it is (a shuffled join)."""
    row = F.lit(24)
    for column, kind in table.dtypes:
        row = row + _bytes_of(column, kind)
    size = table.agg(F.sum(row.cast("long")).alias("bytes")).first()["bytes"] or 0
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(df: DataFrame) -> int:
    """Shuffle partitions of the session, the number of ways that keyed work is dealt out."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
