"""A deterministic events table of any size, for tests and measurements of pruning.

Row r with h = splitmix64(r): id = r and ts are clustered, user_id and event_id are scattered, amount is a
scattered decimal, region has eight values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession

from ..operators.build import IndexField
from .files import opened

# Fixed values of the benchmark's events table.
TS_BASE, TS_STEP, USERS, AMOUNTS = 1_600_000_000_000_000, 1_000_000, 10_000_000, 10_000_000
REGIONS = ["af", "as", "eu", "na", "sa", "oc", "me", "an"]

SCHEMA = pa.schema([("id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()), ("event_id", pa.string()), ("amount", pa.decimal128(12, 2)), ("region", pa.string())])
INDEX = [IndexField("id", 1), IndexField("ts", 2), IndexField("user_id", 3, True), IndexField("event_id", 4, True), IndexField("amount", 5), IndexField("region", 6)]


def splitmix64(r: np.ndarray) -> np.ndarray:
    # The constants of SplitMix64.
    z = r.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


def rows(start: int, n: int) -> pa.Table:
    r = np.arange(start, start + n, dtype=np.int64)
    h = splitmix64(r)
    cents = (h % np.uint64(AMOUNTS)).astype(np.int64)
    wide = np.zeros((n, 2), np.int64)
    wide[:, 0] = cents
    amount = pa.Array.from_buffers(pa.decimal128(12, 2), n, [None, pa.py_buffer(wide.tobytes())])
    columns = [pa.array(r), pa.array(TS_BASE + r * TS_STEP).cast(pa.timestamp("us")), pa.array((h % np.uint64(USERS)).astype(np.int64)), pa.array([f"evt-{x:016x}" for x in h.tolist()]), amount, pa.array(REGIONS).take(pa.array((h % np.uint64(8)).astype(np.int64)))]
    return pa.table(columns, schema=SCHEMA)


def event_name(r: int) -> str:
    return f"evt-{int(splitmix64(np.array([r]))[0]):016x}"


def user_of(r: int) -> int:
    return int(splitmix64(np.array([r]))[0] % np.uint64(USERS))


def write_file(uri: str, start: int, n: int, rows_per_group: int) -> None:
    """One file of row groups of the given size; holds one of them in memory."""
    fs, path = opened(uri)
    with fs.open_output_stream(path) as sink, pq.ParquetWriter(sink, SCHEMA, compression="snappy") as writer:
        for at in range(start, start + n, rows_per_group):
            writer.write_table(rows(at, min(rows_per_group, start + n - at)), row_group_size=rows_per_group)


def write_files(spark: SparkSession, folder: str, n: int, files: int, rows_per_group: int) -> list[str]:
    """The table as several files, written by the executors."""
    fs, root = opened(folder)
    fs.create_dir(root, recursive=True)
    size = -(-n // files)
    listed = [(f"{folder}/part-{k:05d}.parquet", k * size, min(size, n - k * size)) for k in range(files) if k * size < n]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start, count in zip(*(batch.column(c).to_pylist() for c in ("uri", "start", "count")), strict=True):
                write_file(uri, start, count, rows_per_group)
                yield pa.record_batch([pa.array([uri])], names=["uri"])

    frame = spark.createDataFrame(listed, "uri string, start long, count long").repartition(len(listed))
    return sorted(r["uri"] for r in frame.mapInArrow(run, "uri string").collect())
