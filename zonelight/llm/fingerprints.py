"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Each shingle is hashed once; the hash's high bits choose a bin, and a bin keeps its least hash.  An empty
bin copies a bin that a sequence of hashes of the empty bin's number finds first among the full ones, so
that any two fingerprints probe alike.  Of each bin the low ``BITS`` bits are stored.  Equal bins estimate
the Jaccard likeness J after correction for chance matches: J = (m - 2^-b) / (1 - 2^-b).

Shingles are five words, lower-cased A-Z; fewer words count as one shingle.  Defined results: a null text
counts as empty; an empty text has the fingerprint of all zero bytes, is like another empty text to degree 1
and like any other text to degree 0; equal texts have equal fingerprints.  Rows with the same id are
ordered by their texts; null ids come last.  In a table of one row the next document is the row itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._ranges import range_bounds, range_of
from ._text import Words, documents, lean, mix64, partitions, row_slices, shingle_sets, string_buffers

BINS, BITS, SHINGLE = 256, 8, 5
FULL = np.uint64(2**64 - 1)
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _probe_table(bins: int, depth: int = 4096) -> np.ndarray:
    """Bin that each empty bin looks at in each attempt: a 2-universal sequence, the same for all documents."""
    at = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(depth) + np.arange(depth, dtype=np.uint64)[None, :]
    return (mix64(at.reshape(-1) + np.uint64(0x51ED270B)) % np.uint64(bins)).astype(np.uint8).reshape(bins, depth)


_PROBES = _probe_table(BINS)
_STEPS = [0, 16, 128, 1024, 4096]


def densified(bins: np.ndarray) -> np.ndarray:
    """Fill empty bins (FULL) by optimal densification; all empty stays so."""
    full = bins != FULL
    left = np.flatnonzero(~full)
    if not len(left) or len(left) == len(bins):
        return bins
    if len(left) == len(bins) - 1:  # every sequence ends at the only full bin
        return np.full_like(bins, bins[full][0])
    out = bins.copy()
    for a, b in zip(_STEPS[:-1], _STEPS[1:], strict=True):
        probes = _PROBES[left, a:b]
        hits = full[probes]
        first = hits.argmax(axis=1)
        k = np.arange(len(left))
        found = hits[k, first]
        out[left[found]] = bins[probes[k[found], first[found]]]
        left = left[~found]
        if not len(left):
            return out
    out[left] = bins[np.flatnonzero(full)[left % int(full.sum())]]  # odds under 10^-13 a bin with two full ones
    return out


def fingerprint(shingles: np.ndarray) -> np.ndarray:
    """Packed low bits of a set of shingle hashes, or zeros for the empty set (which ``likeness`` tells apart by ``is_empty``)."""
    if not len(shingles):
        return np.zeros(BINS, np.uint8)
    h = mix64(shingles)
    bins = np.full(BINS, FULL, np.uint64)
    which = (h >> np.uint64(56)).astype(np.int64) % BINS
    np.minimum.at(bins, which, h & np.uint64((1 << 56) - 1))
    low = (mix64(densified(bins)) & np.uint64(0xFF)).astype(np.uint8)
    return low | np.uint8(not low.any())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard likeness of two fingerprints, corrected for chance matches of BITS bits."""
    if not a.any() or not b.any():
        return float(a.any() == b.any())
    chance = 2.0**-BITS
    return float(min(1.0, max(0.0, ((a == b).mean() - chance) / (1 - chance))))


def fingerprints_of(texts: list[str]) -> list[np.ndarray]:
    flat, offsets = string_buffers(pa.array(texts, pa.large_string()))
    out: list[np.ndarray] = []
    for lo, hi in row_slices(offsets):
        words = Words(flat[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        out += [fingerprint(s) for s in shingle_sets(words, SHINGLE)]
    return out


def fingerprint_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the packed fingerprint (binary) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                prints = fingerprints_of(part.column("text").fill_null("").to_pylist())
                yield pa.record_batch([part.column("doc_id"), pa.array([p.tobytes() for p in prints], pa.binary())], names=["doc_id", "fingerprint"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, fingerprint binary")


def with_next(df: DataFrame, n: int) -> DataFrame:
    """Rows of ascending ranges of doc_id, ``shard``, each range in descending order with the next range's first row after its last.

    ``border`` marks that extra row.  One shuffle of the texts; what the driver gets is a row for each range.
    """
    bounds = range_bounds(df, "doc_id", n)
    placed = df.withColumn("shard", range_of("doc_id", bounds))
    tops = {r["shard"]: (r["top"], r["n"]) for r in placed.groupBy("shard").agg(F.max("doc_id").alias("top"), F.count("*").alias("n")).collect()}
    order = sorted(tops, reverse=True)
    targets: dict = {}
    for i, s in enumerate(order):
        targets.setdefault(tops[order[(i + 1) % len(order)]][0], []).append(s)
    keyed = [(k, v) for k, v in targets.items()]
    heads = df.sparkSession.createDataFrame(keyed, "top long, shards array<int>")
    first = placed.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("top"))).groupBy("doc_id", "shards").agg(F.min("text").alias("text"))
    border = first.select("doc_id", "text", F.explode("shards").alias("shard"), F.lit(True).alias("border"))
    both = placed.select("doc_id", "text", "shard", F.lit(False).alias("border")).unionByName(border)
    return both.repartitionById(n, "shard").sortWithinPartitions("shard", "border", F.desc_nulls_last("doc_id"), "text")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    held: list[tuple] = []  # rows that wait for the one after them

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        """All but the last of some consecutive rows of a shard."""
        texts = [r[1] for r in rows]
        edited = []
        for a, b in zip(texts[:-1], texts[1:], strict=True):
            half = len(a) // 2
            edited.append(a[: len(a) - half] + b[:half])
        prints = fingerprints_of(texts + edited)
        own, other = prints[: len(texts)], prints[len(texts) :]
        cols = [
            [r[0] for r in rows[:-1]],
            [len(t) for t in texts[:-1]],
            [hashlib.sha256(t.encode()).hexdigest() for t in edited],
            [p.tobytes().hex() for p in own[:-1]],
            [p.tobytes().hex() for p in other],
            [likeness(a, b) for a, b in zip(own[:-1], other, strict=True)],
            [likeness(a, b) for a, b in zip(own[:-1], own[1:], strict=True)],
        ]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    size, shard = 0, None
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            for row in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("shard").to_pylist(), strict=True):
                if row[2] != shard:
                    if len(held) > 1:
                        yield emit(held)
                    held, size, shard = [], 0, row[2]
                held.append(row)
                size += len(row[1])
                if size > 1 << 20:
                    if len(held) > 1:
                        yield emit(held)
                    held, size = held[-1:], len(row[1])
    if len(held) > 1:
        yield emit(held)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return with_next(docs, partitions(docs)).mapInArrow(lean(_compared), SCHEMA)


QUERIES = {"op10_fingerprints": op10_fingerprints}
