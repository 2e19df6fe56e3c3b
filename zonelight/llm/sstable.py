"""Token-id output as sorted-string-table shards.

A shard holds the token ids of a contiguous range of documents, keyed by document id.  Entries lie in
blocks in which a key stores only what differs from the key before; a sparse index has the last key
and the place of every block, a Bloom filter says which keys are surely absent, and a fixed footer finds
both.  A lookup asks the filter, bisects the index and reads one block.

File: ``blocks | index | bloom | footer``.  A block is Zstandard-compressed entries ``varint shared,
varint rest, varint value bytes, key rest, value``.  Keys are one byte (0: null id, 1: an id) and the id as
big-endian unsigned 64-bit with the sign bit flipped, so that bytes sort as ids do.  Values are
little-endian unsigned ids of 2 bytes, or of 4 where an id of the file needs them.  The index has, by block,
last key, offset, length.  All integers of the footer are little-endian 64-bit.

Defined results: a null text counts as empty; a null id sorts before all others; rows with the same id
are all kept, in the order of their texts; an empty table gives no shard and an empty result.  Shards are
written under another name and moved into place, so a repeated task leaves one whole file.
"""

from __future__ import annotations

import bisect
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._ranges import range_bounds, range_of
from ._text import WordCache, Words, documents, lean, partitions, ragged_take, row_slices, shared_dir, string_buffers
from .bpe import vocabulary_path

MAGIC = b"SSTIDS01"
BLOCK_BYTES = 1 << 16
BLOOM_BITS, BLOOM_HASHES = 10, 7
END_ID = 1
#: Stored bytes of the input by shard, where the session's partitions are fewer.
SHARD_BYTES, MOST_SHARDS = 256 << 20, 100_000
CACHE_WORDS = 1_000_000
FOOTER = struct.Struct("<QQQQQQQ8s")
META_SCHEMA = "shard int, path string, n_docs long, n_tokens long"


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + ((doc_id + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else int.from_bytes(key[1:], "big") - (1 << 63)


def _varint(n: int, out: bytearray) -> None:
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, n_bits: int) -> list[int]:
    h = zlib.crc32(key) << 32 | zlib.crc32(key[::-1], 0x5BD1E995)
    h = (h * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)
    a, b = h >> 32, (h & 0xFFFFFFFF) | 1
    return [(a + i * b) % n_bits for i in range(BLOOM_HASHES)]


class TableWriter:
    """Writes one shard; keys must come in ascending order."""

    def __init__(self, sink, wide: bool = False) -> None:  # noqa: ANN001
        self.sink, self.dtype = sink, "<u4" if wide else "<u2"
        self.block, self.last, self.at = bytearray(), b"", 0
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.tokens = 0
        self.pack = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if key < self.last:
            raise ValueError("keys must ascend")
        shared = len(os.path.commonprefix([key, self.last])) if self.block else 0
        value = ids.astype(self.dtype).tobytes()
        for n in (shared, len(key) - shared, len(value)):
            _varint(n, self.block)
        self.block += key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.tokens += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = self.pack.compress(bytes(self.block))
            self.sink.write(data)
            self.index.append((self.last, self.at, len(data)))
            self.at += len(data)
            self.block = bytearray()

    def close(self) -> tuple[int, int]:
        """Write index, filter and footer; returns entries and tokens."""
        self._flush()
        index = b"".join(struct.pack("<H", len(k)) + k + struct.pack("<QQ", a, n) for k, a, n in self.index)
        bits = np.zeros(max(64, -(-BLOOM_BITS * len(self.keys) // 64) * 64), bool)
        for k in set(self.keys):
            bits[_probes(k, len(bits))] = True
        bloom = np.packbits(bits).tobytes()
        width = int(self.dtype[-1])
        self.sink.write(index + bloom + FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), len(self.keys), self.tokens, width, MAGIC))
        return len(self.keys), self.tokens


class TableReader:
    """Reads a shard through its footer."""

    def __init__(self, source) -> None:  # noqa: ANN001
        self.source = source
        size = source.size()
        foot = self._at(size - FOOTER.size, FOOTER.size)
        index_at, index_len, bloom_at, bloom_len, self.entries, self.tokens, width, magic = FOOTER.unpack(foot)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.dtype = f"<u{width}"
        self.bits = np.unpackbits(np.frombuffer(self._at(bloom_at, bloom_len), np.uint8)).astype(bool)
        raw, at, self.index = self._at(index_at, index_len), 0, []
        while at < len(raw):
            (n,) = struct.unpack_from("<H", raw, at)
            self.index.append((raw[at + 2 : at + 2 + n], *struct.unpack_from("<QQ", raw, at + 2 + n)))
            at += 18 + n

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def _block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, offset, n = self.index[i]
        data, at, key = zstandard.ZstdDecompressor().decompress(self._at(offset, n)), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, np.frombuffer(data, self.dtype, size // int(self.dtype[-1]), at)
            at += size

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.index)):
            for key, ids in self._block(i):
                yield id_of(key), ids

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """Ids of a document (the first, if its id repeats), by filter, index and one block; None if absent."""
        key = key_of(doc_id)
        if not self.bits[_probes(key, len(self.bits))].all():
            return None
        i = bisect.bisect_left(self.index, key, key=lambda x: x[0])
        if i == len(self.index):
            return None
        return next((ids for k, ids in self._block(i) if k == key), None)


class LibraryEncoder:
    """Ids by the tokenizers library, which gets each distinct word of a worker once.

    The vocabulary drops white space and no token spans it, so a text's ids are its words' ids in order.
    Words go to the library in long strings, with a special token between them to tell them apart.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        specials = {i: t.content for i, t in self.tok.get_added_tokens_decoder().items()}
        self.mark_id, self.mark = max(specials.items())
        self.specials = list(specials.values())
        self.heads = {s[0] for s in self.specials}
        self.wide = self.tok.get_vocab_size() > 1 << 16
        self.cache = WordCache(self._words, CACHE_WORDS)

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some words in order, and how many each word has."""
        text = [w.decode() for w in words]
        odd = [i for i, w in enumerate(text) if any(h in w for h in self.heads) and any(s in w for s in self.specials)]
        plain = np.delete(np.arange(len(text)), odd)
        lens, found = np.zeros(len(text), np.int64), []
        for lo in range(0, len(plain), 512):  # without offsets, which cost the library half as much again
            part = plain[lo : lo + 512]
            ids = np.array(self.tok.encode_batch_fast([self.mark.join([text[i] for i in part.tolist()])], add_special_tokens=False)[0].ids, np.int32)
            cuts = np.flatnonzero(ids == self.mark_id)
            lens[part] = np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1
            found.append(np.delete(ids, cuts))
        for i in odd:
            found.append(np.array(self.tok.encode(text[i], add_special_tokens=False).ids, np.int32))
            lens[i] = len(found[-1])
        flat = np.concatenate([np.zeros(0, np.int32), *found])
        if not odd:
            return flat, lens
        order = np.concatenate([plain, odd]).astype(np.int64)
        starts = np.empty(len(text), np.int64)
        starts[order] = np.cumsum(lens[order]) - lens[order]
        return ragged_take(flat, starts, lens), lens

    def encode(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.cache.ids(Words(flat, offsets, lower=False), flat)


@lru_cache(maxsize=2)
def _library(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def _files(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def _bytes(df: DataFrame) -> int:
    """What Spark takes a table's size to be, as stored; 0 where it has no idea."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def write_shards(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, shards: int | None = None, end_id: int | None = END_ID) -> list[dict]:
    """Encode all texts and write them as shards below ``folder`` (a URI that every executor can write to).

    Returns shard, path, n_docs and n_tokens of each shard in key order: the only rows that reach the driver.
    """
    path = vocabulary or vocabulary_path()
    n = shards or max(partitions(df), min(MOST_SHARDS, -(-_bytes(df) // SHARD_BYTES)))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    bounds = range_bounds(rows, "doc_id", n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib, (fs, root) = _library(path), _files(folder)
        now, writer, sink, temp = None, None, None, ""
        tail = np.array([] if end_id is None else [end_id], np.int32)

        def finish() -> pa.RecordBatch:
            docs, tokens = writer.close()
            sink.close()
            name = f"{root}/shard-{now:06d}.sst"
            fs.move(temp, name)
            return pa.record_batch([pa.array([now], pa.int32()), pa.array([name]), pa.array([docs], pa.int64()), pa.array([tokens], pa.int64())], names=["shard", "path", "n_docs", "n_tokens"])

        for batch in batches:
            flat, offsets = string_buffers(batch.column("text"))
            keys, shard = batch.column("doc_id").to_pylist(), batch.column("shard").to_numpy()
            for lo, hi in row_slices(offsets, 1 << 21):
                ids, at = lib.encode(flat[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                for i in range(lo, hi):
                    if shard[i] != now:
                        if writer:
                            yield finish()
                        now, temp = int(shard[i]), f"{root}/.tmp-{int(shard[i]):06d}-{uuid.uuid4().hex}"
                        fs.create_dir(root, recursive=True)
                        sink = fs.open_output_stream(temp)
                        writer = TableWriter(sink, lib.wide)
                    writer.add(key_of(keys[i]), np.concatenate([ids[at[i - lo] : at[i - lo + 1]], tail]))
        if writer:
            yield finish()

    dealt = rows.withColumn("shard", range_of("doc_id", bounds)).repartitionById(n, "shard").sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "text")
    found = {r["shard"]: r.asDict() for r in dealt.mapInArrow(lean(run), META_SCHEMA).collect()}
    return [found[k] for k in sorted(found)]


def read_shards(spark: SparkSession, folder: str, shards: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens and ids (binary) of every entry; shards are read in parallel, block by block."""
    return _scan(spark, folder, shards, digest=False)


def _scan(spark: SparkSession, folder: str, shards: list[dict], digest: bool) -> DataFrame:
    start, listed = 0, []
    for s in shards:
        listed.append((s["path"], start))
        start += s["n_tokens"]
    last = "ids_crc32 long" if digest else "ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _files(folder)
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist(), strict=True):
                with fs.open_input_file(path) as f:
                    cols: tuple[list, list, list, list] = ([], [], [], [])
                    for doc_id, ids in TableReader(f).scan():
                        raw = ids.astype("<u4").tobytes()
                        for c, v in zip(cols, (doc_id, first, len(ids), zlib.crc32(raw) if digest else raw), strict=True):
                            c.append(v)
                        first += len(ids)
                        if len(cols[0]) == 512:
                            yield made(cols)
                            cols = ([], [], [], [])
                    yield made(cols)

    def made(cols: tuple) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64() if digest else pa.binary()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "start", "n_tokens", last.split()[0]])

    files = spark.createDataFrame(listed, "path string, first long")
    return files.repartition(max(1, len(listed))).mapInArrow(lean(run), f"doc_id long, start long, n_tokens long, {last}")


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "shards")
    return _scan(spark, folder, write_shards(documents(spark, sf_dir), folder), digest=True)


QUERIES = {"op8_token_shards": op8_token_shards}
