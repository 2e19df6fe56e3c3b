"""Media columns: lossless 8-bit audio and its features as fixed-shape tensors.

``encode_media`` packs bytes into a RIFF/WAVE file of unsigned 8-bit mono samples; ``audio_features``
reads such files back, resamples them with a polyphase filter, takes overlapped log-mel filterbanks
and cuts the signal into spans of energy by hysteresis.  The log-mel patches are stored as an Arrow
stream whose ``patch`` column is a fixed-shape tensor, beside the patches' time spans.

Defined results: a null payload counts as empty; the payload is padded with zero bytes to a positive
multiple of 64, so an empty text has 64 samples.  Repeated rows give repeated rows, an empty table
an empty result.  ``encode_media`` reads the id and the text and returns three columns; other columns are not read.  Signals are walked in blocks: memory is bounded by one
payload and its features.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import documents, lean, saved

PAD = 64
RATE = 16_000
UP, DOWN, TAPS = 3, 4, 24
FRAME, HOP, MELS, PATCH = 256, 128, 32, 16
#: Spans open above the first and close below the second level, in dB over the signal's median frame.
OPEN_DB, CLOSE_DB, HANG = 1.0, 0.25, 4
BLOCK = 1 << 16
MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary"
FEATURE_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, tensors binary, spans array<struct<start_s: double, end_s: double>>"


def pack_wav(payload: bytes, rate: int = RATE) -> bytes:
    """A WAVE file of unsigned 8-bit mono samples; chunks have even length."""
    data = payload + b"\0" * (len(payload) % 2)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + data


def unpack_wav(media: bytes) -> tuple[int, memoryview]:
    """Sample rate and samples; walks the chunks as any reader of the format does."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    view, at, rate = memoryview(media), 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM is read")
        elif name == b"data":
            return rate, view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def _lowpass() -> np.ndarray:
    """Windowed-sinc filter at the lower of the two rates, as UP phases of TAPS coefficients."""
    n = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    cut = 1 / max(UP, DOWN)
    h = np.sinc(n * cut) * cut * UP * np.hamming(len(n))
    return np.ascontiguousarray(h.reshape(TAPS, UP).T[:, ::-1].T.astype(np.float32))


def _mel_bank(rate: float) -> np.ndarray:
    to_mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, to_mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, FRAME // 2 + 1)
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((f - low) / (mid - low), (high - f) / (high - mid))).T.astype(np.float32)


_FILTER, _WINDOW, _BANK = _lowpass(), np.hanning(FRAME).astype(np.float32), _mel_bank(RATE * UP / DOWN)


def resample(samples: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Output samples lo to hi (lo a multiple of UP) at UP / DOWN of the rate.

    Output UP * k + p is the p-th phase of the filter over the TAPS inputs that end at about
    DOWN * k + DOWN * p / UP; beyond the ends the signal is silent.
    """
    k0, k1 = lo // UP, -(-hi // UP)
    first = DOWN * k0 - TAPS // 2
    need = DOWN * (k1 - k0) + TAPS + DOWN
    a, b = max(0, first), min(len(samples), first + need)
    x = np.zeros(need, np.float32)
    if b > a:
        x[a - first : b - first] = samples[a:b]
        x[a - first : b - first] -= 128
    out = np.empty((k1 - k0, UP), np.float32)
    for p in range(UP):
        shift = DOWN * p // UP
        frames = np.lib.stride_tricks.as_strided(x[shift:], (k1 - k0, TAPS), (4 * DOWN, 4), writeable=False)
        out[:, p] = frames @ _FILTER[:, p]
    return out.reshape(-1)[: hi - lo]


def log_mel(samples: np.ndarray) -> np.ndarray:
    """Log-mel energies in dB, a row for each overlapped frame, as whole sixteenths of a dB."""
    n_out = -(-len(samples) * UP // DOWN)
    n_frames = max(1, 1 + -(-max(0, n_out - FRAME) // HOP))
    out = np.empty((n_frames, MELS), np.int16)
    step = BLOCK // HOP
    for f0 in range(0, n_frames, step):
        f1 = min(n_frames, f0 + step)
        lo, hi = f0 * HOP, (f1 - 1) * HOP + FRAME
        base = lo - lo % UP
        x = resample(samples, base, hi)[lo - base :]
        frames = np.lib.stride_tricks.as_strided(x, (f1 - f0, FRAME), (4 * HOP, 4), writeable=False)
        power = np.abs(np.fft.rfft(frames * _WINDOW, axis=1)).astype(np.float32) ** 2
        out[f0:f1] = np.round(160 * np.log10(power @ _BANK + 1e-3))
    return out


def energy_spans(mel: np.ndarray) -> list[tuple[int, int]]:
    """Frames [start, end) that open above OPEN_DB and end once HANG frames in a row are below CLOSE_DB."""
    level = mel.astype(np.int32).sum(axis=1) / (16 * mel.shape[1])
    level = level - np.median(level)
    above, below = np.flatnonzero(level > OPEN_DB), level < CLOSE_DB
    run = np.convolve(below, np.ones(HANG, int))[: len(below)] >= HANG
    closes = np.flatnonzero(run)
    out, at = [], 0
    while True:
        i = np.searchsorted(above, at)
        if i == len(above):
            return out
        start = int(above[i])
        j = np.searchsorted(closes, start + HANG)
        end = int(closes[j]) - HANG + 1 if j < len(closes) else len(level)
        out.append((start, end))
        at = max(end, start + 1)


_TENSOR = pa.fixed_shape_tensor(pa.int16(), [PATCH, MELS])
_TENSOR_SCHEMA = pa.schema([("patch", _TENSOR), ("start_s", pa.float64()), ("end_s", pa.float64()), ("active", pa.bool_())])


def tensor_stream(mel: np.ndarray, spans: list[tuple[int, int]], rate: float) -> bytes:
    """An Arrow stream of PATCH x MELS tensors (the last one is padded by its last frame) with their time spans."""
    n = -(-len(mel) // PATCH)
    padded = np.concatenate([mel, np.repeat(mel[-1:], n * PATCH - len(mel), axis=0)])
    active = np.zeros(n * PATCH, bool)
    for a, b in spans:
        active[a:b] = True
    start = np.arange(n) * PATCH * HOP / rate
    tensors = pa.ExtensionArray.from_storage(_TENSOR, pa.FixedSizeListArray.from_arrays(pa.array(padded.reshape(-1)), PATCH * MELS))
    batch = pa.record_batch([tensors, pa.array(start), pa.array(start + ((PATCH - 1) * HOP + FRAME) / rate), pa.array(active.reshape(n, PATCH).any(axis=1))], schema=_TENSOR_SCHEMA)
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, _TENSOR_SCHEMA) as writer:
        writer.write_batch(batch)
    return sink.getvalue()


def read_tensors(stream: bytes) -> pa.Table:
    return pa.ipc.open_stream(stream).read_all()


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            raw = [(x or "").encode() for x in part.column("text").to_pylist()]
            media = [pack_wav(x + b"\0" * (max(PAD, -(-len(x) // PAD) * PAD) - len(x))) for x in raw]
            yield pa.record_batch([part.column("doc_id").cast(pa.int64()), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in FEATURE_SCHEMA.split(", ")[:-1]][:10] + ["spans"]
    kind = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            part, rows = batch.slice(lo, 64), []
            for n_bytes, media in zip(part.column("n_bytes").to_pylist(), part.column("media").to_pylist(), strict=True):
                rate, samples = unpack_wav(media)
                mel = log_mel(np.frombuffer(samples, np.uint8))
                spans, out_rate = energy_spans(mel), rate * UP / DOWN
                tensors = tensor_stream(mel, spans, out_rate)
                digest = hashlib.sha256(np.ascontiguousarray(mel, "<i2").tobytes() + np.array(spans, "<i8").tobytes()).hexdigest()
                seconds = [{"start_s": a * HOP / out_rate, "end_s": ((b - 1) * HOP + FRAME) / out_rate} for a, b in spans]
                rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), f"logmel:{len(mel)}x{MELS}:spans={len(spans)}:{digest}", len(mel), tensors, seconds))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), kind]
            yield pa.record_batch([part.column("doc_id"), part.column("n_bytes"), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], names=names)


def encode_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and the media column of each row's bytes."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(_encode), MEDIA_SCHEMA)


def audio_features(media: DataFrame) -> DataFrame:
    """Digests of the stored bytes, log-mel tensors and time spans of each media file."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(lean(_features), FEATURE_SCHEMA)


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The media table is written, read back and described: digests, tensors of log-mel patches, time spans."""
    return audio_features(saved(encode_media(documents(spark, sf_dir)), "media"))


QUERIES = {"op4_media_columns": op4_media_columns}
