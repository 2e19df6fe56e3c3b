"""BPE encoding and decoding with a public word-end vocabulary.

Each distinct short word of a batch holds a contiguous array of part boundaries with the rank of
every adjacent pair.  The lowest rank is looked for again and again, its boundary is deleted and the
neighbouring ranks are refreshed, until no pair has a rank.  All words of a batch take these steps
together, as rows of a NumPy matrix.  A worker keeps what it has encoded, up to ``CACHE_WORDS`` words;
the cache only saves time.

Defined results: a null text counts as empty and has no ids; repeated rows are encoded alike; an empty
table gives an empty result; columns other than the id and the text are not read.  Texts are encoded
whole, in batches bounded by bytes.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import WordCache, Words, documents, lean, ragged_take, row_slices, small_batches, string_buffers

VOCABULARY = "word_bpe_49k.json"
CACHE_WORDS = 1_000_000
#: Words beyond this many parts are not padded to rows of a matrix but take the same steps by themselves.
ROW_PARTS = 40
NO_RANK = np.int32(2**31 - 1)
SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"
_SPACES = r"\t\n\x0b\x0c\r \x85\xa0  -     　"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the installed public vocabulary file lies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(keep))}
    return [chr(rest.get(b, b)) for b in range(256)]


class RankBPE:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *special.values()]) + 1
        alphabet = _byte_alphabet()
        pieces = [b""] * size
        for t, i in {**vocab, **special}.items():
            pieces[i] = t.encode()
        lens = np.array([len(x) for x in pieces])
        self.piece_flat, self.piece_lens = np.frombuffer(b" ".join(pieces) + b" ", np.uint8), lens + 1
        self.piece_starts = np.cumsum(self.piece_lens) - self.piece_lens
        self.byte_id = np.array([vocab[c] for c in alphabet], np.int32)
        self.last_id = np.array([vocab[c + self.suffix] for c in alphabet], np.int32)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        left, right = np.array([vocab[a] for a, _ in pairs], np.int64), np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = left << 20 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], np.arange(len(pairs), dtype=np.int32)[order], made[order]
        # a direct-address table from the mixed key halves the cost of a binary search
        self.shift = np.uint64(64 - 18)
        slot = self._slot(self.keys)
        by = np.argsort(slot, kind="stable")
        self.keys, self.rank, self.made, slot = self.keys[by], self.rank[by], self.made[by], slot[by]
        self.slot_at = np.searchsorted(slot, np.arange((1 << 18) + 1))
        self.deep = int(np.diff(self.slot_at).max())
        self.keys = np.concatenate([self.keys, np.full(self.deep + 1, -1)])
        self.rank = np.concatenate([self.rank, np.full(self.deep + 1, NO_RANK, np.int32)])
        self.made = np.concatenate([self.made, np.full(self.deep + 1, -1, np.int32)])
        self.made_by_rank = made
        self.special = special
        self.specials = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + _SPACES + r"\p{L}\p{N}]+")
        self.spaces = regex.compile(f"[{_SPACES}]+")
        self.cache = WordCache(self._encoded, CACHE_WORDS)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NO_RANK for pairs that never merge."""
        key = left.astype(np.int64) << 20 | right
        at = self.slot_at[self._slot(key)]
        out = np.full(key.shape, NO_RANK, np.int32)
        for d in range(self.deep):
            hit = self.keys[at + d] == key
            out[hit] = self.rank[at + d][hit]
        return out

    def merge_rows(self, ids: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the parts of all rows of a matrix of ids (row i has lens[i] parts); returns parts and lens."""
        n, width = ids.shape
        ids, lens = ids.copy(), lens.copy()
        rank = np.full((n, width), NO_RANK, np.int32)
        if width > 1:
            inside = np.arange(width - 1)[None, :] < (lens - 1)[:, None]
            rank[:, :-1][inside] = self.ranks(ids[:, :-1][inside], ids[:, 1:][inside])
        alive, column = np.arange(n), np.arange(width)[None, :]
        while len(alive):
            best = rank[alive].argmin(axis=1)
            low = rank[alive, best]
            go = low != NO_RANK
            alive, best, low = alive[go], best[go], low[go]
            if not len(alive):
                break
            # delete the boundary after part `best`: later parts and ranks move one to the left
            take = np.minimum(column + (column > best[:, None]), width - 1)
            row, row_rank = np.take_along_axis(ids[alive], take, 1), np.take_along_axis(rank[alive], take, 1)
            k = np.arange(len(alive))
            row[k, best] = self.made_by_rank[low]
            lens[alive] -= 1
            row_rank[:, -1] = NO_RANK
            row_rank[k, np.maximum(lens[alive] - 1, 0)] = NO_RANK
            # the ranks on both sides of the new part are stale
            has = best < lens[alive] - 1
            row_rank[k[has], best[has]] = self.ranks(row[k[has], best[has]], row[k[has], best[has] + 1])
            has = best > 0
            row_rank[k[has], best[has] - 1] = self.ranks(row[k[has], best[has] - 1], row[k[has], best[has]])
            ids[alive], rank[alive] = row, row_rank
        return ids, lens

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """The same steps for one long word: its contiguous array of ranks is scanned for the lowest, and all boundaries
        of that rank go in one pass, left before right where two overlap.

        Where a neighbouring rank would come out as low, only the first goes, so the order is that of single steps.
        There are at most as many passes as ranks, so the cost is linear in the length of the word.
        """
        ids = ids.astype(np.int32, copy=True)
        rank = self.ranks(ids[:-1], ids[1:])
        while len(rank) and (low := rank.min()) != NO_RANK:
            at = np.flatnonzero(rank == low)
            if len(at) > 1:
                place = np.arange(len(at))
                begins = np.concatenate(([True], np.diff(at) != 1))
                at = at[(place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0]
            made = self.made_by_rank[low]
            if len(at) > 1:
                left, right = at[at > 0], at[at + 2 < len(ids)]
                near = np.concatenate([self.ranks(ids[left - 1], np.full(len(left), made)), self.ranks(np.full(len(right), made), ids[right + 2])])
                if len(near) and near.min() <= low:
                    at = at[:1]
            ids[at] = made
            ids, rank = np.delete(ids, at + 1), np.delete(rank, at)
            new = at - np.arange(len(at))
            stale = np.unique(np.concatenate([new[new < len(rank)], new[new > 0] - 1]))
            rank[stale] = self.ranks(ids[stale], ids[stale + 1])
        return ids

    def split(self, text: str) -> list[str]:
        """Normalised short words of a piece of text without special tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.words.findall(text.lower())

    def parts(self, text: str) -> list[tuple[int, str]]:
        """(special id or -1, short word) in order."""
        if self.specials is None or "<" not in text:
            return [(-1, w) for w in self.split(text)]
        return [x for p in self.specials.split(text) if p for x in ([(self.special[p], "")] if p in self.special else [(-1, w) for w in self.split(p)])]

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each of some texts without white space (or with: white space only separates)."""
        cut = [self.parts(w) for w in words]
        short = {w: i for i, w in enumerate(dict.fromkeys(w for x in cut for s, w in x if s < 0))}
        raw = [w.encode() for w in short]
        lens = np.array([len(x) for x in raw], np.int64)
        done: list[np.ndarray] = [np.zeros(0, np.int32)] * len(raw)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        starts = np.cumsum(lens) - lens
        order = np.argsort(lens, kind="stable")
        at = 0
        while at < len(order):
            width = int(lens[order[at]])
            upto = int(np.searchsorted(lens[order], min(max(width + 3, 6), max(ROW_PARTS, width)), "right"))
            if width > ROW_PARTS:
                i = int(order[at])
                b = flat[starts[i] : starts[i] + lens[i]]
                ids = self.byte_id[b].copy()
                ids[-1] = self.last_id[b[-1]]
                done[i] = self.merge_long(ids)
                at += 1
                continue
            upto = min(upto, at + 20_000)
            rows = order[at:upto]
            wide = int(lens[rows].max())
            ids = np.zeros((len(rows), wide), np.int32)
            inside = np.arange(wide)[None, :] < lens[rows][:, None]
            body = ragged_take(flat, starts[rows], lens[rows])
            ids[inside] = self.byte_id[body]
            ends = lens[rows] - 1
            k = np.arange(len(rows))
            ids[k, ends] = self.last_id[flat[starts[rows] + ends]]
            merged, n = self.merge_rows(ids, lens[rows])
            for i, row, m in zip(rows.tolist(), merged, n.tolist(), strict=True):
                done[i] = row[:m].copy()
            at = upto
        out = []
        for x in cut:
            if len(x) == 1 and x[0][0] < 0:
                out.append(done[short[x[0][1]]])
            else:
                out.append(np.concatenate([np.array([s], np.int32) if s >= 0 else done[short[w]] for s, w in x]) if x else np.zeros(0, np.int32))
        return out

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.encode_words([w.decode() for w in words])
        return np.concatenate([np.zeros(0, np.int32), *ids]), np.array([len(x) for x in ids], np.int64)

    def encode_flat(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a batch, and the bounds of each row's ids; each distinct word is encoded once."""
        return self.cache.ids(Words(flat, offsets, lower=False), flat)

    def decode_flat(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, each followed by a space, and the bounds of each id's bytes."""
        lens = self.piece_lens[ids]
        return ragged_take(self.piece_flat, self.piece_starts[ids], lens), np.concatenate([[0], np.cumsum(lens)])

    def decode(self, ids: np.ndarray) -> str:
        """The tokens joined by spaces, as a tokenizer without a decoder does."""
        return self.decode_flat(np.asarray(ids, np.int64))[0].tobytes()[:-1].decode()


@lru_cache(maxsize=2)
def encoder(path: str) -> RankBPE:
    return RankBPE(path)


def encode_decode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and decoded text of each row; with ``digests``, SHA-256 of both instead."""
    path = vocabulary or vocabulary_path()
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            flat, offsets = string_buffers(batch.column("text"))
            for lo, hi in row_slices(offsets, 1 << 21):
                ids, bounds = bpe.encode_flat(flat[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                raw = ids.astype("<u4").tobytes()
                spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
                ids_of = [raw[4 * a : 4 * b] for a, b in spans]
                text_of = []
                back = np.frombuffer(raw, "<u4").astype(np.int64)
                body, at = bpe.decode_flat(back)
                body = body.tobytes()
                cuts = at[bounds].tolist()
                text_of = [body[a : max(a, b - 1)] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                if digests:
                    cols = [pa.array([hashlib.sha256(x).hexdigest() for x in ids_of], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in text_of], pa.string())]
                else:
                    cols = [pa.array(ids_of, pa.binary()), pa.array(text_of, pa.binary()).cast(pa.string())]
                yield pa.record_batch([batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(bounds), pa.int64()), *cols], names=names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["doc_id", "n_tokens", "ids", "decoded"]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else SCHEMA
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), schema)


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir), digests=True)


QUERIES = {"op7_bpe_round_trip": op7_bpe_round_trip}
