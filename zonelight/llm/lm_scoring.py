"""Language-model scoring with a weighted backoff automaton.

Training counts of words and word pairs are smoothed as a hierarchical Dirichlet model:
P1(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)),  P2(w | h) = (c(hw) + MU * P1(w)) / (c(h) + MU).
Contexts become states; a seen pair is an arc with its smoothed log probability, and a state's failure arc
costs MU / (c(h) + MU) and leads to the root, whose arcs are the words.  A text is one left-to-right
traversal that carries the state and adds up log10 probabilities, its end included.

The model is as large as the corpus, so nobody holds it whole.  Documents are dealt into chunks of
bounded size by hash of the row and its place, so that repeated rows spread.  Each chunk sends its distinct n-grams, with its training counts, to fragments of
the n-gram hash space, a row for each fragment it has any in, so there are never more rows than n-grams; a fragment adds up the counts and answers every chunk with the totals of what it
sent; with the answers each chunk builds the part of the automaton that its own texts can reach.  A hot
n-gram costs a fragment one entry for each chunk.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end token; n-grams are 64-bit hashes.
Defined results: a null text counts as empty and has one token, its end; a null id counts as the empty string
when documents are split into training and held-out; repeated rows are trained on and scored as often as
given; an empty table gives an empty result; with no training document every score is that of P1 alone, which
is then 1 for each token.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import Words, documents, lean, mix64, ngram_hashes, partitions, string_buffers

MU = 50.0
CHUNK_CHARS = 16_000_000
SEGMENT_TOKENS = 256
END, START = mix64(np.array([0x0E0D, 0x57A7], dtype=np.uint64))
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class Ngrams:
    """Tokens of a chunk's texts as indices of its distinct words, and its distinct pairs."""

    def __init__(self, text: pa.ChunkedArray) -> None:
        words = Words(*string_buffers(text))
        n = np.diff(words.bounds)
        self.n_tokens = n + 1
        total = len(words.hashes) + len(n)
        hashes = np.empty(total, np.uint64)
        self.ends = np.cumsum(self.n_tokens) - 1
        inner = np.ones(total, bool)
        inner[self.ends] = False
        hashes[inner] = words.hashes
        hashes[self.ends] = END
        self.words, self.token = np.unique(hashes, return_inverse=True)
        self.width = np.int64(len(self.words) + 1)  # the last index is the start of a text
        before = np.empty(total, np.int64)
        before[1:] = self.token[:-1]
        before[self.ends - self.n_tokens + 1] = self.width - 1
        self.pair_of = before * self.width + self.token
        self.pairs, self.pair_at = np.unique(self.pair_of, return_inverse=True)
        with_start = np.concatenate([self.words, [START]])
        keys2 = _pair_keys(with_start[self.pairs // self.width], self.words[self.pairs % self.width])
        keys1 = mix64(self.words) | np.uint64(1)
        #: distinct keys of both orders in ascending order; two n-grams that share a key share counts
        self.keys, place = np.unique(np.concatenate([keys1, keys2]), return_inverse=True)
        self.place1, self.place2 = place[: len(keys1)], place[len(keys1) :]

    def counts(self, train: np.ndarray) -> np.ndarray:
        """Occurrences of each key in the texts marked in train."""
        weight = np.repeat(train, self.n_tokens).astype(np.float64)
        out = np.bincount(self.place1, np.bincount(self.token, weight, len(self.words)), len(self.keys))
        out += np.bincount(self.place2, np.bincount(self.pair_at, weight, len(self.pairs)), len(self.keys))
        return out.astype(np.int64)


def _pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    both = np.empty((len(left), 2), np.uint64)
    both[:, 0], both[:, 1] = left, right
    return ngram_hashes(both.reshape(-1), 2)[::2] & ~np.uint64(1)


def pack_counts(counts: np.ndarray) -> bytes:
    """A byte for each count, and the exact values of those over 254 after them."""
    small = np.minimum(counts, 255).astype(np.uint8)
    big = np.flatnonzero(small == 255)
    return small.tobytes() + big.astype("<u4").tobytes() + counts[big].astype("<i8").tobytes()


def unpack_counts(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    big = (len(raw) - n) // 12
    out[np.frombuffer(raw, "<u4", big, n)] = np.frombuffer(raw, "<i8", big, n + 4 * big)
    return out


def _fragment_cuts(keys: np.ndarray, fragments: int) -> np.ndarray:
    """Bounds of the fragments, which are ranges of the hash space, in ascending keys."""
    frag = (keys >> np.uint64(32)).astype(np.int64) * fragments >> 32
    return np.searchsorted(frag, np.arange(fragments + 1))


def _asked(fragments: int):  # noqa: ANN202
    def run(table: pa.Table) -> pa.Table:
        grams = Ngrams(table.column("text"))
        counts = grams.counts(table.column("train").to_numpy())
        cuts = _fragment_cuts(grams.keys, fragments).tolist()
        spans = list(zip(cuts[:-1], cuts[1:], strict=True))
        chunk, full = table.column("chunk")[0].as_py(), [f for f, (a, b) in enumerate(spans) if b > a]
        spans = [spans[f] for f in full]
        return pa.table({"frag": pa.array(full, pa.int32()), "chunk": pa.array([chunk] * len(full), pa.int32()), "keys": pa.array([grams.keys[a:b].tobytes() for a, b in spans], pa.binary()), "counts": pa.array([pack_counts(counts[a:b]) for a, b in spans], pa.binary())})

    return run


def _summed(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of what each chunk asked of a fragment, the fragment's keys, the place of each asked one, and total counts."""
    keys = [np.frombuffer(k, np.uint64) for k in table.column("keys").to_pylist()]
    counts = [unpack_counts(c, len(k)) for c, k in zip(table.column("counts").to_pylist(), keys, strict=True)]
    uniq, at = np.unique(np.concatenate(keys), return_inverse=True)
    return np.array([len(k) for k in keys]), uniq, at, np.bincount(at, np.concatenate(counts), len(uniq)).astype(np.int64)


def _answered(table: pa.Table) -> pa.Table:
    """Total counts of a fragment, for every chunk in the order in which it asked."""
    lens, _, at, total = _summed(table)
    ends = np.cumsum(lens)
    out = [pack_counts(total[at[b - n : b]]) for b, n in zip(ends.tolist(), lens.tolist(), strict=True)]
    return pa.table({"chunk": table.column("chunk"), "frag": table.column("frag"), "n": pa.array(lens, pa.int64()), "totals": pa.array(out, pa.binary())})


def _sizes(table: pa.Table) -> pa.Table:
    """Distinct words and tokens of a fragment that training texts have."""
    _, uniq, _, total = _summed(table)
    single = (uniq & np.uint64(1)).astype(bool) & (total > 0)
    return pa.table({"types": pa.array([int(single.sum())], pa.int64()), "tokens": pa.array([int(total[single].sum())], pa.int64())})


class Automaton:
    """The part of the model that a chunk can reach.

    State i is the context of the chunk's i-th word, or the start of a text; the root is one state beyond.
    """

    def __init__(self, grams: Ngrams, count1: np.ndarray, count2: np.ndarray, types: int, tokens: int, starts: int, mu: float = MU) -> None:
        self.width, self.root = int(grams.width), int(grams.width)
        p1 = (count1 + 0.5) / (tokens + 0.5 * (types + 1))
        self.root_arc = np.log10(p1)
        context = np.concatenate([count1, [starts]]).astype(float)
        self.is_state = context > 0
        self.failure = np.log10(mu / (context + mu))
        seen = count2 > 0
        self.arcs = grams.pairs[seen]
        h, w = self.arcs // grams.width, self.arcs % grams.width
        self.arc_weight = np.log10((count2[seen] + mu * p1[w]) / (context[h] + mu))

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of many traversals: weights and next states."""
        code = state * self.width + word
        at = np.minimum(np.searchsorted(self.arcs, code), max(0, len(self.arcs) - 1))
        inner = state < self.root
        hit = inner & (self.arcs[at] == code) if len(self.arcs) else np.zeros(len(state), bool)
        weight = self.root_arc[word]
        fails = inner & ~hit
        weight[fails] += self.failure[state[fails]]
        weight[hit] = self.arc_weight[at[hit]]
        return weight, np.where(self.is_state[word], word, self.root)

    def traverse(self, tokens: np.ndarray, begins: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Sum of weights of each text; text i has tokens begins[i] to begins[i] + lens[i].

        Long texts are walked as segments side by side; a segment enters with the state of the token before it.
        """
        pieces = -(-lens // SEGMENT_TOKENS)
        owner = np.repeat(np.arange(len(lens)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = begins[owner] + nth * SEGMENT_TOKENS
        size = np.minimum(SEGMENT_TOKENS, lens[owner] - nth * SEGMENT_TOKENS)
        order = np.argsort(-size, kind="stable")
        at, size, owner, nth = at[order], size[order], owner[order], nth[order]
        start = self.width - 1 if self.is_state[-1] else self.root
        before = tokens[np.maximum(at - 1, 0)]
        state = np.where(nth == 0, start, np.where(self.is_state[before], before, self.root))
        total = np.zeros(len(owner))
        for t in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -t, "left"))
            weight, state = self.step(state[:live], tokens[at[:live] + t])
            total[:live] += weight
        return np.bincount(owner, total, len(lens))


def _scored(mu: float):  # noqa: ANN202
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({n: pa.array([], k) for n, k in zip(_NAMES, _KINDS, strict=True)})
        grams = Ngrams(docs.column("text"))
        order = np.argsort(answers.column("frag").to_numpy(), kind="stable").tolist()
        raw, lens = answers.column("totals").to_pylist(), answers.column("n").to_pylist()
        totals = np.concatenate([unpack_counts(raw[i], lens[i]) for i in order])
        types, tokens = (answers.column(c)[0].as_py() for c in ("types", "tokens"))
        count1, count2 = totals[grams.place1], totals[grams.place2]
        # each training text has one end, so their number is the count of ends
        starts = int(count1[np.searchsorted(grams.words, END)])
        auto = Automaton(grams, count1, count2, types, tokens, starts, mu)
        begins = grams.ends - grams.n_tokens + 1
        base = np.add.reduceat(auto.root_arc[grams.token], begins)
        known = np.add.reduceat((count1 > 0)[grams.token].astype(np.int64), begins)
        score = auto.traverse(grams.token, begins, grams.n_tokens)
        train = docs.column("train").to_numpy()
        columns = [docs.column("doc_id"), ~train, grams.n_tokens, known, np.full(len(train), tokens), base, score]
        return pa.table({n: c if isinstance(c, pa.ChunkedArray) else pa.array(c, k) for n, k, c in zip(_NAMES, _KINDS, columns, strict=True)})

    return run


_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_KINDS = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]


def _dealt(rows: DataFrame, chunks: int) -> DataFrame:
    """rows with the chunk of each; a row's place in its file keeps repeated rows from meeting in one chunk."""
    place = F.pmod(F.monotonically_increasing_id(), F.lit(4096))
    return rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text", place), F.lit(chunks)).cast("int"))


def score(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", mu: float = MU) -> DataFrame:
    """Scores of all rows under a model of those for which ``train`` holds (null: it doesn't)."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    chars = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    chunks = max(partitions(df), -(-chars // CHUNK_CHARS))
    dealt = _dealt(rows, chunks)
    asked = dealt.groupBy("chunk").applyInArrow(lean(_asked(chunks)), "frag int, chunk int, keys binary, counts binary")
    answers = asked.groupBy("frag").applyInArrow(lean(_answered), "chunk int, frag int, n long, totals binary").withColumn("all", F.lit(1))
    sizes = asked.groupBy("frag").applyInArrow(lean(_sizes), "types long, tokens long").agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens")).withColumn("all", F.lit(1))
    answers = answers.join(F.broadcast(sizes), "all").select("chunk", "frag", "n", "totals", "types", "tokens")  # one row, for every answer
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lean(_scored(mu)), SCHEMA)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) != 1
    return score(documents(spark, sf_dir), train)


QUERIES = {"op1_lm_scoring": op1_lm_scoring}
