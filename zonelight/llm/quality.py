"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A document's evidence is a logistic classifier on the shape of its text and on words that mark toxic
labels; it is fitted on at most ``FIT_ROWS`` labelled documents, chosen by hash of their ids.  Evidence is
summed by path within host, by host, and over all; a host's posterior shrinks towards the global mean and a
path's towards its host's, by as much as the spread between sites suggests (method of moments), so a
sparse site says little.  A document's own evidence is left out of its site's.  The site's posterior takes the
place of the global prior in the document's odds.  Documents with low odds of quality, or likely toxic, are
rejected.

Hosts and paths are columns, or the host and first folder of a URL column.  The documents table has no URLs: its
``source`` stands for the host and its ``lang`` for the path.  Words are ``[^\\x20\\x09-\\x0D]+``
with A-Z lower-cased.  Defined results: a null text counts as empty; a null host or path is a site of its own;
labels without a quality are not used and a missing toxic label counts as 0; an id with several labels takes
the least; without labels of both classes nothing is rejected on that ground; repeated rows are judged
alike; an empty table gives an empty result.  Other columns pass through ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import SPACE, Words, bounded, documents, drop, lean, row_slices, saved, string_buffers

FIT_ROWS = 16_000
#: Words of a toxic class: documents of the half that finds them that must have them, and least log odds.
LEAST_DOCS, LEAST_ODDS = 4, 3.0
MAX_WORDS = 20_000
RIDGE = 1.0
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#$%&*|!@^~<>{}[]\\=+_")] = True
UNPUNCTUATED = np.arange(256, dtype=np.uint8)
UNPUNCTUATED[list(b".,;:!?\"'()[]|")] = 32
FEATURES = ["words", "upper", "symbols", "digits", "bars", "distinct", "repeats", "stops", "length", "high", "top"]


def shapes(flat: np.ndarray, offsets: np.ndarray, words: Words) -> np.ndarray:
    """Features of the shape of each text, a row each."""
    n = len(offsets) - 1
    at = np.concatenate([flat, np.zeros(1, np.uint8)])
    empty = offsets[1:] == offsets[:-1]

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    size = np.maximum(count(~SPACE[at[:-1]]), 1)
    caps, small = (flat >= 65) & (flat <= 90), (flat >= 97) & (flat <= 122)
    caps_n, small_n = count(caps), count(small)
    bounds, h = words.bounds, words.hashes
    n_words = np.diff(bounds).astype(float)
    row = words.rows()
    safe = np.maximum(n_words, 1)
    by_row = lambda mask: np.bincount(row[mask], minlength=n) if len(row) else np.zeros(n)
    order = np.lexsort((h, row))
    hs, rs = h[order], row[order]
    first = np.ones(len(hs), bool)
    first[1:] = (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])
    groups = np.flatnonzero(first)
    runs = np.diff(np.concatenate([groups, [len(hs)]]))
    top = np.zeros(n)
    np.maximum.at(top, rs[groups], runs)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    last = at[words.ends - 1] if len(h) else np.zeros(0, np.uint8)
    # words that recur more often than 3 + 10 % of the text
    out = np.stack([np.log1p(n_words), caps_n / np.maximum(caps_n + small_n, 1), count(SYMBOLS[flat]) / size, count((flat >= 48) & (flat <= 57)) / size, by_row((last == 124) | (last == 33)) / safe, np.bincount(rs[groups], minlength=n) / np.maximum(n_words, 1) if len(row) else np.zeros(n), by_row(same) / safe, by_row(last == 46) / safe, np.minimum(size / safe, 30), count(flat >= 128) / size, top / safe], axis=1)
    out[empty] = 0
    return out


def expanded(x: np.ndarray) -> np.ndarray:
    """Features, their squares and products."""
    i, j = np.triu_indices(x.shape[1])
    return np.concatenate([x, x[:, i] * x[:, j]], axis=1)


class Logistic:
    """Ridge logistic regression on standardised features, by Newton's method."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.prior = float(np.clip((y.sum() + 1) / (len(y) + 2), 1e-6, 1 - 1e-6))
        self.mean, self.std = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.concatenate([self._scaled(x), np.ones((len(x), 1))], axis=1)
        w = np.zeros(z.shape[1])
        w[-1] = np.log(self.prior / (1 - self.prior))
        penalty = np.full(z.shape[1], RIDGE)
        penalty[-1] = 1e-6
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            grad = z.T @ (y - p) - penalty * w
            hess = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(hess, grad)
            w = w + step
            if np.abs(step).max() < 1e-6:
                break
        self.w = w

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.std, -8, 8)

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._scaled(x) @ self.w[:-1] + self.w[-1], -20, 20)


class Judge:
    """Classifiers of quality and toxicity, fitted on rows of shape, marks (features of ``marked``), quality and toxic.

    marks and weight: hashes of words that mark toxic texts, ascending, and their log odds.  Rows with ``weighs`` had no
    part in finding the words; on them the toxic classifier is fitted.
    """

    def __init__(self, shape: np.ndarray, marked_: np.ndarray, quality: np.ndarray, toxic: np.ndarray, weighs: np.ndarray, marks: np.ndarray, weight: np.ndarray) -> None:
        self.quality = Logistic(expanded(shape), quality) if len(set(quality.tolist())) == 2 else None
        self.marks, self.weight = marks, weight
        self.toxic = Logistic(marked_[weighs], toxic[weighs]) if len(set(toxic.tolist())) == 2 and weighs.any() else None

    def judge(self, shape: np.ndarray, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of quality and of toxicity."""
        q = self.quality.odds(expanded(shape)) if self.quality else np.full(len(shape), 20.0)
        t = self.toxic.odds(np.stack([marked(w, self.marks, self.weight) for w in words])) if self.toxic and len(words) else np.full(len(shape), -20.0)
        return q, t


def marked(words: np.ndarray, marks: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Greatest and summed log odds of a text's distinct words, and the share of them that are marks."""
    if not len(marks) or not len(words):
        return np.zeros(3)
    at = np.minimum(np.searchsorted(marks, words), len(marks) - 1)
    w = weight[at[marks[at] == words]]
    return np.array([w.max(), min(w.sum(), 30.0), len(w) / len(words)]) if len(w) else np.zeros(3)


def _described(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, list[np.ndarray]]]:
    flat, offsets = string_buffers(text)
    for lo, hi in row_slices(offsets):
        f, o = flat[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        # words that may mark a class are cut at punctuation, so that a word counts alike with and without it
        bare = Words(UNPUNCTUATED[f], o)
        yield lo, hi, shapes(f, o, Words(f, o)), [np.unique(bare.hashes[a:b]) for a, b in zip(bare.bounds[:-1].tolist(), bare.bounds[1:].tolist(), strict=True)]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, bad, good): how many toxic and other texts of a batch hold each word."""
    for batch in batches:
        toxic = batch.column("toxic").to_numpy() > 0
        for lo, hi, _, words in _described(batch.column("text")):
            flat = np.concatenate(words)
            bad = np.repeat(toxic[lo:hi], [len(w) for w in words])
            uniq, at = np.unique(flat, return_inverse=True)
            n_bad = np.bincount(at, bad, len(uniq)).astype(np.int64)
            yield pa.record_batch([pa.array(uniq.view(np.int64), pa.int64()), pa.array(n_bad), pa.array(np.bincount(at, minlength=len(uniq)) - n_bad)], names=["word", "bad", "good"])


def _toxic_marks(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Words that at least LEAST_DOCS toxic texts hold, at log odds of LEAST_ODDS or more; at most MAX_WORDS reach the driver."""
    n = sample.agg(F.sum((F.col("toxic") > 0).cast("long")).alias("bad"), F.count("*").alias("all")).first()
    bad, good = n["bad"] or 0, (n["all"] or 0) - (n["bad"] or 0)
    if not bad or not good:
        return np.zeros(0, np.uint64), np.zeros(0)
    words = sample.mapInArrow(lean(_word_counts), "word long, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.ln((F.col("bad") + 0.5) / F.lit(bad + 1.0)) - F.ln((F.col("good") + 0.5) / F.lit(good + 1.0))
    rows = words.withColumn("odds", odds).where((F.col("bad") >= LEAST_DOCS) & (F.col("odds") >= LEAST_ODDS)).orderBy(F.desc("odds"), "word").limit(MAX_WORDS).select("word", "odds").collect()
    marks = np.array([r["word"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(marks)
    return marks[order], np.array([r["odds"] for r in rows], float)[order]


def _evidence(marks: np.ndarray, weight: np.ndarray):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, shape, words in _described(batch.column("text")):
                both = [np.concatenate([x, marked(w, marks, weight)]).tobytes() for x, w in zip(shape, words, strict=True)]
                yield pa.record_batch([pa.array(both, pa.binary()), *(batch.column(c).slice(lo, hi - lo) for c in ("quality", "toxic", "weighs"))], names=["evidence", "quality", "toxic", "weighs"])

    return run


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Judge:
    """Fit on at most ``rows`` labelled documents; what reaches the driver is their features and at most MAX_WORDS words.

    Half of the documents, by hash of the id, finds the words of toxic texts and the other half weighs them.
    """
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.coalesce(F.min("toxic"), F.lit(0)).cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).withColumn("weighs", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 1)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sample = saved(text.join(F.broadcast(chosen), "doc_id").drop("doc_id"), "labelled")
    marks, weight = _toxic_marks(sample.where("NOT weighs"))
    got = sample.mapInArrow(lean(_evidence(marks, weight)), "evidence binary, quality int, toxic int, weighs boolean").orderBy(F.xxhash64("evidence"), "evidence").limit(rows).collect()
    drop(sample)
    both = np.array([np.frombuffer(r["evidence"], float) for r in got]).reshape(len(got), len(FEATURES) + 3)
    column = lambda c: np.array([r[c] for r in got], float)
    return Judge(both[:, : len(FEATURES)], both[:, len(FEATURES) :], column("quality"), column("toxic"), column("weighs") > 0, marks, weight)


def _judged(model: Judge):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, shape, words in _described(batch.column("text")):
                q, t = model.judge(shape, words)
                yield pa.record_batch([*(batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "tkey", "host", "path")), pa.array(1 / (1 + np.exp(-q))), pa.array(1 / (1 + np.exp(-t)))], names=["doc_id", "tkey", "host", "path", "p_doc", "p_toxic"])

    return run


def _strength(sites: DataFrame, mean: Column) -> float:
    """Pseudo-counts of the prior: how little sites differ from ``mean`` beyond what their sizes explain."""
    m = F.col("m")
    row = sites.withColumn("m", mean).agg(F.count("*").alias("k"), F.avg(F.pow(F.col("s") / F.col("n") - m, F.lit(2))).alias("var"), F.avg(m * (1 - m)).alias("full"), F.avg(m * (1 - m) / F.col("n")).alias("noise")).first()
    if (row["k"] or 0) < 2 or not row["full"]:
        return 10.0
    between = max(row["var"] - row["noise"], 1e-6)
    return float(min(1e5, max(1.0, row["full"] / between - 1)))


def posteriors(scores: DataFrame) -> DataFrame:
    """scores with p_host, p_path and posterior: site levels by grouped aggregation, shrunk level by level."""
    paths = saved(scores.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p_doc").alias("s")), "paths")
    whole = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    if not whole["n"]:
        return scores.select("*", *[F.lit(None).cast("double").alias(c) for c in ("p_host", "p_path", "posterior")])
    mean = min(1 - 1e-6, max(1e-6, whole["s"] / whole["n"]))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    kh = _strength(hosts, F.lit(mean))
    hosts = hosts.select(F.col("host").alias("h"), F.col("n").alias("hn"), F.col("s").alias("hs"))
    both = paths.join(hosts, F.col("host").eqNullSafe(F.col("h")))
    kp = _strength(both, (F.col("hs") + kh * mean) / (F.col("hn") + kh))
    sites = saved(both.select("h", F.col("path").alias("pa"), "n", "s", "hn", "hs"), "sites")
    out = scores.join(bounded(sites), F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("pa")))
    own, logit = F.col("p_doc"), lambda p: F.ln(p / (1 - p))
    clip = lambda p: F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    host = (F.col("hs") - own + kh * mean) / (F.col("hn") - 1 + kh)
    out = out.withColumn("p_host", clip(host)).withColumn("p_path", clip((F.col("s") - own + kp * F.col("p_host")) / (F.col("n") - 1 + kp)))
    odds = logit(clip(own)) - float(np.log(mean / (1 - mean))) + logit(F.col("p_path"))
    return out.withColumn("posterior", 1 / (1 + F.exp(-odds))).drop("h", "pa", "n", "s", "hn", "hs")


def site(url: Column) -> tuple[Column, Column]:
    """Host (lower case, without port) and first folder of the path of a URL; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    folder = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)/", 1)
    return F.nullif(host, F.lit("")), F.nullif(folder, F.lit(""))


def classify(df: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", url_col: str | None = None, least: float = 0.5, toxic: float = 0.5) -> DataFrame:
    """doc_id, tkey (xxhash64 of the text), host, path, p_doc, p_toxic, p_host, p_path, posterior and keep of every row.

    With ``url_col`` the host and the first folder of that URL are host and path.
    """
    model = fit(df, labels)
    host, path = site(F.col(url_col).cast("string")) if url_col else (F.col(host_col).cast("string"), F.col(path_col).cast("string"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tkey"), host.alias("host"), path.alias("path"), text.alias("text"))
    scores = saved(rows.mapInArrow(lean(_judged(model)), "doc_id long, tkey long, host string, path string, p_doc double, p_toxic double"), "scores")
    return posteriors(scores).withColumn("keep", (F.col("posterior") >= least) & (F.col("p_toxic") < toxic))


def keep_good(df: DataFrame, labels: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """The rows of df that the classifier keeps."""
    gone = saved(classify(df, labels, **options).where("NOT keep").select(F.col("doc_id").alias("doc"), "tkey").distinct(), "rejected")
    whole = df.select(F.struct(*df.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("own"))
    return whole.join(bounded(gone), F.col("id").eqNullSafe(F.col("doc")) & (F.col("own") == F.col("tkey")), "left_anti").select("row.*")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("tkey")


QUERIES = {"op2_quality": op2_quality}
