"""Mixing against its SQL and brute force; the pipeline's stages against what they promise."""

from __future__ import annotations

import math
import random
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from zonelight.llm import bpe, line_dedup, mixing, ngram_join, oracle_sql, queries

from .helpers import SCHEMA, shingles_of, words_of


def hot_table(spark, tmp_path, n=600):
    r = random.Random(2)
    rows = [(i if i % 90 else None, " ".join("w" for _ in range(r.randint(0, 60))) if i % 50 else None, "en", "hot" if r.random() < 0.6 else r.choice(["a", "b", "c", None]), 0) for i in range(n)]
    rows += rows[5:8]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
    return rows, str(tmp_path)


def test_mixing_equals_its_sql(spark, tmp_path):
    rows, folder = hot_table(spark, tmp_path)
    got = sorted(map(tuple, queries()["op6_mixing"](spark, folder).collect()), key=str)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    assert got == sorted(c.sql(oracle_sql()["op6_mixing"]).fetchall(), key=str)
    seen = Counter((g[0], g[1]) for g in got)
    assert all(seen[r[0], r[3]] >= 1 for r in rows)  # nobody is left out
    again = Counter((x["doc_id"], x["source"]) for x in mixing.repeated(spark.read.parquet(f"{folder}/documents.parquet")).collect())
    assert again == seen


def test_weights_reach_entropy_or_stop_at_the_repetition_limit(spark, tmp_path):
    rows, folder = hot_table(spark, tmp_path)
    light = mixing._light(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id", "text", "source")
    tokens = Counter()
    for r in rows:
        tokens[r[3]] += len(words_of(r[1]))
    for entropy, limit in [(0.9, 50.0), (1.0, 50.0), (1.0, 2.0), (0.1, 2.0)]:
        plan, _ = mixing.weights(light, entropy, limit)
        got = {x["source"]: x for x in plan.collect()}
        w = [x["weight"] for x in got.values()]
        h = -sum(x * math.log(x) for x in w) / math.log(len(w))
        repeats = [x["repeats"] for x in got.values()]
        assert abs(sum(w) - 1) < 1e-6 and {k: x["total"] for k, x in got.items()} == dict(tokens)
        assert min(repeats) == pytest.approx(1, abs=1e-6) and max(repeats) <= limit + 1e-6
        assert h >= entropy - 1e-6 or max(repeats) >= limit - 1e-6


def test_budget_and_blocks(spark, tmp_path):
    rows, folder = hot_table(spark, tmp_path)
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    total = sum(len(words_of(r[1])) for r in rows)
    cut = mixing.mix(frame, budget=total // 3, block_tokens=500).collect()
    assert total // 3 - 60 * 6 <= sum(x["n_tokens"] for x in cut) <= total // 3 + 6
    blocks = Counter()
    for x in cut:
        blocks[x["block"]] += x["n_tokens"]
    assert len(blocks) == math.ceil(total // 3 / 500) and max(blocks.values()) < 800
    for b in blocks:
        assert sorted(x["place"] for x in cut if x["block"] == b) == list(range(1, 1 + sum(x["block"] == b for x in cut)))


def test_budget_beyond_the_repetition_limit_is_short_and_says_so(spark, tmp_path):
    """Blocks follow the tokens placed, and sources at their cap keep their own shares."""
    rows = [(i, " ".join("w" for _ in range(30)), "ab"[i % 2]) for i in range(100)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    with pytest.warns(UserWarning, match="6000 of 30000 tokens"):
        out = mixing.mix(frame, max_repeats=2.0, budget=30_000, block_tokens=1000).collect()
    blocks = Counter()
    for x in out:
        blocks[x["block"]] += x["n_tokens"]
    assert sum(blocks.values()) == 6000 and len(blocks) == 6 and max(blocks.values()) <= 1100


def test_running_sums_in_two_levels(spark, monkeypatch):
    """Small buckets, so that names have several digits, against one bucket."""
    r = random.Random(12)
    rows = [(i, " ".join("w" for _ in range(r.randint(1, 20))), "hot" if i % 5 else "cold") for i in range(800)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    whole = sorted(map(tuple, mixing.mix(frame, block_tokens=700).collect()))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 3)
    assert sorted(map(tuple, mixing.mix(frame, block_tokens=700).collect())) == whole


def test_mixing_of_odd_rows(docs, empty, rows, spark):
    assert mixing.mix(empty).count() == 0 and mixing.repeated(empty).count() == 0
    out = mixing.repeated(docs)
    assert out.columns == docs.columns and out.count() >= len(rows)
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert mixing.mix(blank).count() == 2


def test_stages_on_odd_rows(spark, docs, tmp_path):
    """Each stage works on all that its predecessor kept, and all but the last keep the columns."""
    spark.createDataFrame([(k, k % 2, 0) for k in range(-20, 200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        path = str(tmp_path / name)
        out.write.parquet(path)
        back = spark.read.parquet(path)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert back.columns == docs.columns
        if name == "near copies":
            links = ngram_join.components(back).where("component_id != doc_id")
            assert links.count() == 0
        if name == "lines":
            assert line_dedup.removed_lines(back).count() == 0
        now = back
    assert now.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    previous = spark.read.parquet(str(tmp_path / "mixture"))
    assert now.count() == previous.count()


def test_pipeline_of_no_documents(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_keeps_one_of_each_copy(spark, tmp_path):
    r = random.Random(4)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    text = lambda: "\n".join(" ".join(r.choice(vocab) for _ in range(30)) for _ in range(4))
    base = [text() for _ in range(30)]
    docs = [(i, t) for i, t in enumerate(base)] + [(100 + i, base[i]) for i in range(10)]
    near = [(200 + i, " ".join("".join(r.choice("xyz") for _ in range(6)) if k == 3 else w for k, w in enumerate(base[i].split(" ")))) for i in range(10, 20)]
    rows = [(i, t, "en", "s", len(t)) for i, t in docs + near]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = Counter(x["doc_id"] for x in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert set(range(30)) <= set(got) and not any(100 <= i < 200 for i in got)
    assert bpe.VOCABULARY and SCHEMA


def plain_lines(rows):
    """What line dedup leaves of (doc_id, text): all pairs of lines compared, the least occurrence of each component kept."""
    where = {}
    for d, t in rows:
        for k, line in enumerate(t.split("\n")):
            if norm := line_dedup.normal(line.encode()).decode():
                where.setdefault(norm, []).append((d, line_dedup.line_id(t.encode()), k))
    lines, parent = sorted(where), {}

    def top(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    grams = {x: line_dedup.grams(x) for x in lines}
    for k, a in enumerate(lines):
        for b in lines[k + 1 :]:
            both = len(grams[a] & grams[b])
            if 5 * both >= 4 * (len(grams[a]) + len(grams[b]) - both):
                parent[top(b)] = top(a)
    groups = {}
    for x in lines:
        groups.setdefault(top(x), []).extend(where[x])
    gone = {o for g in groups.values() for o in g if o != min(g)}
    out = []
    for d, t in rows:
        key = line_dedup.line_id(t.encode())
        left = [x for k, x in enumerate(t.split("\n")) if (d, key, k) not in gone]
        if any(x.strip() for x in left) or not any(x.strip() for x in t.split("\n")):
            out.append((d, "\n".join(left)))
    return out


def plain_near(rows):
    """One document of each group of near copies: all pairs of shingle sets compared."""
    sets, parent = {d: shingles_of(t) for d, t in rows}, {d: d for d, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in parent:
        for b in parent:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]) and top(a) != top(b):
                low, high = sorted((top(a), top(b)))
                parent[high] = low
    return [(d, t) for d, t in rows if top(d) == d]


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Every stage on what its predecessor kept: the classifier's verdicts, all pairs of lines and of documents, the
    mixture's SQL on a second engine, the tokenizers library."""
    from tokenizers import Tokenizer

    from zonelight.llm import quality

    r = random.Random(41)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7))) for _ in range(500)]
    line = lambda: " ".join(r.choice(vocab) for _ in range(r.randint(12, 20)))
    common = line()
    docs, labels = [], []
    for i in range(90):
        text = [line() for _ in range(r.randint(1, 4))]
        if i % 9 == 0:
            text.insert(0, common if i % 2 else common + "x")
        bad = i % 6 == 5
        docs.append((i, "\n".join(x.upper() + " !!! $$$" for x in text) if bad else "\n".join(text), "hot" if i % 3 else f"s{i % 2}"))
        labels.append((i, 0 if bad else 1, 0))
    for i in range(10):  # near copies on one line, so that no line is alike but the documents are
        w = docs[6 * i + 1][1].replace("\n", " ").split(" ")
        w[len(w) // 2] = "other"
        docs.append((200 + i, " ".join(w), "hot"))
        labels.append((200 + i, 1, 0))
    docs += [(300, docs[1][1], "hot"), (301, docs[2][1].upper(), "s1")]
    rows = [(i, t, "en", s, len(t)) for i, t, s in docs]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    source = {i: s for i, _, s in docs}

    whole = spark.read.parquet(str(tmp_path / "documents.parquet"))
    judged = quality.classify(whole, spark.read.parquet(str(tmp_path / "labels.parquet"))).collect()
    keep = {x["doc_id"] for x in judged if x["posterior"] >= 0.5 and x["p_toxic"] < 0.5}
    assert {i for i, q, _ in labels if q} <= keep | {301} and len(keep) < len(docs)
    left = plain_near(plain_lines([(i, t) for i, t, _ in docs if i in keep]))

    (tmp_path / "mixed").mkdir()
    spark.createDataFrame([(i, t, "en", source[i], len(t)) for i, t in left], schema).write.parquet(str(tmp_path / "mixed" / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/mixed/documents.parquet/*.parquet'")
    times = Counter(x for (x,) in c.sql(f"SELECT doc_id FROM ({oracle_sql()['op6_mixing']})").fetchall())
    library, text = Tokenizer.from_file(bpe.vocabulary_path()), dict(left)
    want = Counter()
    for i, n in times.items():
        ids = library.encode(text[i], add_special_tokens=False).ids
        want[i, len(ids), library.decode(ids, skip_special_tokens=False)] += n
    got = Counter((x["doc_id"], x["n_tokens"], x["decoded"]) for x in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want
    assert len(left) < len(keep)
