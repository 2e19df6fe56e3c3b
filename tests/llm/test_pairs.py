"""Joins and deduplication against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from zonelight.llm import line_dedup, ngram_join
from zonelight.llm._components import connected_components, resolve

from .helpers import shingles_of


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components_of_paths_stars_and_loops(spark):
    r = random.Random(1)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(900, 900)] + [(r.randint(200, 400), r.randint(200, 400)) for _ in range(120)] + [(None, 3)]
    want = Sets()
    for a, b in pairs:
        if a is not None:
            want.join(a, b)
    got = {x["id"]: x["comp"] for x in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: want.find(i) for i in want.up}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_resolve_decides_every_pair_of_a_hot_bucket(spark):
    """One bucket of 60 members in which likeness is no matter of transitivity; brute force over all pairs."""
    r = random.Random(2)
    value = {i: r.random() for i in range(60)}
    links = {(a, b) for a in value for b in value if a < b and abs(value[a] - value[b]) < 0.02}
    linked = spark.createDataFrame(sorted(links), "a long, b long")
    buckets = spark.createDataFrame([(0, i, 1) for i in value] + [(5, 1, 1), (6, 2, 1), (6, 3, 1)], "bucket long, id long, size long")
    want = Sets()
    for a, b in links:
        want.join(a, b)
    got = {x["id"]: x["comp"] for x in resolve(buckets, lambda p: p.join(linked, ["a", "b"])).collect()}
    assert all(got.get(i, i) == want.find(i) for i in value)


def test_ngram_join_equals_brute_force(docs, rows):
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    sets = {i: shingles_of(t) for i, t in texts.items()}
    want = Sets()
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                want.join(a, b)
    got = ngram_join.components(docs).collect()
    assert len(got) == len(rows)
    for x in got:
        if x["doc_id"] is None:
            assert x["component_id"] is None
            assert x["n_shingles"] == len(shingles_of(rows[3][1]))
        else:
            assert (x["n_shingles"], x["component_id"]) == (len(sets[x["doc_id"]]), want.find(x["doc_id"])), x
    assert len({want.find(i) for i in ids}) < len(ids) - 3  # the table does hold copies


def test_keep_one(docs, rows):
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    comps = {x["doc_id"]: x["component_id"] for x in ngram_join.components(docs).collect()}
    want = sorted(str(r[0]) for r in rows if r[0] is None or comps[r[0]] == r[0])
    assert sorted(str(x["doc_id"]) for x in kept.select("doc_id").collect()) == want


def test_ngram_join_of_nothing(empty, spark):
    assert ngram_join.components(empty).count() == 0
    blank = spark.createDataFrame([(1, None), (2, ""), (3, " ")], "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.components(blank).collect())) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def test_large_group_of_near_copies(spark):
    """300 copies, each with words of its own: one component, whichever centre comes first."""
    r = random.Random(4)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(200)]
    texts = []
    for k in range(300):
        w = list(base)
        w[r.randrange(200)] = f"own{k}"
        texts.append((k + 1, " ".join(w)))
    texts += [(1000 + k, " ".join(base[:60]) + " " + " ".join(f"z{k}_{j}" for j in range(140))) for k in range(100)]  # a common passage, no copies
    got = {x[0]: x[2] for x in ngram_join.components(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert {got[k] for k in range(1, 301)} == {1}
    assert all(got[1000 + k] == 1000 + k for k in range(100))


def lines_of(text):
    return [line_dedup.normal(x).decode() for x in (text or "").encode().split(b"\n")]


def test_line_dedup_equals_brute_force(spark):
    r = random.Random(6)
    sentence = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(r.randint(4, 14)))
    pool = [sentence() for _ in range(40)]
    near = [p[:-1] + "Q" for p in pool[:20] if len(p) > 30]
    docs = [(i, "\n".join(r.choice([*pool, *near, sentence(), "", "  ", "ab"]) for _ in range(r.randint(0, 6)))) for i in range(60)] + [(60, None), (61, pool[0].upper() + " "), (None, pool[1])]
    occ, where = {}, {}
    key = lambda d, t: (d is not None, d or 0, line_dedup.line_id((t or "").encode()))
    for d, t in docs:
        for i, line in enumerate(lines_of(t)):
            if line:
                occ.setdefault(line, []).append((*key(d, t), i))
    lines = sorted(occ)
    grams, want = {x: line_dedup.grams(x) for x in lines}, Sets()
    for k, a in enumerate(lines):
        for b in lines[k + 1 :]:
            if line_dedup.jaccard(grams[a], grams[b]) >= line_dedup.THRESHOLD:
                want.join(a, b)
    groups = {}
    for x in lines:
        groups.setdefault(want.find(x), []).extend(occ[x])
    gone = {o for g in groups.values() for o in g if o != min(g)}
    frame = spark.createDataFrame([(d, t, "x", "y") for d, t in docs], "doc_id long, text string, removed string, n_lines string")
    got = {(x["doc_id"], x["removed"]): x for x in line_dedup.dedup_lines(frame).collect()}
    for d, t in docs:
        left = "\n".join(x for i, x in enumerate((t or "").split("\n")) if (*key(d, t), i) not in gone)
        had, has = [x for x in lines_of(t) if x], [x for x in lines_of(left) if x]
        if had and not has:
            assert (d, "x") not in got
        else:
            assert (got[d, "x"]["text"] or "") == left
            where[d] = left
    assert where and len(gone) > 20


def test_line_dedup_of_nothing(empty, docs):
    assert line_dedup.dedup_lines(empty).count() == 0
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns
    assert out.where("text IS NOT NULL AND n_chars != length(text)").count() == 0


@pytest.mark.parametrize(("likeness", "least"), [(0.8, 0.98), (0.9, 0.999)])
def test_bands_find_alike_lines(likeness, least):
    """Share of pairs of a known likeness that meet in a band."""
    r = random.Random(8)
    pairs = []
    while len(pairs) < 300:
        a = "".join(r.choice("abcdefghij ") for _ in range(200))
        b = a
        while line_dedup.jaccard(line_dedup.grams(a), line_dedup.grams(b)) > likeness + 0.02:
            k = r.randrange(len(b))
            b = b[:k] + "Z" + b[k + 1 :]
        if line_dedup.jaccard(line_dedup.grams(a), line_dedup.grams(b)) >= likeness:
            pairs.append((a, b))
    x = line_dedup.bands(line_dedup.signatures([p[0] for p in pairs]))
    y = line_dedup.bands(line_dedup.signatures([p[1] for p in pairs]))
    assert (x == y).any(axis=1).mean() >= least


def test_components_of_links_dealt_to_many_tasks(spark, monkeypatch):
    """Union-find in small blocks of many tasks, with a path, a hub and random links that cross them."""
    from zonelight.llm import _components

    r = random.Random(9)
    pairs = [(i, i + 1) for i in range(70)] + [(r.randint(100, 300), r.randint(100, 300)) for _ in range(150)] + [(5000, 5000 + i) for i in range(1, 30)]
    r.shuffle(pairs)
    want = Sets()
    for a, b in pairs:
        want.join(a, b)
    monkeypatch.setattr(_components, "BLOCK_LINKS", 4)
    got = connected_components(spark.createDataFrame(pairs, "a long, b long").repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted((i, want.find(i)) for i in want.up)


def alike_lines(r, n, low, high):
    """Pairs of random lines of low to high characters, the second with a character more, of likeness 0.8 or more."""
    out = []
    while len(out) < n:
        a = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(low, high)))
        b = a + r.choice("0123456789")
        if line_dedup.jaccard(line_dedup.grams(a), line_dedup.grams(b)) >= line_dedup.THRESHOLD:
            out.append((a, b))
    return out


def test_short_lines_that_share_a_band_all_link(spark):
    """Lines of 4 to 16 grams against brute force: what the bands propose is lost by no later condition."""
    r = random.Random(8)
    pairs = alike_lines(r, 400, 8, 8) + alike_lines(r, 200, 9, 20)
    x, y = (line_dedup.bands(line_dedup.signatures([p[k] for p in pairs])) for k in range(2))
    proposed = [p for p, same in zip(pairs, (x == y).any(axis=1).tolist(), strict=True) if same]
    assert len(proposed) > 580
    frame = spark.createDataFrame([(i, "\n".join(p)) for i, p in enumerate(pairs)], "doc_id long, text string")
    comp = {c["id"]: c["comp"] for c in line_dedup.line_components(frame).collect()}
    of = lambda line: comp.get(line_dedup.line_id(line.encode()), line)
    assert [p for p in proposed if of(p[0]) != of(p[1])] == []


@pytest.mark.parametrize("kind", ["ends", "words"])
def test_groups_of_any_size_give_the_same_components(spark, kind):
    """Buckets cut into chunks of five lines against whole ones and brute force, over lines that link in chains."""
    r = random.Random(21)
    base = ["".join(r.choice("abcdefghijklmnop") for _ in range(60)) for _ in range(3)]
    lines = set()
    for x in base:
        for _ in range(40):
            if kind == "ends":
                lines.add(x[: r.randint(44, 60)] + "".join(r.choice("xyz") for _ in range(r.randint(0, 8))))
            else:
                y = list(x)
                for k in range(r.randint(0, 3)):
                    y[r.randrange(60)] = r.choice("QRSTU")
                lines.add("".join(y).lower())
    lines = sorted(lines)
    sets, want = {x: line_dedup.grams(x) for x in lines}, Sets()
    for k, a in enumerate(lines):
        for b in lines[k + 1 :]:
            if line_dedup.jaccard(sets[a], sets[b]) >= line_dedup.THRESHOLD:
                want.join(a, b)
    frame = spark.createDataFrame([(i, "\n".join(lines[i::9])) for i in range(9)], "doc_id long, text string")
    truth = {tuple(sorted(line_dedup.line_id(x.encode()) for x in lines if want.find(x) == top)) for top in {want.find(x) for x in lines}}
    truth = {g for g in truth if len(g) > 1}
    for size in ({}, {"group_lines": 5, "group_chars": 10**6}, {"group_lines": 10**6, "group_chars": 400}):
        groups = {}
        for c in line_dedup.line_components(frame, **size).collect():
            groups.setdefault(c["comp"], []).append(c["id"])
        assert {tuple(sorted(g)) for g in groups.values() if len(g) > 1} == truth, size
    assert len(truth) > 2


def test_group_links_span_what_brute_force_finds():
    r = np.random.default_rng(5)
    sets = [np.unique(r.choice(60, 40)).astype(np.uint64) for _ in range(50)]
    sets += [np.unique(np.concatenate([s[2:], r.choice(200, 3).astype(np.uint64)])) for s in sets[:30]]
    n = len(sets)
    bucket = np.concatenate([np.zeros(n, np.int64), np.ones(n, np.int64)])  # twice the same members
    line = np.concatenate([np.arange(n), np.arange(n)[::-1]])
    links = line_dedup.group_links(sets, bucket, line, r.permutation(n), np.arange(n), np.ones(n, bool))
    got, want = Sets(), Sets()
    for x in range(n):
        for y in range(x):
            if line_dedup.jaccard(set(sets[x].tolist()), set(sets[y].tolist())) >= 0.8:
                want.join(x, y)
    for x, y in links:
        assert line_dedup.jaccard(set(sets[x].tolist()), set(sets[y].tolist())) >= 0.8
        got.join(x, y)
    assert all(got.find(i) == want.find(i) for i in range(n)) and len(links) < n


def test_signature_memory_is_bounded_on_short_lines():
    """A million characters in lines of eight: what the kernel holds is bounded by lines of a pass, not by characters."""
    import tracemalloc

    r = random.Random(13)
    lines = ["".join(r.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(20_000)]
    tracemalloc.start()
    for lo in range(0, len(lines), line_dedup.PASS_LINES):
        line_dedup.bands(line_dedup.signatures(lines[lo : lo + line_dedup.PASS_LINES]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6


def test_long_lines_are_hashed_in_overlapping_pieces(monkeypatch):
    r = random.Random(14)
    lines = ["".join(r.choice("abcdefgh ") for _ in range(n)) for n in (3, 1000, 40, 2503, 5, 996)]
    whole, sets = line_dedup.signatures(lines), line_dedup.gram_sets(lines)
    monkeypatch.setattr(line_dedup, "PASS_CHARS", 100)
    assert (line_dedup.signatures(lines) == whole).all()
    assert all((a == b).all() for a, b in zip(line_dedup.gram_sets(lines), sets, strict=True))
    assert [len(s) for s in sets] == [len(line_dedup.grams(x)) for x in lines]


@pytest.mark.parametrize(("low", "high"), [(8, 8), (12, 20), (60, 90)])
def test_bands_miss_few_lines_at_the_threshold(low, high):
    """At most 0.18 % of 4,000 pairs at the threshold, what 12 bands of 4 values miss of long lines."""
    r, pairs = random.Random(10), []
    while len(pairs) < 4000:
        a = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(low, high)))
        b = a
        while line_dedup.jaccard(line_dedup.grams(a), line_dedup.grams(longer := b + r.choice("0123456789"))) >= line_dedup.THRESHOLD:
            b = longer
        if a != b:
            pairs.append((a, b))
    x, y = (line_dedup.bands(line_dedup.signatures([p[k] for p in pairs])) for k in range(2))
    assert (~(x == y).any(axis=1)).sum() <= 0.0018 * len(pairs)


def test_texts_that_share_an_id_are_all_compared(spark):
    r = random.Random(12)
    text = lambda: " ".join(f"w{r.randint(0, 10**6)}" for _ in range(60))
    a, b, c, d = (text() for _ in range(4))
    near = b + " more"
    rows = [(1, a), (2, b), (5, a), (5, near), (5, c), (5, c), (6, c + " more"), (7, d), (7, d + " more"), (8, ""), (8, " "), (None, a)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in ngram_join.components(frame).collect() if x["doc_id"] is not None)
    assert got == [(1, 56, 1), (2, 56, 2), (5, 56, 1), (5, 56, 5), (5, 56, 5), (5, 57, 2), (6, 57, 5), (7, 56, 7), (7, 57, 7), (8, 0, 8), (8, 0, 8)]
    kept = [tuple(x) for x in ngram_join.keep_one(frame).collect()]
    seven = [x for x in kept if x[0] == 7]
    assert len(seven) == 1 and seven[0] in rows
    assert sorted(map(str, (x for x in kept if x[0] != 7))) == sorted(map(str, [(1, a), (2, b), (5, c), (5, c), (8, ""), (8, " "), (None, a)]))


def test_a_slice_sends_as_much_to_many_fragments_as_to_few():
    """Heads of a slice are sent once; the rest is hashes and places, whatever number of fragments they are dealt to."""
    r = np.random.default_rng(3)
    ids = np.arange(2000, dtype=np.int64)
    sets = [np.unique(r.integers(0, 2**63, r.integers(1, 200)).astype(np.uint64)) for _ in ids]
    size = lambda n: sum(len(x) for c in ("places", "hashes") for x in ngram_join._fragment_rows(ids, sets, n).column(c).to_pylist())
    shingles = sum(len(s) for s in sets)
    assert size(1) == size(57) == size(3333) == 10 * shingles + 16 * len(ids)


def test_answers_to_slices_give_counts_and_frequencies():
    """Fragments' answers, put together by slice, against counting."""
    import pyarrow as pa

    r = np.random.default_rng(4)
    whole = {int(i): np.unique(r.integers(0, 400, r.integers(0, 60)).astype(np.uint64) << np.uint64(54)) for i in range(90)}
    rows = pa.concat_tables([pa.Table.from_batches([ngram_join._fragment_rows(np.array(part, np.int64), [whole[i] for i in part], 7)]) for part in (range(40), range(40, 90))])
    frags = sorted(set(rows.column("frag").to_pylist()))
    pick = lambda table, name, value: table.filter(pa.compute.equal(table.column(name), value))
    import pyarrow.compute  # noqa: F401

    count = {}
    for s in whole.values():
        for h in s.tolist():
            count[h] = count.get(h, 0) + 1
    for answer, done in ((ngram_join._counted, ngram_join._totals), (ngram_join._answered, ngram_join._prefixes)):
        answers = pa.concat_tables([answer(pick(rows, "frag", f)) for f in frags])
        out = pa.concat_tables([done(pick(answers, "slice", s)) for s in set(answers.column("slice").to_pylist())]).to_pylist()
        if done is ngram_join._totals:
            assert {x["doc_id"]: (x["size"], x["shared"]) for x in out} == {i: (len(s), sum(count[h] > 1 for h in s.tolist())) for i, s in whole.items()}
            continue
        got = {}
        for x in out:
            got.setdefault(x["id"], []).append((x["freq"], x["shingle"], x["rest"]))
        for i, s in whole.items():
            n = len(s)
            order = sorted((count[h], h) for h in s.tolist())
            prefix = order[: n - -(-80 * n // 100) + 1] if n else []
            want = [(f, h - (h >> 63 << 64), n - 1 - k) for k, (f, h) in enumerate(prefix) if f > 1]
            assert got.get(i, []) == want, i


def test_ngram_join_equals_its_sql(spark, tmp_path):
    """All pairs on a second engine, over texts with copies, near copies and blanks."""
    import duckdb

    from .helpers import make_texts

    rows = [(3 * i - 7, t) for i, t in enumerate(make_texts(seed=9, n=80))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(c.sql(ngram_join.ORACLE_SQL["op3_ngram_jaccard_join"]).fetchall())
    assert sorted(map(tuple, ngram_join.op3_ngram_jaccard_join(spark, str(tmp_path)).collect())) == want
    assert sum(a != b for a, _, b in want) > 5
