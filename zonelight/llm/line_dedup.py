"""Fuzzy line deduplication: MinHash bands propose, exact Jaccard decides, union-find keeps one line per component.

Lines are what newlines separate, with ASCII white space trimmed and A-Z lower-cased; blank lines never
count and always stay.  Equal lines are one class by 64-bit hash.  A line's character 5-gram set (a shorter
line is one gram) gets a one-permutation MinHash signature with densified bins; lines that agree in one of
``BANDS`` bands of ``ROWS`` values share a bucket (a pair of likeness 0.8 is missed with odds of 0.033 %, one of
0.85 with 0.0006 %; seven values a band keep lines that only share common syllables apart, whose number of
chance meetings grows with the square of a corpus).  Members of a bucket with exact Jaccard likeness of 0.8 or
more link.  Of each component the occurrence with the least (doc_id, text hash, line number) stays.

1. Each task hashes each line it meets once and deals (bucket, line) to fragments of the hash space; buckets of two
   lines or more remain, and of buckets with the same members one.
2. Buckets go to groups of about ``GROUP_CHARS`` characters of member lines, near copies to the same group.  A
   group compares the members of each bucket that no link joins yet, line against all others at once, and emits links that
   span its components: at most one fewer than members, never all pairs.
3. A bucket above a group's size is cut into chunks, its centre (the line in most buckets) in each of them.  Once the
   links are united, what the centre's component doesn't hold meets all other chunks; the rest needs no comparison.
4. Components come from the distributed union-find in ``_components``.

Defined results: null text counts as empty; a null id sorts first; rows with equal id and text are one
document and treated alike; an empty table gives an empty result; other columns pass through, and ``n_chars``,
where it is, follows the text.  A document none of whose lines stays is dropped by ``dedup_lines`` unless it
had no line to begin with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._components import connected_components
from ._text import bounded, documents, drop, lean, mix64, partitions, saved

GRAM, ROWS, BANDS = 5, 7, 34
#: Likeness from which lines link, in parts.
NUM, DEN = 4, 5
THRESHOLD = NUM / DEN
BINS = ROWS * BANDS
FULL = np.uint64(2**64 - 1)
FRAGMENT = 1_500_000
#: Characters and lines of one pass of the signature kernel; a longer line is cut with an overlap.
PASS_CHARS, PASS_LINES = 250_000, 2000
#: Full bins below which a line's empty bins are filled from a table instead of by probing.
FEW = 64
#: Characters and members of a group of buckets.
GROUP_CHARS, GROUP_LINES = 2_000_000, 4096
#: (bucket, line) entries that a task gathers before it deals them out.
HELD = 1_000_000
#: Lines that a task remembers so as not to hash them again; beyond it starts anew.
SEEN = 200_000
SEED = 42  # of Spark's xxhash64
_COEF = mix64(np.arange(1, 129, dtype=np.uint64)) | np.uint64(1)


def _probe_order() -> np.ndarray:
    """For each bin an order of all bins, itself first: where it looks for a value if it is empty."""
    keys = mix64(np.arange(BINS * BINS, dtype=np.uint64)).reshape(BINS, BINS)
    keys[np.arange(BINS), np.arange(BINS)] = 0
    return np.argsort(keys, axis=1).astype(np.int64)


_PROBES = _probe_order()
#: [full bin, bin that looks]: place of the first in the other's order, and the full bin.
_PLACES = (np.argsort(_PROBES, axis=1).T.astype(np.uint32) << np.uint32(16)) | np.arange(BINS, dtype=np.uint32)[:, None]


def normal(line: bytes) -> bytes:
    return line.strip().lower()


def line_id(line: bytes) -> int:
    h = xxhash.xxh64_intdigest(line, SEED)
    return h - (1 << 64) if h >> 63 else h


def grams(line: str) -> set[str]:
    return {line[i : i + GRAM] for i in range(max(1, len(line) - GRAM + 1))}


def jaccard(a: set[str], b: set[str]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def _gram_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams of all lines in order, and the line of each; short lines are padded to one gram."""
    padded = [x if len(x) >= GRAM else x + "\0" * (GRAM - len(x)) for x in lines]
    lens = np.array([len(x) for x in padded], np.int64)
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = max(0, len(codes) - GRAM + 1)
    h = np.zeros(size, np.uint64)
    for k in range(GRAM):
        h += codes[k : k + size] * _COEF[k]
    row = np.repeat(np.arange(len(lines)), lens)[:size]
    inside = np.arange(size) <= np.repeat(np.cumsum(lens) - GRAM, lens)[:size]
    return mix64(h[inside]), row[inside]


def _passes(lines: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Consecutive lines of bounded number and size, and the number of the first; a long line comes in overlapping pieces."""
    lo = 0
    while lo < len(lines):
        if len(lines[lo]) > PASS_CHARS:
            step = PASS_CHARS - GRAM + 1
            for at in range(0, len(lines[lo]) - GRAM + 1, step):
                yield lo, [lines[lo][at : at + PASS_CHARS]]
            lo += 1
            continue
        hi, size = lo, 0
        while hi < len(lines) and hi - lo < PASS_LINES and (size := size + len(lines[hi])) <= PASS_CHARS:
            hi += 1
        yield lo, lines[lo:hi]
        lo = hi


def gram_sets(lines: list[str]) -> list[np.ndarray]:
    """Ascending distinct gram hashes of each line."""
    parts: list[list[np.ndarray]] = [[] for _ in lines]
    for first, some in _passes(lines):
        h, row = _gram_hashes(some)
        cuts = np.searchsorted(row, np.arange(len(some) + 1)).tolist()
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            s = np.sort(h[a:b])
            parts[first + k].append(s[np.concatenate(([True], s[1:] != s[:-1]))])
    return [p[0] if len(p) == 1 else np.unique(np.concatenate(p)) for p in parts]


def signatures(lines: list[str]) -> np.ndarray:
    """One-permutation MinHash of each line's character grams, a row of BINS values each, without empty bins.

    An empty bin takes the value of the first full one in its own order of bins.
    """
    sig = np.full((len(lines), BINS), FULL, np.uint64)
    flat = sig.reshape(-1)
    for first, some in _passes(lines):
        h, row = _gram_hashes(some)
        which = ((h >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(flat, (row + first) * BINS + which, h)
        if len(lines[first]) <= PASS_CHARS:
            _fill(sig[first : first + len(some)])
    for k, x in enumerate(lines):
        if len(x) > PASS_CHARS:
            _fill(sig[k : k + 1])
    return sig


def _fill(sig: np.ndarray) -> None:
    """Give the empty bins of each row their values, in place."""
    full = sig != FULL
    count = full.sum(axis=1)
    r, c = np.nonzero(~full & (count >= FEW)[:, None])
    base, t = sig.copy(), 1
    while len(r):
        probe = _PROBES[c, t]
        ok = full[r, probe]
        sig[r[ok], c[ok]] = base[r[ok], probe[ok]]
        r, c, t = r[~ok], c[~ok], t + 1
    few = np.flatnonzero(count < FEW)
    for lo in range(0, len(few), 256):
        some = few[lo : lo + 256]
        at, bins = np.nonzero(full[some])
        starts = np.searchsorted(at, np.arange(len(some)))
        nearest = np.minimum.reduceat(_PLACES[bins], starts, axis=0) & np.uint32(0xFFFF)
        sig[some] = np.take_along_axis(base[some], nearest.astype(np.int64), axis=1)


def bands(sig: np.ndarray) -> np.ndarray:
    """A bucket for each line and band."""
    parts = sig.reshape(-1, BANDS, ROWS)
    out = np.zeros(parts.shape[:2], np.uint64)
    for k in range(ROWS):
        out += parts[:, :, k] * _COEF[k + 8]
    return mix64(out + np.arange(BANDS, dtype=np.uint64) * _COEF[20])


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of bounded size."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            yield batch.slice(lo, 512)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _batches(batches):
        docs, keys, numbers, lines = [], [], [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            raw = text.encode()
            key = line_id(raw)
            for i, line in enumerate(raw.split(b"\n")):
                if line := normal(line):
                    docs.append(doc)
                    keys.append(key)
                    numbers.append(i)
                    lines.append(line_id(line))
        yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(keys, pa.int64()), pa.array(numbers, pa.int32()), pa.array(lines, pa.int64())], names=["doc_id", "tkey", "line_no", "line_id"])


def _new_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[int, str]]:
    """The lines of each piece by id, without those that a task has met among its last SEEN lines."""
    seen: set[int] = set()
    for batch in _batches(batches):
        lines = {line_id(x): x for t in batch.column("text").to_pylist() for x in {normal(y) for y in t.encode().split(b"\n")} if x}
        new = {k: x.decode() for k, x in lines.items() if k not in seen}
        if len(seen) > SEEN:
            seen.clear()
        seen.update(new)
        if new:
            yield new


def _dealt(buckets: np.ndarray, owners: np.ndarray, fragments: int) -> pa.RecordBatch:
    """A row for each fragment: the low 32 bits of its buckets and the upper 40 bits of their lines' ids."""
    frag = (buckets >> np.uint64(32)).astype(np.int64) * fragments >> 32
    order = np.argsort(frag, kind="stable")
    cuts = np.searchsorted(frag[order], np.arange(fragments + 1))
    full = np.flatnonzero(np.diff(cuts)).tolist()
    parts = [order[cuts[f] : cuts[f + 1]] for f in full]
    low, packed = buckets.astype("<u4"), owners.view(np.uint8).reshape(-1, 8)[:, :5]
    return pa.record_batch([pa.array(full, pa.int32()), pa.array([low[p].tobytes() for p in parts], pa.binary()), pa.array([packed[p].tobytes() for p in parts], pa.binary())], names=["frag", "buckets", "ids"])


def _band_rows(fragments: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flushed() -> pa.RecordBatch:
            out = _dealt(*(np.concatenate([h[k] for h in held]) for k in range(2)), fragments)
            held.clear()
            return out

        for lines in _new_lines(batches):
            ids, texts = np.array(list(lines), np.int64).view(np.uint64) >> np.uint64(24), list(lines.values())
            for lo in range(0, len(texts), PASS_LINES):
                some = texts[lo : lo + PASS_LINES]
                held.append((bands(signatures(some)).reshape(-1), np.repeat(ids[lo : lo + len(some)], BANDS)))
                if sum(len(h[0]) for h in held) >= HELD:
                    yield flushed()
        if held:
            yield flushed()

    return run


def _shared_buckets(table: pa.Table) -> pa.Table:
    """(bucket, first, short) of the buckets that hold two lines or more; of buckets with the same members one.

    A bucket is known by 32 bits within its fragment and a line by the upper 40 bits of its id, so chance may add
    members, which costs a comparison and no more.  A bucket's name is a hash of its members; first is its least one.
    """
    b = np.frombuffer(b"".join(table.column("buckets").to_pylist()), "<u4")
    packed = np.frombuffer(b"".join(table.column("ids").to_pylist()), np.uint8).reshape(-1, 5)
    order = np.argsort(b, kind="stable")
    s = b[order]
    same = s[1:] == s[:-1]
    order = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
    wide = np.zeros((len(order), 8), np.uint8)
    wide[:, :5] = packed[order]
    b, i = b[order], wide.view(np.uint64)[:, 0]
    order = np.lexsort((i, b))
    b, i = b[order], i[order]
    new = np.ones(len(b), bool)
    new[1:] = (b[1:] != b[:-1]) | (i[1:] != i[:-1])
    b, i = b[new], i[new]
    head = np.ones(len(b), bool)
    head[1:] = b[1:] != b[:-1]
    starts = np.flatnonzero(head)
    sizes = np.diff(np.concatenate([starts, [len(b)]]))
    name = np.add.reduceat(mix64(i + np.uint64(1)), starts) if len(starts) else np.zeros(0, np.uint64)
    first = np.zeros(len(starts), bool)
    first[np.unique(name, return_index=True)[1]] = True
    keep = np.repeat(first & (sizes > 1), sizes)
    column = lambda x: pa.array(np.repeat(x, sizes)[keep].view(np.int64), pa.int64())
    return pa.table({"bucket": column(name), "first": column(i[starts]), "short": pa.array(i[keep].view(np.int64), pa.int64())})


def _line_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lines in _new_lines(batches):
        yield pa.record_batch([pa.array(list(lines), pa.int64()), pa.array(list(lines.values()), pa.string())], names=["id", "line"])


def group_links(sets: list[np.ndarray], bucket: np.ndarray, line: np.ndarray, prio: np.ndarray, comp: np.ndarray, ask: np.ndarray) -> list[tuple[int, int]]:
    """Links (pairs of lines) that unite the components of lines that share a bucket as far as likeness does.

    sets, prio, comp and ask are by line: its distinct grams, whether it comes early (least first), its component so
    far, and whether it is compared with all lines of its buckets or only with those that ask.  bucket and line are
    the memberships.  A line meets all its candidates at once, whatever number of buckets they share, and lines of
    one component are not compared.
    """
    lens = np.array([len(s) for s in sets], np.int64)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(lens) - lens
    order = np.argsort(bucket, kind="stable")
    bucket, line = bucket[order], line[order]
    head = np.concatenate(([True], bucket[1:] != bucket[:-1]))
    number = np.cumsum(head) - 1
    edges = np.append(np.flatnonzero(head), len(bucket))
    by_line = np.argsort(line, kind="stable")
    own = np.searchsorted(line[by_line], np.arange(len(sets) + 1))
    mark = np.zeros(int(code.max()) + 1, bool)
    comp, done, links = comp.copy(), np.zeros(len(sets), bool), []
    for x in np.argsort(prio, kind="stable").tolist():
        if not ask[x]:
            continue
        done[x] = True
        buckets = number[by_line[own[x] : own[x + 1]]].tolist()
        other = line[edges[buckets[0]] : edges[buckets[0] + 1]] if len(buckets) == 1 else np.unique(np.concatenate([line[edges[k] : edges[k + 1]] for k in buckets]))
        other = other[(comp[other] != comp[x]) & ~done[other]]
        n = lens[other]
        near = DEN * np.minimum(n, lens[x]) >= NUM * np.maximum(n, lens[x])
        other, n = other[near], n[near]
        if not len(other):
            continue
        grams_of_x = code[starts[x] : starts[x] + lens[x]]
        mark[grams_of_x] = True
        for some, m in _blocks(other, n):
            at = np.cumsum(m) - m
            both = np.add.reduceat(mark[code[np.repeat(starts[some] - at, m) + np.arange(int(m.sum()))]], at, dtype=np.int64)
            for y in some[(DEN + NUM) * both >= NUM * (m + lens[x])].tolist():
                if comp[y] != comp[x]:
                    links.append((x, y))
                    comp[comp == comp[y]] = comp[x]
        mark[grams_of_x] = False
    return links


def _blocks(lines: np.ndarray, sizes: np.ndarray, limit: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Lines by about limit grams."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(lines):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, "right")))
        yield lines[lo:hi], sizes[lo:hi]
        lo = hi


def _group_links(members: pa.Table, lines: pa.Table) -> pa.Table:
    """Links of all buckets of a group.  members: (bucket, id, comp, prio, ask), the last three the same for all rows of an id; lines: (id, line)."""
    bucket, ids, comp, prio, ask = (members.column(c).to_numpy() for c in ("bucket", "id", "comp", "prio", "ask"))
    known = lines.column("id").to_numpy()
    if not len(known):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    known, first = np.unique(known, return_index=True)
    sets = gram_sets(lines.column("line").take(pa.array(first)).to_pylist())
    line, row = np.searchsorted(known, ids), np.zeros(len(known), np.int64)
    row[line] = np.arange(len(ids))
    found = np.array(group_links(sets, bucket, line, prio[row], comp[row], ask[row]), np.int64).reshape(-1, 2)
    a, b = known[found[:, 0]], known[found[:, 1]]
    return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})


def _links(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Saved links (a, b) of the members (group, chunk, bucket, id, comp, prio, ask) of each group and chunk."""
    key = ["group", "chunk"]
    lines = members.select(*key, "id").distinct().join(texts.select("id", "line"), "id").select(*key, "id", "line").toDF("g", "c", "id", "line")
    found = members.groupBy(*key).cogroup(lines.groupBy("g", "c")).applyInArrow(lean(_group_links), "a long, b long")
    return saved(found.distinct(), "links")


def line_components(df: DataFrame, group_chars: int = GROUP_CHARS, group_lines: int = GROUP_LINES) -> DataFrame:
    """(id, comp) of the classes of equal lines that link with another class.  df: (doc_id, text), text not null."""
    chars = df.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    fragments = max(partitions(df), -(-chars // 200 * BANDS // FRAGMENT))
    rows = df.mapInArrow(lean(_band_rows(fragments)), "frag int, buckets binary, ids binary").groupBy("frag").applyInArrow(lean(_shared_buckets), "bucket long, first long, short long")
    shared = saved(rows.distinct(), "bands")
    lines = df.mapInArrow(lean(_line_texts), "id long, line string").withColumn("short", F.shiftrightunsigned("id", 24))
    texts = saved(lines.join(bounded(shared.select("short").distinct()), "short", "left_semi").dropDuplicates(["id"]).withColumn("chars", F.length("line")), "lines")

    # buckets of the whole ids, and how each is dealt: groups take about group_chars characters, large buckets are cut
    owners = shared.groupBy("short").agg((-F.count("*")).alias("prio"))  # lines that share most are centres
    known = texts.select("id", "short", "chars").join(owners, "short")
    placed = saved(shared.join(known, "short").select("bucket", "first", "id", "chars", "prio"), "placed")
    stats = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("chars").alias("size"), F.min(F.struct("prio", "id")).alias("centre"))
    stats = stats.where("n > 1").withColumn("chunks", F.ceil(F.greatest(F.col("n") / group_lines, F.col("size") / group_chars)))
    large = saved(stats.where("chunks > 1").select("bucket", "chunks", F.col("centre.id").alias("centre")), "large")
    groups = max(partitions(df), -(-(placed.agg(F.sum("chars").alias("n")).first()["n"] or 0) // group_chars))
    columns = ["group", "chunk", "bucket", "id", F.col("id").alias("comp"), "prio", F.lit(True).alias("ask")]
    small = placed.join(bounded(large.select("bucket")), "bucket", "left_anti").withColumn("group", F.pmod(F.xxhash64("first"), F.lit(groups))).withColumn("chunk", F.lit(-1).cast("long"))
    whole = _links(small.select(*columns), texts)
    links = [whole]
    if large.isEmpty():
        out = connected_components(whole)
    else:
        in_large = placed.join(bounded(large), "bucket").withColumn("group", F.col("bucket"))
        spread = in_large.withColumn("chunk", F.when(F.col("id") == F.col("centre"), F.expr("sequence(0L, chunks - 1)")).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("chunks")))))
        links.append(_links(spread.withColumn("chunk", F.explode("chunk")).select(*columns), texts))
        labels = connected_components(whole.union(links[1]).distinct())
        links.append(_links(_across(in_large, labels, group_lines), texts))
        out = labels
        if not links[2].isEmpty():
            out = connected_components(labels.select(F.col("id").alias("a"), F.col("comp").alias("b")).union(links[2]))
            drop(labels)
    drop(shared, texts, placed, large, *links)
    return out


def _across(members: DataFrame, labels: DataFrame, group_lines: int) -> DataFrame:
    """What large buckets still have to compare: members outside their centre's component with the members of all chunks."""
    marked = members.join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    centres = marked.where("id = centre").select("bucket", F.col("comp").alias("main"))
    rest = marked.join(bounded(centres), "bucket").withColumn("ask", F.col("comp") != F.col("main"))
    asking = rest.where("ask").groupBy("bucket").agg(F.ceil(F.count("*") / group_lines).alias("parts"))
    rest = saved(rest.join(bounded(asking), "bucket"), "rest")
    part, chunk = F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")), F.pmod(F.xxhash64("id"), F.col("chunks"))
    asks = rest.where("ask").withColumn("part", part).withColumn("chunk", F.explode(F.expr("sequence(0L, chunks - 1)")))
    told = rest.withColumn("chunk", chunk).withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)"))).where(~F.col("ask") | (F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")) != F.col("part")))
    columns = [F.col("bucket").alias("group"), (F.col("part") * F.col("chunks") + F.col("chunk")).alias("chunk"), F.xxhash64("bucket", "part", "chunk").alias("bucket"), "id", "comp", "prio", "ask"]
    return asks.select(*columns).union(told.withColumn("ask", F.lit(False)).select(*columns))


def removed_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tkey, removed): the numbers of the lines that go, for each document that loses some; tkey is xxhash64 of the text."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    comps = line_components(docs)
    seen = saved(docs.mapInArrow(lean(_occurrences), "doc_id long, tkey long, line_no int, line_id long"), "occurrences")
    # a row for each distinct line, then for each component, before anything meets its occurrences again
    at = F.struct("doc_id", "tkey", "line_no")
    lines = seen.groupBy("line_id").agg(F.min(at).alias("lo"), F.count("*").alias("n"))
    lines = saved(lines.join(comps.withColumnRenamed("id", "line_id"), "line_id", "left").withColumn("comp", F.coalesce("comp", "line_id")), "distinct")
    kept = lines.groupBy("comp").agg(F.min("lo").alias("kept"), F.sum("n").alias("n")).where("n > 1").select("comp", "kept")
    repeated = saved(lines.join(kept, "comp").select("line_id", "kept"), "repeated")
    gone = seen.join(repeated, "line_id").where(~at.eqNullSafe(F.col("kept")))
    out = saved(gone.groupBy("doc_id", "tkey").agg(F.array_sort(F.collect_set("line_no")).alias("removed")), "removed")
    drop(comps, seen, lines, repeated)
    return out


def _rebuilt(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row (all columns of df), lines, gone and left: the non-blank lines of each text, how many go, and what stays."""
    gone = removed_lines(df, id_col, text_col)
    table = bounded(gone).toDF("doc", "tkey", "removed")
    whole = df.select(F.struct(*df.columns).alias("row"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    joined = whole.join(table, F.col("id").eqNullSafe(F.col("doc")) & (F.xxhash64("text") == F.col("tkey")), "left")
    parts = F.split("text", "\n")
    lines = F.size(F.filter(parts, lambda x: x.rlike(r"[^ \t\x0b\x0c\r]")))
    # the numbers that stay, by hash, then their lines: linear in a text of many lines, which is split once
    numbers = lambda p: F.array_except(F.sequence(F.lit(0), F.size(p) - 1), "removed")
    stays = F.transform(F.array(parts), lambda p: F.array_join(F.transform(numbers(p), lambda i: F.get(p, i)), "\n"))[0]
    return joined.select("row", lines.alias("lines"), F.coalesce(F.size("removed"), F.lit(0)).alias("gone"), F.when(F.col("removed").isNull(), F.col("row").getField(text_col)).otherwise(stays).alias("left"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df with repeated and near-repeated lines taken out, without documents of which nothing is left."""
    out = _rebuilt(df, id_col, text_col).where("lines = 0 OR gone < lines")
    row = F.col("row").withField(text_col, F.col("left"))
    if "n_chars" in df.columns:
        row = row.withField("n_chars", F.when(F.col("gone") > 0, F.length("left").cast(df.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")))
    return out.select(row.alias("row")).select("row.*")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return _rebuilt(docs, "doc_id", "text").select("row.doc_id", F.col("lines").cast("long").alias("n_lines"), F.col("gone").cast("long").alias("n_removed"), F.col("left").alias("text"))


QUERIES = {"op9_line_dedup": op9_line_dedup}
