"""N-gram Jaccard join by vertical partitioning.

Two texts link when their sets of five-word shingles have 100 * intersection >= 80 * union.  The global
order of shingles (rare first, ties by hash) yields candidates: linked sets share a shingle among the
first n - ceil(0.8 n) + 1 of either.  The order is cut into fragments by hash; a candidate pair's overlap is
counted in each fragment by itself and summed per pair, and the sum decides exactly.

1. Equal texts are one class; only its least document goes on.
2. Shingle hashes go to the fragments.  A shingle that a second class has too is shared; a fragment answers each
   slice of documents in one packed row.  Classes with fewer than 80 % shared shingles can't link and leave.  Most of a
   corpus leaves here.
3. What is left gets document frequencies among the rest, and prefixes; equal posting lists are one bucket.
   A pair is a candidate only if sizes and the places of a common shingle leave room for enough overlap.
4. Buckets resolve into components round by round (``_components.resolve``) with the vertical count as test.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; fewer words than five are one shingle.
Shingles are 64-bit hashes.  Defined results: null and empty texts have the empty set, link with nothing and
are their own component; a null id takes part in nothing and is its own row with a null component; repeated
rows appear as often as given; where an id has several texts, each text is compared and has its own component,
named by the least id that it reaches, so components of unlike texts of one id can bear the same name; an empty table gives an empty result; other columns are not read.
A fragment holds about ``FRAGMENT`` hashes, so a group fits a worker at any input size; a shingle adds one
entry to its group for each class that has it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._components import resolve
from ._text import Words, bounded, documents, drop, lean, partitions, row_slices, saved, shingle_sets, string_buffers

SHINGLE, NUM, DEN = 5, 80, 100
FRAGMENT = 1_500_000
#: Fragments of the vertical count.
PARTS = 4
PAIRS_A_BLOCK = 20_000
#: What sizes allow, and what the shingles from the first common one on allow.
NEAR = f"{DEN} * least(size_a, size_b) >= {NUM} * greatest(size_a, size_b) AND {DEN + NUM} * (1 + least(rest_a, rest_b)) >= {NUM} * (size_a + size_b)"


def least_overlap(n: np.ndarray) -> np.ndarray:
    """Shingles that any partner of a set of n must share with it."""
    return -(-NUM * n // DEN)


def _sets(text: pa.Array) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    flat, offsets = string_buffers(text)
    for lo, hi in row_slices(offsets):
        yield lo, hi, shingle_sets(Words(flat[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), SHINGLE)


def _fragment_rows(ids: np.ndarray, sets: list[np.ndarray], fragments: int) -> pa.RecordBatch:
    """What a slice of documents sends: a row for each fragment it has hashes in, and a head with ids and set sizes.

    The head is the row of fragment -1.  The other rows have the hashes and the place in the slice of each one's
    document, and nothing of documents that are not in the fragment.  A slice is known by a hash of its ids.
    """
    lens = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    place = np.repeat(np.arange(len(sets), dtype="<u2"), lens)
    frag = (flat >> np.uint64(32)).astype(np.int64) * fragments >> 32
    order = np.argsort(frag, kind="stable")
    cuts = np.searchsorted(frag[order], np.arange(fragments + 1))
    full = np.flatnonzero(np.diff(cuts)).tolist()
    parts = [order[cuts[f] : cuts[f + 1]] for f in full]
    name = int.from_bytes(hashlib.blake2b(ids.tobytes(), digest_size=8).digest(), "little", signed=True)
    places = [ids.astype("<i8").tobytes(), *(place[p].tobytes() for p in parts)]
    hashes = [lens.astype("<i8").tobytes(), *(flat[p].tobytes() for p in parts)]
    columns = [pa.array([-1, *full], pa.int32()), pa.array([name] * (1 + len(full)), pa.int64()), pa.array(places, pa.binary()), pa.array(hashes, pa.binary())]
    return pa.record_batch(columns, names=["frag", "slice", "places", "hashes"])


_FRAGMENT_SCHEMA = "frag int, slice long, places binary, hashes binary"
#: Documents of a slice at most.
SLICE = 1 << 16


def _text_fragments(fragments: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for first, last, sets in _sets(batch.column("text")):
                for lo in range(0, last - first, SLICE):
                    yield _fragment_rows(ids[first + lo : min(last, first + lo + SLICE)], sets[lo : lo + SLICE], fragments)

    return run


def _set_fragments(fragments: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for lo in range(0, len(ids), 1024):
                part = batch.column("shingles").slice(lo, 1024).to_pylist()
                yield _fragment_rows(ids[lo : lo + 1024], [np.frombuffer(x, np.uint64) for x in part], fragments)

    return run


def _frequency(hashes: np.ndarray) -> np.ndarray:
    """How often each element's value occurs."""
    order = np.argsort(hashes, kind="stable")
    s = hashes[order]
    new = np.concatenate(([True], s[1:] != s[:-1])) if len(s) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    counts = np.diff(np.concatenate([at, [len(s)]]))
    out = np.empty(len(s), np.int64)
    out[order] = np.repeat(counts, counts)
    return out


def _answered(table: pa.Table) -> pa.Table:
    """A fragment's answer to each slice, one packed row: of the shingles that another document has too, the hash, the
    document's place in the slice and the document frequency.  Heads pass through."""
    slices, places, raw = (table.column(c).to_pylist() for c in ("slice", "places", "hashes"))
    if table.num_rows and table.column("frag")[0].as_py() < 0:
        return pa.table({"slice": pa.array(slices, pa.int64()), "head": pa.array([True] * len(slices)), "places": pa.array(places, pa.binary()), "hashes": pa.array(raw, pa.binary()), "freq": pa.array([b""] * len(slices), pa.binary())})
    lens = np.array([len(x) // 8 for x in raw], np.int64)
    hashes = np.frombuffer(b"".join(raw), np.uint64)
    at = np.frombuffer(b"".join(places), "<u2")
    freq = _frequency(hashes)
    out, ends = [], np.cumsum(lens).tolist()
    for name, n, end in zip(slices, lens.tolist(), ends, strict=True):
        keep = np.flatnonzero(freq[end - n : end] > 1) + (end - n)
        if len(keep):
            out.append((name, at[keep].tobytes(), hashes[keep].tobytes(), np.minimum(freq[keep], 2**32 - 1).astype("<u4").tobytes()))
    columns = list(zip(*out, strict=True)) or [(), (), (), ()]
    return pa.table({"slice": pa.array(columns[0], pa.int64()), "head": pa.array([False] * len(out), pa.bool_()), "places": pa.array(columns[1], pa.binary()), "hashes": pa.array(columns[2], pa.binary()), "freq": pa.array(columns[3], pa.binary())})


_ANSWER_SCHEMA = "slice long, head boolean, places binary, hashes binary, freq binary"


def _counted(table: pa.Table) -> pa.Table:
    """A fragment's answer without hashes: how many shared shingles each document of the slice has in it."""
    found = _answered(table)
    if not found.num_rows or found.column("head")[0].as_py():
        return found
    docs, counts = [], []
    for raw in found.column("places").to_pylist():
        place, n = np.unique(np.frombuffer(raw, "<u2"), return_counts=True)
        docs.append(place.tobytes())
        counts.append(n.astype("<u4").tobytes())
    empty = pa.array([b""] * found.num_rows, pa.binary())
    return pa.table({"slice": found.column("slice"), "head": found.column("head"), "places": pa.array(docs, pa.binary()), "hashes": empty, "freq": pa.array(counts, pa.binary())})


def _headed(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Ids and set sizes of a slice's documents, and the rows of its answers."""
    head = table.column("head").to_pylist()
    at = head.index(True)
    ids = np.frombuffer(table.column("places")[at].as_py(), "<i8")
    sizes = np.frombuffer(table.column("hashes")[at].as_py(), "<i8")
    return ids, sizes, [k for k, x in enumerate(head) if not x]


def _totals(table: pa.Table) -> pa.Table:
    """Set size and number of shared shingles of each document of a slice."""
    ids, sizes, rows = _headed(table)
    shared = np.zeros(len(ids), np.int64)
    for k in rows:
        shared[np.frombuffer(table.column("places")[k].as_py(), "<u2")] += np.frombuffer(table.column("freq")[k].as_py(), "<u4")
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "size": pa.array(sizes, pa.int64()), "shared": pa.array(shared, pa.int64())})


def _prefixes(table: pa.Table) -> pa.Table:
    """The shared part of each document's prefix: shingle, its document frequency, document, size, shingles after it
    in the document's order, and prio, which is least for documents whose shingles are common."""
    ids, sizes, rows = _headed(table)
    joined = lambda c, kind: np.frombuffer(b"".join(table.column(c)[k].as_py() for k in rows), kind)
    place, h, f = joined("places", "<u2"), joined("hashes", np.uint64), joined("freq", "<u4").astype(np.int64)
    order = np.lexsort((h, f, place))
    place, h, f = place[order], h[order], f[order]
    bounds = np.searchsorted(place, np.arange(len(ids) + 1))
    own = sizes - np.diff(bounds)  # shingles that no other document has come first
    length = np.clip(sizes - least_overlap(sizes) + 1 - own, 0, np.diff(bounds))
    weight = np.bincount(place, np.log(f), len(ids))
    doc = np.repeat(np.arange(len(ids)), length)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(length) - length, length)
    at = bounds[doc] + nth
    columns = {"shingle": h[at].view(np.int64), "freq": f[at], "id": ids[doc], "size": sizes[doc], "rest": (sizes - own)[doc] - 1 - nth}
    return pa.table({k: pa.array(x, pa.int64()) for k, x in columns.items()} | {"prio": pa.array(-weight[doc] / sizes[doc], pa.float64())})


_EDGES = np.array([(k << 64) // PARTS for k in range(PARTS)], dtype=np.uint64)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut each needed set into the fragments of the vertical count."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            some = batch.slice(lo, 1024)
            raw = [np.frombuffer(x, np.uint64) for x in some.column("shingles").to_pylist()]
            cuts = [[*np.searchsorted(x, _EDGES).tolist(), len(x)] for x in raw]
            columns = [
                pa.array(np.tile(np.arange(PARTS), len(raw)), pa.int32()),
                pa.array(np.repeat(some.column("block").to_numpy(), PARTS), pa.int32()),
                pa.array(np.repeat(some.column("id").to_numpy(), PARTS), pa.int64()),
                pa.array([x[c[p] : c[p + 1]].tobytes() for x, c in zip(raw, cuts, strict=True) for p in range(PARTS)], pa.binary()),
            ]
            yield pa.record_batch(columns, names=["part", "block", "id", "seg"])


def overlap_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[left[k]] and sets[right[k]]; sets are ascending arrays without repeats."""
    lens = np.array([len(x) for x in sets], np.int64)
    starts = np.cumsum(lens) - lens
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    _, code = np.unique(flat, return_inverse=True)
    width = np.int64(max(1, int(code.max(initial=0)) + 1))
    whole = np.repeat(np.arange(len(sets)), lens) * width + code  # ascending: sets in order, codes ascending within
    out = np.zeros(len(left), np.int64)
    step = max(1, 2_000_000 // max(1, int(lens.max(initial=1))))
    for lo in range(0, len(left), step):
        x, y = left[lo : lo + step], right[lo : lo + step]
        swap = lens[x] > lens[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        n = lens[x]
        at = np.repeat(starts[x] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        want = np.repeat(y * width, n) + code[at]
        pos = np.minimum(np.searchsorted(whole, want), max(0, len(whole) - 1))
        hit = whole[pos] == want if len(whole) else np.zeros(0, bool)
        out[lo : lo + step] = np.bincount(np.repeat(np.arange(len(x)), n)[hit], minlength=len(x))
    return out


def _overlaps(segs: pa.Table, pairs: pa.Table) -> pa.Table:
    """Partial overlaps of a block's pairs in one fragment."""
    a, b = pairs.column("a").to_numpy(), pairs.column("b").to_numpy()
    ids = segs.column("id").to_numpy()
    raw = [np.frombuffer(x, np.uint64) for x in segs.column("seg").to_pylist()]
    order = np.argsort(ids, kind="stable")
    out = overlap_counts([raw[i] for i in order.tolist()], np.searchsorted(ids[order], a), np.searchsorted(ids[order], b))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "part_overlap": pa.array(out, pa.int64())})


def linked_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of distinct pairs (a, b), those that link.  sets: (id, size, shingles), the hashes ascending.

    Pairs are dealt into blocks by b, so a member of many pairs spreads; each block gets the sets it needs
    once, cut into PARTS fragments.
    """
    blocks = max(1, -(-pairs.count() // PAIRS_A_BLOCK), partitions(pairs) // PARTS)
    dealt = pairs.withColumn("block", F.pmod(F.xxhash64("b"), F.lit(blocks)).cast("int"))
    need = dealt.select(F.col("a").alias("id"), "block").union(dealt.select(F.col("b").alias("id"), "block")).distinct()
    segs = need.join(sets.select("id", "shingles"), "id").mapInArrow(lean(_segments), "part int, block int, id long, seg binary")
    spread = dealt.select("a", "b", "block", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    partial = segs.groupBy("part", "block").cogroup(spread.groupBy("part", "block")).applyInArrow(lean(_overlaps), "a long, b long, part_overlap long")
    total = partial.groupBy("a", "b").agg(F.sum("part_overlap").alias("both"))
    size = sets.select("id", "size")
    total = total.join(size.toDF("a", "sa"), "a").join(size.toDF("b", "sb"), "b")
    return total.where(F.col("both") * DEN >= NUM * (F.col("sa") + F.col("sb") - F.col("both"))).select("a", "b", (F.col("both") / (F.col("sa") + F.col("sb") - F.col("both"))).alias("jaccard"))


def _salt(frag: str) -> Column:
    """Deals heads, which need nobody's company, to groups of their own."""
    return F.when(F.col(frag) < 0, F.pmod("slice", F.lit(256))).otherwise(F.lit(0)).alias("salt")


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id that links reach) of every row."""
    given = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = given.where("doc_id IS NOT NULL")
    count = rows.agg(F.count("*").alias("n"), F.approx_count_distinct("doc_id").alias("d"), F.sum(F.length("text")).alias("chars")).first()
    if rows.groupBy("doc_id").count().where("count > 1").limit(1).count():
        if _clashing(rows):
            return _by_text(rows).select("doc_id", "n_shingles", "component_id").union(_nameless(given))
        rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"))
    fragments = max(partitions(df), -(-(count["chars"] or 0) // 6 // FRAGMENT))

    # 1. classes of equal texts
    keyed = rows.select("doc_id", F.xxhash64("text").alias("k1"), F.md5("text").alias("k2"))
    least = keyed.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    copies = saved(keyed.join(least, ["k1", "k2"]).where("doc_id != rep").select("doc_id", "rep"), "copies")
    texts = rows.join(bounded(copies.select("doc_id")), "doc_id", "left_anti")

    # 2. shared shingles by fragment, answered to each slice of documents in one row
    frags = texts.mapInArrow(lean(_text_fragments(fragments)), _FRAGMENT_SCHEMA)
    counted = frags.groupBy("frag", _salt("frag")).applyInArrow(lean(_counted), _ANSWER_SCHEMA)
    sizes = saved(counted.groupBy("slice").applyInArrow(lean(_totals), "doc_id long, size long, shared long"), "sizes")
    left = saved(sizes.where((F.col("shared") * DEN >= NUM * F.col("size")) & (F.col("size") > 0)).select("doc_id"), "left")

    # 3. equal sets, document frequencies, prefixes and buckets
    sets = saved(texts.join(bounded(left), "doc_id", "left_semi").mapInArrow(lean(_packed), "id long, size long, digest binary, shingles binary"), "sets")
    heads = sets.groupBy("digest").agg(F.min("id").alias("head"))
    same = saved(sets.select("id", "digest").join(heads, "digest").where("id != head").select("id", "head"), "same")
    sole = sets.join(same.select("id"), "id", "left_anti")
    fewer = max(1, -(-(sole.agg(F.sum("size").alias("n")).first()["n"] or 0) // FRAGMENT))
    lists = sole.select("id", "shingles").mapInArrow(lean(_set_fragments(fewer)), _FRAGMENT_SCHEMA).groupBy("frag", _salt("frag")).applyInArrow(lean(_answered), _ANSWER_SCHEMA)
    posts = saved(lists.groupBy("slice").applyInArrow(lean(_prefixes), "shingle long, freq long, id long, size long, rest long, prio double"), "posts")
    # of equal posting lists the first shingle stays: hashes order as unsigned numbers
    signed = posts.groupBy("shingle").agg(F.min("freq").alias("freq"), F.min(F.col("shingle").bitwiseXOR(F.lit(-(1 << 63)))).alias("order"), F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("s1"), F.expr("bit_xor(xxhash64(id, 7))").alias("s2"))
    chosen = signed.where("n > 1").groupBy("n", "s1", "s2").agg(F.min(F.struct("freq", "order", "shingle")).alias("first")).select("first.shingle")
    buckets = saved(posts.join(chosen, "shingle", "left_semi").select(F.col("shingle").alias("bucket"), "id", "size", "rest", "prio"), "buckets")
    drop(left, posts)

    # 4. links and components
    labels = resolve(buckets, lambda pairs: linked_pairs(pairs, sole), NEAR)
    drop(buckets)
    head_comp = same.select(F.col("id"), "head").join(labels.toDF("head", "comp"), "head", "left").select("id", F.coalesce("comp", "head").alias("comp")).union(labels.select("id", "comp"))
    by_rep = sizes.select(F.col("doc_id").alias("rep"), "size").join(head_comp.withColumnRenamed("id", "rep"), "rep", "left").select("rep", "size", F.when(F.col("size") > 0, F.coalesce("comp", "rep")).alias("comp"))
    per_doc = copies.union(sizes.select("doc_id", F.col("doc_id").alias("rep"))).join(by_rep, "rep").select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("comp", "doc_id").alias("component_id"))
    if count["n"] != per_doc.count():
        per_doc = given.where("doc_id IS NOT NULL").select("doc_id").join(per_doc, "doc_id")
    return per_doc.union(_nameless(given))


def _nameless(given: DataFrame) -> DataFrame:
    nameless = given.where("doc_id IS NULL").mapInArrow(lean(_packed), "id long, size long, digest binary, shingles binary")
    return nameless.select("id", "size", F.lit(None).cast("long"))


def _clashing(rows: DataFrame) -> bool:
    """Whether an id has texts that differ."""
    tkey = F.xxhash64("text")
    return rows.groupBy("doc_id").agg(F.min(tkey).alias("lo"), F.max(tkey).alias("hi")).where("lo != hi").limit(1).count() > 0


def _by_text(rows: DataFrame) -> DataFrame:
    """Components of rows whose ids have several texts: distinct texts link, by their hash as id.

    doc_id, tkey (xxhash64 of the text), n_shingles, component_id and first, the least (doc_id, tkey) of the
    component, of every row; first is null where there are no shingles.
    """
    keyed = rows.select("doc_id", F.xxhash64("text").alias("tkey"), "text")
    found = saved(components(keyed.groupBy("tkey").agg(F.min("text").alias("text")), "tkey").toDF("tkey", "n_shingles", "comp"), "by_text")
    marked = keyed.select("doc_id", "tkey").join(found, "tkey").withColumn("comp", F.expr("IF(n_shingles > 0, comp, NULL)"))
    least = marked.where("comp IS NOT NULL").groupBy("comp").agg(F.min(F.struct("doc_id", "tkey")).alias("first"))
    return marked.join(least, "comp", "left").select("doc_id", "tkey", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id"), "first")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, digest and ascending shingle hashes of each text."""
    for batch in batches:
        for lo, hi, sets in _sets(batch.column("text")):
            raw = [s.tobytes() for s in sets]
            columns = [batch.column("doc_id").slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in raw], pa.binary()), pa.array(raw, pa.binary())]
            yield pa.record_batch(columns, names=["id", "size", "digest", "shingles"])


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df whose id is the least of its component; rows without an id stay.

    Where an id has several texts, the rows of the component's least (id, text hash) stay.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    if _clashing(rows):
        gone = saved(_by_text(rows).where("struct(doc_id, tkey) != first").select(F.col("doc_id").alias("doc"), "tkey").distinct(), "gone")
        whole = df.select(F.struct(*df.columns).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("key"))
        return whole.join(bounded(gone), (F.col("id") == F.col("doc")) & (F.col("key") == F.col("tkey")), "left_anti").select("row.*")
    gone = saved(components(df, id_col, text_col).where("component_id != doc_id").select(F.col("doc_id").alias("doc")).distinct(), "gone")
    whole = df.select(F.struct(*df.columns).alias("row"), F.col(id_col).cast("long").alias("id"))
    return whole.join(bounded(gone), F.col("id") == F.col("doc"), "left_anti").select("row.*")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(documents(spark, sf_dir))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All pairs that share a shingle, and what links reach: for tables on which a second engine can afford that.
ORACLE_SQL = {
    "op3_ngram_jaccard_join": f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {SHINGLE} THEN [array_to_string(w[i : i + {SHINGLE - 1}], ' ') FOR i IN range(1, len(w) - {SHINGLE - 2})] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE {DEN} * pairs.n >= {NUM} * (a.n + b.n - pairs.n)
), edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached(x, y) AS (SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reached r JOIN edges e ON r.y = e.x)
SELECT d.doc_id, coalesce(any_value(s.n), 0)::BIGINT AS n_shingles, least(d.doc_id, min(r.y))::BIGINT AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN reached r ON r.x = d.doc_id GROUP BY d.doc_id
"""
}
QUERIES = {"op3_ngram_jaccard_join": op3_ngram_jaccard_join}
