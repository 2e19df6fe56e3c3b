"""Connected components, and the resolution of candidate buckets into components without all pairs.

Everything stays in DataFrames: labels, links and buckets never reach the driver, which only sees counts.
Each step is cut by a table in the shared folder, so a lost executor repeats one step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import drop, lean, saved

#: Links that a task unites at once (16 bytes each).
BLOCK_LINKS = 1_000_000


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v): each id of a block of links with the least id that the block's links reach."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        parts.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
        if sum(len(p[0]) for p in parts) >= BLOCK_LINKS:
            yield _stars(parts)
            parts = []
    if parts:
        yield _stars(parts)


def _stars(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Union-find by pointer jumping over arrays."""
    u, v = (np.concatenate([p[k] for p in parts]) for k in range(2))
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while True:
        a, b = root[u], root[v]
        if (a == b).all():
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    return pa.record_batch([pa.array(ids, pa.int64()), pa.array(ids[root], pa.int64())], names=["u", "v"])


def _are_stars(edges: DataFrame) -> bool:
    """Whether each id has one edge down to an id that has none: then that is the least of its component."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select(F.col("v").alias("id"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("id").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 OR down + up > 1").isEmpty()


def connected_components(links: DataFrame) -> DataFrame:
    """(id, comp) of every id in links (a long, b long): comp is the least id that links reach.

    Distributed union-find: each task unites its own links, block by block, into stars; alternating large-star and
    small-star steps unite the stars of all tasks.  A node's least neighbour comes from a partial
    aggregation and goes back by a join that Spark splits where a node is hot, so no task gathers a
    node's neighbours.  Self links keep an id alone.  Null ends are ignored.
    """
    whole = links.where("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    ids = saved(whole.mapInArrow(lean(_united), "u long, v long").distinct(), "edges")
    edges = saved(ids.where("u != v"), "edges")
    while not _are_stars(edges):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u != v").union(low.select("u", F.col("m").alias("v")))
        step = saved(small.distinct(), "edges")
        drop(edges)
        edges = step
    labels = ids.select(F.col("u").alias("id")).distinct()
    out = saved(labels.join(edges.select(F.col("u").alias("id"), F.col("v").alias("m")), "id", "left").select("id", F.coalesce("m", "id").alias("comp")), "components")
    drop(ids, edges)
    return out


def resolve(buckets: DataFrame, verify: Callable[[DataFrame], DataFrame], near: str | None = None, small: int = 8) -> DataFrame:
    """Components (id, comp) of all linked pairs among the ids that share a bucket.

    buckets: (bucket long, id long), optionally prio, and any other columns.  ``verify`` gets distinct pairs
    (a, b), a < b, and returns those that are linked.  ``near`` is an SQL condition that each linked pair meets in
    one of its buckets, on x_a and x_b for every other column x of the two members.

    In every round a bucket's centres, the members of least prio in some classes, are compared with the
    bucket's other members; then they leave the bucket, all of whose pairs with them are decided.  Members
    that got linked share a component and need no further comparison; a bucket within one component is done.
    The number of centres grows 64-fold from round to round, so that buckets of unlike members end as well,
    each pair compared.  No pair of unlike components that shares a bucket stays undecided: the result has
    every link.
    """
    spark = buckets.sparkSession
    own = [c for c in buckets.columns if c not in ("bucket", "id", "prio")]
    names = ["bucket", "id", "prio", *own]
    alive = (buckets if "prio" in buckets.columns else buckets.withColumn("prio", F.xxhash64("id"))).select(*names)
    previous, labels, rounds = None, None, 0
    while True:
        n = 1 << 6 * rounds
        if labels is None:
            marked = alive.withColumn("comp", F.col("id"))
        else:
            marked = alive.join(labels, "id", "left").select(*names, F.coalesce("comp", "id").alias("comp"))
        stats = marked.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"))
        live = saved(marked.join(stats.where("lo != hi").select("bucket", "n"), "bucket"), "live")
        drop(previous)
        if live.isEmpty():
            drop(live)
            break
        classed = live.withColumn("class", F.when(F.col("n") <= small + n, F.col("id")).otherwise(F.pmod(F.xxhash64("id", F.lit(rounds)), F.lit(n))))
        centres = classed.groupBy("bucket", "class").agg(F.min(F.struct("prio", "id", "comp", *own)).alias("c"))
        centres = centres.select("bucket", *[F.col(f"c.{c}").alias(f"c{c}") for c in ("id", "comp", *own)])
        pairs = live.join(centres, "bucket").where("id != cid AND comp != ccomp")
        first = F.col("id") < F.col("cid")
        pairs = pairs.select(F.least("id", "cid").alias("a"), F.greatest("id", "cid").alias("b"), *[F.when(first if side == "a" else ~first, F.col(c)).otherwise(F.col(f"c{c}")).alias(f"{c}_{side}") for c in own for side in "ab"])
        pairs = saved((pairs.where(near) if near else pairs).select("a", "b").distinct(), "pairs")
        found = saved(verify(pairs).select("a", "b"), "links")
        merged = found
        if labels is not None:
            ends = found.join(labels.toDF("a", "ca"), "a", "left").join(labels.toDF("b", "cb"), "b", "left")
            merged = ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).union(labels.select(F.col("id").alias("a"), F.col("comp").alias("b")))
        components = connected_components(merged)
        alive = live.join(centres.select("bucket", F.col("cid").alias("id")), ["bucket", "id"], "left_anti").select(*names)
        drop(pairs, found, labels)
        previous, labels, rounds = live, components, rounds + 1
    return spark.createDataFrame([], "id long, comp long") if labels is None else labels
