"""Mixing sources to target weights by temperature, in DataFrame operations only.

Source shares p of the tokens become weights p^a / sum p^a.  The exponent a is bisected: the largest whose
entropy reaches ``entropy`` of the greatest possible, but no smaller than the repetition limit allows, which
is the least a at which no source repeats more than ``max_repeats`` times.  Without a token budget the
source that is wanted least counts once, so every document stays; others repeat in whole epochs and part of
one more.  With a budget sources may also be cut; one beyond what the limit allows is not reached, which a warning
tells, and blocks are sized by the tokens placed.  An epoch is a permutation of its source by hash; a part
epoch is the longest prefix of the permutation within what is left of the source's budget.  The epochs of all
sources advance together through blocks of about ``block_tokens``, each permuted by hash, so every block
has the target weights.

Words ``[^\\x20\\x09-\\x0D]+`` count as tokens.  Defined results: a null text counts as empty; a null source is
a source; a source without tokens, and a table without tokens, repeats once; documents of no tokens are
placed like others; rows with the same id are told apart by their texts and full repeats are placed side by
side; an empty table gives an empty result.  Running sums go by buckets of the permutation hash, then by
document within a bucket, so a hot source is dealt out.  Other columns are not read by ``mix`` and pass
through ``repeated``.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._text import bounded, documents, saved

ENTROPY, MAX_REPEATS, BLOCK_TOKENS, SEED = 0.95, 2.0, 100_000, "mix"
LEVELS, STEPS = 5, 8
WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a bucket of the permutation, on average.
BUCKET_ROWS = 2_000


def _light(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, source, n_tokens and tkey, which tells texts apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_tokens"), F.md5(text).alias("tkey"))


def _key(epoch: Column) -> Column:
    """Place of a document in its source's permutation of an epoch."""
    return F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), epoch.cast("string"), F.lit(SEED)))


def entropy_exponent(shares: DataFrame, target: float) -> float:
    """The largest exponent in [0, 1] at which the entropy of share^a (normalised) is at least ``target``.

    Each pass over the shares evaluates the 2^LEVELS - 1 inner points that LEVELS bisections can reach.
    """

    def entropies(points: list[float]) -> list[float]:
        aggs = [x for k, a in enumerate(points) for x in (F.sum(F.pow("share", F.lit(a))).alias(f"z{k}"), F.sum(F.pow("share", F.lit(a)) * F.ln("share")).alias(f"s{k}"))]
        row = shares.agg(*aggs).first()
        return [math.log(row[f"z{k}"]) - a * row[f"s{k}"] / row[f"z{k}"] for k, a in enumerate(points)]

    if entropies([1.0])[0] >= target:
        return 1.0
    lo, hi, n = 0.0, 1.0, 1 << LEVELS
    for _ in range(STEPS):
        points = [lo + (hi - lo) * k / n for k in range(1, n)]
        reached = [a for a, h in zip(points, entropies(points), strict=True) if h >= target]
        width = (hi - lo) / n
        lo = reached[-1] if reached else lo
        hi = lo + width
    return lo


def repeat_exponent(ratio: float, limit: float) -> float:
    """The least exponent at which the largest and the smallest share, ``ratio`` apart, repeat at most ``limit`` to 1."""
    if ratio <= limit:
        return 0.0
    lo, hi = 0.0, 1.0
    for _ in range(LEVELS * STEPS):
        mid = (lo + hi) / 2
        if ratio ** (1 - mid) <= limit:
            hi = mid
        else:
            lo = mid
    return hi


def weights(light: DataFrame, entropy: float = ENTROPY, max_repeats: float = MAX_REPEATS, budget: int | None = None) -> tuple[DataFrame, float]:
    """(source, total, weight, repeats) of every source, and the tokens of the mixture.

    Under a budget that the repetition limit keeps out of reach the mixture is short: capped sources miss their
    weights, and where all are capped the weights are the sources' own shares.  The tokens returned are those that the
    plan places, and a warning tells the shortfall.  The driver holds a few numbers; sources stay in a table however
    many there are.
    """
    totals = saved(light.groupBy("source").agg(F.sum("n_tokens").alias("total")), "sources")
    known = totals.where("total > 0")
    row = known.agg(F.count("*").alias("n"), F.sum("total").alias("t"), F.max("total").alias("most"), F.min("total").alias("least")).first()
    if not row["n"]:
        return totals.select("source", "total", F.lit(0.0).alias("weight"), F.lit(1.0).alias("repeats")), 0.0
    shares = known.select("source", "total", (F.col("total") / F.lit(float(row["t"]))).alias("share"))
    a = 1.0 if row["n"] == 1 else round(max(entropy_exponent(shares, entropy * math.log(row["n"])), repeat_exponent(row["most"] / row["least"], max_repeats)), 9)
    z = round(shares.agg(F.sum(F.pow("share", F.lit(a)))).first()[0], 9)
    weight = F.pow("share", F.lit(a)) / F.lit(z)
    # the most common source repeats least
    top = round((row["most"] / row["t"]) ** a / z, 9)
    tokens = float(budget) if budget is not None else row["most"] / top
    repeats = F.round(F.lit(tokens) * weight / F.col("total"), 9)
    repeats = F.least(F.lit(float(max_repeats)), F.greatest(F.lit(1.0), repeats) if budget is None else repeats)
    all_shares = totals.withColumn("share", F.when(F.col("total") > 0, F.col("total") / F.lit(float(row["t"]))))
    out = all_shares.select("source", "total", F.coalesce(F.round(weight, 9), F.lit(0.0)).alias("weight"), F.when(F.col("total") > 0, repeats).otherwise(F.lit(1.0)).alias("repeats"))
    plan = saved(out, "weights")
    if budget is not None:
        tokens = plan.agg(F.sum(F.col("repeats") * F.col("total"))).first()[0]
        if tokens < 0.999 * budget:
            warnings.warn(f"the mixture holds {tokens:.0f} of {budget} tokens: no source may repeat more than {max_repeats:g} times", stacklevel=2)
    return plan, tokens


def _bases(sums: DataFrame, upper: int) -> DataFrame:
    """(s, e, b, base): the tokens of an epoch before each bucket, in two levels, so that the buckets of a hot source
    are summed in as many groups as a bucket name's first ``upper`` digits tell apart."""
    sums = sums.withColumn("top", F.substring("bucket", 1, upper))
    tops = sums.groupBy("source", "epoch", "top").agg(F.sum("in_bucket").alias("in_top"))
    before = lambda what, over: F.coalesce(F.sum(what).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = tops.select(F.col("source").alias("s"), F.col("epoch").alias("e"), F.col("top").alias("t"), before("in_top", Window.partitionBy("source", "epoch").orderBy("top")).alias("above"))
    low = sums.withColumn("inner", before("in_bucket", Window.partitionBy("source", "epoch", "top").orderBy("bucket")))
    both = low.join(tops, F.col("source").eqNullSafe(F.col("s")) & (F.col("epoch") == F.col("e")) & (F.col("top") == F.col("t")))
    return both.select("s", "e", F.col("bucket").alias("b"), (F.col("above") + F.col("inner")).alias("base"))


def _placed(light: DataFrame, plan: DataFrame, rows: int) -> DataFrame:
    """A row for each document and epoch that its source reaches, with the tokens before it in the epoch."""
    digits = 1 if rows <= BUCKET_ROWS else math.ceil(math.log(rows / BUCKET_ROWS, 16)) + 1
    epochs = light.join(bounded(plan), light["source"].eqNullSafe(plan["source"])).select("doc_id", light["source"], "n_tokens", "tkey", "total", "repeats", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil("repeats").cast("int")) - 1)).alias("epoch"))
    keyed = epochs.withColumn("key", _key(F.col("epoch"))).withColumn("bucket", F.substring("key", 1, digits))
    sums = _bases(keyed.groupBy("source", "epoch", "bucket").agg(F.sum("n_tokens").alias("in_bucket")), (digits + 1) // 2)
    within = F.sum("n_tokens").over(Window.partitionBy("source", "epoch", "bucket").orderBy("key", "tkey").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    both = keyed.withColumn("upto", within).join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("epoch") == F.col("e")) & (F.col("bucket") == F.col("b")))
    both = both.withColumn("upto", F.col("upto") + F.col("base"))
    part = (F.col("repeats") - F.col("epoch")) * F.col("total")
    return both.where((F.col("epoch") + 1 <= F.col("repeats")) | (F.col("upto") <= part)).drop("s", "e", "b", "base", "bucket")


def mix(df: DataFrame, entropy: float = ENTROPY, max_repeats: float = MAX_REPEATS, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, n_tokens, epoch, block and place (from 1, within the block) of every document of the mixture."""
    light = saved(_light(df, id_col, text_col, source_col), "light")
    plan, tokens = weights(light, entropy, max_repeats, budget)
    blocks = max(1, math.ceil(round(tokens, 3) / block_tokens))
    placed = _placed(light, plan, light.count())
    at = (F.col("epoch") * F.col("total") + F.col("upto") - F.col("n_tokens")) / F.greatest(F.col("repeats") * F.col("total"), F.lit(1.0))
    placed = placed.withColumn("block", F.least(F.floor(at * F.lit(float(blocks))), F.lit(blocks - 1)).cast("long"))
    place = F.row_number().over(Window.partitionBy("block").orderBy("key", "tkey", "source")).cast("long")
    return placed.select("doc_id", "source", "n_tokens", F.col("epoch").cast("long").alias("epoch"), "block", place.alias("place"))


def repeated(df: DataFrame, entropy: float = ENTROPY, max_repeats: float = MAX_REPEATS, budget: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of df, each as often as the mixture holds it.

    A part epoch is a prefix of its permutation, so one key for each source tells what it holds: the texts
    themselves are not shuffled.
    """
    light = saved(_light(df, id_col, text_col, source_col), "light")
    plan, _ = weights(light, entropy, max_repeats, budget)
    part = _placed(light, plan.where("repeats > floor(repeats)"), light.count()).where("epoch + 1 > repeats")
    last = part.groupBy(F.col("source").alias("s")).agg(F.max(F.struct("key", "tkey")).alias("_last"))
    ends = plan.select(F.col("source").alias("_source"), F.floor("repeats").cast("int").alias("_whole")).join(last, F.col("_source").eqNullSafe(F.col("s")), "left")
    ends = saved(ends.select("_source", "_whole", "_last"), "ends")
    whole = df.select(F.struct(*df.columns).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("tkey"))
    copies = F.col("_whole") + F.when(F.struct(_key(F.col("_whole")).alias("key"), "tkey") <= F.col("_last"), F.lit(1)).otherwise(F.lit(0))
    out = whole.join(bounded(ends), F.col("source").eqNullSafe(F.col("_source"))).select("row", copies.alias("copies"))
    return out.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


ORACLE_SQL = {
    "op6_mixing": f"""
WITH RECURSIVE light AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens, md5(coalesce(text, '')) AS tkey FROM documents
), totals AS (SELECT source, sum(n_tokens)::BIGINT AS total FROM light GROUP BY source),
shares AS (SELECT source, total, total / (SELECT sum(total) FROM totals)::DOUBLE AS share FROM totals WHERE total > 0),
lists AS (SELECT list(share) AS ps, count(*) AS n, max(total) AS most, min(total) AS least, sum(total) AS t FROM shares),
by_entropy(k, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT k + 1, CASE WHEN h >= {ENTROPY} * ln(n) THEN mid ELSE lo END, CASE WHEN h >= {ENTROPY} * ln(n) THEN hi ELSE mid END
  FROM (SELECT k, lo, hi, (lo + hi) / 2 AS mid, n, ln(list_sum([pow(x, (lo + hi) / 2) FOR x IN ps])) - (lo + hi) / 2 * list_sum([pow(x, (lo + hi) / 2) * ln(x) FOR x IN ps]) / list_sum([pow(x, (lo + hi) / 2) FOR x IN ps]) AS h FROM by_entropy, lists) WHERE k < {LEVELS * STEPS}
), by_repeat(k, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT k + 1, CASE WHEN pow(most / least, 1 - (lo + hi) / 2) <= {MAX_REPEATS} THEN lo ELSE (lo + hi) / 2 END, CASE WHEN pow(most / least, 1 - (lo + hi) / 2) <= {MAX_REPEATS} THEN (lo + hi) / 2 ELSE hi END FROM by_repeat, lists WHERE k < {LEVELS * STEPS}
), alpha AS (
  SELECT CASE WHEN n = 1 THEN 1.0 ELSE round(greatest(
    CASE WHEN -list_sum([x * ln(x) FOR x IN ps]) >= {ENTROPY} * ln(n) THEN 1.0 ELSE (SELECT lo FROM by_entropy WHERE k = {LEVELS * STEPS}) END,
    CASE WHEN most / least <= {MAX_REPEATS} THEN 0.0 ELSE (SELECT hi FROM by_repeat WHERE k = {LEVELS * STEPS}) END), 9) END AS a, ps, most, t FROM lists
), z AS (SELECT a, most, t, round(list_sum([pow(x, a) FOR x IN ps]), 9) AS z FROM alpha),
mixture AS (SELECT a, z, most / round(pow(most / t, a) / z, 9) AS tokens FROM z),
plan AS (
  SELECT totals.source, totals.total, coalesce(least({MAX_REPEATS}, greatest(1.0, round(tokens * (pow(share, a) / z) / totals.total, 9))), 1.0)::DOUBLE AS repeats
  FROM totals LEFT JOIN shares ON totals.source IS NOT DISTINCT FROM shares.source CROSS JOIN mixture
), epochs AS (
  SELECT doc_id, light.source, n_tokens, tkey, total, repeats, epoch, md5(concat_ws('|', doc_id::VARCHAR, epoch::VARCHAR, '{SEED}')) AS key
  FROM light JOIN plan ON light.source IS NOT DISTINCT FROM plan.source, unnest(range(greatest(1, ceil(repeats)::INT))) AS u(epoch)
), placed AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY key, tkey ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM epochs
), kept AS (SELECT * FROM placed WHERE epoch + 1 <= repeats OR upto <= (repeats - epoch) * total),
n AS (SELECT greatest(1, ceil(round(tokens, 3) / {BLOCK_TOKENS}))::BIGINT AS blocks FROM mixture),
blocked AS (
  SELECT *, least(floor((epoch * total + upto - n_tokens) / greatest(repeats * total, 1.0) * blocks::DOUBLE)::BIGINT, blocks - 1) AS block FROM kept, n
)
SELECT doc_id, source, n_tokens, epoch::BIGINT AS epoch, block, row_number() OVER (PARTITION BY block ORDER BY key, tkey, source)::BIGINT AS place FROM blocked
""",
}
QUERIES = {"op6_mixing": op6_mixing}
