"""Mixing sources to target weights: temperature, bisection, budgeted block permutations.

Source token shares p are raised to an exponent and normalised, w = p^a / sum
p^a. Entropy falls and the largest repetition w * budget / tokens falls as the
exponent grows, so the exponent is found by bisection: the least one in [0, 1]
whose largest repetition is within ``max_repeat``, or the one that meets
``target_entropy`` (in nats, exponent in [0, 8]). Each round of bisection
evaluates a grid of 2^5 - 1 points over the table of source totals in one small
job and keeps one cell, so eight rounds fix 40 bits.

A source's budget is its weight times the total budget (the input's tokens
unless given), rounded. It is dealt as whole passes over the source and a
remainder. Documents fall into 4096 blocks a source by a hash of their id; in
each pass the blocks are permuted by a hash of pass, source and block, and
documents within a block by a hash of pass and id. The remainder takes whole
blocks while they fit, then documents of the next block while they fit; a
budget is never exceeded. ``position`` is where in its source's budget a row's
block begins, as a share, so ordering by it interleaves the sources.

All of it is DataFrame expressions. Totals are summed by source and block, so a
source holding most rows is spread over its blocks; the per-source steps see at
most 4096 rows a source, and only the one block that a budget cuts is ordered
document by document.

Defined cases: a null source is the source named ''; null or word-less texts
have 0 tokens, and come with whole passes and with whole blocks; repeated rows
each count; no rows or no tokens give no rows, and a source whose documents
have no tokens at all has no share, so none of its rows come; columns of any name are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

WORD = r"[^\x20\x09-\x0D]+"
BITS, ROUNDS = 5, 8
BLOCK_DIGITS = 3  # hexadecimal: 4096 blocks a source
BROADCAST_ROWS = 100_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _id(key: str) -> Column:
    return F.coalesce(F.col(key).cast("string"), F.lit(""))


def block_of(key: Column) -> Column:
    return F.substring(F.md5(key.cast("binary")), 1, BLOCK_DIGITS)


def order_of(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def exponent(totals: DataFrame, *, budget_share: float = 1.0, max_repeat: float | None = None, target_entropy: float | None = None) -> float:
    """Bisect the exponent over (source, tokens); only the grid's sums come to the driver."""
    shares = totals.where("tokens > 0").select(F.log(F.col("tokens") / F.col("all_tokens")).alias("lp"))
    lo, width = 0.0, 8.0 if target_entropy is not None else 1.0

    def fits(points: list[float]) -> list[bool]:
        grid = shares.select("lp", F.explode(F.array(*map(F.lit, points))).alias("a"))
        z = grid.groupBy("a").agg(F.sum(F.exp(F.col("a") * F.col("lp"))).alias("z"), F.sum(F.col("a") * F.col("lp") * F.exp(F.col("a") * F.col("lp"))).alias("e"), F.max(F.exp((F.col("a") - 1) * F.col("lp"))).alias("r"))
        got = {r["a"]: r for r in z.collect()}
        if target_entropy is not None:
            import math

            return [a in got and math.log(got[a]["z"]) - got[a]["e"] / got[a]["z"] <= target_entropy for a in points]
        return [a in got and got[a]["r"] * budget_share / got[a]["z"] <= max_repeat for a in points]

    if fits([lo])[0]:
        return lo
    for _ in range(ROUNDS):
        width /= 2**BITS
        ok = fits([lo + k * width for k in range(1, 2**BITS)])
        lo += width * (ok.index(True) if True in ok else 2**BITS - 1)
    return lo + width


def plan(spark: SparkSession, counts: DataFrame, *, max_repeat: float | None = 1.25, target_entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """From (k, source, tokens) to one row for each source and block: whole passes, what the remainder takes, weight, and place."""
    blocks = cut(spark, counts.groupBy("source", block_of(F.col("k")).alias("block")).agg(F.sum("tokens").alias("tokens")), "blocks")
    total = blocks.agg(F.sum("tokens")).first()[0] or 0
    sources = blocks.groupBy("source").agg(F.sum("tokens").alias("tokens")).withColumn("all_tokens", F.lit(float(total or 1)))
    size = float(budget if budget is not None else total)
    a = exponent(sources, budget_share=size / (total or 1), max_repeat=max_repeat, target_entropy=target_entropy) if total else 1.0
    z = sources.where("tokens > 0").agg(F.sum(F.exp(F.lit(a) * F.log(F.col("tokens") / F.col("all_tokens"))))).first()[0] or 1.0
    dealt = (
        sources.where("tokens > 0")
        .withColumn("weight", F.exp(F.lit(a) * F.log(F.col("tokens") / F.col("all_tokens"))) / F.lit(z))
        .withColumn("budget", F.round(F.col("weight") * F.lit(size)).cast("long"))
        .withColumn("passes", F.floor(F.col("budget") / F.col("tokens")).cast("long"))
        .withColumn("rest", F.col("budget") - F.col("passes") * F.col("tokens"))
        .select("source", "weight", "budget", "passes", "rest", F.col("tokens").alias("source_tokens"))
    )
    run = Window.partitionBy("source").orderBy(order_of(F.col("passes"), F.col("source"), F.col("block")), "block").rowsBetween(Window.unboundedPreceding, 0)
    placed = blocks.join(dealt, "source").withColumn("upto", F.sum("tokens").over(run))
    before = F.col("upto") - F.col("tokens")
    placed = placed.withColumn("takes", F.when(F.col("upto") <= F.col("rest"), "all").when(before < F.col("rest"), "some").otherwise("none")).withColumn("room", F.col("rest") - before)

    # the block that a budget cuts, document by document
    edge = placed.where("takes = 'some'").select("source", "block", "room", "passes")
    inside = counts.withColumn("block", block_of(F.col("k"))).join(edge, ["source", "block"]).withColumn("o", order_of(F.col("passes"), F.col("k")))
    within = Window.partitionBy("source", "block").orderBy("o").rangeBetween(Window.unboundedPreceding, 0)
    last = inside.withColumn("upto", F.sum("tokens").over(within)).where("upto <= room").groupBy("source", "block").agg(F.max("o").alias("last"))
    return placed.join(last, ["source", "block"], "left").select("source", "block", "weight", "budget", "source_tokens", "passes", "takes", "last", before.alias("before"))


def mix(spark: SparkSession, docs: DataFrame, *, text: str = "text", key: str = "doc_id", source: str = "source", **target) -> DataFrame:
    """The mixture: struct ``row`` (all columns of ``docs``), and source, n_tokens, weight, pass, position of each time that it is dealt."""
    rows = docs.select(F.struct("*").alias("row"), _id(key).alias("k"), F.coalesce(F.col(source), F.lit("")).alias("source"), words(F.col(text)).alias("tokens"))
    counts = cut(spark, rows.select("k", "source", "tokens"), "counts")
    chosen = cut(spark, plan(spark, counts, **target), "plan")
    if chosen.count() <= BROADCAST_ROWS:  # at most 4096 rows a source
        chosen = F.broadcast(chosen)
    met = rows.withColumn("block", block_of(F.col("k"))).join(chosen, ["source", "block"])
    extra = (F.col("takes") == "all") | ((F.col("takes") == "some") & (order_of(F.col("passes"), F.col("k")) <= F.col("last")))
    times = F.col("passes") + F.when(extra, 1).otherwise(0)
    dealt = met.where(times > 0).withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
    position = (F.col("pass") * F.col("source_tokens") + F.when(F.col("pass") == F.col("passes"), F.col("before")).otherwise(0)) / F.col("budget")
    return dealt.select("row", "source", F.col("tokens").alias("n_tokens"), "weight", "pass", position.alias("position"))


def mixture_table(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """What the query returns: doc_id, source, n_tokens, pass, weight (6 places)."""
    return mix(spark, docs, **options).select(F.col("row.doc_id").alias("doc_id"), "source", "n_tokens", "pass", F.round("weight", 6).alias("weight"))


#: Shared by the SQL forms: counts, the exponent by 40 halvings, budgets, permuted blocks. ``{max_repeat}`` is put in.
SQL = r"""
WITH RECURSIVE counts AS (
  SELECT doc_id, COALESCE(CAST(doc_id AS VARCHAR), '') AS k, COALESCE(source, '') AS source,
         COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS tokens
  FROM documents),
blocks AS (SELECT source, substr(md5(k), 1, 3) AS block, CAST(SUM(tokens) AS BIGINT) AS tokens FROM counts GROUP BY ALL),
sources AS (SELECT source, CAST(SUM(tokens) AS BIGINT) AS tokens, ln(SUM(tokens) / (SELECT CAST(SUM(tokens) AS DOUBLE) FROM blocks)) AS lp FROM blocks GROUP BY source HAVING SUM(tokens) > 0),
bisect AS (
  SELECT 0 AS step, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS width
  UNION ALL
  SELECT step + 1,
         CASE WHEN (SELECT MAX(exp((lo + width / 2 - 1) * lp)) / SUM(exp((lo + width / 2) * lp)) FROM sources) <= {max_repeat} THEN lo ELSE lo + width / 2 END,
         width / 2
  FROM bisect WHERE step < 40),
alpha AS (
  SELECT CASE WHEN (SELECT MAX(exp(-lp)) / COUNT(*) FROM sources) <= {max_repeat} THEN 0 ELSE lo + width END AS a FROM bisect WHERE step = 40),
dealt AS (
  SELECT source, tokens AS source_tokens, exp(a * lp) / SUM(exp(a * lp)) OVER () AS weight,
         CAST(round(exp(a * lp) / SUM(exp(a * lp)) OVER () * SUM(tokens) OVER ()) AS BIGINT) AS budget
  FROM sources, alpha),
passed AS (SELECT *, budget // source_tokens AS passes, budget - (budget // source_tokens) * source_tokens AS rest FROM dealt),
placed AS (
  SELECT b.source, block, tokens, weight, passes, rest,
         SUM(tokens) OVER (PARTITION BY b.source ORDER BY md5(passes || ':' || b.source || ':' || block), block ROWS UNBOUNDED PRECEDING) AS upto
  FROM blocks b JOIN passed p ON b.source = p.source),
ordered AS (
  SELECT c.doc_id, c.source, c.tokens, p.weight, p.passes, p.rest, p.upto AS block_upto, p.upto - p.tokens AS block_before,
         SUM(c.tokens) OVER (PARTITION BY c.source, p.block ORDER BY md5(passes || ':' || k) RANGE UNBOUNDED PRECEDING) AS inside
  FROM counts c JOIN placed p ON c.source = p.source AND substr(md5(c.k), 1, 3) = p.block),
times AS (
  SELECT *, passes + CASE WHEN block_upto <= rest OR (block_before < rest AND block_before + inside <= rest) THEN 1 ELSE 0 END AS n FROM ordered)
SELECT doc_id, source, tokens AS n_tokens, unnest(range(n)) AS pass, round(weight, 6) AS weight FROM times
"""
