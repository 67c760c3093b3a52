"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

Two ways to weights share everything else:

    * ``tempered``: shares p_i ** a / sum of the sources' own token shares p, where a is bisected
      until the shares have the wanted entropy (that of the targets if none is given) and then, if a
      source would need more than its repetition limit, further towards 1 until none does. The
      total is ``part`` of the available tokens (all of them by default) unless another is given.
    * ``plan``: one exponent cannot give every source a share of its own, as targets ask, so the
      mixture goes along the path from p to the targets t, w_i(a) = p_i ** (1 - a) * t_i ** a / sum,
      and bisects a for the largest one at which no source needs more than its limit. Without a
      wanted total, the total is the largest at which the targets themselves (a = 1) keep all limits.

A source's budget is its weight times the total. Its documents are in a fixed random order, by a
hash, in blocks of about ``BLOCK_DOCUMENTS``. Whole passes over the source come first; of the last pass the blocks
that fit are taken whole and the block in which the budget ends is taken document by document
until the next doesn't fit, then one more that closes the gap best.

Scale: token counts come from the corpus encoder; per source only sums over blocks are ordered
(at most ``MOST_BLOCKS`` rows), and document windows stay inside a block, so a hot source spreads over blocks.
Only one row for each target reaches the driver.

Defined results for odd input: documents with a NULL or unlisted source, and those without
tokens, are not used; a listed source without tokens reaches 0 and the other targets are scaled
up; targets with a NULL or no positive share, and limits below 1, count as no target; no target
or no documents: no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.sources import source_name
from tickloom.llm.tokens import token_counts
from tickloom.session import cut_lineage

BLOCK_DOCUMENTS, MOST_BLOCKS = 1024, 65536


def _normal(values: list[float]) -> list[float]:
    total = sum(values)
    return [v / total for v in values]


def entropy(shares: list[float]) -> float:
    return -sum(s * math.log(s) for s in shares if s > 0)


def entropy_exponent(shares: list[float], target: float, rounds: int = 80) -> float:
    """The exponent a in [0, 8] at which shares ** a have the target entropy (entropy falls with a)."""
    low, high = 0.0, 8.0
    for _ in range(rounds):
        middle = (low + high) / 2
        low, high = (middle, high) if entropy(_normal([s**middle for s in shares])) > target else (low, middle)
    return (low + high) / 2


@dataclass(frozen=True)
class Plan:
    exponent: float
    total: float
    budgets: dict[str, float]


def plan(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None, rounds: int = 80) -> Plan:
    """Budgets in tokens from sizes in tokens and (share, limit) of each source."""
    names = sorted(s for s in targets if sizes.get(s, 0) > 0)
    if not names:
        return Plan(1.0, 0.0, {})
    wanted, own = _normal([targets[s][0] for s in names]), _normal([float(sizes[s]) for s in names])
    limit = [float(sizes[s] * targets[s][1]) for s in names]
    weights = lambda a: _normal([p ** (1 - a) * t**a for p, t in zip(own, wanted, strict=True)])
    if total is None:
        total = min(m / w for m, w in zip(limit, wanted, strict=True))
    fits = lambda a: all(w * total <= m * (1 + 1e-12) for w, m in zip(weights(a), limit, strict=True))
    low, high = 0.0, 1.0
    if fits(1.0):
        low = 1.0
    else:
        for _ in range(rounds):
            middle = (low + high) / 2
            low, high = (middle, high) if fits(middle) else (low, middle)
    return Plan(low, total, {s: min(w * total, m) for s, w, m in zip(names, weights(low), limit, strict=True)})


def tempered(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None, goal: float | None = None, part: float = 1.0, rounds: int = 80) -> Plan:
    """Budgets of tempered own shares: the exponent of the entropy ``goal``, or the nearest one to it at which all limits hold."""
    names = sorted(s for s in targets if sizes.get(s, 0) > 0)
    if not names:
        return Plan(1.0, 0.0, {})
    own, limit = _normal([float(sizes[s]) for s in names]), [float(sizes[s] * targets[s][1]) for s in names]
    total = part * sum(sizes[s] for s in names) if total is None else total
    weights = lambda a: _normal([p**a for p in own])
    fits = lambda a: all(w * total <= m * (1 + 1e-12) for w, m in zip(weights(a), limit, strict=True))
    wanted = entropy_exponent(own, entropy(_normal([targets[s][0] for s in names])) if goal is None else goal)
    exponent = wanted
    if not fits(wanted):
        # a = 1 keeps the sources' own shares, which all limits allow up to all available tokens
        far, near = wanted, 1.0
        for _ in range(rounds):
            middle = (far + near) / 2
            far, near = (far, middle) if fits(middle) else (middle, near)
        exponent = near
    return Plan(exponent, total, {s: min(w * total, m) for s, w, m in zip(names, weights(exponent), limit, strict=True)})


def listed_targets(mix_targets: DataFrame) -> dict[str, tuple[float, int]]:
    """The target table, one row for each source, under the spelling of ``source_name``."""
    rows = mix_targets.select(source_name().alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("times"))
    return {r.source: (r.share, r.times) for r in rows.where("source is not null and share > 0 and not isnan(share) and times >= 1").collect()}


def sized_documents(documents: DataFrame, targets: dict[str, tuple[float, int]], **options) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents of listed sources that have tokens."""
    named = documents.where("doc_id is not null").withColumn("source", source_name()).where(F.col("source").isin(*targets) if targets else F.lit(False))
    counts = token_counts(named.select(F.struct("doc_id", "source").alias("key"), "text"), key="key", **options)
    return cut_lineage(counts.where("n_tokens > 0").select("key.doc_id", "key.source", "n_tokens"))


def realise(sized: DataFrame, planned: Plan, seed: int = 7) -> DataFrame:
    """(doc_id, source, n_tokens, uses): how often each document is used."""
    spark = sized.sparkSession
    budgets = spark.createDataFrame(sorted(planned.budgets.items()), "source string, budget double")
    blocks = F.least(F.floor(F.count("*") / BLOCK_DOCUMENTS) + 1, F.lit(MOST_BLOCKS))
    sizes = sized.groupBy("source").agg(F.sum("n_tokens").alias("size"), blocks.alias("blocks"))
    # one row for each listed source: as few as the target table has
    passes = F.broadcast(
        budgets.join(sizes, "source").withColumn("passes", F.floor(F.col("budget") / F.col("size") + 1e-9)).withColumn("rest", F.col("budget") - F.col("passes") * F.col("size"))
    )
    order = F.xxhash64("doc_id", F.lit(seed))
    placed = sized.withColumn("order", order).join(passes, "source").withColumn("block", F.pmod(F.shiftright("order", 40), F.col("blocks")))
    upto = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("inside")).withColumn("before", F.coalesce(F.sum("inside").over(upto), F.lit(0)))
    within = Window.partitionBy("source", "block").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    walked = placed.join(blocks, ["source", "block"]).withColumn("taken", F.col("before") + F.sum("n_tokens").over(within))
    ends = (F.col("before") <= F.col("rest")) & (F.col("before") + F.col("inside") > F.col("rest"))
    fits = F.col("taken") <= F.col("rest")
    whole = Window.partitionBy("source", "block")
    gap = F.col("rest") - F.coalesce(F.max(F.when(fits, F.col("taken"))).over(whole), F.col("before"))
    left = walked.withColumn("fits", fits).withColumn("gap", F.when(ends, gap))
    closing = F.max(F.when(~F.col("fits") & (F.col("n_tokens") <= 2 * F.col("gap")), F.struct(-F.abs(F.col("n_tokens") - F.col("gap")), F.col("doc_id")))).over(whole)
    used = left.withColumn("closing", closing).withColumn("uses", F.col("passes") + (F.col("fits") | F.coalesce(F.col("closing.doc_id") == F.col("doc_id"), F.lit(False))).cast("bigint"))
    return used.where("uses > 0").select("doc_id", "source", "n_tokens", "uses")


def mixture(documents: DataFrame, mix_targets: DataFrame, *, total: float | None = None, seed: int = 7, way=plan, **options) -> tuple[DataFrame, Plan, DataFrame]:
    """(uses of documents, the plan, sized documents); ``way`` is ``plan`` or ``tempered``."""
    targets = listed_targets(mix_targets)
    sized = sized_documents(documents, targets, **options)
    sizes = {r.source: r.size for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("size")).collect()}
    planned = way(sizes, targets, total)
    return realise(sized, planned, seed), planned, sized


def spread(uses: DataFrame, seed: int = 7) -> DataFrame:
    """One row for each use with ``mix_key``, whose order mixes the sources evenly."""
    return uses.select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1).cast("bigint"), "uses")).alias("use_no")).withColumn("mix_key", F.xxhash64("doc_id", "use_no", F.lit(seed + 1)))


def reached(uses: DataFrame, planned: Plan, sized: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """For each target: tokens there, budget, tokens mixed, share reached and its error."""
    spark = uses.sparkSession
    targets = listed_targets(mix_targets)
    wanted = spark.createDataFrame([(s, t, n, planned.budgets.get(s, 0.0), planned.exponent) for s, (t, n) in sorted(targets.items())], "source string, target_share double, max_repeats int, budget double, exponent double")
    there = sized.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"), F.count("*").alias("available_documents"))
    got = uses.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("mixed_tokens"), F.count("*").alias("used_documents"), F.max("uses").alias("most_uses"))
    all_of = F.sum("mixed_tokens").over(Window.partitionBy())
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = wanted.join(there, "source", "left").join(got, "source", "left").select("source", "target_share", "max_repeats", "exponent", "budget", *map(zero, ("available_tokens", "available_documents", "mixed_tokens", "used_documents", "most_uses")))
    # one row for each target, so the window over all of them is small
    return out.withColumn("reached_share", F.col("mixed_tokens") / F.nullif(all_of, F.lit(0))).withColumn("share_error", F.col("reached_share") - F.col("target_share"))
