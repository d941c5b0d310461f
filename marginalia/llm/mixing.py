"""Problem 6: a mixture of sources with target shares of its tokens.

Quotas come from Sainte-Laguë apportionment of equal-token blocks, first to sources and then to the shards of a source.
Both work on counts of bounded length (targets, targets x SHARDS); the documents themselves stay in Spark.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks that the whole mixture is divided into: shares come out in steps of 1 / BLOCKS.
BLOCKS = 10_000
#: Most shards of a source, and the tokens from which on a source gets another shard.
SHARDS, SHARD_TOKENS = 256, 400_000


def source_key(source: Column) -> Column:
    """Spelling of a source that all its variants share; null and blank ones have none."""
    plain = F.translate(F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", "")), "-", "_")
    return F.when(plain != "", plain)


def sainte_lague(weights: dict, seats: int, most: dict) -> dict:
    """``seats`` given one by one to the highest quotient weight / (2 x seats so far + 1); ties to the smaller key.

    A key that has ``most[key]`` seats takes no more. Seats that nobody can take stay free.
    """
    got = dict.fromkeys(weights, 0)
    heap = [(-float(w), key) for key, w in weights.items() if w > 0 and most[key] > 0]
    heapq.heapify(heap)
    while heap and seats > 0:
        _, key = heapq.heappop(heap)
        got[key] += 1
        seats -= 1
        if got[key] < most[key]:
            heapq.heappush(heap, (-float(weights[key]) / (2 * got[key] + 1), key))
    return got


def mix(items: DataFrame, targets: DataFrame, seed: int = 0, blocks: int = BLOCKS) -> tuple[DataFrame, DataFrame]:
    """Uses of ``items`` (id, source, tokens) for a mixture as large as all items, and the report on it.

    ``targets`` (source, target_share, max_uses; a few rows): rows without source or share are ignored, repeated ones add
    their shares and take the larger cap, a missing cap counts as 1. Items of other sources, or none, count towards the
    size of the mixture only. A source whose items don't suffice gives all it may; what it leaves stays open, so that the
    others keep their targets.

    Uses: id, source, tokens, uses (0 for items left out). Report: source, target_share, reached_share (of the size of all
    items), mixture_share (of what was mixed), target_tokens, mixed_tokens, available_tokens, max_uses, short (not even all
    allowed uses reach the target). ``items`` is read several times, so it should be settled.
    """
    spark = items.sparkSession
    wanted = (
        targets.select(source_key(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.coalesce(F.col("max_uses"), F.lit(1)).alias("uses"))
        .filter("source is not null and share is not null")
        .groupBy("source").agg(F.sum("share").alias("share"), F.max("uses").alias("uses"))
    )
    goal = {r["source"]: (r["share"], max(0, r["uses"])) for r in wanted.collect()}
    keyed = items.select("id", source_key(F.col("source")).alias("source"), F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"))
    sharded = keyed.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(SHARDS)).cast("int"))
    wide = sharded.groupBy(F.when(F.col("source").isin(*goal), F.col("source")).alias("source"), "shard").agg(F.sum("tokens").alias("tokens"))
    sums = {(r["source"], r["shard"]): r["tokens"] for r in wide.collect()}  # at most (targets + 1) x SHARDS rows
    total = sum(sums.values())
    has = {s: sum(n for (source, _), n in sums.items() if source == s) for s in goal}
    block = max(1.0, total / blocks)
    shares = {s: share for s, (share, _) in goal.items()}
    quotas = sainte_lague(shares, round(blocks * sum(x for x in shares.values() if x > 0)), dict.fromkeys(shares, 2 * blocks))
    rows = []
    for s, (share, uses) in sorted(goal.items()):
        shards = max(1, min(SHARDS, -(-has[s] // SHARD_TOKENS)))
        of = {k: 0 for k in range(shards)}
        for (source, k), n in sums.items():
            if source == s:
                of[k % shards] += n
        passes, rest = divmod(quotas[s] * block, has[s]) if has[s] else (0, 0.0)
        full = passes >= uses
        part = sainte_lague(of, 0 if full else round(rest / block), {k: -(-n // block) for k, n in of.items()})
        short = has[s] * uses < share * total
        for k in of:
            rows.append((s, k, shards, int(min(passes, uses)) if not short else uses, 0.0 if short else part[k] * block, share, share * total, int(uses), short))
    columns = "source string, shard int, shards int, passes int, quota double, target_share double, target_tokens double, max_uses int, short boolean"
    quota = F.broadcast(spark.createDataFrame(rows, columns))  # at most targets x SHARDS rows
    counts = F.broadcast(quota.select("source", "shards").distinct())
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "id"), "id").rowsBetween(Window.unboundedPreceding, -1)
    chosen = (
        sharded.join(counts, "source").withColumn("shard", F.col("shard") % F.col("shards")).drop("shards")
        .join(quota, ["source", "shard"])
        .withColumn("_middle", F.coalesce(F.sum("tokens").over(order), F.lit(0)) + F.col("tokens") / 2)
        .withColumn("uses", F.col("passes") + F.when(F.col("_middle") < F.col("quota"), 1).otherwise(0))
    )
    uses = chosen.select("id", "source", "tokens", "uses")
    reached = uses.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("mixed_tokens"), F.sum("tokens").alias("available_tokens"))
    report = (
        quota.select("source", "target_share", "target_tokens", "max_uses", "short").distinct()
        .join(reached, "source", "left")
        .fillna(0, ["mixed_tokens", "available_tokens"])
        .withColumn("reached_share", F.try_divide(F.col("mixed_tokens"), F.lit(total)))
        .withColumn("mixture_share", F.try_divide(F.col("mixed_tokens"), F.sum("mixed_tokens").over(Window.partitionBy())))  # a row for each source
        .select("source", "target_share", "reached_share", "mixture_share", "target_tokens", "mixed_tokens", "available_tokens", "max_uses", "short")
    )
    return uses, report
