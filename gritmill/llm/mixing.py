"""Mixing sources to target weights, by Sainte-Lague apportionment of equal-token blocks.

1. Documents are counted in tokens of a public vocabulary. The largest mixture that meets all shares is bounded by the
   source that runs out first at its capped number of repeats; it is cut into seats of BLOCK tokens.
2. Seats go to sources by the highest quotients share / (2 k + 1); no source gets more than its tokens times its cap.
   The result of that many single rounds is found at once, by the multiplier at which the rounded shares add up.
3. Each source is cut into shards of its own, hash classes of documents of about SHARD_TOKENS tokens, so no source is ever
   ordered in one task and none has shards smaller than its size gives. Its seats go to the shards by highest quotients
   too, in SQL: bounds of the multiplier leave about two quotients a shard to be ranked. Only sums of whole sources come to
   the driver.
4. In a shard documents stand in a seeded order, cut into blocks by their running token count. Every block is used as often
   as the seats allow for all, and the first ones once more; a document counts to the block in which its middle stands.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritmill.llm.tokens import token_counts
from gritmill.session import materialise

BLOCK = 256
SHARD_TOKENS = 50_000_000
SEED = 17


def source_name(c: Column) -> Column:
    """Sources are spelt alike but for case, blanks around, and hyphens for underscores."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), "-", "_")


def apportion(weights: dict, seats: int, caps: dict | None = None) -> dict:
    """Sainte-Lague: integer seats that add up to `seats`, or to the sum of the caps if that is less. Ties go to the first key in order."""
    keys = sorted(k for k, w in weights.items() if w > 0)
    top = {k: seats if caps is None else min(seats, caps[k]) for k in keys}
    seats = min(seats, sum(top.values()))
    if not keys or seats <= 0:
        return {k: 0 for k in weights}

    def at(x: float) -> dict:
        return {k: min(top[k], math.floor(weights[k] * x + 0.5)) for k in keys}

    low, high = 0.0, 1.0
    while sum(at(high).values()) <= seats and high < 1e300 and any(v < top[k] for k, v in at(high).items()):
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if sum(at(mid).values()) <= seats:
            low = mid
        else:
            high = mid
    got = at(low)
    heap = [(-weights[k] / (2 * got[k] + 1), k) for k in keys if got[k] < top[k]]
    heapq.heapify(heap)
    for _ in range(seats - sum(got.values())):
        _, k = heapq.heappop(heap)
        got[k] += 1
        if got[k] < top[k]:
            heapq.heappush(heap, (-weights[k] / (2 * got[k] + 1), k))
    return {k: got.get(k, 0) for k in weights}


def plan(targets: dict[str, tuple[float, int]], have: dict[str, int], block: int = BLOCK, total_tokens: int | None = None) -> dict[str, int]:
    """Seats of each source. `targets`: share and cap of each source; `have`: its tokens.

    Shares of sources without tokens fall to the others in proportion. `total_tokens` asks for a smaller mixture.
    """
    weights = {s: targets[s][0] for s in targets if targets[s][0] > 0 and have.get(s, 0) > 0 and targets[s][1] > 0}
    if not weights:
        return {}
    caps = {s: have[s] * targets[s][1] // block for s in weights}
    most = min(have[s] * targets[s][1] * sum(weights.values()) / weights[s] for s in weights)
    seats = int(min(most, total_tokens if total_tokens is not None else most)) // block
    return apportion(weights, seats, caps)


def shard_seats(shards: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(source, shard, shard_total, seats, cap)``: Sainte-Lague of each source's seats over its shards.

    `shards` has ``(source, shard, shard_total)`` and of the source ``(q, cap)``. With n shards of T tokens together
    the multiplier lies between (q - n / 2) / T and, but for shards far below the mean, (q + n) / T: the seats that the
    lower bound gives are certain, and the quotients up to the upper one are ranked, about two a shard. A shard has at
    most its tokens times the cap.
    """
    whole = Window.partitionBy("source")
    s = shards.withColumn("t", F.sum("shard_total").over(whole)).withColumn("n", F.count("*").over(whole))
    s = s.withColumn("top", F.ceil(F.col("shard_total") * F.col("cap") / block))
    s = s.withColumn("base", F.expr("least(top, greatest(0, floor(shard_total * (q - n / 2) / t + 0.5D)))"))
    s = s.withColumn("high", F.expr("least(top, greatest(floor(shard_total * (q + n) / t + 0.5D) + 1, ceil(shard_total * q / t)))"))
    s = s.withColumn("left", F.col("q") - F.sum("base").over(whole))
    seat = s.where("high > base").withColumn("seat", F.explode(F.expr("sequence(base, high - 1)")))
    ranked = Window.partitionBy("source").orderBy(F.desc(F.col("shard_total") / (2 * F.col("seat") + 1)), "shard")
    won = seat.withColumn("place", F.row_number().over(ranked)).where("place <= left").groupBy("source", "shard").agg(F.count("*").alias("won"))
    out = s.join(won, ["source", "shard"], "left").withColumn("seats", F.col("base") + F.coalesce("won", F.lit(0)))
    return out.select("source", "shard", "shard_total", "seats", "cap").where("seats > 0")


def mix(docs: DataFrame, targets: DataFrame, path: str | None = None, block: int = BLOCK, shard_tokens: int = SHARD_TOKENS, seed: int = SEED, total_tokens: int | None = None) -> DataFrame:
    """``(doc_id, source, n_tokens, repeats)`` of the chosen documents, repeats from 1 to the source's cap.

    Documents without tokens, without a source or of a source that is not listed are never chosen; a listed source
    without documents gets nothing. A null share or cap counts as 0. Rows that repeat a document are documents of
    their own. Empty tables give no rows. The choice depends on ids, tokens and `seed` alone, not on the order of rows.
    """
    spark = docs.sparkSession
    listed = {}
    for r in targets.select(source_name(F.col("source")).alias("s"), "target_share", "max_repeat").collect():  # one row a source
        if r.s is not None:
            listed[r.s] = (r.target_share or 0.0, r.max_repeat or 0)
    named = docs.select("doc_id", "text", source_name(F.col("source")).alias("source")).where(F.col("source").isin(*listed) if listed else F.lit(False))
    sizes = materialise(token_counts(named, path, keep=["source"]).where("n_tokens > 0"), "mixing-sizes")
    have = {r.source: r.n for r in sizes.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}  # one row a listed source
    of = [(s, q, listed[s][1], max(1, math.ceil(have[s] / shard_tokens))) for s, q in plan(listed, have, block, total_tokens).items() if q]
    of = F.broadcast(spark.createDataFrame(of, "source string, q bigint, cap int, n_shards bigint"))  # one row a listed source
    order = F.xxhash64(F.lit(seed), "doc_id")
    sizes = sizes.join(of, "source").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), "n_shards").cast("int"))
    quota = shard_seats(sizes.groupBy("source", "shard", "q", "cap").agg(F.sum("n_tokens").alias("shard_total")), block)
    sizes = sizes.drop("q", "cap", "n_shards")
    w = Window.partitionBy("source", "shard").orderBy(order, "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.join(quota, ["source", "shard"]).withColumn("middle", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)) + F.col("n_tokens") / 2)
    wanted = F.col("seats") * F.lit(block)
    rounds = F.floor(wanted / F.col("shard_total"))
    repeats = F.least(rounds + (F.col("middle") < wanted - rounds * F.col("shard_total")).cast("int"), F.col("cap")).cast("int")
    return placed.select("doc_id", "source", "n_tokens", repeats.alias("repeats")).where("repeats > 0")


def mix_shares(docs: DataFrame, targets: DataFrame, **how) -> DataFrame:
    """``(source, target_share, max_repeat, n_docs, n_tokens, most_repeats, actual_share)`` for every listed source."""
    chosen = mix(docs, targets, **how).groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("n_tokens"), F.max("repeats").alias("most_repeats"))
    t = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeat")
    out = t.join(chosen, "source", "left").na.fill(0, ["n_docs", "n_tokens", "most_repeats"])
    total = F.sum("n_tokens").over(Window.partitionBy())  # one row a source
    return out.withColumn("actual_share", F.when(total > 0, F.round(F.col("n_tokens") / total, 6)).otherwise(F.lit(0.0)))
