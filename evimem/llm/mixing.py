"""Mixing sources to target weights: blocks of each source are scheduled fairly, with small sources repeated up to a cap."""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import lcm

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evimem.llm.tokens import token_sizes
from evimem.session import written

#: Tokens of a block, the unit of the schedule, and the longest cycle of blocks that weights may need.
BLOCK, CYCLE = 1024, 20_000
#: Documents that a window over one bucket of a source holds, about.
BUCKET = 20_000


def cycle(weights: list[float]) -> list[int]:
    """Blocks of each source in one cycle of the schedule: exact where the weights have a common denominator up to `CYCLE`, else the nearest."""
    total = sum(Fraction(w).limit_denominator(10**6) for w in weights)
    shares = [Fraction(w).limit_denominator(10**6) / total for w in weights]
    length = lcm(*(s.denominator for s in shares))
    if length > CYCLE:
        length = CYCLE
        floors = [int(s * length) for s in shares]
        for k in sorted(range(len(shares)), key=lambda k: floors[k] - shares[k] * length)[: length - sum(floors)]:
            floors[k] += 1
        return floors
    return [int(s * length) for s in shares]


def fair_schedule(blocks: list[int]) -> list[int]:
    """The source of each slot of a cycle: block k of a source with share w is released at k / w and due by (k + 1) / w; of the
    released blocks the one that is due first goes, ties by position. Every source is less than one block off its share after each slot.
    """
    length = sum(blocks)
    waiting = [(0, -(-length // n), s, 0) for s, n in enumerate(blocks) if n]  # release, deadline, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    out = []
    for slot in range(length):
        while waiting and waiting[0][0] <= slot:
            _, due, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s, k))
        due, s, k = heapq.heappop(ready)
        out.append(s)
        k, n = k + 1, blocks[s]
        if k < n:
            # whole slots: released from the floor of k / w, due by the ceiling of (k + 1) / w
            heapq.heappush(waiting, (k * length // n, -(-(k + 1) * length // n), s, k))
    return out


def plan(available: dict[str, int], targets: list[tuple[str, float, int]], block: int = BLOCK) -> tuple[list[str], list[int], list[int], int]:
    """Sources with texts and a share, their blocks of a cycle, the schedule of a cycle, and the number of slots of the mix.

    Shares are those of the sources that have texts, scaled to add up to 1. The mix is as long as the scarcest source allows: as
    many slots as all sources can fill with their texts repeated as often as they may be.
    """
    chosen = sorted((s, w, r) for s, w, r in targets if s is not None and w and w > 0 and r and r > 0 and available.get(s, 0) > 0)
    if not chosen:
        return [], [], [], 0
    names = [s for s, _, _ in chosen]
    blocks = cycle([w for _, w, _ in chosen])
    order = fair_schedule(blocks)
    caps = [available[s] * r // block for s, _, r in chosen]
    full = min((c // n for c, n in zip(caps, blocks, strict=True) if n), default=0)
    left = [c - full * n for c, n in zip(caps, blocks, strict=True)]
    slots = full * len(order)
    for s in order:
        if not left[s]:
            break
        left[s] -= 1
        slots += 1
    return names, blocks, order, slots


def sized(df: DataFrame, key: str, text: str, source: str, file: str | None = None) -> DataFrame:
    """`key, source, n_tokens` of each different text with tokens, under its smallest key that has a source."""
    rows = df.where(F.col(source).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(source).alias("source"), F.md5(text).alias("digest"), F.col(text).alias("text"))
    sizes = token_sizes(rows, ["key", "source", "digest"], "text", file).where("n_tokens > 0")
    return sizes.groupBy("digest").agg(F.min(F.struct("key", "source", "n_tokens")).alias("x")).select("x.*")


def mixed(df: DataFrame, targets: DataFrame, key: str, text: str, source: str, file: str | None = None, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The mix (`key, source, copy, n_tokens, slot, place`: ordered by slot, then place) and the report of shares reached.

    Each source's texts follow each other in an order of hashes, pass after pass; where a text begins decides its block, and the
    block's slot follows from the schedule of one cycle. Sums up to each text are taken in buckets of the hash order, so no task
    holds a source. The report has the target, the share scaled to the sources with texts, the share of the schedule (which differs where the weights
    need a cycle of more than `CYCLE` blocks) and the actual one. Targets are a small fixed table; a source listed twice counts as the last in order. Texts that are null, empty or without
    source, and sources without target, are not used; the same text under several keys counts as one.
    """
    spark = df.sparkSession
    sizes = written(sized(df, key, text, source, file), "sized")
    listed = [(r[0], float(r[1] or 0), int(r[2] or 0)) for r in targets.select("source", "target_share", "max_repeats").orderBy("source", "target_share").collect()]
    listed = list({s: (s, w, r) for s, w, r in listed if s is not None}.values())
    mine = sizes.where(F.col("source").isin([s for s, _, _ in listed]))
    totals = {r[0]: (r[1], r[2]) for r in mine.groupBy("source").agg(F.sum("n_tokens"), F.count("*")).collect()}
    names, blocks, order, slots = plan({s: t for s, (t, _) in totals.items()}, listed, block)
    turns = [[] for _ in names]
    for slot, s in enumerate(order):
        turns[s].append(slot)
    whole, rest = divmod(slots, len(order)) if order else (0, 0)
    quota = {s: (whole * n + sum(t < rest for t in at)) * block for s, n, at in zip(names, blocks, turns, strict=True)}
    # one row a source, the slots of a cycle in it: at most CYCLE numbers in all
    side = spark.createDataFrame([(s, totals[s][0], quota[s], n, at) for s, n, at in zip(names, blocks, turns, strict=True)], "source string, total bigint, quota bigint, blocks int, turns array<int>")

    buckets = max(1, sum(n for _, n in totals.values()) // BUCKET)
    placed = mine.select("key", "source", "n_tokens", F.xxhash64("key").alias("h")).withColumn("bucket", F.pmod(F.shiftright("h", 20), F.lit(buckets)))
    sums = placed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("source", "bucket", (F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")).alias("base"))
    within = F.sum("n_tokens").over(Window.partitionBy("source", "bucket").orderBy("h", "key").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    begun = placed.withColumn("within", within).join(before, ["source", "bucket"]).join(F.broadcast(side), "source").withColumn("at", F.col("base") + F.col("within"))
    passes = F.ceil((F.col("quota") - F.col("at")) / F.col("total")).cast("int")
    copies = begun.where("at < quota").withColumn("copy", F.explode(F.sequence(F.lit(0), passes - 1)))
    start = F.col("at") + F.col("copy") * F.col("total")
    number = F.floor(start / F.lit(block))
    slot = F.floor(number / F.col("blocks")) * F.lit(len(order) or 1) + F.element_at("turns", (number % F.col("blocks") + 1).cast("int"))
    out = copies.select(F.col("key").alias(key), "source", "copy", "n_tokens", slot.cast("bigint").alias("slot"), start.alias("place"))

    used = out.groupBy("source").agg(F.sum("n_tokens").alias("tokens_used"), F.count("*").alias("texts_used"), (F.max("copy") + 1).alias("most_copies"))
    wanted = sum(w for s, w, _ in listed if s in quota) or 1.0
    scheduled = {s: n / len(order) for s, n in zip(names, blocks, strict=True)}
    facts = spark.createDataFrame([(s, w, w / wanted if s in quota else 0.0, scheduled.get(s, 0.0), r, *totals.get(s, (0, 0))[::-1]) for s, w, r in listed], "source string, target_share double, scaled_share double, scheduled_share double, max_repeats int, texts bigint, tokens bigint")
    report = facts.join(used, "source", "left").fillna(0, ["tokens_used", "texts_used", "most_copies"])
    report = report.withColumn("actual_share", F.coalesce(F.try_divide(F.col("tokens_used"), F.sum("tokens_used").over(Window.partitionBy())), F.lit(0.0)))
    return out, report
