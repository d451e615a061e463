"""Upkeep of a store: work queues, lifecycle, repair proposals, budgets, the role gate, fusion with semantic ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evimem.functions.numbers import days_between, r6, share

# Kinds that never cool by age, days until a record cools and is archived, words that need a context.
DURABLE_KINDS = ("identity", "preference", "decision", "prospective", "procedure")
COLD_DAYS, ARCHIVE_DAYS = 90, 180
CONTEXTLESS = r"\b(?:this|that|it|these|those|the same|this one|that one)\b"
#: Constant of the reciprocal rank in fusion, and the least similarity that counts.
RANK_K, FLOOR = 60, 0.0


def work_queue(rows: DataFrame, at: str, key: str, due: Column, most: int) -> DataFrame:
    """The rows to be worked on next: of the `most` newest those that are due, or, if none of them is, the oldest that are due.

    So fresh rows that are not yet due never keep older ones from being worked on. Both windows are top-k reports.
    """
    newest = rows.orderBy(F.desc(at), key).limit(most).where(due)
    oldest = rows.where(due).orderBy(at, key).limit(most)
    # at most `most` rows a side
    return newest.unionByName(oldest.join(F.broadcast(newest.agg(F.count("*").alias("_n"))).where("_n = 0"), how="inner").drop("_n"))


def lifecycle(memories: DataFrame, now: Column) -> DataFrame:
    """`id, state, proposed`: live records of low value that would cool, or cold ones that would be archived, by the days since they last helped or changed.

    Pinned, protected and durable kinds of records, and those with a helpful history, stay as they are.
    """
    idle = days_between(now, F.coalesce(F.greatest("last_used_at", "last_helpful_at", "updated_at"), F.col("updated_at")))
    free = ~F.coalesce("pinned", F.lit(False)) & ~F.coalesce("protected", F.lit(False)) & ~F.col("kind").isin(*DURABLE_KINDS) & (F.coalesce(F.col("helpful_count") + F.col("validated_count"), F.lit(0)) < 3)
    proposed = F.when((F.col("state") == "active") & (idle >= COLD_DAYS), "cold").when((F.col("state") == "cold") & (idle >= ARCHIVE_DAYS), "archived")
    return memories.select("id", "state", F.when(free, proposed).alias("proposed")).where("proposed is not null")


def repair_proposals(memories: DataFrame, most: int = 1000) -> DataFrame:
    """`id, score, missing`: of the `most` least complete live records those that are ambiguous outside their context, with what they lack.

    That is a record that depends on its context and is less than .75 complete, or one that stands alone, names nothing and points at something.
    """
    live = memories.where(F.col("state").isin("active", "cold")).orderBy(F.asc_nulls_first("metadata_completeness"), "updated_at", "id").limit(most)
    complete = F.coalesce("metadata_completeness", F.lit(0.0))
    bare = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    sourceless = F.trim(F.coalesce("source_context", F.lit(""))) == ""
    partial = (F.col("context_mode") == "context_dependent") & (complete < 0.75)
    pointing = (F.col("context_mode") == "standalone") & sourceless & bare("entities") & F.coalesce(F.col("content"), F.lit("")).rlike("(?i)" + CONTEXTLESS)
    missing = F.array_compact(F.array(F.when(bare("scope"), "scope"), F.when(bare("entities"), "entities"), F.when(sourceless, "source context"), F.when(bare("preconditions"), "preconditions")))
    return live.where(partial | pointing).select("id", r6(F.greatest(F.lit(0.25), 1 - complete)).alias("score"), F.array_join(missing, ", ").alias("missing"))


def budgets(uses: DataFrame, task: str, mode: str, budget: int, least: int = 8, times: str | None = None) -> DataFrame:
    """The token budget that resolved uses (`outcome, tokens`) suggest for each task and mode: less where all were ignored, more where helpful ones were full.

    A task and mode with `least` resolved uses decides by itself, else the mode with twice as many, else the budget stays. All ignored: 15 % less; half
    or more helpful and nine tenths of the budget filled on the mean: 10 % more (our choice). Pending and withheld uses never count.
    A row may stand for several equal uses (`times`).
    """
    n_of = F.col(times) if times else F.lit(1)
    seen = uses.where(~F.col("outcome").isin("pending", "withheld"))
    facts = lambda by, tag: seen.groupBy(*by).agg(F.sum(n_of).alias(f"n{tag}"), F.sum(F.when(F.col("outcome") == "ignored", n_of).otherwise(0)).alias(f"ignored{tag}"), F.sum(F.when(F.col("outcome").isin("helpful", "validated"), n_of).otherwise(0)).alias(f"good{tag}"), F.sum(F.col("tokens") * n_of).alias(f"tokens{tag}"))
    # there are few modes
    both = facts([task, mode], "").join(F.broadcast(facts([mode], "_m")), mode)

    def change(tag: str) -> Column:
        n = F.col(f"n{tag}")
        return F.when(F.col(f"ignored{tag}") == n, round(budget * 0.85)).when((F.col(f"good{tag}") * 2 >= n) & (F.col(f"tokens{tag}") >= 0.9 * budget * n), round(budget * 1.1)).otherwise(budget)

    own, wide = F.col("n") >= least, F.col("n_m") >= 2 * least
    return both.select(task, mode, F.col("n").alias("samples"), r6(share(F.col("ignored"), F.col("n"))).alias("ignored_share"), F.when(own, "task_mode").when(wide, "mode").otherwise("none").alias("scope"), F.when(own, change("")).when(wide, change("_m")).otherwise(budget).alias("budget"))


def role_gate(rows: DataFrame) -> DataFrame:
    """`rows` (`role, lexical, phrase, graph, currentness, support, technical`) with whether their `role` lets them in (`admitted`).

    A reference needs direct support (words, context, or a technical word of the query) and cannot come by the graph alone; an event must be
    current or asked for; claims wait for a review; all others pass.
    """
    words = F.greatest("lexical", "phrase")
    direct = (words >= 0.22) | (F.col("support") > 0) | F.col("technical")
    by_graph = (F.col("graph") > 0) & (words < 0.10) & (F.col("support") <= 0)
    return rows.withColumn("admitted", F.when(F.col("role") == "reference", direct & ~by_graph).when(F.col("role") == "event", (F.col("currentness") >= 0.35) | (words >= 0.30)).otherwise(F.col("role") != "claim"))


def fused(results: DataFrame, semantic: DataFrame, unseen: DataFrame, weight: float) -> DataFrame:
    """`query_id, id, score, fusion`: results lifted by their semantic rank, and eligible records found by it alone.

    semantic: `query_id, id, rank` (from 0) and `similarity`, of which only those above the floor count. unseen: scores (`query_id, id, score`) of
    eligible records that are no results yet. A bonus is weight / (60 + rank + 1); scores stay at 1 at most.
    """
    near = semantic.where(F.col("similarity") > FLOOR).select("query_id", "id", (weight / (RANK_K + F.col("rank") + 1)).alias("bonus"))
    kept = results.select("query_id", "id", "score").join(near, ["query_id", "id"], "left")
    new = unseen.select("query_id", "id", "score").join(results.select("query_id", "id"), ["query_id", "id"], "left_anti").join(near, ["query_id", "id"])
    return kept.unionByName(new).select("query_id", "id", r6(F.least(F.lit(1.0), F.col("score") + F.coalesce("bonus", F.lit(0.0)))).alias("score"), r6(F.coalesce("bonus", F.lit(0.0))).alias("fusion"))
