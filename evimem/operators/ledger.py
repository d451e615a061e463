"""Analytics over outcome ledgers: usage records, counters, daily metrics, feedback, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evimem.functions.numbers import clamp, days_between, r6, share, wilson
from evimem.operators.quantiles import exact_quantiles

# Outcomes that speak for and against a memory.
POSITIVE, NEGATIVE = ("helpful", "validated"), ("harmful", "corrected")


def delivered_once(usage: DataFrame, *columns: str) -> DataFrame:
    """Usage records with one row per usage_id: the one resolved last (then created last) stands; rows without id are dropped.

    Only `columns` (all without any) are read and shuffled.
    """
    order = F.struct(F.coalesce("resolved_at", F.lit("0001-01-01").cast("timestamp_ntz")), "created_at")
    cols = [c for c in columns or usage.columns if c != "usage_id"]
    return usage.where("usage_id is not null").groupBy("usage_id").agg(F.max_by(F.struct(*cols), order).alias("v")).select("usage_id", "v.*")


def outcome_funnel(usage: DataFrame, by: str) -> DataFrame:
    """Conditional counts of one group: offered, selected, used, positive, negative, unresolved."""
    return usage.groupBy(by).agg(
        F.count("*").alias("offered"),
        F.count_if("selected").alias("selected"),
        F.count_if("used").alias("used"),
        F.count_if(F.col("outcome").isin(*POSITIVE)).alias("positive"),
        F.count_if(F.col("outcome").isin(*NEGATIVE)).alias("negative"),
        F.count_if(F.col("resolved_at").isNull()).alias("unresolved"),
    )


def relation_histogram(edges: DataFrame) -> DataFrame:
    """Edges by relation with their mean weight (null weights do not count)."""
    return edges.groupBy("relation").agg(F.count("*").alias("n"), F.count("weight").alias("weighted"), r6(F.avg("weight")).alias("avg_weight"), F.sum("evidence_count").alias("evidence"))


def daily_outcomes(usage: DataFrame) -> DataFrame:
    """Counts by day and outcome."""
    return usage.groupBy(F.to_date("created_at").alias("day"), "outcome").agg(F.count("*").alias("n"))


def task_rollup(usage: DataFrame, memories: DataFrame) -> DataFrame:
    """Per task: distinct memories, used ones, outcomes in order, mean age in days of the memories at the task's start."""
    ages = memories.select(F.col("id").alias("memory_id"), F.col("created_at").alias("born"))
    joined = usage.join(ages, "memory_id", "left")
    return joined.groupBy("task_id").agg(
        F.count_distinct("memory_id").alias("memories"),
        F.count_distinct(F.when(F.col("used"), F.col("memory_id"))).alias("used_memories"),
        F.concat_ws(",", F.array_sort(F.collect_set("outcome"))).alias("outcomes"),
        r6(F.avg(days_between(F.col("created_at"), F.col("born")))).alias("avg_age_days"),
    )


def daily_metrics(runs: DataFrame) -> DataFrame:
    """Daily rollup of benchmark runs: tasks, labelled ones, accuracy over labels, mean times; shares are null without a denominator."""
    ok = lambda c: F.when(~F.isnan(c) & (F.col(c) >= 0), F.col(c))
    return runs.groupBy(F.to_date("run_at").alias("day")).agg(
        F.count("*").alias("runs"),
        F.count("answer").alias("answered"),
        r6(share(F.count_if("correct"), F.count("answer"))).alias("accuracy"),
        r6(F.avg(ok("agent_ttft_ms"))).alias("avg_ttft_ms"),
        r6(share(F.count_if("answer_available_in_context"), F.count("*"))).alias("available_share"),
    )


def arm_statistics(runs: DataFrame, arm: str, least: int = 8) -> DataFrame:
    """Arms of an experiment: share of correct runs with its Wilson interval; ready when every arm has `least` runs."""
    n, k = F.col("runs"), F.col("correct_runs")
    low, high = wilson(k, n)
    sums = runs.groupBy(arm).agg(F.count("*").alias("runs"), F.count_if("correct").alias("correct_runs"))
    ready = F.min("runs").over(Window.partitionBy()) >= least
    return sums.select(arm, "runs", "correct_runs", r6(k / n).alias("share"), r6(low).alias("low"), r6(high).alias("high"), ready.alias("ready"))


def counter_inventory(memories: DataFrame, counters: list[str]) -> DataFrame:
    """One row a counter: its total and how many memories have any (one aggregation, then unpivoted)."""
    sums = memories.agg(*[F.sum(c).alias(f"{c}_sum") for c in counters], *[F.count_if(F.col(c) > 0).alias(f"{c}_some") for c in counters])
    rows = F.array(*[F.struct(F.lit(c).alias("counter"), F.coalesce(f"{c}_sum", F.lit(0)).alias("total"), F.col(f"{c}_some").alias("memories")) for c in counters])
    return sums.select(F.inline(rows))


def counter_separation(memories: DataFrame) -> DataFrame:
    """Used against offered by state."""
    return memories.groupBy("state").agg(F.sum("retrieved_count").alias("retrieved"), F.sum("used_count").alias("used"), F.count_if((F.col("retrieved_count") > 0) & (F.col("used_count") == 0)).alias("never_used"), r6(share(F.sum("used_count"), F.sum("retrieved_count"))).alias("used_share"))


def use_buckets(memories: DataFrame, least: int = 5) -> DataFrame:
    """Memories offered `least` times or more by the share of offers that were used: 0, below a quarter, below half, half or more."""
    rate = F.col("used_count") / F.col("retrieved_count")
    bucket = F.when(F.col("used_count") == 0, "0").when(rate < 0.25, "<.25").when(rate < 0.5, "<.5").otherwise(">=.5")
    return memories.where(F.col("retrieved_count") >= least).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("memories"), r6(F.avg("helpful_count")).alias("avg_helpful"))


def never_retrieved(memories: DataFrame, by: str) -> DataFrame:
    return memories.groupBy(by).agg(F.count("*").alias("memories"), F.count_if(F.coalesce("retrieved_count", F.lit(0)) == 0).alias("never_retrieved"))


def lifecycle_histogram(memories: DataFrame) -> DataFrame:
    return memories.groupBy("state").agg(F.count("*").alias("n"), *[F.count_if(c).alias(c) for c in ("pinned", "protected", "dirty", "stranded")], F.count("supersedes_id").alias("superseding"))


def staleness(memories: DataFrame, versions: DataFrame, slop_s: int = 3600) -> DataFrame:
    """Memories whose source was recorded anew later than they were observed, by more than `slop_s` seconds; per source type."""
    latest = versions.groupBy("memory_id").agg(F.max("system_from").alias("recorded"))
    late = F.unix_micros(F.col("recorded").cast("timestamp")) > F.unix_micros(F.col("observed_at").cast("timestamp")) + slop_s * 1_000_000
    return memories.join(latest, memories["id"] == latest["memory_id"], "left").groupBy("source_type").agg(F.count("*").alias("memories"), F.count("recorded").alias("with_source"), F.count_if(late).alias("stale"))


def context_feedback(usage: DataFrame, keys: list[str]) -> DataFrame:
    """Smoothed usefulness of each memory in its context from resolved outcomes; pending and withheld ones do not count."""
    seen = usage.where(~F.col("outcome").isin("pending", "withheld"))
    n, p, g, u, i = (F.col(c) for c in ("observations", "positive", "negative", "used", "ignored"))
    sums = seen.groupBy(*keys).agg(F.count("*").alias("observations"), F.count_if(F.col("outcome").isin(*POSITIVE)).alias("positive"), F.count_if(F.col("outcome").isin(*NEGATIVE)).alias("negative"), F.count_if("used").alias("used"), F.count_if(F.col("outcome") == "ignored").alias("ignored"))
    return sums.withColumn("usefulness", r6(clamp((p + 1.5) / (n + 3.0) + 0.15 * u / n - 0.45 * g / n - 0.25 * i / n)))


def topic_weights(memories: DataFrame, as_of: Column, half_life: float = 30.0) -> DataFrame:
    """Decayed weight of each entity by how long ago its memories were last helpful."""
    topics = memories.where("last_helpful_at is not null").select(F.explode("entities").alias("topic"), days_between(as_of, F.col("last_helpful_at")).alias("days"))
    return topics.groupBy("topic").agg(F.count("*").alias("n"), r6(F.sum(F.pow(F.lit(0.5), F.greatest(F.col("days"), F.lit(0.0)) / half_life))).alias("weight"))


def calibration(usage: DataFrame, memories: DataFrame, least: int = 4, strength: float = 4.0) -> DataFrame:
    """Chance that a use is helpful per kind and source type, from the first rung with `least` resolved uses: both, the kind, all, else the prior .5.

    Each rung's share is drawn to .5 by `strength` uses. Uses are counted per memory before they meet the memories, so a hot memory is one row.
    """
    good = F.col("outcome").isin(*POSITIVE)
    per = usage.where(F.col("outcome").isin(*POSITIVE, *NEGATIVE)).groupBy("memory_id").agg(F.count("*").alias("n"), F.count_if(good).alias("k"))
    own = per.join(memories.select(F.col("id").alias("memory_id"), "kind", "source_type"), "memory_id")
    sums = own.groupBy("kind", "source_type").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    kinds = sums.groupBy("kind").agg(F.sum("n").alias("kind_n"), F.sum("k").alias("kind_k"))
    total = sums.agg(F.sum("n").alias("all_n"), F.sum("k").alias("all_k"))
    drawn = lambda k, n: (F.col(k) + 0.5 * strength) / (F.col(n) + strength)
    rungs = [("task_source", "k", "n"), ("task", "kind_k", "kind_n"), ("global", "all_k", "all_n")]
    rung, chance = F.lit("prior"), F.lit(0.5)
    for name, k, n in reversed(rungs):
        rung, chance = F.when(F.col(n) >= least, name).otherwise(rung), F.when(F.col(n) >= least, drawn(k, n)).otherwise(chance)
    # the totals of kinds are as few as there are kinds
    return sums.join(F.broadcast(kinds), "kind").join(F.broadcast(total)).select("kind", "source_type", "n", "k", rung.alias("rung"), r6(chance).alias("probability"))


def calibration_error(usage: DataFrame, bins: int = 10) -> DataFrame:
    """Brier score and calibration error of attribution as a forecast of a positive outcome, by bin."""
    p, y = F.col("attribution"), F.col("outcome").isin(*POSITIVE).cast("double")
    seen = usage.where(F.col("outcome").isin(*POSITIVE, *NEGATIVE, "ignored") & p.isNotNull() & ~F.isnan(p))
    bin_ = F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")
    return seen.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), r6(F.avg(p)).alias("forecast"), r6(F.avg(y)).alias("observed"), r6(F.avg((p - y) * (p - y))).alias("brier"), r6(F.abs(F.avg(p) - F.avg(y))).alias("gap"))


def token_waste(usage: DataFrame, memories: DataFrame) -> DataFrame:
    """Health of selections per day: share of their tokens that went unused, of selections used, of uses helpful, and of selections that did harm."""
    size = memories.select(F.col("id").alias("memory_id"), F.ceil(F.length("content") / 4).alias("tokens"))
    joined = usage.where("selected").join(size, "memory_id")
    good, bad = F.count_if(F.col("outcome").isin(*POSITIVE)), F.count_if(F.col("outcome").isin(*NEGATIVE))
    used = F.count_if("used")
    health = [r6(share(used, F.count("*"))).alias("precision"), r6(share(good, used)).alias("helpfulness"), r6(share(bad, F.count("*"))).alias("false_positive_rate")]
    return joined.groupBy(F.to_date("created_at").alias("day")).agg(*health, F.sum("tokens").alias("tokens"), F.sum(F.when(~F.col("used"), F.col("tokens")).otherwise(0)).alias("unused_tokens"), r6(share(F.sum(F.when(~F.col("used"), F.col("tokens")).otherwise(0)), F.sum("tokens"))).alias("waste"))


def spaced_reinforcement(usage: DataFrame) -> DataFrame:
    """Helpful use over different days, sessions and tasks counts for more than one burst: saturating in the distinct days and tasks."""
    good = usage.where(F.col("outcome").isin(*POSITIVE))
    sums = good.groupBy("memory_id").agg(F.count_distinct(F.to_date("created_at")).alias("days"), F.count_distinct("session_id").alias("sessions"), F.count_distinct("task_id").alias("tasks"))
    spread = 0.5 * F.col("days") + 0.25 * F.col("sessions") + 0.25 * F.col("tasks")
    return sums.withColumn("strength", r6(spread / (spread + 3.0)))


def rehearsal(usage: DataFrame) -> DataFrame:
    """`id, spaced, unused` of each used or selected memory: strength of spaced helpful use, and how often it was selected and not used."""
    spaced = spaced_reinforcement(usage).select("memory_id", F.col("strength").alias("spaced"))
    unused = usage.groupBy("memory_id").agg(F.count_if(F.col("selected") & ~F.coalesce("used", F.lit(False))).alias("unused"))
    return unused.where("memory_id is not null").join(spaced, "memory_id", "left").select(F.col("memory_id").alias("id"), F.coalesce("spaced", F.lit(0.0)).alias("spaced"), "unused")


def tool_statistics(events: DataFrame) -> DataFrame:
    """Tool calls by tool and user group: calls, successes, distinct contexts; reinforced from two contexts on."""
    user = F.col("user_id") % 10
    sums = events.groupBy(F.col("event_type").alias("tool"), user.alias("context")).agg(F.count("*").alias("calls"), F.count_if(F.col("value") > 50).alias("successes"), F.count_distinct("user_id").alias("contexts"))
    return sums.withColumn("reinforced", F.col("contexts") >= 2)


def admitted_groups(memories: DataFrame, least: int = 5, contexts: int = 2) -> DataFrame:
    """Named scopes with enough memories over enough session contexts."""
    named = memories.select(F.element_at("scope", "project").alias("name"), "session_id").where("name is not null")
    return named.groupBy("name").agg(F.count("*").alias("memories"), F.count_distinct("session_id").alias("sessions")).withColumn("admitted", (F.col("memories") >= least) & (F.col("sessions") >= contexts))


def distribution(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Minimum, quartile-like percentiles (linear interpolation) and maximum; null and NaN values do not count."""
    found = exact_quantiles(rows, by, value, (0.5, 0.95, 0.99))
    return found.select(by, "n", r6(F.col("least")).alias("least"), *[r6(F.col("q")[k]).alias(n) for k, n in enumerate(("p50", "p95", "p99"))], r6(F.col("most")).alias("most"))


def capacity(memories: DataFrame) -> DataFrame:
    """Memories made each day and the running total (a window over days, not over memories)."""
    days = memories.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("made"))
    return days.withColumn("capacity", F.sum("made").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))


def audit(memories: DataFrame, edges: DataFrame, usage: DataFrame, versions: DataFrame) -> DataFrame:
    """Integrity counts: references that lead nowhere (null keys too), self-loops, repeated keys."""
    ids = memories.select(F.col("id").alias("ref")).distinct()

    def orphans(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.select(F.col(column).alias("ref")).join(ids, "ref", "left_anti").agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")

    parts = [orphans(edges, "src_id", "edge source"), orphans(edges, "dst_id", "edge target"), orphans(usage, "memory_id", "usage memory"), orphans(versions, "memory_id", "version memory")]
    parts.append(edges.agg(F.count_if(F.col("src_id") == F.col("dst_id")).alias("n")).select(F.lit("self loop").alias("check"), "n"))
    parts.append(usage.groupBy("usage_id").agg((F.count("*") - 1).alias("again")).agg(F.coalesce(F.sum("again"), F.lit(0)).alias("n")).select(F.lit("usage delivered again").alias("check"), "n"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
