"""Joins, windows and set operations over memories, edges and usage: association evidence, conflicts, decay, undo, bounded walks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evimem.functions.numbers import r6
from evimem.functions.skew import hot_keys, salt, spread
from evimem.session import cut, partitions_for

#: Most used memories of a task that are paired with each other.
MOST_PAIRED = 10


def used_pairs(usage: DataFrame, most: int | None = MOST_PAIRED, ways: int = 32) -> DataFrame:
    """`task_id, src_id, dst_id, helpful`: pairs (src < dst) of the up to `most` best attributed memories used in a task, or of all.

    With a cap, as direct co-use edges have it, a task with many rows gives a bounded number. Without one, as association evidence is
    counted, hot tasks are salted, so that no task of the job makes all pairs of one.
    """
    per = usage.where("used and memory_id is not null and task_id is not null").groupBy("task_id", "memory_id").agg(F.max("attribution").alias("attribution"), F.max(F.col("outcome").isin("helpful", "validated")).alias("helpful"))
    hot = []
    if most is None:
        hot = hot_keys(per, "task_id", floor=1000)
    else:
        per = per.withColumn("rn", F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("attribution"), "memory_id"))).where(F.col("rn") <= most)
    one = per.select("task_id", F.col("memory_id").alias("src_id"), F.col("helpful").alias("h1")).withColumn("_salt", salt("task_id", hot, F.col("src_id"), ways))
    two = spread(per.select("task_id", F.col("memory_id").alias("dst_id"), F.col("helpful").alias("h2")), "task_id", hot, ways)
    return one.join(two, ["task_id", "_salt"]).where("src_id < dst_id").select("task_id", "src_id", "dst_id", (F.col("h1") & F.col("h2")).alias("helpful"))


def association_support(pairs: DataFrame, least: int = 2) -> DataFrame:
    """Pairs seen by at least `least` different tasks, with their helpful ones."""
    return pairs.groupBy("src_id", "dst_id").agg(F.count_distinct("task_id").alias("witnesses"), F.count_distinct(F.when(F.col("helpful"), F.col("task_id"))).alias("helpful")).where(F.col("witnesses") >= least)


def gated(support: DataFrame, least: int = 2) -> DataFrame:
    """Associations that may be proposed: a helpful witness, or else three witnesses at least; with the weight they would add."""
    add = F.least(F.lit(0.18), 0.04 + 0.02 * F.log1p(F.col("witnesses")))
    return support.where((F.col("helpful") > 0) | (F.col("witnesses") >= max(3, least))).withColumn("increment", r6(add))


def similarity(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """`pairs` (`src_id, dst_id` and more) with the `similarity` of both records' features (`id, features, weights`), 0 where one has none.

    Shared weight, summed over the smaller weights, by the lighter record's whole weight (1 at least). Different pairs meet the features once.
    """
    maps = features.select("id", F.map_from_arrays("features", "weights").alias("m"), F.aggregate("weights", F.lit(0.0), lambda acc, w: acc + w).alias("total"))
    ends = lambda side: maps.select(F.col("id").alias(f"{side}_id"), F.col("m").alias(f"{side}_m"), F.col("total").alias(f"{side}_t"))
    both = pairs.select("src_id", "dst_id").distinct().join(ends("src"), "src_id", "left").join(ends("dst"), "dst_id", "left")
    shared = F.aggregate(F.map_keys("src_m"), F.lit(0.0), lambda acc, k: acc + F.least(F.element_at("src_m", k), F.coalesce(F.element_at("dst_m", k), F.lit(0.0))))
    total = F.greatest(F.lit(1.0), F.least(F.coalesce("src_t", F.lit(0.0)), F.coalesce("dst_t", F.lit(0.0))))
    found = both.select("src_id", "dst_id", r6(F.least(F.lit(1.0), F.coalesce(shared, F.lit(0.0)) / total)).alias("similarity"))
    return pairs.join(found, ["src_id", "dst_id"])


def alike(support: DataFrame, least: float = 0.35) -> DataFrame:
    """Of associations with their `similarity`, those with a helpful witness and those of records that are alike."""
    return support.where((F.col("helpful") > 0) | (F.col("similarity") >= least))


def replay_score(a: Column, b: Column, similarity: Column) -> Column:
    """The weaker record's score, a quarter of it by likeness, .05 at least."""
    return r6(F.greatest(F.lit(0.05), F.least(a, b) * (0.75 + 0.25 * similarity)))


def conflicting_groups(claims: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Groups of claims with more than one different value."""
    return claims.groupBy(*keys).agg(F.count("*").alias("claims"), F.count_distinct(value).alias("distinct_values")).where("distinct_values > 1")


def interference(claims: DataFrame, keys: list[str], key: str, value: str, score: str, top: int = 8) -> DataFrame:
    """Pairs of different values among the `top` claims of each group, scored by the weaker one."""
    ranked = claims.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), key))).where(F.col("rn") <= top)
    one = ranked.select(*keys, F.col(key).alias("a"), F.col(value).alias("value_a"), F.col(score).alias("score_a"))
    two = ranked.select(*keys, F.col(key).alias("b"), F.col(value).alias("value_b"), F.col(score).alias("score_b"))
    return one.join(two, keys).where((F.col("a") < F.col("b")) & (F.lower("value_a") != F.lower("value_b"))).select(*keys, "a", "b", F.least("score_a", "score_b").alias("score"))


def contradictions(claims: DataFrame, keys: list[str], key: str, value: str, start: str, end: str) -> DataFrame:
    """For each claim, how many claims of its group with another value hold at some time when it holds: `key, conflicts`.

    No pairs are made: claims that begin by its end, less those that have ended before its start, over all values and over its own.
    A null start has always begun, a null end never comes.
    """
    low, high = F.lit(-(1 << 61)), F.lit(1 << 61)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    by_key = [f"_key{n}" for n in range(len(keys))]
    rows = claims.select(*[F.col(c).alias(n) for c, n in zip(keys, by_key, strict=True)], F.col(key).alias("_id"), F.lower(value).alias("_value"), F.coalesce(micros(start), low).alias("_start"), F.coalesce(micros(end), high).alias("_end"))
    rows = rows.where("_value is not null and _start <= _end")
    marks = rows.select(*by_key, "_id", "_value", F.inline(F.array(F.struct(F.col("_start").alias("_at"), F.lit(1).alias("_begins")), F.struct(F.col("_end").alias("_at"), F.lit(0).alias("_begins")))))

    def counted(by: list[str], name: str) -> tuple[Column, Column]:
        upto = Window.partitionBy(*by).orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
        before = Window.partitionBy(*by).orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
        return F.sum("_begins").over(upto).alias(f"begun_{name}"), F.coalesce(F.sum(1 - F.col("_begins")).over(before), F.lit(0)).alias(f"gone_{name}")

    seen = marks.select("_id", "_begins", *counted(by_key, "all"), *counted([*by_key, "_value"], "same"))
    begun = F.max(F.when(F.col("_begins") == 0, F.col("begun_all") - F.col("begun_same")))
    gone = F.max(F.when(F.col("_begins") == 1, F.col("gone_all") - F.col("gone_same")))
    return seen.groupBy("_id").agg((begun - gone).alias("conflicts")).withColumnRenamed("_id", key)


def running_count(events: DataFrame, at: str, population: DataFrame, born: str) -> DataFrame:
    """Each event with the number of `population` rows born by then: totals of earlier days plus a count within the day, so no task holds all rows."""
    marks = events.select(F.col("event"), F.col(at).alias("t")).unionByName(population.select(F.lit(None).cast("string").alias("event"), F.col(born).alias("t"))).where("t is not null").withColumn("day", F.to_date("t"))
    days = marks.groupBy("day").agg(F.count_if(F.col("event").isNull()).alias("n"))
    before = days.select("day", (F.sum("n").over(Window.orderBy("day")) - F.col("n")).alias("base"))
    within = F.sum(F.when(F.col("event").isNull(), 1).otherwise(0)).over(Window.partitionBy("day").orderBy("t").rangeBetween(Window.unboundedPreceding, 0))
    return marks.withColumn("within", within).where("event is not null").join(before, "day").select("event", (F.col("base") + F.col("within")).alias("capacity"))


def decayed(edges: DataFrame, cutoff: Column) -> DataFrame:
    """Weak edges (weight .45 at most, evidence 2 at most) not reinforced since `cutoff`, with the weight after decay."""
    return edges.where((F.col("weight") <= 0.45) & (F.col("evidence_count") <= 2) & (F.col("last_reinforced_at") < cutoff)).select("src_id", "dst_id", "relation", "created_at", "weight", r6(F.greatest(F.lit(0.05), 0.95 * F.col("weight"))).alias("new_weight"))


def undone(changes: DataFrame, current: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Undo with a check: a change is restored where the value still is what it set, else it is in conflict (or gone)."""
    now = current.select(*keys, F.col(value).alias("now"))
    state = F.when(F.col("now").isNull(), "gone").when(F.abs(F.col("now") - F.col(f"new_{value}")) < 1e-9, "restored").otherwise("conflict")
    return changes.join(now, keys, "left").select(*keys, value, state.alias("undo"))


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Edges after an upsert: weights add up to 1 at most, evidence adds up, the latest time stands. Null weights count as 0."""
    both = old.unionByName(new)
    return both.groupBy(*keys).agg(r6(F.least(F.lit(1.0), F.sum(F.coalesce("weight", F.lit(0.0))))).alias("weight"), F.sum("evidence_count").alias("evidence_count"), F.max("last_reinforced_at").alias("last_reinforced_at"))


def inserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` that an insert-or-ignore would add: keys that are not there, once each."""
    return new.dropDuplicates(keys).join(old.select(*keys).distinct(), keys, "left_anti")


def reconciled(stored: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """What a full reconcile would do with each key: add, remove or keep."""
    one, two = stored.select(*keys).distinct().withColumn("s", F.lit(1)), wanted.select(*keys).distinct().withColumn("w", F.lit(1))
    action = F.when(F.col("s").isNull(), "add").when(F.col("w").isNull(), "remove").otherwise("keep")
    return one.join(two, keys, "full_outer").select(*keys, action.alias("action"))


def reached(starts: DataFrame, edges: DataFrame, depth: int = 2, decay: float = 0.5) -> DataFrame:
    """`seed, id, boost`: what `starts` (`seed, id, boost`) hand on to the records within `depth` steps; a seed's several starts add up.

    Contradictions are never followed; a superseded record leads to what supersedes it only, and a claim to the evidence that supports it only;
    useful_together goes both ways, other relations along their direction. A step shares a score by edge weight, times `decay`; several paths add up to 1 at most.
    """
    known = edges.where("src_id is not null and dst_id is not null and src_id <> dst_id and relation <> 'contradicts'")
    w = F.coalesce("weight", F.lit(0.0))
    ahead = known.where("relation not in ('supersedes', 'supports')").select(F.col("src_id").alias("a"), F.col("dst_id").alias("b"), w.alias("w"))
    back = known.where("relation in ('supersedes', 'supports', 'useful_together')").select(F.col("dst_id").alias("a"), F.col("src_id").alias("b"), w.alias("w"))
    steps = ahead.unionByName(back).groupBy("a", "b").agg(F.max("w").alias("w")).where("w > 0")
    shared = steps.join(steps.groupBy("a").agg(F.sum("w").alias("total")), "a").select("a", "b", (F.col("w") / F.greatest(F.col("total"), F.lit(1.0))).alias("p"))
    at = starts.select("seed", "id", "boost")
    found = None
    for _ in range(depth):
        at = at.join(shared, at["id"] == shared["a"]).groupBy("seed", F.col("b").alias("id")).agg((F.sum(F.col("boost") * F.col("p")) * decay).alias("boost"))
        found = at if found is None else found.unionByName(at)
    return found.groupBy("seed", "id").agg(r6(F.least(F.lit(1.0), F.sum("boost"))).alias("boost"))


def walk(seeds: DataFrame, edges: DataFrame, depth: int = 2, decay: float = 0.5) -> DataFrame:
    """`seed, id, boost`: associations of each seed by itself, as `reached` from a score of 1; the seed itself is left out."""
    return reached(seeds.select("seed", F.col("seed").alias("id"), F.lit(1.0).alias("boost")), edges, depth, decay).where("id <> seed")


def flags(memories: DataFrame, edges: DataFrame) -> DataFrame:
    """Each memory with whether an edge supersedes or contradicts it (contradictions count for both ends)."""
    old = edges.where("relation = 'supersedes'").select(F.col("dst_id").alias("id")).distinct().withColumn("superseded", F.lit(True))
    ends = edges.where("relation = 'contradicts'").select(F.explode(F.array("src_id", "dst_id")).alias("id")).distinct().withColumn("contradicted", F.lit(True))
    return memories.select("id").join(old, "id", "left").join(ends, "id", "left").select("id", F.coalesce("superseded", F.lit(False)).alias("superseded"), F.coalesce("contradicted", F.lit(False)).alias("contradicted"))


def merged_duplicates(memories: DataFrame, keys: list[Column]) -> DataFrame:
    """Exact duplicates in one context as one record: best scores, least uniqueness, all entities, number of further copies."""
    named = [k.alias(f"k{n}") for n, k in enumerate(keys)]
    sums = memories.groupBy(*named).agg(
        F.min("id").alias("id"),
        (F.count("*") - 1).alias("further_copies"),
        F.max("importance").alias("importance"),
        F.max("confidence").alias("confidence"),
        F.max("trust").alias("trust"),
        F.min("uniqueness").alias("uniqueness"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("entities")))), ",").alias("entities"),
    )
    return sums.drop(*[f"k{n}" for n in range(len(keys))])


def numbered(rows: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """`rows` with their number (from 1) within each group, in an order that leaves no ties.

    A group is not sorted by one task: rows are range-partitioned on keys and order, numbered within their partition, and the few groups that
    reach over several partitions (two a partition at most) get the counts of the earlier ones added. Rows with a null key are a group.
    """
    ranged = cut(rows.repartitionByRange(partitions_for(rows), *keys, *order).sortWithinPartitions(*keys, *order).withColumn("_pid", F.spark_partition_id()))
    within = ranged.withColumn(name, F.row_number().over(Window.partitionBy("_pid", *keys).orderBy(*order)).cast("bigint"))
    sizes = ranged.groupBy("_pid", *keys).agg(F.count("*").alias("_n"))
    by_pid = Window.partitionBy(*keys).orderBy("_pid")
    offsets = sizes.withColumn("_offset", F.sum("_n").over(by_pid) - F.col("_n")).where("_offset > 0")
    renamed = offsets.select(F.col("_pid").alias("_p"), "_offset", *[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)])
    same = F.col("_pid") == F.col("_p")
    for n, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{n}"))
    joined = within.join(F.broadcast(renamed), same, "left")
    return joined.select(*rows.columns, (F.col(name) + F.coalesce("_offset", F.lit(0))).alias(name))


def adjacent_pairs(rows: DataFrame, keys: list[str], order: list, key: str) -> DataFrame:
    """Neighbours (first with second, third with fourth, ...) within each group; an odd last row has no pair. The arm of each is a hash of the pair."""
    found = numbered(rows, keys, order, "rn").select(*keys, F.col(key).alias("id"), "rn")
    pair = found.withColumn("pair", F.floor((F.col("rn") - 1) / 2)).groupBy(*keys, "pair").agg(F.min_by("id", "rn").alias("first"), F.max_by("id", "rn").alias("second"), F.count("*").alias("n")).where("n = 2")
    treated = F.when(F.conv(F.substring(F.sha2(F.concat("first", F.lit("|"), "second"), 256), 1, 8), 16, 10).cast("bigint") % 2 == 0, F.col("first")).otherwise(F.col("second"))
    return pair.select(*keys, "first", "second", treated.alias("treated"))


def signatures(edges: DataFrame, relations: list[str], most: int = 250) -> DataFrame:
    """Summary candidates: the `most` strongest edges of some relations, with a signature of the two ids that does not depend on direction."""
    ids = F.concat_ws(",", F.least("src_id", "dst_id"), F.greatest("src_id", "dst_id"))
    rows = edges.where(F.col("relation").isin(*relations) & F.col("weight").isNotNull() & (F.col("src_id") != F.col("dst_id")))
    return rows.groupBy(F.sha2(ids, 256).alias("signature")).agg(F.max("weight").alias("weight"), F.sum("evidence_count").alias("evidence")).orderBy(F.desc("weight"), F.desc("evidence"), "signature").limit(most)
