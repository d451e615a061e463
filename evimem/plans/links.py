"""Queries of joins, windows and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evimem.functions.numbers import r6
from evimem.operators import ledger as L
from evimem.operators import links as K
from evimem.plans.ledger import ONCE
from evimem.plans.registering import AS_OF, registrar
from evimem.plans.text import FEATURES, feature_lists
from evimem.session import written
from evimem.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registrar(QUERIES, SQL)

PAIRS = (
    ONCE
    + """, per as (select task_id, memory_id, max(attribution) as attribution, max(outcome in ('helpful', 'validated')) as helpful from once where used and memory_id is not null and task_id is not null group by 1, 2),
top as (select * from (select *, row_number() over (partition by task_id order by attribution desc, memory_id) as k from per) where k <= 10),
pairs as (select a.task_id, a.memory_id as src_id, b.memory_id as dst_id, a.helpful and b.helpful as helpful from top a join top b on a.task_id = b.task_id and a.memory_id < b.memory_id)
"""
)
SUPPORT = PAIRS + ", support as (select src_id, dst_id, count(distinct task_id) as witnesses, count(distinct case when helpful then task_id end) as helpful from pairs group by 1, 2 having count(distinct task_id) >= 2)"


def _pairs(spark, d, most=None):
    """All pairs of a task; SQL pairs ten memories of a task at most, which is the same where no task uses more."""
    return K.used_pairs(L.delivered_once(table(spark, d, "usage_records"), "task_id", "memory_id", "used", "attribution", "outcome"), most)


@query("jn_7", PAIRS + "select * from pairs")
def jn_7(spark, d):
    return _pairs(spark, d, K.MOST_PAIRED)


@query("agg_1", SUPPORT + " select * from support")
def agg_1(spark, d):
    return K.association_support(_pairs(spark, d))


def likened(pairs, memories):
    """`pairs` with the likeness of their records; features are made once, and of records that are in a pair only."""
    pairs = written(pairs, "pairs")
    named = pairs.select(F.explode(F.array("src_id", "dst_id")).alias("id")).distinct()
    return K.similarity(pairs, written(feature_lists(memories.select("id", "content").join(named, "id", "left_semi")), "features"))


#: CTEs after a list of pairs: the likeness of the records of `asked` pairs.
LIKENESS = f"""{FEATURES}, sums as (select id, sum(weight) as total from feats group by id),
shared as (select src_id, dst_id, sum(least(a.weight, b.weight)) as n from asked join feats a on a.id = src_id join feats b on b.id = dst_id and b.feature = a.feature group by 1, 2),
liking as (select p.src_id, p.dst_id, round(least(1.0, coalesce(n, 0) / greatest(1.0, least(coalesce(x.total, 0), coalesce(y.total, 0)))), 6) as similarity from asked p left join shared s on s.src_id = p.src_id and s.dst_id = p.dst_id left join sums x on x.id = p.src_id left join sums y on y.id = p.dst_id)"""


@query(
    "agg_2",
    SUPPORT
    + f", asked as (select src_id, dst_id from support), {LIKENESS} select support.*, round(least(0.18::double, 0.04 + 0.02 * ln(1 + witnesses)), 6) as increment, similarity from support join liking using (src_id, dst_id) where helpful > 0 or (witnesses >= 3 and similarity >= 0.35)",
)
def agg_2(spark, d):
    """Associations that may be proposed: a helpful witness, or else three witnesses of records that are alike."""
    return K.alike(likened(K.gated(K.association_support(_pairs(spark, d))), table(spark, d, "memories")))


@query("agg_3", "select o_custkey, o_orderpriority, count(*) as claims, count(distinct o_orderstatus) as distinct_values from orders group by 1, 2 having count(distinct o_orderstatus) between 2 and 50")
def agg_3(spark, d):
    return K.conflicting_groups(table(spark, d, "orders"), ["o_custkey", "o_orderpriority"], "o_orderstatus")


@query("agg_4", ONCE + ", first as (select task_id, min(created_at) as first_at from once group by 1) select task_id, first_at from first where task_id not in (select task_id from once where outcome = 'pending' and task_id is not null)")
def agg_4(spark, d):
    usage = L.delivered_once(table(spark, d, "usage_records"), "task_id", "created_at", "outcome")
    return usage.groupBy("task_id").agg(F.min("created_at").alias("first_at")).join(usage.where("outcome = 'pending'").select("task_id").distinct(), "task_id", "left_anti")


@query(
    "agg_12",
    """with e as (select unnest([src_id, dst_id]) as memory_id, relation, created_at as begun from edges)
select relation, count(distinct u.task_id) as tasks, count(distinct case when u.outcome in ('helpful', 'validated') then u.task_id end) as helpful_tasks from e join usage_records u on u.memory_id = e.memory_id and u.created_at >= e.begun group by relation""",
)
def agg_12(spark, d):
    begun = table(spark, d, "edges").select(F.explode(F.array("src_id", "dst_id")).alias("memory_id"), "relation", "created_at").groupBy("memory_id", "relation").agg(F.min("created_at").alias("begun"))
    # one row a memory and relation: the earliest edge decides, so nothing is counted twice
    joined = table(spark, d, "usage_records").select("memory_id", "task_id", "outcome", "created_at").join(begun, "memory_id").where("created_at >= begun")
    return joined.groupBy("relation").agg(F.count_distinct("task_id").alias("tasks"), F.count_distinct(F.when(F.col("outcome").isin("helpful", "validated"), F.col("task_id"))).alias("helpful_tasks"))


@query("jn_1", "select relation, a.kind as src_kind, b.kind as dst_kind, count(*) as n from edges join memories a on a.id = src_id join memories b on b.id = dst_id group by 1, 2, 3")
def jn_1(spark, d):
    m = table(spark, d, "memories")
    ends = lambda side: m.select(F.col("id").alias(f"{side}_id"), F.col("kind").alias(f"{side}_kind"))
    return table(spark, d, "edges").join(ends("src"), "src_id").join(ends("dst"), "dst_id").groupBy("relation", "src_kind", "dst_kind").agg(F.count("*").alias("n"))


@query("jn_2", ONCE + "select id, count(usage_id) as uses, count(distinct task_id) as tasks from memories left join once on memory_id = id group by id")
def jn_2(spark, d):
    m = table(spark, d, "memories").select("id")
    # the usage side is counted before the join, so a hot memory is one row in it
    sums = L.delivered_once(table(spark, d, "usage_records"), "memory_id", "task_id").groupBy(F.col("memory_id").alias("id")).agg(F.count("usage_id").alias("uses"), F.count_distinct("task_id").alias("tasks"))
    return m.join(sums, "id", "left").fillna(0)


@query("jn_3", "select id, kind from memories where id not in (select memory_id from usage_records where memory_id is not null)")
def jn_3(spark, d):
    return table(spark, d, "memories").select("id", "kind").join(table(spark, d, "usage_records").select(F.col("memory_id").alias("id")).distinct(), "id", "left_anti")


@query("jn_4", "select id from memories where id not in (select src_id from edges where src_id is not null union select dst_id from edges where dst_id is not null)")
def jn_4(spark, d):
    linked = table(spark, d, "edges").select(F.explode(F.array("src_id", "dst_id")).alias("id")).distinct()
    return table(spark, d, "memories").select("id").join(linked, "id", "left_anti")


CLAIMS = "claims as (select o_orderkey, o_custkey, o_orderpriority, o_orderstatus, o_totalprice, o_orderdate as s, o_orderdate + interval 90 day as e from orders)"


def _claims(spark, d):
    return table(spark, d, "orders").withColumn("until", F.col("o_orderdate") + F.expr("interval 90 days"))


@query("jn_5", f"with {CLAIMS} select a.o_orderkey, count(b.o_orderkey) as conflicts from claims a left join claims b on a.o_custkey = b.o_custkey and a.o_orderpriority = b.o_orderpriority and a.o_orderstatus <> b.o_orderstatus and a.s <= b.e and b.s <= a.e group by 1")
def jn_5(spark, d):
    return K.contradictions(_claims(spark, d), ["o_custkey", "o_orderpriority"], "o_orderkey", "o_orderstatus", "o_orderdate", "until")


@query(
    "jn_6",
    "with t as (select * from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as k from orders) where k <= 8) select a.o_custkey, a.o_orderkey as a, b.o_orderkey as b, least(a.o_totalprice, b.o_totalprice) as score from t a join t b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey and lower(a.o_orderstatus) <> lower(b.o_orderstatus)",
)
def jn_6(spark, d):
    return K.interference(table(spark, d, "orders"), ["o_custkey"], "o_orderkey", "o_orderstatus", "o_totalprice")


@query("jn_8", "select id, count(distinct (src_id, dst_id)) as edges from (select unnest([src_id, dst_id]) as id, src_id, dst_id, created_at from edges) e where exists (select 1 from usage_records u where outcome = 'harmful' and u.memory_id = e.id and u.created_at >= e.created_at) group by id")
def jn_8(spark, d):
    """Edges at either end of which a memory did harm after the edge was made."""
    ends = table(spark, d, "edges").select("src_id", "dst_id", "created_at", F.explode(F.array("src_id", "dst_id")).alias("id")).groupBy("id", "src_id", "dst_id").agg(F.min("created_at").alias("created_at"))
    # the latest harm decides, so a hot memory is one row
    bad = table(spark, d, "usage_records").where("outcome = 'harmful'").groupBy(F.col("memory_id").alias("id")).agg(F.max("created_at").alias("last_harm"))
    return ends.join(bad, "id").where("last_harm >= created_at").groupBy("id").agg(F.count("*").alias("edges"))


@query(
    "jn_9",
    ONCE
    + ", t as (select task_id as event, min(created_at) as at_time from once where task_id is not null group by 1), m as (select created_at, count(*) over (order by created_at) as n from memories) select event, coalesce(max(n), 0) as capacity from t asof left join (select created_at, max(n) as n from m group by 1) mm on t.at_time >= mm.created_at group by event",
)
def jn_9(spark, d):
    tasks = L.delivered_once(table(spark, d, "usage_records"), "task_id", "created_at").where("task_id is not null").groupBy(F.col("task_id").alias("event")).agg(F.min("created_at").alias("at_time"))
    return K.running_count(tasks, "at_time", table(spark, d, "memories"), "created_at")


@query("jn_10", "select kind, count(*) as n from memories where id in (select memory_id from usage_records where selected) group by kind")
def jn_10(spark, d):
    picked = table(spark, d, "usage_records").where("selected").select(F.col("memory_id").alias("id")).distinct()
    return table(spark, d, "memories").join(picked, "id", "left_semi").groupBy("kind").agg(F.count("*").alias("n"))


STORED = "stored as (select distinct least(src_id, dst_id) as src_id, greatest(src_id, dst_id) as dst_id from edges where relation = 'co_used')"


@query("jn_14", PAIRS + f", {STORED}, wanted as (select distinct src_id, dst_id from pairs) select coalesce(s.src_id, w.src_id) as src_id, coalesce(s.dst_id, w.dst_id) as dst_id, case when s.src_id is null then 'add' when w.src_id is null then 'remove' else 'keep' end as action from stored s full outer join wanted w on s.src_id = w.src_id and s.dst_id = w.dst_id")
def jn_14(spark, d):
    stored = table(spark, d, "edges").where("relation = 'co_used'").select(F.least("src_id", "dst_id").alias("src_id"), F.greatest("src_id", "dst_id").alias("dst_id"))
    return K.reconciled(stored, _pairs(spark, d, K.MOST_PAIRED), ["src_id", "dst_id"])


@query("win_2", ONCE + "select * from (select task_id, memory_id, usage_id, row_number() over (partition by task_id order by score desc nulls last, usage_id) as place from once) where place <= 3")
def win_2(spark, d):
    rank = F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc_nulls_last("score"), "usage_id"))
    return L.delivered_once(table(spark, d, "usage_records"), "task_id", "memory_id", "score").select("task_id", "memory_id", "usage_id", rank.alias("place")).where("place <= 3").withColumn("place", F.col("place").cast("bigint"))


@query("win_3", "select memory_id, version_id, state from (select *, row_number() over (partition by memory_id order by system_from desc, version_id desc) as k from memory_versions) where k = 1")
def win_3(spark, d):
    # max_by aggregates in part before the shuffle, where a window would sort a hot memory in one task
    latest = F.max_by(F.struct("version_id", "state"), F.struct("system_from", "version_id"))
    return table(spark, d, "memory_versions").groupBy("memory_id").agg(latest.alias("v")).select("memory_id", "v.version_id", "v.state")


@query("win_4", "select memory_id, max_by(reason, (system_from, version_id)) as last_reason, max_by(state, (system_from, version_id)) as last_state from memory_versions where reason is not null group by memory_id")
def win_4(spark, d):
    order = F.struct("system_from", "version_id")
    return table(spark, d, "memory_versions").where("reason is not null").groupBy("memory_id").agg(F.max_by("reason", order).alias("last_reason"), F.max_by("state", order).alias("last_state"))


@query("win_5", "select doc_id, title, row_number() over (partition by title order by doc_id) as occurrence from documents where title is not null")
def win_5(spark, d):
    return K.numbered(table(spark, d, "documents").where("title is not null").select("doc_id", "title"), ["title"], [F.col("doc_id")], "occurrence")


@query("win_6", "select kind, id, place from (select kind, id, row_number() over (partition by kind order by confidence * currentness_confidence desc, id) as place from memories) where place <= 8")
def win_6(spark, d):
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc(F.col("confidence") * F.col("currentness_confidence")), "id")).cast("bigint")
    return table(spark, d, "memories").select("kind", "id", rank.alias("place")).where("place <= 8")


ADJACENT = "with s as (select kind, state, id, row_number() over (partition by kind, state order by importance desc, id) as k from memories), p as (select kind, state, (k - 1) // 2 as pair, min_by(id, k) as first, max_by(id, k) as second from s group by 1, 2, 3 having count(*) = 2)"


@query("win_7", ADJACENT + " select kind, state, first, second, case when cast('0x' || substr(sha256(first || '|' || second), 1, 8) as bigint) % 2 = 0 then first else second end as treated from p")
def win_7(spark, d):
    return K.adjacent_pairs(table(spark, d, "memories"), ["kind", "state"], [F.col("importance").desc(), F.col("id")], "id")


@query("win_8", "select event_id, last_value(case when event_type = 'view' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as last_view from events")
def win_8(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, d, "events").select("event_id", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w).alias("last_view"))


@query("set_1", "with s as (select memory_id, max(score) as score, null::double as weight from usage_records where memory_id is not null group by 1 union all select dst_id, null, max(weight) from edges where dst_id is not null group by 1) select memory_id, max(score) as score, max(weight) as weight, count(*) as sources from s group by 1")
def set_1(spark, d):
    one = table(spark, d, "usage_records").where("memory_id is not null").groupBy("memory_id").agg(F.max("score").alias("score"))
    two = table(spark, d, "edges").where("dst_id is not null").groupBy(F.col("dst_id").alias("memory_id")).agg(F.max("weight").alias("weight"))
    return one.unionByName(two, allowMissingColumns=True).groupBy("memory_id").agg(F.max("score").alias("score"), F.max("weight").alias("weight"), F.count("*").alias("sources"))


@query("set_2", "select distinct memory_id from usage_records where selected and memory_id not in (select memory_id from usage_records where used and memory_id is not null)")
def set_2(spark, d):
    u = table(spark, d, "usage_records")
    return u.where("selected and memory_id is not null").select("memory_id").exceptAll(u.where("false").select("memory_id")).distinct().join(u.where("used").select("memory_id").distinct(), "memory_id", "left_anti")


@query(
    "set_4",
    """with a as (select memory_id, max_by(content, (system_from, version_id)) as c from memory_versions where system_from < timestamp '2025-01-01' group by 1), b as (select memory_id, max_by(content, (system_from, version_id)) as c from memory_versions group by 1)
select coalesce(a.memory_id, b.memory_id) as memory_id, case when a.memory_id is null then 'new' when b.memory_id is null then 'removed' when a.c = b.c then 'unchanged' else 'changed' end as change from a full outer join b on a.memory_id = b.memory_id""",
)
def set_4(spark, d):
    v = table(spark, d, "memory_versions")
    at = lambda rows, name: rows.groupBy("memory_id").agg(F.md5(F.max_by("content", F.struct("system_from", "version_id"))).alias(name))
    both = at(v.where("system_from < timestamp_ntz '2025-01-01'"), "a").join(at(v, "b"), "memory_id", "full_outer")
    return both.select("memory_id", F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "removed").when(F.col("a") == F.col("b"), "unchanged").otherwise("changed").alias("change"))


DECAYED = f"decayed as (select src_id, dst_id, relation, created_at, weight, round(greatest(0.05::double, 0.95 * weight), 6) as new_weight from edges where weight <= 0.45 and evidence_count <= 2 and last_reinforced_at < timestamp '{AS_OF}' - interval 120 day)"


def _decayed(spark, d):
    return K.decayed(table(spark, d, "edges"), F.expr(f"timestamp_ntz '{AS_OF}' - interval 120 days"))


@query("scl_40", f"with {DECAYED} select * from decayed")
def scl_40(spark, d):
    return _decayed(spark, d)


@query(
    "slp_2",
    f"with {DECAYED}, one as (select src_id, dst_id, relation, max(weight) as weight, max(new_weight) as new_weight from decayed group by 1, 2, 3), now as (select src_id, dst_id, relation, case when evidence_count % 2 = 1 then round(greatest(0.05::double, 0.95 * weight), 6) else weight end as now from (select src_id, dst_id, relation, max(weight) as weight, max(evidence_count) as evidence_count from edges group by 1, 2, 3)) select src_id, dst_id, relation, weight, case when now is null then 'gone' when abs(now - new_weight) < 1e-9 then 'restored' else 'conflict' end as undo from one left join now using (src_id, dst_id, relation)",
)
def slp_2(spark, d):
    keys = ["src_id", "dst_id", "relation"]
    changes = _decayed(spark, d).groupBy(*keys).agg(F.max("weight").alias("weight"), F.max("new_weight").alias("new_weight"))
    # as if a later pass had set only the edges with an odd count
    now = table(spark, d, "edges").groupBy(*keys).agg(F.max("weight").alias("weight"), F.max("evidence_count").alias("evidence_count"))
    now = now.withColumn("weight", F.when(F.col("evidence_count") % 2 == 1, r6(F.greatest(F.lit(0.05), 0.95 * F.col("weight")))).otherwise(F.col("weight")))
    return K.undone(changes, now, keys, "weight")


@query("snk_1", "select src_id, dst_id, relation, round(least(1.0::double, sum(coalesce(weight, 0))), 6) as weight, cast(sum(evidence_count) as bigint) as evidence_count, max(last_reinforced_at) as last_reinforced_at from edges group by 1, 2, 3")
def snk_1(spark, d):
    e = table(spark, d, "edges").select("src_id", "dst_id", "relation", "weight", "evidence_count", "last_reinforced_at")
    return K.upserted(e.where("evidence_count > 1"), e.where("evidence_count <= 1"), ["src_id", "dst_id", "relation"])


@query("snk_2", PAIRS + ", have as (select src_id, dst_id from edges) select distinct src_id, dst_id from pairs p where not exists (select 1 from have h where h.src_id = p.src_id and h.dst_id = p.dst_id)")
def snk_2(spark, d):
    return K.inserted(table(spark, d, "edges"), _pairs(spark, d).select("src_id", "dst_id"), ["src_id", "dst_id"])


@query(
    "gr_1",
    """with known as (select * from edges where src_id is not null and dst_id is not null and src_id <> dst_id and relation <> 'contradicts'),
steps as (select a, b, max(w) as w from (select src_id as a, dst_id as b, coalesce(weight, 0) as w from known where relation not in ('supersedes', 'supports') union all select dst_id, src_id, coalesce(weight, 0) from known where relation in ('supersedes', 'supports', 'useful_together')) group by 1, 2 having max(w) > 0),
shared as (select a, b, w / greatest(sum(w) over (partition by a), 1.0) as p from steps),
one as (select id as seed, b as id, 0.5 * p as boost from memories join shared on a = id where pinned),
two as (select seed, b as id, sum(boost * p) * 0.5 as boost from one join shared on a = one.id group by 1, 2)
select seed, id, round(least(1.0, sum(boost)), 6) as boost from (select * from one union all select * from two) where id <> seed group by 1, 2""",
)
def gr_1(spark, d):
    seeds = table(spark, d, "memories").where("pinned").select(F.col("id").alias("seed"))
    return K.walk(seeds, table(spark, d, "edges"))


@query("gr_4", "select id, id in (select dst_id from edges where relation = 'supersedes' and dst_id is not null) as superseded, id in (select unnest([src_id, dst_id]) from edges where relation = 'contradicts') as contradicted from memories")
def gr_4(spark, d):
    return K.flags(table(spark, d, "memories"), table(spark, d, "edges"))


@query("gr_5", "select id, supersedes_id, dirty or supersedes_id in (select memory_id from memory_versions where state = 'archived') as stale from memories where supersedes_id is not null")
def gr_5(spark, d):
    gone = table(spark, d, "memory_versions").where("state = 'archived'").select(F.col("memory_id").alias("supersedes_id")).distinct().withColumn("gone", F.lit(True))
    return table(spark, d, "memories").where("supersedes_id is not null").join(gone, "supersedes_id", "left").select("id", "supersedes_id", (F.col("dirty") | F.coalesce("gone", F.lit(False))).alias("stale"))


@query(
    "ded_1",
    "with g as (select min(id) as id, count(*) - 1 as further_copies, max(importance) as importance, max(confidence) as confidence, max(trust) as trust, min(uniqueness) as uniqueness, lower(trim(regexp_replace(content, '\\s+', ' ', 'g'))) as k, scope['project'] as p, array_to_string(list_sort(list_distinct(flatten(list(entities)))), ',') as entities from memories group by k, p) select id, further_copies, importance, confidence, trust, uniqueness, coalesce(entities, '') as entities from g",
)
def ded_1(spark, d):
    text = F.lower(F.trim(F.regexp_replace("content", r"\s+", " ")))
    return K.merged_duplicates(table(spark, d, "memories"), [text, F.element_at("scope", "project")])


@query("slp_4", "select sha256(concat_ws(',', least(src_id, dst_id), greatest(src_id, dst_id))) as signature, max(weight) as weight, cast(sum(evidence_count) as bigint) as evidence from edges where relation in ('co_used', 'useful_together', 'related') and weight is not null and src_id <> dst_id group by 1 order by weight desc, evidence desc, signature limit 250")
def slp_4(spark, d):
    return K.signatures(table(spark, d, "edges"), ["co_used", "useful_together", "related"])
