"""Queries of the ledger analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from evimem.operators import ledger as L
from evimem.plans.registering import AS_OF, registrar
from evimem.sources.tables import OBSERVATIONS, table

COUNTERS = ["retrieved_count", "selected_count", "injected_count", "used_count", "success_count", "confirmed_count", "validated_count", "helpful_count", "harmful_count", "correction_count"]

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registrar(QUERIES, SQL)

ONCE = """
with once as (select * from (select *, row_number() over (partition by usage_id order by coalesce(resolved_at, timestamp '0001-01-01') desc, created_at desc) as rn from usage_records where usage_id is not null) where rn = 1)
"""


def _usage(spark, d, *columns):
    return L.delivered_once(table(spark, d, "usage_records"), *columns)


@query("agg_6", ONCE + "select session_id, count(*) as offered, count(*) filter (selected) as selected, count(*) filter (used) as used, count(*) filter (outcome in ('helpful', 'validated')) as positive, count(*) filter (outcome in ('harmful', 'corrected')) as negative, count(*) filter (resolved_at is null) as unresolved from once group by session_id")
def agg_6(spark, d):
    return L.outcome_funnel(_usage(spark, d, "session_id", "selected", "used", "outcome", "resolved_at"), "session_id")


@query("agg_7", "select relation, count(*) as n, count(weight) as weighted, round(avg(weight), 6) as avg_weight, cast(sum(evidence_count) as bigint) as evidence from edges group by relation")
def agg_7(spark, d):
    return L.relation_histogram(table(spark, d, "edges"))


@query("agg_8", ONCE + "select cast(cast(created_at as date) as varchar) as day, outcome, count(*) as n from once group by 1, 2")
def agg_8(spark, d):
    return L.daily_outcomes(_usage(spark, d, "created_at", "outcome"))


@query(
    "agg_9",
    ONCE
    + "select task_id, count(distinct memory_id) as memories, count(distinct case when used then memory_id end) as used_memories, array_to_string(list_sort(list(distinct outcome)), ',') as outcomes, round(avg((epoch_us(once.created_at) - epoch_us(born)) / 86400000000.0), 6) as avg_age_days from once left join (select id, created_at as born from memories) m on m.id = memory_id group by task_id",
)
def agg_9(spark, d):
    return L.task_rollup(_usage(spark, d, "task_id", "memory_id", "used", "outcome", "created_at"), table(spark, d, "memories"))


@query(
    "agg_10",
    f"select cast(cast(run_at as date) as varchar) as day, count(*) as runs, count(answer) as answered, round(count(*) filter (correct) / nullif(count(answer), 0), 6) as accuracy, round(avg(case when agent_ttft_ms >= 0 and not isnan(agent_ttft_ms) then agent_ttft_ms end), 6) as avg_ttft_ms, round(count(*) filter (answer_available_in_context) / count(*), 6) as available_share from {OBSERVATIONS} group by 1",
)
def agg_10(spark, d):
    return L.daily_metrics(table(spark, d, OBSERVATIONS))


@query(
    "agg_11",
    f"""with s as (select condition, count(*) as n, count(*) filter (correct) as k from {OBSERVATIONS} group by 1)
select condition, n as runs, k as correct_runs, round(k / n, 6) as share,
round(greatest(0.0, (k / n + 3.8416 / (2 * n) - 1.96 * sqrt((k / n * (1 - k / n) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n)), 6) as low,
round(least(1.0, (k / n + 3.8416 / (2 * n) + 1.96 * sqrt((k / n * (1 - k / n) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n)), 6) as high,
min(n) over () >= 8 as ready from s""",
)
def agg_11(spark, d):
    return L.arm_statistics(table(spark, d, OBSERVATIONS), "condition")


@query("agg_13", " union all ".join(f"select '{c}' as counter, cast(coalesce(sum({c}), 0) as bigint) as total, count(*) filter ({c} > 0) as memories from memories" for c in COUNTERS))
def agg_13(spark, d):
    return L.counter_inventory(table(spark, d, "memories"), COUNTERS)


@query("agg_14", "select state, cast(sum(retrieved_count) as bigint) as retrieved, cast(sum(used_count) as bigint) as used, count(*) filter (retrieved_count > 0 and used_count = 0) as never_used, round(case when sum(retrieved_count) > 0 then sum(used_count) / sum(retrieved_count) end, 6) as used_share from memories group by state")
def agg_14(spark, d):
    return L.counter_separation(table(spark, d, "memories"))


@query("agg_15", "select case when used_count = 0 then '0' when used_count / retrieved_count < 0.25 then '<.25' when used_count / retrieved_count < 0.5 then '<.5' else '>=.5' end as bucket, count(*) as memories, round(avg(helpful_count), 6) as avg_helpful from memories where retrieved_count >= 5 group by 1")
def agg_15(spark, d):
    return L.use_buckets(table(spark, d, "memories"))


@query("agg_16", "select kind, count(*) as memories, count(*) filter (coalesce(retrieved_count, 0) = 0) as never_retrieved from memories group by kind")
def agg_16(spark, d):
    return L.never_retrieved(table(spark, d, "memories"), "kind")


@query("agg_17", "select state, count(*) as n, count(*) filter (pinned) as pinned, count(*) filter (protected) as protected, count(*) filter (dirty) as dirty, count(*) filter (stranded) as stranded, count(supersedes_id) as superseding from memories group by state")
def agg_17(spark, d):
    return L.lifecycle_histogram(table(spark, d, "memories"))


@query("agg_18", "select source_type, count(*) as memories, count(recorded) as with_source, count(*) filter (epoch_us(recorded) > epoch_us(observed_at) + 3600000000) as stale from memories left join (select memory_id, max(system_from) as recorded from memory_versions group by 1) v on v.memory_id = id group by source_type")
def agg_18(spark, d):
    return L.staleness(table(spark, d, "memories"), table(spark, d, "memory_versions"))


@query(
    "agg_19",
    ONCE
    + """, s as (select memory_id, count(*) as n, count(*) filter (outcome in ('helpful', 'validated')) as p, count(*) filter (outcome in ('harmful', 'corrected')) as g, count(*) filter (used) as u, count(*) filter (outcome = 'ignored') as i from once where outcome not in ('pending', 'withheld') group by 1)
select memory_id, n as observations, p as positive, g as negative, u as used, i as ignored, round(least(greatest((p + 1.5) / (n + 3.0) + 0.15 * u / n - 0.45 * g / n - 0.25 * i / n, 0.0), 1.0), 6) as usefulness from s""",
)
def agg_19(spark, d):
    return L.context_feedback(_usage(spark, d, "memory_id", "outcome", "used"), ["memory_id"])


@query("agg_21", f"select topic, count(*) as n, round(sum(pow(0.5, greatest((epoch_us(timestamp '{AS_OF}') - epoch_us(last_helpful_at)) / 86400000000.0, 0.0) / 30.0)), 6) as weight from (select unnest(entities) as topic, last_helpful_at from memories where last_helpful_at is not null) group by topic")
def agg_21(spark, d):
    return L.topic_weights(table(spark, d, "memories"), F.lit(AS_OF).cast("timestamp"))


@query(
    "agg_22",
    ONCE
    + """, s as (select kind, source_type, count(*) as n, count(*) filter (outcome in ('helpful', 'validated')) as k from once join (select id, kind, source_type from memories) m on m.id = memory_id where outcome in ('helpful', 'validated', 'harmful', 'corrected') group by 1, 2),
t as (select *, sum(n) over (partition by kind) as kn, sum(k) over (partition by kind) as kk, sum(n) over () as an, sum(k) over () as ak from s)
select kind, source_type, n, k, case when n >= 4 then 'task_source' when kn >= 4 then 'task' when an >= 4 then 'global' else 'prior' end as rung, round(case when n >= 4 then (k + 2.0) / (n + 4.0) when kn >= 4 then (kk + 2.0) / (kn + 4.0) when an >= 4 then (ak + 2.0) / (an + 4.0) else 0.5 end, 6) as probability from t""",
)
def agg_22(spark, d):
    return L.calibration(_usage(spark, d, "memory_id", "outcome"), table(spark, d, "memories"))


@query(
    "agg_23",
    ONCE
    + """, s as (select attribution as p, case when outcome in ('helpful', 'validated') then 1.0::double else 0.0::double end as y from once where outcome in ('helpful', 'validated', 'harmful', 'corrected', 'ignored') and attribution is not null and not isnan(attribution))
select cast(least(floor(p * 10), 9) as int) as bin, count(*) as n, round(avg(p), 6) as forecast, round(avg(y), 6) as observed, round(avg((p - y) * (p - y)), 6) as brier, round(abs(avg(p) - avg(y)), 6) as gap from s group by 1""",
)
def agg_23(spark, d):
    return L.calibration_error(_usage(spark, d, "attribution", "outcome"))


@query(
    "agg_24",
    ONCE
    + ", s as (select cast(cast(created_at as date) as varchar) as day, used, outcome, cast(ceil(length(content) / 4.0) as bigint) as tokens from once join (select id, content from memories) m on m.id = memory_id where selected) select day, round(count(*) filter (used) / count(*), 6) as precision, round(case when count(*) filter (used) > 0 then count(*) filter (outcome in ('helpful', 'validated')) / count(*) filter (used) end, 6) as helpfulness, round(count(*) filter (outcome in ('harmful', 'corrected')) / count(*), 6) as false_positive_rate, cast(sum(tokens) as bigint) as tokens, cast(sum(case when not used then tokens else 0 end) as bigint) as unused_tokens, round(case when sum(tokens) > 0 then sum(case when not used then tokens else 0 end) / sum(tokens) end, 6) as waste from s group by day",
)
def agg_24(spark, d):
    return L.token_waste(_usage(spark, d, "memory_id", "created_at", "selected", "used", "outcome"), table(spark, d, "memories"))


@query("agg_25", ONCE + ", s as (select memory_id, count(distinct cast(created_at as date)) as days, count(distinct session_id) as sessions, count(distinct task_id) as tasks from once where outcome in ('helpful', 'validated') group by 1) select *, round((0.5 * days + 0.25 * sessions + 0.25 * tasks) / (0.5 * days + 0.25 * sessions + 0.25 * tasks + 3.0), 6) as strength from s")
def agg_25(spark, d):
    return L.spaced_reinforcement(_usage(spark, d, "memory_id", "created_at", "session_id", "task_id", "outcome"))


@query("agg_27", "select event_type as tool, user_id % 10 as context, count(*) as calls, count(*) filter (value > 50) as successes, count(distinct user_id) as contexts, count(distinct user_id) >= 2 as reinforced from events group by 1, 2")
def agg_27(spark, d):
    return L.tool_statistics(table(spark, d, "events"))


@query("agg_28", "with s as (select scope['project'] as name, session_id from memories where scope['project'] is not null) select name, count(*) as memories, count(distinct session_id) as sessions, count(*) >= 5 and count(distinct session_id) >= 2 as admitted from s group by name")
def agg_28(spark, d):
    return L.admitted_groups(table(spark, d, "memories"))


@query("agg_29", f"select model, count(*) as n, round(min(model_total_ms), 6) as least, round(quantile_cont(model_total_ms, 0.5), 6) as p50, round(quantile_cont(model_total_ms, 0.95), 6) as p95, round(quantile_cont(model_total_ms, 0.99), 6) as p99, round(max(model_total_ms), 6) as most from {OBSERVATIONS} where model_total_ms is not null and not isnan(model_total_ms) group by model")
def agg_29(spark, d):
    return L.distribution(table(spark, d, OBSERVATIONS), "model", "model_total_ms")


@query("agg_34", "with s as (select cast(cast(created_at as date) as varchar) as day, count(*) as made from memories group by 1) select day, made, cast(sum(made) over (order by day) as bigint) as capacity from s")
def agg_34(spark, d):
    return L.capacity(table(spark, d, "memories"))


@query(
    "agg_35",
    """select 'edge source' as "check", count(*) as n from edges where src_id is null or src_id not in (select id from memories)
union all select 'edge target', count(*) from edges where dst_id is null or dst_id not in (select id from memories)
union all select 'usage memory', count(*) from usage_records where memory_id is null or memory_id not in (select id from memories)
union all select 'version memory', count(*) from memory_versions where memory_id is null or memory_id not in (select id from memories)
union all select 'self loop', count(*) from edges where src_id = dst_id
union all select 'usage delivered again', count(*) - count(distinct usage_id) from usage_records""",
)
def agg_35(spark, d):
    return L.audit(*[table(spark, d, t) for t in ("memories", "edges", "usage_records", "memory_versions")])
