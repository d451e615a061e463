"""Queries of document sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from evimem.operators import ledger as L
from evimem.plans.ledger import ONCE
from evimem.plans.registering import AS_OF, registrar
from evimem.sources import documents as D
from evimem.sources.tables import OBSERVATIONS, table
from evimem.streaming import rollups as S

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registrar(QUERIES, SQL)


@query(
    "src_3",
    r"""with l as (select doc_id, generate_subscripts(x, 1) as k, unnest(x) as a from (select doc_id, string_split(text, chr(10)) as x from documents where text is not null)),
p as (select doc_id, k - 1 as turn, a, lead(a) over (partition by doc_id order by k) as b from l),
t as (select doc_id, turn, substr(a, 7) as user_content, substr(b, 12) as assistant_content from p where starts_with(a, 'User: ') and starts_with(b, 'Assistant: '))
select doc_id, min(turn) as turn, user_content, assistant_content, md5(user_content || '|' || assistant_content) as content_hash from t group by doc_id, user_content, assistant_content""",
)
def src_3(spark, d):
    return D.turns(table(spark, d, "documents"), "doc_id", "text")


@query("src_7", "select 'fact-' || lpad(i::varchar, 5, '0') as label, 'project-' || lpad((i // 8)::varchar, 5, '0') as project, ['owner', 'region', 'port', 'version', 'backup', 'channel', 'schedule', 'review'][i % 8 + 1] as attribute, substr(md5('7:' || i), 1, 8) as value, 'The ' || attribute || ' of ' || project || ' is ' || value as content from range(0, 2000) r(i)")
def src_7(spark, d):
    return D.synthetic_facts(spark, 2000)


@query("src_11", "select doc_id from documents where doc_id not in (select vec_id from embeddings)")
def src_11(spark, d):
    have = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return D.missing(table(spark, d, "documents").select("doc_id"), have, "doc_id")


@query("scl_35")
def scl_35(spark, d):
    """The sections of all notes; a line parser with state, tested on small texts."""
    notes = table(spark, d, "documents").where("source = 'vault_markdown'")
    return D.document_sections(notes, "doc_id", "text").withColumn("links", F.array_join("links", ","))


@query("snk_3", "select '{\"evidence_count\":' || evidence_count || ',\"relation\":\"' || relation || '\",\"src_id\":\"' || src_id || '\"}' as line from edges where src_id is not null and relation is not null and evidence_count is not null")
def snk_3(spark, d):
    return D.as_json_lines(table(spark, d, "edges").where("src_id is not null and relation is not null and evidence_count is not null").select("src_id", "relation", "evidence_count"))


@query("str_9", "select cast(cast(ts as date) as varchar) as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def str_9(spark, d):
    found = S.daily_rollup(spark, f"{d}/events.parquet", "ts", "event_type", "value", "400 days")
    return found.withColumn("total", F.round("total", 4))


@query("str_4", f"select condition, count(*) as n from (select distinct on (observation_id) observation_id, condition from {OBSERVATIONS} where observation_id is not null and received_at is not null) group by 1")
def str_4(spark, d):
    return S.counted_once(spark, f"{d}/{OBSERVATIONS}.parquet", "observation_id", "received_at", "condition", "400 days")


@query(
    "str_7",
    """with o as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end as fresh from events where user_id is not null and ts is not null),
s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from o)
select user_id, count(*) as events, epoch_us(min(ts)) as first_us, epoch_us(max(ts)) as last_us from s group by user_id, k""",
)
def str_7(spark, d):
    return S.sessions(table(spark, d, "events"), "user_id", "ts")


@query(
    "str_3",
    ONCE
    + f", done as (select task_id, max_by(outcome, (resolved_at, usage_id)) as o from once where outcome <> 'pending' and resolved_at is not null group by 1) select usage_id, once.task_id, memory_id, coalesce(o, 'stale') as outcome_now from once left join done on done.task_id = once.task_id where outcome = 'pending' and created_at < timestamp '{AS_OF}' - interval 12 hour",
)
def str_3(spark, d):
    return S.unresolved(L.delivered_once(table(spark, d, "usage_records"), "task_id", "memory_id", "outcome", "created_at", "resolved_at"), F.expr(f"timestamp_ntz '{AS_OF}'"))
