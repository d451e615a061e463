"""Queries of upkeep: lifecycle, repair proposals, budgets, the role gate, fusion, the two-level bootstrap."""

from __future__ import annotations

from pyspark.sql import functions as F

from evimem.functions.text import tokens
from evimem.operators import evaluation as E
from evimem.operators import ledger as L
from evimem.operators import links as K
from evimem.operators import retrieval as R
from evimem.operators import upkeep as U
from evimem.plans.context import CONTEXT, _contexts
from evimem.plans.ledger import ONCE
from evimem.plans.registering import AS_OF, registrar
from evimem.plans.retrieval import BM25, LEXICAL, NOW, SCORED, SIGNALS, _candidates, _live, _signals, scored
from evimem.plans.text import _q
from evimem.session import written
from evimem.sources.tables import OBSERVATIONS, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registrar(QUERIES, SQL)

_KINDS = ", ".join(f"'{k}'" for k in U.DURABLE_KINDS)


@query(
    "slp_6",
    f"""with m as (select id, state, (epoch_us(timestamp '{AS_OF}') - epoch_us(greatest(last_used_at, last_helpful_at, updated_at))) / 86400000000.0 as idle from memories
where not coalesce(pinned, false) and not coalesce(protected, false) and kind not in ({_KINDS}) and coalesce(helpful_count + validated_count, 0) < 3)
select id, state, case state when 'active' then 'cold' else 'archived' end as proposed from m where (state = 'active' and idle >= 90) or (state = 'cold' and idle >= 180)""",
)
def slp_6(spark, d):
    """Which records would cool or be archived."""
    return U.lifecycle(table(spark, d, "memories"), F.expr(NOW))


@query(
    "slp_3",
    f"""with l as (select * from memories where state in ('active', 'cold') order by metadata_completeness nulls first, updated_at, id limit 1000)
select id, round(greatest(0.25, 1 - coalesce(metadata_completeness, 0)), 6) as score, array_to_string(list_filter([case when cardinality(scope) = 0 then 'scope' end, case when len(entities) = 0 then 'entities' end, case when trim(coalesce(source_context, '')) = '' then 'source context' end, case when cardinality(preconditions) = 0 then 'preconditions' end], lambda x: x is not null), ', ') as missing from l
where (context_mode = 'context_dependent' and coalesce(metadata_completeness, 0) < 0.75) or (context_mode = 'standalone' and trim(coalesce(source_context, '')) = '' and len(entities) = 0 and regexp_matches(content, {_q(U.CONTEXTLESS)}, 'i'))""",
)
def slp_3(spark, d):
    """Records that may be ambiguous outside their context, and what they lack."""
    return U.repair_proposals(table(spark, d, "memories"))


@query(
    "agg_20",
    ONCE
    + """, u as (select kind, context_mode, outcome, length(content) as tokens from once join memories m on m.id = memory_id where outcome not in ('pending', 'withheld')),
t as (select kind, context_mode, count(*) as n, count(*) filter (outcome = 'ignored') as i, count(*) filter (outcome in ('helpful', 'validated')) as g, sum(tokens) as s from u group by 1, 2),
w as (select *, sum(n) over m as nm, sum(i) over m as im, sum(g) over m as gm, sum(s) over m as sm from t window m as (partition by context_mode))
select kind, context_mode, n as samples, round(i / n, 6) as ignored_share, case when n >= 8 then 'task_mode' when nm >= 16 then 'mode' else 'none' end as scope,
case when n >= 8 then case when i = n then 510 when g * 2 >= n and s >= 540 * n then 660 else 600 end when nm >= 16 then case when im = nm then 510 when gm * 2 >= nm and sm >= 540 * nm then 660 else 600 end else 600 end as budget from w""",
)
def agg_20(spark, d):
    """Budgets by kind and context mode, from resolved uses; a record's characters stand for the tokens that a recall spent."""
    usage = L.delivered_once(table(spark, d, "usage_records"), "memory_id", "outcome")
    # a hot memory is a few rows, one an outcome, before it meets its record
    per = usage.groupBy("memory_id", "outcome").agg(F.count("*").alias("times"))
    records = table(spark, d, "memories").select(F.col("id").alias("memory_id"), "kind", "context_mode", F.length("content").alias("tokens"))
    return U.budgets(per.join(records, "memory_id"), "kind", "context_mode", 600, times="times")


@query(
    "agg_32_nested",
    f"""with c as (select cast(cast(run_at as date) as varchar) as cluster, label, sum(correct::int) as total, count(*) as n from {OBSERVATIONS} group by 1, 2),
k as (select cluster, row_number() over (order by cluster) - 1 as k, count(*) over () as m from (select distinct cluster from c)),
i as (select cluster, total, n, row_number() over (partition by cluster order by label nulls first) - 1 as i, count(*) over (partition by cluster) as mi from c),
d as (select b, k as place, cast('0x' || substr(md5('7:' || b || ':' || k), 1, 8) as bigint) % m as pick from k, range(1, 1001) r(b)),
e as (select b, place, k.cluster from d join k on k.k = pick),
f as (select b, e.cluster, cast('0x' || substr(md5('7:' || b || ':' || place || ':' || i), 1, 8) as bigint) % mi as inner_pick from e join i on i.cluster = e.cluster),
m as (select b, sum(total) / sum(n) as mean from f join i on i.cluster = f.cluster and i.i = inner_pick group by 1)
select count(*) as draws, round(quantile_cont(mean, 0.025), 6) as low, round(quantile_cont(mean, 0.5), 6) as middle, round(quantile_cont(mean, 0.975), 6) as high from m""",
)
def agg_32_nested(spark, d):
    """Interval of the share of right answers: days are drawn, and within each drawn day its labels; 1,000 draws of all cells."""
    cells = table(spark, d, OBSERVATIONS).groupBy(F.to_date("run_at").cast("string").alias("cluster"), "label").agg(F.count_if("correct").alias("total"), F.count("*").alias("n"))
    return E.nested_bootstrap(cells, "label", 1000)


@query(
    "flt_13",
    f"""with {BM25}, {LEXICAL}, {SIGNALS}, {SCORED}, {CONTEXT},
g as (select j.query_id, j.id, m.record_role as role, j.lexical, j.phrase, j.currentness, greatest(scope_match * (cardinality(f.scope) > 0)::int, entity_match * (len(f.entities) > 0)::int, system_match * (len(f.systems) > 0)::int, version_match * (len(f.versions) > 0)::int, precondition_match * (cardinality(f.preconditions) > 0)::int) as support,
len(list_filter(regexp_extract_all(lower(f.title), '[a-z0-9_./-]+'), lambda t: regexp_matches(t, '[0-9_./-]') and contains(lower(m.content), t))) > 0 as technical
from joined j join full_context f on f.query_id = j.query_id and f.id = j.id join memories m on m.id = j.id)
select query_id, id, role, case role when 'reference' then greatest(lexical, phrase) >= 0.22 or support > 0 or technical when 'event' then currentness >= 0.35 or greatest(lexical, phrase) >= 0.30 else role <> 'claim' end as admitted from g""",
)
def flt_13(spark, d):
    """Which lexical candidates of the stated queries the role gate lets in."""
    parts = ("scope", "entity", "system", "version", "precondition")
    has = {"scope": "scope", "entity": "entities", "system": "systems", "version": "versions", "precondition": "preconditions"}
    support = F.greatest(*[F.when(F.size(has[p]) > 0, F.col(f"{p}_match")).otherwise(0.0) for p in parts])
    technical = F.exists(F.filter(F.regexp_extract_all(F.lower("query"), F.lit(r"([a-z0-9_./-]+)"), 1), lambda t: t.rlike(r"[0-9_./-]")), lambda t: F.lower("content").contains(t))
    candidates = written(_candidates(spark, d), "candidates")
    # texts meet the candidates once and go no further
    pairs = _contexts(spark, d, candidates, "content", "record_role").select("query_id", "id", F.col("record_role").alias("role"), F.col("project").alias("asked_project"), R.phrase_match().alias("phrase"), support.alias("support"), technical.alias("technical"))
    signals, marks = _signals(spark, d, _live(spark, d)).drop("content"), K.flags(table(spark, d, "memories"), table(spark, d, "edges"))
    rows = R.weighted(R.lexical(candidates).join(signals, "id").join(marks, "id", "left").join(pairs, ["query_id", "id"]))
    return U.role_gate(rows).select("query_id", "id", "role", "admitted")


@query("gr_3")
def gr_3(spark, d):
    """Results of the stated queries lifted by the rank of their features' likeness. Features of both sides have no short SQL; it is tested."""
    from pyspark.sql import Window

    from evimem.plans.retrieval import _live, _queries
    from evimem.plans.text import feature_lists
    from evimem.session import written

    asked = _queries(spark, d).where(F.size(tokens(F.col("text"))) > 0)
    near = R.by_features(feature_lists(asked.select(F.col("query_id").alias("id"), F.col("text").alias("content"))).withColumnRenamed("id", "query_id"), feature_lists(_live(spark, d).select("id", "content")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("feature_score"), "id")) - 1
    semantic = written(near.select("query_id", "id", rank.alias("rank"), F.col("feature_score").alias("similarity")), "semantic")
    lexical = R.ranked(scored(spark, d), 48).select("query_id", "id", "score")
    # what only its features found starts from its activation, as it shares no word with the query
    signals = table(spark, d, "memories").where(F.col("state").isin("active", "cold")).select("id", r_score().alias("score"))
    return U.fused(lexical, semantic, semantic.select("query_id", "id").join(signals, "id"), weight=10.0)


def r_score():
    """The share of a record's score that does not depend on the query: importance and confidence with their weights."""
    return F.round(0.06 * F.coalesce("importance", F.lit(0.0)) + 0.05 * F.coalesce("confidence", F.lit(0.0)), 6)
