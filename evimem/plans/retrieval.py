"""Queries of retrieval and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evimem.functions.numbers import r6
from evimem.functions.text import tokens
from evimem.operators import evaluation as E
from evimem.operators import ledger as L
from evimem.operators import links as K
from evimem.operators import retrieval as R
from evimem.operators.quantiles import exact_quantiles
from evimem.plans.ledger import ONCE
from evimem.plans.registering import AS_OF, registrar
from evimem.plans.text import STOPS, feature_lists
from evimem.session import written
from evimem.sources.tables import OBSERVATIONS, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registrar(QUERIES, SQL)


def _queries(spark, d):
    """The stated queries: titles of the documents whose id is divisible by 20."""
    return table(spark, d, "documents").where("doc_id % 20 = 0 and title is not null").select(F.col("doc_id").alias("query_id"), F.col("title").alias("text"), "project")


def _live(spark, d):
    return table(spark, d, "memories").where(F.col("state").isin("active", "cold"))


def _candidates(spark, d):
    return R.bm25(_queries(spark, d), _live(spark, d).select("id", F.col("content").alias("text")))


BM25 = rf"""
live as (select * from memories where state in ('active', 'cold')),
post as (select id, term, count(*) as tf from (select id, unnest(regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}]{{2,}}')) as term from live) where term not in {STOPS} group by 1, 2),
sizes as (select id, sum(tf) as len, count(*) as n_record from post group by 1),
total as (select count(*) as n, avg(len) as avg_len from sizes),
freq as (select term, count(*) as df from post group by 1),
asked as (select query_id, term, count(*) over (partition by query_id) as n_query from (select distinct doc_id as query_id, unnest(regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}]{{2,}}')) as term from documents where doc_id % 20 = 0 and title is not null) where term not in {STOPS}),
hits as (select query_id, p.id, -sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) as rank, count(*) as matched, max(n_query) as n_query, max(n_record) as n_record
from asked a join post p using (term) join freq using (term) join sizes s on s.id = p.id cross join total group by 1, 2),
cand as (select * from (select *, row_number() over (partition by query_id order by round(rank, 9), id) as place from hits) where place <= 48)"""


@query("scl_12", f"with {BM25} select query_id, id, round(rank, 6) as rank, place from cand")
def scl_12(spark, d):
    return _candidates(spark, d).select("query_id", "id", r6(F.col("rank")).alias("rank"), F.col("place").cast("bigint").alias("place"))


LEXICAL = """
lex as (select *, matched / greatest(1, n_query + n_record - matched) as overlap, matched / greatest(1, n_query) as coverage, abs(rank) / (1 + abs(rank)) as rel from cand),
lexed as (select *, greatest(overlap, coverage * 0.8, rel * least(1.0, 0.2 + 0.8 * coverage)) as lexical from lex)"""


@query("scl_13", f"with {BM25}, {LEXICAL} select query_id, id, round(overlap, 6) as overlap, round(coverage, 6) as coverage, round(lexical, 6) as lexical from lexed")
def scl_13(spark, d):
    return R.lexical(_candidates(spark, d)).select("query_id", "id", *[r6(F.col(c)).alias(c) for c in ("overlap", "coverage", "lexical")])


def _case(table_: dict, column: str, default: float) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then {v}" for k, v in table_.items()) + f" else {default} end"


def _age(column: str) -> str:
    return f"greatest(coalesce((epoch_us(timestamp '{AS_OF}') - epoch_us({column})) / 86400000000.0, 3650.0), 0.0)"


HALF = f"({_case(R.HALF_LIFE, 'kind', 120.0)})"
# spaced helpful use and unused selections of each memory
REHEARSED = f"""{ONCE.strip().removeprefix('with ')},
spacing as (select memory_id, 0.5 * count(distinct cast(created_at as date)) + 0.25 * count(distinct session_id) + 0.25 * count(distinct task_id) as spread from once where outcome in ('helpful', 'validated') group by 1),
idle as (select memory_id, count(*) filter (selected and not coalesce(used, false)) as unused from once where memory_id is not null group by 1),
rehearsed as (select m.*, coalesce(round(spread / (spread + 3.0), 6), 0) as spaced, coalesce(unused, 0) as unused from memories m left join idle i on i.memory_id = m.id left join spacing s on s.memory_id = m.id)"""
SIGNALS = f"""
{REHEARSED},
base as (select *, success_count + confirmed_count + helpful_count + validated_count as good, false_positive_count + harmful_count as bad from rehearsed),
sig as (select id, kind, state, pinned, content, importance, confidence, uniqueness, coalesce(stranded, false) as stranded, scope['project'] as project, context_mode = 'context_dependent' as dependent,
round(least(greatest(0.54 / (1 + {_age('coalesce(last_helpful_at, updated_at)')} / greatest(1.0, {HALF} * greatest(0.2, 1.15 - volatility))) + 0.28 * least(1.0, ln(1 + 0.25 * least(2, used_count) + 1.5 * success_count + 2.0 * confirmed_count + 1.5 * helpful_count + 2.0 * validated_count) / ln(12.0)) + 0.18 * spaced - 0.10 * least(1.0, unused / 5), 0.0), 1.0), 6) as activation,
round(least(greatest((good + 1.5) / (used_count + 3.0) - 0.7 * bad / greatest(3.0, used_count + bad + 2.0), 0.0), 1.0), 6) as utility,
round(least(greatest(0.55 * ({_case(R.SOURCE_PRIOR, 'coalesce(origin_source_category, source_category)', 0.64)}) + 0.45 * least(greatest(coalesce(trust, 0.0), 0.0), 1.0), 0.0), 1.0), 6) as source_reliability,
round(coalesce(currentness_confidence, 0.7) * case when timestamp '{AS_OF}' < valid_from then 0.25 when timestamp '{AS_OF}' > valid_to then 0.10 else 1.0 end, 6) as currentness,
cast({_case(R.KIND_PRIOR, 'kind', 0.60)} as double) as memory_type,
round(least(1.0, volatility * {_age('updated_at')} / greatest(1.0, {HALF})), 6) as stale_risk,
round(least(1.0, bad / greatest(1, used_count + bad)), 6) as wrong_rate from base)"""
NOW = f"timestamp_ntz '{AS_OF}'"


def _rehearsed(spark, d, memories):
    usage = L.delivered_once(table(spark, d, "usage_records"), "memory_id", "created_at", "session_id", "task_id", "outcome", "selected", "used")
    return memories.join(L.rehearsal(usage), "id", "left")


def _signals(spark, d, memories):
    return R.record_signals(_rehearsed(spark, d, memories), F.expr(NOW))


@query("scl_16", f"with {SIGNALS} select id, activation, utility, source_reliability, currentness, memory_type, stale_risk, wrong_rate from sig")
def scl_16(spark, d):
    """Signals of each record; the activation counts spaced use and unused selections."""
    return _signals(spark, d, table(spark, d, "memories")).select("id", "activation", "utility", "source_reliability", "currentness", "memory_type", "stale_risk", "wrong_rate")


SCORED = f"""
marks as (select id, id in (select dst_id from edges where relation = 'supersedes' and dst_id is not null) as superseded, id in (select unnest([src_id, dst_id]) from edges where relation = 'contradicts') as contradicted from memories),
joined as (select l.query_id, l.id, l.lexical, l.n_query, s.* exclude (id), m.superseded, m.contradicted, coalesce(s.project = d.project, false) as same,
case when length(trim(d.title)) >= 8 and contains(lower(s.content), lower(d.title)) then 1.0 else 0.0 end as phrase
from lexed l join sig s on s.id = l.id join documents d on d.doc_id = l.query_id join marks m on m.id = l.id),
raw as (select *, 0.20 * lexical + 0.06 * phrase + 0.09 * activation + 0.11 * utility + 0.06 * importance + 0.05 * confidence + 0.06 * source_reliability + 0.06 * currentness + 0.03 * memory_type + 0.02 * uniqueness
+ case when same and project is not null then 0.08 else 0.0 end + case when dependent and same then 0.05 else 0.0 end
- case when n_query >= 3 and greatest(lexical, phrase) < 0.28 and not (dependent and same) then 0.12 else 0.0 end - 0.08 * stale_risk - 0.12 * wrong_rate
- 0.15 * contradicted::int - 0.18 * superseded::int + 0.08 * pinned::int - case state when 'cold' then 0.03 when 'archived' then 0.10 else 0.0 end - 0.12 * stranded::int as t from joined),
scored as (select query_id, id, kind, pinned, content, round(least(greatest(case when dependent and project is not null and not same then least(t, 0.01) else t end, 0.0), 1.0), 6) as score from raw),
best as (select * from (select *, row_number() over (partition by query_id order by score desc, pinned desc, id) as result_place from scored) where result_place <= 6)"""


def scored(spark, d):
    return R.scored(_candidates(spark, d), _signals(spark, d, _live(spark, d)), _queries(spark, d), K.flags(table(spark, d, "memories"), table(spark, d, "edges")))


@query("scl_19", f"with {BM25}, {LEXICAL}, {SIGNALS}, {SCORED} select query_id, id, score, result_place from best")
def scl_19(spark, d):
    return R.ranked(scored(spark, d)).select("query_id", "id", "score", "result_place")


def searched(spark, d):
    """`query_id, id, kind, pinned, score, content` over candidates of all sources and the walk from each query's best seeds.

    Candidates: BM25, feature index, the query's project, groups named in the query, due records. Queries without words find nothing.
    """
    asked = _queries(spark, d).where(F.size(tokens(F.col("text"))) > 0)
    live, edges = _live(spark, d), table(spark, d, "edges")
    records = live.select("id", F.col("content").alias("text"))
    scoped = live.select("id", F.element_at("scope", "project").alias("project"), "importance")
    featured = R.by_features(
        feature_lists(asked.select(F.col("query_id").alias("id"), F.col("text").alias("content"))).withColumnRenamed("id", "query_id"),
        feature_lists(live.select("id", "content")),
    )
    groups = L.admitted_groups(table(spark, d, "memories")).where("admitted")
    sources = (R.bm25(asked, records).select("query_id", "id", "rank"), featured, R.by_project(asked, scoped), R.by_neighborhood(asked, scoped, groups), R.due(asked, live, F.expr(NOW)))
    signals, marks = _signals(spark, d, live).drop("content"), K.flags(table(spark, d, "memories"), edges)
    score = lambda c: R.weighted(R.lexical(R.matched_words(c, asked, records)).join(signals, "id").join(marks, "id", "left")).select("query_id", "id", "kind", "pinned", "score")
    # texts are joined again at the end, so that only slim rows are written
    first = written(score(R.united(*sources)), "scored")
    boosts = K.reached(R.seeds(first), edges, depth=1).select(F.col("seed").alias("query_id"), "id", F.col("boost").alias("graph"))
    known, new = R.expanded(first, boosts)
    return known.unionByName(score(new.withColumn("rank", F.lit(None).cast("double")))).join(live.select("id", "content"), "id")


@query("scl_19_all")
def scl_19_all(spark, d):
    """scl_19 over the candidates of all sources; scl_19 itself has the lexical ones that its SQL states."""
    return R.ranked(searched(spark, d)).select("query_id", "id", "score", "result_place")


@query("sel_1")
def sel_1(spark, d):
    """Greedy choice depends on what was chosen before, which SQL cannot say; it is tested against a plain version."""
    return R.selected(searched(spark, d))


@query("sel_5")
def sel_5(spark, d):
    return R.packed(R.ranked(searched(spark, d)))


RANKINGS = """rankings as (select task_id, 'score' as ranking, memory_id as id, row_number() over (partition by task_id order by score desc nulls last, usage_id) - 1 as rank from once where memory_id is not null
union all select task_id, 'attribution', memory_id, row_number() over (partition by task_id order by attribution desc nulls last, usage_id) - 1 from once where memory_id is not null)"""


@query("sel_8", ONCE + f", {RANKINGS}, firsts as (select task_id, ranking, id, min(rank) as rank from rankings group by 1, 2, 3) select task_id, id, round(sum(1.0 / (60 + rank + 1)), 6) as score, count(*) as rankings from firsts group by 1, 2")
def sel_8(spark, d):
    usage = L.delivered_once(table(spark, d, "usage_records"), "task_id", "memory_id", "score", "attribution").where("memory_id is not null")
    rank = lambda c: F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc_nulls_last(c), "usage_id")) - 1
    parts = [usage.select(F.col("task_id").alias("group"), F.lit(c).alias("ranking"), F.col("memory_id").alias("id"), rank(c).alias("rank"), F.lit(1.0).alias("weight")) for c in ("score", "attribution")]
    return R.fused(parts[0].unionByName(parts[1])).withColumnRenamed("group", "task_id")


@query(
    "sel_7",
    "with q as (select vec_id as query_id, embedding::double[] as a from embeddings where vec_id % 20 = 0), s as (select query_id, vec_id as id, list_cosine_similarity(a, embedding::double[]) as c from q join embeddings on vec_id <> query_id), r as (select *, row_number() over (partition by query_id order by c desc, id) as k from s where c > 0) select query_id, id, round(c, 6) as similarity from r where k <= 5",
)
def sel_7(spark, d):
    e = table(spark, d, "embeddings")
    return R.nearest(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")))


@query("sel_10", "select id, pinned, importance from memories where state = 'active' order by pinned desc, importance desc, updated_at desc, id limit 30")
def sel_10(spark, d):
    return table(spark, d, "memories").where("state = 'active'").orderBy(F.desc("pinned"), F.desc("importance"), F.desc("updated_at"), "id").limit(30).select("id", "pinned", "importance")


@query("sel_11", "select id, cast(greatest(12, ceil(length(content) / 4.0) + 18) as bigint) as estimate, cast(greatest(1, ceil(length(content) / 4.0)) as bigint) as rendered from memories")
def sel_11(spark, d):
    quarter = F.ceil(F.length("content") / 4)
    return table(spark, d, "memories").select("id", F.greatest(F.lit(12), quarter + 18).cast("bigint").alias("estimate"), F.greatest(F.lit(1), quarter).cast("bigint").alias("rendered"))


@query("agg_29b", f"select model, quantile_disc(model_total_ms, 0.95) as p95 from {OBSERVATIONS} where not isnan(model_total_ms) group by model")
def agg_29b(spark, d):
    return exact_quantiles(table(spark, d, OBSERVATIONS), "model", "model_total_ms", (0.95,), between=False).select("model", F.col("q")[0].alias("p95"))


@query(
    "agg_30",
    ONCE
    + """, r as (select task_id, outcome in ('helpful', 'validated') as relevant, row_number() over (partition by task_id order by score desc nulls last, usage_id) as place from once where task_id is not null),
s as (select task_id, count(*) filter (relevant) as rel, count(*) filter (relevant and place <= 5) as found, min(case when relevant then place end) as first, sum(case when relevant and place <= 5 then 1 / log2(place + 1.0) else 0.0 end) as dcg from r group by 1)
select task_id, found > 0 as hit, round(case when rel > 0 then found / rel else 0.0 end, 6) as recall, round(found / 5, 6) as precision, round(coalesce(1.0 / first, 0.0), 6) as reciprocal_rank,
round(case when rel > 0 then dcg / list_sum(list_transform(range(1, greatest(1, least(5, rel)) + 1), lambda i: 1 / log2(i + 1.0))) else 0.0 end, 6) as ndcg from s""",
)
def agg_30(spark, d):
    place = F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc_nulls_last("score"), "usage_id"))
    rows = L.delivered_once(table(spark, d, "usage_records"), "task_id", "score", "outcome").where("task_id is not null").select("task_id", F.col("outcome").isin("helpful", "validated").alias("relevant"), place.alias("place"))
    return E.ranking_metrics(rows, "task_id")


@query(
    "agg_31",
    f"with e as (select min(condition) as one, max(condition) as two from {OBSERVATIONS}), s as (select model, label, avg(case when condition = one then correct::int end) as a, avg(case when condition = two then correct::int end) as b from {OBSERVATIONS}, e group by 1, 2) select model, label, round(a, 6) as first_mean, round(b, 6) as last_mean, round(a - b, 6) as delta from s where a is not null and b is not null",
)
def agg_31(spark, d):
    runs = table(spark, d, OBSERVATIONS).withColumn("correct", F.col("correct").cast("int"))
    return E.paired_deltas(runs, ["model", "label"], "condition", "correct")


@query(
    "agg_32",
    f"""with c as (select cast(cast(run_at as date) as varchar) as cluster, sum(correct::int) as total, count(*) as n from {OBSERVATIONS} group by 1),
k as (select *, row_number() over (order by cluster) - 1 as k, count(*) over () as m from c),
d as (select b, cast('0x' || substr(md5('7:' || b || ':' || k), 1, 8) as bigint) % m as pick from k, range(1, 5001) r(b)),
m as (select b, sum(total) / sum(n) as mean from d join k on k.k = pick group by 1)
select count(*) as draws, round(quantile_cont(mean, 0.025), 6) as low, round(quantile_cont(mean, 0.5), 6) as middle, round(quantile_cont(mean, 0.975), 6) as high from m""",
)
def agg_32(spark, d):
    clusters = table(spark, d, OBSERVATIONS).groupBy(F.to_date("run_at").cast("string").alias("cluster")).agg(F.count_if("correct").alias("total"), F.count("*").alias("n"))
    return E.bootstrap(clusters, 5000)


@query("agg_33", f"with s as (select model, avg(correct::int) as q, quantile_cont(memory_prepare_ms, 0.95) as p from {OBSERVATIONS} where memory_prepare_ms > 0 group by 1) select model, round(100 * q, 6) as quality, round(100 * least(1.0, 50 / p), 6) as speed, round(85 * q + 15 * least(1.0, 50 / p), 6) as score from s")
def agg_33(spark, d):
    runs = table(spark, d, OBSERVATIONS).where("memory_prepare_ms > 0 and not isnan(memory_prepare_ms)")
    late = exact_quantiles(runs, "model", "memory_prepare_ms", (0.95,)).select("model", F.col("q")[0].alias("p"))
    rows = runs.groupBy("model").agg(F.avg(F.col("correct").cast("int")).alias("q")).join(late, "model")
    speed = F.least(F.lit(1.0), 50 / F.col("p"))
    return rows.select("model", r6(100 * F.col("q")).alias("quality"), r6(100 * speed).alias("speed"), r6(85 * F.col("q") + 15 * speed).alias("score"))
