"""Queries of filters and scalar functions, each one expression over a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from evimem.functions import text as T
from evimem.functions.numbers import clamp, days_between, r6
from evimem.operators import ledger as L
from evimem.operators import links as K
from evimem.operators import retrieval as R
from evimem.operators.upkeep import work_queue
from evimem.plans.ledger import ONCE
from evimem.plans.links import LIKENESS, PAIRS, _pairs, likened
from evimem.plans.registering import AS_OF, registrar
from evimem.plans.text import NORMAL, SENTENCES, STOPS
from evimem.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registrar(QUERIES, SQL)
NOW = f"timestamp_ntz '{AS_OF}'"


@query("flt_1", "select id, state from memories where state in ('active', 'cold')")
def flt_1(spark, d):
    return table(spark, d, "memories").where(F.col("state").isin("active", "cold")).select("id", "state")


@query("flt_3", f"select id, round(coalesce(currentness_confidence, 0.7) * case when timestamp '{AS_OF}' < valid_from then 0.25 when timestamp '{AS_OF}' > valid_to then 0.10 else 1.0 end, 6) as currentness from memories")
def flt_3(spark, d):
    return table(spark, d, "memories").select("id", r6(R.currentness(F.expr(NOW))).alias("currentness"))


@query(
    "flt_5",
    r"with s as (select id, scope['project'] as p, coalesce(list_sort(list_distinct(regexp_extract_all(lower(scope['project']), '[a-z0-9]+'))), []) as t from memories) select id, p = 'Lantern Core' or (len(t) > 0 and t = ['core', 'lantern']) as matches from s where p is not null",
)
def flt_5(spark, d):
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("p"), F.lit("([a-z0-9]+)"), 1)))
    rows = table(spark, d, "memories").select("id", F.element_at("scope", "project").alias("p")).where("p is not null")
    return rows.select("id", ((F.col("p") == "Lantern Core") | ((F.size(words) > 0) & (words == F.array(F.lit("core"), F.lit("lantern"))))).alias("matches"))


@query("flt_6", rf"select doc_id from documents where title is not null and len(list_filter(regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}]{{2,}}'), lambda x: x not in {STOPS})) > 0")
def flt_6(spark, d):
    return table(spark, d, "documents").where(F.size(T.tokens(F.col("title"))) > 0).select("doc_id")


@query("flt_11", "select src_id, dst_id, relation, weight from edges where relation in ('co_used', 'useful_together', 'related', 'supports') and weight >= 0.5 and evidence_count >= 2")
def flt_11(spark, d):
    return table(spark, d, "edges").where("relation in ('co_used', 'useful_together', 'related', 'supports') and weight >= 0.5 and evidence_count >= 2").select("src_id", "dst_id", "relation", "weight")


@query("flt_12", "select id from memories where source_type in ('conversation', 'reflection') and not protected and (lower(content) like '%never run%' or lower(content) like '%decision:%')")
def flt_12(spark, d):
    low = F.lower("content")
    return table(spark, d, "memories").where(F.col("source_type").isin("conversation", "reflection") & ~F.col("protected") & (low.contains("never run") | low.contains("decision:"))).select("id")


@query("flt_14", "select substr(id, 1, 6) as prefix, min(id) as id from memories group by 1 having count(*) = 1")
def flt_14(spark, d):
    return table(spark, d, "memories").groupBy(F.substring("id", 1, 6).alias("prefix")).agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n = 1").drop("n")


@query("scl_10", "select usage_id, score, round(case when coalesce(score, 8.0) - 0.5 <= 0 then abs(score - 0.5) / (1 + abs(score - 0.5)) else 1 / (1 + coalesce(score - 0.5, 7.5)) end, 6) as relevance from (select distinct usage_id, score from usage_records)")
def scl_10(spark, d):
    rank = F.coalesce("score", F.lit(8.0)) - 0.5
    return table(spark, d, "usage_records").select("usage_id", "score").distinct().select("usage_id", "score", r6(R.relevance(rank)).alias("relevance"))


# Words of a query and the words that expand it.
GROUPS = [
    (("format", "response", "respond", "style", "answer"), ("prefer", "preference", "concise", "summary", "detail")),
    (("fix", "broken", "error", "issue", "problem"), ("workaround", "resolved", "verified", "root", "cause")),
    (("where", "location", "path", "host", "hosted"), ("runs", "stored", "server", "backend")),
    (("decision", "choose", "choice", "approach"), ("decided", "chose", "picked", "uses")),
]
_IN = lambda words: ", ".join(f"'{w}'" for w in words)


@query(
    "scl_11",
    "with s as (select id, content, regexp_extract_all(lower(content), '[\\p{L}\\p{N}]{2,}') as w from memories), a as (select id, content, list_sort(list_distinct("
    + " || ".join(f"case when list_has_any(w, [{_IN(a)}]) then [{_IN(b)}] else [] end" for a, b in GROUPS)
    + ")) as x from s) select id, case when len(x) > 0 then content || ' ' || array_to_string(x, ' ') else content end as expanded from a",
)
def scl_11(spark, d):
    words = T.tokens(F.col("content"))
    lists = [F.when(F.arrays_overlap("w", F.array(*map(F.lit, a))), F.array(*map(F.lit, b))).otherwise(F.array().cast("array<string>")) for a, b in GROUPS]
    rows = table(spark, d, "memories").select("id", "content", words.alias("w")).select("id", "content", F.array_sort(F.array_distinct(F.concat(*lists))).alias("x"))
    return rows.select("id", F.when(F.size("x") > 0, F.concat_ws(" ", "content", F.array_join("x", " "))).otherwise(F.col("content")).alias("expanded"))


@query("scl_20", "with x as (select label, k, avg(e) as m from (select label, generate_subscripts(embedding, 1) as k, unnest(embedding)::double as e from embeddings) group by 1, 2), c as (select label, list(m order by k) as v from x group by 1) select vec_id, round(list_cosine_similarity(embedding::double[], v), 5) as similarity from embeddings join c using (label)")
def scl_20(spark, d):
    e = table(spark, d, "embeddings")
    means = e.select("label", F.posexplode("embedding").alias("k", "x")).groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("x")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("mean"))
    return e.join(means, "label").select("vec_id", F.round(R.cosine(F.col("embedding"), F.col("mean")), 5).alias("similarity"))


@query("scl_26", f"with {SENTENCES} select id, k as place, s as part from sents where length(s) >= 12 and k < 6")
def scl_26(spark, d):
    parts = F.posexplode(T.sentences(F.col("content"))).alias("k", "s")
    return table(spark, d, "memories").select("id", parts).select("id", F.col("k").cast("bigint").alias("place"), F.trim("s").alias("part")).where("length(part) >= 12 and place < 6")


@query("scl_26_all", f"with {SENTENCES}, n as (select id, s, row_number() over (partition by id order by k) - 1 as place from sents where length(s) >= 12) select id, place, s as part from n where place < 6")
def scl_26_all(spark, d):
    """The first six parts of a text; scl_26, as its SQL, looks at the first six sentences only, short ones among them."""
    rows = table(spark, d, "memories").select("id", F.posexplode(T.parts(F.col("content"))).alias("place", "part"))
    return rows.select("id", F.col("place").cast("bigint").alias("place"), "part")


@query("scl_39", f"select id, round(least(greatest(0.15 * least(retrieved_count, 5) + 0.30 * least(helpful_count, 5) - 0.50 * least(harmful_count, 5), 0.0), 1.0) * pow(0.995, greatest((epoch_us(timestamp '{AS_OF}') - epoch_us(updated_at)) / 86400000000.0, 0.0)), 6) as strength from memories")
def scl_39(spark, d):
    n = lambda c: F.least(F.col(c), F.lit(5))
    base = clamp(0.15 * n("retrieved_count") + 0.30 * n("helpful_count") - 0.50 * n("harmful_count"))
    return table(spark, d, "memories").select("id", r6(base * F.pow(F.lit(0.995), F.greatest(days_between(F.expr(NOW), F.col("updated_at")), F.lit(0.0)))).alias("strength"))


@query("scl_41", "select src_id, dst_id, relation, round(least(1.0::double, max(coalesce(weight, 0)) + least(0.18::double, 0.04 + 0.02 * ln(1 + sum(evidence_count)))), 6) as weight from edges group by 1, 2, 3")
def scl_41(spark, d):
    add = F.least(F.lit(0.18), 0.04 + 0.02 * F.log1p(F.sum("evidence_count")))
    return table(spark, d, "edges").groupBy("src_id", "dst_id", "relation").agg(r6(F.least(F.lit(1.0), F.max(F.coalesce("weight", F.lit(0.0))) + add)).alias("weight"))


@query("scl_42", PAIRS + f", asked as (select distinct src_id, dst_id from pairs), {LIKENESS} select task_id, pairs.src_id, pairs.dst_id, round(greatest(0.05, least(a.confidence, b.confidence) * (0.75 + 0.25 * similarity)), 6) as score from pairs join liking using (src_id, dst_id) join memories a on a.id = pairs.src_id join memories b on b.id = pairs.dst_id")
def scl_42(spark, d):
    """Replay score of each pair: the weaker record's confidence, a quarter of it by likeness."""
    m = table(spark, d, "memories")
    one, two = m.select(F.col("id").alias("src_id"), F.col("confidence").alias("a")), m.select(F.col("id").alias("dst_id"), F.col("confidence").alias("b"))
    return likened(_pairs(spark, d), m).join(one, "src_id").join(two, "dst_id").select("task_id", "src_id", "dst_id", K.replay_score(F.col("a"), F.col("b"), F.col("similarity")).alias("score"))


@query("scl_44", "select id, concat_ws(' · ', source_type, case when approval_state <> 'unreviewed' then replace(approval_state, '_', ' ') end, case when pinned then 'pinned' end, strftime(observed_at, '%Y-%m-%d')) as label from memories")
def scl_44(spark, d):
    parts = ["source_type", F.when(F.col("approval_state") != "unreviewed", F.replace("approval_state", F.lit("_"), F.lit(" "))), F.when(F.col("pinned"), "pinned"), F.date_format("observed_at", "yyyy-MM-dd")]
    return table(spark, d, "memories").select("id", F.concat_ws(" · ", *parts).alias("label"))


@query(
    "set_3",
    rf"""with w as (select id, list_distinct(regexp_extract_all(lower({NORMAL.format('content')}), '[\p{{L}}\p{{N}}]{{2,}}')) as t from memories), e as (select distinct src_id, dst_id from edges where relation = 'supersedes' and src_id <> dst_id)
select src_id, dst_id, round(len(list_intersect(a.t, b.t)) / greatest(1, len(list_distinct(a.t || b.t))), 6) as jaccard from e join w a on a.id = src_id join w b on b.id = dst_id""",
)
def set_3(spark, d):
    words = F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(r"([\p{L}\p{N}]{2,})"), 1))
    w = table(spark, d, "memories").select("id", words.alias("t"))
    pairs = table(spark, d, "edges").where("relation = 'supersedes' and src_id <> dst_id").select("src_id", "dst_id").distinct()
    both = pairs.join(w.select(F.col("id").alias("src_id"), F.col("t").alias("a")), "src_id").join(w.select(F.col("id").alias("dst_id"), F.col("t").alias("b")), "dst_id")
    return both.select("src_id", "dst_id", r6(F.size(F.array_intersect("a", "b")) / F.greatest(F.lit(1), F.size(F.array_union("a", "b")))).alias("jaccard"))


_PENDING = f", p as (select usage_id, created_at, created_at < timestamp '{AS_OF}' - interval 12 hour as due from once where outcome = 'pending'), new as (select * from (select * from p order by created_at desc, usage_id limit 100) where due)"


@query("sel_12", ONCE + _PENDING + " select usage_id from new union all select usage_id from (select * from p where due and (select count(*) from new) = 0 order by created_at, usage_id limit 100)")
def sel_12(spark, d):
    """Pending uses to be settled next: of the newest those that are old enough, or else the oldest."""
    rows = L.delivered_once(table(spark, d, "usage_records"), "created_at", "outcome").where("outcome = 'pending'")
    return work_queue(rows, "created_at", "usage_id", F.col("created_at") < F.expr(f"{NOW} - interval 12 hours"), 100).select("usage_id")


@query("ext_5", f"select id, valid_to, case when valid_to < timestamp '{AS_OF}' then 'overdue' when valid_to is null then 'open' else 'due later' end as due from memories where kind = 'prospective'")
def ext_5(spark, d):
    due = F.when(F.col("valid_to") < F.expr(NOW), "overdue").when(F.col("valid_to").isNull(), "open").otherwise("due later")
    return table(spark, d, "memories").where("kind = 'prospective'").select("id", "valid_to", due.alias("due"))


@query("ext_8", "with e as (select case when relation = 'contradicts' then least(src_id, dst_id) else src_id end as src_id, case when relation = 'contradicts' then greatest(src_id, dst_id) else dst_id end as dst_id, relation, weight from edges where src_id <> dst_id) select src_id, dst_id, relation, max(weight) as weight from e group by 1, 2, 3")
def ext_8(spark, d):
    both_ways = F.col("relation") == "contradicts"
    one, two = F.when(both_ways, F.least("src_id", "dst_id")).otherwise(F.col("src_id")), F.when(both_ways, F.greatest("src_id", "dst_id")).otherwise(F.col("dst_id"))
    return table(spark, d, "edges").where("src_id <> dst_id").select(one.alias("src_id"), two.alias("dst_id"), "relation", "weight").groupBy("src_id", "dst_id", "relation").agg(F.max("weight").alias("weight"))
