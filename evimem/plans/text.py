"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evimem.functions import text as T
from evimem.functions.numbers import r6
from evimem.plans.registering import AS_OF, registrar
from evimem.session import spread_out
from evimem.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registrar(QUERIES, SQL)


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


NORMAL = r"trim(regexp_replace(coalesce({0}, ''), '[\s\p{{Z}}]+', ' ', 'g'))"


def _redacted(column: str) -> str:
    out = NORMAL.format(column)
    for pattern, by, loose in T.SECRETS:
        plain = pattern.replace(r"(?!(?:stored|saved|managed|kept|located)\b)", "")
        out = f"regexp_replace({out}, {_q(plain)}, {_q(by.replace('$1', chr(92) + '1'))}, {_q('gi' if loose else 'g')})"
    return out


@query("scl_1", f"select id, {NORMAL.format('content')} as content from memories")
def scl_1(spark, d):
    return table(spark, d, "memories").select("id", T.normalized(F.col("content")).alias("content"))


REASONS = "concat_ws(', ', " + ", ".join(f"case when regexp_matches(t, {_q(p)}, 'i') then {_q(r)} end" for r, p in sorted(T.INJECTIONS)) + ")"


@query("scl_3", f"with s as (select id, {_redacted('content')} as t, {NORMAL.format('content')} as n from memories) select id, t as content, nullif({REASONS}, '') as reason, t <> n as redacted from s")
def scl_3(spark, d):
    m = table(spark, d, "memories").select("id", T.normalized(F.col("content")).alias("n"), T.redacted(F.col("content")).alias("content"))
    return m.select("id", "content", T.quarantine_reason(F.col("content")).alias("reason"), (F.col("content") != F.col("n")).alias("redacted"))


@query("scl_4", f"select id, regexp_replace(content, {_q(T.ROLE_TAGS)}, '', 'gi') as content from memories")
def scl_4(spark, d):
    return table(spark, d, "memories").select("id", T.without_role_tags(F.col("content")).alias("content"))


STOPS = "(" + ", ".join(map(_q, T.STOP)) + ")"
TOKENS = rf"tokens as (select distinct id, w from (select id, unnest(regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}]{{2,}}')) as w from memories) where w not in {STOPS})"


@query("scl_5", f"with {TOKENS} select id, count(*) as n_tokens, min(w) as first_token, max(w) as last_token from tokens group by id")
def scl_5(spark, d):
    t = table(spark, d, "memories").select("id", T.tokens(F.col("content")).alias("t")).where("size(t) > 0")
    return t.select("id", F.size("t").cast("bigint").alias("n_tokens"), F.array_min("t").alias("first_token"), F.array_max("t").alias("last_token"))


@query("agg_5", f"with {TOKENS} select w as feature, count(*) as memories from tokens group by w")
def agg_5(spark, d):
    return table(spark, d, "memories").select(F.explode(T.tokens(F.col("content"))).alias("feature")).groupBy("feature").agg(F.count("*").alias("memories"))


def _stem(t: str) -> str:
    whens = " ".join(f"when {t} like '%{s}' and length({t}) - {len(s)} >= 3 then left({t}, length({t}) - {len(s)})" + (" || 'y'" if s == "ies" else "") for s in T.SUFFIXES)
    return f"case when length({t}) < 5 or not regexp_full_match({t}, '\\p{{L}}+') then {t} {whens} else {t} end"


ALIASES = ", ".join(f"('{name}', '{a}')" for name, aliases in T.CONCEPTS.items() for a in aliases)
FEATURES = rf"""
raw as (select id, regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}_~./:@+-]{{2,}}') as r from memories),
each as (select id, generate_subscripts(r, 1) as k, regexp_replace(unnest(r), '^[.,;!?()\[\]{{}}"'']+|[.,;!?()\[\]{{}}"'']+$', '', 'g') as t from raw),
kept as (select * from (select id, t, row_number() over (partition by id order by k) as k from each where t <> '' and t not in {STOPS}) where k <= 48),
stemmed as (select id, k, t, {_stem('t')} as s from kept),
grams as (select id, k, t, g, row_number() over (partition by id, k order by min(n)) as place from (select id, k, t, n, substr('^' || t || '$', n, 3) as g from (select id, k, t, unnest(range(1, length(t) + 1)) as n from kept where length(t) >= 6 and regexp_full_match(t, '\p{{L}}+'))) group by id, k, t, g),
concepts(name, alias) as (values {ALIASES}),
all_features as (
select id, 'tok:' || t as feature, 1.0::double as weight from kept
union all select id, 'stem:' || s, 0.72 from stemmed where s <> t and length(s) >= 3
union all select id, 'tri:' || g, 0.10 from grams where place <= 10
union all select a.id, 'pair:' || a.s || ':' || b.s, 0.58 from stemmed a join stemmed b on a.id = b.id and b.k = a.k + 1
union all select id, 'concept:' || name, 0.88 from stemmed join concepts on alias in (t, s)),
ranked as (select id, feature, max(weight) as weight, row_number() over (partition by id order by max(weight) desc, feature) as place from all_features group by id, feature),
feats as (select id, feature, weight from ranked where place <= 160)"""


def feature_rows(memories):
    """`id, feature, weight`: the up to 160 weightiest features of each record."""
    # exploding a single value keeps the optimizer from putting the tokenizer into every later use
    words = spread_out(memories).select("id", F.explode(F.array(T.feature_tokens(F.col("content")))).alias("w"))
    pairs = words.select("id", F.inline(F.arrays_zip(F.col("w").alias("t"), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))).alias("following"))))
    rows = pairs.select("id", F.inline(T.features(F.col("t"), F.col("following")))).groupBy("id", "feature").agg(F.max("weight").alias("weight"))
    # a record has at most a few hundred features, so its window is small
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("weight"), "feature"))).where("place <= 160").drop("place")


def feature_lists(records):
    """`id, features, weights`: the rows of `feature_rows` as two arrays a record, without a shuffle: a feature's kind alone gives its weight."""
    words = spread_out(records).select("id", F.explode(F.array(T.feature_tokens(F.col("content")))).alias("w"))
    pairs = F.arrays_zip(F.col("w").alias("t"), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))).alias("following"))
    found = F.array_distinct(F.flatten(F.transform(pairs, lambda p: T.features(p["t"], p["following"]))))
    ordered = F.slice(F.array_sort(F.transform(found, lambda f: F.struct((-f["weight"]).alias("less"), f["feature"].alias("feature")))), 1, 160)
    return words.select("id", F.explode(F.array(ordered)).alias("f")).select("id", F.col("f.feature").alias("features"), F.transform("f.less", lambda x: -x).alias("weights"))


@query("scl_6", f"with {FEATURES} select * from feats")
def scl_6(spark, d):
    return feature_rows(table(spark, d, "memories").select("id", "content"))


@query(
    "scl_9",
    f"""with {FEATURES}, sums as (select id, sum(weight) as total from feats group by id), pairs as (select distinct src_id, dst_id from edges where relation in ('contradicts', 'supersedes') and src_id <> dst_id),
shared as (select src_id, dst_id, sum(least(a.weight, b.weight)) as n from pairs join feats a on a.id = src_id join feats b on b.id = dst_id and b.feature = a.feature group by 1, 2)
select p.src_id, p.dst_id, round(least(1.0, coalesce(n, 0) / greatest(1.0, least(coalesce(x.total, 0), coalesce(y.total, 0)))), 6) as similarity from pairs p left join shared s on s.src_id = p.src_id and s.dst_id = p.dst_id left join sums x on x.id = p.src_id left join sums y on y.id = p.dst_id""",
)
def scl_9(spark, d):
    feats = feature_rows(table(spark, d, "memories").select("id", "content"))
    pairs = table(spark, d, "edges").where("relation in ('contradicts', 'supersedes') and src_id <> dst_id").select("src_id", "dst_id").distinct()
    maps = feats.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "weight"))).alias("m"), F.sum("weight").alias("total"))
    ends = lambda side, n: maps.select(F.col("id").alias(f"{side}_id"), F.col("m").alias(f"m{n}"), F.col("total").alias(f"t{n}"))
    both = pairs.join(ends("src", 1), "src_id", "left").join(ends("dst", 2), "dst_id", "left")
    shared = F.aggregate(F.map_keys("m1"), F.lit(0.0), lambda acc, k: acc + F.least(F.element_at("m1", k), F.coalesce(F.element_at("m2", k), F.lit(0.0))))
    total = F.greatest(F.lit(1.0), F.least(F.coalesce("t1", F.lit(0.0)), F.coalesce("t2", F.lit(0.0))))
    return both.select("src_id", "dst_id", r6(F.least(F.lit(1.0), F.coalesce(shared, F.lit(0.0)) / total)).alias("similarity"))


def _score(markers, column: str) -> str:
    return " + ".join(f"(case when regexp_matches({column}, {_q(p)}, 'i') then {w} else 0 end)" for p, w in markers)


DATE = r"list_filter(regexp_extract_all(content, '\b\d{4}-\d{2}-\d{2}\b'), lambda x: try_strptime(x, '%Y-%m-%d') is not null)[1]"
TIMED = r"list_filter(regexp_extract_all(content, '\b\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}'), lambda x: try_strptime(x, '%Y-%m-%dT%H:%M') is not null)[1]"
SLASH = r"list_filter(regexp_extract_all(content, '\b\d{1,2}/\d{1,2}/\d{2,4}\b'), lambda x: cast(string_split(x, '/')[1] as int) between 1 and 12 and cast(string_split(x, '/')[2] as int) between 1 and 31)[1]"
NAMED = r"list_filter(regexp_extract_all(content, '(?i)\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2},?\s+\d{4}\b'), lambda x: try_strptime(regexp_replace(replace(x, ',', ''), '\s+', ' ', 'g'), '%b %d %Y') is not null)[1]"


@query(
    "scl_23",
    f"""with s as (select id, content, coalesce({DATE}, {TIMED}, {NAMED}, {SLASH}) as as_of from memories where trim(content) <> ''),
v as (select id, as_of, {_score(T.VOLATILE, 'content')} + case when as_of is not null and regexp_matches(content, {_q('|'.join(T.DATED_VALUES))}, 'i') then 3 else 0 end as volatile, {_score(T.DURABLE, 'content')} as durable from s)
select id, as_of, volatile, durable, case when volatile = 0 then 'durable' when durable = 0 then 'volatile' when volatile >= 2 then 'mixed' else 'mostly_durable' end as class from v""",
)
def scl_23(spark, d):
    kind, volatile, durable, as_of = T.temporal_class(F.col("content"))
    return table(spark, d, "memories").where("trim(content) <> ''").select("id", as_of.alias("as_of"), volatile.alias("volatile"), durable.alias("durable"), kind.alias("class"))


SENTENCES = rf"sents as (select id, k, trim(s) as s from (select id, generate_subscripts(l, 1) - 1 as k, unnest(l) as s from (select id, string_split_regex(regexp_replace({NORMAL.format('content')}, '([.!?])\s+', '\1' || chr(10), 'g'), '\n|\s*;\s*') as l from memories)))"
KEPT = rf"case when regexp_matches(s, {_q(T.EXPLICIT)}, 'i') then trim(regexp_replace(s, {_q(T.EXPLICIT)}, '', 'i')) else s end"
KINDS = " ".join(f"when regexp_matches(c, {_q(p)}, 'i') then '{k}'" for k, p, *_ in T.STATEMENTS)


@query(
    "scl_27",
    f"""with {SENTENCES}, c as (select id, k, s, {KEPT} as c, regexp_matches(s, {_q(T.EXPLICIT)}, 'i') as explicit from sents where length(s) between 16 and 600),
f as (select id, k, c, case {KINDS} when explicit then 'semantic' end as kind from c where c <> '' and (explicit or not regexp_matches(s, '\\?\\s*$')) and (explicit or not regexp_matches(s, {_q(T.TRANSIENT)}, 'i') or regexp_matches(s, {_q(T.STABLE)}, 'i')))
select id, min(k) as place, min_by(c, k) as content, min_by(kind, k) as kind from f where kind is not null group by id, lower(c)""",
)
def scl_27(spark, d):
    rows = table(spark, d, "memories").select("id", F.posexplode(T.sentences(F.col("content"))).alias("k", "s")).select("id", "k", T.statement(F.trim("s")).alias("x")).where("x is not null")
    return rows.select("id", F.col("k").cast("bigint").alias("k"), "x.*").groupBy("id", F.lower("content").alias("low")).agg(F.min("k").alias("place"), F.min_by("content", "k").alias("content"), F.min_by("kind", "k").alias("kind")).drop("low")


def _cue(name: str) -> str:
    return f"regexp_matches(t, {_q(T.CUES[name])}, 'i')"


_HIST = f"({_cue('historical')} or {_cue('year')})"


@query(
    "scl_28",
    f"""with s as (select doc_id, {NORMAL.format('title')} as t from documents),
m as (select doc_id, t, case when t = '' or {_cue('greeting')} or (({_cue('stateless')} or {_cue('arithmetic')}) and not ({_cue('personal')} or {_cue('decision')} or {_HIST})) then 'none'
when {_cue('attention')} or {_cue('hops')} or ({_HIST} and {_cue('decision')}) then 'deep'
when {_cue('personal')} or {_cue('decision')} or {_HIST} or {_cue('current')} then 'focused' when {_cue('tool')} then 'procedural' else 'lean' end as mode from s)
select doc_id, mode, case when mode = 'none' then 0 else 6 end as "limit", case mode when 'none' then 0 when 'deep' then 680 else 620 end as token_budget, case mode when 'deep' then 0.14::double when 'procedural' then 0.18 when 'lean' then 0.18 else 0.16 end as threshold, case when mode = 'deep' then 2 else 1 end as graph_depth,
case when mode = 'none' or not {_cue('tool')} then 0 when mode = 'focused' then 2 else 3 end as tool_limit, case when mode <> 'none' and {_HIST} then 'historical' else 'current' end as temporal_mode,
case when mode <> 'none' and {_cue('year')} then case when regexp_extract(t, {_q(T.CUES['year'])}, 1) = '2026' then '2026-07-01T00:00:00' else regexp_extract(t, {_q(T.CUES['year'])}, 1) || '-12-31T23:59:59' end end as as_of from m""",
)
def scl_28(spark, d):
    return table(spark, d, "documents").select("doc_id", T.plan(F.col("title"), now=F.lit(AS_OF).cast("timestamp_ntz")).alias("p")).select("doc_id", "p.*")


@query(
    "scl_29",
    f"""with w as (select id, k, regexp_replace(lower(t), '^[._-]+|[._-]+$', '', 'g') as t from (select id, generate_subscripts(l, 1) as k, unnest(l) as t from (select id, regexp_extract_all(content, '[A-Za-z][A-Za-z0-9._-]{{2,31}}') as l from memories))),
f as (select id, t, min(k) as k from w where length(t) >= 3 and t not in ({', '.join(map(_q, T.TOPIC_STOP))}) and not regexp_full_match(t, '\\d+') group by 1, 2),
r as (select *, row_number() over (partition by id order by k) as n from f)
select m.id, coalesce(string_agg(t, ',' order by n), '') as topics from memories m left join r on r.id = m.id and n <= 6 group by m.id""",
)
def scl_29(spark, d):
    return table(spark, d, "memories").select("id", F.array_join(T.topics(F.col("content")), ",").alias("topics"))
