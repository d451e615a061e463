"""Queries of context, trust, attribution, tool results, roles, corrections, links and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from evimem.operators import context as C
from evimem.operators import ledger as L
from evimem.operators import retrieval as R
from evimem.plans.ledger import SQL as LEDGER_SQL
from evimem.plans.links import LIKENESS, likened
from evimem.plans.registering import registrar
from evimem.plans.retrieval import BM25, LEXICAL, SCORED, SIGNALS, _candidates, _queries, scored
from evimem.plans.text import _q
from evimem.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registrar(QUERIES, SQL)


def _memberships(memories):
    """Canonical records and events are primary members of the one set, others evidence only; what was quarantined is revoked."""
    kind = F.when(F.col("record_role").isin("canonical", "event"), "primary").otherwise("evidence_only")
    return memories.select(F.col("id").alias("memory_id"), F.lit("live").alias("recall_set_id"), kind.alias("eligibility"), F.when(F.col("quarantine_reason").isNotNull(), F.col("updated_at")).alias("revoked_at"))


@query("flt_2", "select id, state from memories where state in ('active', 'cold') and record_role in ('canonical', 'event') and quarantine_reason is null")
def flt_2(spark, d):
    m = table(spark, d, "memories")
    return C.eligible(m, _memberships(m), "live").select("id", "state")


@query("flt_2_evidence", "select id, state from memories where state in ('active', 'cold', 'archived') and quarantine_reason is null")
def flt_2_evidence(spark, d):
    m = table(spark, d, "memories")
    return C.eligible(m, _memberships(m), "live", evidence_lookup=True, include_archived=True).select("id", "state")


def _label(x: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+')))"


def _same(required: str, actual: str) -> str:
    return f"(case when {actual} is not null and {actual} <> '' and (lower(trim({required})) = lower(trim({actual})) or (len({_label(required)}) > 0 and {_label(required)} = {_label(actual)})) then 1.0 else 0.0 end)"


_NAMED = f"(len({_label('x')}) > 0 and list_has_all({_label('title')}, {_label('x')}))"


def _hits(column: str, test: str) -> str:
    return f"(case when len({column}) > 0 then len(list_filter({column}, lambda x: {test})) / len({column}) else 1.0 end)"


CONTEXT = f"""
pairs as (select query_id, m.id, title, d.project as asked, context_mode = 'context_dependent' as dependent, scope, entities, preconditions, systems, versions from cand join memories m on m.id = cand.id join documents d on d.doc_id = query_id),
matched as (select *, case when cardinality(scope) > 0 then list_sum(list_transform(map_entries(scope), lambda e: case when e.key = 'project' then {_same('e.value', 'asked')} else 0.0 end)) / cardinality(scope) else 1.0 end as scope_match,
case when coalesce(scope['project'], '') <> '' then {_same("scope['project']", 'asked')} else 1.0 end as project_match,
{_hits('entities', f"contains(lower(title), lower(x)) or {_NAMED}")} as entity_match, case when cardinality(preconditions) > 0 then 0.0 else 1.0 end as precondition_match,
{_hits('systems', _NAMED)} as system_match, {_hits('versions', _NAMED)} as version_match from pairs),
needs as (select *, list_filter([case when cardinality(scope) > 0 then scope_match end, case when len(entities) > 0 then entity_match end, case when cardinality(preconditions) > 0 then precondition_match end, case when len(systems) > 0 then system_match end, case when len(versions) > 0 then version_match end], lambda x: x is not null) as s from matched),
full_context as (select *, case when len(s) > 0 then list_sum(s) / len(s) when dependent then 0.0 else 1.0 end as completeness,
case when dependent and ((cardinality(scope) > 0 and scope_match < 0.999) or precondition_match < 0.999 or system_match < 0.999 or version_match < 0.999 or (cardinality(scope) + cardinality(preconditions) + len(systems) + len(versions) = 0 and (len(entities) = 0 or entity_match <= 0))) then 0 else 1 end as gate from needs)"""


def _contexts(spark, d, candidates=None, *more):
    """The candidates of the stated queries beside their records' contexts and `more` columns; a query's context is its project and its words."""
    records = table(spark, d, "memories").select("id", "context_mode", "scope", "entities", "preconditions", "systems", "versions", *more)
    none = F.array().cast("array<string>")
    asking = _queries(spark, d).select("query_id", F.col("text").alias("query"), "project")
    # the records' texts and maps come last and are not shuffled with each query
    rows = (candidates or _candidates(spark, d)).select("query_id", "id").join(asking, "query_id").join(records, "id")
    asked = F.when(F.col("project").isNotNull(), F.create_map(F.lit("project"), "project")).otherwise(F.create_map().cast("map<string,string>"))
    return C.context_match(rows.withColumns({"asked_scope": asked, "asked_state": F.create_map().cast("map<string,string>"), "asked_entities": none, "asked_systems": none, "asked_versions": none}))


@query("flt_4", f"with {BM25}, {CONTEXT} select query_id, id, gate from full_context")
def flt_4(spark, d):
    """The context gate of each candidate."""
    return _contexts(spark, d).select("query_id", "id", "gate")


@query(
    "scl_21",
    f"with {BM25}, {CONTEXT} select query_id, id, round(scope_match, 6) as scope_match, round(entity_match, 6) as entity_match, round(completeness, 6) as completeness, round(0.08 * project_match * (coalesce(scope['project'], '') <> '')::int + 0.05 * entity_match * (len(entities) > 0)::int + 0.07 * scope_match * (cardinality(scope) > 0)::int + 0.07 * precondition_match * (cardinality(preconditions) > 0)::int + 0.04 * system_match * (len(systems) > 0)::int + 0.03 * version_match * (len(versions) > 0)::int + 0.05 * completeness * dependent::int, 6) as boost from full_context",
)
def scl_21(spark, d):
    return _contexts(spark, d).select("query_id", "id", *[F.round(c, 6).alias(c) for c in ("scope_match", "entity_match", "completeness")], "boost")


@query("scl_22", f"select memory_id, observations, usefulness, round((2 * usefulness - 1) * least(1.0, observations / 3), 6) as adaptation from ({LEDGER_SQL['agg_19']})")
def scl_22(spark, d):
    usage = L.delivered_once(table(spark, d, "usage_records"), "memory_id", "outcome", "used")
    return C.adaptation(L.context_feedback(usage, ["memory_id"])).select("memory_id", "observations", "usefulness", "adaptation")


_PRIORS = "case coalesce(m.origin_source_category, m.source_category) " + " ".join(f"when '{k}' then {v}" for k, v in R.SOURCE_PRIOR.items()) + " else 0.66 end"


@query(
    "scl_30",
    f"""with {BM25}, {LEXICAL}, {SIGNALS}, {SCORED},
t as (select b.query_id, b.id, 0.20 * round(j.confidence, 6) + 0.16 * round(m.trust, 6) + 0.14 * round(j.currentness, 6) + 0.13 * round(j.utility, 6) + 0.13 * round(greatest(j.lexical, j.phrase), 6) + 0.10 * (1 - j.stale_risk) + 0.08 * ({_PRIORS})
+ 0.06 * round((success_count + confirmed_count + helpful_count + validated_count + 2.0) / (success_count + confirmed_count + helpful_count + validated_count + harmful_count + false_positive_count + 4.0), 6)
- 0.18 * j.wrong_rate - 0.16 * m.dirty::int - 0.12 * coalesce(j.superseded, false)::int - 0.03 * (m.state = 'cold')::int as p from best b join joined j on j.query_id = b.query_id and j.id = b.id join memories m on m.id = b.id),
r as (select query_id, id, round(least(greatest(p, 0.0), 1.0), 6) as probability from t)
select *, case when probability >= 0.70 then 'use' when probability >= 0.48 then 'verify' else 'abstain' end as decision from r""",
)
def scl_30(spark, d):
    """Whether the results of the stated queries may be trusted without another look."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    good, bad = n("success_count") + n("confirmed_count") + n("helpful_count") + n("validated_count"), n("harmful_count") + n("false_positive_count")
    prior = R.lookup(R.SOURCE_PRIOR, F.coalesce("origin_source_category", "source_category"), 0.66)
    records = table(spark, d, "memories").select("id", "trust", "dirty", good.alias("positive"), bad.alias("negative"), prior.alias("source_prior"))
    best = R.ranked(scored(spark, d)).withColumn("relevance", F.greatest("lexical", "phrase")).join(records, "id")
    return C.assessed(best).select("query_id", "id", "probability", "decision")


_TOKENS = lambda c: f"list_distinct(list_transform(list_filter(regexp_extract_all({c}, '[\\w~./:@+-]{{2,}}'), lambda t: length(t) >= 3 and not list_contains({list(C.NO_EVIDENCE)}, lower(t))), lambda t: regexp_replace(lower(t), '^[.,;:!?()\\[\\]{{}}\"'']+|[.,;:!?()\\[\\]{{}}\"'']+$', '', 'g')))"


@query(
    "scl_31",
    f"""with asked as (select distinct src_id, dst_id from edges where relation in ('contradicts', 'supersedes') and src_id <> dst_id), {LIKENESS},
w as (select l.src_id, l.dst_id, similarity, a.object_value, a.content, b.content as response, {_TOKENS('a.content')} as own, {_TOKENS('b.content')} as said, list_distinct(list_transform(regexp_extract_all(a.content, {_q(C.ANCHOR)}, 1), lambda x: regexp_replace(lower(x), '[.,;:!?]+$', ''))) as anchors
from liking l join memories a on a.id = l.src_id join memories b on b.id = l.dst_id),
o as (select *, len(list_intersect(own, said)) as shared, case when len(anchors) > 0 then len(list_filter(anchors, lambda x: contains(lower(response), x))) / len(anchors) else 0.0 end as hits from w),
v as (select *, shared / greatest(1, least(len(own), len(said))) * case when shared < 2 and len(anchors) = 0 then 0.35 else 1.0 end as overlap from o),
s as (select *, greatest(overlap, 0.88 * hits, 0.68 * similarity) as best from v)
select src_id, dst_id, round(case when coalesce(content, '') = '' or coalesce(response, '') = '' then 0.0 when trim(coalesce(object_value, '')) <> '' and contains(lower(response), lower(trim(object_value))) then 1.0 else least(1.0, greatest(0.0, case when overlap < 0.12 and hits = 0 then least(best, 0.17) else best end)) end, 6) as attribution from s""",
)
def scl_31(spark, d):
    """How much the text of a linked record looks as if it used the other's: conflicts and replacements."""
    m = table(spark, d, "memories")
    pairs = table(spark, d, "edges").where("relation in ('contradicts', 'supersedes') and src_id <> dst_id").select("src_id", "dst_id").distinct()
    one, two = m.select(F.col("id").alias("src_id"), "content", "object_value"), m.select(F.col("id").alias("dst_id"), F.col("content").alias("response"))
    return C.attributed(likened(pairs, m).join(one, "src_id").join(two, "dst_id")).select("src_id", "dst_id", "attribution")


# the other engine's word borders know letters without accents only
_WHOLE = lambda p: rf"(?:^|[^\p{{L}}\p{{N}}_]){p.removeprefix(chr(92) + 'b').removesuffix(chr(92) + 'b')}(?:$|[^\p{{L}}\p{{N}}_])"
_TASK = "case " + " ".join(f"when regexp_matches(text, {_q(_WHOLE(p))}, 'i') then '{n}'" for n, p in C.TASKS) + " else 'general' end"
_ERROR = "case " + " ".join(f"when regexp_matches(text, {_q(p)}, 'i') then '{n}'" for n, p in C.ERRORS) + " else 'tool_error' end"


@query("scl_33", f"with f as (select doc_id, text, {_TASK} as task, regexp_matches(substr(text, 1, 1200), {_q(C.FAILURE)}, 'i') as failed from documents where text is not null) select doc_id, task, failed, case when failed then {_ERROR} end as error from f")
def scl_33(spark, d):
    """The kind of task that each document asks for, and whether it reads like a failed result."""
    text, failed = F.col("text"), C.result_failed(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", C.task_type(text).alias("task"), failed.alias("failed"), F.when(failed, C.error_type(text)).alias("error"))


_RESULTS = r"""with l as (select doc_id, k, line from (select doc_id, generate_subscripts(x, 1) as k, unnest(x) as line from (select doc_id, string_split(text, chr(10)) as x from documents where regexp_matches(text, '^\{"tool"'))) where json_valid(line)),
f as (select doc_id, k, json_extract_string(line, '$.ok') = 'false' as failed, line as text from l)"""


@query("scl_34", _RESULTS + f" select doc_id as session_id, count(*) as steps, not bool_or(failed) as success, min_by(case when failed then {_ERROR} end, k) filter (failed) as error_type, count(*) filter (failed) as failed_steps from f group by 1")
def scl_34(spark, d):
    """Workflows of the documents that are logs of tool results, one result a line."""
    lines = table(spark, d, "documents").where(F.col("text").rlike(r'^\{"tool"')).select("doc_id", F.posexplode(F.split("text", "\n")).alias("step", "result")).where(C.one_value(F.col("result")) & (F.col("result") != ""))
    made = C.workflows(lines.select(F.col("doc_id").alias("session_id"), "step", F.get_json_object("result", "$.tool").alias("tool"), F.get_json_object("result", "$.args").alias("arguments"), "result"))
    return made.select("session_id", F.col("steps").cast("bigint").alias("steps"), "success", "error_type", F.col("failed_steps").cast("bigint").alias("failed_steps"))


@query("scl_24")
def scl_24(spark, d):
    """The role of each record by its source, structure and support. Its patterns look ahead, which the other engine cannot; it is tested."""
    backed = table(spark, d, "edges").where("relation = 'supports'").select(F.col("dst_id").alias("id"), F.lit(True).alias("supported")).distinct()
    rows = table(spark, d, "memories").join(backed, "id", "left")
    return C.record_role(rows).select("id", "role", F.array_join("structures", ",").alias("structures"))


@query(
    "crt_1",
    """with v as (select *, coalesce(valid_from, system_from) as start from memory_versions where memory_id is not null),
o as (select memory_id, max_by(struct_pack(version_id := version_id, content := content, state := state, confidence := confidence, start := start), (start, system_from, version_id)) as o from v group by 1),
c as (select id as memory_id, 1000000000 + correction_count as version_id, content, updated_at as at_time from memories where correction_count > 0)
select c.memory_id, c.version_id, c.content, round(greatest(0.55::double, coalesce(o.o.confidence, 0)), 6) as confidence, coalesce(o.o.state, 'active') as state, at_time as valid_from, null::timestamp as valid_to, at_time as system_from, 'correction' as reason from c left join o using (memory_id)
union all select c.memory_id, o.o.version_id, o.o.content, o.o.confidence, o.o.state, o.o.start, at_time, at_time, 'closed' from c join o using (memory_id) where o.o.start < at_time""",
)
def crt_1(spark, d):
    """What the corrected records append to the update feed."""
    wrong = table(spark, d, "memories").where("correction_count > 0").select(F.col("id").alias("memory_id"), (F.col("correction_count") + 1_000_000_000).alias("version_id"), "content", F.col("updated_at").alias("at"))
    return C.corrected(table(spark, d, "memory_versions"), wrong)


@query(
    "crt_2",
    """with o as (select memory_id, max_by(struct_pack(version_id := version_id, content := content, state := state), (system_from, coalesce(valid_from, system_from), version_id)) as o from memory_versions group by 1)
select memory_id, o.version_id, o.content, o.state as before, state, updated_at as system_from from memories join o on memory_id = id where state is distinct from o.state""",
)
def crt_2(spark, d):
    """What changes of state append to the update feed, from the latest version's state to the record's."""
    return C.state_changes(table(spark, d, "memory_versions"), table(spark, d, "memories").select(F.col("id").alias("memory_id"), "state", F.col("updated_at").alias("at")))


_ARMS = ["none", "lexical", "full"]


@query(
    "agg_36",
    f"""with n as (select id, kind, row_number() over (partition by kind order by created_at, id) as n from memories),
a as (select id, kind, n, arm, row_number() over (partition by id order by sha256('recall|' || coalesce(kind, '') || '|' || cast((n - 1) // 3 as varchar) || '|' || arm), arm) as turn from n, (select unnest({_ARMS}) as arm))
select id, kind, arm from a where turn = (n - 1) % 3 + 1""",
)
def agg_36(spark, d):
    """Arms of an experiment, balanced within each kind of record in the order of arrival."""
    rows = table(spark, d, "memories").select("id", "kind", "created_at")
    return C.balanced(rows, ["kind"], _ARMS, [F.col("created_at"), F.col("id")], "id", "recall").select("id", "kind", "arm")


@query("str_5", "with l as (select usage_id as label_id, task_id, outcome, created_at, case when outcome = 'withheld' then resolved_at end as reversed_at from usage_records where outcome <> 'pending') select task_id, max_by(outcome, (created_at, label_id)) as outcome, count(*) as labels from l where reversed_at is null group by 1")
def str_5(spark, d):
    """The label that stands for each task, after labels that were taken back."""
    back = F.when(F.col("outcome") == "withheld", F.col("resolved_at"))
    labels = table(spark, d, "usage_records").where("outcome <> 'pending'").select(F.col("usage_id").alias("label_id"), "task_id", "outcome", "created_at", back.alias("reversed_at"))
    return C.standing_labels(labels, ["task_id"])


@query(
    "jn_12",
    r"""with notes as (select doc_id as id, lower(regexp_replace(coalesce(project, '') || '/' || replace(title, ' ', '-'), '\.[^./]+$', '')) as bare, coalesce(project, '') || '/' || replace(title, ' ', '-') as path, lower(trim(title)) as title from documents where title is not null),
named as (select id, path, 0 as rank, bare as alias from notes union all select id, path, 1, regexp_extract(bare, '([^/]*)$', 1) from notes union all select id, path, 2, title from notes),
one as (select alias, min_by(id, (rank, path, id)) as target from named where alias <> '' group by 1),
links as (select doc_id as id, lower(trim(regexp_replace(regexp_replace(unnest(regexp_extract_all(text, '\[\[([^\]]+)\]\]', 1)), '[#|].*$', ''), '\.md$', ''))) as alias from documents where text is not null
union all select doc_id, lower(trim(regexp_extract(text, '^([^.\n]+)', 1))) from documents where text is not null)
select distinct least(id, target) as a, greatest(id, target) as b from links join one using (alias) where id <> target""",
)
def jn_12(spark, d):
    """Documents that name each other: links in double brackets, and first sentences that are another's title."""
    docs = table(spark, d, "documents")
    notes = docs.where("title is not null").select(F.col("doc_id").alias("id"), F.concat(F.coalesce("project", F.lit("")), F.lit("/"), F.replace("title", F.lit(" "), F.lit("-"))).alias("path"), "title")
    named = docs.where("text is not null").select(F.col("doc_id").alias("id"), F.explode(F.concat(F.regexp_extract_all("text", F.lit(r"\[\[([^\]]+)\]\]"), 1), F.array(F.regexp_extract("text", r"^([^.\n]+)", 1)))).alias("target"))
    return C.resolved_links(named, notes)


def _chunks(versions, latest: bool):
    order = F.struct("system_from", "version_id")
    pick = F.max_by("content", order) if latest else F.min_by("content", order)
    text = versions.where("memory_id is not null and content is not null").groupBy(F.col("memory_id").alias("path")).agg(pick.alias("content"))
    return text.select("path", F.posexplode(F.split("content", r"(?<=[.])\s+|\n")).alias("place", "part")).select("path", F.col("place").cast("bigint").alias("place"), F.md5("part").alias("hash"))


@query(
    "scl_36",
    r"""with t as (select memory_id as path, min_by(content, (system_from, version_id)) as a, max_by(content, (system_from, version_id)) as b from memory_versions where memory_id is not null and content is not null group by 1),
o as (select path, generate_subscripts(l, 1) - 1 as place, md5(unnest(l)) as hash from (select path, string_split(regexp_replace(a, '\.\s+', '.' || chr(10), 'g'), chr(10)) as l from t)),
n as (select path, generate_subscripts(l, 1) - 1 as place, md5(unnest(l)) as hash from (select path, string_split(regexp_replace(b, '\.\s+', '.' || chr(10), 'g'), chr(10)) as l from t)),
k as (select n.path, n.place, n.hash, n.path || '#' || n.place as key, 'keep' as action from n join o using (path, place, hash)),
n2 as (select *, row_number() over (partition by path, hash order by place) as nth from n where (path, place) not in (select (path, place) from k)),
o2 as (select *, row_number() over (partition by path, hash order by place) as nth from o where (path, place) not in (select (path, place) from k)),
m as (select n2.path, n2.place, n2.hash, o2.path || '#' || o2.place as key, 'move' as action, o2.place as old_place from n2 join o2 using (path, hash, nth)),
n3 as (select * from n2 where (path, place) not in (select (path, place) from m)),
o3 as (select * from o2 where (path, place) not in (select (path, old_place) from m)),
c as (select n3.path, n3.place, n3.hash, case when o3.place is not null then o3.path || '#' || o3.place else sha256(n3.path || '|' || n3.place || '|' || n3.hash) end as key, case when o3.place is not null then 'change' else 'add' end as action from n3 left join o3 on o3.path = n3.path and o3.place = n3.place)
select * from k union all select path, place, hash, key, action from m union all select * from c
union all select path, place, hash, path || '#' || place, 'remove' from o3 where (path, place) not in (select (path, place) from c where action = 'change')""",
)
def scl_36(spark, d):
    """The sentences of each memory's latest wording against those of its first: which stand, moved, changed, are new or gone."""
    v = table(spark, d, "memory_versions").select("memory_id", "content", "system_from", "version_id")
    return C.reconciled_chunks(_chunks(v, False).withColumn("key", F.concat_ws("#", "path", "place")), _chunks(v, True))

