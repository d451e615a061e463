"""Queries of the operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evimem.llm import copies, cuts, digests, mixing, neardup, personal, reading, tokens
from evimem.sources.tables import OBSERVATIONS, table


def p2_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    rows = digests.observations(table(spark, folder, OBSERVATIONS))
    return digests.percentiles(rows, ["model", "condition"], "day", ["agent_ttft_ms", "memory_prepare_ms", "reported_prompt_tokens"])


def p2_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many measurements stand behind the percentiles of each group and day, and whether all of these are certified."""
    found = p2_percentiles(spark, folder).groupBy("model", "condition", "day", "metric")
    return found.agg(F.max("n").alias("n"), F.min("certified").alias("certified")).withColumn("day", F.col("day").cast("string"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return cuts.judged(table(spark, folder, "memories"), "id", "content", "source_type").where("cut").selectExpr("key as memory_id")


def p3_sources(spark: SparkSession, folder: str) -> DataFrame:
    return cuts.report(table(spark, folder, "memories"), "id", "content", "source_type")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    found = personal.mentions(table(spark, folder, "memories"), "id", ["content", "quarantine_reason"])
    return found.selectExpr("id as memory_id", "field", "pii_type", "nth")


def p4_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return personal.redacted(table(spark, folder, "memories"), "id", ["content", "quarantine_reason"]).withColumnRenamed("id", "memory_id")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.similar_pairs(table(spark, folder, "memories"), "id", "content").toDF("memory_id_a", "memory_id_b")


def p6_groups(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.groups(table(spark, folder, "memories"), "id", "content")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return copies.copy_pairs(table(spark, folder, "memories"), "id", "content")


def p7_records(spark: SparkSession, folder: str) -> DataFrame:
    return copies.records(table(spark, folder, "memories"), "id", "content")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_ids(table(spark, folder, "documents"), "doc_id", "text")


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(table(spark, folder, "documents"), table(spark, folder, "mixture_targets"), "doc_id", "text", "source")[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(table(spark, folder, "documents"), table(spark, folder, "mixture_targets"), "doc_id", "text", "source")[1]


def p10_levels(spark: SparkSession, folder: str) -> DataFrame:
    return reading.levels(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "reading_reference"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Running prose nearer to level 4 than to level 3."""
    return p10_levels(spark, folder).where("prose and level >= 3.5").select("doc_id")


QUERIES = {"p2_percentiles": p2_percentiles, "p2_counts": p2_counts, "p3_found": p3_found, "p3_sources": p3_sources, "p4_found": p4_found, "p4_redacted": p4_redacted, "p6_found": p6_found, "p6_groups": p6_groups, "p7_found": p7_found, "p7_records": p7_records, "p8_ids": p8_ids, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p10_found": p10_found, "p10_levels": p10_levels}
def _letters(text: str) -> str:
    return rf"lower(regexp_replace({text}, '[^\p{{L}}\p{{N}}]+', '', 'g'))"


_ITEM = r"(?s)^[^\p{L}\p{N}]*([\p{L}\p{N}_]+)[^\p{L}\p{N}:=]*[:=](.*)$"
_CANON = rf"""
t as (select id, content, regexp_replace(content, '[\p{{Zs}}\t]', ' ', 'g') as plain, {_letters('content')} as seq from memories where id is not null),
l as (select id, seq, case when regexp_matches(plain, '(?s)^\s*\{{.*\}}\s*$') and json_valid(plain) then list_transform(json_keys(plain), lambda k: {_letters('k')} || '=' || coalesce({_letters("json_extract_string(plain, '$.\"' || k || '\"')")}, '')) end as j,
list_filter(string_split_regex(plain, '\n|\s\|\s|;\s'), lambda p: regexp_matches(p, '[\p{{L}}\p{{N}}]')) as parts from t where seq <> ''),
f as (select id, seq, case when len(j) > 0 then j when len(parts) >= 2 and len(list_filter(parts, lambda p: not regexp_matches(p, '{_ITEM}'))) = 0 then list_transform(parts, lambda p: {_letters(f"regexp_extract(p, '{_ITEM}', 1)")} || '=' || {_letters(f"regexp_extract(p, '{_ITEM}', 2)")}) end as fields from l),
r as (select id, seq, '#' || array_to_string(list_sort(fields), chr(10)) as record from f),
canon as (select id, coalesce(min(record) over (partition by seq), seq) as c from r)"""
_MEASURED = " union all ".join(f"select model, condition, day, '{m}' as metric from o where {m} >= {least} and not isnan({m}::double) and not isinf({m}::double)" for m, least in (("agent_ttft_ms", 0), ("memory_prepare_ms", 0), ("reported_prompt_tokens", 1)))
SQL: dict[str, str] = {
    "p2_counts": f"with o as (select *, cast(cast(run_at as date) as varchar) as day from (select *, row_number() over (partition by observation_id order by received_at nulls last) as k from {OBSERVATIONS} where observation_id is not null) where k = 1), m as ({_MEASURED}) select model, condition, day, metric, count(*) as n, true as certified from m group by 1, 2, 3, 4 union all select model, condition, null, metric, count(*), true from m group by 1, 2, 4",
    "p7_found": f"with {_CANON}, n as (select id, min(id) over (partition by c) as first_id from canon) select first_id, id as copy_id from n where id <> first_id",
    "p7_records": f"with {_CANON} select min(id) as id, count(*) as copies from canon group by c",
    "p6_found": rf"""with {_CANON}, w as (select id, list_distinct(regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}]+')) as ws from memories),
k as (select id, len(ws) as n, unnest(ws) as word from w),
o as (select a.id as memory_id_a, b.id as memory_id_b, count(*) as shared, any_value(a.n) + any_value(b.n) as total from k a join k b on a.word = b.word and a.id < b.id group by 1, 2)
select memory_id_a, memory_id_b from o join canon x on x.id = memory_id_a join canon y on y.id = memory_id_b where x.c <> y.c and 10 * shared >= 7 * (total - shared)""",
}
