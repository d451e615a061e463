"""Queries of the history operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evimem.operators import history
from evimem.plans.history_sql import P1, P5
from evimem.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return history.valid_periods(table(spark, folder, "memory_versions"))


def p1_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return history.ledger(table(spark, folder, "memory_versions"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return history.retrieved_versions(table(spark, folder, "memories"), table(spark, folder, "memory_versions"))


def p5_attributes(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "memories").select(F.col("id").alias("memory_id"), F.col("last_retrieved_at").alias("at"))
    return history.attributes_at(events, table(spark, folder, "memory_versions"), "memory_id", ["content", "state"], F.col("valid_to"))


P5_ATTRIBUTES = """
with v as (select distinct memory_id, version_id, content, state, valid_to, system_from, coalesce(valid_from, system_from) as start from memory_versions),
k as (select v.*, last_retrieved_at as seen from v join memories on memories.id = v.memory_id where system_from <= last_retrieved_at and start <= last_retrieved_at),
c as (select *, row_number() over (partition by memory_id order by start desc, system_from desc, version_id desc) as rn from k where content is not null),
s as (select *, row_number() over (partition by memory_id order by start desc, system_from desc, version_id desc) as rn from k where state is not null)
select id as memory_id, last_retrieved_at as "at", c.content, s.state from memories
left join c on c.memory_id = id and c.rn = 1 and not coalesce(c.valid_to > c.start and c.valid_to <= c.seen, false)
left join s on s.memory_id = id and s.rn = 1 and not coalesce(s.valid_to > s.start and s.valid_to <= s.seen, false)
where last_retrieved_at is not null
"""

# of each recording the moments at which its end changed, and from each until the next
P1_LEDGER = """
with v as (select distinct memory_id, version_id, case when valid_to > coalesce(valid_from, system_from) then valid_to end as stop, system_from as recorded, coalesce(valid_from, system_from) as start
           from memory_versions where memory_id is not null and version_id is not null and system_from is not null),
r as (select *, lead(recorded) over (partition by memory_id, start order by recorded, version_id) as until from v),
f as (select memory_id, start, min(recorded) as first from v group by 1, 2),
t as (select memory_id, version_id, start, stop, recorded, until, recorded as moment from r where until is null or until > recorded
      union select r.memory_id, version_id, r.start, stop, recorded, until, first from r join f on f.memory_id = r.memory_id and f.start > r.start and first > recorded and (until is null or first < until)),
e as (select t.memory_id, version_id, t.start, recorded, until, moment, least(stop, min(f.start)) as valid_to
      from t left join f on f.memory_id = t.memory_id and f.start > t.start and f.first <= moment group by t.memory_id, version_id, t.start, recorded, until, moment, stop),
c as (select *, row_number() over w = 1 or valid_to is distinct from lag(valid_to) over w as changed from e window w as (partition by memory_id, version_id, start, recorded order by moment))
select memory_id, version_id, start as valid_from, valid_to, moment as recorded_from, coalesce(lead(moment) over (partition by memory_id, version_id, start, recorded order by moment), until) as recorded_to
from c where changed
"""

QUERIES = {"p1_found": p1_found, "p1_ledger": p1_ledger, "p5_found": p5_found, "p5_attributes": p5_attributes}
SQL = {"p1_found": P1, "p1_ledger": P1_LEDGER, "p5_found": P5, "p5_attributes": P5_ATTRIBUTES}
