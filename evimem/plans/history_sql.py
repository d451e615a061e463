"""SQL of the history queries, for a second engine to compare with."""

P1 = """
with v as (select distinct on (version_id) memory_id, version_id, content, state, valid_to, system_from, coalesce(valid_from, system_from) as start from memory_versions),
s as (select *, case when valid_to > start then valid_to end as stop, row_number() over (partition by memory_id, start order by system_from desc, version_id desc) as rn from v),
n as (select *, lag(stop) over w as before_stop, lag(start) over w as before_start, lag(content) over w as before_content, lag(state) over w as before_state from s where rn = 1 window w as (partition by memory_id order by start)),
f as (select *, before_start is not null and (before_stop is null or before_stop >= start) as touching from n),
p as (select * from f where not (touching and content is not distinct from before_content and state is not distinct from before_state))
select memory_id, version_id, case when lead(touching) over q then lead(version_id) over q else 0 end as ended_by
from p window q as (partition by memory_id order by start)
"""

P5 = """
with v as (select distinct memory_id, version_id, valid_to, system_from, coalesce(valid_from, system_from) as start from memory_versions),
m as (select v.*, last_retrieved_at as seen, row_number() over (partition by memory_id order by start desc, system_from desc, version_id desc) as rn
      from v join memories on memories.id = v.memory_id where system_from <= last_retrieved_at and start <= last_retrieved_at)
select memory_id, version_id from m where rn = 1 and not coalesce(valid_to > start and valid_to <= seen, false)
"""
