"""Insights of every case (DA24)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from casewright.operators.insights import insights
from casewright.plans.copilot import _CASE_SQL, CaseTables
from casewright.plans.registry import query
from casewright.plans.standin import Tables

_INSIGHTS = (
    f"with {_CASE_SQL}, dz as (select e.case_id, e.id, count(*) as n from entity e join (select src as id from relation union all select src from relation union all select dst from relation) r on r.id = e.id group by 1, 2), "
    "tz as (select case_id, arg_min(id, (-n, id)) as subject, max(n) as n from dz group by 1), dt as (select *, lead(us) over (partition by case_id order by us, id) - us as gap from ce where us is not null), "
    "sp as (select case_id, count(*) as n, max(us) - min(us) as span, max(gap) as gap, arg_min(id, (-gap, us, id)) filter (gap is not null) as before from dt group by 1), "
    "fs as (select case_id, entity, row_number() over (partition by case_id order by seen, entity) as k from (select case_id, entity, min((us, id)) as seen from ce where us is not null group by 1, 2)), lz as (select case_id, list(entity order by k) as linked from fs where k <= 6 group by 1), "
    "ge as (select case_id, arg_max(location, (us, id)) as location, arg_max(entity, (us, id)) as entity from ce where us is not null and location in (select id from place) group by 1), "
    "vi as (select case_id, location, count(*) as n from ce where location is not null group by 1, 2), vt as (select case_id, arg_min(location, (-n, location)) as location, max(n) as n from vi group by 1), "
    "oz as (select case_id, id, row_number() over (partition by case_id order by id) as k from entity where entity_type = 'VEHICLE' and id not in (select src from relation union all select dst from relation)) "
    "select case_id, 'link' as category, subject, n, null::double as amount, least(90, 50 + 8 * n)::int as confidence, [subject] as linked from tz where n >= 2 "
    "union all select case_id, 'temporal', case when gap >= 10800000000 then before end, n, greatest(1, round(span / 86400000000)), 88, linked from sp join lz using (case_id) where n >= 2 "
    "union all select case_id, 'geo', location, (select count(*) from place where place.case_id = ge.case_id), null, 84, [entity] from ge "
    "union all select case_id, 'pattern', location, n, null, least(88, 55 + 8 * n)::int, [] from vt where n >= 2 "
    "union all select case_id, 'anomaly', null, count(*), null, 70, list(id order by id) filter (k <= 6) from oz group by 1"
)


@query("da24_insights", _INSIGHTS)
def _(t: Tables) -> DataFrame:
    c = CaseTables(t)
    return insights(c.entities, c.relations, c.events, c.locations, ["VEHICLE"])
