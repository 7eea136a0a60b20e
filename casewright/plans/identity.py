"""Entity resolution (GR30, GR31): observed people in two scripts and several spellings, some with a shared phone.

The SQL knows which spellings of the stand-in are alike (all of one person but initial against middle initial), and finds clusters
by reach; the operator finds that out from the names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.operators import identity, names
from casewright.plans.registry import query
from casewright.plans.standin import _F, _L, OBSERVED_FORM, Tables


def clusters_sql(x: str, observed: str) -> str:
    """Common table expressions x_e, x_r and x_c (obs, entity) of the table ``observed``."""
    return (
        f"{x}_e as (select a.obs as src, b.obs as dst from {observed} a join {observed} b on a.f = b.f and a.l = b.l and a.obs <> b.obs and least(a.form, b.form) * 10 + greatest(a.form, b.form) <> 23 "
        f"union select a.obs, b.obs from {observed} a join {observed} b on a.ident = b.ident and a.obs <> b.obs), "
        f"{x}_r as (select obs, obs as pos from {observed} union select {x}_r.obs, {x}_e.dst from {x}_r join {x}_e on {x}_r.pos = {x}_e.src), "
        f"{x}_c as (select obs, min(pos) as entity from {x}_r group by 1)"
    )


def _resolved(t: Tables) -> identity.Resolved:
    return identity.resolve(t.observed, t.observed.select("obs", "ident"))


@query("gr30_entity_clusters", f"with recursive {clusters_sql('x', 'observed')} select obs, entity from x_c")
def _(t: Tables) -> DataFrame:
    return _resolved(t).members


@query("gr30_merge_decisions")
def _(t: Tables) -> DataFrame:
    return identity.decisions(t.observed, _resolved(t).merges)


#: What a person whose names are all in Devanagari is called, by first and last name.
_SPOKEN_FIRST, _SPOKEN_LAST = "Vikrama,Rajesha,Devendra,Phareda,Mohana,Lalita,Nikhila,Taruna,Gopala,Haresha", "Sethe,Kumara,Patila,Bhosale,Qureshe,Jadhava,Chauhana"


@query(
    "gr31_canonical_entities",
    f"with recursive {clusters_sql('x', 'observed')}, o as (select x_c.entity, observed.*, case form when 2 then 1 else 2 end as full_words, form <> 4 as latin from observed join x_c using (obs)), "
    "k as (select *, row_number() over (partition by entity order by full_words desc, latin desc, length(name) desc, obs) as n, count(*) over (partition by entity) as observations from o) "
    f"select entity, case when latin then name else split_part('{_SPOKEN_FIRST}', ',', cast(1 + f as int)) || ' ' || split_part('{_SPOKEN_LAST}', ',', cast(1 + l as int)) end as canonical, observations, "
    "'P' || lpad(cast(row_number() over (order by 'obs' || entity) as varchar), 4, '0') as label from k where n = 1",
)
def _(t: Tables) -> DataFrame:
    """Canonical name, size and positional id of each entity."""
    return identity.positional_ids(identity.canonical_names(t.observed, _resolved(t).members))


# --- names nearly the same -------------------------------------------------------------------------------------------
#: A candidate's name by its form: as it is, a letter short, with an initial, with a word more, the first name alone.
_WRITTEN = f"case {OBSERVED_FORM} when 0 then {_F} || ' ' || {_L} when 1 then substr({_F}, 1, length({_F}) - 1) || ' ' || {_L} when 2 then substr({_F}, 1, 1) || ' ' || {_L} when 3 then {_F} || ' Rao ' || {_L} else {_F} end"


def _written(t: Tables) -> tuple[DataFrame, DataFrame]:
    return t.customer.select(F.col("c_custkey").alias("id"), F.expr(_WRITTEN).alias("name")), t.customer.select(F.expr(f"{_F} || ' ' || {_L}").alias("name"))


_LADDER = (
    f"nm as (select distinct f, l, {_F} || ' ' || {_L} as name from observed join customer on c_custkey = obs), "
    "cd as (select obs as id, f, l, form from observed), mt as (select cd.id, nm.name, case form when 0 then 1.0 when 1 then .75 when 2 then .82 when 3 then .55 + .35 * 2 / 3 else .725 end::double as score from cd join nm on cd.f = nm.f and (cd.l = nm.l or form = 4))"
)


@query("wn11_name_suggestions", f"with {_LADDER}, rk as (select *, row_number() over (partition by id order by score desc, lower(name)) as place from mt) select id, place, name, round(score, 9) as score from rk where place <= 3")
def _(t: Tables) -> DataFrame:
    """The three best known names of each candidate."""
    return names.suggestions(*_written(t)).withColumn("score", F.round("score", 9))


@query("sc12_score_ladder", f"with {_LADDER} select round(score, 9) as score, count(*) as pairs from (select distinct name, score, {_WRITTEN} as written from mt join customer on c_custkey = id) group by 1")
def _(t: Tables) -> DataFrame:
    """How many pairs of spellings each rung of the ladder has: equal, an initial, a letter, half of the words."""
    return names.name_matches(*_written(t)).groupBy(F.round("score", 9).alias("score")).agg(F.count("*").alias("pairs"))
