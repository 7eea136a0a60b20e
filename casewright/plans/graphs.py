"""Graph operators over whole tables (GR). Scores and clusters are over the pairs of entities, with entities that have none; paths and cycles over nations and their three largest outflows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.operators import aggregates as g
from casewright.operators import graph as gr
from casewright.operators import joins as j
from casewright.operators.sequences import ranked
from casewright.plans.joins import _INDIRECT
from casewright.plans.registry import query
from casewright.plans.standin import Tables
from casewright.storage import stored

_BOTH = "u as (select a as src, b as dst, weight from link union all select b, a, weight from link)"


_WEB = _BOTH.replace("link", "web") + ", v as (select id from entity), n as (select count(*) as n from entity), o as (select src, sum(weight) as total from u group by 1)"
#: Power iterations over entities, those without links too, until nothing moves any more.
_RANKS = (
    _WEB + ", arc as (select u.src, u.dst, weight / total as share from u join o using (src) union all select v.id, z.id, 1.0 / n.n from v cross join v z cross join n where v.id not in (select src from o)), "
    "p as (select 0 as k, id, 1.0::double / n.n as x from v cross join n union all select p.k + 1, arc.dst, .15 / any_value(n.n) + .85 * sum(p.x * arc.share) from p join arc on p.id = arc.src cross join n where p.k < 120 group by p.k, arc.dst)"
)
_VECTOR = (
    "sa as (select src, dst, weight from u union all select id, id, 1.0 from v), q as (select 0 as k, id, 1.0::double / n.n as x from v cross join n "
    "union all select k + 1, id, y / sqrt(sum(y * y) over ()) from (select q.k, sa.dst as id, sum(q.x * sa.weight) as y from q join sa on q.id = sa.src where q.k < 1000 group by q.k, sa.dst))"
)


_LEVELS = 9
_SHORT = ", ".join(
    ["l0 as (select distinct src as s, src as v, 0 as d, 1.0::double as paths from u)", "k0 as (select s, v, d, paths from l0)"]
    + [
        f"l{k} as materialized (select l.s, u.dst as v, {k} as d, sum(l.paths) as paths from l{k - 1} l join u on l.v = u.src where not exists (select 1 from k{k - 1} k where k.s = l.s and k.v = u.dst) group by 1, 2), k{k} as materialized (select * from k{k - 1} union all select * from l{k})"
        for k in range(1, _LEVELS + 1)
    ]
)
_BETWEEN = f"{_SHORT}, bt as (select i.v as id, sum(i.paths * o.paths / t.paths) as raw from k{_LEVELS} i join k{_LEVELS} o on i.v = o.s join k{_LEVELS} t on t.s = i.s and t.v = o.v and t.d = i.d + o.d where i.v <> i.s and i.v <> o.v and i.s <> o.v group by 1), bw as (select v.id, coalesce(raw, 0) / ((n - 1) * (n - 2)) as betweenness from v cross join n left join bt on bt.id = v.id)"


def _bridging(t: Tables) -> DataFrame:
    return gr.foreign_communities(t.web, _nations(t))


def _nations(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("community"))


_BY_NATION = "w as (select u.*, a.c_nationkey as cs, b.c_nationkey as cd from u join customer a on u.src = a.c_custkey join customer b on u.dst = b.c_custkey)"


@query("gr01_weighted_degree", f"with {_WEB} select v.id, coalesce(total, 0) as degree from v left join o on v.id = o.src")
def _(t: Tables) -> DataFrame:
    degree = gr.both_ways(t.web).groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("degree"))
    return t.entity.select("id").join(degree, "id", "left").select("id", F.coalesce("degree", F.lit(0.0)).alias("degree"))


@query("gr02_pagerank", f"with {_RANKS} select id, round(x, 7) as pagerank from p where k = 120")
def _(t: Tables) -> DataFrame:
    return gr.pagerank(t.web, t.entity).select("id", F.round("pagerank", 7).alias("pagerank"))


@query("gr03_eigenvector", f"with {_WEB}, {_VECTOR} select id, round(x, 5) as eigenvector from q where k = 1000")
def _(t: Tables) -> DataFrame:
    return gr.eigenvector(t.web, t.entity).select("id", F.round("eigenvector", 5).alias("eigenvector"))


@query("gr04_betweenness", f"with {_WEB}, {_BETWEEN} select id, round(betweenness, 9) as betweenness from bw")
def _(t: Tables) -> DataFrame:
    return gr.betweenness(t.web, t.entity).select("id", F.round("betweenness", 9).alias("betweenness"))


@query("gr05_communities")
def _(t: Tables) -> DataFrame:
    return gr.communities(t.web, t.entity)


@query("gr06_modularity", f"with {_WEB}, {_BY_NATION}, m as (select sum(weight) as m2 from w) select cs as community, sum(case when cs = cd then weight else 0 end) / m2 - pow(sum(weight) / m2, 2) as part from w cross join m group by cs, m2")
def _(t: Tables) -> DataFrame:
    return gr.modularity(t.web, _nations(t))


_PARTS = ("betweenness", "pagerank", "degree", "eigenvector", "prior", "bridging")
_INFLUENCE = (
    f"{_RANKS}, {_VECTOR}, {_BETWEEN}, {_BY_NATION}, f as (select src as id, count(distinct cd) filter (cs <> cd)::double as bridging from w group by 1), "
    "al as (select v.id, betweenness, p.x as pagerank, coalesce(total, 0)::double as degree, q.x as eigenvector, coalesce(prior_cases, 0)::double as prior, coalesce(bridging, 0) as bridging "
    "from v join bw using (id) join p on p.id = v.id and p.k = 120 join q on q.id = v.id and q.k = 1000 left join o on o.src = v.id left join f on f.id = v.id left join person pr on pr.id = v.id), "
    "sc as (select id, "
    + ", ".join(f"case when max({c}) over () - min({c}) over () <= 1e-9 * greatest(abs(max({c}) over ()), abs(min({c}) over ())) then 0.0 else ({c} - min({c}) over ()) / (max({c}) over () - min({c}) over ()) end as {c}" for c in _PARTS)
    + " from al), ph as (select id, .30 * betweenness + .25 * pagerank + .15 * degree + .15 * eigenvector + .10 * prior + .05 * bridging as score, "
    + ", ".join(f"{w} * ({c} - avg({c}) over ()) as phi_{c}" for c, w in zip(_PARTS, (0.30, 0.25, 0.15, 0.15, 0.10, 0.05), strict=True))
    + ", .30 * avg(betweenness) over () + .25 * avg(pagerank) over () + .15 * avg(degree) over () + .15 * avg(eigenvector) over () + .10 * avg(prior) over () + .05 * avg(bridging) over () as baseline from sc)"
)


def _influence(t: Tables) -> DataFrame:
    return gr.influence(t.web, t.person.select("id", F.col("prior_cases").alias("prior")), _nations(t), t.entity)


@query("gr07_influence", f"with {_INFLUENCE} select id, round(score, 4) as score from ph")
def _(t: Tables) -> DataFrame:
    return _influence(t).select("id", F.round("score", 4).alias("score"))


@query("gr08_shapley", f"with {_INFLUENCE} select id, " + ", ".join(f"round({c}, 4) as {c}" for c in ("baseline", *(f"phi_{p}" for p in _PARTS))) + " from ph")
def _(t: Tables) -> DataFrame:
    return _influence(t).select("id", *[F.round(c, 4).alias(c) for c in ("baseline", *(f"phi_{p}" for p in _PARTS))])


@query("gr09_bridging", f"with {_WEB}, {_BY_NATION} select src as id, count(distinct cd) filter (cs <> cd) as bridging from w group by 1")
def _(t: Tables) -> DataFrame:
    return _bridging(t)


_WALK = "with recursive e as (select a as src, b as dst from link union all select b, a from link), p as (select [0, dst] as path, dst as pos from e where src = 0 union all select list_append(path, dst), dst from p join e on p.pos = e.src where pos <> {target} and len(path) <= {cutoff} and not list_contains(path, dst))"


@query("gr10_simple_paths", _WALK.format(target=7, cutoff=3) + " select array_to_string(path, '-') as path, len(path) - 1 as hops from p where pos = 7")
def _(t: Tables) -> DataFrame:
    return gr.simple_paths(t.link, 0, 7, 3).select(F.array_join("path", "-").alias("path"), F.col("hops").cast("long").alias("hops"))


@query("gr11_neighbourhood", f"with {_BOTH}, {_SHORT} select v as id, d as distance from k2 where s = 3")
def _(t: Tables) -> DataFrame:
    return gr.neighbourhood(t.link, F.col("id") == 3, 2)


@query("gr12_shortest_paths", _WALK.format(target=7, cutoff=4) + ", d as (select array_to_string(path, '-') as path, len(path) - 1 as hops from p where pos = 7) select * from d where hops = (select min(hops) from d)")
def _(t: Tables) -> DataFrame:
    return gr.shortest_paths(t.link, 0, 7, 4).select(F.array_join("path", "-").alias("path"), F.col("hops").cast("long").alias("hops"))


@query("gr13_one_shortest_path", _WALK.format(target=7, cutoff=4) + ", d as (select array_to_string(path, '-') as path, len(path) - 1 as hops from p where pos = 7) select path, 1 - .15 * (hops - 1)::double as confidence from d order by hops, path limit 1")
def _(t: Tables) -> DataFrame:
    p = gr.shortest_paths(t.link, 0, 7, 4).select(F.array_join("path", "-").alias("path"), "hops")
    return p.orderBy("hops", "path").limit(1).select("path", (1 - 0.15 * (F.col("hops") - 1)).alias("confidence"))


@query("gr14_hidden_pairs", "with u as (select a as src, b as dst from link union all select b, a from link), h as (select distinct x.src as a, y.dst as b from u x join u y on x.dst = y.src and x.src < y.dst), f as (select h.* from h anti join link l on h.a = l.a and h.b = l.b) select a, b from f order by 'e' || a, 'e' || b limit 10")
def _(t: Tables) -> DataFrame:
    far = j.two_hops(t.link.select("a", "b"))
    return far.orderBy(F.concat(F.lit("e"), F.col("a").cast("string")), F.concat(F.lit("e"), F.col("b").cast("string"))).limit(10)


@query("gr14_hidden_pairs_by_length", _INDIRECT + ", k as (select length, 2 - (x.entity_type = 'PERSON')::int as p, 2 - (y.entity_type = 'PERSON')::int as q, 'e' || a as s, 'e' || b as t from f join entity x on x.id = a join entity y on y.id = b) select least(s, t) as source, greatest(s, t) as target, length from k order by length, case when p + q = 2 then 0 when p + q = 3 then 1 else 2 end, 1, 2 limit 10")
def _(t: Tables) -> DataFrame:
    """Of the entities' pairs the first ten: shorter paths, then two persons, then one, then node ids as strings."""
    kind = t.entity.select("id", (F.col("entity_type") == "PERSON").cast("int").alias("person"))
    far = j.indirect_pairs(t.pair.select("a", "b")).join(kind.toDF("a", "x"), "a").join(kind.toDF("b", "y"), "b")
    node = lambda c: F.concat(F.lit("e"), F.col(c).cast("string"))
    named = far.select(F.least(node("a"), node("b")).alias("source"), F.greatest(node("a"), node("b")).alias("target"), "length", (F.col("x") + F.col("y")).alias("persons"))
    return named.orderBy("length", F.desc("persons"), "source", "target").limit(10).select("source", "target", "length")


_REACH = "with recursive e as (select a as src, b as dst from pair union all select b, a from pair), r as (select src as id, src as pos from e union select r.id, e.dst from r join e on r.pos = e.src), cc as (select id, min(pos) as component from r group by 1)"


@query("gr15_components", _REACH + " select * from cc")
def _(t: Tables) -> DataFrame:
    return gr.components(t.pair)


#: For each node gone: what is left of its component, by reachability without it.
_GONE = (
    _REACH + ", rr as (select g.id as gone, z.id, z.id as pos from cc g join cc z on g.component = z.component and g.id <> z.id union select rr.gone, rr.id, e.dst from rr join e on rr.pos = e.src where e.dst <> rr.gone), "
    "im as (select gone as id, count(distinct part) - 1 as impact from (select gone, id, min(pos) as part from rr group by 1, 2) group by 1 having count(distinct part) > 1)"
)


@query("gr16_articulation_points", _GONE + " select id from im")
def _(t: Tables) -> DataFrame:
    return gr.articulation_points(t.pair).select("id")


@query("gr17_connectivity_impact", _GONE + " select id, impact from im")
def _(t: Tables) -> DataFrame:
    return gr.articulation_points(t.pair)


_REACHED = (
    "dg as (select id, count(*) as degree, sum(1 + n) as strength from (select a as id, n from pair union all select b, n from pair) group by 1), "
    "mr as (select e.id, m.reach from entity e join (select entity_type, lower(name) as key, count(distinct case_id) as reach from entity group by 1, 2) m on e.entity_type = m.entity_type and lower(e.name) = m.key)"
)


def _merged_reach(t: Tables) -> DataFrame:
    from casewright.functions.text import normalize_name

    e = t.entity.withColumn("key", normalize_name(F.col("name")))
    return e.join(e.groupBy("entity_type", "key").agg(F.countDistinct("case_id").alias("reach")), ["entity_type", "key"]).select("id", "reach")


_SCORED = (
    _GONE + ", " + _WEB + f", {_BETWEEN}, {_REACHED}, x as (select dg.id, degree, betweenness, coalesce(impact, 0) as impact, reach from dg join bw on bw.id = dg.id left join im on im.id = dg.id join mr on mr.id = dg.id where degree >= 2), "
    "mx as (select max(betweenness) as b, max(impact) as i, max(reach) as r from x), "
    "bs as (select id, degree, round(.45 * case when b > 0 then betweenness / b else 0 end + .35 * case when i > 0 then impact / i else 0 end + .20 * case when r > 1 then (reach - 1) / (r - 1) else 0 end, 3) as score from x cross join mx)"
)


@query("gr18_bridge_scores", _SCORED + " select id, degree, score from bs where score >= .25 order by score desc, degree desc, id limit 10")
def _(t: Tables) -> DataFrame:
    return gr.bridge_scores(t.pair, _merged_reach(t), t.entity).orderBy(F.desc("score"), F.desc("degree"), "id").limit(10)


@query(
    "gr19_clusters",
    _SCORED + ", kb as (select component, arg_min(id, (-score, -degree, id)) as key_bridge from bs join cc using (id) where score >= .25 group by 1) select cc.component, count(*) as size, count(*) filter (entity_type = 'PERSON') as persons, "
    "count(*) filter (entity_type = 'ORGANIZATION') as organizations, count(*) filter (entity_type = 'VEHICLE') as vehicles, any_value(key_bridge) as key_bridge from cc join entity using (id) left join kb on kb.component = cc.component group by 1 having count(*) >= 2",
)
def _(t: Tables) -> DataFrame:
    c = stored(gr.components(t.pair), "components")
    best = gr.bridge_scores(t.pair, _merged_reach(t), t.entity).join(c, "id").groupBy("component").agg(F.min(F.struct(-F.col("score"), -F.col("degree"), "id"))["id"].alias("key_bridge"))
    kinds = [F.count_if(F.col("entity_type") == k).alias(n) for k, n in (("PERSON", "persons"), ("ORGANIZATION", "organizations"), ("VEHICLE", "vehicles"))]
    sizes = c.join(t.entity.select("id", "entity_type"), "id").groupBy("component").agg(F.count("*").alias("size"), *kinds).filter("size >= 2")
    return sizes.join(best, "component", "left")


@query("gr19_subgroups")
def _(t: Tables) -> DataFrame:
    """Communities of three or more inside components of eight or more, where there are two of them at least; each component by itself."""
    return gr.subgroups(t.pair).groupBy("component", "community").agg(F.count("*").alias("members"))


@query(
    "gr20_metrics",
    _REACH + ", " + _WEB + f", {_BETWEEN}, {_REACHED}, z as (select component, count(*) as size from cc group by 1), "
    "nt as (select src as id, count(*) filter (entity_type = 'PERSON') as persons, count(*) filter (entity_type = 'ORGANIZATION') as organizations, count(*) filter (entity_type = 'VEHICLE') as vehicles from u join entity on entity.id = dst group by 1) "
    "select dg.id, degree, strength::bigint as strength, size, round(betweenness, 9) as betweenness, reach, persons, organizations, vehicles from dg join cc using (id) join z using (component) join bw on bw.id = dg.id join mr on mr.id = dg.id join nt on nt.id = dg.id",
)
def _(t: Tables) -> DataFrame:
    c = stored(gr.components(t.pair), "components")
    size = c.groupBy("component").agg(F.count("*").alias("size"))
    near = gr.both_ways(t.pair).join(t.entity.select(F.col("id").alias("dst"), "entity_type"), "dst").groupBy(F.col("src").alias("id")).agg(
        *[F.count_if(F.col("entity_type") == k).alias(n) for k, n in (("PERSON", "persons"), ("ORGANIZATION", "organizations"), ("VEHICLE", "vehicles"))]
    )
    between = gr.betweenness(t.pair, t.entity).select("id", F.round("betweenness", 9).alias("betweenness"))
    rows = g.degrees(t.pair, F.sum(1 + F.col("n")).alias("strength")).join(c, "id").join(size, "component").join(between, "id").join(_merged_reach(t), "id").join(near, "id")
    return rows.drop("component")


@query("gr21_high_connectivity", "select id, count(*) as degree from (select a as id from pair union all select b from pair) group by 1 having count(*) >= 3 order by 2 desc, 1 limit 5")
def _(t: Tables) -> DataFrame:
    return g.degrees(t.pair).filter("degree >= 3").orderBy(F.desc("degree"), "id").limit(5)


@query("gr22_case_graph", "select least(src, dst) as a, greatest(src, dst) as b, id, kind from (select *, row_number() over (partition by least(src, dst), greatest(src, dst) order by id) as n from relation where src <> dst) where n = 1")
def _(t: Tables) -> DataFrame:
    r = t.relation.filter("src != dst")
    first = r.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min(F.struct("id", "kind")).alias("x"))
    return first.select("a", "b", "x.id", "x.kind")


@query("gr23_merged_graph", "select entity_type, lower(name) as key, arg_min(name, (length(name), id)) as name, min(id) as first_id, count(*) as n, count(distinct case_id) as cases from entity group by 1, 2")
def _(t: Tables) -> DataFrame:
    from casewright.functions.text import normalize_name

    return t.entity.groupBy("entity_type", normalize_name(F.col("name")).alias("key")).agg(
        F.min(F.struct(F.length("name"), "id", "name"))["name"].alias("name"), F.min("id").alias("first_id"), F.count("*").alias("n"), F.countDistinct("case_id").alias("cases")
    )


@query("gr24_merged_reach", "with m as (select entity_type, lower(name) as key, count(distinct case_id) as reach from entity group by 1, 2) select e.id, m.reach from entity e join m on e.entity_type = m.entity_type and lower(e.name) = m.key")
def _(t: Tables) -> DataFrame:
    from casewright.functions.text import normalize_name

    e = t.entity.withColumn("key", normalize_name(F.col("name")))
    m = e.groupBy("entity_type", "key").agg(F.countDistinct("case_id").alias("reach"))
    return e.join(m, ["entity_type", "key"]).select("id", "reach")


@query(
    "gr25_cross_case",
    "with e as (select a as src, b as dst from pair union all select b, a from pair), s as (select a.id as a, b.id as b, a.case_id as case_a, b.case_id as case_b, a.entity_type as kind, lower(a.name) as key from entity a join entity b on a.entity_type = b.entity_type and lower(a.name) = lower(b.name) and a.case_id < b.case_id), "
    "t as (select *, row_number() over (order by case_a, case_b, kind, key, a, b) as place from s), n as (select src, min(dst) as near from e group by 1) "
    "select place, a, b, case_a, case_b, case when x.near is null then '' else x.near || '-' end || a || '=' || b || case when y.near is null then '' else '-' || y.near end as path from t left join n x on x.src = a left join n y on y.src = b where place <= 12",
)
def _(t: Tables) -> DataFrame:
    """Identities of two cases, the first twelve, each with an example path from a neighbour in one case over the shared identity to one in the other."""
    from casewright.functions.text import normalize_name

    e = t.entity.select("entity_type", normalize_name(F.col("name")).alias("key"), "id", "case_id")
    same = e.toDF("kind", "key", "a", "case_a").join(e.toDF("kind", "key", "b", "case_b"), ["kind", "key"]).filter("case_a < case_b")
    first = same.orderBy("case_a", "case_b", "kind", "key", "a", "b").limit(12)
    near = gr.both_ways(t.pair).groupBy("src").agg(F.min("dst").alias("near"))
    first = first.join(near.toDF("a", "x"), "a", "left").join(near.toDF("b", "y"), "b", "left")
    path = F.concat(F.coalesce(F.concat(F.col("x"), F.lit("-")), F.lit("")), "a", F.lit("="), "b", F.coalesce(F.concat(F.lit("-"), F.col("y")), F.lit("")))
    return ranked(first, [F.col(c) for c in ("case_a", "case_b", "kind", "key", "a", "b")], "place").select(F.col("place").cast("long").alias("place"), "a", "b", "case_a", "case_b", path.alias("path"))


@query("gr26_cycles", "with recursive w as (select src as first, [src, dst] as nodes, dst as pos, amount as total from flow where dst > src union all select first, list_append(nodes, dst), dst, total + amount from w join flow f on w.pos = f.src where dst > first and not list_contains(nodes, dst) and len(nodes) < 5), c as (select list_sort(nodes) as nodes, total + amount as total from w join flow f on w.pos = f.src and f.dst = w.first where len(nodes) >= 3) select array_to_string(nodes, '-') as nodes, max(total) as total from c group by 1 having max(total) >= 1000000")
def _(t: Tables) -> DataFrame:
    return gr.cycles(t.flow, 1_000_000).select(F.array_join("nodes", "-").alias("nodes"), "total")


_DRIVEN = "greatest(round(phi_betweenness, 6), round(phi_eigenvector, 6)) >= greatest(round(phi_pagerank, 6), round(phi_degree, 6), round(phi_prior, 6), round(phi_bridging, 6))"
_UNDER_DEGREE = " + ".join(f"(round(phi_{p}, 6) < round(phi_degree, 6))::int" for p in _PARTS)


@query(
    "gr27_insulated_actors",
    f"with {_INFLUENCE}, pl as (select *, row_number() over (order by round(score, 4) desc, id) as place, count(*) over () as n from ph), hs as (select user_id as id, count(distinct k) as handsets from ev group by 1) "
    f"select pl.id, case when coalesce(handsets, 0) >= 2 then 'handsets' else 'priors' end as reason from pl left join hs on hs.id = pl.id left join person on person.id = pl.id where n >= 6 and place <= ceil(n * .25) and {_DRIVEN} and {_UNDER_DEGREE} <= 1 and (coalesce(handsets, 0) >= 2 or coalesce(prior_cases, 0) >= 3)",
)
def _(t: Tables) -> DataFrame:
    """Of six people or more those of the top quarter whose score comes from brokerage, whose degree is among their two lowest parts, and who hold two handsets or three prior cases."""
    x = stored(ranked(_influence(t), [F.desc(F.round("score", 4)), F.asc("id")], "rank"), "influence")
    n = x.count()
    phi = {p: F.round(f"phi_{p}", 6) for p in _PARTS}
    driven = F.greatest(phi["betweenness"], phi["eigenvector"]) >= F.greatest(*[phi[p] for p in ("pagerank", "degree", "prior", "bridging")])
    under = sum((phi[p] < phi["degree"]).cast("int") for p in _PARTS)
    handsets = t.ev.groupBy(F.col("user_id").alias("id")).agg(F.countDistinct("k").alias("handsets"))
    kept = x.filter((F.lit(n) >= 6) & (F.col("rank") <= F.ceil(F.lit(n * 0.25))) & driven & (under <= 1)).join(handsets, "id", "left").join(t.person.select("id", "prior_cases"), "id", "left")
    many = F.coalesce("handsets", F.lit(0)) >= 2
    return kept.filter(many | (F.coalesce("prior_cases", F.lit(0)) >= 3)).select("id", F.when(many, "handsets").otherwise("priors").alias("reason"))


@query(
    "gr28_clean_skin_bridges",
    f"with {_WEB}, {_SHORT} select z.s as id, max(y.prior_cases) as worst, count(*) as reached, case when max(y.prior_cases) >= 4 or max(case when z.d = 1 then y.prior_cases end) >= 2 then 'high' else 'medium' end as severity "
    "from k3 z join person x on x.id = z.s join person y on y.id = z.v where z.d > 0 and x.prior_cases = 0 and (y.prior_cases >= 3 or z.d = 1 and y.prior_cases >= 2) group by 1 having max(y.prior_cases) >= 3",
)
def _(t: Tables) -> DataFrame:
    """People without a prior case who reach one with three or more in three steps; high with a direct neighbour of two or more, or a worst of four or more."""
    pr = t.person.select("id", "prior_cases").filter("prior_cases is not null")
    near = gr.within_hops(t.web, 3, pr.filter("prior_cases = 0").select("id")).join(pr.toDF("v", "prior"), "v").filter("prior >= 3 or d = 1 and prior >= 2")
    direct = F.coalesce(F.max(F.when(F.col("d") == 1, F.col("prior"))) >= 2, F.lit(False))
    found = near.groupBy(F.col("s").alias("id")).agg(F.max("prior").alias("worst"), F.count("*").alias("reached"), direct.alias("direct")).filter("worst >= 3")
    return found.select("id", "worst", "reached", F.when((F.col("worst") >= 4) | F.col("direct"), "high").otherwise("medium").alias("severity"))


@query("gr29_brokers", f"with {_WEB}, {_BY_NATION} select src as id, count(distinct cd) filter (cs <> cd) as bridging from w group by 1 having count(distinct cd) filter (cs <> cd) >= 2")
def _(t: Tables) -> DataFrame:
    return _bridging(t).filter("bridging >= 2")


@query("gr30_identifier_clusters", "with recursive e as (select distinct a.p_partkey as src, b.p_partkey as dst from (select p_partkey, p_brand || p_name as k from part) a join (select p_partkey, p_brand || p_name as k from part) b on a.k = b.k and a.p_partkey <> b.p_partkey), r as (select src as id, src as pos from e union select r.id, e.dst from r join e on r.pos = e.src) select id, min(pos) as component from r group by 1")
def _(t: Tables) -> DataFrame:
    k = t.part.select("p_partkey", F.concat("p_brand", "p_name").alias("k"))
    star = k.groupBy("k").agg(F.min("p_partkey").alias("a")).join(k, "k").filter("a != p_partkey").select("a", F.col("p_partkey").alias("b"))
    return gr.components(star)


@query("gr31_canonical_names")
def _(t: Tables) -> DataFrame:
    from casewright.functions.text import normalize_name

    rank = F.struct(F.size(F.split("name", " ")).alias("words"), F.length("name").alias("n"), F.col("name").alias("name"))
    return t.entity.groupBy("entity_type", normalize_name(F.col("name")).alias("key")).agg(F.max(rank)["name"].alias("canonical"), F.min("id").alias("root"))


@query("gr32_bridges", "with u as (select a as src, b as dst from pair union all select b, a from pair), d as (select src as id, count(*) as degree from u group by 1), t as (select x.src as id, count(*) as closed from u x join u y on x.src = y.src and x.dst < y.dst join pair p on p.a = x.dst and p.b = y.dst group by 1) select id, degree, coalesce(closed, 0) as closed from d left join t using (id) where degree >= 3 and coalesce(closed, 0) <= .2 * degree * (degree - 1) / 2")
def _(t: Tables) -> DataFrame:
    """Nodes of degree 3 or more of whose pairs of neighbours a fifth at most are linked."""
    return gr.clustering(t.pair).filter((F.col("degree") >= 3) & (F.col("closed") <= 0.2 * F.col("degree") * (F.col("degree") - 1) / 2)).select("id", "degree", "closed")


@query("gr32_clustering", "with u as (select a as src, b as dst from pair union all select b, a from pair), d as (select src as id, count(*) as degree from u group by 1), t as (select x.src as id, count(*) as closed from u x join u y on x.src = y.src and x.dst < y.dst join pair p on p.a = x.dst and p.b = y.dst group by 1) select id, degree, coalesce(closed, 0) as closed from d left join t using (id)")
def _(t: Tables) -> DataFrame:
    return gr.clustering(t.pair).select("id", "degree", "closed")


@query("gr33_browser_clusters", _REACH + " select component, count(*) as size from cc group by 1 having count(*) >= 3")
def _(t: Tables) -> DataFrame:
    return gr.components(t.pair).groupBy("component").agg(F.count("*").alias("size")).filter("size >= 3")
