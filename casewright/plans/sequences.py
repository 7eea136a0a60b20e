"""Windows, rankings and top-k over whole tables (WN, TK), set operations (ST)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions import measures as m
from casewright.functions import text as x
from casewright.operators import detectors as d
from casewright.operators import joins as j
from casewright.operators import names
from casewright.operators import sequences as s
from casewright.plans.registry import query
from casewright.plans.standin import Tables

_HOUR = 3_600_000_000


@query("wn01_rank", "select a, b, row_number() over (order by weight desc, a, b) as place from link")
def _(t: Tables) -> DataFrame:
    return s.ranked(t.link, [F.desc("weight"), F.asc("a"), F.asc("b")], "place").select("a", "b", "place")


@query("wn02_finding_ids", "select src, dst, format('A{:03d}', row_number() over (order by n desc, src, dst)) as id from flow")
def _(t: Tables) -> DataFrame:
    return s.ranked(t.flow, [F.desc("n"), F.asc("src"), F.asc("dst")], "place").select("src", "dst", F.format_string("A%03d", "place").alias("id"))


@query("wn03_consecutive_sightings", "select event_id, lead(event_id) over (partition by user_id order by us, event_id) as next_event from ev")
def _(t: Tables) -> DataFrame:
    return t.ev.select("event_id", F.lead("event_id").over(Window.partitionBy("user_id").orderBy("us", "event_id")).alias("next_event"))


@query("wn04_gaps", "select user_id, event_id, us - before as gap from (select *, lag(us) over (partition by user_id order by us, event_id) as before from ev) where us - before > 43200000000")
def _(t: Tables) -> DataFrame:
    return s.gaps(t.ev, "user_id", "us", "event_id", 12 * _HOUR).select("user_id", "event_id", "gap")


@query("wn05_longest_quiet", "select user_id, max(gap) as gap, min(before) as since from (select *, max(gap) over (partition by user_id) as most from (select user_id, us, lag(us) over (partition by user_id order by us, event_id) as before, us - lag(us) over (partition by user_id order by us, event_id) as gap from ev)) where gap = most and gap > 86400000000 group by 1")
def _(t: Tables) -> DataFrame:
    return s.longest_gap(t.ev, "user_id", "us", "event_id", 24 * _HOUR)


@query("wn06_busiest_sequence", "with c as (select case_id, user_id, row_number() over (partition by case_id order by count(*) desc, user_id) as place from ev group by 1, 2 having count(*) >= 3), r as (select e.case_id, e.user_id, e.event_id, row_number() over (partition by e.case_id order by us, event_id) as n, us - lag(us) over (partition by e.case_id order by us, event_id) as step from ev e join c on e.case_id = c.case_id and e.user_id = c.user_id and c.place = 1) select * from r where n <= 6")
def _(t: Tables) -> DataFrame:
    return s.busiest_sequence(t.ev, "case_id", "user_id", "us", "event_id", 3, 6)


@query("wn07_closest_pairs", "with p as (select a.user_id, a.event_id as a, b.event_id as b, abs(a.us - b.us) as d from ev a join ev b on a.user_id = b.user_id and a.event_id < b.event_id and abs(a.us - b.us) <= 1800000000 and a.us <> b.us), r as (select *, row_number() over (partition by user_id order by d, a, b) as n from p) select * from r where n <= 3")
def _(t: Tables) -> DataFrame:
    p = j.band_pairs(t.ev, ["user_id"], "us", 0.5 * _HOUR, "event_id", []).select("user_id", F.col("a_event_id").alias("a"), F.col("b_event_id").alias("b"), F.abs(F.col("a_us") - F.col("b_us")).alias("d"))
    return s.first_of_each(p.filter("d > 0"), ["user_id"], ["d", "a", "b"], 3, "n")


@query("wn08_place_sequence", "with v as (select e.user_id, e.event_id, e.us, p.lat, p.lon from ev e join place p on e.k % 25 = p.id where p.lon is not null), l as (select *, lag(lat) over w as lat0, lag(lon) over w as lon0, us - lag(us) over w as step from v window w as (partition by user_id order by us, event_id)) select event_id, step, 2 * 6371.0088 * asin(sqrt((pow(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lon - lon0) / 2), 2)))) as km from l")
def _(t: Tables) -> DataFrame:
    v = t.ev.join(t.place.filter("lon is not null").select("id", "lat", "lon"), F.col("k") % 25 == F.col("id"))
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    before = {c: F.lag(c).over(w) for c in ("lat", "lon", "us")}
    v = v.withColumns({f"{c}0": b for c, b in before.items()})
    return v.select("event_id", (F.col("us") - F.col("us0")).alias("step"), m.haversine_km(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon"), m.config.RADIUS_CASE).alias("km"))


@query("wn09_movement_trace", "with f as (select *, case when event_type = lag(event_type) over (partition by user_id order by us, event_id) then 0 else 1 end as new from ev), i as (select *, sum(new) over (partition by user_id order by us, event_id rows unbounded preceding) as island from f) select user_id, island::bigint as island, min(event_type) as event_type, count(*) as n, max(us) as last_us from i group by 1, 2")
def _(t: Tables) -> DataFrame:
    return s.islands(t.ev, "user_id", ["us", "event_id"], "event_type").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"), F.max("us").alias("last_us"))


@query("wn10_first_pairs", "with p as (select a.user_id, a.event_id as i, b.event_id as j from ev a join ev b on a.user_id = b.user_id and a.event_id < b.event_id and abs(a.us - b.us) <= 7200000000), r as (select *, row_number() over (partition by user_id order by i, j) as n from p) select * from r where n <= 10")
def _(t: Tables) -> DataFrame:
    p = j.band_pairs(t.ev, ["user_id"], "us", 2 * _HOUR, "event_id", []).select("user_id", F.col("a_event_id").alias("i"), F.col("b_event_id").alias("j"))
    return s.first_of_each(p, ["user_id"], ["i", "j"], 10, "n")


@query("wn11_ranked_matches", r"with n as (select id, lower(name) as nm, entity_type, case_id from entity), p as (select a.id as a, b.id as b, len(list_intersect(string_split(a.nm, ' '), string_split(b.nm, ' '))) as hit, b.nm from n a join n b on a.entity_type = b.entity_type and a.case_id = b.case_id and split_part(a.nm, ' ', 2) = split_part(b.nm, ' ', 2) and a.id <> b.id), r as (select a, b, hit, row_number() over (partition by a order by hit desc, nm, b) as n from p) select * from r where n <= 3")
def _(t: Tables) -> DataFrame:
    e = t.entity.withColumn("norm", x.normalize_name(F.col("name"))).withColumn("block", F.split_part("norm", F.lit(" "), F.lit(2)))
    return names.best_in_block(e, ["entity_type", "case_id", "block"], 3)


@query("wn12_next_sequence", "select case_id, max(id) + 1 as next_id from relation group by 1")
def _(t: Tables) -> DataFrame:
    return t.relation.groupBy("case_id").agg((F.max("id") + 1).alias("next_id"))


@query("wn13_kth_occurrence", "select event_id, row_number() over (partition by case_id, event_type order by us, event_id) as kth from ev")
def _(t: Tables) -> DataFrame:
    return t.ev.select("event_id", F.row_number().over(Window.partitionBy("case_id", "event_type").orderBy("us", "event_id")).alias("kth"))


@query("wn14_hub_threshold", "with d as (select id, count(*) as degree from (select a as id from link union all select b from link) group by 1), r as (select degree, row_number() over (order by degree desc, id) as n, count(*) over () as all_n from d) select greatest(2, max(degree) filter (n = floor(all_n * .25) + 1))::bigint as threshold from r")
def _(t: Tables) -> DataFrame:
    from casewright.operators.aggregates import degrees

    return s.hub_threshold(degrees(t.link))


@query("wn15_min_max", "select a, b, case when max(weight) over () - min(weight) over () <= 1e-9 * max(abs(weight)) over () then 0.0 else (weight - min(weight) over ()) / (max(weight) over () - min(weight) over ()) end as x from link")
def _(t: Tables) -> DataFrame:
    return s.min_max(t.link, ["weight"]).select("a", "b", F.col("weight").alias("x"))


@query("wn16_cap_by_type", "with r as (select id, kind, row_number() over (partition by kind order by confidence desc nulls last, id) as n from relation) select * from r where n <= 5")
def _(t: Tables) -> DataFrame:
    return s.first_of_each(t.relation.select("id", "kind", "confidence"), ["kind"], [F.desc_nulls_last("confidence"), F.asc("id")], 5, "n").drop("confidence")


@query("tk01_influencers", "with d as (select id, sum(weight) as strength from (select a as id, weight from link union all select b, weight from link) group by 1) select id, round(strength, 6) as strength from d order by strength desc, id limit 15")
def _(t: Tables) -> DataFrame:
    from casewright.operators.aggregates import degrees

    return degrees(t.link, F.sum("weight").alias("strength")).orderBy(F.desc("strength"), "id").limit(15).select("id", F.round("strength", 6).alias("strength"))


@query("tk02_top_flows", "select src, dst, amount from flow order by amount desc, src, dst limit 3")
def _(t: Tables) -> DataFrame:
    return t.flow.orderBy(F.desc("amount"), "src", "dst").limit(3).select("src", "dst", "amount")


@query("tk03_co_location_top", "with n as (select least(a.user_id, b.user_id) as u, greatest(a.user_id, b.user_id) as v, count(*) as n from ev a join ev b on a.event_type = b.event_type and a.event_id < b.event_id and a.user_id <> b.user_id and abs(a.us - b.us) <= 300000000 group by 1, 2) select * from n order by n desc, u, v limit 6")
def _(t: Tables) -> DataFrame:
    return d.co_location_top(t.ev, "user_id", "event_type", "us", "event_id", _HOUR / 12, 6)


@query("tk05_largest_payments", "select txn_id, amount from pay order by amount desc, txn_id limit 100")
def _(t: Tables) -> DataFrame:
    return t.pay.select("txn_id", "amount").orderBy(F.desc("amount"), "txn_id").limit(100)


@query("tk06_severe_first", "select id, kind from relation order by case when confidence >= .9 then 0 else 1 end, kind, id limit 15")
def _(t: Tables) -> DataFrame:
    return t.relation.orderBy(F.when(F.col("confidence") >= 0.9, 0).otherwise(1), "kind", "id").limit(15).select("id", "kind")


_HITS = "(select '{0}' as kind, {1} as id, {2} as label, case when lower({2}) = '{3}' then 1.0 when starts_with(lower({2}), '{3}') then 0.9 else 0.75 end::double as relevance from {4} where contains(lower({2}), '{3}') order by relevance desc, label, id limit {5})"


@query("tk07_global_search", "select * from (" + " union all ".join(_HITS.format(k, i, c, "nation_1", f, n) for k, i, c, f, n in (("place", "id", "name", "place", 10), ("nation", "n_nationkey", "n_name", "nation", 8))) + " union all " + _HITS.format("person", "id", "name", "nation_1", "person", 15) + ") order by relevance desc, kind, label, id limit 20")
def _(t: Tables) -> DataFrame:
    found = s.search("nation_1", [("place", t.place, "id", "name", 10), ("nation", t.nation, "n_nationkey", "n_name", 8), ("person", t.person, "id", "name", 15)])
    return found.orderBy(F.desc("relevance"), "kind", "label", "id").limit(20)


@query("tk08_subject_links", "select a, b, n, confidence from pair where a = 5 or b = 5 order by n desc, confidence desc nulls last, a, b limit 15")
def _(t: Tables) -> DataFrame:
    return t.pair.filter("a = 5 or b = 5").orderBy(F.desc("n"), F.desc_nulls_last("confidence"), "a", "b").limit(15).select("a", "b", "n", "confidence")


@query("tk09_evidence_impact", "select e.id, count(r.id) as relations from evidence e join relation r on e.source_reference = 'candidate:' || r.candidate_id group by 1 order by 2 desc, 1 limit 25")
def _(t: Tables) -> DataFrame:
    r = t.relation.filter("candidate_id is not null").select(F.concat(F.lit("candidate:"), F.col("candidate_id").cast("string")).alias("source_reference"))
    return t.evidence.join(r, "source_reference").groupBy("id").agg(F.count("*").alias("relations")).orderBy(F.desc("relations"), "id").limit(25)


@query("tk10_hypotheses", "select id, confidence from relation where kind = 'OWNS' order by candidate_id is null, confidence desc nulls last, id limit 12")
def _(t: Tables) -> DataFrame:
    return t.relation.filter("kind = 'OWNS'").orderBy(F.col("candidate_id").isNull(), F.desc_nulls_last("confidence"), "id").limit(12).select("id", "confidence")


@query("tk11_undated_last", "select id, document_id from evidence order by document_id asc nulls last, id limit 40 offset 3960")
def _(t: Tables) -> DataFrame:
    return t.evidence.orderBy(F.asc_nulls_last("document_id"), "id").offset(3960).limit(40).select("id", "document_id")


@query("tk12_table_slice", "select id, name from person order by name, id limit 50 offset 100")
def _(t: Tables) -> DataFrame:
    return t.person.orderBy("name", "id").offset(100).limit(50).select("id", "name")


@query("st01_union_of_detectors", "select 'large' as kind, txn_id as id from pay where amount > 95000 union all select 'late', event_id from ev where event_type = 'error' and value > 200")
def _(t: Tables) -> DataFrame:
    large = t.pay.filter("amount > 95000").select(F.lit("large").alias("kind"), F.col("txn_id").alias("id"))
    return large.unionByName(t.ev.filter("event_type = 'error' and value > 200").select(F.lit("late").alias("kind"), F.col("event_id").alias("id")))


@query("st02_key_difference", "with a as (select distinct src, kind from relation), b as (select distinct src, kind from relation where confidence >= .5) select a.src, a.kind, b.src is not null as kept from a left join b on a.src = b.src and a.kind = b.kind")
def _(t: Tables) -> DataFrame:
    a = t.relation.select("src", "kind").distinct()
    b = t.relation.filter("confidence >= .5").select("src", "kind").distinct().withColumn("kept", F.lit(True))
    return a.join(b, ["src", "kind"], "left").select("src", "kind", F.coalesce("kept", F.lit(False)).alias("kept"))


@query("st03_name_jaccard", "select a.p_partkey, len(list_intersect(string_split(a.p_name, ' '), string_split(lower(a.p_type), ' '))) / len(list_distinct(list_concat(string_split(a.p_name, ' '), string_split(lower(a.p_type), ' '))))::double as share from part a")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", x.jaccard(F.split("p_name", " "), F.split(F.lower("p_type"), " ")).alias("share"))


@query("st04_evidence_minus_one", "with o as (select src, dst, id from relation), m as (select src, dst, min(id) as first from o group by 1, 2) select o.src, o.dst, count(*) as others from o join m using (src, dst) where o.id <> m.first group by 1, 2")
def _(t: Tables) -> DataFrame:
    n = t.relation.groupBy("src", "dst").agg((F.count("*") - 1).alias("others"))
    return n.filter("others > 0")


@query("st05_distinct_in_order", "select user_id, string_agg(event_type, ',' order by f) as kinds from (select user_id, event_type, min((us, event_id)) as f from ev group by 1, 2) group by 1")
def _(t: Tables) -> DataFrame:
    first = t.ev.groupBy("user_id", "event_type").agg(F.min(F.struct("us", "event_id")).alias("f"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("f", "event_type"))), lambda r: r["event_type"]), ",").alias("kinds"))


@query("st06_in_document_dedupe", "select case_id, entity_type, lower(name) as key, min(id) as first_id, count(*) as n from entity group by 1, 2, 3")
def _(t: Tables) -> DataFrame:
    return t.entity.groupBy("case_id", "entity_type", x.normalize_name(F.col("name")).alias("key")).agg(F.min("id").alias("first_id"), F.count("*").alias("n"))


@query("st07_cross_case_listing", "select case_id, id from evidence where case_id in (select id % 5 from person where nation = 3)")
def _(t: Tables) -> DataFrame:
    mine = t.person.filter("nation = 3").select((F.col("id") % 5).alias("case_id")).distinct()
    return t.evidence.join(mine, "case_id", "left_semi").select("case_id", "id")


@query("st08_corroboration_search", "select p.src, p.dst, count(distinct p.mode) as level from pay p join person c on p.src = c.id where contains(lower(c.name), '77') group by 1, 2 having count(distinct p.mode) >= 2")
def _(t: Tables) -> DataFrame:
    who = t.person.filter(F.contains(F.lower("name"), F.lit("77"))).select("id")
    return t.pay.join(who, F.col("src") == F.col("id"), "left_semi").groupBy("src", "dst").agg(F.countDistinct("mode").alias("level")).filter("level >= 2")
