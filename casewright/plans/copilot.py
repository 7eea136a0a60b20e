"""Questions about a case in words (DA27): twelve intents, names found in the case's own entities, answers with citations (CQ02, CQ04, CQ05, CQ10, CQ11)."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.functions import text as x
from casewright.operators import briefs as b
from casewright.operators import graph as gr
from casewright.operators import hypotheses as h
from casewright.operators import joins as j
from casewright.operators import provenance
from casewright.plans.hypotheses import _GAPS, _HYPOTHESES, _gaps, _hypotheses
from casewright.plans.registry import query
from casewright.plans.standin import Tables
from casewright.plans.whatif import _derived

_MIN = 60_000_000
_LONGEST_NAME = 6


@dataclass(frozen=True)
class CaseIntent:
    """What a question is about: stems with their weights, the least and most names, whether it needs or may have a record's number, what it weighs by that alone, and how sure the reading is (a fixed value)."""

    name: str
    stems: dict[str, float]
    sure: float
    names: tuple[int, int] = (0, 9)
    record: bool = False
    alone: float = 0.0


def _stems(weight: float, words: str) -> dict[str, float]:
    return dict.fromkeys(words.split(), weight)


CASE_INTENTS = (
    CaseIntent("impact_simulation", _stems(1.6, "remov impact reclassif discard lose without simulat") | _stems(0.8, "happen if"), 0.86, record=True),
    CaseIntent("evidence_lookup", _stems(1.3, "evidenc prov support cite sourc document पुराव साक्ष"), 0.85, record=True, alone=1.3),
    CaseIntent("relationship_path", _stems(1.4, "connect link relat path between associat संबंध जुड़") | _stems(0.2, "how"), 0.90, names=(2, 9)),
    CaseIntent("neighbourhood", _stems(1.3, "connect link associat around network neighbo near संबंध") | _stems(0.3, "who with"), 0.85, names=(1, 1)),
    CaseIntent("contradictions", _stems(1.5, "contradict inconsist conflict discrep clash विरोधाभास विसंगति"), 0.88),
    CaseIntent("gaps", _stems(1.4, "gap missing lack insufficient need"), 0.86),
    CaseIntent("hypotheses", _stems(1.5, "hypothes explan compet theor rebuttal alternativ"), 0.87),
    CaseIntent("timeline", _stems(1.2, "timelin chronolog sequence happen when event order"), 0.84),
    CaseIntent("evidence_lookup", _stems(1.25, "evidenc prov support cite sourc document पुराव साक्ष"), 0.80),
    CaseIntent("location_query", _stems(1.2, "where locat place geograph mov ठिकाण स्थान कहाँ"), 0.82),
    CaseIntent("case_overview", _stems(1.2, "summar overview outline brief recap know status many much count total number सारांश"), 0.83),
    CaseIntent("entity_profile", _stems(0.9, "profile") | _stems(0.3, "show who about"), 0.70, names=(1, 9), alone=0.4),
    CaseIntent("entity_search", _stems(0.6, "search find look") | _stems(0.2, "who"), 0.60, alone=0.01),
)
_SEARCH_WORDS = set("please can could would you search for find me look up who is there any a the".split())


@dataclass(frozen=True)
class CaseQuestion:
    intent: str
    names: tuple[int, ...] = ()
    record: int | None = None
    hops: int | None = None
    term: str = ""
    confidence: float = 0.0


def question_words(text: str) -> list[str]:
    return re.findall(r"[^\s?.!,;:\"'()]+", text.lower())


def resolve(text: str, entities: DataFrame) -> list[tuple[int, int, int]]:
    """(first word, words, id) of the entities (id, name) that a question names, the longest first, in reading order, the smallest id of a name.

    The runs of words of the question, a bounded number, are the filter on the entities, so only names that occur come to the driver.
    """
    words = question_words(text)
    runs = {" ".join(words[k : k + n]) for n in range(1, _LONGEST_NAME + 1) for k in range(len(words) - n + 1)}
    if not runs:
        return []
    key = x.normalize_name(F.col("name"))
    known = {r["key"]: r["id"] for r in entities.select(key.alias("key"), "id").filter(F.col("key").isin(*sorted(runs))).groupBy("key").agg(F.min("id").alias("id")).collect()}
    found, k = [], 0
    while k < len(words):
        n = next((n for n in range(min(_LONGEST_NAME, len(words) - k), 0, -1) if " ".join(words[k : k + n]) in known), 0)
        if n and known[" ".join(words[k : k + n])] not in {i for _, _, i in found}:
            found.append((k, n, known[" ".join(words[k : k + n])]))
        k += max(n, 1)
    return found


def parse(text: str, entities: DataFrame) -> CaseQuestion:
    """The intent whose stems weigh most among those that the names and the record's number allow, the first of equal ones; ``E17`` or ``evidence 17`` is a record."""
    words = question_words(text)
    found = resolve(text, entities)
    record = re.search(r"\bE(\d+)\b|\b[Ee]vidence\s+#?(\d+)\b", text)
    hops = re.search(r"within\s+(\d+)[\s-]*hop", text, re.I)
    taken = {k for at, n, _ in found for k in range(at, at + n)}
    free = [w for k, w in enumerate(words) if k not in taken]
    fits = [i for i in CASE_INTENTS if i.names[0] <= len(found) <= i.names[1] and (record is not None or not i.record)]
    weight = lambda i: i.alone + sum(max((v for s, v in i.stems.items() if w.startswith(s)), default=0.0) for w in free)
    best = max(fits, key=weight)  # the first of equal ones
    term = " ".join(w for w in words if w not in _SEARCH_WORDS) if best.name == "entity_search" else ""
    return CaseQuestion(best.name, tuple(i for _, _, i in found), int(record[1] or record[2]) if record else None, int(hops[1]) if hops else None, term or (text.strip() if best.name == "entity_search" else ""), best.sure)


class CaseTables:
    """The confirmed records of one case, or of all cases with None."""

    def __init__(self, t: Tables, case_id: int | None = None):
        self.t, self.case_id = t, case_id

    def _of(self, df: DataFrame) -> DataFrame:
        return df if self.case_id is None else df.filter(F.col("case_id") == self.case_id)

    @cached_property
    def entities(self) -> DataFrame:
        return self._of(self.t.entity)

    @cached_property
    def relations(self) -> DataFrame:
        return self._of(self.t.relation)

    @cached_property
    def links(self) -> DataFrame:
        return self.relations.filter("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()

    @cached_property
    def evidence(self) -> DataFrame:
        return self._of(self.t.evidence)

    @cached_property
    def events(self) -> DataFrame:
        k = F.col("k")
        return self._of(
            self.t.ev.select(
                F.col("event_id").alias("id"), F.col("user_id").alias("entity"), (F.col("user_id") % 5).alias("case_id"), F.col("event_type").alias("kind"), F.when(k % 7 > 0, F.col("us")).alias("us"),
                (k % 25).cast("long").alias("location"), F.when(k % 6 == 0, F.col("event_id") * 10).alias("evidence"),
            )
        )

    @cached_property
    def claims(self) -> DataFrame:
        k = F.col("k")
        said = F.when(k % 3 == 1, F.concat(F.lit("Nation_"), (k % 25).cast("string"))).when(k % 3 == 2, F.concat(F.lit(" NATION_"), (k % 12).cast("string"), F.lit(" ")))
        return self._of(
            self.t.ev.filter("event_type = 'purchase'").select(
                F.col("event_id").alias("id"), (F.col("user_id") % 5).alias("case_id"), F.col("user_id").alias("subject"), F.when(k % 3 == 0, k % 10).cast("long").alias("object_entity"), said.alias("object_value"),
                F.when(k % 2 == 0, k % 25).cast("long").alias("location"), F.when(k % 5 == 0, F.col("event_id") * 10).alias("evidence"),
            )
        )

    @cached_property
    def locations(self) -> DataFrame:
        return self._of(self.t.place.select(F.col("id").cast("long").alias("id"), F.col("case_id").cast("long").alias("case_id"), "name", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")))

    @cached_property
    def spots(self) -> DataFrame:
        return self._of(self.t.supplier.select(F.col("s_suppkey").cast("long").alias("id"), (F.col("s_suppkey") % 5).cast("long").alias("case_id"), F.concat(F.lit("nation_"), F.col("s_nationkey").cast("string")).alias("name")))

    @cached_property
    def findings(self) -> DataFrame:
        """Contradictions: two events of one subject and kind within a quarter of an hour that differ."""
        ev = self.t.ev.withColumn("case_id", F.col("user_id") % 5)
        p = j.band_pairs(self._of(ev), ["user_id", "event_type"], "us", 15 * _MIN, "event_id", ["k"]).filter("a_k != b_k")
        one, two = F.least("a_event_id", "b_event_id"), F.greatest("a_event_id", "b_event_id")
        return p.select(
            (one * 1_000_000 + two).alias("id"), (F.col("user_id") % 5).alias("case_id"), F.concat_ws(" ", "event_type", one.cast("string"), two.cast("string")).alias("title"), (F.abs(F.col("a_us") - F.col("b_us")) <= 5 * _MIN).alias("high"),
            F.array("user_id").alias("entities"), F.array(one * 10, two * 10).alias("evidence"),
        )


def _row(place, label, value, cites, sure) -> list:
    value = value.cast("double")
    return [place.cast("int").alias("place"), label.cast("string").alias("label"), value.alias("value"), cites.cast("array<string>").alias("citations"), sure.cast("double").alias("confidence")]


def reply(q: CaseQuestion, c: CaseTables) -> DataFrame:
    """The answer of a question over one case: (place, label, value, citations, confidence), as many rows as an answer shows. A case without the records asked for gives no rows."""
    col, lit = F.col, F.lit
    one = q.names[0] if q.names else None
    match q.intent:
        case "case_overview":
            parts = {"entities": c.entities, "relationships": c.relations, "evidence": c.evidence, "events": c.events, "locations": c.locations, "claims": c.claims, "findings": c.findings}
            counts = [df.agg(F.count("*").alias("value")).select(lit(k).alias("place"), lit(n).alias("label"), "value") for k, (n, df) in enumerate(parts.items(), 1)]
            rows = counts[0]
            for n in counts[1:]:
                rows = rows.unionByName(n)
            high = b.numbered(c.findings.filter("high"), ["title", "id"], 3).agg(F.sort_array(F.collect_list(b.cite("finding", "id"))).alias("cites"))
            total = F.sum(F.when(col("place") <= 4, col("value")))
            rows = b.surely(rows, 0.3 + 0.7 * b.share(total, 20)).join(F.broadcast(high))
            return rows.select(*_row(col("place"), col("label"), col("value"), col("cites"), col("confidence")))
        case "entity_profile":
            mine = col("id") == one
            p = b.profiles(c.entities.filter(mine), c.relations.filter((col("src") == one) | (col("dst") == one)), c.events.filter(col("entity") == one), c.claims.filter(col("subject") == one), c.findings.filter(F.array_contains("entities", lit(one).cast("long"))))
            return p.select(*_row(lit(1), col("name"), col("relations"), col("citations"), col("confidence")))
        case "relationship_path":
            paths = gr.shortest_paths(c.links, one, q.names[1], q.hops or b.MOST_HOPS)
            first = paths.orderBy("path").limit(1)
            sure = F.greatest(lit(0.0), 1.0 - 0.15 * (col("hops") - 1))
            return first.select(*_row(lit(1), F.array_join(col("path").cast("array<string>"), " > "), col("hops"), F.transform("path", lambda n: b.cite("entity", n)), sure))
        case "neighbourhood":
            near = b.neighbourhoods(c.entities, c.links, c.entities.filter(col("id") == one).select("id"), q.hops or 2).filter("cited is not null")
            return near.select(*_row(col("cited"), col("name"), col("distance"), F.array(b.cite("entity", "id")), col("confidence")))
        case "timeline":
            scoped = c.events if one is None else c.events.filter(col("entity") == one)
            lines = b.timelines(scoped, "case_id").filter("cited is not null")
            return lines.select(*_row(col("cited"), col("kind"), col("us"), F.array(b.cite("event", "id")), col("confidence")))
        case "contradictions":
            rows = b.numbered(c.findings, [F.desc("high"), F.asc("title"), F.asc("id")], 10)
            cites = F.concat(F.array(b.cite("finding", "id")), F.transform("evidence", lambda e: b.cite("evidence", e)))
            return rows.select(*_row(col("place"), col("title"), col("high").cast("int"), cites, lit(1.0)))
        case "gaps":
            rows = b.numbered(c._of(_gaps(c.t)).drop("place"), ["kind", F.desc("amount"), "a", F.asc_nulls_last("b")], 10)
            kind = F.when(col("kind") == "TIMELINE_GAP", "event").otherwise("entity")
            return rows.select(*_row(col("place"), col("kind"), col("amount"), F.array_compact(F.array(F.concat_ws(":", kind, col("a").cast("string")), F.when(col("b").isNotNull(), F.concat_ws(":", kind, col("b").cast("string"))))), lit(1.0)))
        case "hypotheses":
            rows = b.numbered(c._of(_hypotheses(c.t)), ["rank"], 8)
            cites = F.concat(F.array(b.cite("hypothesis", "rank")), F.transform(F.slice("evidence", 1, 2), lambda e: b.cite("evidence", e)))
            return b.surely(rows, F.max("score")).select(*_row(col("place"), col("title"), col("score"), cites, col("confidence")))
        case "evidence_lookup" if q.record is not None:
            cited = b.cites_of_evidence(c.evidence.filter(col("id") == q.record), c.relations, c.events, c.claims, c.findings)
            rows = b.numbered(cited, ["kind"], 4)
            return rows.select(*_row(col("place"), col("kind"), col("n"), F.transform("first", lambda i: F.concat_ws(":", col("kind"), i.cast("string"))), lit(1.0)))
        case "evidence_lookup" if one is not None:
            ids = b.proofs_of_entities(c.relations.filter((col("src") == one) | (col("dst") == one)), c.evidence, c.events, c.claims).filter(col("entity") == one)
            rows = b.surely(ids, 0.5 + 0.5 * b.share(F.count("*"), 5))
            return b.numbered(rows, ["evidence"], 10).select(*_row(col("place"), lit("evidence"), lit(None), F.array(b.cite("evidence", "evidence")), col("confidence")))
        case "evidence_lookup":
            return b.numbered(c.evidence, ["id"], 15).select(*_row(col("place"), col("evidence_type"), lit(None), F.array(b.cite("evidence", "id")), lit(1.0)))
        case "location_query":
            found = b.places_of_cases(c.claims, c.locations, c.spots) if one is None else b.places_of_entities(c.claims.filter(col("subject") == one), c.locations, c.spots, c.events.filter(col("entity") == one))
            return found.filter("cited is not null").select(*_row(col("cited"), col("name"), col("claims"), col("citations"), col("confidence")))
        case "impact_simulation":
            sole = provenance.sole_grounds(_derived(c.t).join(c.entities.select(col("id").alias("a")), "a", "left_semi"), ["a", "b"]).filter(col("record") == q.record)
            return b.numbered(sole, ["a", "b"], 8).select(*_row(col("place"), F.concat_ws(" - ", col("a").cast("string"), col("b").cast("string")), lit(None), F.array(lit(f"evidence:{q.record}"), b.cite("entity", "a"), b.cite("entity", "b")), lit(1.0)))
        case "entity_search":
            hits = c.entities.filter(F.contains(x.normalize_name(col("name")), x.normalize_name(lit(q.term))))
            rows = b.surely(hits, F.when(F.count("*") == 0, 1.0).otherwise(0.4 + 0.6 * b.share(F.count("*"), 5)))
            return b.numbered(rows, ["name", "id"], 20).select(*_row(col("place"), col("name"), lit(None), F.array(b.cite("entity", "id")), col("confidence")))
    raise ValueError(q.intent)


def ask(text: str, c: CaseTables) -> DataFrame:
    return reply(parse(text, c.entities.select("id", "name")), c)


# --- all subjects of all cases ---------------------------------------------------------------------------------------
_NORM = r"lower(trim(regexp_replace({}, '\s+', ' ', 'g')))"
_CASE_SQL = (
    "ce as (select event_id as id, user_id as entity, user_id % 5 as case_id, event_type as kind, case when k % 7 > 0 then us end as us, k % 25 as location, case when k % 6 = 0 then event_id * 10 end as evidence from ev), "
    "cc as (select event_id as id, user_id % 5 as case_id, user_id as subject, case when k % 3 = 0 then k % 10 end as object_entity, case k % 3 when 1 then 'Nation_' || (k % 25) when 2 then ' NATION_' || (k % 12) || ' ' end as object_value, case when k % 2 = 0 then k % 25 end as location, "
    "case when k % 5 = 0 then event_id * 10 end as evidence from ev where event_type = 'purchase'), "
    "cs as (select s_suppkey as id, s_suppkey % 5 as case_id, 'nation_' || s_nationkey as name from supplier), "
    "cf as (select a.event_id * 1000000 + b.event_id as id, a.user_id % 5 as case_id, a.event_type || ' ' || a.event_id || ' ' || b.event_id as title, abs(a.us - b.us) <= 300000000 as high, a.user_id as entity, [a.event_id * 10, b.event_id * 10] as evidence "
    "from ev a join ev b on a.user_id = b.user_id and a.event_type = b.event_type and a.event_id < b.event_id and abs(a.us - b.us) <= 900000000 and a.k <> b.k)"
)
_PROFILES = (
    "en as (select src as id, id as relation, kind, dst as other from relation union all select dst, id, kind, src from relation where src <> dst), "
    "kn as (select id, sum(n)::bigint as relations, list_sort(list(kind || ' x ' || n)) as kinds from (select id, kind, count(*) as n from en group by 1, 2) group by 1), "
    "lk as (select id, count(distinct other) as linked from en where other <> id group by 1), se as (select entity as id, count(*) as events, max(us) as last_event from ce group by 1), "
    "sa as (select subject as id, count(*) as claims from cc group by 1), fo as (select entity as id, count(*) as findings from cf group by 1), "
    "ci as (select id, 1 as section, row_number() over (partition by id order by relation) as seat, 'relationship:' || relation as cited from en union all select entity, 2, row_number() over (partition by entity order by us nulls last, id), 'event:' || id from ce "
    "union all select entity, 3, row_number() over (partition by entity order by id), 'finding:' || id from cf), cl as (select id, list(cited order by section, seat) as cited from ci where seat <= case section when 3 then 3 else 8 end group by 1), "
    "pr as (select e.id, e.case_id, e.name, e.entity_type, coalesce(relations, 0) as relations, coalesce(linked, 0) as linked, coalesce(events, 0) as events, coalesce(claims, 0) as claims, coalesce(findings, 0) as findings, last_event, coalesce(kinds, []) as kinds, list_concat(['entity:' || e.id], coalesce(cited, [])) as citations, "
    "(.4 + .15 * (least(1.0, coalesce(relations, 0) / 3) + least(1.0, coalesce(events, 0) / 3) + least(1.0, coalesce(claims, 0) / 2) + least(1.0, coalesce(findings, 0) / 2)))::double as confidence "
    "from entity e left join kn using (id) left join lk using (id) left join se using (id) left join sa using (id) left join fo using (id) left join cl using (id))"
)


@query("cq02_entity_profiles", f"with {_CASE_SQL}, {_PROFILES} select id, name, entity_type, relations, linked, events, claims, findings, last_event, kinds, confidence, citations from pr")
def _(t: Tables) -> DataFrame:
    """The profile of every entity: relations by kind, linked entities, events, claims and findings, and what it cites."""
    c = CaseTables(t)
    return b.profiles(c.entities, c.relations, c.events, c.claims, c.findings)


_HUBS = "dg as (select id, count(*) as degree from (select a as id from pair union all select b from pair) group by 1), hb as (select case_id, arg_min(id, (-degree, id)) as subject from entity join dg using (id) group by 1)"
_NEAR = (
    "u as (select a, b from pair union all select b, a from pair), n1 as (select subject, case_id, b as id, 1 as distance from hb join u on u.a = subject), "
    "nb as (select * from n1 union all select distinct n1.subject, n1.case_id, u.b, 2 from n1 join u on u.a = n1.id where u.b <> n1.subject and (n1.subject, u.b) not in (select (subject, id) from n1)), "
    "nr as (select nb.subject, nb.case_id, id, name, entity_type, distance, .5 + .5 * least(1.0, count(*) over (partition by subject) / 10)::double as confidence, row_number() over (partition by subject order by distance, name, id) as r from nb join entity using (id))"
)


def _hubs(t: Tables) -> DataFrame:
    """(case_id, id): the entity with most links of each case, the smallest id of equal ones."""
    degree = gr.both_ways(t.pair.select("a", "b")).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return t.entity.join(degree, "id").groupBy("case_id").agg(F.min(F.struct(-F.col("degree"), "id"))["id"].alias("id"))


@query("cq04_neighbourhoods", f"with {_HUBS}, {_NEAR} select subject, id, name, entity_type, distance, confidence, case when r <= 10 then r end as cited from nr")
def _(t: Tables) -> DataFrame:
    """What is within two hops of the best connected entity of each case."""
    return b.neighbourhoods(t.entity, t.pair, _hubs(t), 2)


_TIMED = "tm as (select *, count(*) over (partition by {0}) as total, count(us) over (partition by {0}) as dated from ce), tl as (select *, (.4 + .6 * dated / total)::double as confidence, row_number() over (partition by {0} order by us, id) as r from tm where us is not null)"


@query("cq05_timeline_events", f"with {_CASE_SQL}, {_TIMED.format('entity')} select entity, id, kind, us, location, evidence, total, dated, confidence, case when r <= 15 then r end as cited from tl")
def _(t: Tables) -> DataFrame:
    """The dated events of every entity, how much of its timeline is dated, and those that an answer cites."""
    return b.timelines(CaseTables(t).events.drop("case_id"), "entity")


def _places_sql(scope: str) -> str:
    shape = f"{scope}, name, source, entity_id, location_id, lat, lon, claim"
    said = f"select cc.{scope}, coalesce(cs.name, object_value) as name, 2 as source, cs.id as entity_id, cc.location as location_id, place.lat::double as lat, place.lon::double as lon, cc.id as claim from cc left join cs on cs.id = cc.object_entity left join place on place.id = cc.location"
    if scope == "case_id":
        rest = "select case_id, name, 1, null, id, lat, lon, null from place union all select case_id, name, 3, id, null, null, null, null from cs"
    else:
        rest = "select subject, name, 1, null, id, lat, lon, null from (select subject, location from cc where location is not null union select entity, location from ce where location is not null) td join place on place.id = td.location"
    return (
        f"pw as ({said} union all {rest}), pk as (select {shape}, {_NORM.format('name')} as key from pw where trim(name) <> ''), "
        f"pm as (select {scope}, key, arg_min(name, (source, name)) as name, min(entity_id) as entity_id, min(case when location_id is not null then (source, location_id) end) as own, count(distinct claim) as claims, list_sort(list(distinct claim) filter (claim is not null))[1:3] as said from pk group by 1, 2), "
        f"pl as (select pm.*, own[2] as location_id, place.lat::double as lat, place.lon::double as lon from pm left join place on place.id = own[2]), "
        f"px as (select *, (.5 + .5 * count(*) filter (lat is not null and lon is not null) over (partition by {scope}) / count(*) over (partition by {scope}))::double as confidence, row_number() over (partition by {scope} order by claims desc, lower(name), key) as r, "
        "list_concat(case when location_id is not null then ['location:' || location_id] when entity_id is not null then ['entity:' || entity_id] else [] end, list_transform(coalesce(said, []), lambda c: 'claim:' || c)) as citations from pl)"
    )


_PLACE_COLUMNS = "name, entity_id, location_id, lat, lon, claims, confidence, case when r <= 10 then r end as cited, citations"


@query("cq11_places_of_cases", f"with {_CASE_SQL}, {_places_sql('case_id')} select case_id, {_PLACE_COLUMNS} from px")
def _(t: Tables) -> DataFrame:
    """The places of every case, merged by name from location rows, entities that are places and claims."""
    c = CaseTables(t)
    return b.places_of_cases(c.claims, c.locations, c.spots)


@query("cq11_places_of_entities", f"with {_CASE_SQL}, {_places_sql('subject')} select subject, {_PLACE_COLUMNS} from px")
def _(t: Tables) -> DataFrame:
    c = CaseTables(t)
    return b.places_of_entities(c.claims, c.locations, c.spots, c.events)


_PROOFS = (
    "pf as (select unnest([src, dst]) as entity, e.id as evidence from relation r join evidence e on e.source_reference = 'candidate:' || r.candidate_id union select entity, evidence from ce where evidence is not null union select subject, evidence from cc where evidence is not null)"
)


@query("cq10_records_of_entities", f"with {_CASE_SQL}, {_PROOFS} select entity, evidence from pf")
def _(t: Tables) -> DataFrame:
    """Each record that an entity's relations, events and claims rest on."""
    c = CaseTables(t)
    return b.proofs_of_entities(c.relations, c.evidence, c.events, c.claims)


_CITING = (
    "ct as (select e.id as evidence, 'relationship' as kind, r.id as key, 6 as most from relation r join evidence e on e.source_reference = 'candidate:' || r.candidate_id union select evidence, 'event', id, 6 from ce union select evidence, 'claim', id, 4 from cc union select unnest(evidence), 'finding', id, 3 from cf), "
    "cg as (select evidence, kind, count(*) as n, list_sort(list(key))[1:any_value(most)] as first from ct where evidence in (select id from evidence) group by 1, 2)"
)


@query("cq09_records_cited_by", f"with {_CASE_SQL}, {_CITING} select evidence, kind, n, first from cg")
def _(t: Tables) -> DataFrame:
    """What rests on each record of evidence, by kind."""
    c = CaseTables(t)
    return b.cites_of_evidence(c.evidence, c.relations, c.events, c.claims, c.findings)


# --- one question of each intent, over case 0 -------------------------------------------------------------------------
# A question names the best connected entity of the case, and the first one at distance two from it, as they are written;
# a name that several entities have stands for the smallest id, so both are such ids.
_ONE = "ez as (select * from ev where user_id % 5 = 0), pz as (select * from place where case_id = 0), " + (_CASE_SQL.replace("from ev", "from ez").replace("join ev", "join ez") + ", ").replace("from supplier)", "from supplier where s_suppkey % 5 = 0)")
_NAMED = (
    "u as (select a, b from pair union all select b, a from pair), dg as (select a as id, count(*) as degree from u group by 1), cn as (select min(id) as id from entity where case_id = 0 group by lower(name)), "
    "hu as (select id from cn join dg using (id) order by degree desc, id limit 1), "
    "ot as (select min(y.b) as id from hu join u x on x.a = hu.id join u y on y.a = x.b where y.b in (select id from cn) and y.b <> hu.id and y.b not in (select b from u where a = hu.id)), "
    "dv as (select least(src, dst) as a, greatest(src, dst) as b, case when candidate_id is not null then e.id end as record, candidate_id is null as free from relation r left join evidence e on e.source_reference = 'candidate:' || r.candidate_id "
    "where src <> dst and (candidate_id is null or e.id is not null)), sg as (select a, b, min(record) as record from dv group by 1, 2 having count(distinct record) = 1 and not bool_or(free)), "
    "s0 as (select a, b, record from sg where a in (select id from entity where case_id = 0)), rc as (select min(record) as id from s0), "
)


def _hub(t: Tables) -> int:
    degree = gr.both_ways(t.pair.select("a", "b")).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return _first_of_names(t).join(degree, "id").orderBy(F.desc("degree"), "id").first()["id"]


def _first_of_names(t: Tables) -> DataFrame:
    return t.entity.filter("case_id = 0").groupBy(x.normalize_name(F.col("name"))).agg(F.min("id").alias("id")).select("id")


def _name(t: Tables, key: int) -> str:
    return t.entity.filter(F.col("id") == key).first()["name"]


def _second(t: Tables, hub: int) -> int:
    near = gr.within_hops(t.pair.select("a", "b"), 2, t.entity.filter(F.col("id") == hub).select("id")).filter("d = 2").select(F.col("v").alias("id"))
    return near.join(_first_of_names(t), "id").agg(F.min("id")).first()[0]


def _record(t: Tables) -> int:
    return provenance.sole_grounds(_derived(t).join(t.entity.filter("case_id = 0").select(F.col("id").alias("a")), "a", "left_semi"), ["a", "b"]).agg(F.min("record")).first()[0]


def _case(t: Tables) -> CaseTables:
    return CaseTables(t, 0)


@query(
    "da27_case_overview",
    f"with {_ONE} cnt as (select 1 as place, 'entities' as label, count(*) as value from entity where case_id = 0 union all select 2, 'relationships', count(*) from relation where case_id = 0 union all select 3, 'evidence', count(*) from evidence where case_id = 0 union all select 4, 'events', count(*) from ce "
    "union all select 5, 'locations', count(*) from pz union all select 6, 'claims', count(*) from cc union all select 7, 'findings', count(*) from cf), hi as (select list_sort(list('finding:' || id)) as cites from (select id from cf where high order by title, id limit 3)) "
    "select place, label, value::double as value, coalesce(cites, []) as citations, (.3 + .7 * least(1.0, (select sum(value) from cnt where place <= 4) / 20))::double as confidence from cnt, hi",
)
def _(t: Tables) -> DataFrame:
    return ask("Summarize the case so far", _case(t))


@query("da27_entity_profile", f"with {_ONE}{_NAMED}{_PROFILES} select 1 as place, name as label, relations::double as value, citations, confidence from pr where id = (select id from hu)")
def _(t: Tables) -> DataFrame:
    return ask(f"Show me the profile of {_name(t, _hub(t))}", _case(t))


@query("da27_relationship_path", f"with {_NAMED} pa as (select min([hu.id, x.b, ot.id]) as path from hu, ot, u x, u y where x.a = hu.id and y.a = x.b and y.b = ot.id) select 1 as place, array_to_string(path, ' > ') as label, 2.0::double as value, list_transform(path, lambda n: 'entity:' || n) as citations, .85::double as confidence from pa where path is not null")
def _(t: Tables) -> DataFrame:
    hub = _hub(t)
    return ask(f"How is {_name(t, hub)} connected to {_name(t, _second(t, hub))}?", _case(t))


@query("da27_neighbourhood", f"with {_NAMED} hb as (select 0 as case_id, id as subject from hu), {_NEAR[_NEAR.index('n1 as'):]} select r as place, name as label, distance::double as value, ['entity:' || id] as citations, confidence from nr where r <= 10")
def _(t: Tables) -> DataFrame:
    return ask(f"Who is connected to {_name(t, _hub(t))}?", _case(t))


@query("da27_timeline", f"with {_ONE}{_TIMED.format('case_id')} select r as place, kind as label, us::double as value, ['event:' || id] as citations, confidence from tl where r <= 15")
def _(t: Tables) -> DataFrame:
    return ask("What happened, in order?", _case(t))


@query("da27_contradictions", f"with {_ONE} f as (select * from cf order by high desc, title, id limit 10) select row_number() over (order by high desc, title, id) as place, title as label, high::int::double as value, list_concat(['finding:' || id], list_transform(evidence, lambda e: 'evidence:' || e)) as citations, 1.0::double as confidence from f")
def _(t: Tables) -> DataFrame:
    return ask("Which contradictions are there?", _case(t))


@query(
    "da27_gaps",
    _GAPS + ", gz as (select kind, a, b, amount, row_number() over (order by kind, amount desc, a, b nulls last) as place from gp where place <= 5 and case_id = 0), gy as (select *, case kind when 'TIMELINE_GAP' then 'event:' else 'entity:' end as sort from gz where place <= 10) "
    "select place, kind as label, amount::double as value, list_filter([sort || a, sort || b], lambda c: c is not null) as citations, 1.0::double as confidence from gy",
)
def _(t: Tables) -> DataFrame:
    return ask("What data is missing?", _case(t))


@query("da27_hypotheses", _HYPOTHESES + " select rank as place, title as label, score::double as value, list_concat(['hypothesis:' || rank], list_transform(evidence[1:2], lambda e: 'evidence:' || e)) as citations, (select max(score) from hy where case_id = 0)::double as confidence from hy where case_id = 0 and rank <= 8")
def _(t: Tables) -> DataFrame:
    return ask("What are the competing hypotheses?", _case(t))


@query("da27_evidence_record", f"with {_ONE}{_NAMED}{_CITING} select row_number() over (order by kind) as place, kind as label, n::double as value, list_transform(first, lambda i: kind || ':' || i) as citations, 1.0::double as confidence from cg where evidence = (select id from rc)")
def _(t: Tables) -> DataFrame:
    return ask(f"What is E{_record(t)}?", _case(t))


@query("da27_evidence_about", f"with {_ONE}{_NAMED}{_PROOFS}, pn as (select evidence, row_number() over (order by evidence) as place, .5 + .5 * least(1.0, count(*) over () / 5) as confidence from pf where entity = (select id from hu)) select place, 'evidence' as label, null::double as value, ['evidence:' || evidence] as citations, confidence::double as confidence from pn where place <= 10")
def _(t: Tables) -> DataFrame:
    return ask(f"Find evidence about {_name(t, _hub(t))}.", _case(t))


@query("da27_location_query", f"with {_ONE}{_places_sql('case_id').replace('place ', 'pz ').replace('place.', 'pz.')} select r as place, name as label, claims::double as value, citations, confidence from px where r <= 10")
def _(t: Tables) -> DataFrame:
    return ask("Where? Which locations are recorded?", _case(t))


@query("da27_impact_simulation", f"with {_NAMED} im as (select *, row_number() over (order by a, b) as place from s0 where record = (select id from rc)) select place, a || ' - ' || b as label, null::double as value, ['evidence:' || record, 'entity:' || a, 'entity:' || b] as citations, 1.0::double as confidence from im where place <= 8")
def _(t: Tables) -> DataFrame:
    return ask(f"What happens if we remove E{_record(t)}?", _case(t))


@query("da27_entity_search", "with f as (select id, name, row_number() over (order by name, id) as place, .4 + .6 * least(1.0, count(*) over () / 5) as confidence from entity where case_id = 0 and contains(lower(name), 'machinery')) select place, name as label, null::double as value, ['entity:' || id] as citations, confidence::double as confidence from f where place <= 20")
def _(t: Tables) -> DataFrame:
    return ask("Search for Machinery", _case(t))
