"""Questions in words are read as what they are about; answers hold for subjects without rows, nulls, ties and empty tables."""

import pytest

from casewright.operators import briefs as b
from casewright.plans import copilot


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(1, "Asha Patil"), (2, "Vikram  Sethi"), (3, "asha patil"), (4, "Asha Patil Rao"), (5, "विक्रम सेठी"), (6, None)], "id long, name string").cache()


@pytest.mark.parametrize(
    "text, intent, names, record",
    [
        ("Summarize the case", "case_overview", (), None), ("How many events are there in total?", "case_overview", (), None), ("Show the profile for Asha Patil", "entity_profile", (1,), None), ("asha patil rao?", "entity_profile", (4,), None),
        ("How is Vikram Sethi connected to Asha Patil within 4 hops?", "relationship_path", (2, 1), None), ("Who is connected to विक्रम सेठी", "neighbourhood", (5,), None), ("What happened to Asha Patil?", "timeline", (1,), None),
        ("Are there contradictions?", "contradictions", (), None), ("What is missing?", "gaps", (), None), ("What are the competing hypotheses?", "hypotheses", (), None), ("Find evidence about Asha Patil.", "evidence_lookup", (1,), None),
        ("What is E17?", "evidence_lookup", (), 17), ("Describe evidence 17", "evidence_lookup", (), 17), ("What happens if we remove E17?", "impact_simulation", (), 17), ("What would we lose without evidence #17?", "impact_simulation", (), 17),
        ("Where was Asha Patil?", "location_query", (1,), None), ("Search for hidden money", "entity_search", (), None), ("", "entity_search", (), None), ("Kumar", "entity_search", (), None),
    ],
)
def test_intents(people, text, intent, names, record):
    q = copilot.parse(text, people)
    assert (q.intent, q.names, q.record) == (intent, names, record)


def test_hops_and_terms(people):
    assert copilot.parse("How is Vikram Sethi connected to Asha Patil within 4 hops?", people).hops == 4
    assert copilot.parse("Please search for Hidden Money", people).term == "hidden money"
    assert copilot.parse("anything", people.limit(0)).term == "anything"


def _tables(spark, relations=(), events=(), claims=(), findings=()):
    return (
        spark.createDataFrame(list(relations), "id long, kind string, src long, dst long"), spark.createDataFrame(list(events), "id long, entity long, us long"),
        spark.createDataFrame(list(claims), "id long, subject long"), spark.createDataFrame(list(findings), "id long, entities array<long>"),
    )


def test_profiles(spark, people):
    entities = people.selectExpr("id", "name", "'PERSON' as entity_type")
    alone = {r["id"]: r for r in b.profiles(entities, *_tables(spark)).collect()}
    assert len(alone) == 6 and all(r["relations"] == r["events"] == 0 and r["kinds"] == [] and r["citations"] == [f"entity:{k}"] and r["confidence"] == pytest.approx(0.4) for k, r in alone.items())
    assert b.profiles(entities.limit(0), *_tables(spark, [(1, "X", 1, 2)])).count() == 0
    relations = [(k, "CALLED" if k % 2 else "OWNS", 1, 2) for k in range(1, 13)] + [(20, "CALLED", 1, 1), (21, "CALLED", 1, None), (22, "CALLED", 99, 98)]
    events = [(1, 1, None), (2, 1, 50), (3, 1, 40), (4, None, 1)]
    got = {r["id"]: r for r in b.profiles(entities, *_tables(spark, relations, events, [(1, 1), (2, 1), (3, None)], [(5, [1, 1, 2]), (4, [1]), (6, None)])).collect()}
    one = got[1]
    assert (one["relations"], one["linked"], one["events"], one["last_event"], one["claims"], one["findings"]) == (14, 1, 3, 50, 2, 2)
    assert one["kinds"] == ["CALLED x 8", "OWNS x 6"] and one["confidence"] == pytest.approx(1.0)
    assert one["citations"] == ["entity:1", *(f"relationship:{k}" for k in range(1, 9)), "event:3", "event:2", "event:1", "finding:4", "finding:5"]
    assert got[2]["relations"] == 12 and got[2]["findings"] == 1


def test_timelines_cite_the_first_fifteen(spark):
    events = spark.createDataFrame([(k, 7, None if k % 4 == 0 else 100 - k // 2, "x") for k in range(40)], "id long, entity long, us long, total string")
    got = b.timelines(events, "entity").collect()
    want = sorted((100 - k // 2, k) for k in range(40) if k % 4)
    assert len(got) == 30 and {(r["us"], r["id"]) for r in got if r["cited"]} == set(want[:15]) and sorted(r["cited"] for r in got if r["cited"]) == list(range(1, 16))
    assert all((r["total"], r["dated"]) == (40, 30) and r["confidence"] == pytest.approx(0.85) for r in got)
    assert b.timelines(events.filter("us is null"), "entity").count() == 0


def test_places_are_merged_by_name(spark):
    locations = spark.createDataFrame([(1, 0, "Harbour  Road", 1.0, 2.0), (2, 0, "Mill", 3.0, None), (3, 0, None, 1.0, 1.0)], "id long, case_id long, name string, lat double, lon double")
    spots = spark.createDataFrame([(50, 0, "harbour road"), (51, 0, "Depot")], "id long, case_id long, name string")
    claims = spark.createDataFrame([(9, 0, 7, 50, None, 1), (8, 0, 7, None, "HARBOUR ROAD ", None), (7, 0, 7, None, " ", None), (6, 0, None, 99, "Gate", 2)], "id long, case_id long, subject long, object_entity long, object_value string, location long")
    got = {r["name"]: r for r in b.places_of_cases(claims, locations, spots).collect()}
    assert set(got) == {"Harbour  Road", "Mill", "Gate", "Depot"}
    road = got["Harbour  Road"]
    assert (road["entity_id"], road["location_id"], road["lat"], road["claims"], road["cited"]) == (50, 1, 1.0, 2, 1)
    assert road["citations"] == ["location:1", "claim:8", "claim:9"] and got["Depot"]["citations"] == ["entity:51"] and road["confidence"] == pytest.approx(0.5 + 0.5 / 4)
    mine = b.places_of_entities(claims, locations, spots, spark.createDataFrame([(7, 2), (None, 1)], "entity long, location long")).collect()
    assert {(r["subject"], r["name"], r["claims"]) for r in mine} == {(7, "Harbour  Road", 2), (7, "Mill", 0)}
    assert b.places_of_cases(claims.limit(0), locations.limit(0), spots.limit(0)).count() == 0
