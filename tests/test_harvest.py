"""Case files by lines, written dates, and counts of cases: known small files, nulls, empty tables, repeated rows."""

import pytest
from pyspark.sql import functions as F

from casewright.functions import stamps
from casewright.operators import counts
from casewright.operators import harvest as h

_FILE = [
    "CASE FILE 12/2024", "Suspect: Mr. Manish Kharat (age 40), +91 98200 11111", "Contact: 98765-43210", "A/C: note", "Account No: XXXX123456", "Vidya Bhavan Junior College gave marks to Dr. Asha Rao and Manish Kharat",
    "Address: 12 Mill Lane", "SECOND PART", "IMEI: 123456789012345", "mail A.B@Post.in twice a.b@post.in", None, "   ", "Police Station", "Tuesday Report", "Satara Road",
]


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(1, k, t) for k, t in enumerate(_FILE)] + [(2, 0, "Manish Kharat met Ravi Kumar"), (3, 0, None)]
    return spark.createDataFrame(rows, "document long, line_no int, line string").cache()


def test_candidates(lines):
    got = {(r["document"], r["key"]): (r["name"], r["role"], r["mentions"]) for r in h.candidates(h.found_in_lines(lines)).collect()}
    assert got == {
        (1, "person:manishkharat"): ("Manish Kharat", "Person of interest", 4), (1, "person:asharao"): ("Asha Rao", "Named person", 2), (1, "phone_number:919820011111"): ("+91 98200 11111", "Number in record", 1),
        (1, "phone_number:919876543210"): ("+91 98765 43210", "Number in record", 1), (1, "bank_account:acxxxx123456"): ("A/C XXXX123456", "Account in record", 1),
        (1, "organization:vidyabhavanjuniorcollege"): ("Vidya Bhavan Junior College", "Organisation", 2), (1, "address:12milllane"): ("12 Mill Lane", "Address in record", 1),
        (1, "asset:imei123456789012345"): ("IMEI 123456789012345", "Device identifier", 1), (1, "asset:abpostin"): ("a.b@post.in", "Online identifier", 2),
        (2, "person:manishkharat"): ("Manish Kharat", "Named person", 1), (2, "person:ravikumar"): ("Ravi Kumar", "Named person", 1),
    }


def test_blocks_give_identifiers_to_their_person_until_the_next_heading(lines):
    got = {(r["document"], r["a"], r["b"]): r["count"] for r in h.named_together(h.found_in_lines(lines)).collect()}
    assert got[(1, "person:manishkharat", "phone_number:919876543210")] == 1 and got[(1, "bank_account:acxxxx123456", "person:manishkharat")] == 1
    assert got[(1, "address:12milllane", "person:manishkharat")] == 1 and got[(1, "person:asharao", "person:manishkharat")] == 1 and got[(2, "person:manishkharat", "person:ravikumar")] == 1
    assert not any("asset:imei123456789012345" in k for k in got)  # a new block without a person


def test_commit(spark, lines):
    existing = spark.createDataFrame([(8, "person", "MANISH  kharat"), (7, "person", "Manish Kharat"), (9, "vehicle", None)], "id long, kind string, name string")
    entities, links = h.committed(h.found_in_lines(lines), existing)
    got = {r["key"]: r for r in entities.collect()}
    assert (got["person:manishkharat"]["id"], got["person:manishkharat"]["status"], got["person:manishkharat"]["mentions"], got["person:manishkharat"]["documents"]) == (7, "MATCHED", 5, 2)
    assert got["person:ravikumar"]["status"] == "CREATED"  # few candidates: once is enough
    assert all(r["strength"] == min(95, 45 + 12 * r["count"]) for r in links.collect())
    many = spark.createDataFrame([(1, 0, "Manish Kharat and Ravi Kumar"), (1, 1, "Ravi Kumar, a@b.in, c@b.in, d@b.in, e@b.in, f@b.in")], lines.schema)
    entities, links = h.committed(h.found_in_lines(many), existing.limit(0))
    assert "person:manishkharat" not in {r["key"] for r in entities.collect()} and not [r for r in links.collect() if "person:manishkharat" in (r["a"], r["b"])]
    none = h.committed(h.found_in_lines(lines.limit(0)), existing)
    assert none[0].count() == none[1].count() == 0


def test_events_of_equal_time_and_title_are_one(spark):
    rows = [(2, 0, "2024-01-02 10:00 Seen at  the gate"), (1, 5, "02/01/2024, 10:00: seen at the Gate"), (1, 6, "2024-01-02 10:00 - x"), (1, 7, None)]
    got = h.dated_events(spark.createDataFrame(rows, "document long, line_no int, line string")).collect()
    assert [tuple(r) for r in got] == [(1, 5, "2024-01-02T10:00:00+05:30", "seen at the Gate")]


@pytest.mark.parametrize(
    "line, stamp, rest",
    [
        ("2026-09-01T21:15 left home", "2026-09-01T21:15:00+05:30", "left home"), ("1 Sept 2026, 9:15 pm – left", "2026-09-01T21:15:00+05:30", "left"), ("Sept 1, 2026 left", "2026-09-01T09:00:00+05:30", "left"),
        ("• 01-09-2026 | 12:05 AM left", "2026-09-01T00:05:00+05:30", "left"), ("31/02/2026", "2026-02-31T09:00:00+05:30", ""), ("1/13/2026 x", None, None), ("2026-09-01 25:15 x", None, None), ("1 Foo 2026 x", None, None), ("on 2026-09-01", None, None), ("", None, None), (None, None, None),
    ],
)
def test_leading_stamps(spark, line, stamp, rest):
    r = spark.range(1).select(stamps.leading_stamp(F.lit(line).cast("string")).alias("f")).first()["f"]
    assert (r and r["stamp"], r["rest"] if r else None) == (stamp, rest)


def test_counts(spark):
    cases, rows = spark.createDataFrame([(1,), (2,), (2,)], "case_id long"), spark.createDataFrame([(1,), (1,), (3,), (None,)], "case_id long")
    got = {r["case_id"]: (r["a"], r["b"]) for r in counts.child_counts(cases, {"a": rows, "b": rows.limit(0)}).collect()}
    assert got == {1: (2, 0), 2: (0, 0)}
    assert counts.child_counts(cases.limit(0), {"a": rows}).count() == 0
    stages = counts.stage_checklist(spark.createDataFrame([(1, None), (1, "x"), (2, None)], "case_id long, text string"), {"read": F.col("text") == "x"})
    assert {(r["case_id"], r["stage"], r["done"], r["total"]) for r in stages.collect()} == {(1, "read", 1, 2), (2, "read", 0, 1)}
    empty = spark.createDataFrame([], "id long, v string")
    before, after = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], empty.schema), spark.createDataFrame([(2, "z"), (3, "y"), (4, None)], empty.schema)
    got = {r["section"]: tuple(r)[1:] for r in counts.section_changes({"s": before, "t": empty}, {"s": after, "t": empty}, {"s": ["v"], "t": ["v"]}).collect()}
    assert got == {"s": (1, 1, 1), "t": (0, 0, 0)}


def test_lines_are_searched_once_and_by_all_tasks(spark, lines, monkeypatch):
    from casewright.plans import harvest as plan
    from casewright.plans.standin import Tables

    assert plan._lines(Tables(spark, "/root/testdata/sf0.001")).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    plans, real = [], h.stored
    monkeypatch.setattr(h, "stored", lambda df, tag: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, tag))
    h.candidates(h.found_in_lines(lines)).collect()
    assert [p.count("MH|DL|KA") for p in plans] == [1]


def test_organisations_by_ending(spark):
    """The patterns of the endings, tried on every line by Python's re."""
    import re

    texts = ["Satara Police Station and Police Station", "Junior College", "Vidya Junior  College, Rao Café", "xBank Rao Bank. Old Bank", "Hospital", "St. Mary's Nursing Home Trust", "a Mall", "City\tMall", "Big Stores Store", "Storeroom Depot Xdepot", "Pvt Ltd", "Acme Pvt Ltd Club"]
    df = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "document long, line_no int, line string")
    got = {r["document"]: sorted(f["name"] for f in r["found"] if f["kind"] == "organization") for r in h.found_in_lines(df).collect()}
    low = {e.lower() for e in h.ORGANISATION_ENDINGS}
    for k, t in enumerate(texts):
        t = re.sub(r"\s+", " ", t).strip()
        want = [n for e in h.ORGANISATION_ENDINGS for n in re.findall(rf"\b((?:[A-Z][A-Za-z'’.&-]*\s+){{0,3}}{e})\b", t) if " " in n and n.lower() not in low]
        assert got[k] == sorted(want)
    assert sum(map(len, got.values())) >= 10
