"""The widest gap of a case is found within and between days; a case without rows has no insights."""

import random

from casewright.operators.insights import insights, widest_gaps

_HOUR = 3_600_000_000


def test_widest_gaps_match_plain_loops(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(4), rng.choice([None, rng.randrange(400) * _HOUR // 2]), k) for k in range(120)] + [(9, 5, 500), (None, 7, 501), (8, 3, 502), (8, 3, 503)]
    got = {r["case_id"]: tuple(r)[1:] for r in widest_gaps(spark.createDataFrame(rows, "case_id long, us long, id long")).collect()}
    for case in {c for c, _, _ in rows if c is not None}:
        es = sorted((us, i) for c, us, i in rows if c == case and us is not None)
        best = min(((a[0] - b[0], a[0], a[1], b[1]) for a, b in zip(es, es[1:], strict=False)), default=None)
        assert got[case] == (len(es), es[0][0], es[-1][0], *((-best[0], best[2], best[3]) if best else (None, None, None)))
    assert None not in got


def test_insights_of_small_and_empty_cases(spark):
    entities = spark.createDataFrame([(1, 0, "PERSON"), (2, 0, "PHONE"), (3, 0, "PHONE"), (4, 1, "PERSON")], "id long, case_id long, entity_type string")
    relations = spark.createDataFrame([(2, 1), (None, 1)], "src long, dst long")
    events = spark.createDataFrame([(1, 0, 1, 0, 5), (2, 0, 2, 4 * _HOUR, 5), (3, 0, None, 5 * _HOUR, 77), (4, 0, 3, None, None)], "id long, case_id long, entity long, us long, location long")
    locations = spark.createDataFrame([(5, 0), (6, 0)], "id long, case_id long")
    got = {(r["case_id"], r["category"]): tuple(r)[2:] for r in insights(entities, relations, events, locations, ["PHONE"]).collect()}
    assert got == {
        (0, "link"): (1, 2, None, 66, [1]), (0, "temporal"): (1, 3, 1.0, 88, [1, 2]), (0, "geo"): (5, 2, None, 84, [2]), (0, "pattern"): (5, 2, None, 71, []), (0, "anomaly"): (None, 1, None, 70, [3]),
    }
    assert insights(*(df.limit(0) for df in (entities, relations, events, locations)), ["PHONE"]).count() == 0
