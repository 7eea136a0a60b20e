"""Connections of cases against plain loops; shared identifiers with nulls and empty tables."""

import itertools
import random

from casewright.operators import crosscase as c


def _brute(entities, links, most):
    key = {i: (k, " ".join(n.lower().split())) for i, case, k, n in entities if n is not None and case is not None}
    node = {i: min(j for j in key if key[j] == key[i]) for i in key}
    cases = {}
    for i, case, _, _ in entities:
        if i in node:
            cases.setdefault(node[i], set()).add(case)
    near = {n: set() for n in cases}
    for a, b in links:
        if a in node and b in node and node[a] != node[b]:
            near[node[a]].add(node[b])
            near[node[b]].add(node[a])
    out = {}
    for a in sorted(set().union(*cases.values())):
        others = sorted(b for b in set().union(*cases.values()) if b != a and any({a, b} <= s for s in cases.values()))
        for b in others[:most]:
            both = sorted((n for n in cases if {a, b} <= cases[n]), key=lambda n: key[n])
            path = next(([x, n, y] for n in both for x, y in itertools.product(sorted(m for m in near[n] if a in cases[m]), sorted(m for m in near[n] if b in cases[m])) if x != y), None)
            out[a, b] = ("shared_path" if path else "shared_entity", len(both), [key[n][1] for n in both[:4]], path)
    return out


def test_connections_match_plain_loops(spark):
    rng = random.Random(5)
    kinds = set()
    for n_links, most in ((4, 12), (20, 12), (40, 2)):
        entities = [(i, rng.choice([0, 1, 2, 3, None]), rng.choice("PO"), rng.choice(["Asha Rao", "asha  rao", "Ravi", "Mill", "Gate", None])) for i in range(30)]
        links = [(rng.randrange(32), rng.randrange(32)) for _ in range(n_links)]
        e = spark.createDataFrame(entities, "id long, case_id long, entity_type string, name string")
        got = {(r["case_a"], r["case_b"]): (r["kind"], r["shared"], r["names"], r["path"]) for r in c.connections(e, spark.createDataFrame(links, "a long, b long"), most).collect()}
        assert got == _brute(entities, links, most)
        kinds |= {v[0] for v in got.values()}
    assert kinds == {"shared_path", "shared_entity"}
    assert c.connections(e.limit(0), spark.createDataFrame([], "a long, b long")).count() == 0


def test_shared_identifiers(spark):
    nodes = spark.createDataFrame([(1, "PERSON", "A"), (2, "PERSON", "B"), (3, "PHONE", " 98 1 "), (4, "PHONE", "98  1"), (5, "PHONE", None), (6, "CAR", "MH"), (7, "SHOP", "X")], "id long, entity_type string, name string")
    rel = lambda *r: spark.createDataFrame(list(r), "src long, dst long")
    kinds = {"PHONE": "phone", "CAR": "vehicle"}
    said = c.associations(nodes, rel((1, 3), (1, 3), (6, 1), (1, 5), (1, 7), (99, 3), (None, 3)), kinds)
    assert {tuple(r) for r in said.collect()} == {(1, "phone", "98 1"), (1, "vehicle", "mh")}
    known = c.associations(nodes, rel((4, 2)), kinds)
    pairs = spark.createDataFrame([(1, 2), (1, 2), (2, 1), (1, None)], "candidate long, entity long")
    assert [tuple(r) for r in c.shared_identifiers(pairs, said, known).collect()] == [(1, 2, "phone", "98 1")]
    assert c.shared_identifiers(pairs.limit(0), said, known).count() == 0
