"""What ties cases to each other, and candidates to entities: shared identities with an example path, shared identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.functions import text as x
from casewright.operators.graph import both_ways
from casewright.operators.sequences import first_of_each

MOST_CONNECTIONS, NAMES = 12, 4


def connections(entities: DataFrame, links: DataFrame, most: int = MOST_CONNECTIONS) -> DataFrame:
    """(case_a, case_b, kind, shared, names, path): for each case the first ``most`` others that it shares an identity with, each pair from both sides.

    Entities (id, case_id, entity_type, name) of one type and name are one node, the smallest id. ``shared`` counts the
    nodes of both cases, ``names`` are the first four by type and name. ``path`` goes from a neighbour of the first case
    over a shared node to another neighbour of the second, through the first shared node that has both; the smallest ids
    are taken, and of each node no more than two neighbours a case are looked at. Without one it is null and the kind is
    ``shared_entity``, else ``shared_path``. Entities without a name or a case share nothing.
    """
    e = entities.filter("name is not null and case_id is not null").select("id", "case_id", "entity_type", x.normalize_name(F.col("name")).alias("key"))
    nodes = e.groupBy("entity_type", "key").agg(F.min("id").alias("node"))
    members = e.join(nodes, ["entity_type", "key"])
    node_of = members.select("id", "node")
    seats = members.select("node", "entity_type", "key", "case_id").distinct()
    ends = both_ways(links.select("a", "b")).select("src", "dst")
    ends = ends.join(node_of.select(F.col("id").alias("src"), F.col("node").alias("x")), "src").join(node_of.select(F.col("id").alias("dst"), F.col("node").alias("y")), "dst")
    near = ends.filter("x != y").select(F.col("x").alias("node"), F.col("y").alias("near")).distinct().join(seats.select(F.col("node").alias("near"), "case_id"), "near")
    two = first_of_each(near, ["node", "case_id"], ["near"], 2, "at").groupBy("node", "case_id").agg(F.sort_array(F.collect_list("near")).alias("near"))
    seats = seats.join(two, ["node", "case_id"], "left")
    other = seats.select("node", F.col("case_id").alias("case_b"), F.col("near").alias("right"))
    both = seats.select("node", "entity_type", "key", F.col("case_id").alias("case_a"), F.col("near").alias("left")).join(other, "node").filter("case_a != case_b")
    l0, l1, r0, r1 = (F.get(side, k) for side in ("left", "right") for k in (0, 1))
    path = F.when(l0 != r0, F.array(l0, "node", r0)).when((l0 == r0) & r1.isNotNull(), F.array(l0, "node", r1)).when((l0 == r0) & l1.isNotNull(), F.array(l1, "node", r0))
    both = both.select("case_a", "case_b", "node", "entity_type", "key", path.alias("path"))
    best = both.groupBy("case_a", "case_b").agg(F.count("*").alias("shared"), F.min(F.struct(F.col("path").isNull().alias("none"), "entity_type", "key", "path"))["path"].alias("path"))
    best = first_of_each(best, ["case_a"], ["case_b"], most, "at").drop("at")
    names = first_of_each(both.select("case_a", "case_b", "entity_type", "key"), ["case_a", "case_b"], ["entity_type", "key"], NAMES, "at").groupBy("case_a", "case_b").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "key"))), lambda n: n["key"]).alias("names"))
    return best.join(names, ["case_a", "case_b"]).select("case_a", "case_b", F.when(F.col("path").isNull(), "shared_entity").otherwise("shared_path").alias("kind"), "shared", "names", "path")


def associations(nodes: DataFrame, relations: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(id, kind, identifier) once each: the normalised names of what a node (id, entity_type, name) is related to, for the entity types in ``kinds``. Nameless ends, and ends that are no node, give nothing."""
    kind = F.create_map(*[F.lit(v) for pair in kinds.items() for v in pair])
    named = nodes.filter(F.col("entity_type").isin(*kinds) & F.col("name").isNotNull()).select(F.col("id").alias("other"), kind[F.col("entity_type")].alias("kind"), x.normalize_name(F.col("name")).alias("identifier"))
    ends = both_ways(relations.select(F.col("src").alias("a"), F.col("dst").alias("b"))).select(F.col("src").alias("id"), F.col("dst").alias("other"))
    return ends.join(named, "other").join(nodes.select("id"), "id", "left_semi").select("id", "kind", "identifier").distinct()


def shared_identifiers(pairs: DataFrame, said: DataFrame, known: DataFrame) -> DataFrame:
    """(candidate, entity, kind, identifier): what both sides of ``pairs`` (candidate, entity) are associated with, by two ``associations``.

    Only the pairs to be compared are joined, by their ids, so an identifier that very many hold makes no pairs of its own.
    """
    mine = pairs.select("candidate", "entity").distinct().join(said.withColumnRenamed("id", "candidate"), "candidate")
    return mine.join(known.withColumnRenamed("id", "entity"), ["entity", "kind", "identifier"]).select("candidate", "entity", "kind", "identifier")
