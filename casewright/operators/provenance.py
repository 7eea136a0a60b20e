"""What a case looks like without some of its records: an index of what rests on which record, and second runs of what is hit only.

The case is resolved from observations (obs, name, record), identifiers (obs, ident) and reports (report, a, b, record,
weight), where a and b are observations. Every derived row (an entity, a link) has its records in an index. Without some
records, entities that lose an observation are resolved anew among what is left of them, links of those entities and of those
records are counted anew, and shortest paths are sought anew in components that hold such a link. All else stays as it is,
because entities and links of other records and components of other links don't depend on it. Scores over the whole graph
(ranks, modularity) do, and are made anew.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.operators import graph as gr
from casewright.operators import identity
from casewright.storage import stored


def grounds(derived: DataFrame, key: list[str], record: str = "record") -> DataFrame:
    """(key, record, n): the provenance index of derived rows: each record that a key rests on, and how often."""
    return derived.filter(F.col(record).isNotNull()).groupBy(*key, F.col(record).alias("record")).agg(F.count("*").alias("n"))


def sole_grounds(derived: DataFrame, key: list[str], record: str = "record") -> DataFrame:
    """(key, record) of keys that rest on one record only. A derived row without a record rests on none that could go, and keeps its key."""
    by = derived.groupBy(*key).agg(F.min(record).alias("record"), F.max(record).alias("_last"), F.count_if(F.col(record).isNull()).alias("_free"))
    return by.filter((F.col("_free") == 0) & (F.col("record") == F.col("_last"))).drop("_last", "_free")


@dataclass(frozen=True)
class Case:
    """A resolved case. ``entity`` of an observation is the smallest observation of its cluster; links are pairs of entities, a < b."""

    observations: DataFrame  # obs, name, record
    identifiers: DataFrame  # obs, ident
    reports: DataFrame  # report, a, b, record, weight
    members: DataFrame  # obs, entity
    links: DataFrame  # a, b, n, weight, records

    @cached_property
    def entities(self) -> DataFrame:
        return self.members.select(F.col("entity").alias("id")).distinct()

    @cached_property
    def components(self) -> DataFrame:
        """(id, component) of every entity; one without links is its own."""
        found = gr.components(self.links.select("a", "b"))
        return stored(self.entities.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component")), "components")

    @cached_property
    def betweenness(self) -> DataFrame:
        """(id, raw): shortest paths through each entity, not scaled."""
        return stored(_raw_betweenness(self.links, self.entities), "betweenness")


def _raw_betweenness(links: DataFrame, entities: DataFrame) -> DataFrame:
    n = gr._nodes(links, entities).count()
    return gr.betweenness(links, entities).select("id", (F.col("betweenness") * float(max(1, (n - 1) * (n - 2)))).alias("raw"))


def _links(reports: DataFrame, members: DataFrame) -> DataFrame:
    """Links of reports by the entities of their ends; reports of an observation that is nobody, or of one entity with itself, are none."""
    side = lambda x: members.select(F.col("obs").alias(x), F.col("entity").alias(f"e{x}"))
    ends = reports.join(side("a"), "a").join(side("b"), "b").filter("ea != eb")
    return ends.groupBy(F.least("ea", "eb").alias("a"), F.greatest("ea", "eb").alias("b")).agg(
        F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"), F.countDistinct("record").alias("records")
    )


def build(observations: DataFrame, identifiers: DataFrame, reports: DataFrame) -> Case:
    """The case of all records. Rows of nobody (names without a word) and loops are left out; empty tables give an empty case."""
    members = stored(identity.resolve(observations, identifiers).members, "members")
    return Case(observations, identifiers, reports, members, stored(_links(reports, members), "links"))


def link_grounds(case: Case) -> DataFrame:
    """(a, b, record, n): the provenance index of the links."""
    side = lambda x: case.members.select(F.col("obs").alias(x), F.col("entity").alias(f"e{x}"))
    ends = case.reports.join(side("a"), "a").join(side("b"), "b").filter("ea != eb")
    return grounds(ends.select(F.least("ea", "eb").alias("a"), F.greatest("ea", "eb").alias("b"), "record"), ["a", "b"])


def without(case: Case, gone: DataFrame) -> Case:
    """The case without the records ``gone`` (record), equal to ``build`` of what is left, from the parts of ``case`` that don't rest on them.

    ``gone`` is joined, not collected, so any number of records can go.
    """
    gone = stored(gone.select("record").distinct(), "gone")
    kept = lambda df: df.join(gone, "record", "left_anti")
    hit = stored(case.observations.join(gone, "record", "left_semi").join(case.members, "obs").select("entity").distinct(), "hit")
    inside = stored(case.members.join(hit, "entity", "left_semi"), "inside")
    left = stored(kept(case.observations).join(inside.select("obs"), "obs", "left_semi"), "left")
    again = identity.resolve(left, case.identifiers.join(left.select("obs"), "obs", "left_semi")).members
    members = stored(case.members.join(hit, "entity", "left_anti").select("obs", "entity").unionByName(again), "members")
    observations, reports = kept(case.observations), kept(case.reports)
    identifiers = case.identifiers.join(observations.select("obs"), "obs", "left_semi")
    # links to count anew: of an entity that was hit, or with a report that goes
    lost = link_grounds(case).join(gone, "record", "left_semi").select("a", "b")
    of = case.links.select("a", "b")
    stale = of.join(hit.toDF("a"), "a", "left_semi").union(of.join(hit.toDF("b"), "b", "left_semi").select("a", "b")).union(lost).distinct()
    stale = stored(stale, "stale")
    ends = stale.select(F.col("a").alias("entity")).union(stale.select("b")).distinct()
    near = stored(case.members.join(ends, "entity", "left_semi").select("obs"), "near")
    some = reports.join(near.toDF("a"), "a", "left_semi").join(near.toDF("b"), "b", "left_semi")
    counted = _links(some, members)
    fresh = counted.join(case.links.join(stale, ["a", "b"], "left_anti").select("a", "b"), ["a", "b"], "left_anti")
    out = Case(observations, identifiers, reports, members, stored(case.links.join(stale, ["a", "b"], "left_anti").unionByName(fresh), "links"))
    # paths: components that hold a stale link or an entity that was hit are gone through again, the others keep their counts
    touched = case.components.join(ends.toDF("id").union(hit.toDF("id")).distinct(), "id", "left_semi").select("component").distinct()
    old = stored(case.components.join(touched, "component", "left_anti").select("id", "component"), "same")
    new = stored(out.entities.join(old.select("id"), "id", "left_anti"), "changed")
    again_links = stored(out.links.join(new.toDF("a"), "a", "left_semi"), "again")
    found = gr.components(again_links.select("a", "b"))
    components = old.unionByName(new.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component")))
    paths = case.betweenness.join(old.select("id"), "id", "left_semi").unionByName(_raw_betweenness(again_links, new))
    out.__dict__.update(components=stored(components, "components"), betweenness=stored(paths, "betweenness"))
    return out


def aligned_entities(before: Case, after: Case) -> DataFrame:
    """(before, after, shared, part): entities of both runs by the observations they share; part 1 is what the entity before has become, others came apart from it. Null after: gone.

    Withholding records never joins two entities, so each entity after is a part of one before; the part with most
    observations (of equal ones the smallest id) is the one that stays.
    """
    from pyspark.sql import Window

    both = before.members.toDF("obs", "before").join(after.members.toDF("obs", "after"), "obs").groupBy("before", "after").agg(F.count("*").alias("shared"))
    place = F.row_number().over(Window.partitionBy("before").orderBy(F.desc("shared"), "after"))  # of one entity's parts
    return before.entities.select(F.col("id").alias("before")).join(both.withColumn("part", place), "before", "left")


def identity_changes(before: Case, after: Case) -> DataFrame:
    """(entity, observations, left, parts, status) of entities that lose an observation: smaller, split or gone."""
    size = before.members.groupBy("entity").agg(F.count("*").alias("observations"))
    now = aligned_entities(before, after).groupBy(F.col("before").alias("entity")).agg(F.coalesce(F.sum("shared"), F.lit(0)).alias("left"), F.count("after").alias("parts"))
    status = F.when(F.col("parts") == 0, "gone").when(F.col("parts") > 1, "split").otherwise("smaller")
    return size.join(now, "entity").filter("left < observations").select("entity", "observations", "left", "parts", status.alias("status"))


def link_changes(before: Case, after: Case) -> DataFrame:
    """(a, b, n, n_after, records, records_after, status) of links that change: removed, weakened or introduced. Entities that stay are told by their id before, parts that came apart by their own."""
    parts = aligned_entities(before, after).filter("after is not null")
    name = lambda x: parts.select(F.col("after").alias(x), F.when(F.col("part") == 1, F.col("before")).otherwise(F.col("after")).alias(f"k{x}"), (F.col("part") == 1).alias(f"s{x}"))
    now = after.links.join(name("a"), "a").join(name("b"), "b").select(
        F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), F.col("n").alias("n_after"), F.col("records").alias("records_after"), (F.col("sa") & F.col("sb")).alias("stays")
    )
    old = before.links.select("a", "b", "n", "records", F.lit(True).alias("stays"))
    status = F.when(F.col("n_after").isNull(), "removed").when(F.col("n").isNull(), "introduced").otherwise("weakened")
    both = old.join(now, ["a", "b", "stays"], "full_outer")  # a part's id can be that of the entity before
    return both.filter(~F.col("n").eqNullSafe(F.col("n_after")) | ~F.col("records").eqNullSafe(F.col("records_after"))).select("a", "b", "n", "n_after", "records", "records_after", status.alias("status"))


def scores(case: Case, prior: DataFrame | None = None) -> DataFrame:
    """(id, degree, betweenness, component, community, influence, place) of every entity."""
    n = case.entities.count()
    links = case.links.select("a", "b", F.col("n").cast("double").alias("weight"))
    community = stored(gr.communities(links, case.entities), "communities")
    between = case.betweenness.select("id", (F.col("raw") / float(max(1, (n - 1) * (n - 2)))).alias("betweenness"))
    prior = case.entities.select("id", F.lit(0.0).alias("prior")) if prior is None else prior
    ranked = gr.influence(links, prior, community, case.entities, between).select("id", F.round("score", 6).alias("influence"), F.col("place").cast("long").alias("place"))
    degree = gr.both_ways(links).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    joined = case.entities.join(degree, "id", "left").join(between, "id").join(case.components, "id").join(community, "id").join(ranked, "id")
    return joined.select("id", F.coalesce("degree", F.lit(0)).alias("degree"), F.round("betweenness", 9).alias("betweenness"), "component", "community", "influence", "place")


def score_changes(before: Case, after: Case) -> DataFrame:
    """The scores of every entity before, and of what it has become (null: gone): degree, betweenness, component, community, influence and place, each also with _after, and isolated."""
    stays = aligned_entities(before, after).filter("part = 1 or part is null").select(F.col("before").alias("id"), "after")
    new = scores(after)
    new = new.select(F.col("id").alias("after"), *[F.col(c).alias(f"{c}_after") for c in new.columns[1:]])
    return scores(before).join(stays, "id").join(new, "after", "left").withColumn("isolated", (F.col("degree") > 0) & (F.col("degree_after") == 0)).drop("after")
