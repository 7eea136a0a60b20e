"""What changes if evidence goes: the graph before and after, pairs that lose their connection, findings of a second run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.operators import graph as gr
from casewright.operators.aggregates import degrees
from casewright.operators.joins import full_diff
from casewright.storage import stored


def removal_metrics(links: DataFrame, gone: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, degree, betweenness, component, each also with _after, isolated) of every vertex, with all links (a, b) and without ``gone`` (a, b).

    Components that lose no link keep their scores, so only those that do are gone through again. A vertex without
    links is a component of its own.
    """
    before = stored(links.select("a", "b"), "before")
    gone = stored(gone.select("a", "b"), "gone")
    part = stored(vertices.select("id").join(gr.components(before), "id", "left").select("id", F.coalesce("component", "id").alias("component")), "part")
    hit = gone.join(part.toDF("a", "component"), "a").select("component").distinct()
    inside = stored(part.join(hit, "component", "left_semi").select("id"), "inside")
    after = stored(before.join(gone, ["a", "b"], "left_anti"), "after")
    again = stored(after.join(inside.toDF("a"), "a", "left_semi"), "again")
    changed = inside.join(gr.betweenness(again, vertices).toDF("id", "new_betweenness"), "id").join(gr.components(again).toDF("id", "new_component"), "id", "left")
    changed = changed.select("id", "new_betweenness", F.coalesce("new_component", "id").alias("new_component"))
    out = part.join(gr.betweenness(before, vertices), "id").join(degrees(before), "id", "left").join(degrees(after).toDF("id", "new_degree"), "id", "left").join(changed, "id", "left")
    none = F.lit(0).cast("long")
    degree, left = F.coalesce("degree", none), F.coalesce("new_degree", none)
    return out.select(
        "id", degree.alias("degree"), left.alias("degree_after"), "betweenness", F.coalesce("new_betweenness", "betweenness").alias("betweenness_after"),
        "component", F.coalesce("new_component", "component").alias("component_after"), ((degree > 0) & (left == 0)).alias("isolated"),
    )


def _split(parts: DataFrame) -> DataFrame:
    """Vertices (id, component, component_after) of components that fall apart."""
    several = parts.groupBy("component").agg(F.min("component_after").alias("x"), F.max("component_after").alias("y")).filter("x < y")
    return parts.select("id", "component", "component_after").join(several.select("component"), "component", "left_semi")


def disconnected_pairs(parts: DataFrame, most: int = 25) -> DataFrame:
    """The first ``most`` pairs (a, b), a < b, by a and b, of one component before and of two after; ``parts`` is (id, component, component_after).

    An id starts a pair if some larger id of its component lies in another part; the first ``most`` such ids have all
    pairs that are asked for, so only they meet their components.
    """
    p = stored(_split(parts), "split")
    last = p.groupBy("component", "component_after").agg(F.max("id").alias("last"))
    top = last.groupBy("component").agg(F.max(F.struct("last", "component_after")).alias("top"))
    second = last.join(top, "component").filter("component_after != top.component_after").groupBy("component").agg(F.max("last").alias("second"))
    ends = top.join(second, "component")
    beyond = F.when(F.col("component_after") == F.col("top.component_after"), F.col("second")).otherwise(F.col("top.last"))
    starts = p.join(ends, "component").filter(beyond > F.col("id")).orderBy("id").limit(most).select(F.col("id").alias("a"), "component", F.col("component_after").alias("own"))
    pairs = p.join(F.broadcast(starts), "component").filter((F.col("id") > F.col("a")) & (F.col("component_after") != F.col("own")))  # ``most`` rows
    return pairs.select("a", F.col("id").alias("b")).orderBy("a", "b").limit(most)


def removal_summary(metrics: DataFrame) -> DataFrame:
    """One row of ``removal_metrics``: components before and after, isolated nodes, changed nodes, pairs that lose their connection. Pairs are counted from the sizes of the parts."""
    half = lambda n: F.col(n) * (F.col(n) - 1) / 2
    pairs = lambda c: metrics.groupBy(c).agg(F.count("*").alias("n")).agg(F.count("*").alias(f"n_{c}"), F.sum(half("n")).cast("long").alias(f"pairs_{c}"))
    moved = (F.col("degree") != F.col("degree_after")) | (F.abs(F.col("betweenness") - F.col("betweenness_after")) > 1e-12)
    nodes = metrics.agg(F.count_if("isolated").alias("isolated"), F.count_if(moved).alias("changed"))
    one = nodes.join(pairs("component")).join(pairs("component_after"))  # one row each
    return one.select(F.col("n_component").alias("components"), F.col("n_component_after").alias("components_after"), "isolated", "changed", (F.col("pairs_component") - F.col("pairs_component_after")).alias("disconnected"))


def counterfactual(tables: dict[str, DataFrame], excluded: dict[str, Column], analyse: Callable[[dict[str, DataFrame]], DataFrame], key: list[str], fields: list[str]) -> DataFrame:
    """(key, status): what ``analyse`` finds in the tables, and in them without the rows for which ``excluded`` of the table is true: added, removed, changed or same."""
    kept = {name: rows.filter(~F.coalesce(excluded[name], F.lit(False))) if name in excluded else rows for name, rows in tables.items()}
    found = [analyse(t).select(F.struct(*key).alias("finding"), *fields) for t in (tables, kept)]
    return full_diff(*found, "finding", fields).select("finding.*", "status")
