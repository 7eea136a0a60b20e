"""Counts of a case: its child tables, stages of its documents, what changed between two snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.operators.joins import full_diff


def child_counts(cases: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """(case_id, a column for each child table): rows of each table by case, 0 where it has none.

    All tables are counted in one shuffle of partial counts, however many they are. Rows of other cases, or none, are left out.
    """
    ones = [df.select("case_id", F.lit(name).alias("table")) for name, df in children.items()]
    n = reduce(DataFrame.unionByName, ones).groupBy("case_id").agg(*[F.count_if(F.col("table") == name).alias(name) for name in children])
    return cases.select("case_id").distinct().join(n, "case_id", "left").na.fill(0, list(children))


def stage_checklist(documents: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """(case_id, stage, done, total): of the documents of each case, how many have passed each stage; a stage's test that is null is not passed."""
    n = documents.groupBy("case_id").agg(F.count("*").alias("total"), *[F.count_if(F.coalesce(test, F.lit(False))).alias(name) for name, test in stages.items()])
    return n.unpivot(["case_id", "total"], list(stages), "stage", "done").select("case_id", "stage", "done", "total")


def section_changes(before: dict[str, DataFrame], after: dict[str, DataFrame], fields: dict[str, list[str]]) -> DataFrame:
    """(section, added, removed, changed): rows of two snapshots by ``id``; a section without rows in both has zeros. A row is changed if one of the section's ``fields`` is another, nulls included."""
    out = []
    for name, names in fields.items():
        status = full_diff(before[name].select("id", *names), after[name].select("id", *names), "id", names)
        out.append(status.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("added", "removed", "changed")]).select(F.lit(name).alias("section"), "added", "removed", "changed"))
    return reduce(DataFrame.unionByName, out)
