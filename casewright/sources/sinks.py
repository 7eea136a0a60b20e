"""Writing: appends without repeated ids, exports, versioned tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def appended(existing: DataFrame, incoming: DataFrame, key: str, seq: str) -> DataFrame:
    """Existing rows and those incoming ones whose key is new; of incoming rows that repeat a key the first by ``seq`` wins."""
    first = incoming.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(seq))).filter("_n = 1").drop("_n")
    return existing.unionByName(first.join(existing.select(key), key, "left_anti"))


def next_id(rows: DataFrame, key: str) -> DataFrame:
    """(next_id): the id after the largest number at the end of an id, with as many digits; one row."""
    digits = F.regexp_extract(key, r"(\d+)$", 1)
    most = rows.select(F.regexp_replace(key, r"\d+$", "").alias("prefix"), digits.alias("d")).filter("d != ''")
    top = most.agg(F.max(F.struct(F.col("d").cast("long").alias("n"), F.length("d").alias("w"), "prefix")).alias("m"))
    return top.select(F.concat("m.prefix", F.lpad((F.col("m.n") + 1).cast("string"), F.greatest(F.col("m.w"), F.length((F.col("m.n") + 1).cast("string"))), F.lit("0"))).alias("next_id"))


def quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def cypher(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(line): a MERGE statement for each vertex (id, kind, label) and edge (a, b, kind)."""
    v = vertices.select(F.format_string("MERGE (n:%s {id: %s}) SET n.label = %s;", "kind", quoted(F.col("id").cast("string")), quoted(F.col("label"))).alias("line"))
    e = edges.select(F.format_string("MATCH (a {id: %s}), (b {id: %s}) MERGE (a)-[:%s]->(b);", quoted(F.col("a").cast("string")), quoted(F.col("b").cast("string")), "kind").alias("line"))
    return v.unionByName(e)


def json_lines(rows: DataFrame) -> DataFrame:
    """(line): rows as JSON, nulls left out."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("line"))


def exported_edges(edges: DataFrame) -> DataFrame:
    """(a, b, rel, evidence): first type of each edge (a, b, types, sources), and the first three sources in a row."""
    return edges.select("a", "b", F.get("types", 0).alias("rel"), F.array_join(F.slice("sources", 1, 3), " | ").alias("evidence"))


def marked_stale(findings: DataFrame, version: str) -> DataFrame:
    return findings.withColumn("stale", F.col("graph_version") != version)


def snapshot(rows: DataFrame, previous: DataFrame, case: str) -> DataFrame:
    """Rows with the next ``sequence`` of their case."""
    last = previous.groupBy(case).agg(F.max("sequence").alias("_last"))
    return rows.join(last, case, "left").withColumn("sequence", F.coalesce("_last", F.lit(0)) + 1).drop("_last")
