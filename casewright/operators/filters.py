"""Slices of graphs and case tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def graph_slice(vertices: DataFrame, edges: DataFrame, kinds: list[str] | None = None, min_confidence: float = 0.0, edge_types: list[str] | None = None, redact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, kind, ...) of the given kinds, and edges (src, dst, confidence, types) with both ends kept. ``redact`` hides phones and accounts."""
    v = vertices.filter(F.col("kind").isin(*kinds)) if kinds else vertices
    e = edges.filter(F.col("confidence") >= min_confidence)
    if edge_types:
        e = e.filter(F.arrays_overlap("types", F.array(*[F.lit(x) for x in edge_types])))
    if redact:
        v = v.withColumns({c: F.lit(None).cast(v.schema[c].dataType) for c in ("phones", "accounts") if c in v.columns})
    return v, within(e, v)


def within(edges: DataFrame, vertices: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges whose both ends are vertices."""
    ids = vertices.select("id")
    return edges.join(ids, edges[src] == ids.id, "left_semi").join(ids, edges[dst] == ids.id, "left_semi")


def graph_payload(entities: DataFrame, relations: DataFrame, relation_type: str | None = None, min_confidence: float | None = None, entity_type: str | None = None, limit: int | None = None) -> DataFrame:
    """Relations after, in this order: type, confidence (null drops), entity type, the first ``limit`` entities by id, and both ends kept. The limit is the caller's page size."""
    r = relations if relation_type is None else relations.filter(F.col("kind") == relation_type)
    r = r if min_confidence is None else r.filter(F.col("confidence") >= min_confidence)
    e = entities if entity_type is None else entities.filter(F.col("entity_type") == entity_type)
    e = e if limit is None else e.orderBy("id").limit(limit)
    return within(r, e)


def timeline(events: DataFrame, ts: str, lo: str | None = None, hi: str | None = None, **equal) -> DataFrame:
    """Events with the given values, between the bounds; events without a time drop only if there is a bound."""
    for name, value in equal.items():
        if value is not None:
            events = events.filter(F.col(name) == value)
    if lo is not None:
        events = events.filter(F.col(ts) >= F.lit(lo).cast(events.schema[ts].dataType))
    if hi is not None:
        events = events.filter(F.col(ts) <= F.lit(hi).cast(events.schema[ts].dataType))
    return events


def page(df: DataFrame, order: list[Column | str], limit: int, offset: int = 0) -> tuple[DataFrame, int]:
    """A page in a total order, and the number of all rows."""
    return df.orderBy(*order).offset(offset).limit(limit), df.count()


def visible_at(edges: DataFrame, date: str) -> tuple[DataFrame, DataFrame]:
    """Edges first seen by ``date`` (without a date: not visible), and the nodes that still have one."""
    e = edges.filter(F.col("first_seen") <= F.lit(date).cast("timestamp_ntz"))
    return e, e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def accessible(cases: DataFrame, user: int, role: str) -> DataFrame:
    """Cases a user may see: all for an admin, else own ones and those without an owner."""
    return cases if role == "ADMIN" else cases.filter(F.col("owner").isNull() | (F.col("owner") == user))


def searched(df: DataFrame, query: str, *columns: str) -> DataFrame:
    """Rows that hold ``query`` in one of the columns, written in a row; case does not count."""
    return df.filter(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(query.strip().lower())))


def party(payments: DataFrame, names: DataFrame) -> DataFrame:
    """Payments with a payer or payee in ``names`` (id)."""
    n = names.select("id").distinct()
    hit = payments.join(n, payments.src == n.id, "left_semi").select("txn_id").union(payments.join(n, payments.dst == n.id, "left_semi").select("txn_id")).distinct()
    return payments.join(hit, "txn_id", "left_semi")
