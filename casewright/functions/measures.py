"""Distances, times, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casewright import config


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = config.RADIUS_CORPUS) -> Column:
    """Great-circle distance; null if a coordinate is."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    # least() would skip a null
    return 2 * radius * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))


def minutes_between(a_us: Column, b_us: Column) -> Column:
    """Minutes between two times in microseconds, without sign."""
    return F.abs(a_us - b_us) / F.lit(60_000_000.0)


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def record_weight(reliability: Column, confidence: Column, occurrence: Column) -> Column:
    """Weight of the k-th record of a source: reliability * confidence within 0 and 1 / sqrt(k)."""
    return F.coalesce(reliability, F.lit(config.RELIABILITY)) * F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)) / F.sqrt(occurrence)


def contra_ratio(support: Column, contra: Column) -> Column:
    return F.when(support + contra > 0, contra / (support + contra)).otherwise(0.0)


def adjusted(base: Column, ratio: Column) -> Column:
    return base * (1 - config.IMPACT_CAP * ratio)


def severity(ratio: Column) -> Column:
    return F.when(ratio >= config.SEVERE, "high").when(ratio >= config.MODERATE, "medium").otherwise("low")


def hypothesis_score(evidence: Column, relations: Column, consistency: Column, provenance: Column, entities: Column) -> Column:
    """Weighted shares of 4 pieces of evidence, 3 relations, consistency, provenance and 5 entities."""
    w = config.HYPOTHESIS_WEIGHTS
    share = lambda x, n: F.least(F.lit(1.0), x / n)
    return w[0] * share(evidence, 4) + w[1] * share(relations, 3) + w[2] * consistency + w[3] * provenance + w[4] * share(entities, 5)


def band(score: Column) -> Column:
    return F.when(score >= 0.67, "high").when(score >= 0.34, "medium").otherwise("low")
