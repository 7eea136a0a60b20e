"""All queries of the engine, by category."""

from __future__ import annotations

from casewright.plans import aggregates, boards, changes, copilot, counts, crosscase, detection, extraction, filters, free, graphs, harvest, hypotheses, identity, insights, io, joins, scalars, sequences, streams, whatif  # noqa: F401
from casewright.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
