"""The registry of queries and of the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from casewright.plans import standin

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of the tables as query ``name``; ``sql`` may use the stand-in views as tables."""

    def put(f: Callable[[standin.Tables], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: f(standin.Tables(spark, sf_dir))
        if sql:
            ORACLE[name] = with_views(sql)
        return f

    return put


def with_views(sql: str) -> str:
    """``sql`` with the views that it uses as common table expressions."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name, body in standin.VIEWS.items():
            if name not in need and re.search(rf"\b{name}\b", text):
                visit(body)
                need.append(name)

    visit(sql)
    own = re.sub(r"^\s*with\s+(recursive\s+)?", "", sql) if re.match(r"\s*with\s", sql) else None
    ctes = ",\n".join(f"{n} as ({standin.VIEWS[n]})" for n in need)
    if own is not None:
        return f"with recursive {ctes + ',' if ctes else ''}\n{own}"
    return f"with recursive {ctes}\n{sql}" if ctes else sql
