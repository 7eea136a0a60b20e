"""Extractors that a user adds: table functions by name in SQL, with the schema that they are registered with and a second choice for texts where the first fails."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType

Extractor = Callable[[str], Iterable[tuple]]


def register(spark: SparkSession, name: str, extractor: Extractor, schema: str, fallback: Extractor | None = None) -> None:
    """Registers ``extractor`` as the table function ``name(text)``: a row of ``schema``, and ``extractor`` and ``error``, for each tuple that it gives for a text.

    ``SELECT d.doc_id, m.* FROM documents d, LATERAL name(d.text) m``. A text for which it raises is given to
    ``fallback``, whose rows say so in ``extractor`` and why in ``error``; without one the error ends the query. Rows of
    a text on which the first one failed half way are not mixed with those of the second. Null texts give no rows. A
    second registration under a name replaces the first.
    """
    own = StructType.fromDDL(schema)
    if not own.fields or {"extractor", "error"} & set(own.fieldNames()):
        raise ValueError("a schema has a column at least, and none that is called extractor or error")
    width = len(own.fields)

    class Extract:
        def eval(self, text: str):
            if text is None:
                return
            why = None
            try:
                rows, by = list(extractor(text)), "first"
            except Exception as problem:  # of a user's function, any kind
                if fallback is None:
                    raise
                rows, by, why = list(fallback(text)), "fallback", f"{type(problem).__name__}: {problem}"
            for row in rows:
                row = tuple(row)
                if len(row) != width:
                    raise ValueError(f"{name} gave {len(row)} values for {width} columns")
                yield (*row, by, why)

    spark.udtf.register(name, udtf(Extract, returnType=f"{schema}, extractor string, error string"))
