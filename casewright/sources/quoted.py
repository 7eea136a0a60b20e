"""CSV and text documents as they are uploaded: quotes across commas and line ends, a byte-order mark, strict UTF-8, a header, a cap on rows that is reported."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of a document that are read, and characters of a cell.
MOST_ROWS, MOST_CELL = 2000, 500
_ROW = "row_no int, cells map<string,string>, problem string, left_out long"


def _rows(content: bytes, most: int, cell: int) -> Iterator[tuple[int, list[tuple[str, str]] | None, str | None, int]]:
    """(number, cells, problem, rows left out): a row for each record, and one with number 0 that says how the document went."""
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError:
        yield 0, None, "not valid UTF-8", 0
        return
    reader = csv.reader(io.StringIO(text, newline=""))
    try:
        header = next(reader, [])
        if not any(c.strip() for c in header):
            yield 0, None, "no header row", 0
            return
        n = 0
        for record in reader:
            if not record:
                continue
            n += 1
            if n <= most:
                named = dict(zip(header, [v[:cell] for v in record] + [""] * (len(header) - len(record)), strict=False))
                yield n, list(named.items()), None, 0
        yield 0, None, None, max(0, n - most)
    except csv.Error as problem:
        yield 0, None, f"malformed: {problem}", 0


def csv_documents(files: DataFrame, key: str, content: str, most: int = MOST_ROWS, cell: int = MOST_CELL) -> DataFrame:
    """(key, row_no, cells, problem, left_out): records of CSV documents (binary ``content``) after the header, numbered from 1.

    Quoted fields hold commas, quotes and line ends; empty lines are no records; missing cells are empty, those beyond the
    header are left out, long ones cut at ``cell`` characters. Of each document there is a row number 0 that says what is
    wrong with it (null: nothing), or how many rows beyond ``most`` were left out. Null content is an empty document. A
    document is parsed in one piece, as only its quotes say where a record ends.
    """
    kind = dict(files.dtypes)[key]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column(1).to_pylist()):
                made = list(_rows(data or b"", most, cell))
                for lo in range(0, len(made), 1000):
                    some = made[lo : lo + 1000]
                    keys = batch.column(0).take(pa.array([i] * len(some), pa.int64()))
                    columns = [pa.array([r[k] for r in some], t) for k, t in enumerate((pa.int32(), pa.map_(pa.string(), pa.string()), pa.string(), pa.int64()))]
                    yield pa.RecordBatch.from_arrays([keys, *columns], ["_key", "row_no", "cells", "problem", "left_out"])

    return files.select(F.col(key).alias("_key"), F.col(content).cast("binary").alias("_content")).mapInArrow(parse, f"_key {kind}, {_ROW}").withColumnRenamed("_key", key)


def text_documents(files: DataFrame, key: str, content: str) -> DataFrame:
    """(key, line_no, line, problem): lines of text documents (binary), numbered from 1; one row that says so for a document that is no UTF-8."""
    sound = F.is_valid_utf8(F.col(content))
    lines = F.split(F.decode(content, "utf-8"), r"\r\n|\n|\r")
    good = files.filter(sound).select(key, F.posexplode(lines).alias("n", "line")).select(key, (F.col("n") + 1).alias("line_no"), "line", F.lit(None).cast("string").alias("problem"))
    bad = files.filter(~sound).select(key, F.lit(None).cast("int").alias("line_no"), F.lit(None).cast("string").alias("line"), F.lit("not valid UTF-8").alias("problem"))
    return good.unionByName(bad)
