"""Reading feeds, documents and adapters; validating uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.functions.text import mapped

#: Magic bytes of the accepted uploads, hexadecimal.
MAGIC = {"pdf": "25504446", "png": "89504E47", "jpg": "FFD8FF"}


def csv_feed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a CSV file with a header; a row that does not fit the schema fails the read."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def json_feed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON array."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def optional_feed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As ``json_feed``, without rows if there is no such file."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    return json_feed(spark, path, schema) if there else spark.createDataFrame([], schema)


def without(rows: DataFrame, key: str, excluded: DataFrame) -> DataFrame:
    """Rows whose key is not in ``excluded`` (key)."""
    return rows.join(excluded.select(key), key, "left_anti")


def split_parties(payments: DataFrame, party: str, organisations: DataFrame) -> DataFrame:
    """Payments with ``party_kind``: ORG if the party is in the directory (id), else PERSON."""
    known = organisations.select(F.col("id").alias(party), F.lit("ORG").alias("_k")).distinct()
    return payments.join(known, party, "left").withColumn("party_kind", F.coalesce("_k", F.lit("PERSON"))).drop("_k")


def text_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line), numbered from 1."""
    return texts.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line")).select(key, (F.col("n") + 1).alias("line_no"), "line")


def csv_document(texts: DataFrame, key: str, text: str, cell: int = 500) -> DataFrame:
    """(key, row_no, cells): rows of CSV texts after the header, cells cut at ``cell`` characters; quotes are not read."""
    rows = text_lines(texts, key, text).filter("line_no > 1 and trim(line) != ''")
    return rows.select(key, (F.col("line_no") - 1).alias("row_no"), F.transform(F.split("line", ","), lambda c: F.left(F.trim(c), F.lit(cell))).alias("cells"))


def adapter(rows: DataFrame, fields: dict[str, str], authorisation: str | None) -> DataFrame:
    """Rows of another system under our names; none without an authorisation."""
    out = mapped(rows, fields)
    return out if authorisation else out.limit(0)


def upload_verdict(name: Column, content: Column, most: int) -> Column:
    """Why an upload is refused, null if it is accepted."""
    kind = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    head = F.hex(F.substring(content, 1, 4))
    wrong = F.lit(False)
    for ext, magic in MAGIC.items():
        wrong = wrong | ((kind == ext) & ~head.startswith(magic))
    return F.when(~kind.isin(*MAGIC, "txt", "csv"), "extension").when(F.octet_length(content) > most, "size").when(wrong, "magic bytes").when(kind.isin("txt", "csv") & ~F.is_valid_utf8(content), "encoding")


def first_by_hash(uploads: DataFrame, case: str, content: str, order: str) -> DataFrame:
    """One upload of each content in each case, the first in order; contents are compared by SHA-256."""
    h = uploads.withColumn("sha256", F.sha2(content, 256))
    first = h.groupBy(case, "sha256").agg(F.min(order).alias(order))
    return h.join(first, [case, "sha256", order], "left_semi")


def fuzzy_rows(spark: SparkSession, path: str, wanted: dict[str, str]) -> DataFrame:
    """Rows of a delimited file, the separator found in its first line (tab, semicolon, bar or comma), columns found by a part of their heading; missing ones are null."""
    head = spark.read.text(path).limit(1).collect()
    line = head[0][0] if head else ""
    sep = max("\t;|,", key=line.count)
    rows = spark.read.option("header", True).option("sep", sep).csv(path)
    find = lambda part: next((c for c in rows.columns if part.lower() in c.lower()), None)
    return rows.select(*[(F.col(f"`{c}`") if (c := find(part)) else F.lit(None).cast("string")).alias(ours) for ours, part in wanted.items()])
