"""A corpus from raw documents to packed bins: five stages, each written and read again before the next.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns what it keeps. All but the last
return the columns of ``documents``. Needs the subpackage ``llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm import language_id
from casewright.llm.common import read, row_key, scratch, stored
from casewright.llm.line_dedup import remove_chunks, repeated_runs
from casewright.llm.mixing import mix
from casewright.llm.near_dedup import BANDING_80, near_dedup
from casewright.llm.packing import pack

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; null texts and texts without a letter, however long, go. ``lang`` becomes the found one.

    Each row is judged by itself: null or repeated ids and repeated rows make no difference, and without any labelled
    document nothing is found, so an empty table stays empty.
    """
    found = language_id.identify(docs.select(*COLUMNS), language_id.fit(docs))
    return found.filter("lang_pred != 'und'").select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without runs of two or more lines that stand earlier in the corpus (by id, null last); documents of which nothing but white space stays go.

    Rows are told apart by id and text, so documents that share an id, or have none, are cut by themselves, and rows
    that repeat both are cut alike and stay. Null and empty texts stay as they are.
    """
    docs = docs.select(*COLUMNS)
    return remove_chunks(docs, repeated_runs(docs)).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8): the smallest id, null last, then the smallest hash of id and text.

    Documents that share an id, or have none, are documents of their own; of rows that repeat id and text one stays.
    Texts without words are no copies of each other and stay.
    """
    docs = docs.select(*COLUMNS).withColumn("node", row_key(F.col("doc_id").cast("long"), F.col("text")))
    found = stored(near_dedup(docs, "node", percent=80, banding=BANDING_80).select("node", "component_id", "kept", "first_row"), "found")
    groups = found.filter("not kept").select("component_id").distinct()
    members = found.filter("first_row").join(groups, "component_id", "left_semi").join(docs.select("node", "doc_id"), "node")
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("node").alias("node"))
    stays = stored(members.groupBy("component_id").agg(F.min(order)["node"].alias("stays")), "stays")
    gone = found.filter("first_row").join(stays, "component_id").filter("node != stays").select("node")
    left = docs.join(gone, "node", "left_anti")
    twice = found.filter("not first_row").select("node").distinct()
    if twice.limit(1).count():  # texts are moved for this only if there are such rows
        left = left.join(twice, "node", "left_anti").unionByName(left.join(twice, "node", "left_semi").dropDuplicates(["node"]))
    return left.select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Documents are dealt by a hash of id and text, so those that share an id, or have none, are taken one by one, and rows
    that repeat both alike. Null sources are a source. Texts without words have no size: they come with their hash.
    """
    docs = docs.select(*COLUMNS).withColumn("node", row_key(F.col("doc_id").cast("long"), F.col("text")))
    taken = mix(docs, "node").filter("copies > 0").groupBy(F.col("node").alias("taken"), F.col("source").alias("of")).agg(F.max("copies").alias("copies"))
    each = docs.join(taken, (F.col("node") == F.col("taken")) & F.col("source").eqNullSafe(F.col("of")))
    return each.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their bins; see ``pack`` for nulls, long texts and repeated rows. Near copies are gone, so copies that the mix repeats are the duplicate clusters."""
    return pack(docs.select(*COLUMNS))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_bins),
]

#: A classifier and hashes decide; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
