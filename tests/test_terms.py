"""Terms of a table in texts, against a search for each term alone."""

import random
import re

from pyspark.sql import functions as F

from casewright.operators import terms


def plainly(texts, rows):
    return sorted((k, t, kind, m.start(), m.end()) for k, text in texts if text for t, kind in rows if t for m in re.finditer(re.escape(t), text))


def test_all_occurrences_in_several_scripts(spark):
    rng = random.Random(2)
    pieces = ["aa", "aaa", "Asha Patil", "Patil", "पाटिल", "आशा पाटिल", "بازار", "दादर", "Dadar", "x", " ", "\n", "🙂"]
    texts = [(k, "".join(rng.choice(pieces) for _ in range(rng.randrange(30)))) for k in range(200)] + [(900, None), (901, ""), (902, "aa" * 20_000)]
    rows = [("aa", "p"), ("aaa", "q"), ("Asha Patil", "person"), ("Patil", "person"), ("Patil", "surname"), ("पाटिल", "person"), ("आशा पाटिल", "person"), ("بازار", "place"), ("", "none"), (None, "none"), ("🙂", "sign")]
    df = spark.createDataFrame(texts, "id long, text string")
    found = terms.term_mentions(df, "id", "text", spark.createDataFrame(rows, "term string, kind string"))
    assert sorted(tuple(r) for r in found.select("id", "term", "kind", "start", "stop").collect()) == plainly(texts, rows)
    assert terms.term_mentions(df, "id", "text", spark.createDataFrame([], "term string, kind string")).count() == 0


def test_very_many_terms_in_one_scan(spark):
    names = spark.range(100_000).select(F.concat(F.lit("name"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("term"), (F.col("id") % 7).alias("kind"))
    texts = spark.range(300).select("id", F.concat_ws(" ", F.concat(F.lit("name"), F.lpad((F.col("id") * 331).cast("string"), 6, "0")), F.lit("and"), F.concat(F.lit("name"), F.lpad((F.col("id") + 7).cast("string"), 6, "0"))).alias("text"))
    got = {(r.id, r.term, r.kind, r.start, r.stop) for r in terms.term_mentions(texts, "id", "text", names).collect()}
    assert got == {(k, f"name{n:06d}", n % 7, at, at + 10) for k in range(300) for n, at in ((k * 331, 0), (k + 7, 15))}


def test_parts_of_a_large_table_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(terms, "PART_TERMS", 3)
    rows = [(w, "k") for w in ("one", "two", "three", "four", "five", "six", "seven")]
    texts = [(1, "seven one two"), (2, "four five"), (3, "eight")]
    found = terms.term_mentions(spark.createDataFrame(texts, "id long, text string"), "id", "text", spark.createDataFrame(rows, "term string, kind string"))
    assert sorted(tuple(r) for r in found.select("id", "term", "kind", "start", "stop").collect()) == plainly(texts, rows)


def test_claims_need_a_connective_a_stamp_and_nearness(spark):
    far = "राजेश कुमार " + "और " * 12 + "दादर"
    lines = [
        (1, "hi", "राजेश कुमार को दादर में देखा 2024-01-02 10:30"), (2, "hi", f"{far} में देखा 2024-01-02 10:30"), (3, "hi", "राजेश कुमार को दादर में देखा"),
        (4, "hi", "दादर राजेश कुमार में 2024-01-02 10:30"), (5, "ur", "راجیش دادر میں 2024-01-02 10:30"), (6, "ur", "राजेश कुमार को दादर में देखा 2024-01-02 10:30"),
    ]
    surfaces = [("राजेश कुमार", "hi", "person", "Rajesh Kumar"), ("दादर", "hi", "location", "Dadar"), ("راجیش", "ur", "person", "Rajesh"), ("دادر", "ur", "location", "Dadar")]
    got = terms.multilingual_claims(
        spark.createDataFrame(lines, "id long, lang string, text string"), "id", "text", spark.createDataFrame(surfaces, "term string, lang string, kind string, name string"),
        spark.createDataFrame([("में", "hi"), ("میں", "ur")], "word string, lang string"), r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}",
    )
    assert sorted(tuple(r) for r in got.collect()) == [(1, "hi", "Rajesh Kumar", "Dadar", "2024-01-02 10:30"), (5, "ur", "Rajesh", "Dadar", "2024-01-02 10:30")]


def test_unknown_names(spark):
    lines = spark.createDataFrame([(1, "per ahmad ali lahore"), (2, "ahmad"), (3, "noor jahan per raza khan")], "id long, text string")
    got = terms.unknown_names(lines, "id", "text", r"[a-z]{3,}", ["per"], ["khan"])
    assert sorted(tuple(r) for r in got.collect()) == [(1, "ahmad ali"), (3, "noor jahan")]
