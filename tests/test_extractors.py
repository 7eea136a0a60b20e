"""Extractors by name in SQL, with a second choice where the first fails."""

import re

import pytest

from casewright.sources import extractors


def test_two_extractors_one_failing(spark):
    def phones(text):
        yield from ((m.group(), m.start()) for m in re.finditer(r"9\d{9}", text))
        if "broken" in text:
            raise RuntimeError("model is gone")

    def words(text):
        return [(w, text.index(w)) for w in text.split() if w.isdigit()]

    spark.createDataFrame([(1, "call 9000000001 or 12"), (2, "broken 9000000002 and 34"), (3, None), (4, "nothing")], "id long, text string").createOrReplaceTempView("notes_of_two")
    extractors.register(spark, "numbers_in", phones, "value string, at int", fallback=words)
    extractors.register(spark, "words_in", words, "value string, at int")
    got = spark.sql("select n.id, m.* from notes_of_two n, lateral numbers_in(n.text) m order by id, at").collect()
    assert [tuple(r) for r in got] == [(1, "9000000001", 5, "first", None), (2, "9000000002", 7, "fallback", "RuntimeError: model is gone"), (2, "34", 22, "fallback", "RuntimeError: model is gone")]
    got = spark.sql("select n.id, m.value from notes_of_two n, lateral words_in(n.text) m order by 1, 2").collect()
    assert [tuple(r) for r in got] == [(1, "12"), (1, "9000000001"), (2, "34"), (2, "9000000002")]


def test_without_a_second_choice_an_error_ends_the_query(spark):
    def fails(text):
        raise RuntimeError("model is gone")

    extractors.register(spark, "fails_on", fails, "value string")
    with pytest.raises(Exception, match="model is gone"):
        spark.sql("select * from values ('a') n(text), lateral fails_on(n.text)").collect()
    with pytest.raises(ValueError):
        extractors.register(spark, "clash", fails, "error string")
