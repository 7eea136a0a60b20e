"""Entity resolution: observations that share an identifier or have names alike are one entity, and each merge has a reason.

The clusters are the components of identifier links and name links. The reasons are those of merging in order: first every
identifier, then, block by block and place by place, each pair of names whose clusters are still apart. That is the
minimum spanning forest of the name links, ordered by block and places, over the clusters of identifiers, so it is found in
rounds (each cluster takes its first link out) and does not depend on how rows are dealt to tasks.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions.similarity import long_sounds, runs_to_latin, to_latin, words_likeness
from casewright.functions.text import has_devanagari
from casewright.operators import graph as gr
from casewright.storage import stored

# Spellings that are one, and words that are no part of a name.
VARIANTS = {
    "shaikh": "sheikh", "fareed": "farid", "bhosle": "bhosale", "quraishi": "qureshi", "seth": "sethi", "kr": "kumar", "chouhan": "chauhan", "jhadav": "jadhav", "yadhav": "yadav",
}
NOISE = ("mr", "mrs", "shri", "smt", "alias", "urf", "one", "accused", "subject")
#: Least likeness at which two names are one.
NAME_MATCH = 0.75


class Resolved(NamedTuple):
    """``members`` (obs, entity): entity is the smallest observation of the cluster; ``merges`` (a, b, reason, score): one row for each merge, in observations."""

    members: DataFrame
    merges: DataFrame


def observed_words(name: Column) -> Column:
    """Words of a name in Latin letters, one spelling each, without noise words; single letters are initials."""
    plain = F.transform(F.split(F.lower(F.trim(runs_to_latin(name))), r"[\s.]+"), lambda w: F.regexp_replace(w, "[^a-z]", ""))
    table = F.create_map(*[F.lit(x) for pair in VARIANTS.items() for x in pair])
    unified = F.transform(plain, lambda w: F.coalesce(F.element_at(table, w), w))
    return F.coalesce(F.filter(unified, lambda w: (w != "") & ~w.isin(*NOISE)), F.array().cast("array<string>"))


def _named(observations: DataFrame) -> DataFrame:
    """(name, first, n, words, sounds) of each spelling: its first observation, how many there are; spellings without a long word have no blocks and are left out."""
    each = observations.groupBy("name").agg(F.min("obs").alias("first"), F.count("*").alias("n")).withColumn("words", observed_words(F.col("name")))
    return each.withColumn("sounds", F.array_sort(long_sounds(F.col("words")))).filter(F.size("sounds") > 0)


def _blocks(words: Column, sounds: Column) -> Column:
    """Keys of which two names alike share one: a long sound and how another word begins, by letter or by sound; the sound alone for names of one word.

    Names alike share a long sound, and where the shorter one has two words or more, a second word too, at least by its
    first letter; so a surname that very many people have does not pair all of them.
    """
    from casewright.functions.text import skeleton

    starts = F.array_distinct(F.concat(F.transform(words, lambda w: F.left(w, F.lit(1))), F.transform(words, lambda w: F.left(skeleton(w), F.lit(1)))))
    pairs = F.flatten(F.transform(sounds, lambda s: F.transform(starts, lambda c: F.concat(s, F.lit(" "), c))))
    return F.when(F.size(words) > 1, pairs).otherwise(F.concat(sounds, pairs))


def name_pairs(observations: DataFrame, least: float = NAME_MATCH) -> DataFrame:
    """(a, b, block, score): spellings (by their first observations, a < b) that are alike, with the first sound they share.

    Spellings meet in blocks (``_blocks``), each pair once, however many observations have them.
    """
    named = stored(_named(observations), "names")
    keyed = named.select("first", "words", "sounds", F.explode(_blocks(F.col("words"), F.col("sounds"))).alias("key"))
    side = lambda x: keyed.select("key", F.col("first").alias(x), F.col("words").alias(f"{x}_words"), F.col("sounds").alias(f"{x}_sounds"))
    met = side("a").join(side("b"), "key").filter("a < b").drop("key").dropDuplicates(["a", "b"])
    both = F.array(F.struct(F.col("a_words").alias("x"), F.col("b_words").alias("y")))
    score = F.get(F.transform(both, lambda p: words_likeness(p["x"], p["y"])), 0)
    return met.withColumn("score", score).filter(F.col("score") >= least).select("a", "b", F.array_min(F.array_intersect("a_sounds", "b_sounds")).alias("block"), "score")


def name_links(observations: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, block, score), observations a < b: all links that merging by name can take.

    Of two spellings alike, their first observations; and each later observation of a spelling with the earliest one of
    all spellings alike in that spelling's first block. Any other pair of observations comes after a way round through
    these, so merging in order never takes it.
    """
    named = _named(observations).select("name", "first", "n", F.element_at("sounds", 1).alias("block"), F.size("words").alias("size"))
    near = pairs.select(F.col("a").alias("first"), F.col("b").alias("other"), "block", "score").union(pairs.select("b", "a", "block", "score"))
    earlier = named.join(near, ["first", "block"]).groupBy("first").agg(F.min(F.struct("other", "score")).alias("e"))
    repeated = named.filter("n > 1").join(earlier, "first", "left").select(
        "name", "first", "block", F.when(F.col("e.other") < F.col("first"), F.col("e.other")).otherwise(F.col("first")).alias("at"),
        F.when(F.col("e.other") < F.col("first"), F.col("e.score")).otherwise(1.0).alias("score"),
    )
    later = observations.join(stored(repeated, "repeated"), "name").filter(F.col("obs") != F.col("first"))
    return pairs.select("a", "b", "block", "score").unionByName(later.select(F.least("at", "obs").alias("a"), F.greatest("at", "obs").alias("b"), "block", "score"))


def identifier_links(observations: DataFrame, identifiers: DataFrame) -> DataFrame:
    """(a, b, ident): each observation that has an identifier (obs, ident) with the first one that has it."""
    held = identifiers.filter("ident is not null and ident != ''").join(observations.select("obs"), "obs", "left_semi").select("obs", "ident").distinct()
    first = stored(held.groupBy("ident").agg(F.min("obs").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n"), "first")
    return held.join(first, "ident").filter("obs != a").select("a", F.col("obs").alias("b"), "ident")


def spanning_forest(vertices: DataFrame, links: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """((id, component) of ``vertices`` (id, component) with all links, the links that join two components when links are taken by ``order``, a, b).

    In a round each component takes its first link out; the number of components at least halves, so rounds are few.
    """
    rank = F.struct(*order, "a", "b")
    label, taken = vertices, None
    left = stored(links, "links")
    while True:
        ends = left.join(label.toDF("a", "ca"), "a").join(label.toDF("b", "cb"), "b").filter("ca != cb")
        left = stored(ends.drop("ca", "cb"), "links")
        if not left.limit(1).count():
            return label, taken if taken is not None else links.limit(0)
        ends = left.join(label.toDF("a", "ca"), "a").join(label.toDF("b", "cb"), "b").withColumn("rank", rank)
        first = ends.select(F.col("ca").alias("c"), "rank").union(ends.select("cb", "rank")).groupBy("c").agg(F.min("rank").alias("rank"))
        won = stored(ends.join(first.select("rank").distinct(), "rank", "left_semi").drop("rank"), "won")
        taken = won.drop("ca", "cb") if taken is None else taken.unionByName(won.drop("ca", "cb"))
        joined = gr.components(won.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct())
        label = stored(label.join(joined.toDF("component", "to"), "component", "left").select("id", F.coalesce("to", "component").alias("component")), "labels")


def resolve(observations: DataFrame, identifiers: DataFrame, least: float = NAME_MATCH) -> Resolved:
    """Entities of observations (obs long, unique: the place in order; name) by identifiers (obs, ident) and names.

    Observations whose name has no word but noise words are left out, as they say nothing of a person. An empty table
    gives no entities.
    """
    seen = stored(observations.select("obs", F.trim("name").alias("name")).filter(F.size(observed_words(F.col("name"))) > 0), "observations")
    held = stored(identifier_links(seen, identifiers), "identifiers")
    start = seen.select(F.col("obs").alias("id")).join(gr.components(held.select("a", "b").distinct()), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    pairs = stored(name_pairs(seen, least), "pairs")
    members, forest = spanning_forest(stored(start, "start"), name_links(seen, pairs), ["block"])
    said = lambda side: seen.select(F.col("obs").alias(side), F.col("name").alias(f"{side}_name"))
    named = forest.join(said("a"), "a").join(said("b"), "b")
    reason = F.format_string("name match %s ~ %s (score %.2f)", "a_name", "b_name", "score")
    merges = held.select("a", "b", F.concat(F.lit("shared identifier "), "ident").alias("reason"), F.lit(1.0).alias("score")).unionByName(named.select("a", "b", reason.alias("reason"), F.round("score", 2).alias("score")))
    return Resolved(members.select(F.col("id").alias("obs"), F.col("component").alias("entity")), merges)


def decisions(observations: DataFrame, merges: DataFrame) -> DataFrame:
    """(a_name, b_name, reason, score): merges told once for each pair of spellings and reason."""
    said = lambda side: observations.select(F.col("obs").alias(side), F.trim("name").alias(f"{side}_name"))
    return merges.join(said("a"), "a").join(said("b"), "b").groupBy("a_name", "b_name", "reason").agg(F.max("score").alias("score"))


def canonical_names(observations: DataFrame, members: DataFrame) -> DataFrame:
    """(entity, canonical, observations): the name with most spelled-out words, in Latin letters before others, then the longest, then the first seen.

    Where no Latin one is among those with most words, the longest of them is transliterated.
    """
    full = F.size(F.filter(observed_words(F.col("name")), lambda w: F.length(w) > 1))
    rank = F.struct(full.alias("full"), (~has_devanagari(F.col("name"))).alias("latin"), F.length("name").alias("n"), (-F.col("obs")).alias("obs"), F.col("name").alias("name"))
    each = observations.select("obs", F.trim("name").alias("name")).join(members, "obs").groupBy("entity").agg(F.max(rank).alias("best"), F.count("*").alias("observations"))
    shown = F.when(F.col("best.latin"), F.col("best.name")).otherwise(F.initcap(to_latin(F.col("best.name"))))
    return each.select("entity", shown.alias("canonical"), "observations")


def positional_ids(entities: DataFrame) -> DataFrame:
    """``entities`` with ``label``: P0001 and on, in the order of the text obs<entity>."""
    from casewright.operators.sequences import ranked

    placed = ranked(entities.withColumn("_root", F.concat(F.lit("obs"), F.col("entity").cast("string"))), [F.asc("_root")], "_place")
    return placed.withColumn("label", F.format_string("P%04d", "_place")).drop("_root", "_place")
