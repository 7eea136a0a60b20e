"""Language identification: the family first, then one-versus-one linear support vector machines within it.

Features are the shares of hashed runs of one to three code points (lower-cased, digits and punctuation as blanks) in
the whole text. A model is a few weight rows of fixed length, fitted on a bounded sample and sent to the tasks.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.llm.common import small_batches, stored

#: Families of well-known language codes; any other code is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "pl", "cs", "uk", "bg", "sr", "hr", "sk", "sl"),
}
_SLOTS = 1 << 13
_CHUNK = 1 << 20


def _letters(text: str) -> np.ndarray:
    """Code points in lower case; runs of all that is no letter are one blank."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(points):
        return points
    ascii_letter = (points >= 97) & (points <= 122)
    other = points >= 170
    if other.any():
        kinds = np.unique(points[other])
        letter = kinds[np.array([chr(c).isalpha() for c in kinds], dtype=bool)]
        ascii_letter |= np.isin(points, letter)
    points = np.where(ascii_letter, points, np.uint32(32))
    return points[(points != 32) | np.diff(points, prepend=np.uint32(0)).astype(bool)]


def _grams(points: np.ndarray) -> np.ndarray:
    """Slots of all runs of one to three code points, blank at either end."""
    p = np.concatenate([[32], points, [32]]).astype(np.uint32)
    out = []
    h = np.zeros(len(p), dtype=np.uint32)
    for n in range(3):
        h = (h[: len(p) - n] * np.uint32(0x01000193)) ^ (p[n:] * np.uint32(0x9E3779B1))
        mixed = h ^ (h >> np.uint32(15))
        out.append((mixed * np.uint32(0x85EBCA6B)) >> np.uint32(19))
    return np.concatenate(out)


def features(text: str) -> np.ndarray | None:
    """Square roots of the shares of the slots; null without a letter."""
    points = _letters(text)
    if not (points != 32).any():
        return None
    total = np.zeros(_SLOTS, dtype=np.int64)
    for lo in range(0, len(points), _CHUNK):
        total += np.bincount(_grams(points[max(0, lo - 2) : lo + _CHUNK]), minlength=_SLOTS)
    return np.sqrt(total / total.sum()).astype(np.float32)


def _svm(x: np.ndarray, y: np.ndarray, epochs: int = 12, c: float = 10.0) -> np.ndarray:
    """Weights of rows with a last column of 1 (so the bias is last) of a linear support vector machine, by dual coordinate descent."""
    norm = np.einsum("ij,ij->i", x, x)
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    order = np.random.Generator(np.random.PCG64(7))
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))) * c
    for _ in range(epochs):
        for i in order.permutation(len(x)):
            step = np.clip(alpha[i] - (y[i] * (x[i] @ w) - 1) / norm[i], 0, weight[i]) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * x[i]
    return w


@dataclass(frozen=True)
class Model:
    """``families``: names, languages of each; ``family``: weight rows, one against the rest; ``pairs``: weights by family of each pair of its languages."""

    families: tuple[tuple[str, ...], ...]
    family: np.ndarray
    pairs: tuple[tuple[tuple[int, int, np.ndarray], ...], ...]

    def predict(self, text: str | None) -> tuple[str, float]:
        x = features(text or "")
        if x is None or not self.families:
            return "und", 0.0
        margins = self.family[:, :-1] @ x + self.family[:, -1]
        f = int(margins.argmax())
        chance = 1 / (1 + np.exp(-2 * margins[f])) if len(self.families) > 1 else 1.0
        langs = self.families[f]
        votes, sure = np.zeros(len(langs)), np.zeros(len(langs))
        for a, b, w in self.pairs[f]:
            p = 1 / (1 + np.exp(-2 * (w[:-1] @ x + w[-1])))
            votes[a if p >= 0.5 else b] += 1
            sure[a] += p
            sure[b] += 1 - p
        best = max(range(len(langs)), key=lambda k: (votes[k], sure[k]))
        return langs[best], float(chance * (sure[best] / (len(langs) - 1) if len(langs) > 1 else 1.0))


def train(sample: list[tuple[str, str]]) -> Model:
    """A model of (language, text) pairs, in any order."""
    rows = [(lang, x) for lang, text in sorted(sample) if (x := features(text)) is not None]
    if not rows:
        return Model((), np.zeros((0, _SLOTS + 1)), ())
    langs = sorted({lang for lang, _ in rows})
    home = {code: name for name, codes in FAMILIES.items() for code in codes}
    names = sorted({home.get(x, f"only {x}") for x in langs})
    families = tuple(tuple(x for x in langs if home.get(x, f"only {x}") == name) for name in names)
    own = np.array([lang for lang, _ in rows])
    x = np.ones((len(rows), _SLOTS + 1), dtype=np.float32)
    for row, (_, v) in zip(x, rows, strict=True):
        row[:-1] = v
    place = {lang: k for k, f in enumerate(families) for lang in f}
    at = np.array([place[v] for v in own])
    family = [_svm(x, np.where(at == k, 1.0, -1.0)) if len(families) > 1 else np.zeros(_SLOTS + 1) for k in range(len(families))]
    pairs = []
    for codes in families:
        some = []
        for a, b in combinations(range(len(codes)), 2):
            held = (own == codes[a]) | (own == codes[b])
            some.append((a, b, _svm(x[held], np.where(own[held] == codes[a], 1.0, -1.0)).astype(np.float32)))
        pairs.append(tuple(some))
    return Model(families, np.array(family, dtype=np.float32), tuple(pairs))


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text is 2 modulo 4; a null id is not."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", each: int = 300, most_chars: int = 20_000, least_chars: int = 40) -> Model:
    """A model of about ``each`` documents a language, of ``least_chars`` to ``most_chars`` characters, whole texts, none of them held out.

    The sample is bounded: by hash of the id a share of ``each`` / (documents of the language), ``2 * each`` a language at
    most, so that its size does not follow the input. A language without documents in that range of lengths is learned
    from its ``each`` shortest ones. Null texts and null languages teach nothing; rows that share an id go into the
    sample together, and a table without usable rows gives a model that knows nothing. Languages are what ``lang_col``
    holds, as it is spelled: the model has a weight row for each family and each pair of languages in one, so ``lang_col``
    should hold codes and not free text.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col)).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit(11), F.col(id_col)).alias("h"), F.length(text_col).alias("n")
    )
    fits = F.col("n").between(least_chars, most_chars)
    shares = stored(known.groupBy("lang").agg(F.count_if(fits).alias("usable")), "languages")  # a row a language
    dealt = known.filter(fits).join(shares, "lang").filter((F.pmod(F.col("h"), F.lit(1 << 30)) / F.lit(1 << 30)) * F.col("usable") < 1.2 * each)
    nearest = Window.partitionBy("lang").orderBy("h", F.xxhash64("text"))
    picked = stored(dealt.select("lang", "text", F.row_number().over(nearest).alias("place")).filter(F.col("place") <= 2 * each).drop("place"), "sample")
    lacking = shares.join(picked.select("lang").distinct(), "lang", "left_anti").select("lang")
    if lacking.limit(1).count():  # texts are moved for this only if there are such languages; the model holds a weight row for each anyway
        shortest = Window.partitionBy("lang").orderBy("n", "h", F.xxhash64("text"))
        short = known.join(F.broadcast(lacking), "lang").withColumn("place", F.row_number().over(shortest)).filter(F.col("place") <= each)
        picked = picked.unionByName(short.select("lang", "text"))
    return train([(r["lang"], r["text"]) for r in picked.collect()])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``, with all its columns: lang_pred, score (0 to 1) added.

    The whole text is read, a very long one in parts. Null texts and texts without a letter are ``und`` with score 0; of
    languages with as many votes the one with the larger sum of scores is taken, then the first by name. Each row is
    judged by itself, so repeated rows are alike and an empty table stays empty. Columns of ``docs`` called lang_pred or
    score are replaced; all others stay.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast((model.families, model.family, model.pairs))

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts):
        known = Model(*sent.value)
        return pd.DataFrame([known.predict(t) for t in texts], columns=["lang_pred", "score"])

    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*rest, predict(F.col(text_col)).alias("_predicted")).select(*rest, F.col("_predicted.lang_pred").alias("lang_pred"), F.col("_predicted.score").alias("score"))
