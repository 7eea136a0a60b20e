"""Whitening, importance resampling and byte-pair encoding against exact arithmetic, plain Python and the library."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from oracle import FOLDER
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from casewright.llm import bpe, importance
from casewright.llm.queries import QUERIES
from casewright.llm.whitening import DoubleDouble, divided, eigen, moments, outer_products, whiten

CLASHING = "n long, x string, id string, v string, component string, key string, weight string, rank string"
CLASHES = (1, "x", "i", "v", "c", "k", "w", "r")


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, *CLASHES) for i, v in rows], "vec_id long, embedding array<float>, " + CLASHING)


def whitened_plainly(rows, k=4):
    """The contract in exact integers: id -> deviation, and whitened, explained (signs are free)."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [tuple(math.floor(256 * float(np.float32(c))) for c in v) for _, v in kept]
    fit = sorted(set(x))
    n, d = len(fit), len(fit[0])
    s = [sum(r[j] for r in fit) for j in range(d)]
    y = [[n * r[j] - s[j] for j in range(d)] for r in fit]
    cov = np.array([[float(Fraction(sum(r[a] * r[b] for r in y), n**3)) for b in range(d)] for a in range(d)])
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    z = np.array([[c - t / n for c, t in zip(r, s)] for r in x]) @ axes / np.sqrt(values)
    return n, kept, [sum((n * c - t) ** 2 for c, t in zip(r, s)) for r in x], z, values / np.trace(cov)


def test_whitening_matches_exact_integers(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 6)) * [5, 4, 3, 2, 1, 0.5] + 1000  # far from 0, so centring matters
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(500 + i, rows[3][1]) for i in range(200)] + [(3, rows[4][1]), (None, rows[5][1])]
    bad = [(900, None), (901, [1.0] * 5 + [None]), (902, [1.0] * 5 + [float("nan")]), (903, [1.0] * 5 + [float("-inf")])]
    n, kept, deviation, z, explained = whitened_plainly(rows)
    got = whiten(vectors(spark, rows + bad)).collect()
    assert Counter((r.vec_id, r.component) for r in got) == Counter((i, c) for i, _ in kept for c in range(1, 5))
    assert {r.n for r in got} == {n} and {r.identity_error for r in got}.pop() < 1e-12
    want = sorted((i is None, i or 0, d, *(abs(v) for v in zz)) for (i, _), d, zz in zip(kept, deviation, z))
    mine = {}
    for r in got:
        mine.setdefault((r.vec_id is None, r.vec_id or 0, r.deviation), []).append((r.component, abs(r.whitened), r.explained))
    assert sorted(mine) == sorted({w[:3] for w in want})
    for w in want:
        for c, v, e in mine[w[:3]]:
            assert v == pytest.approx(w[2 + c], abs=1e-9) and e == pytest.approx(explained[c - 1], rel=1e-12)


def test_whitening_defined_cases(spark):
    assert whiten(vectors(spark, [])).count() == 0
    assert whiten(vectors(spark, [(1, None), (2, []), (3, [])])).count() == 0
    one = whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one) == [(i, c, 1, 0, None, 0.0, 0.0) for i in (1, 2) for c in (1, 2)]
    line = whiten(vectors(spark, [(1, [1.0, 1.0]), (2, [3.0, 3.0]), (3, [2.0])])).collect()  # rank 1, and a vector of another length
    assert {(r.vec_id, r.component): r.whitened is None for r in line} == {(1, 1): False, (1, 2): True, (2, 1): False, (2, 2): True, (3, 1): True, (3, 2): True}
    assert {r.deviation for r in line if r.vec_id == 3} == {None}
    assert sorted(round(abs(r.whitened), 12) for r in line if r.whitened is not None) == [1.0, 1.0]
    huge = whiten(vectors(spark, [(1, [3e38, -0.001]), (2, [-3e38, 0.001]), (3, [1.0, 2.0])])).collect()
    ends = [(2**63 - 1024, -1), (-(2**63), 0), (256, 512)]  # as wide as a long
    s = [sum(e[j] for e in ends) for j in (0, 1)]
    wide = [sum((3 * v - t) ** 2 for v, t in zip(e, s)) for e in ends]
    assert {(r.vec_id, r.n, r.deviation) for r in huge} == {(k + 1, 3, w if w < 2**63 else None) for k, w in enumerate(wide)} and len(huge) == 6


def test_compensated_sums_keep_what_doubles_lose(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-(2**20), 2**20, size=(5000, 3)).astype(float) + 2.0**45
    s = [sum(int(v) for v in col) for col in x.T]
    n = len(x)
    mean = divided(DoubleDouble(np.array([float(v) for v in s]), np.array([float(v - int(float(v))) for v in s])), n)
    got = outer_products(x, mean)
    for a in range(3):
        for b in range(3):
            exact = Fraction(sum((n * int(p) - s[a]) * (n * int(q) - s[b]) for p, q in zip(x[:, a], x[:, b])), n * n)
            assert abs(Fraction(got.high[a, b]) + Fraction(got.low[a, b]) - exact) <= abs(exact) * Fraction(1, 2**75) + Fraction(1, 2**20)
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(7)
    m = moments(df, "x", 3, n)
    assert [int(h) + int(low) for h, low in zip(*m.sums)] == s
    assert np.allclose(m.covariance.high, got.high / n, rtol=1e-15)


def test_eigen_solver():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(12, 12))
    a = a @ a.T
    values, axes = eigen(DoubleDouble(a, np.zeros_like(a)))
    assert np.all(np.diff(values) <= 0) and np.allclose(axes.T @ axes, np.eye(12), atol=1e-15) and np.allclose(a @ axes, axes * values, atol=1e-12)
    values, axes = eigen(DoubleDouble(np.eye(3), np.zeros((3, 3))))  # all alike
    assert np.allclose(values, 1) and np.allclose(axes.T @ axes, np.eye(3), atol=1e-15)


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def features(text):
    w = WORDS.findall((text or "").translate(LOWER))
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)], len(w)


def resampled_plainly(docs, target):
    made = [(i, *features(t)) for i, t in docs]
    s, t = Counter(), Counter()
    for _, f, _ in made:
        s.update(zlib.crc32(x.encode()) % 10000 for x in f)
    for x in target:
        t.update(zlib.crc32(y.encode()) % 10000 for y in features(x)[0])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + 10000) / ((s[b] + 1) * (n_t + 10000)))) for b in range(10000)]
    out = []
    for i, f, words in made:
        weight = sum(gain[zlib.crc32(x.encode()) % 10000] for x in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    large = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(large[: 5 * len(large) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_importance_matches_plain_python(spark):
    found = pq.read_table(f"{FOLDER}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    target = pq.read_table(f"{FOLDER}/benchmark.parquet", columns=["text"])["text"].to_pylist()
    got = QUERIES["op12_importance"](spark, FOLDER).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted((tuple(r) for r in got), key=str) == resampled_plainly([(r["doc_id"], r["text"]) for r in found], target)


def test_importance_defined_cases(spark):
    rng = random.Random(4)
    words = ["W%d" % k for k in range(50)] + ["Été", "x" * 70, "日本", "a-b"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(300)]
    docs += [(400, None), (401, ""), (402, "\0 -- "), (None, docs[0][1]), (7, docs[8][1]), (9, docs[9][1]), (9, docs[9][1])] + [(500 + k, docs[1][1]) for k in range(200)]
    docs += [(800, " ".join(rng.choice(words) for _ in range(40_000))), (801, "y" * 100_000)]
    target = [" ".join(rng.choice(words[:9]) for _ in range(30)), None]
    table = lambda rows: spark.createDataFrame([(*r, *CLASHES) for r in rows], "doc_id long, text string, " + CLASHING)
    asked = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(table(docs), asked).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted((tuple(r) for r in got), key=str) == resampled_plainly(docs, target)
    assert importance.resample(table([]), asked).count() == 0
    alone = importance.resample(table(docs[:30]), asked.limit(0)).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted((tuple(r) for r in alone), key=str) == resampled_plainly(docs[:30], [])


PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    rng = random.Random(6)
    parts = [*"abcdefstrvml'' \t\n\r 019.,%-é日本हिन्दी 　 \x1c\u0085\x00<|>ß🙂՘꟎", "'s", "'re", "'ll", "  ", "<|endoftext|>", "<|endof", "\n\n", "....", "the ", " of"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(80))) for _ in range(3000)]
    return [*made, "", "a" * 5000, " " * 3000 + "x", "ab" * 4000, "!" * 3000, "<|endoftext|>" * 3, "word " * 70_000]


def test_bpe_matches_the_library(spark):
    library = Tokenizer.from_file(PATH)
    rows = texts()
    codec = bpe.Codec(spark, PATH)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*rows, None])], "doc_id long, text string").repartition(8)
    made = docs.withColumn("ids", codec.encode(F.col("text"))).withColumn("decoded", codec.decode(F.col("ids")))
    got = {r.doc_id: r for r in made.withColumn("n", bpe.token_count(F.col("ids"))).collect()}
    for k, (t, e) in enumerate(zip(rows, library.encode_batch(rows, add_special_tokens=False), strict=True)):
        assert np.frombuffer(bytes(got[k].ids), "<u4").tolist() == e.ids, t[:200]
        assert got[k].decoded == library.decode(e.ids, skip_special_tokens=False) == t and got[k].n == len(e.ids)
    assert (bytes(got[len(rows)].ids), got[len(rows)].decoded, got[len(rows)].n) == (b"", "", 0)
    broken = spark.createDataFrame([(bytes([146, 0, 0, 0, 233, 0, 0, 0, 146, 0, 0, 0]),), (None,)], "ids binary").select(codec.decode(F.col("ids")).alias("t")).collect()
    assert [r.t for r in broken] == [library.decode([146, 233, 146], skip_special_tokens=False), None]


def test_bpe_query_digests(spark):
    library = Tokenizer.from_file(PATH)
    for r, d in zip(
        QUERIES["op13_bpe"](spark, FOLDER).orderBy("doc_id").collect(), sorted(pq.read_table(f"{FOLDER}/documents.parquet", columns=["doc_id", "text"]).to_pylist(), key=lambda d: d["doc_id"]), strict=True
    ):
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            d["doc_id"], len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(),
        )


def test_forced_cuts_are_never_inside_a_token():
    vocabulary = bpe.parsed(open(PATH, "rb").read())
    rng = random.Random(8)
    for t in texts()[:150]:
        b = t.encode()
        cuts = vocabulary._text_cuts(b).tolist()
        for at in rng.sample(cuts, min(3, len(cuts))):
            assert not any(b[at - 1 : at + 1] in token for token in vocabulary.tokens[:50256])


def test_vocabularies_of_another_kind_are_refused(spark):
    with pytest.raises(ValueError):
        bpe.Codec(spark, public_tokenizers.path("word_bpe_49k.json"))
