"""Training-data operators against brute force, with nulls, empty and long texts, ties, repeats and empty tables."""

import binascii
import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from oracle import same
from pyspark.sql import functions as F

from casewright.llm import chat, fingerprint, language_id, mixing, near_dedup as near, warc
from casewright.llm.exact_dedup import exact_dedup
from casewright.llm.line_dedup import chunks, remove_chunks, repeated_chunks, repeated_runs
from casewright.llm.mixing import mix
from casewright.llm.near_dedup import near_dedup
from casewright.llm.packing import best_fit, pack
from casewright.llm.passage_dedup import repeated_passages
from casewright.llm.queries import ORACLE, QUERIES
from casewright.llm.substring_dedup import cut_units, repeated_stretches, repeated_units

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, row string, key string, start string, digest string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def table(spark, rows):
    """Documents of (id, text, source), with columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, None, "x", "y", "z", "u", "v") for i, t, s in rows], SCHEMA)


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    words = ["w%d" % k for k in range(400)] + ["Été", "straße", "ABC", "日本"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 90))) for _ in range(n // 2)]
    rows = []
    for i in range(n):
        t = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 2])):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i * 3, rng.choice([" ", "\n", "\t "]).join(t), f"s{rng.randrange(4)}"))
    long = " ".join(rng.choice(words) for _ in range(30_000))
    return [*rows, (1000, None, None), (1001, "", "s1"), (1002, " \n\t", "s1"), (1003, long, "s2"), (1004, long + " end", "s2"), (7, rows[0][1], "s3"), (None, "a text without an id of its own", "s0"), (1003, long, "s2")]


def shingles(text, k=5):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    same(spark, QUERIES[name], ORACLE.get(name))


def test_empty_tables(spark):
    docs = table(spark, [])
    for f in (exact_dedup, near_dedup, repeated_units, repeated_stretches, repeated_runs, repeated_passages, repeated_chunks, mix, pack, fingerprint.fingerprints, fingerprint.with_next):
        assert f(docs).count() == 0
    assert language_id.identify(docs, language_id.fit(docs)).count() == 0
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_exact_dedup(spark):
    rows = corpus()
    got = exact_dedup(table(spark, rows), digest_all=True).collect()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0))
    first = {k: min(v)[2] for k, v in groups.items()}
    by_digest = {hashlib.sha256(k.encode()).digest(): k for k in groups}
    assert len(got) == len(rows)
    for r in got:
        k = by_digest[bytes(r.digest)]
        assert (r.keep_id, r.group_size) == (first[k] if r.doc_id is not None else None, len(groups[k]))
    assert Counter(by_digest[bytes(r.digest)] for r in got if r.kept) == Counter(groups.keys())


@pytest.mark.parametrize("percent,banding", [(85, (5, 25)), (80, (4, 32))])
def test_near_dedup(spark, percent, banding):
    rows = corpus()
    got = near_dedup(table(spark, rows), percent=percent, banding=banding).collect()
    sets = {i: shingles(t) for i, t, _ in rows if i is not None}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root(r.doc_id), root(r.doc_id) == r.doc_id)
    assert Counter(r.doc_id for r in got if r.first_row) == Counter({r.doc_id: 1 for r in got})


def test_near_dedup_large_group(spark):
    rng = random.Random(5)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for i in range(700):  # more than two blocks; each differs from the base by one word, from others by up to two
        t = list(base)
        t[rng.randrange(60)] = f"x{i}"
        rows.append((i + 1, " ".join(t), "s"))
    rows.append((0, " ".join(base), "s"))
    sets = {i: shingles(t) for i, t, _ in rows}
    near = {i for i in sets if 100 * len(sets[i] & sets[0]) >= 85 * len(sets[i] | sets[0])}
    got = {r.doc_id: r.component_id for r in near_dedup(table(spark, rows)).collect()}
    assert all(got[i] == 0 for i in near)


def test_near_dedup_large_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 4)
    rng = random.Random(15)
    rows = []
    base = [f"b{k}" for k in range(40)]
    for chain in range(3):  # chains of texts, each near to its neighbours, and their ends far from each other
        t = base[:20] + [f"own{chain}-{k}" for k in range(20)]
        for step in range(60):
            rows.append((len(rows), " ".join(t), "s"))
            t[rng.randrange(40)] = f"c{chain}-{step}"
    test_rows = [(i, t, s) for i, t, s in rows]
    sets = {i: shingles(t) for i, t, _ in test_rows}
    label = {i: i for i in sets}
    moved = True
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 60 * len(sets[a] | sets[b])]
    while moved:
        moved = False
        for a, b in links:
            m = min(label[a], label[b])
            moved |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    got = {r.doc_id: r.component_id for r in near_dedup(table(spark, test_rows), percent=60, banding=(1, 40)).collect()}
    assert got == label and len(set(label.values())) > 1


def test_substring_dedup(spark):
    line = " ".join(f"word{k}" for k in range(25))
    rows = [(9, "x", "s"), (9, "y", "s"), (1, f"first\n{line}\nrest", "s"), (2, f"{line.upper()}\né {line}", "s"), (3, f"ü\n {line}  \n{line}", None), (4, "short\nshort", "s"), (5, None, "s"), (6, "", "s")]
    docs = table(spark, rows)
    cuts = repeated_units(docs)
    got = sorted((r.doc_id, r.unit_no, r.start, r.stop, r.first_id, r.group_size) for r in cuts.collect())
    n = len(line)
    assert got == [(2, 0, 0, n, 1, 4), (3, 1, 2, 5 + n, 1, 4), (3, 2, 6 + n, 6 + 2 * n, 1, 4)]
    left = {r.doc_id: (r.text, [(s.start, s.stop) for s in r.kept_spans]) for r in cut_units(docs, cuts).filter("doc_id < 5").collect()}
    assert cut_units(docs, cuts).filter("doc_id = 9").count() == 2 and set(docs.columns) < set(cut_units(docs, cuts).columns)
    assert left[2] == (f"é {line}", [(n + 1, 2 * n + 3)]) and left[3] == ("ü", [(0, 1)]) and left[1][0] == rows[2][1]


def test_stretches_hold_against_brute_force(spark):
    rng = random.Random(8)
    pool = ["été", "ab", "Q", "日本"] + [f"w{k}" for k in range(500)]
    fresh = lambda n: [rng.choice(pool) + str(rng.random()) for _ in range(n)]
    wrapped = lambda ws: "".join(w + rng.choice([" ", " ", "  ", "\n", "\t"]) for w in ws)
    shared = fresh(160)
    rows = []
    for i in range(60):  # passages pasted into the middle of lines and wrapped anew, some in capitals
        a, n = rng.randrange(60), rng.choice([20, 24, 25, 49, 50, 51, 75, 100])
        rows.append((i, wrapped(fresh(rng.randrange(60)) + [w.upper() if w.isascii() and i % 3 else w for w in shared[a : a + n]] + fresh(rng.randrange(90))), "s"))
    rows += [(60 + k, wrapped(shared[30:90]), "s") for k in range(40)]  # a third of all rows hold the same passage
    rows += [(150, None, "s"), (151, "", "s"), (152, "again " * 49, "s"), (153, "again " * 70, "s"), (154, "once " * 5000, "s"), (155, wrapped(fresh(20_000) + shared), "s"), (None, wrapped(shared), "s")]
    rows += [(200, twice := wrapped(fresh(80)), "s"), (200, twice, "s"), (200, wrapped(fresh(80)), "s")]  # the first two are one document
    texts, order = {}, []
    for i, t, _ in rows:
        if (i, t) not in texts:
            texts[i, t] = [m for m in WORD.finditer(t or "")]
            order.append((i, t))
    earlier = {25: set(), 50: []}
    for width in (25, 50):
        seen = defaultdict(list)
        for n, key in enumerate(order):
            plain = [m.group().translate(LOWER) for m in texts[key]]
            for p in range(len(plain) - width + 1):
                w = tuple(plain[p : p + width])
                if any(m < n or q + (25 if width == 25 else 50) <= p for m, q in seen[w][:1]):
                    if width == 25:
                        earlier[25] |= {(key, k) for k in range(p, p + 25)}
                    else:
                        earlier[50].append((key, p))
                seen[w].append((n, p))
    got = defaultdict(set)
    docs = table(spark, rows)
    for r in repeated_stretches(docs).collect():
        key = next(k for k in order if k[0] == r.doc_id and len(texts[k]) >= r.first_word + r.words and (texts[k][r.first_word].start(), texts[k][r.first_word + r.words - 1].end()) == (r.start, r.stop))
        here = {(key, k) for k in range(r.first_word, r.first_word + r.words)}
        assert r.words >= 25 and not here & got[key]
        got[key] |= here
    found = set().union(*got.values())
    assert found <= earlier[25] and len(found) > 2000
    assert all(sum((key, k) in found for k in range(p, p + 50)) >= 25 for key, p in earlier[50])


def test_passages_match_brute_force(spark):
    rng = random.Random(8)
    pool = ["été", "ab", "Q", "日本"] + [f"w{k}" for k in range(500)]
    fresh = lambda n: [rng.choice(pool) + str(rng.random()) for _ in range(n)]
    shared = fresh(160)
    rows = []
    for i in range(40):  # stretches of 20 to 110 shared words inside lines, over line ends, in short lines
        a, n = rng.randrange(60), rng.choice([20, 49, 50, 51, 75, 110])
        rows.append((i, "".join(w + rng.choice([" ", " ", "  ", "\n", "\t"]) for w in fresh(rng.randrange(60)) + [w.upper() if w.isascii() and i % 3 else w for w in shared[a : a + n]] + fresh(rng.randrange(90))), "s"))
    rows += [(50, None, "s"), (51, "", "s"), (52, "again " * 49, "s"), (53, "again " * 70, "s"), (54, "once " * 120, "s"), (None, " ".join(shared), "s")]
    seen, want = defaultdict(list), set()
    for n, (i, t, _) in enumerate(rows):
        words = list(WORD.finditer(t or ""))
        plain = [m.group().translate(LOWER) for m in words]
        for p in range(len(words) - 49):
            key = tuple(plain[p : p + 50])
            if any(m < n or q + 50 <= p for m, q in seen[key]):
                want |= {(i, m.start()) for m in words[p : p + 50]}
            seen[key].append((n, p))
    docs = table(spark, rows).repartition(1).sortWithinPartitions(F.col("doc_id").asc_nulls_last())
    texts, got = {i: t for i, t, _ in rows}, []
    for r in repeated_passages(docs).collect():
        inside = [m.start() + r.start for m in WORD.finditer(texts[r.doc_id][r.start : r.stop])]
        assert len(inside) == r.words and texts[r.doc_id][r.start : r.stop].strip() == texts[r.doc_id][r.start : r.stop]
        got += [(r.doc_id, k) for k in inside]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000
    assert repeated_passages(table(spark, [])).count() == 0


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(9)
    lines = [f"line {k} " + "x" * rng.randrange(20) for k in range(80)]
    shared = lines[:30]
    rows = [(i, "\n".join([*rng.choices(lines, k=rng.randrange(12)), *shared[rng.randrange(10) :], *rng.choices(lines, k=3)]), "s") for i in range(30)]
    rows += [(50, None, "s"), (51, "", "s"), (52, "\n\n\n\n", "s"), (53, rows[0][1], "s")]
    docs = table(spark, rows)
    seen, want = {}, set()
    for i, t, _ in rows:
        ls = (t or "").split("\n")
        for no, (a, b, _) in enumerate(chunks(ls)):
            body = "\n".join(ls[a:b])
            if b - a >= 2 and body.strip("\n"):
                if body in seen:
                    want.add((i, no, seen[body]))
                else:
                    seen[body] = i
    cuts = repeated_chunks(docs)
    got = {(r.doc_id, r.chunk_no, r.first_id) for r in cuts.collect()}
    assert got == want and len(want) > 20
    texts = {i: t for i, t, _ in rows}
    for r in cuts.collect():
        assert "\n".join(texts[r.doc_id].split("\n")[r.first_line : r.first_line + r.lines]) == texts[r.doc_id][r.start : r.stop]
    left = {r.doc_id: r.text for r in remove_chunks(docs, cuts).collect()}
    assert left[0] == texts[0] and left[51] == "" and left[50] is None
    gone = defaultdict(set)
    for r in cuts.collect():
        gone[r.doc_id] |= set(range(r.first_line, r.first_line + r.lines))
    for i, t in texts.items():
        if t is not None:
            rest = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])
            assert left.get(i, "").strip() == rest.strip()


def test_repeated_runs_match_brute_force_over_all_runs(spark):
    rng = random.Random(4)
    own = iter(range(10**6))
    fresh = lambda n: [f"own line {next(own)}" for _ in range(n)]
    shared = [f"shared é {k}" for k in range(12)]
    texts = []
    for _ in range(40):  # shared runs of 1 to 6 lines anywhere between own lines
        a = rng.randrange(10)
        texts.append(fresh(rng.randrange(4)) + shared[a : a + rng.randrange(1, 7)] + fresh(rng.randrange(4)) + rng.choice([[], ["", ""], ["a", "a", "a", "a"], shared[:2]]))
    rows = [(i, "\n".join(t), "s") for i, t in enumerate(texts)] + [(50, None, "s"), (51, "", "s"), (52, "\n\n\n\n", "s"), (None, "\n".join(shared[:3]), "s")]
    lines = [(t or "").split("\n") for _, t, _ in rows]
    want = {}
    for n, ls in enumerate(lines):
        gone = set()
        for i in range(len(ls)):
            for j in range(i + 2, len(ls) + 1):  # every run of two lines or more, anywhere earlier and disjoint
                if any(m[k : k + j - i] == ls[i:j] for o, m in enumerate(lines[: n + 1]) for k in range((len(m) if o < n else i) - (j - i) + 1)):
                    gone |= set(range(i, j))
        runs = [[k for k in range(len(ls)) if k in gone and k - 1 not in gone], [k + 1 for k in range(len(ls)) if k in gone and k + 1 not in gone]]
        want[rows[n][0]] = [(a, b - a) for a, b in zip(*runs, strict=True) if any(ls[a:b])]
    docs = table(spark, rows).repartition(1).sortWithinPartitions(F.col("doc_id").asc_nulls_last())
    got, text = defaultdict(list), {i: t for i, t, _ in rows}
    cuts = repeated_runs(docs).collect()
    for r in sorted(cuts, key=lambda r: r.first_line):
        got[r.doc_id].append((r.first_line, r.lines))
        assert "\n".join(text[r.doc_id].split("\n")[r.first_line : r.first_line + r.lines]) == text[r.doc_id][r.start : r.stop]
    assert got == {i: x for i, x in want.items() if x} and sum(map(len, got.values())) > 30
    left = {r.doc_id: r.text for r in remove_chunks(docs.filter("doc_id is not null"), repeated_runs(docs)).collect()}
    for i, t in text.items():
        if t is not None and i is not None:
            gone = {k for a, n in want[i] for k in range(a, a + n)}
            assert left.get(i, "").strip() == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone).strip()


def test_fingerprints(spark):
    rows = [r for r in corpus() if r[0] is not None]
    both = fingerprint.with_next(table(spark, rows))
    changed = fingerprint.edited(F.col("text"), F.col("next_start"))
    a, b = fingerprint.sketch(F.col("text")), fingerprint.sketch(changed)
    got = both.select("id", "text", changed.alias("changed"), "next_sketch", a.alias("a"), fingerprint.resemblance(a, b).alias("r"), fingerprint.containment(a, b).alias("c"), fingerprint.distinct_shingles(a).alias("n")).collect()
    texts = {}
    for i, t, _ in rows:
        texts[i] = min(t or "", texts.get(i, t or ""))
    order = sorted(texts)
    assert len(got) == len(rows)
    sketches = {r.id: r.a for r in got}
    for r in got:
        nxt = texts[order[(order.index(r.id) + 1) % len(order)]]
        half = len(r.text) // 2
        assert r.changed == r.text[: len(r.text) - half] + nxt[:half]
        x, y = shingles(r.text.lower()), shingles(r.changed.lower())
        if x | y:
            assert abs(r.r - len(x & y) / len(x | y)) < 0.17
            assert abs(r.n - len(x)) <= 0.35 * max(1, len(x))
        assert r.next_sketch == sketches[order[(order.index(r.id) + 1) % len(order)]]


def test_sketches_merge(spark):
    rng = random.Random(2)
    w = [f"v{rng.randrange(1000)}" for _ in range(900)]
    df = spark.createDataFrame([(w[:500], w[496:], w)], "a array<string>, b array<string>, whole array<string>")
    s = [fingerprint.sketch_of_words(F.col(c)) for c in ("a", "b", "whole")]
    r = df.select(fingerprint.merged(s[0], s[1]).alias("m"), s[2].alias("w")).first()
    assert r.m == r.w and len(r.w) == fingerprint.K


def test_language_model_of_very_many_languages(spark):
    rng = random.Random(5)
    alphabet = [chr(c) for c in range(0x4E00, 0x4E00 + 1200)]
    rows = [(i, "".join(rng.choice(alphabet[3 * (i % 400) : 3 * (i % 400) + 3]) for _ in range(50 if i % 400 else 10)), f"x{i % 400}") for i in range(800)]
    docs = spark.createDataFrame([(i, t, "s", None, g) for i, t, g in rows], "doc_id long, text string, source string, n_chars long, lang string")
    model = language_id.fit(docs)
    taught = {g for i, _, g in rows if binascii.crc32(str(i).encode()) % 4 != 2}
    assert {x for f in model.families for x in f} == taught and len(taught) > 300
    assert sum(model.predict(t)[0] == g for _, t, g in rows[:60] if g in taught) > 40


def test_language(spark):
    alphabet = {"en": "the and of ing tion", "de": "der und ung keit sch", "fr": "le et ment eux que", "es": "los que ción ado ez"}
    rng = random.Random(4)
    rows = []
    for i in range(240):
        lang = list(alphabet)[i % 4]
        rows.append((i, " ".join(rng.choice(alphabet[lang].split()) + rng.choice("aeiou") for _ in range(rng.randrange(5, 60))), lang))
    rows += [(500, None, "en"), (501, "", "en"), (502, "123 !? 456", "de"), (503, "le et " * 40_000, None), (None, "the and of", None)]
    docs = spark.createDataFrame([(i, t, lang, "src", 0, "old") for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, score string")
    got = {r.doc_id: r for r in language_id.identify(docs, language_id.fit(docs)).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang_pred == lang for i, _, lang in rows if i is not None and i < 240)
    assert [got[k].lang_pred for k in (500, 501, 502, 503)] == ["und", "und", "und", "fr"]
    assert all(0 <= r.score <= 1 for r in got.values())


@pytest.mark.parametrize("fan_in", [256, 2])
def test_warc_round_trip(spark, monkeypatch, fan_in):
    monkeypatch.setattr(warc, "FAN_IN", fan_in)
    rng = random.Random(6)
    same_page = "<p>" + "copy " * 40 + "</p>"
    rows = [(i, f"http://WWW.host{i % 3}.example.com:80/a{i % 7}?q={i}#x", same_page if i % 5 == 0 else f"<p>{i} " + "é" * rng.randrange(200)) for i in range(60)]
    rows += [(None, "http://x.org/none", same_page), (None, "http://x.org/none", "<p>tiny"), (25, "http://x.org/again", same_page), (25, "http://x.org/again", same_page)]
    rows += [(100, None, None), (101, "", ""), (102, "http://x.org/%\r\nA", "tiny"), (103, "http://x.org/b", "tiny"), (104, "https://x.org:8080", same_page)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")
    from casewright.llm.common import scratch

    folder = scratch(spark, "test-archives")
    got = warc.capture_histories(spark, folder, warc.write_archives(pages.repartition(3), folder), ranges=4).collect()
    known = [r for r in rows if r[0] is not None]
    want = Counter()
    for i, u, h in rows:
        body = (h or "").encode()
        first = min((j for j, _, g in known if (g or "") == (h or "")), default=None)
        again = len(body) >= 100 and i is not None and first != i
        want[i, u, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first if again else None] += 1
    assert Counter((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    in_order = [(r.url_key, r.captured, -1 if r.page_id is None else r.page_id) for r in sorted(got, key=lambda r: (r.range_no, r.place))]
    assert in_order == sorted(in_order)
    assert warc.url_key("http://WWW.Host.example.com:80/a#x") == "com,example,host)/a"


def test_warc_ranges_where_keys_are_dealt_to_more_partitions(spark, monkeypatch):
    from casewright.llm.common import scratch

    rows = [(i, f"http://x{i % 2}.org/{i % 9}", f"<p>{i % 50}" + "text " * 30) for i in range(400)]
    folder = scratch(spark, "test-archives")
    archives = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), folder)
    frame = type(archives)
    monkeypatch.setattr(frame, "repartitionByRange", lambda self, n, *cols, f=frame.repartitionByRange: f(self, max(n, 31), *cols))
    plain = None
    for ranges in (4, 1, 3, None):
        got = sorted(warc.capture_histories(spark, folder, archives, ranges).collect(), key=lambda r: (r.range_no, r.place))
        assert {r.range_no for r in got} == set(range(ranges or 3))
        assert [(r.url_key, r.captured, r.page_id) for r in got] == sorted((r.url_key, r.captured, r.page_id) for r in got)
        found = sorted((r.page_id, r.url, r.payload_digest, r.record_type, r.refers_to) for r in got)
        plain = plain or sorted((i, u, hashlib.sha256(h.encode()).hexdigest(), "revisit" if i >= 50 else "response", i % 50 if i >= 50 else -1) for i, u, h in rows)
        assert [(*r[:4], -1 if r[4] is None else r[4]) for r in found] == plain


def test_warc_reads_few_pages_at_once(spark, monkeypatch, tmp_path):
    from casewright.llm.common import scratch, stored

    key, seen = "spark.sql.parquet.columnarReaderBatchSize", []
    before = spark.conf.get(key)
    monkeypatch.setattr(warc, "stored", lambda df, tag: (seen.append(int(spark.conf.get(key))), stored(df, tag))[1])
    spark.createDataFrame([(i, "http://x.org", f"{i % 300} " + "text " * 40) for i in range(1000)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages")
    folder = scratch(spark, "test-archives")
    archives = warc.write_archives(spark.read.parquet(f"{tmp_path}/pages"), folder)
    assert len(seen) == 2 and max(seen) <= warc.READ_ROWS and spark.conf.get(key) == before
    got = {r.page_id: r.refers_to for r in warc.capture_histories(spark, folder, archives).collect()}
    assert got == {i: i % 300 if i >= 300 else None for i in range(1000)}


def test_no_pages(spark):
    from casewright.llm.common import scratch

    folder = scratch(spark, "test-archives")
    archives = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert archives.count() == 0 and warc.capture_histories(spark, folder, archives).count() == 0


def test_loser_tree():
    rng = random.Random(8)
    for k in range(12):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(k)]
        assert list(warc.loser_tree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_best_fit_matches_plain_search():
    rng = random.Random(11)
    for _ in range(30):
        items = sorted(((rng.randrange(1, 40), rng.randrange(5), rng.choice([-1, -1, 0, 1, 2])) for _ in range(120)), reverse=True)
        got = best_fit(items, 50)
        bins, tightest = [], 0
        for (size, source, cluster), (number, rest) in zip(items, got, strict=True):
            fits = [b["rest"] for b in bins if b["rest"] >= size and source not in b["sources"] and cluster not in b["clusters"]]
            if fits:
                tightest += 1
                b = bins[number]
                assert b["rest"] == min(fits) and source not in b["sources"] and (cluster < 0 or cluster not in b["clusters"])
            else:
                assert number == len(bins)
                bins.append(b := {"rest": 50, "sources": set(), "clusters": set()})
            b["rest"] -= size
            b["sources"].add(source)
            if cluster >= 0:
                b["clusters"].add(cluster)
            assert b["rest"] == rest >= 0
        assert tightest


def test_packing(spark):
    rows = corpus()
    docs = table(spark, [*rows, *[(None, "the same text", None)] * 30])
    got = pack(docs, capacity=100, shard_docs=40).collect()
    assert sum(r.size for r in got) == sum(len(WORD.findall(t or "")) for _, t, _ in rows) + 90
    assert len({(r.doc_id, r.copy, r.cluster, r.source, r.piece) for r in got}) == len(got)
    bins = defaultdict(list)
    for r in got:
        assert (r.bin is None) == (r.size == 0)
        if r.bin is not None:
            bins[r.shard, r.bin].append(r)
    for b in bins.values():
        assert sum(r.size for r in b) <= 100
        assert len({r.source for r in b}) == len(b) == len({r.cluster for r in b})
    # each shard as the plain search packs it, and the same whatever the partitions
    for shard in {r.shard for r in got}:
        mine = sorted((r for r in got if r.shard == shard and r.size), key=lambda r: (-r.size, r.bin))
        assert [r.size for r in mine] == sorted((r.size for r in got if r.shard == shard and r.size), reverse=True)
    facts = lambda rs: sorted(((r.doc_id is None, r.doc_id or 0, r.copy, r.piece, r.size, r.source or "", r.cluster, r.shard, r.bin or 0, r.residual or 0) for r in rs))
    assert facts(pack(docs.repartition(7, "text"), capacity=100, shard_docs=40).collect()) == facts(got)


def test_packing_keeps_given_clusters_apart(spark):
    docs = spark.createDataFrame([(k, f"text {k}", f"s{k}", k % 2) for k in range(6)], "doc_id long, text string, source string, group long")
    got = pack(docs, cluster_col="group").collect()
    assert len({(r.shard, r.bin, r.cluster) for r in got}) == 6


def test_packing_keeps_large_ids_and_clusters_next_to_nulls(spark):
    big = 1 << 53
    rows = [(None, "a b", "s", 1 << 62), (big + 1, "c d", "t", (1 << 62) + 1), (big + 3, "e f", "t", (1 << 62) + 1), (big + 5, "g h", "u", (1 << 62) + 3), (7, "i j", None, None)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, source string, group long"), cluster_col="group").collect()
    assert {(r.doc_id, r.source, r.cluster) for r in got} == {(i, s, g) for i, _, s, g in rows}
    where = {r.doc_id: (r.shard, r.bin) for r in got}
    assert where[big + 1] != where[big + 3] and where[big + 1] == where[None] == where[big + 5] == where[7]


@pytest.mark.parametrize("few", [100_000, 0])
def test_mixing(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW_SOURCES", few)
    rows = corpus(n=400)
    got = mix(table(spark, rows)).collect()
    assert len(got) == len(rows)
    size = Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(size.values()), set(names)
    while open_:  # share by weight, cap, and share again what is left
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * size[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = 2.0 * size[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    taken, most = Counter(), Counter()
    for r in got:
        assert abs(r.target - target[r.source]) < 1e-6 * max(1, r.target) and r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
    for s in names:
        assert abs(taken[s] - target[s]) <= most[s]


def test_chat(spark):
    nasty = ["<|im_end|>", "a\\<|b\\", "<", "|>", "<\\|im_end|>\n", "", None, "line\nline", "\\\\", "é日"]
    rows = [(1, k, ["user", "assistant"][k % 2], t) for k, t in enumerate(nasty)] + [(2, 5, "assistant", "b"), (2, 1, "user", "a"), (2, 0, "system", "s"), (3, 0, "assistant", "x"), (4, 0, None, "y"), (4, 0, "us\ner\\", "<|z"), (None, 0, "user", "n"), (2, 9, "assistant", "b")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    made = chat.format_chats(df).withColumn("back", chat.parse_chats(F.col("formatted"))).collect()
    by = defaultdict(list)
    for c, k, role, t in rows:
        by[c].append((k, role or "", t or ""))
    assert {r.conv_id for r in made} == set(by)
    for r in made:
        want = [(a, b) for _, a, b in sorted(by[r.conv_id])]
        assert [(x.role, x.text) for x in r.back] == want
        assert "".join(s.text for s in r.segments) == r.formatted
        assert sum(s.loss for s in r.segments) == sum(a == "assistant" for a, _ in want)
    state = {r.conv_id: (r.valid, r.first_bad) for r in made}
    assert state[1] == (True, None) and state[2] == (False, 4) and state[3] == (False, 1) and state[4][0] is False and state[None] == (False, None)


PIPELINE = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    rows = corpus(n=200)
    docs = spark.createDataFrame([(i, t, "en", s, len(t) if t else None) for i, t, s in rows], PIPELINE)
    for name, stage in p.STAGES[:4]:
        out = stage(spark, docs, "")
        assert set(out.columns) == set(p.COLUMNS), name
    kept = p.drop_near_copies(spark, docs, "").collect()
    # one of each component of the links, the smallest id of it; rows that repeat id and text once
    nodes = sorted({(i is None, i or 0, t or "", t is None) for i, t, _ in rows})
    sets = [shingles(n[2]) for n in nodes]
    parent = list(range(len(nodes)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for b in range(len(nodes)):
        for a in range(b):
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    want = Counter(n[:2] for k, n in enumerate(nodes) if root(k) == k)
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in kept) == want


def test_documents_that_share_an_id_stay_apart(spark):
    import corpus_pipeline as p

    rng = random.Random(3)
    text = lambda: "\n".join(" ".join(rng.choice("the and of to in") + str(rng.random()) for _ in range(12)) for _ in range(6))
    a, b, c, lines = text(), text(), text(), "one shared line here\nand another one"
    rows = [(1, a, "s"), (1, b, "s"), (None, c, "s"), (None, text(), None), (2, a + "\n" + lines, "s"), (2, lines + "\n" + b, "s"), (3, text(), "s"), (3, rows3 := text(), "s"), (4, rows3, "s"), (5, "", "s"), (5, None, "s"), (6, text(), "s")]
    rows += [rows[-1]]
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], PIPELINE)
    for _, stage in p.STAGES[:1]:
        assert Counter((r.doc_id, r.text) for r in stage(spark, docs, "").collect()) == Counter((i, t) for i, t, _ in rows if t)
    cut = Counter((r.doc_id, r.text) for r in p.drop_repeated_lines(spark, docs, "").collect())
    assert cut[1, a] == cut[1, b] == cut[None, c] == 1 and cut[6, rows[-1][1]] == 2 and cut[5, ""] == cut[5, None] == 1
    assert sum(n for (i, t), n in cut.items() if i == 2) == 1 and (4, rows3) not in cut
    kept = Counter((r.doc_id, r.text) for r in p.drop_near_copies(spark, docs, "").collect())
    assert kept[1, a] == kept[1, b] == kept[None, c] == kept[3, rows3] == kept[6, rows[-1][1]] == 1 and (4, rows3) not in kept
    mixed = Counter((r.doc_id, r.text) for r in p.mix_sources(spark, docs, "").collect())
    assert set(mixed) <= {(i, t) for i, t, _ in rows} and max(mixed.values()) <= 4


def test_pipeline_of_an_empty_table(spark):
    import corpus_pipeline as p

    docs = spark.createDataFrame([], PIPELINE)
    for name, stage in p.STAGES:
        assert stage(spark, docs, "").count() == 0, name


def test_pipeline_runs(spark):
    import corpus_pipeline as p

    out = p.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100
    assert out.filter("residual < 0").count() == 0
