"""Questions in words: a question is scored against what each intent is about, and becomes a registered plan with its parameters. No data is read here."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.operators import graph as gr
from casewright.plans.standin import Tables


@dataclass(frozen=True)
class Intent:
    """What a question is about: stems that speak for it with a weight, the least and most names it needs, and how sure an answer is (a fixed value)."""

    name: str
    stems: dict[str, float]
    names: tuple[int, int]
    sure: float


def _stems(weight: float, words: str) -> dict[str, float]:
    return dict.fromkeys(words.split(), weight)


INTENTS = (
    Intent("path", _stems(1.0, "connect relat link path rout between chain tie"), (2, 9), 0.92),
    Intent("neighbourhood", _stems(1.2, "around neighbour circle associat surround near") | _stems(0.9, "connect link network contact"), (1, 1), 0.85),
    Intent("influencers", _stems(1.5, "influenc kingpin leader mastermind central import boss") | _stems(0.7, "key top main people player suspect rank"), (0, 0), 0.90),
    Intent("anomalies", _stems(1.5, "suspic anomal unusual strang launder irregular flag") | _stems(0.8, "pattern cycle"), (0, 9), 0.88),
    Intent("transactions", _stems(1.4, "payment pay paid transact transfer money fund amount hawala"), (0, 9), 0.80),
    Intent("calls", _stems(1.4, "call phone rang dial spoke") | _stems(0.6, "contact"), (0, 9), 0.78),
    Intent("communities", _stems(1.4, "communit gang cluster group faction"), (0, 0), 0.85),
    Intent("timeline", _stems(1.4, "when timelin happen chronolog sequence event"), (0, 9), 0.75),
)
_NUMBER = {"crore": 1e7, "cr": 1e7, "lakh": 1e5, "lac": 1e5, "thousand": 1e3, "k": 1e3}


@dataclass(frozen=True)
class Question:
    intent: str
    names: tuple[int, ...] = ()
    hops: int | None = None
    amount: float | None = None
    limit: int | None = None
    days: int | None = None
    confidence: float = 0.0
    unresolved: tuple[str, ...] = field(default=())


def _known(words: list[str], names: dict[str, int]) -> tuple[list[int], set[int]]:
    """Ids of the names in the order of the question, and the places of words that they take up. Whole names first, the longest at each place; then a word of one name only."""
    by_words: dict[tuple[str, ...], int] = {}
    owners: dict[str, set[int]] = {}
    for label, key in names.items():
        parts = tuple(re.findall(r"\w+", label.lower()))
        by_words.setdefault(parts, key)
        for p in parts:
            if len(p) >= 4:
                owners.setdefault(p, set()).add(key)
    longest = max(map(len, by_words), default=0)
    found, taken, k = [], set(), 0
    while k < len(words):
        n = next((n for n in range(min(longest, len(words) - k), 0, -1) if tuple(words[k : k + n]) in by_words), 0)
        if n:
            found.append((k, by_words[tuple(words[k : k + n])]))
            taken |= set(range(k, k + n))
        k += max(1, n)
    for k, w in enumerate(words):
        if k not in taken and len(owners.get(w, ())) == 1:
            (key,) = owners[w]
            if key not in {i for _, i in found}:
                found.append((k, key))
            taken.add(k)
    return [i for _, i in sorted(found)], taken


def _counts(words: list[str]) -> dict[str, float]:
    """Numbers of a question by what they count: hops, limit, days, amount."""
    out: dict[str, float] = {}
    for k, w in enumerate(words):
        plain = w.replace(",", "")
        if not re.fullmatch(r"\d+(\.\d+)?(crore|cr|lakh|lac|k)?", plain):
            continue
        digits = re.match(r"[\d.]+", plain)[0]
        unit = plain[len(digits) :]
        before, after = words[k - 1] if k else "", words[k + 1] if k + 1 < len(words) else ""
        value = float(digits)
        if after.rstrip("s") in ("hop", "step", "degree"):
            out["hops"] = value
        elif after.rstrip("s") in ("day", "week", "month"):
            out["days"] = value * {"day": 1, "week": 7, "month": 30}[after.rstrip("s")]
        elif before in ("top", "first", "best"):
            out["limit"] = value
        elif unit or after in _NUMBER or before in ("rs", "inr", "over", "above", "than", "least"):
            out["amount"] = value * _NUMBER.get(unit or after, 1.0)
    return out


def parse(text: str, names: dict[str, int]) -> Question:
    """The intent whose stems weigh most among those that the number of names allows; the first of equal ones. Capitalised words that are no known name are ``unresolved``."""
    words = re.findall(r"\d[\d,.]*\w*|\w+", text.lower().rstrip("?.! "))
    ids, taken = _known(words, names)
    numbers = _counts(words)
    free = [w for k, w in enumerate(words) if k not in taken]
    weigh = lambda i: sum(max((v for s, v in i.stems.items() if w.startswith(s)), default=0.0) for w in free)
    fits = [(weigh(i), -k, i) for k, i in enumerate(INTENTS) if i.names[0] <= len(ids) <= i.names[1]]
    weight, _, best = max(fits, key=lambda f: f[:2], default=(0.0, 0, None))
    loose = tuple(w for w in re.findall(r"(?<!^)\b[A-Z][a-z]{2,}\b", text) if w.lower() not in {words[k] for k in taken})
    given = {"hops": numbers.get("hops"), "limit": numbers.get("limit"), "days": numbers.get("days")}
    rest = {k: int(v) for k, v in given.items() if v is not None}
    if best is None or weight <= 0:
        return Question("entity", tuple(ids), confidence=0.70, unresolved=loose, **rest) if ids else Question("unknown", unresolved=loose, **rest)
    return Question(best.name, tuple(ids), amount=numbers.get("amount"), confidence=best.sure, unresolved=loose, **rest)


def _involving(df: DataFrame, ids: Iterable[int], a: str, b: str) -> DataFrame:
    return df.filter(F.col(a).isin(*ids) | F.col(b).isin(*ids)) if ids else df


def answer(question: Question, t: Tables) -> DataFrame:
    """The plan of a question over the nation graph and the payments."""
    q = question
    match q.intent:
        case "path":
            paths = gr.simple_paths(t.link, q.names[0], q.names[1], q.hops or 5)
            return paths.orderBy("hops", F.array_join("path", "-")).limit(6)
        case "neighbourhood":
            return gr.neighbourhood(t.link, F.col("id") == q.names[0], q.hops or 2).filter("distance > 0")
        case "influencers":
            return gr.pagerank(t.link).orderBy(F.desc(F.round("pagerank", 9)), "id").limit(q.limit or 10)
        case "communities":
            return gr.communities(t.link)
        case "transactions":
            paid = _involving(t.pay.filter(F.col("amount") >= (q.amount or 0)), q.names, "src_nation", "dst_nation")
            return paid.orderBy(F.desc("amount"), "txn_id").limit(q.limit or 100)
        case "calls":
            return _involving(t.call, q.names, "caller", "callee")
        case "timeline":
            last = t.ev.agg(F.max("us").alias("last"))  # one row
            seen = t.ev.join(F.broadcast(last)).filter(F.col("us") >= F.col("last") - (q.days or 36_500) * 86_400_000_000).drop("last")
            return (seen.filter(F.col("user_id").isin(*q.names)) if q.names else seen).orderBy("us", "event_id").limit(q.limit or 100)
        case "entity":
            return t.nation.filter(F.col("n_nationkey").isin(*q.names))
        case "anomalies":
            return gr.cycles(t.flow, 1_000_000).orderBy(F.desc("total"))
    return t.nation.limit(0)


def suggested(t: Tables) -> DataFrame:
    """(place, question): of the strongest pair, the best connected nation, the largest payment and, last, two about the whole case."""
    pair = t.link.orderBy(F.desc("weight"), "a", "b").limit(1).select(F.lit(1).alias("place"), F.format_string("How is nation %d connected to nation %d?", "a", "b").alias("question"))
    hub = gr.both_ways(t.link).groupBy("src").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src").limit(1).select(F.lit(2).alias("place"), F.format_string("Who is around nation %d?", "src").alias("question"))
    most = t.flow.orderBy(F.desc("amount"), "src", "dst").limit(1).select(F.lit(3).alias("place"), F.format_string("Which payments over Rs 1 lakh involve nation %d?", "src").alias("question"))
    whole = t.spark.range(2).select((F.col("id") + 4).cast("int").alias("place"), F.when(F.col("id") == 0, "Who are the key people?").otherwise("Is there any suspicious pattern?").alias("question"))
    return pair.union(hub).union(most).union(whole)

