"""Case files by lines: what they name and what is committed (EX16, EX17)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.operators import harvest as h
from casewright.plans.registry import query
from casewright.plans.standin import _F, _L, Tables


def _named(step: int) -> str:
    return " || ' ' || ".join(part.replace("c_custkey", f"(c_custkey * {step} + {step - 1})") for part in (_F, _L))


_ONE, _TWO, _THREE = _named(1), _named(3), _named(10)
_TEL, _CAR, _MAIL = "'98765' || lpad(cast(c_custkey % 100000 as string), 5, '0')", "'MH12AB' || cast(1000 + c_custkey % 9000 as string)", "'v' || cast(c_custkey as string) || '@post.in'"
_WARD = "case when c_custkey % 2 = 0 then 'City Hospital' else 'Lakeside General Hospital' end"
_DAY = "lpad(cast(1 + c_custkey % 28 as string), 2, '0')"
#: A case file of each customer.
_LINES = [
    "'CASE SHEET ' || cast(c_custkey as string)", f"'Missing person: ' || {_ONE} || ', age 17'", f"'Contact:  ' || {_TEL}", f"'2024-01-' || {_DAY} || ' 10:15 Mr. ' || {_TWO} || ' met ' || {_ONE} || ' at ' || {_WARD}",
    f"'Vehicle: ' || {_CAR}", f"{_THREE} || ' left early, mail ' || {_MAIL}", "'Last seen at: Harbour Road ' || cast(c_custkey % 50 as string)", "''",
]

# The same, by what each line is made of: which thing in which line, how often, in which order.
_KEY = "kind || ':' || regexp_replace(lower(name), '[^a-z0-9]', '', 'g')"
_HARVEST = (
    "with fl as ("
    + " union all ".join(
        f"select c_custkey as document, {line} as line_no, {n} as n, '{kind}' as kind, {name} as name, '{role}' as role, {seq} as seq from customer"
        for line, n, kind, name, role, seq in [
            (1, 1, "person", _ONE, "Missing person", 0), (1, 1, "person", _ONE, "Named person", 1), (2, 1, "phone_number", f"'+91 98765 ' || right({_TEL}, 5)", "Number in record", 0), (3, 2, "person", _TWO, "Named person", 0),
            (3, 1, "person", _ONE, "Named person", 2), (3, 1, "organization", _WARD, "Organisation", 3), (4, 1, "vehicle", _CAR, "Vehicle in record", 0), (5, 1, "person", _THREE, "Named person", 0), (5, 1, "asset", _MAIL, "Online identifier", 1),
            (6, 1, "address", "'Harbour Road ' || cast(c_custkey % 50 as string)", "Address in record", 0),
        ]
    )
    + f"), fk as (select *, {_KEY} as key from fl), cd as (select document, key, kind, arg_min(name, (line_no, seq)) as name, arg_min(role, (line_no, seq)) as role, sum(n)::bigint as mentions from fk group by 1, 2, 3), "
    "pq as (select distinct document, line_no, key from fk), own as (select document, line_no, key, (select any_value(k.key) from fk k where k.document = fk.document and k.line_no = 1) as subject from fk where line_no in (2, 4)), "
    "pl as (select x.document, x.line_no, x.key as a, y.key as b from pq x join pq y on x.document = y.document and x.line_no = y.line_no and x.key < y.key union select document, line_no, least(key, subject), greatest(key, subject) from own), "
    "pr as (select document, a, b, count(*) as count from pl group by 1, 2, 3)"
)
_COMMIT = (
    _HARVEST + ", sz as (select document, count(*) as size from cd group by 1), kp as (select cd.* from cd join sz using (document) where not (kind = 'person' and mentions < 2 and role = 'Named person' and size > 6)), "
    f"ex as (select min(c_custkey) as id, {_KEY.replace('name', 'nm').replace('kind', chr(39) + 'person' + chr(39))} as key from (select c_custkey, {_ONE} as nm from customer where c_custkey % 3 = 0) group by 2)"
)


def _lines(t: Tables) -> DataFrame:
    """The lines of all case files. A customer's row is small and its lines take long to search, so customers are dealt to all tasks first, and a file stays in one."""
    dealt = t.customer.repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    return dealt.select(F.col("c_custkey").alias("document"), F.posexplode(F.array(*[F.expr(line) for line in _LINES])).alias("line_no", "line"))


def _existing(t: Tables) -> DataFrame:
    return t.customer.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.lit("person").alias("kind"), F.expr(_ONE).alias("name"))


@query("ex16_candidates", _HARVEST + " select document, key, kind, name, role, mentions from cd")
def _(t: Tables) -> DataFrame:
    """What each case file names: people by labels, titles and bare names, organisations, identifiers, addresses."""
    return h.candidates(h.found_in_lines(_lines(t))).drop("first_line")


@query("ex16_named_together", _HARVEST + " select document, a, b, count from pr")
def _(t: Tables) -> DataFrame:
    """Who and what stands in one line, and identifiers with the person whose block they stand in."""
    return h.named_together(h.found_in_lines(_lines(t)))


@query("ex17_committed_entities", _COMMIT + " select key, kind, arg_min(name, (document, name)) as name, any_value(ex.id) as id, case when any_value(ex.id) is null then 'CREATED' else 'MATCHED' end as status, sum(mentions)::bigint as mentions, count(*) as documents from kp left join ex using (key) group by 1, 2")
def _(t: Tables) -> DataFrame:
    """Entities that the case files add or match, without people who are named too weakly."""
    return h.committed(h.found_in_lines(_lines(t)), _existing(t))[0]


@query("ex17_committed_links", _COMMIT + " select a, b, sum(count)::bigint as count, max(least(95, 45 + 12 * count)) as strength from pr where (document, a) in (select (document, key) from kp) and (document, b) in (select (document, key) from kp) group by 1, 2")
def _(t: Tables) -> DataFrame:
    return h.committed(h.found_in_lines(_lines(t)), _existing(t))[1]


@query(
    "ex17_committed_events",
    f"with l as (select c_custkey as document, {_DAY} as d, 'Mr. ' || {_TWO} || ' met ' || {_ONE} || ' at ' || {_WARD} as title from customer) select min(document) as document, 3 as line_no, '2024-01-' || d || 'T10:15:00+05:30' as stamp, arg_min(title, document) as title from l group by d, lower(title)",
)
def _(t: Tables) -> DataFrame:
    """Dated lines as events, those of equal time and title once."""
    return h.dated_events(_lines(t))
