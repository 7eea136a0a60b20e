"""The test tables read as evidence: each stand-in as a DataFrame, and as SQL for the oracle.

Payments are line items (customer to supplier), calls are neighbouring events of a kind, people are customers, cases
are groups of entities, places are nations with coordinates made from their keys.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewright.functions.measures import micros
from casewright.storage import stored

_BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_LETTERS = "'0123456789', 'aeioukmnrt'"


def person_name(key: str) -> str:
    """SQL of a two-word name made of a key's digits: 5 x 20 first names, 7 last ones."""
    return f"'P' || translate(lpad(cast({key} % 100 as string), 3, '0'), {_LETTERS}) || ' S' || translate(lpad(cast({key} % 7 as string), 3, '0'), {_LETTERS})"


#: Last names of the stand-in people, as a lexicon.
LAST_NAMES = ["s" + "".join("aeioukmnrt"[int(d)] for d in f"{k:03d}") for k in range(7)]
_A, _B, _TEL = person_name("c_custkey"), person_name("(c_custkey * 7 + 3)"), "'9' || lpad(cast(c_custkey as string), 9, '0')"
_SAYINGS = [
    f"{_A} || ' acted on instructions of ' || {_B} || ', near the gate.'", f"{_A} || ' is reportedly working under ' || {_B} || '.'", f"{_A} || ' said it was handed over to him by ' || {_B} || ' at night.'",
    f"{_A} || ' was procuring the material from ' || {_B} || ', daily.'", f"'Police suspect involvement of ' || {_B} || ' in a case with ' || {_A} || '.'",
    f"'The director of Acme Traders is recorded as ' || {_B} || ', says ' || {_A} || '. FIR 12/2024'", f"{_A} || ' controls collection in the market after dark, IMEI ' || lpad(cast(c_custkey as string), 15, '1')",
    f"{_A} || ' (mob. ' || {_TEL} || ') was seen with ' || {_B}", f"'SIM issued to ' || {_A} || ' at mobile ' || {_TEL} || ' on 01/02/2024'", f"'Contact number of accused ' || {_A} || ' is ' || {_TEL}",
    f"{_A} || ' was heard. Mobile number ' || {_TEL} || ' was used to make threatening calls'", f"{_A} || ' called ' || {_B} || ' from the known number ' || {_TEL}",
    f"'Vehicle MH12AB' || cast(1000 + c_custkey % 9000 as string) || ' is owned by ' || {_A} || ', says ' || {_B}", f"{_A} || ' arrived in a vehicle MH12AB' || cast(1000 + c_custkey % 9000 as string) || ' at Harbour Road'",
    f"'Amount Rs 25,000 transferred from ACABC' || cast(1000 + c_custkey % 9000 as string) || ' to ACXYZ5678 by ' || {_A} || ' near Harbour Road'",
    f"'पकस तलम के कहने पर ' || {_A} || ' गया (विकरम सठ).'",
]
#: SQL of a case note for each customer, in words that both engines read; each kind of sentence once in sixteen.
NOTE = "case c_custkey % 16 " + " ".join(f"when {k} then {v}" for k, v in enumerate(_SAYINGS)) + " end"

_FIRST, _LAST = "cast(floor(c_custkey / 7) as bigint) % 10", "c_custkey % 7"
_part = lambda words, at: f"split_part('{words}', ',', cast(1 + {at} as int))"
_F, _L = _part("Vikram,Rajesh,Devendra,Farid,Mohan,Lalit,Nikhil,Tarun,Gopal,Harish", _FIRST), _part("Sethi,Kumar,Patil,Bhosale,Qureshi,Jadhav,Chauhan", _LAST)
_FD, _LD = _part("विक्रम,राजेश,देवेन्द्र,फरीद,मोहन,ललित,निखिल,तरुन,गोपाल,हरीश", _FIRST), _part("सेठी,कुमार,पाटिल,भोसले,क़ुरेशी,जाधव,चौहान", _LAST)
#: How an observed name is written: as it is, turned round, with an initial, with a middle initial, in Devanagari.
OBSERVED_FORM = "cast(floor(c_custkey / 11) as bigint) % 5"
OBSERVED_NAME = f"case {OBSERVED_FORM} when 0 then {_F} || ' ' || {_L} when 1 then {_L} || ' ' || {_F} when 2 then substr({_F}, 1, 1) || '. ' || {_L} when 3 then {_F} || ' Z. ' || {_L} else {_FD} || ' ' || {_LD} end"
OBSERVED_TEL = "case when c_custkey % 90 = 0 then 'tel' || cast(c_custkey % 720 as string) end"

VIEWS: dict[str, str] = {
    "observed": f"select c_custkey as obs, {OBSERVED_NAME} as name, {OBSERVED_TEL} as ident, c_custkey % 50 as record, {_FIRST} as f, {_LAST} as l, {OBSERVED_FORM} as form from customer",
    "note": f"select c_custkey as note_id, {NOTE} as text from customer",
    "pay": """select l_orderkey * 10 + l_linenumber as txn_id, o_custkey as src, l_suppkey as dst, c_nationkey as src_nation, s_nationkey as dst_nation,
  l_extendedprice * (1 - l_discount) as amount, l_extendedprice as gross, l_returnflag as mode, l_shipdate as ts
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey""",
    "flow": """select src, dst, amount, n from (
  select *, row_number() over (partition by src order by amount desc, dst) as place from (
    select src_nation as src, dst_nation as dst, round(sum(amount), 2) as amount, count(*) as n from pay where src_nation <> dst_nation group by 1, 2)) where place <= 3""",
    "link": """select least(src, dst) as a, greatest(src, dst) as b, sum(1 + least(amount / 5e6, 3)) as weight, sum(n) as n, sum(amount) as amount from flow group by 1, 2""",
    "ev": """select event_id, ts, epoch_us(ts) as us, user_id, event_type, value, cast(regexp_extract(props, '[0-9]+', 0) as int) as k, user_id % 10 as case_id from events""",
    "call": """select event_id as call_id, user_id as caller, lead(user_id) over (partition by event_type order by us, event_id) as callee, us, ts, event_type as tower, value as secs, k as imei from ev""",
    "person": """select c_custkey as id, c_name as name, c_nationkey as nation, c_mktsegment as segment,
  case when c_acctbal >= 0 then coalesce(prior, 0) end as prior_cases
  from customer left join (select o_custkey, count(*) as prior from orders where o_orderstatus = 'F' group by 1) on o_custkey = c_custkey""",
    "entity": """select c_custkey as id, c_custkey % 5 as case_id, case c_custkey % 3 when 0 then 'PERSON' when 1 then 'ORGANIZATION' else 'VEHICLE' end as entity_type,
  c_mktsegment || ' ' || cast(c_nationkey as varchar) || ' ' || cast(c_custkey % 8 as varchar) as name from customer""",
    "relation": """select id, case_id, src, dst, kind, confidence, candidate_id from (
  select o_orderkey as id, o_custkey % 5 as case_id, o_custkey as src, o_custkey - o_custkey % 80 + (o_custkey % 5 + 5 * ((o_custkey * 3 + o_orderkey) % 16)) as dst,
    case o_orderkey % 4 when 0 then 'CALLED' when 1 then 'OWNS' when 2 then 'USED' else 'ASSOCIATE_OF' end as kind,
    case when o_orderkey % 10 <> 0 then (o_orderkey % 100) / 100.0 end as confidence, case when o_orderpriority < '4' then o_orderkey end as candidate_id
  from orders where o_orderstatus = 'F') where dst in (select c_custkey from customer)""",
    "evidence": """select o_orderkey * 10 as id, o_custkey % 5 as case_id, case when o_orderkey % 3 = 0 then o_orderkey end as document_id, 'candidate:' || cast(o_orderkey as varchar) as source_reference,
  case o_orderkey % 3 when 0 then 'DOCUMENT' when 1 then 'CALL_RECORD' else 'SURVEILLANCE' end as evidence_type from orders where o_orderstatus <> 'P'""",
    "web": "select a, b, n::double as weight from pair",
    "place": """select n_nationkey as id, n_regionkey as case_id, n_name as name, -60.0 + 5 * n_nationkey as lat, case when n_nationkey % 7 <> 6 then -180.0 + 14 * n_nationkey end as lon from nation""",
    "pair": """select least(src, dst) as a, greatest(src, dst) as b, count(*) as n, max(confidence) as confidence, count(distinct kind) as kinds, min(id) as first_id from relation where src <> dst group by 1, 2""",
}


class Tables:
    """Test tables and stand-ins of one folder, each built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in _BASE:
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        self.__dict__[name] = df
        return df

    @cached_property
    def pay(self) -> DataFrame:
        lines = self.lineitem.join(self.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(self.customer, F.col("o_custkey") == F.col("c_custkey"))
        return lines.join(self.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("txn_id"), F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"),
            F.col("c_nationkey").alias("src_nation"), F.col("s_nationkey").alias("dst_nation"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"),
            F.col("l_extendedprice").alias("gross"), F.col("l_returnflag").alias("mode"), F.col("l_shipdate").alias("ts"),
        )

    @cached_property
    def flow(self) -> DataFrame:
        total = self.pay.filter("src_nation != dst_nation").groupBy(F.col("src_nation").alias("src"), F.col("dst_nation").alias("dst")).agg(F.round(F.sum("amount"), 2).alias("amount"), F.count("*").alias("n"))
        return total.withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("amount"), "dst"))).filter("place <= 3").drop("place")

    @cached_property
    def link(self) -> DataFrame:
        return self.flow.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(
            F.sum(1 + F.least(F.col("amount") / 5e6, F.lit(3.0))).alias("weight"), F.sum("n").alias("n"), F.sum("amount").alias("amount")
        )

    @cached_property
    def ev(self) -> DataFrame:
        return self.events.select(
            "event_id", "ts", micros(F.col("ts")).alias("us"), "user_id", "event_type", "value", F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("k"), (F.col("user_id") % 10).alias("case_id")
        )

    @cached_property
    def call(self) -> DataFrame:
        """Events are dealt by ranges of type and time; the last one of a type in a range is followed by the first one in a later range (a row for each type and range)."""
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = stored(self.ev.repartitionByRange(parts, "event_type", "us", "event_id").withColumn("part", F.spark_partition_id()), "calls")
        first = dealt.groupBy("event_type", "part").agg(F.min_by("user_id", F.struct("us", "event_id")).alias("first"))
        beyond = first.select("event_type", "part", F.struct(F.lead("first").over(Window.partitionBy("event_type").orderBy("part")).alias("user")).alias("beyond"))
        inside = F.lead(F.struct(F.col("user_id").alias("user"))).over(Window.partitionBy("part", "event_type").orderBy("us", "event_id"))
        called = dealt.withColumn("next", inside).join(F.broadcast(beyond), ["event_type", "part"])
        return called.select(
            F.col("event_id").alias("call_id"), F.col("user_id").alias("caller"), F.coalesce("next", "beyond")["user"].alias("callee"), "us", "ts", F.col("event_type").alias("tower"), F.col("value").alias("secs"), F.col("k").alias("imei")
        )

    @cached_property
    def person(self) -> DataFrame:
        prior = self.orders.filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("prior"))
        return self.customer.join(prior, F.col("o_custkey") == F.col("c_custkey"), "left").select(
            F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"),
            F.when(F.col("c_acctbal") >= 0, F.coalesce("prior", F.lit(0))).alias("prior_cases"),
        )

    @cached_property
    def entity(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.customer.select(
            key.alias("id"), (key % 5).alias("case_id"), F.when(key % 3 == 0, "PERSON").when(key % 3 == 1, "ORGANIZATION").otherwise("VEHICLE").alias("entity_type"),
            F.concat_ws(" ", "c_mktsegment", F.col("c_nationkey").cast("string"), (key % 8).cast("string")).alias("name"),
        )

    @cached_property
    def relation(self) -> DataFrame:
        key, cust = F.col("o_orderkey"), F.col("o_custkey")
        made = self.orders.filter("o_orderstatus = 'F'").select(
            key.alias("id"), (cust % 5).alias("case_id"), cust.alias("src"), (cust - cust % 80 + (cust % 5 + 5 * ((cust * 3 + key) % 16))).alias("dst"),
            F.when(key % 4 == 0, "CALLED").when(key % 4 == 1, "OWNS").when(key % 4 == 2, "USED").otherwise("ASSOCIATE_OF").alias("kind"),
            F.when(key % 10 != 0, (key % 100) / 100.0).alias("confidence"), F.when(F.col("o_orderpriority") < "4", key).alias("candidate_id"),
        )
        return made.join(self.customer.select(F.col("c_custkey").alias("dst")), "dst", "left_semi").select("id", "case_id", "src", "dst", "kind", "confidence", "candidate_id")

    @cached_property
    def evidence(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self.orders.filter("o_orderstatus != 'P'").select(
            (key * 10).alias("id"), (F.col("o_custkey") % 5).alias("case_id"), F.when(key % 3 == 0, key).alias("document_id"), F.concat(F.lit("candidate:"), key.cast("string")).alias("source_reference"),
            F.when(key % 3 == 0, "DOCUMENT").when(key % 3 == 1, "CALL_RECORD").otherwise("SURVEILLANCE").alias("evidence_type"),
        )

    @cached_property
    def observed(self) -> DataFrame:
        return self.customer.select(F.col("c_custkey").alias("obs"), F.expr(OBSERVED_NAME).alias("name"), F.expr(OBSERVED_TEL).alias("ident"), (F.col("c_custkey") % 50).alias("record"))

    @cached_property
    def note(self) -> DataFrame:
        return self.customer.select(F.col("c_custkey").alias("note_id"), F.expr(NOTE).alias("text"))

    @cached_property
    def web(self) -> DataFrame:
        return self.pair.select("a", "b", F.col("n").cast("double").alias("weight"))

    @cached_property
    def place(self) -> DataFrame:
        key = F.col("n_nationkey")
        return self.nation.select(
            key.alias("id"), F.col("n_regionkey").alias("case_id"), F.col("n_name").alias("name"), (-60.0 + 5 * key).alias("lat"), F.when(key % 7 != 6, -180.0 + 14 * key).alias("lon")
        )

    @cached_property
    def pair(self) -> DataFrame:
        return self.relation.filter("src != dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(
            F.count("*").alias("n"), F.max("confidence").alias("confidence"), F.countDistinct("kind").alias("kinds"), F.min("id").alias("first_id")
        )
