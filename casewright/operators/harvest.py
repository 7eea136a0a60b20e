"""What the lines of a case file name (people, organisations, identifiers, addresses), who is named together, and how that is committed to a case.

Lines are rows (document, line_no, line), so a file of any length is spread over tasks; only the block that a line belongs
to needs the order of a document. Names and labels are found by patterns on the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions import stamps
from casewright.functions import text as x
from casewright.storage import stored

# --- fixed values: labels, titles, endings and patterns that decide what is found ------------------------------------
ROLES = {
    "name": "Named person", "full name": "Named person", "missing person": "Missing person", "subject": "Subject", "suspect": "Person of interest", "accused": "Person of interest", "complainant": "Complainant",
    "informant": "Informant", "witness": "Witness", "victim": "Victim", "reported by": "Complainant", "reporting person": "Complainant", "father": "Family", "father name": "Family", "father's name": "Family",
    "mother": "Family", "mother's name": "Family", "guardian": "Family", "friend": "Associate", "classmate": "Associate", "last seen by": "Witness", "investigating officer": "Investigating officer",
    "io": "Investigating officer", "lead officer": "Investigating officer", "driver": "Person of interest", "owner": "Registered owner", "contact person": "Named person",
}
TITLES = "Mr|Mrs|Ms|Miss|Shri|Smt|Sri|Dr|Prof|Adv|Insp|Inspector|Sub-Inspector|PSI|API|ASI|Constable|Head Constable|HC|PI|SI|DCP|ACP|SP|DySP|Kum"
ORGANISATION_ENDINGS = [
    "School", "College", "University", "Vidyalaya", "Junior College", "Academy", "Institute", "Coaching", "Classes", "Hospital", "Clinic", "Nursing Home", "Police Station", "Chowky", "Bank", "Society", "Club",
    "Gymkhana", "Hotel", "Lodge", "Restaurant", "Cafe", "Café", "Mall", "Stores", "Store", "Shop", "Enterprises", "Traders", "Industries", "Logistics", "Transport", "Travels", "Pvt Ltd", "Ltd", "LLP", "Trust",
    "Foundation", "NGO", "Depot", "Terminus", "Godown", "Warehouse",
]
CONTACT_LABELS = ["contact", "phone", "mobile", "mobile no", "phone no", "number", "vehicle", "vehicle no", "email", "e-mail", "imei", "account no", "account", "a/c", "address", "school", "college", "employer"]
PLACE_LABELS = ["location", "place", "address", "last seen at", "last known location", "venue", "scene", "residence", "from", "to", "destination"]
LABEL = r"^([A-Za-z][A-Za-z'’\s./-]{1,28}?)\s*[:\-–]\s*(.+)$"
PHONE = r"(?:\+91[\s-]?)?\b[6-9]\d{4}[\s-]?\d{5}\b"
VEHICLE = r"\b(?:MH|DL|KA|GJ|TN|AP|TS|RJ|UP|MP|WB|KL|HR|PB|GA)[\s-]?\d{1,2}[\s-]?[A-Z]{1,3}[\s-]?\d{3,4}\b"
ACCOUNT = r"\b(?:A/C|Account(?:\s+No\.?)?|Acc\.?\s*No\.?)[:\s#]*([Xx*•\d]{6,20})\b"
IMEI = r"(?i)\bIMEI[:\s#]*(\d{14,16})\b"
EMAIL = r"\b[\w.+-]+@[\w-]+\.[\w.]{2,}\b"
# ----------------------------------------------------------------------------------------------------------------------
#: Words that no name of a person has, and words of places; both are parameters.
NOT_NAMES = "the this that case report police station date time page section act court india january february march april june july august september october november december monday tuesday wednesday thursday friday saturday sunday".split()
PLACE_WORDS = "road street lane nagar city town village market bridge chowk junction station colony park".split()
OWNABLE = ["phone_number", "vehicle", "bank_account", "asset", "address", "organization"]
UNNAMED = "Named person"
WEAK_BEYOND = 6


def _like_name(name: Column, not_names: list[str], place_words: list[str]) -> Column:
    words = F.split(name, " ")
    fits = F.forall(words, lambda w: w.rlike("^[A-Z][a-z'’-]+$") & (F.length(F.regexp_replace(w, "[^A-Za-z]", "")) >= 2) & ~F.lower(w).isin(*not_names, *place_words))
    return F.length(name).between(4, 48) & F.size(words).between(2, 4) & fits


def _plain(name: Column) -> Column:
    """A name without its title and the punctuation after it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(name), rf"(?i)^(?:{TITLES})\.?\s+", ""), "[.,;:]+$", ""))


def key_of(kind: Column, name: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.regexp_replace(F.lower(name), "[^a-z0-9]", ""))


def found_in_lines(lines: DataFrame, not_names: list[str] = NOT_NAMES, place_words: list[str] = PLACE_WORDS) -> DataFrame:
    """``lines`` (document, line_no, line) with ``label`` (lower case, null without one) and ``found``: (key, kind, name, role) in the order found, one for each time.

    Null and blank lines find nothing. A name of Latin letters only has a key; others keep an empty one of their kind.
    """
    line = F.trim(F.regexp_replace(F.coalesce("line", F.lit("")), r"\s+", " "))
    df = lines.select("document", "line_no", line.alias("line"))
    label = F.nullif(F.regexp_replace(F.lower(F.trim(F.regexp_extract("line", LABEL, 1))), r"\.$", ""), F.lit(""))
    df = df.withColumn("label", label).withColumn("value", F.trim(F.regexp_extract("line", LABEL, 2)))
    like = lambda n: _like_name(n, not_names, place_words)
    every = lambda pattern, group=0: F.regexp_extract_all("line", F.lit(pattern), group)
    some = lambda kind, role: lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name"), F.lit(role).alias("role"))
    own = _plain(F.get(F.split("value", "[,(]"), 0))
    role = F.create_map(*[F.lit(v) for pair in ROLES.items() for v in pair])
    nothing = F.array().cast("array<struct<kind:string,name:string,role:string>>")
    labelled = F.when(F.col("label").isin(*ROLES) & like(own), F.array(F.struct(F.lit("person").alias("kind"), own.alias("name"), F.element_at(role, F.col("label")).alias("role"))))
    titled = F.filter(F.transform(every(rf"\b(?:{TITLES})\.?\s+([A-Z][a-z'’-]+(?:\s+[A-Z][a-z'’-]+){{0,2}})", 1), _plain), lambda n: like(n) | n.rlike(r"^[A-Z][a-z]+\s+[A-Z][a-z]+"))
    ending = "|".join(ORGANISATION_ENDINGS)
    bare = F.filter(every(r"\b([A-Z][a-z'’-]{2,}(?:\s+[A-Z][a-z'’-]{2,}){1,2})\b", 1), lambda n: like(n) & ~n.rlike(f"(?:{ending})$"))
    # a name that is kept has a blank before its ending; few lines hold that, so each ending's pattern is tried only on lines in which it stands
    none = F.array().cast("array<string>")
    ended = lambda e: F.when(F.contains("line", F.lit(f" {e}")), every(rf"\b((?:[A-Z][A-Za-z'’.&-]*\s+){{0,3}}{e})\b", 1)).otherwise(none)
    named = F.when(F.col("line").rlike(f" (?:{ending})"), F.flatten(F.array(*[ended(e) for e in ORGANISATION_ENDINGS]))).otherwise(none)
    named = F.filter(named, lambda n: F.contains(n, F.lit(" ")) & ~F.lower(n).isin(*[e.lower() for e in ORGANISATION_ENDINGS]))
    phone = F.transform(every(PHONE), lambda n: F.concat_ws(" ", F.lit("+91"), F.left(x.phone(n), F.lit(5)), F.right(x.phone(n), F.lit(5))))
    address = F.when(F.col("label").isin(*PLACE_LABELS) & (F.length("value") > 3), F.array(some("address", "Address in record")(F.left("value", F.lit(80)))))
    found = F.concat(
        F.coalesce(labelled, nothing), F.transform(titled, some("person", UNNAMED)), F.transform(bare, some("person", UNNAMED)), F.transform(named, some("organization", "Organisation")),
        F.transform(phone, some("phone_number", "Number in record")), F.transform(F.transform(every(VEHICLE), x.vehicle), some("vehicle", "Vehicle in record")),
        F.transform(F.transform(every(ACCOUNT, 1), lambda n: F.concat(F.lit("A/C "), n)), some("bank_account", "Account in record")), F.transform(F.transform(every(IMEI, 1), lambda n: F.concat(F.lit("IMEI "), n)), some("asset", "Device identifier")),
        F.transform(F.transform(every(EMAIL), F.lower), some("asset", "Online identifier")), F.coalesce(address, nothing),
    )
    keyed = F.transform(found, lambda f: F.struct(key_of(f["kind"], f["name"]).alias("key"), f["kind"].alias("kind"), f["name"].alias("name"), f["role"].alias("role")))
    return df.select("document", "line_no", "line", "label", keyed.alias("found"))


def candidates(found: DataFrame) -> DataFrame:
    """(document, key, kind, name, role, mentions, first_line): each thing a document names, as at its first place. A person whose name begins the name of an organisation of the document is none."""
    # with posexplode Spark would ask for found's size before, and search the line once more for it
    each = found.select("document", "line_no", "line", F.posexplode_outer("found").alias("seq", "f")).filter("seq is not null").select("document", "line_no", "line", "seq", "f.*")
    first = F.min(F.struct("line_no", "seq", "name", "role", "line")).alias("first")
    all_ = each.groupBy("document", "key", "kind").agg(first, F.count("*").alias("mentions"))
    all_ = stored(all_.select("document", "key", "kind", F.col("first.name").alias("name"), F.col("first.role").alias("role"), "mentions", F.col("first.line").alias("first_line")), "candidates")
    words = F.split(F.lower("name"), " ")
    beginnings = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda n: F.array_join(F.slice(words, 1, n), " "))
    taken = all_.filter((F.col("kind") == "organization") & (F.size(words) > 1)).select("document", F.explode(beginnings).alias("begin")).distinct()
    person = all_.withColumn("begin", F.when(F.col("kind") == "person", F.lower("name")))
    return person.join(taken, ["document", "begin"], "left_anti").drop("begin")


def named_together(found: DataFrame) -> DataFrame:
    """(document, a, b, count): keys of one line, and the identifiers of a labelled line with the person its block is about: the last one named since the last heading.

    ``count`` is the number of lines, a < b. All pairs of a line are the result asked for; a line is short by nature.
    """
    keys = F.array_distinct(F.col("found.key"))
    people = F.filter("found", lambda f: f["kind"] == "person")
    df = found.select(
        "document", "line_no", F.sort_array(keys).alias("keys"), F.get(F.reverse(F.array_distinct(people["key"])), 0).alias("person"),
        F.when(F.col("label").isin(*CONTACT_LABELS), F.array_distinct(F.filter("found", lambda f: f["kind"].isin(*OWNABLE))["key"])).alias("owned"), F.col("line").rlike(r"^[A-Z0-9][A-Z0-9 ,.'’—–&-]{4,}$").cast("int").alias("heading"),
    )
    order = Window.partitionBy("document").orderBy("line_no")
    df = df.withColumn("block", F.sum("heading").over(order))
    before = Window.partitionBy("document", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("subject", F.last("person", ignorenulls=True).over(before))
    inside = F.flatten(F.transform("keys", lambda a, i: F.transform(F.slice("keys", i + 2, F.size("keys")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    owner = F.when(F.col("person").isNull() & F.col("subject").isNotNull(), F.transform("owned", lambda k: F.struct(F.least(k, "subject").alias("a"), F.greatest(k, "subject").alias("b"))))
    pairs = F.array_distinct(F.concat(inside, F.coalesce(owner, F.array().cast("array<struct<a:string,b:string>>"))))
    return df.select("document", F.explode_outer(pairs).alias("p")).filter("p is not null").groupBy("document", "p.a", "p.b").agg(F.count("*").alias("count"))


def dated_events(lines: DataFrame) -> DataFrame:
    """(document, line_no, stamp, title): lines that begin with a date and say something, once for each time and title (case and blanks don't count), the first document and line of equal ones."""
    at = lines.select("document", "line_no", stamps.leading_stamp(F.col("line")).alias("f")).select("document", "line_no", "f.stamp", "f.rest").filter(F.length("rest") >= 4)
    at = at.withColumn("title", F.left("rest", F.lit(110))).withColumn("key", x.normalize_name(F.col("title")))
    first = at.groupBy("stamp", "key").agg(F.min(F.struct("document", "line_no", "title")).alias("first"))
    return first.select("first.document", "first.line_no", "stamp", "first.title")


def committed(found: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (key, kind, name, id, status, mentions, documents) and links (a, b, count, strength) that documents add to a case with ``existing`` (id, kind, name).

    A person who is named once, without a label, in a document of more than six candidates is too weak and left out, with
    its links. A candidate is the existing entity of its key (the smallest id), else CREATED. A link is as strong as in the
    document that has it most often, 45 and 12 for each line, 95 at most; counts add up.
    """
    c = candidates(found)
    size = c.groupBy("document").agg(F.count("*").alias("size"))
    weak = (F.col("kind") == "person") & (F.col("mentions") < 2) & (F.col("role") == UNNAMED) & (F.col("size") > WEAK_BEYOND)
    kept = c.join(size, "document").filter(~weak)
    known = existing.groupBy(key_of(F.col("kind"), F.col("name")).alias("key")).agg(F.min("id").alias("id"))
    entities = kept.groupBy("key", "kind").agg(F.min(F.struct("document", "name"))["name"].alias("name"), F.sum("mentions").alias("mentions"), F.count("*").alias("documents"))
    entities = entities.join(known, "key", "left").select("key", "kind", "name", "id", F.when(F.col("id").isNull(), "CREATED").otherwise("MATCHED").alias("status"), "mentions", "documents")
    ends = kept.select("document", "key")
    pairs = named_together(found)
    pairs = pairs.join(ends.withColumnRenamed("key", "a"), ["document", "a"], "left_semi").join(ends.withColumnRenamed("key", "b"), ["document", "b"], "left_semi")
    links = pairs.groupBy("a", "b").agg(F.sum("count").alias("count"), F.max(F.least(F.lit(95), 45 + 12 * F.col("count"))).alias("strength"))
    return entities, links
