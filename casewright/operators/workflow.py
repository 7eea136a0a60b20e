"""Work on tables that change: queues, candidates that are accepted, extractions that are kept, snapshots and run records."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions.text import normalize_name
from casewright.operators.sequences import ranked
from casewright.sources.tables import ChangingTable

JOBS = "id long, document_id long, status string, attempts int, worker string, error string"
CANDIDATES = "id long, document_id long, case_id long, entity_type string, name string, place string, confidence double, status string, entity_id long"
ENTITIES = "id long, case_id long, entity_type string, key string, name string"
EVIDENCE = "reference string, case_id long, document_id long, description string, confidence double"
SNAPSHOTS = "case_id long, sequence long, section string, id long, payload string"
RUNS = "case_id long, run long, version string, findings long, supersedes long"
#: Jobs of a claim.
BATCH = 5


def claim(jobs: ChangingTable, worker: str, most: int = BATCH) -> DataFrame:
    """Takes the first ``most`` queued jobs for ``worker``, and gives them. Of two workers at once each job goes to one: the second sees the first one's claim and takes others."""
    batch = f"claim-{worker}-{uuid.uuid4().hex}"

    def take(rows: DataFrame) -> DataFrame:
        first = rows.filter("status = 'QUEUED'").orderBy("id").limit(most)
        return first.withColumns({"status": F.lit("PROCESSING"), "attempts": F.col("attempts") + 1, "worker": F.lit(worker), "error": F.lit(None).cast("string")})

    number = jobs.change(take, batch)
    folder = next(v["folder"] for v in jobs.history() if v["number"] == number)
    return jobs.spark.read.schema(jobs.types).parquet(f"{jobs.path}/{folder}")


def settle(jobs: ChangingTable, claimed: DataFrame, error: Column, batch: str) -> int:
    """Ends claimed jobs: DONE, or FAILED where ``error`` says why; only those that are still their worker's, so a worker that was given up changes nothing."""
    ended = claimed.select("id", F.col("worker").alias("_by"), F.col("attempts").alias("_try"), error.alias("_error"))

    def end(rows: DataFrame) -> DataFrame:
        mine = rows.join(ended, "id").filter((F.col("status") == "PROCESSING") & (F.col("worker") == F.col("_by")) & (F.col("attempts") == F.col("_try")))
        return mine.withColumns({"status": F.when(F.col("_error").isNull(), "DONE").otherwise("FAILED"), "error": F.col("_error")})

    return jobs.change(end, batch)


def requeue(jobs: ChangingTable, stuck: Column, batch: str) -> int:
    """Jobs for which ``stuck`` is true are queued again; their attempts stay."""
    return jobs.change(lambda rows: rows.filter(stuck).withColumns({"status": F.lit("QUEUED"), "worker": F.lit(None).cast("string")}), batch)


def persist_extraction(candidates: ChangingTable, found: DataFrame, batch: str) -> int:
    """Adds found candidates (document_id, case_id, entity_type, name, place, confidence), each once for its document, type, name and place, with the next ids.

    A batch that was persisted writes nothing; another batch that finds the same adds nothing.
    """
    natural = ["document_id", "entity_type", "name", "place"]

    def add(rows: DataFrame) -> DataFrame:
        best = found.groupBy(*natural).agg(F.min("case_id").alias("case_id"), F.max("confidence").alias("confidence"))
        fresh = best.join(rows.select(*natural), [best[c].eqNullSafe(rows[c]) for c in natural], "left_anti")
        last = rows.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))  # one row
        placed = ranked(fresh, [F.asc(c) for c in natural], "_place").join(F.broadcast(last))
        return placed.withColumns({"id": F.col("_last") + F.col("_place"), "status": F.lit("PENDING"), "entity_id": F.lit(None).cast("long")})

    return candidates.change(add, batch)


def accept(candidates: ChangingTable, entities: ChangingTable, evidence: ChangingTable, chosen: DataFrame, batch: str) -> None:
    """Accepts the pending candidates in ``chosen`` (id): each gets the entity of its case, type and name, a new one where there is none, and a row of evidence.

    Three versions of one batch, in an order in which each step finds what the one before has put: run again after a
    failure, it goes on where it stopped, and run twice it changes nothing. Candidates that are not pending are left alone.
    """
    same = ["case_id", "entity_type", "key"]
    if entities._of(batch) is None or evidence._of(batch) is None or candidates._of(batch) is None:
        of_batch = chosen.select("id").distinct()
        pending = lambda: candidates.read().filter("status = 'PENDING'").join(of_batch, "id", "left_semi").withColumn("key", normalize_name(F.col("name")))

        def confirm(rows: DataFrame) -> DataFrame:
            names = pending().groupBy(*same).agg(F.min(F.struct("id", "name")).alias("first"))
            fresh = names.join(rows.select(*same), same, "left_anti")
            last = rows.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))  # one row
            return ranked(fresh, [F.asc("first.id")], "_place").join(F.broadcast(last)).select((F.col("_last") + F.col("_place")).alias("id"), *same, F.col("first.name").alias("name"))

        entities.change(confirm, batch)
        said = F.concat(F.col("name"), F.lit(" ("), F.col("entity_type"), F.lit(")"))
        proof = lambda rows: pending().select(F.concat(F.lit("candidate:"), F.col("id").cast("string")).alias("reference"), "case_id", "document_id", said.alias("description"), "confidence")
        evidence.change(proof, batch)
        known = entities.read().select(F.col("id").alias("_entity"), *same)
        candidates.change(lambda rows: pending().drop("entity_id").join(known, same).withColumns({"entity_id": F.col("_entity"), "status": F.lit("ACCEPTED")}), batch)


def process(jobs: ChangingTable, candidates: ChangingTable, worker: str, documents: DataFrame, key: str, text: str, extract: Callable[[DataFrame], DataFrame], most: int = BATCH) -> DataFrame:
    """Claims jobs, keeps what ``extract`` finds in their documents and ends them; gives the claimed jobs. Documents without a text fail.

    The candidates are kept before the jobs end. A worker that dies in between leaves its jobs in PROCESSING; they are
    queued again (``requeue``), and what the second run finds is there already.
    """
    claimed = claim(jobs, worker, most)
    mine = documents.join(claimed.select(F.col("document_id").alias(key)), key, "left_semi")
    batch = uuid.uuid4().hex
    persist_extraction(candidates, extract(mine.filter(F.trim(text) != "")), f"extract-{batch}")
    read = mine.filter(F.trim(text) != "").select(F.col(key).alias("document_id"), F.lit(True).alias("_read"))
    ended = claimed.join(read, "document_id", "left")
    settle(jobs, ended, F.when(F.col("_read").isNull(), "no text"), f"settle-{batch}")
    return claimed


def clear(table: ChangingTable, batch: str) -> int:
    """Takes all rows out of a table; earlier versions stay readable."""
    return table.put(table.read().limit(0), batch, kind="base")


def snapshot(snapshots: ChangingTable, sections: dict[str, DataFrame], cases: DataFrame, batch: str) -> int:
    """Keeps the rows (case_id, id and others) of each section, for each of ``cases`` (case_id), under the next number of the case. A snapshot is never changed."""

    def add(rows: DataFrame) -> DataFrame:
        last = rows.groupBy("case_id").agg(F.max("sequence").alias("_last"))
        number = cases.select("case_id").distinct().join(last, "case_id", "left").select("case_id", (F.coalesce("_last", F.lit(0)) + 1).alias("sequence"))
        out = None
        for name, df in sections.items():
            part = df.join(number, "case_id").select("case_id", "sequence", F.lit(name).alias("section"), F.col("id").cast("long").alias("id"), F.to_json(F.struct(*sorted(df.columns))).alias("payload"))
            out = part if out is None else out.unionByName(part)
        return out

    return snapshots.change(add, batch)


def record_run(runs: ChangingTable, measured: DataFrame, batch: str) -> int:
    """Adds a run record (case_id, version, findings) for each case with the next number; it supersedes the case's last run, unless the version is still the same, then there is no new one."""

    def add(rows: DataFrame) -> DataFrame:
        last = rows.groupBy("case_id").agg(F.max(F.struct("run", "version")).alias("_last"))
        new = measured.select("case_id", "version", F.col("findings").cast("long").alias("findings")).join(last, "case_id", "left").filter(~F.col("version").eqNullSafe(F.col("_last.version")))
        return new.select("case_id", (F.coalesce("_last.run", F.lit(0)) + 1).alias("run"), "version", "findings", F.col("_last.run").alias("supersedes"))

    return runs.change(add, batch)
