"""Tables that change: one winner for each version, batches that are run twice, and the work that is done on them."""

import json
import re
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from casewright.operators import workflow as wf
from casewright.sources import adapters
from casewright.sources.tables import ChangingTable, Conflict


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_versions_keys_and_compaction(spark, tmp_path):
    t = ChangingTable(spark, f"{tmp_path}/t", "id long, name string", ["id"])
    assert t.version() == 0 and t.read().count() == 0
    put = lambda data, batch, expected=None: t.put(spark.createDataFrame(data, "id long, name string"), batch, expected)
    assert put([(1, "a"), (2, "b")], "one") == 1
    assert put([(2, "c"), (3, None)], "two") == 2
    assert put([(9, "x")], "one") == 1  # a batch that was put
    assert rows(t.read()) == [(1, "a"), (2, "c"), (3, None)] and rows(t.read(1)) == [(1, "a"), (2, "b")]
    with pytest.raises(Conflict):
        put([(4, "d")], "three", 1)
    assert t.compact() == 3 and rows(t.read()) == [(1, "a"), (2, "c"), (3, None)] and len(list(tmp_path.glob("t/data-*"))) == 3
    other = ChangingTable(spark, f"{tmp_path}/t", "id long, name string", ["id"])
    assert other.version() == 3
    won = [x._commit(4, json.dumps({"batch": str(k), "kind": "put", "folder": "none"})) for k, x in enumerate((t, other))]
    assert won == [True, False]


def queue(spark, path, n):
    jobs = ChangingTable(spark, path, wf.JOBS, ["id"])
    jobs.put(spark.range(n).select("id", (F.col("id") * 10).alias("document_id"), F.lit("QUEUED").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("worker"), F.lit(None).cast("string").alias("error")), "fill")
    return jobs


def test_two_claimers_at_once_share_no_job(spark, tmp_path):
    queue(spark, f"{tmp_path}/jobs", 23)
    got, start = {}, threading.Barrier(3)

    def work(name):
        mine = ChangingTable(spark, f"{tmp_path}/jobs", wf.JOBS, ["id"])
        start.wait()
        got[name] = [[r.id for r in wf.claim(mine, name).collect()] for _ in range(2)]

    threads = [threading.Thread(target=work, args=(f"w{k}",)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    taken = [i for lots in got.values() for lot in lots for i in lot]
    assert sorted(taken) == list(range(23))
    jobs = ChangingTable(spark, f"{tmp_path}/jobs", wf.JOBS, ["id"])
    assert {r.worker: r.n for r in jobs.read().groupBy("worker").agg(F.count("*").alias("n")).collect()} == {k: sum(map(len, v)) for k, v in got.items()}
    assert wf.claim(jobs, "late").count() == 0


def test_jobs_end_once_and_by_their_worker(spark, tmp_path):
    jobs = queue(spark, f"{tmp_path}/jobs", 4)
    a = wf.claim(jobs, "a", 2)
    wf.requeue(jobs, (F.col("status") == "PROCESSING") & (F.col("id") == 1), "stuck")
    b = wf.claim(jobs, "b", 2)
    assert [r.id for r in b.orderBy("id").collect()] == [1, 2]
    wf.settle(jobs, a, F.when(F.col("id") == 0, "bad file"), "end-a")
    wf.settle(jobs, b, F.lit(None).cast("string"), "end-b")
    wf.settle(jobs, b, F.lit("again"), "end-b")
    assert rows(jobs.read().select("id", "status", "attempts", "worker", "error")) == [(0, "FAILED", 1, "a", "bad file"), (1, "DONE", 2, "b", None), (2, "DONE", 1, "b", None), (3, "QUEUED", 0, None, None)]


def test_persist_accept_and_snapshot_survive_a_repeated_batch(spark, tmp_path):
    tables = {n: ChangingTable(spark, f"{tmp_path}/{n}", s, k) for n, s, k in (("c", wf.CANDIDATES, ["id"]), ("e", wf.ENTITIES, ["id"]), ("v", wf.EVIDENCE, ["reference"]), ("s", wf.SNAPSHOTS, ["case_id", "sequence", "section", "id"]), ("r", wf.RUNS, ["case_id", "run"]))}
    found = spark.createDataFrame([(1, 7, "person", "Asha  Patil", "line 1", 0.9), (1, 7, "person", "Asha  Patil", "line 1", 0.7), (1, 7, "person", "asha patil", None, 0.8), (2, 8, "location", "Dadar", "line 2", 0.6)], "document_id long, case_id long, entity_type string, name string, place string, confidence double")
    for batch in ("x1", "x1", "x2"):  # again, and another run that finds the same
        wf.persist_extraction(tables["c"], found, batch)
    assert rows(tables["c"].read().select("id", "name", "place", "confidence", "status")) == [(1, "Asha  Patil", "line 1", 0.9, "PENDING"), (2, "asha patil", None, 0.8, "PENDING"), (3, "Dadar", "line 2", 0.6, "PENDING")]
    for batch in ("a1", "a1", "a2"):
        wf.accept(tables["c"], tables["e"], tables["v"], spark.createDataFrame([(1,), (2,), (99,)], "id long"), batch)
    assert rows(tables["e"].read()) == [(1, 7, "person", "asha patil", "Asha  Patil")]
    assert rows(tables["c"].read().select("id", "status", "entity_id")) == [(1, "ACCEPTED", 1), (2, "ACCEPTED", 1), (3, "PENDING", None)]
    assert [r[0] for r in rows(tables["v"].read())] == ["candidate:1", "candidate:2"]
    for batch in ("s1", "s1", "s2"):
        wf.snapshot(tables["s"], {"entities": tables["e"].read()}, tables["e"].read(), batch)
    kept = tables["s"].read()
    assert rows(kept.select("case_id", "sequence", "section", "id")) == [(7, 1, "entities", 1), (7, 2, "entities", 1)]
    assert json.loads(kept.first().payload)["name"] == "Asha  Patil"
    runs = lambda v, n: spark.createDataFrame([(7, v, n)], "case_id long, version string, findings int")
    for v, n, batch in (("h1", 3, "r1"), ("h1", 3, "r1"), ("h1", 3, "r2"), ("h2", 4, "r3")):
        wf.record_run(tables["r"], runs(v, n), batch)
    assert rows(tables["r"].read()) == [(7, 1, "h1", 3, None), (7, 2, "h2", 4, 1)]


FIELDS = json.dumps({"subject": "accused_id", "label": "full_name", "unit": "ps"})


def test_an_adapter_reads_fixtures_with_an_authorisation_only(spark, tmp_path):
    adapters.register(spark)
    theirs = [{"accused_id": k, "full_name": f"N{k}", "ps": "A" if k % 2 else None} for k in range(10)]
    for part in range(2):
        (tmp_path / f"part-{part}.json").write_text("\n".join(json.dumps(r) for r in theirs[part::2]) + "\n")
    (tmp_path / "_SUCCESS").write_text("")
    read = lambda **more: spark.read.format("casewright_adapter").options(fields=FIELDS, fixture=str(tmp_path), **more).load()
    got = read(authorisation="warrant 7")
    assert sorted(map(tuple, got.collect())) == sorted((str(k), f"N{k}", "A" if k % 2 else None) for k in range(10)) and got.rdd.getNumPartitions() == 2
    assert read().count() == read(authorisation=" ").count() == 0
    few = got.filter("unit = 'A' and label in ('N1', 'N2', 'N3')")
    assert sorted(r.subject for r in few.collect()) == ["1", "3"]
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "isin" not in plan and " IN " not in plan and not re.search(r"\bFilter \(", plan)  # the reader does it
    assert [r.subject for r in got.filter("unit is null and label > 'N6'").collect()] == ["8"]


def test_an_adapter_asks_a_live_system(spark):
    adapters.register(spark)
    asked = []

    class Office(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append((self.path, self.headers["X-Authorisation"], self.headers["Authorization"]))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps([{"accused_id": 4, "full_name": "N4", "ps": "B"}, {"accused_id": 5, "full_name": "N5", "ps": "A"}]).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Office)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        df = spark.read.format("casewright_adapter").options(fields=FIELDS, live=f"http://127.0.0.1:{server.server_port}/records", authorisation="w", token="t").load()
        assert [tuple(r) for r in df.filter("unit = 'A'").collect()] == [("5", "N5", "A")]
        assert asked == [("/records?ps=A", "w", "Bearer t")]
    finally:
        server.shutdown()
