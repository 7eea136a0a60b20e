"""Web archives: WARC records with revisits, their index, and an external merge of index runs.

Writing: payload digests decide which record is a response and which revisits it; each task writes archives of bounded
size, one gzip member a record, under a name of its own that it moves to the final one when the file is whole, so a
repeated task leaves one copy. Reading: each archive is streamed, and gives a run of index lines sorted by URL key and
timestamp. Merging: key ranges are dealt to tasks; each takes its slices of all runs and merges them k ways with a
loser tree, so captures come out in global order.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from hashlib import sha256
from uuid import uuid4

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm.common import scratch, small_batches, stored

#: Smaller payloads are always responses.
LEAST_BYTES = 100
#: Uncompressed bytes of an archive.
ARCHIVE_BYTES = 64 << 20
#: Pages that a Parquet reader holds at once.
READ_ROWS = 64
#: Runs that one loser tree merges at once.
FAN_IN = 256
_INDEX = pa.schema([
    ("url_key", pa.string()), ("captured", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
])
_INDEX_DDL = "url_key string, captured long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"


def url_key(url: str | None) -> str:
    """Sort-friendly key: host labels reversed and joined by commas, then path and query, lower-cased; without scheme, www, port 80/443 and fragment."""
    rest = (url or "").strip().lower().partition("#")[0]
    rest = rest.split("://", 1)[-1]
    cut = min((i for c in "/?" if (i := rest.find(c)) >= 0), default=len(rest))
    host, path = rest[:cut].rpartition("@")[2], rest[cut:] or "/"
    name, _, port = host.partition(":")
    name = name.removeprefix("www.")
    return ",".join(reversed(name.split("."))) + (f":{port}" if port not in ("", "80", "443") else "") + ")" + (path if path[0] == "/" else "/" + path)


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:/") else f"file://{path}")


def _clean(value: str) -> str:
    """A header value on one line, reversible: % and control characters as %XX."""
    return "".join(f"%{ord(c):02X}" if c == "%" or ord(c) < 32 or ord(c) == 127 else c for c in value)


def _unclean(value: str) -> str:
    out, _, rest = value.partition("%")
    while rest:
        out += chr(int(rest[:2], 16))
        more, _, rest = rest[2:].partition("%")
        out += more
    return out


def record(page: int | None, url: str | None, captured: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record; a revisit keeps the HTTP headers and leaves out the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = "none" if page is None else page
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head += [f"WARC-Date: {captured}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


@contextmanager
def _few_rows_read(spark: SparkSession) -> Iterator[None]:
    """Within it Parquet is read READ_ROWS rows at a time at most, so that an executor's memory follows a few pages and not 4096."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(READ_ROWS, int(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _write(folder: str):
    def written(batches):
        fs, base = _file_system(folder)
        out = part = name = None
        size = 0

        def close():
            out.close()
            fs.move(f"{base}/{part}", f"{base}/{name}")
            return name

        for batch in batches:
            done = []
            rows = zip(*(batch.column(k).to_pylist() for k in range(4)), *(batch.column(k).to_pylist() for k in (4, 5)), strict=True)
            for page, url, captured, html, digest, refers_to in rows:
                if out is None:
                    name = f"{uuid4().hex}.warc.gz"
                    part, size = f".{name}.part", 0
                    out = fs.open_output_stream(f"{base}/{part}", compression=None)
                whole = record(page, url, captured, (html or "").encode("utf-8", "surrogatepass"), digest, refers_to)
                out.write(gzip.compress(whole, 4, mtime=0))
                size += len(whole)
                if size >= ARCHIVE_BYTES:
                    done.append(close())
                    out = None
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["archive"])
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([close()], pa.string())], names=["archive"])

    return written


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(archive): names of the archives in ``folder`` that hold a record for each row of ``pages``.

    Null html is an empty payload. Of equal payloads of LEAST_BYTES or more the row with the smallest id is the response and rows with a
    larger id revisit it; rows that repeat that smallest id are responses too, and rows with a null id are responses. Only
    digests are grouped; pages are sent once, by digest. The date of a capture is the id in seconds after 2020-01-01. A
    page is one record however long it is; of an empty table no archive is written. Other columns are not read.
    """
    small_batches(pages.sparkSession)
    fs, base = _file_system(folder)
    fs.create_dir(base, recursive=True)
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"))
    digest = F.sha2(F.col("html").cast("binary"), 256).alias("digest")  # not encode(), which makes a Java string of each page and its bytes again
    large = rows.filter((F.octet_length("html") >= LEAST_BYTES) & F.col("page_id").isNotNull()).select("page_id", digest)
    captured = F.date_format(F.timestamp_seconds(F.lit(1577836800) + F.coalesce(F.pmod("page_id", F.lit(1 << 31)), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    with _few_rows_read(pages.sparkSession):
        # stored, so that both sides of the join are plain exchanges and a payload of very many pages can be split
        first = stored(large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first"), "first")
        full = rows.select("*", digest).join(first, "digest", "left").withColumn("refers_to", F.when(F.col("page_id") > F.col("first"), F.col("first")))
        return stored(full.select("page_id", "url", captured.alias("captured"), "html", "digest", "refers_to").mapInArrow(_write(folder), "archive string"), "archives")


def members(stream):
    """(offset, length, record) of each gzip member of a stream, one at a time."""
    offset, rest = 0, b""
    while rest or (rest := stream.read(1 << 16)):
        unzip, parts, used = zlib.decompressobj(31), [], 0
        while not unzip.eof:
            if not rest and not (rest := stream.read(1 << 16)):
                raise ValueError(f"the archive ends within the record at {offset}")
            parts.append(unzip.decompress(rest))
            used += len(rest)
            rest = unzip.unused_data if unzip.eof else b""
        used -= len(rest)
        yield offset, used, b"".join(parts)
        offset += used


def parse(whole: bytes) -> dict:
    """Headers of a record (names in lower case), its HTTP headers (http) and payload."""
    head, _, rest = whole.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    out: dict = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(out["content-length"])]
    http, _, out["payload"] = block.partition(b"\r\n\r\n")
    out["http"] = {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])}
    return out


def _index(folder: str, runs: str):
    def indexed(batches):
        from datetime import datetime, timezone

        fs, base = _file_system(folder)
        to, there = _file_system(runs)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                lines = []
                with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for offset, length, whole in members(stream):
                        r = parse(whole)
                        page = r["warc-record-id"][10:-1]
                        when = int(datetime.strptime(r["warc-date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc).timestamp())
                        url = _unclean(r["warc-target-uri"]) if "warc-target-uri" in r else None
                        digest = r["warc-payload-digest"].removeprefix("sha256:")
                        revisit = r["warc-type"] == "revisit"
                        if not revisit and (sha256(r["payload"]).hexdigest() != digest or len(r["payload"]) != int(r["http"]["content-length"])):
                            raise ValueError(f"{name}: the payload at {offset} does not have its digest")
                        lines.append((url_key(url), when, None if page == "none" else int(page), url, int(r["http"]["content-length"]), digest, r["warc-type"], int(r["warc-refers-to"][10:-1]) if revisit else None, name, offset, length))
                lines.sort(key=_order)
                part = f"{there}/.{name}.{uuid4().hex}"
                with to.open_output_stream(part) as sink:
                    pq.write_table(_table(lines), sink, row_group_size=4096)
                to.move(part, f"{there}/{name}.parquet")
                # every so many keys of the run, from which ranges are chosen
                step = max(1, len(lines) // 64)
                some = lines[::step]
                yield pa.RecordBatch.from_arrays([pa.array([f"{name}.parquet"] * len(some)), pa.array([x[0] for x in some]), pa.array([x[1] for x in some], pa.int64()), pa.array([x[2] for x in some], pa.int64())], names=["run", "url_key", "captured", "page_id"])

    return indexed


def _order(line: tuple) -> tuple:
    """URL key, timestamp, id (null first), archive, offset: a total order."""
    return (line[0], line[1], -(1 << 63) if line[2] is None else line[2], line[8], line[9])


def loser_tree(runs: list, key):
    """All items of sorted iterators in order: each step replays one path of a tree whose inner nodes hold the losers."""
    k = len(runs)
    if not k:
        return
    runs = [iter(r) for r in runs]
    heads = [next(r, None) for r in runs]
    keys = [None if h is None else key(h) for h in heads]
    beats = lambda a, b: keys[b] is None or keys[a] is not None and (keys[a], a) < (keys[b], b)
    tree = [-1] * k  # 0: the winner
    up = list(range(k))
    # the first round from the leaves k..2k-1 upwards
    winners = {k + i: i for i in up}
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], tree[node] = (a, b) if beats(a, b) else (b, a)
    tree[0] = winners.get(1, 0)
    while keys[tree[0]] is not None:
        w = tree[0]
        yield heads[w]
        heads[w] = next(runs[w], None)
        keys[w] = None if heads[w] is None else key(heads[w])
        node = (k + w) // 2
        while node:
            if beats(tree[node], w):
                tree[node], w = w, tree[node]
            node //= 2
        tree[0] = w


def _slice(fs: pafs.FileSystem, path: str, low: tuple | None, high: tuple | None):
    """Lines of a run with low <= (url_key, captured, page_id) < high; row groups outside are not read."""
    with fs.open_input_file(path) as source:
        file = pq.ParquetFile(source)
        for g in range(file.num_row_groups):
            stats = file.metadata.row_group(g).column(0).statistics
            if stats is not None and stats.has_min_max and (low and stats.max < low[0] or high and stats.min > high[0]):
                continue
            for batch in file.iter_batches(1024, row_groups=[g]):
                for line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    own = _order(line)[:3]
                    if (not low or own >= low) and (not high or own < high):
                        yield line


def _merge(runs: str, names: list[str]):
    def merged(batches):
        fs, base = _file_system(runs)
        for batch in batches:
            for low, high, no in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                low, high = (tuple(x.values()) if x else None for x in (low, high))
                out, place = [], 0
                for line in loser_tree([_slice(fs, f"{base}/{n}", low, high) for n in names], _order):
                    out.append((*line, no, place))
                    place += 1
                    if len(out) == 4096:
                        yield _lines(out)
                        out = []
                yield _lines(out)

    return merged


def _join_runs(runs: str):
    """Merges the runs of each row into one longer run."""

    def joined(batches):
        fs, base = _file_system(runs)
        for batch in batches:
            for group in batch.column(0).to_pylist():
                name = f"{sha256(group[0].encode()).hexdigest()}.parquet"
                part, lines = f"{base}/.{name}.{uuid4().hex}", []
                with fs.open_output_stream(part) as sink, pq.ParquetWriter(sink, _INDEX) as to:
                    for line in loser_tree([_slice(fs, f"{base}/{n}", None, None) for n in group], _order):
                        lines.append(line)
                        if len(lines) == 4096:
                            to.write_table(_table(lines))
                            lines = []
                    to.write_table(_table(lines))
                fs.move(part, f"{base}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array([name])], names=["run"])

    return joined


def _table(lines: list[tuple]) -> pa.Table:
    columns = zip(*lines, strict=True) if lines else [[] for _ in _INDEX]
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _INDEX, strict=True)], schema=_INDEX)


def _lines(out: list[tuple]) -> pa.RecordBatch:
    schema = _INDEX.append(pa.field("range_no", pa.int64())).append(pa.field("place", pa.int64()))
    columns = zip(*out, strict=True) if out else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def capture_histories(spark: SparkSession, folder: str, archives: DataFrame, ranges: int | None = None) -> DataFrame:
    """The merged index: url_key, captured, page_id, url, payload_bytes, payload_digest, record_type, refers_to, archive, offset, length, range_no, place.

    Rows are in global order by (range_no, place): URL key, timestamp, id (null first), archive, offset. Payloads are read
    back and held against their digests. There are at most ``ranges`` ranges (by default the lesser of archives and shuffle
    partitions). A URL that holds many captures is cut by timestamp and id, so no range follows one key; records that
    repeat an id and a payload are lines of their own. Without archives there are no rows.
    """
    runs = scratch(spark, "runs")
    fs, base = _file_system(runs)
    fs.create_dir(base, recursive=True)
    n = max(1, archives.count())
    keys = stored(archives.repartition(n).mapInArrow(_index(folder, runs), "run string, url_key string, captured long, page_id long"), "keys")
    names = sorted(r["run"] for r in keys.select("run").distinct().collect())  # a file name for each archive
    while len(names) > FAN_IN:
        groups = [(names[k : k + FAN_IN],) for k in range(0, len(names), FAN_IN)]
        longer = spark.createDataFrame(groups, "runs array<string>").repartition(len(groups)).mapInArrow(_join_runs(runs), "run string")
        names = sorted(r["run"] for r in stored(longer, "longer").collect())
    # cuts: the first key of each of ``ranges`` even ranges of the sampled keys
    ranges = ranges or max(1, min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    place = ["url_key", "captured", "page_id"]
    known = keys.select("url_key", "captured", F.coalesce("page_id", F.lit(-(1 << 63))).alias("page_id"))
    firsts = known.repartitionByRange(ranges, *place).groupBy(F.spark_partition_id()).agg(F.min(F.struct(*place)).alias("x")).collect()
    # a session may deal keys to more partitions than asked for; each range opens every run, so no more ranges than asked for
    cuts = sorted({tuple(r["x"]) for r in firsts})
    cuts = [cuts[len(cuts) * i // ranges] for i in range(1, ranges)] if len(cuts) > ranges else cuts[1:]
    rows = [(a, b, no) for no, (a, b) in enumerate(zip([None, *cuts], [*cuts, None], strict=True))]
    key = "struct<url_key: string, captured: bigint, page_id: bigint>"
    tasks = spark.createDataFrame(rows, f"low {key}, high {key}, no long").repartitionByRange(len(rows), "no")
    return tasks.mapInArrow(_merge(runs, names), _INDEX_DDL + ", range_no long, place long")
