"""Tables that change: versions in a shared folder, each committed by one atomic step.

A version is a file ``_versions/<number>`` that says which data folder belongs to it and how: rows that are added or
replace those of their key (``put``), or all rows (``base``). Data is written first; the version file is then put in place
under the next number by a step that fails if there is one already (a link on a local or mounted folder, a rename on HDFS),
so of two writers one wins, and the other looks at what has changed and tries again. A batch that has a version already
writes nothing, so a job that is run again after a failure does no harm. The store needs such a step: plain object stores,
whose renames replace, are refused.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stores whose rename fails if the target is there.
RENAMES = ("hdfs", "viewfs", "abfs", "abfss")


class Conflict(Exception):
    """Another writer has made the version."""


class ChangingTable:
    """A table of ``schema`` with one row for each ``key`` (a list of columns), the one put last."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str]):
        self.spark, self.path, self.key = spark, path.rstrip("/") if "://" in path else f"file://{path.rstrip('/')}", key
        self.types = spark.createDataFrame([], schema).schema
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.scheme = self._fs.getUri().getScheme()
        if self.scheme != "file" and self.scheme not in RENAMES:
            raise ValueError(f"{self.scheme} has no rename that fails if the target is there")
        self._fs.mkdirs(self._path(f"{self.path}/_versions"))
        self._seen: dict[int, dict] = {}

    def history(self) -> list[dict]:
        """What each version is: number, batch, kind, folder. Versions don't change, so those read before are not read again."""
        for s in self._fs.listStatus(self._path(f"{self.path}/_versions")):
            name = s.getPath().getName()
            if name.isdigit() and int(name) not in self._seen:
                self._seen[int(name)] = {"number": int(name), **json.loads(self._text(s.getPath()))}
        return [self._seen[n] for n in sorted(self._seen)]

    def _text(self, path) -> str:
        stream = self._fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def version(self) -> int:
        """The last version, 0 without one."""
        return max((v["number"] for v in self.history()), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the last one): of each key those put last since the last version that was whole."""
        kept: list[dict] = []
        for v in self.history():
            if version is None or v["number"] <= version:
                kept = [v] if v["kind"] == "base" else [*kept, v]
        rows = None
        for v in kept:
            part = self.spark.read.schema(self.types).parquet(f"{self.path}/{v['folder']}").withColumn("_version", F.lit(v["number"]))
            rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            return self.spark.createDataFrame([], self.types)
        if len(kept) == 1:
            return rows.drop("_version")
        names = self.types.fieldNames()
        return rows.groupBy(*self.key).agg(F.max_by(F.struct(*names), "_version").alias("_row")).select("_row.*").select(*names)

    def put(self, rows: DataFrame, batch: str, expected: int | None = None, kind: str = "put") -> int:
        """Puts rows (one for each key) as a version and gives its number. A batch that has a version already gives that, and writes nothing.

        With ``expected`` a version after that one is a ``Conflict``; without, the rows go on top of what others have put.
        """
        if (old := self._of(batch)) is not None:
            return old
        if expected is not None and self.version() != expected:
            raise Conflict(f"version {self.version()} instead of {expected}")
        folder = f"data-{uuid.uuid4().hex}"
        rows.select(*self.types.fieldNames()).write.parquet(f"{self.path}/{folder}")
        said = json.dumps({"batch": batch, "kind": kind, "folder": folder})
        while True:
            number = (self.version() if expected is None else expected) + 1
            if self._commit(number, said):
                return number
            if (old := self._of(batch)) is not None:  # another run of this batch was faster
                self._fs.delete(self._path(f"{self.path}/{folder}"), True)
                return old
            if expected is not None:
                self._fs.delete(self._path(f"{self.path}/{folder}"), True)
                raise Conflict(f"version {number} was made meanwhile")

    def _of(self, batch: str) -> int | None:
        return next((v["number"] for v in self.history() if v["batch"] == batch), None)

    def _commit(self, number: int, said: str) -> bool:
        made, target = self._path(f"{self.path}/_versions/.{uuid.uuid4().hex}"), self._path(f"{self.path}/_versions/{number}")
        stream = self._fs.create(made)
        stream.write(said.encode())
        stream.close()
        if self.scheme != "file":
            won = self._fs.rename(made, target)
        else:
            try:
                os.link(made.toUri().getPath(), target.toUri().getPath())
                won = True
            except FileExistsError:
                won = False
        if not won or self.scheme == "file":
            self._fs.delete(made, False)
        return won

    def change(self, changed: Callable[[DataFrame], DataFrame], batch: str, tries: int = 50) -> int:
        """Puts what ``changed`` makes of the rows of the last version; made anew of the rows then if another writer comes between."""
        for _ in range(tries):
            now = self.version()
            try:
                return self.put(changed(self.read(now)), batch, now)
            except Conflict:
                continue
        raise Conflict(f"{tries} tries")

    def compact(self) -> int:
        """Writes all rows as one version, so that reads don't merge many. Older versions stay readable."""
        now = self.version()
        return self.put(self.read(now), f"compact-{now}", now, "base") if now else 0
