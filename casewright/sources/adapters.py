"""Systems of other offices as data sources: ``spark.read.format("casewright_adapter")``.

Options: ``fixture`` (a JSON-lines file, or a folder of them, in any store that pyarrow knows) or ``live`` (an address that
answers a GET with a JSON array); ``authorisation``, without which nothing is read; ``fields``, a JSON object from our
column names to theirs; ``token`` for a live system. All columns are strings. Filters of equality, of membership and for
values that are there are done by the reader, a live system also gets those of equality as parameters.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull
from pyspark.sql.types import StructType

#: Seconds that a live system has for an answer.
PATIENCE = 30


class _Part(InputPartition):
    """A file of a fixture, or the live system's address."""


class AdapterReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names = schema.fieldNames()
        self.options = options
        self.fields: dict[str, str] = json.loads(options.get("fields", "{}"))
        self.wanted: list[tuple[str, frozenset[str] | None]] = []  # column and its values; any value that is there for None

    def pushFilters(self, filters: list) -> Iterable:  # noqa: N802
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in self.names and isinstance(f, EqualTo) and f.value is not None:
                self.wanted.append((column, frozenset([f.value])))
            elif column in self.names and isinstance(f, In):
                self.wanted.append((column, frozenset(v for v in f.value if v is not None)))
            elif column in self.names and isinstance(f, IsNotNull):
                self.wanted.append((column, None))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """A partition for each file of the fixture, one for a live system, none without an authorisation."""
        if not self.options.get("authorisation", "").strip():
            return []
        if live := self.options.get("live"):
            asked = {self.fields.get(c, c): next(iter(v)) for c, v in self.wanted if v is not None and len(v) == 1}
            return [_Part(("live", f"{live}{'&' if '?' in live else '?'}{urlencode(asked)}" if asked else live))]
        from pyarrow import fs

        if not (path := self.options.get("fixture")):
            raise ValueError("an adapter needs a fixture or a live address")
        store, place = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        info = store.get_file_info(place)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(place))
        scheme = path.split("://")[0] if "://" in path else "file"
        return [_Part(("file", f"{scheme}://{f.path}")) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is None or partition.value is None:  # what Spark asks for where there are no partitions
            return
        kind, place = partition.value
        for theirs in self._live(place) if kind == "live" else self._file(place):
            row = tuple(None if (v := theirs.get(self.fields.get(c, c))) is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for c in self.names)
            if all(v in some if some is not None else v is not None for c, some in self.wanted for v in (row[self.names.index(c)],)):
                yield row

    def _live(self, address: str) -> list[dict]:
        asked = Request(address, headers={"Accept": "application/json", "X-Authorisation": self.options["authorisation"]} | ({"Authorization": f"Bearer {t}"} if (t := self.options.get("token")) else {}))
        with urlopen(asked, timeout=PATIENCE) as answer:
            return json.load(answer)

    def _file(self, place: str) -> Iterator[dict]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(place)
        with store.open_input_stream(path) as stream:
            rest = b""
            while chunk := stream.read(1 << 20):
                *lines, rest = (rest + chunk).split(b"\n")
                yield from (json.loads(line) for line in lines if line.strip())
            if rest.strip():
                yield json.loads(rest)


class Adapter(DataSource):
    @classmethod
    def name(cls) -> str:
        return "casewright_adapter"

    def schema(self) -> str:
        """Our names of the field map; ``schema()`` of the reader can name them otherwise."""
        names = list(json.loads(self.options.get("fields", "{}")))
        if not names:
            raise ValueError("an adapter needs a schema or a field map")
        return ", ".join(f"`{n}` string" for n in names)

    def reader(self, schema: StructType) -> AdapterReader:
        return AdapterReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Adapter)
