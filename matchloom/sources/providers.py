"""Metadata providers as a data source: DOIs in, answers out, as a batch or a stream.

DOIs lie in a folder of Parquet files that every executor can read (`deposit` writes one, in the shared folder). Files
are dealt to a fixed number of lanes, which bounds how many requests run at a time; each lane spaces its
requests so that all lanes together keep to the rate. Busy servers are asked again after the seconds they name in
Retry-After, or after a doubling wait. A stream takes files that have come since, a bounded number at a time.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from matchloom.operators.enrichment import ask
from matchloom.session import scratch

SCHEMA = "doi string, status string, http_status int, body string"
_ARROW = pa.schema([("doi", pa.string()), ("status", pa.string()), ("http_status", pa.int32()), ("body", pa.string())])


@dataclass(frozen=True)
class Http:
    """Requests to a provider's works: base address, headers (who asks) and parameters (a mail address or key)."""

    base: str
    headers: dict[str, str] = field(default_factory=dict)
    params: dict[str, str] = field(default_factory=dict)
    timeout: float = 30.0
    prefix: str = "/works/"

    def get(self, doi: str) -> tuple[int, str, dict[str, str]]:
        query = "?" + urllib.parse.urlencode(self.params) if self.params else ""
        request = urllib.request.Request(f"{self.base}{self.prefix}{urllib.parse.quote(doi, safe='/')}{query}", headers={"Accept": "application/json", **self.headers})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as r:
                return r.status, r.read().decode("utf-8", "replace"), dict(r.headers)
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode("utf-8", "replace"), dict(e.headers or {})


def crossref(email: str, **more) -> Http:
    """The first provider; it asks who is asking."""
    if not email.strip():
        raise ValueError("the provider asks for a mail address")
    return Http("https://api.crossref.org", {"User-Agent": f"matchloom/0.1 (mailto:{email.strip()})"}, {"mailto": email.strip()}, **more)


def openalex(key: str, **more) -> Http:
    """The second provider; it asks for a key. A DOI is one of its ids."""
    if not key.strip():
        raise ValueError("the provider asks for a key")
    return Http("https://api.openalex.org", {"User-Agent": "matchloom/0.1"}, {"api_key": key.strip()}, prefix="/works/doi:", **more)


def deposit(dois: DataFrame, files: int, path: str | None = None, doi: str = "doi") -> str:
    """Writes the distinct, folded DOIs of a table to so many files of a folder, and returns its path."""
    path = path or scratch(dois.sparkSession, "dois")
    clean = dois.select(F.lower(F.trim(F.col(doi))).alias("doi")).where("doi <> ''").distinct()
    clean.repartition(files, "doi").write.mode("append").parquet(path)
    return path


class _Lane(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


def _listed(path: str) -> tuple[fs.FileSystem, list[str]]:
    """The folder's data files, by the time they were written and by name."""
    system, root = fs.FileSystem.from_uri(path)
    found = [f for f in system.get_file_info(fs.FileSelector(root)) if f.is_file and f.base_name.startswith("part-")]
    return system, [f.path for f in sorted(found, key=lambda f: (f.mtime_ns or 0, f.path))]


def _lanes(files: list[str], lanes: int) -> list[_Lane]:
    dealt = [files[i::lanes] for i in range(lanes)]
    return [_Lane(x) for x in dealt if x]


def _answers(path: str, files: list[str], provider, tries: int, pause: float) -> Iterator[pa.RecordBatch]:
    """What the provider says to the files' DOIs, a hundred at a time; `pause` seconds pass between two requests."""
    system, _ = fs.FileSystem.from_uri(path)
    last = None
    for name in files:
        for batch in pq.ParquetFile(system.open_input_file(name)).iter_batches(100, columns=["doi"]):
            rows = []
            for doi in batch.column(0).to_pylist():
                if last is not None and pause > 0:
                    time.sleep(max(0.0, last + pause - time.monotonic()))
                last = time.monotonic()
                rows.append((doi, *ask(provider, doi, tries)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(_ARROW)], schema=_ARROW)


def provider_source(name: str, provider) -> type[DataSource]:
    """A data source of that name whose answers come from `provider` (Http, or anything with its get).

    Options: path (a folder of DOIs, see deposit), lanes (4), per_second (requests of all lanes together, unlimited by default), tries (4), and
    for a stream files_per_batch (8).
    """

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.path, self.lanes, self.tries = options["path"], int(options.get("lanes", 4)), int(options.get("tries", 4))
            rate = float(options.get("per_second", 0))
            self.pause = self.lanes / rate if rate else 0.0

        def partitions(self):
            return _lanes(_listed(self.path)[1], self.lanes) or [_Lane([])]

        def read(self, partition):
            yield from _answers(self.path, partition.files, provider, self.tries, self.pause)

    class Stream(DataSourceStreamReader):
        def __init__(self, options):
            self.batch = Reader(options)
            self.most = int(options.get("files_per_batch", 8))
            self.given = 0

        def initialOffset(self):
            return {"files": 0}

        def latestOffset(self):
            self.given = min(len(_listed(self.batch.path)[1]), self.given + self.most)
            return {"files": self.given}

        def partitions(self, start, end):
            self.given = max(self.given, end["files"])  # after a restart
            return _lanes(_listed(self.batch.path)[1][start["files"] : end["files"]], self.batch.lanes)

        def read(self, partition):
            yield from self.batch.read(partition)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            return Reader(dict(self.options))

        def streamReader(self, schema):
            return Stream(dict(self.options))

    return Source


def register(spark: SparkSession, name: str, provider) -> None:
    spark.dataSource.register(provider_source(name, provider))
