"""A private blob store over HTTP as a data source of Spark, for batches and streams.

The store answers, with a bearer token if it wants one:

- ``PUT base/path`` and ``GET base/path`` with a body, ``DELETE base/path``;
- ``GET base?prefix=&after=&until=&limit=`` with ``{"blobs": [{"pathname", "size", "sequence"}], "more"}``,
  by pathname, those above ``after`` and below ``until``;
- ``GET base?from=&to=&limit=`` with the same in the order of upload, by sequence numbers;
- ``GET base?latest`` with ``{"sequence"}``, one more than that of the latest upload.

``register(spark)`` makes it ``spark.read.format("blobs")``; executors need this package too.
Options: ``base``, ``token``; reading: ``prefixes`` (a comma between two, a task for each),
``splits`` (pathnames at which a prefix is parted), ``committed`` (only what a writer of that
name has published), ``per_task`` (uploads of a stream's task); writing: ``name``.

A writer puts each body under its path with a suffix made of the run and of the content, so a
task that runs again puts the same blobs. Each task lists its blobs in a part list of its
own; a run is published by one last blob that names the part lists, and until then no reader
of ``committed`` sees any of it. A stream's run is its batch: a batch that runs again
replaces its own publication. A stream must not write to the store it reads: every batch
would make another.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from sedge.functions import columns as C

#: What reading gives. A blob that can't be read has an error and no content.
SCHEMA = "pathname string, size long, content binary, error string"
#: Rows of a page of a listing, tries of a request, and the first wait in seconds, doubled each time.
PAGE, TRIES, WAIT = 1000, 5, 0.2
_RETRIED = {429, 500, 502, 503, 504}


class BlobError(Exception):
    """An answer that isn't a success, with its status (0: none came)."""

    def __init__(self, status: int, what: str = "fetch"):
        super().__init__(f"Failed to {what} blob ({status})")
        self.status = status


@dataclass
class Store:
    base: str
    token: str | None = None
    tries: int = TRIES
    wait: float = WAIT

    def request(self, method: str, url: str, body: bytes | None = None, what: str = "fetch") -> bytes:
        """The answer's body; answers that may pass and broken connections are tried again."""
        headers = {"Authorization": f"Bearer {self.token}"} if self.token else {}
        status = 0
        for n in range(self.tries):
            if n:
                time.sleep(self.wait * 2 ** (n - 1))
            try:
                with urllib.request.urlopen(urllib.request.Request(url, data=body, method=method, headers=headers), timeout=60) as r:
                    return r.read()
            except urllib.error.HTTPError as e:
                status = e.code
                if status not in _RETRIED:
                    break
            except (urllib.error.URLError, ConnectionError, TimeoutError):
                status = 0
        raise BlobError(status, what)

    def url(self, path: str) -> str:
        return f"{self.base.rstrip('/')}/{'/'.join(urllib.parse.quote(s, safe='') for s in path.split('/'))}"

    def get(self, path: str) -> bytes:
        return self.request("GET", self.url(path))

    def put(self, path: str, body: bytes) -> None:
        self.request("PUT", self.url(path), body, "put")

    def delete(self, path: str) -> None:
        try:
            self.request("DELETE", self.url(path), what="delete")
        except BlobError as e:
            if e.status != 404:
                raise

    def asked(self, **query: object) -> dict:
        return json.loads(self.request("GET", f"{self.base.rstrip('/')}?{urllib.parse.urlencode(query)}", what="list"))

    def listed(self, prefix: str, after: str = "", until: str = "") -> Iterator[dict]:
        """Blobs below ``prefix``, a page after the other."""
        while True:
            page = self.asked(prefix=prefix, after=after, until=until, limit=PAGE)
            yield from page["blobs"]
            if not page["more"]:
                return
            after = page["blobs"][-1]["pathname"]

    def uploaded(self, start: int, end: int) -> Iterator[dict]:
        while start < end:
            page = self.asked(**{"from": start, "to": end, "limit": PAGE})
            yield from page["blobs"]
            if not page["more"]:
                return
            start = page["blobs"][-1]["sequence"] + 1

    def row(self, blob: dict) -> tuple:
        try:
            return blob["pathname"], blob["size"], self.get(blob["pathname"]), None
        except BlobError as e:
            return blob["pathname"], blob["size"], None, str(e)


def _own(path: str) -> bool:
    """Whether a blob is one of a writer's lists and no body."""
    return path.startswith(("_runs/", "_parts/"))


@dataclass
class Range(InputPartition):
    prefix: str
    after: str = ""
    until: str = ""


@dataclass
class Part(InputPartition):
    path: str


@dataclass
class Uploads(InputPartition):
    start: int
    end: int


class Reader(DataSourceReader):
    def __init__(self, store: Store, prefixes: list[str], splits: list[str], committed: str | None):
        self.store, self.prefixes, self.splits, self.committed = store, prefixes, splits, committed

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802
        """A prefix that pathnames are asked for narrows the listing; the rest is left to Spark."""
        for f in filters:
            if isinstance(f, StringStartsWith) and f.attribute == ("pathname",) and self.committed is None:
                self.prefixes = sorted({f.value if f.value.startswith(p) else p for p in self.prefixes if f.value.startswith(p) or p.startswith(f.value)})
            yield f

    def partitions(self) -> list[InputPartition]:
        """A task for each part list, or for each prefix and split of it; no blob is listed here."""
        if self.committed is not None:
            runs = [b["pathname"] for b in self.store.listed(f"_runs/{self.committed}/")]
            return [Part(p) for run in runs for p in json.loads(self.store.get(run))["parts"]] or [Range("_runs/none/")]
        found = []
        for p in self.prefixes:
            edges = ["", *sorted(s for s in self.splits if s.startswith(p)), ""]
            found += [Range(p, a, b) for a, b in zip(edges, edges[1:], strict=False)]
        return found or [Range("_runs/none/")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if isinstance(partition, Part):
            for line in self.store.get(partition.path).splitlines():
                yield self.store.row(json.loads(line))
        else:
            # a split is the last pathname of its range: "until" is that which doesn't belong any more
            for blob in self.store.listed(partition.prefix, partition.after, partition.until and partition.until + "\x00"):
                if not _own(blob["pathname"]):
                    yield self.store.row(blob)


class StreamReader(DataSourceStreamReader):
    """Offsets are sequence numbers of uploads; a batch is dealt into ranges of them."""

    def __init__(self, store: Store, per_task: int):
        self.store, self.per_task = store, per_task

    def initialOffset(self) -> dict:  # noqa: N802
        return {"sequence": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"sequence": self.store.asked(latest="")["sequence"]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        a, b = start["sequence"], end["sequence"]
        return [Uploads(i, min(b, i + self.per_task)) for i in range(a, b, self.per_task)]

    def read(self, partition: Uploads) -> Iterator[tuple]:
        for blob in self.store.uploaded(partition.start, partition.end):
            if not _own(blob["pathname"]):
                yield self.store.row(blob)


@dataclass
class Put(WriterCommitMessage):
    """A task's part list, the number of its blobs, and their bytes."""

    part: str
    blobs: int
    size: int


class _Writing:
    """What writers of batches and of streams share. ``run``: unlike any other of the name."""

    store: Store
    name: str

    def put_rows(self, rows: Iterator, run: str) -> Put:
        from pyspark import TaskContext

        context = TaskContext.get()
        part = f"_parts/{self.name}/{run}-{context.partitionId()}-{context.taskAttemptId()}"
        lines, size = [], 0
        try:
            for row in rows:
                body = bytes(row["content"] or b"")
                path = suffixed(row["pathname"], run, body)
                self.store.put(path, body)
                lines.append(json.dumps({"pathname": path, "size": len(body)}))
                size += len(body)
            self.store.put(part, "\n".join(lines).encode())
        except BaseException:
            self.remove([part])  # bodies stay: another attempt puts the same under the same names
            raise
        return Put(part, len(lines), size)

    def publish(self, messages: list, run: str) -> None:
        parts = sorted(m.part for m in messages if m is not None)
        self.store.put(f"_runs/{self.name}/{run}", json.dumps({"parts": parts}).encode())

    def withdraw(self, messages: list) -> None:
        """Delete what finished tasks of a run that isn't published have put."""
        for m in messages:
            if m is not None:
                self.remove([json.loads(line)["pathname"] for line in self.store.get(m.part).splitlines()] + [m.part])

    def remove(self, paths: list[str]) -> None:
        for p in paths:
            try:
                self.store.delete(p)
            except BlobError:
                pass  # the run has failed already; what stays is in no list


class Writer(_Writing, DataSourceWriter):
    def __init__(self, store: Store, name: str, run: str):
        self.store, self.name, self.run = store, name, run

    def write(self, iterator: Iterator) -> Put:
        return self.put_rows(iterator, self.run)

    def commit(self, messages: list) -> None:
        self.publish(messages, self.run)

    def abort(self, messages: list) -> None:
        self.remove([f"_runs/{self.name}/{self.run}"])  # first: it may be there though its answer was lost
        self.withdraw(messages)


class StreamWriter(_Writing, DataSourceStreamWriter):
    """Blobs of a batch that failed stay, for the batch runs again and puts the same."""

    def __init__(self, store: Store, name: str):
        self.store, self.name = store, name

    def write(self, iterator: Iterator) -> Put:
        return self.put_rows(iterator, "stream")

    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        self.publish(messages, f"batch-{batchId:012d}")

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        self.remove([m.part for m in messages if m is not None])


class BlobSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blobs"

    def schema(self) -> str:
        return SCHEMA

    def _store(self) -> Store:
        o = self.options
        if not o.get("base"):
            raise ValueError("option base: the address of the store")
        return Store(o["base"], o.get("token"), int(o.get("tries", TRIES)), float(o.get("wait", WAIT)))

    def _list(self, option: str, otherwise: str) -> list[str]:
        return [x for x in self.options.get(option, otherwise).split(",")]

    def reader(self, schema: StructType) -> Reader:
        return Reader(self._store(), self._list("prefixes", ""), [s for s in self._list("splits", "") if s], self.options.get("committed"))

    def streamReader(self, schema: StructType) -> StreamReader:  # noqa: N802
        return StreamReader(self._store(), int(self.options.get("per_task", PAGE)))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("blobs are only added: use mode append")
        return Writer(self._store(), self._named(), f"{time.time_ns():020d}")

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:  # noqa: N802
        return StreamWriter(self._store(), self._named())

    def _named(self) -> str:
        if not self.options.get("name"):
            raise ValueError("option name: under which readers find what is written")
        return self.options["name"]


def register(spark: SparkSession) -> None:
    """Make ``blobs`` a format of the session, and let Spark hand filters to such sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BlobSource)


def suffixed(path: str, run: str, body: bytes) -> str:
    """``path`` with 32 hexadecimal digits of run and content before its extension."""
    made = hashlib.sha256(run.encode() + b"\x1f" + hashlib.sha256(body).hexdigest().encode()).hexdigest()[:32]
    folder, _, name = path.rpartition("/")
    stem, dot, extension = name.rpartition(".")
    name = f"{stem}-{made}.{extension}" if dot and stem else f"{name}-{made}"
    return f"{folder}/{name}" if folder else name


def suffixed_column(path: Column, run: Column, body: Column) -> Column:
    """``suffixed`` as an expression, of bytes ``body``."""
    made = F.substring(F.sha2(F.concat(run, F.lit("\x1f"), F.sha2(body, 256)).cast("binary"), 256), 1, 32)
    parts = F.regexp_extract(path, r"(?s)^(.*/)?([^/]*)$", 1), F.regexp_extract(path, r"(?s)^(.*/)?([^/]*)$", 2)
    stem = F.regexp_extract(parts[1], r"(?s)^(.+)(\.[^.]*)$", 1)
    return F.concat(parts[0], F.when(stem == "", F.concat(parts[1], F.lit("-"), made)).otherwise(F.concat(stem, F.lit("-"), made, F.regexp_extract(parts[1], r"(?s)^(.+)(\.[^.]*)$", 2))))


def with_bodies(files: DataFrame, token: str | None = None, url_col: str = "storage_url", data_col: str = "file_data", tries: int = TRIES, wait: float = WAIT) -> DataFrame:
    """``files`` with content and body_error: what the address gives, else the inline data.

    Only rows with an address go through Python, each body read in its task and once. A
    row without either, with an answer that isn't a success, or with inline data that is no
    address of data has an error and no content; the job goes on.
    """
    inline = C.data_uri_bytes(data_col)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store("", token, tries, wait)
        for batch in batches:
            urls = batch.column(batch.schema.get_field_index("_url"))
            for i, url in enumerate(urls.to_pylist()):
                try:
                    body, error = store.request("GET", url), None
                except (BlobError, ValueError) as e:
                    body, error = None, str(e)
                # a batch for each row: bodies are large, what is read is passed on
                own = batch.slice(i, 1).drop_columns(["_url"])
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array([body], pa.binary()), pa.array([error], pa.string())], [*own.schema.names, "content", "body_error"])

    rows = files.drop("content", "body_error")
    blob = F.coalesce(F.col(url_col), F.lit("")) != ""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    fetched = rows.filter(blob).withColumn("_url", F.col(url_col)).mapInArrow(fetch, f"{kinds}, content binary, body_error string")
    given = F.coalesce(F.col(data_col), F.lit("")) != ""
    error = F.when(~given, "No source payload available for ingestion").when(inline.isNull(), "Invalid data URI content")
    return fetched.unionByName(rows.filter(~blob).withColumns({"content": F.when(given, inline), "body_error": error}))
