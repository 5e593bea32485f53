"""Chunks in versions: replaced as a whole, seen as a whole, by several writers and readers.

A version is a small list that names a folder of Parquet files for each bucket of keys.
Writers put the buckets that they change into a folder of their own and then claim the next
version's name, which only one can get; who comes second looks at what the first has
changed, merges again only if it touched the same buckets, and claims the next. Readers pin
the version that they begin with. A run that breaks off has changed nothing. A claim is a
rename that must not overwrite: it decides as safely as the file system's does.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Files of versions that a writer tries to claim before it gives up.
TRIES = 50
_LISTS = "_versions"


class Conflict(RuntimeError):
    """Others were faster, again and again."""


class _Folder:
    """The files of a table, in any file system that Spark reads, with exclusive creation."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.files = self.at().getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def names(self, *parts: str) -> list[tuple[str, int]]:
        """Names in a folder with the time of their last change in seconds."""
        place = self.at(*parts)
        return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in self.files.listStatus(place)] if self.files.exists(place) else []

    def text(self, *parts: str) -> str:
        stream = self.files.open(self.at(*parts))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def claim(self, text: str, *parts: str) -> bool:
        """Create a file with ``text`` unless there is one; it appears whole or not at all."""
        place, made = self.at(*parts), self.at(_LISTS, f".{uuid.uuid4().hex}")
        stream = self.files.create(made, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if self.files.exists(place):
                return False
            # renaming onto a file fails: it is the one step that decides
            contexts = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self.files.getConf())
            none = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
            contexts.rename(made, place, none)
            return True
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            if self.files.exists(made):
                self.files.delete(made, False)

    def remove(self, *parts: str) -> None:
        self.files.delete(self.at(*parts), True)


def _version(folder: _Folder, number: int | None = None) -> tuple[int, dict]:
    """Number and list of a version, the latest if none is named; 0 is the empty one."""
    known = sorted(int(n) for n, _ in folder.names(_LISTS) if n.isdigit())
    number = (known[-1] if known else 0) if number is None else number
    if not number:
        return 0, {"buckets": {}, "schema": None, "of": None, "tags": {}}
    return number, json.loads(folder.text(_LISTS, f"{number:012d}"))


def latest(spark: SparkSession, path: str) -> int:
    return _version(_Folder(spark, path))[0]


def tags(spark: SparkSession, path: str) -> dict[str, int]:
    """What the latest version's writers have said, by name: the last batch of a stream, say."""
    return _version(_Folder(spark, path))[1]["tags"]


def _rows(spark: SparkSession, folder: _Folder, found: dict, buckets: list[str] | None = None) -> DataFrame | None:
    places = [f"{folder.path}/{found['buckets'][b]}" for b in (found["buckets"] if buckets is None else buckets) if b in found["buckets"]]
    return spark.read.schema(StructType.fromJson(found["schema"])).parquet(*places) if places else None


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version. The answer stays the same while others write, and it may be
    read again and again until ``clear`` removes the version."""
    number, found = _version(_Folder(spark, path), version)
    if not number:
        raise FileNotFoundError(f"{path} has no version")
    rows = _rows(spark, _Folder(spark, path), found)
    return spark.createDataFrame([], StructType.fromJson(found["schema"])) if rows is None else rows


def replace(rows: DataFrame, path: str, key: str = "file_id", keys: DataFrame | None = None, buckets: int = 64, tries: int = TRIES, tags: dict[str, int] | None = None) -> int:
    """Put ``rows`` in place of all that the table has of their keys; the new version's number.

    ``keys``: a table with ``key`` whose rows go too, also of keys without new rows. Only
    buckets that have such keys are written, each with the rest of its old rows. Rows with a
    null key are added and never replaced. The number of buckets is that of the first
    version. ``tags`` become part of the version, with those of the versions before. Raises ``Conflict`` after ``tries`` claims that others won; whatever is raised,
    the table is as if this run had not been.
    """
    spark, run = rows.sparkSession, uuid.uuid4().hex
    folder = _Folder(spark, path)
    number, found = _version(folder)
    of = found["of"] or buckets
    bucket = F.pmod(F.xxhash64(key), F.lit(of)).cast("int")
    try:
        rows.withColumn("_bucket", bucket).write.partitionBy("_bucket").parquet(f"{folder.path}/data/{run}/new")
        new = spark.read.schema(StructType([*rows.schema.fields, *StructType.fromDDL("_bucket int").fields])).parquet(f"{folder.path}/data/{run}/new")
        gone = new.select(key)
        if keys is not None:
            keys.select(key).write.parquet(f"{folder.path}/data/{run}/keys")
            gone = gone.unionByName(spark.read.schema(keys.select(key).schema).parquet(f"{folder.path}/data/{run}/keys"))
        gone = gone.distinct()
        touched = sorted(str(r[0]) for r in gone.select(bucket).distinct().collect())  # as many as there are buckets
        seen, made = None, {}
        for n in range(tries):
            if seen is None or any(seen.get(b) != found["buckets"].get(b) for b in touched):
                made = {}
                old = _rows(spark, folder, found, touched)
                merged = new if old is None else new.unionByName(old.join(gone, key, "left_anti").withColumn("_bucket", bucket), allowMissingColumns=True)
                at = f"data/{run}/{n}"
                merged.write.partitionBy("_bucket").parquet(f"{folder.path}/{at}")
                made = {name.partition("=")[2]: f"{at}/{name}" for name, _ in folder.names(at) if name.startswith("_bucket=")}
                seen = found["buckets"]
            schema = json.loads(merged.drop("_bucket").schema.json())
            whole = {b: p for b, p in found["buckets"].items() if b not in touched} | made
            if folder.claim(json.dumps({"buckets": whole, "schema": schema, "of": of, "tags": found["tags"] | (tags or {})}), _LISTS, f"{number + 1:012d}"):
                folder.remove("data", run, "new")
                folder.remove("data", run, "keys")
                return number + 1
            number, found = _version(folder)
            if found["of"] != of:
                raise Conflict("another writer began the table with other buckets")
        raise Conflict(f"{tries} versions were claimed by others")
    except BaseException:
        folder.remove("data", run)
        raise


def clear(spark: SparkSession, path: str, keep: int = 2, older_than: float = 86400.0) -> list[int]:
    """Remove versions but the last ``keep``, and folders that no version left names.

    Only what was last changed ``older_than`` seconds ago goes, which must be longer than
    any writer or reader takes; the numbers of the removed versions.
    """
    folder, now = _Folder(spark, path), time.time()
    known = sorted((int(n), t) for n, t in folder.names(_LISTS) if n.isdigit())
    old = [n for n, t in known[: -keep or None] if now - t >= older_than]
    for n in old:
        folder.remove(_LISTS, f"{n:012d}")
    used = {p.split("/")[1] for n, _ in known if n not in old for p in _version(folder, n)[1]["buckets"].values()}
    for run, t in folder.names("data"):
        if run not in used and now - t >= older_than:
            folder.remove("data", run)
    return old
