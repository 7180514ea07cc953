"""Graphs in plain files with atomic versions.

A graph is a folder: data files by bucket of the rows' ids, and one list of files for each version. A writer adds data files,
which nobody sees yet, and publishes a list that names them, under the next version's name, by an operation that fails where the name
is taken: a hard link on local files, a rename without replacement on HDFS. So of two writers that read one version the
second fails, and a writer that dies leaves nothing that is read. A change rewrites only the buckets that its rows fall into.

Object stores whose renames replace what is there give no such promise; they are refused.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: File systems whose way of publishing is known to be exclusive.
EXCLUSIVE = ("file", "hdfs", "viewfs")


class StaleVersion(RuntimeError):
    """Another writer has published a version since the one that was read."""


@dataclass
class Version:
    """One list of files: by table the schema, and by bucket the folder that holds its rows."""

    number: int
    buckets: int
    schemas: dict[str, str]
    folders: dict[str, dict[str, str]]
    counts: dict[str, int]
    updated_at: str | None = None


class GraphFiles:
    """The tables (each with an id) of one graph below a folder."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        if (scheme := self._fs(self.folder)[0].getUri().getScheme()) not in EXCLUSIVE:
            raise ValueError(f"versions cannot be published exclusively on {scheme}")

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def versions(self) -> list[int]:
        fs, path = self._fs(f"{self.folder}/versions")
        return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(path) if s.getPath().getName()[:1] == "v") if fs.exists(path) else []

    def version(self, number: int | None = None) -> Version:
        """A version's list; the latest if no number is given, 0 without any rows if there is none."""
        there = self.versions()
        number = (there[-1] if there else 0) if number is None else number
        if number == 0:
            return Version(0, self.buckets, {}, {}, {})
        if number not in there:
            raise KeyError(f"no version {number}")
        return Version(**json.loads(self.spark.read.text(f"{self.folder}/versions/v{number:020d}", wholetext=True).first()[0]))

    def read(self, name: str, number: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a table in a version, or in some of its buckets."""
        version = self.version(number)
        if name not in version.schemas:
            raise KeyError(f"no table {name}")
        schema = StructType.fromJson(json.loads(version.schemas[name]))
        paths = [f"{self.folder}/data/{f}" for b, f in version.folders[name].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def save(self, expected: int, now: str | None = None, remove: dict[str, DataFrame] | None = None, **rows: DataFrame) -> dict[str, int]:
        """Put rows in the place of those of equal ids, take out the ids of remove, and publish version expected + 1; raises StaleVersion if that is taken.

        Returns version, and for each table <name>_count, and how many buckets and rows were written (<name>_buckets, <name>_written).
        """
        before = self.version(expected) if expected else Version(0, self.buckets, {}, {}, {})
        if (self.versions() or [0])[-1] != expected:
            raise StaleVersion(f"version {expected} is not the latest")
        after = Version(expected + 1, before.buckets, dict(before.schemas), {k: dict(v) for k, v in before.folders.items()}, dict(before.counts), now)
        folder, out = uuid.uuid4().hex, {"version": expected + 1}
        bucket = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(before.buckets)).cast("int")
        try:
            for name in {*rows, *(remove or {})}:
                new, gone = rows.get(name), (remove or {}).get(name)
                ids = [df.select(F.col("id").cast("string").alias("id")) for df in (new, gone) if df is not None]
                ids = ids[0] if len(ids) == 1 else ids[0].union(ids[1])
                touched = sorted(r["b"] for r in ids.select(bucket.alias("b")).distinct().collect())
                there = name in before.schemas
                kept = self.read(name, expected, touched).join(ids.withColumnRenamed("id", "__id").distinct(), F.col("id").cast("string") == F.col("__id"), "left_anti") if there else None
                whole = kept if new is None else new if kept is None else kept.unionByName(new)
                if whole is None:
                    continue
                after.schemas[name] = whole.schema.json() if not there else before.schemas[name]
                old = self.read(name, expected, touched).count() if there else 0
                path = f"{self.folder}/data/{folder}/{name}"
                whole.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(path)
                fs, at = self._fs(path)
                made = {int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(at) if "=" in s.getPath().getName()}
                folders = {b: f for b, f in after.folders.get(name, {}).items() if int(b) not in touched}
                after.folders[name] = folders | {str(b): f"{folder}/{name}/bucket={b}" for b in made}
                written = self.spark.read.parquet(path).count() if made else 0
                after.counts[name] = before.counts.get(name, 0) - old + written
                out |= {f"{name}_count": after.counts[name], f"{name}_buckets": len(touched), f"{name}_written": written}
            self._publish(after)
        except BaseException:
            fs, at = self._fs(f"{self.folder}/data/{folder}")
            fs.delete(at, True)
            raise
        return out

    def _publish(self, version: Version) -> None:
        fs, draft = self._fs(f"{self.folder}/drafts/{uuid.uuid4().hex}")
        _, name = self._fs(f"{self.folder}/versions/v{version.number:020d}")
        fs.mkdirs(name.getParent())
        stream = fs.create(draft, False)
        stream.write(json.dumps(version.__dict__).encode())
        stream.close()
        try:
            if fs.getUri().getScheme() == "file":
                files, get = self.spark.sparkContext._jvm.java.nio.file.Files, self.spark.sparkContext._jvm.java.nio.file.Paths.get
                try:
                    files.createLink(get(name.toUri().getPath(), self._strings()), get(draft.toUri().getPath(), self._strings()))
                except Exception as e:
                    if "FileAlreadyExists" in str(e):
                        raise StaleVersion(f"version {version.number} is there already") from None
                    raise
            elif not fs.rename(draft, name):
                raise StaleVersion(f"version {version.number} is there already")
        finally:
            fs.delete(draft, False)

    def _strings(self):
        gateway = self.spark.sparkContext._gateway
        return gateway.new_array(gateway.jvm.java.lang.String, 0)

    def forget(self, keep: int = 2) -> int:
        """Remove all but the last versions, and the data folders that no version left names; how many folders went. For times without writers."""
        there = self.versions()
        for number in there[:-keep]:
            fs, path = self._fs(f"{self.folder}/versions/v{number:020d}")
            fs.delete(path, False)
        used = {f.split("/bucket=")[0] for n in there[-keep:] for by in self.version(n).folders.values() for f in by.values()}
        fs, data = self._fs(f"{self.folder}/data")
        gone = 0
        for writer in fs.listStatus(data) if fs.exists(data) else []:
            for table in fs.listStatus(writer.getPath()):
                if f"{writer.getPath().getName()}/{table.getPath().getName()}" not in used:
                    fs.delete(table.getPath(), True)
                    gone += 1
        return gone
