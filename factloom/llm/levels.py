"""Levelled sorted runs that a later call can open again.

A family is a folder with runs and a list of them. A run is a bucketed table, sorted by the key within its buckets, so
that runs are merged, and batches joined with them, bucket by bucket, without a shuffle of what is stored. Level n
holds fewer than `fanout` runs of about fanout**n batches; a full level is merged into one run of the next.

The list is written anew, as one more version, after each change; a family whose job fails opens as it was before.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.arrow_rows import drop_folder, file_system, shared_folder


class Levels:
    def __init__(self, spark: SparkSession, key: str, folder: str | None = None, fanout: int = 2):
        """folder: where the family is, or begins; without it a fresh one in the shared folder."""
        self.spark, self.key, self.fanout = spark, key, fanout
        self.folder = (folder or shared_folder(spark, "levels")).rstrip("/")
        #: (level, name of the run)
        self.runs: list[tuple[int, str]] = []
        fs, path = file_system(spark, self.folder)
        self.version = 0
        if fs.exists(path):
            names = [s.getPath().getName() for s in fs.listStatus(path)]
            found = sorted(int(m[1]) for n in names if (m := re.fullmatch(r"list-(\d+)", n)) and fs.exists(file_system(spark, f"{self.folder}/{n}/_SUCCESS")[1]))
            if found:
                self.version = found[-1]
                self.runs = [(r["level"], r["name"]) for r in spark.read.schema("level int, name string, place int").json(f"{self.folder}/list-{self.version}").orderBy("place").collect()]

    def table(self, name: str) -> DataFrame:
        """A run as a bucketed table, made known to this session's catalogue if it is not."""
        if not self.spark.catalog.tableExists(name):
            buckets = int(name.rsplit("_", 1)[1])
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(f"{self.folder}/{name}").schema)
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) INTO {buckets} BUCKETS LOCATION '{self.folder}/{name}'")
        return self.spark.table(name)

    def tables(self) -> list[DataFrame]:
        """The runs, the smallest first."""
        return [self.table(name) for _, name in sorted(self.runs)]

    def add(self, rows: DataFrame) -> None:
        """Put rows in as a run of level 0. Full levels are merged by compact(), which is called before the next rows are made from the runs."""
        self.runs.append((0, self._write(rows)))
        self._save()

    def compact(self, merge: Callable[[DataFrame, DataFrame], DataFrame], all_runs: bool = False) -> None:
        """Merge full levels, or all runs into one, two runs at a time."""
        while True:
            numbers = [n for n, _ in self.runs]
            full = [n for n in sorted(set(numbers)) if numbers.count(n) >= self.fanout]
            if all_runs and len(self.runs) > 1:
                own, level = sorted(self.runs)[:2], max(numbers)
            elif full:
                own, level = [r for r in self.runs if r[0] == full[0]], full[0] + 1
            else:
                return
            # of more than two runs, what two of them make is no run of the family yet
            names, made = [name for _, name in own], None
            for name in names[1:]:
                before, made = made, self._write(merge(self.table(made or names[0]), self.table(name)))
                if before:
                    self._drop(before)
            self.runs = [r for r in self.runs if r not in own] + [(level, made)]
            self._save()
            for name in names:
                self._drop(name)

    def close(self) -> None:
        """Delete the family."""
        for _, name in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop_folder(self.spark, self.folder)
        self.runs = []

    def _write(self, rows: DataFrame) -> str:
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"run_{uuid.uuid4().hex}_{buckets}"
        rows.write.bucketBy(buckets, self.key).sortBy(self.key).option("path", f"{self.folder}/{name}").format("parquet").saveAsTable(name)
        return name

    def _save(self) -> None:
        rows = [(level, name, place) for place, (level, name) in enumerate(self.runs)]
        self.spark.createDataFrame(rows, "level int, name string, place int").coalesce(1).write.json(f"{self.folder}/list-{self.version + 1}")
        self.version += 1
        if self.version > 2:
            drop_folder(self.spark, f"{self.folder}/list-{self.version - 2}")

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop_folder(self.spark, f"{self.folder}/{name}")


def merged_by(key: str, **columns: Callable) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A merge of two runs of one row a key: columns that both have are united by the given functions of two columns (null where a run has no row)."""

    def merge(a: DataFrame, b: DataFrame) -> DataFrame:
        left, right = (x.select(F.col(key).alias(f"{side}_key"), *[F.col(c).alias(f"{side}_{c}") for c in columns]) for x, side in ((a, "a"), (b, "b")))
        both = left.hint("merge").join(right, F.col("a_key") == F.col("b_key"), "full")
        return both.select(F.coalesce("a_key", "b_key").alias(key), *[f(F.col(f"a_{c}"), F.col(f"b_{c}")).alias(c) for c, f in columns.items()])

    return merge
