"""Tables between the stages of a job, in the folder that all executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir; where that is unset, on a local master only, under a temporary one that is set for the session."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="spark-stages-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Folders of the stages that stand, for scope().
_STANDING: list[str] = []


def standing_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for a table that stands until drop() or the end of a scope()."""
    path = shared_folder(spark, name)
    _STANDING.append(path)
    return path


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written inside needs its shuffles no more: Spark removes their files at the end of the write, so that disk holds those of one stage of a job, not of all."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written and read back: lineage is cut, and a lost executor costs no more than a re-read. The table stays until drop() or the end of a scope()."""
    path = standing_folder(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitioned(df: DataFrame, by: str, name: str) -> DataFrame:
    """As stored, with a folder for each value of a column, so that one of them is read alone."""
    path = standing_folder(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.repartition(by).write.partitionBy(by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Remove the tables of stored() that df reads; nothing else."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if re.search(r"-[0-9a-f]{32}$", folder):
            _remove(df.sparkSession, folder)
            _STANDING[:] = [p for p in _STANDING if p.rsplit("/", 1)[-1] != folder.rsplit("/", 1)[-1]]


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored inside are removed at the end; results that are wanted beyond it must be written elsewhere before."""
    before = set(_STANDING)
    try:
        yield
    finally:
        for path in [p for p in _STANDING if p not in before]:
            _remove(spark, path)
            _STANDING.remove(path)


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
