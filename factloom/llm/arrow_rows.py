"""Small helpers shared by the operators that run Python inside Spark tasks."""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value of the contracts: A-Z to a-z, all other bytes as they are.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Fixed value of the contracts: the white space that separates words, `[\x20\x09-\x0D]`.
SPACES = b" \t\n\x0b\x0c\r"

#: Arrow bytes that a Python function gets at once.
SLICE_BYTES = 3 << 20
#: Arrow bytes that Spark sends to a Python worker at once.
BATCH_BYTES = 8 << 20


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null becomes empty), so that other columns neither travel nor clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def map_rows(df: DataFrame, fn: Callable[[list[list]], list], schema: str, keep: list[str] | None = None, arrow: bool = False, read: list[str] | None = None) -> DataFrame:
    """Run fn(list of column lists) -> list of columns (lists or Arrow arrays) over each Arrow batch of df.

    schema: fn's columns, one row out for each row in. keep: columns of df that go before them as they are. read: the
    columns that fn gets (if not given, those that are not kept). arrow: fn gets Arrow arrays instead of lists. Batches are handed over in slices of about
    SLICE_BYTES, so that long texts do not multiply in the worker's memory.
    """
    bound_batches(df.sparkSession)
    keep = keep or []
    names = read or [n for n in df.columns if n not in keep]
    made = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = fn([part.column(n) if arrow else part.column(n).to_pylist() for n in names])
            kept = [part.column(n) for n in keep]
            yield pa.RecordBatch.from_arrays(
                kept + [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(out, made, strict=True)],
                names=keep + made.names,
            )

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep]
    kept.sort(key=lambda x: keep.index(x.split("`")[1]))
    return df.mapInArrow(run, ", ".join([*kept, schema]))


def whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """All of a partition's rows; None where there are none."""
    found = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(found) if found else None


def bound_batches(spark: SparkSession) -> None:
    """Have Spark cut its Arrow batches by bytes too, not by rows alone: the session's setting is lowered for good; a smaller limit of the user's stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)([bkmgtp]?)b?", spark.conf.get(name).strip().lower()).groups()
    if not 0 < int(number) << 10 * "bkmgtp".index(unit or "b") <= BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def slices(batches: Iterator[pa.RecordBatch], slice_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.num_rows
        step = max(1, min(rows, int(rows * slice_bytes / max(1, batch.nbytes)))) if rows else 1
        for at in range(0, rows, step):
            yield batch.slice(at, step)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the checkpoint folder that the cluster names; where none is, one is set on a local master only."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        base = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if not base and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="spark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, sort_by: str | None = None) -> DataFrame:
    """df written to the shared folder and read back: lineage is cut and lost executors cost no more than a re-read."""
    path = shared_folder(df.sparkSession, name)
    (df.sortWithinPartitions(sort_by) if sort_by else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Remove a table that stored() wrote, through the file system of its path."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if re.search(r"-[0-9a-f]{32}$", folder):
            drop_folder(df.sparkSession, folder)


def drop_folder(spark: SparkSession, folder: str) -> None:
    fs, path = file_system(spark, folder)
    fs.delete(path, True)


def file_system(spark: SparkSession, folder: str):
    """The file system of a folder, and the folder's path in it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def free_name(name: str, *tables: DataFrame) -> str:
    """name, with underlines until none of the tables has such a column."""
    while any(name.lower() == c.lower() for t in tables for c in t.columns):
        name += "_"
    return name
