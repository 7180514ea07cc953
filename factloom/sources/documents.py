"""Document sets: files and admission rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.text import base_name, content_id

# Which files are documents, and how much one upload may hold.
SUFFIXES = ("txt", "md", "pdf", "docx")
MAX_FILE, MAX_FILES, MAX_TOTAL = 20 * 1024 * 1024, 200, 200 * 1024 * 1024


def read_files(spark: SparkSession, *paths: str, parsers: dict | None = None) -> DataFrame:
    """doc_id, source, name, text of the document files under paths.

    Text and Markdown are decoded by Spark. parsers: by suffix a function from bytes to text for other formats (those
    without one are left out); it runs in Arrow batches.
    """
    pattern = "*.{" + ",".join(f"{s},{s.upper()}" for s in SUFFIXES) + "}"
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    files = reduce(DataFrame.unionByName, [read.load(p) for p in paths]).select("path", "content").withColumn("suffix", F.lower(F.substring_index("path", ".", -1)))
    common = [content_id(F.col("content")).alias("doc_id"), F.col("path").alias("source"), base_name(F.col("path")).alias("name")]
    out = files.where(F.col("suffix").isin("txt", "md")).select(*common, decoded(F.col("content")).alias("text"))
    for suffix, parse in (parsers or {}).items():
        parsed = F.pandas_udf(lambda content, parse=parse: content.map(parse), "string")
        out = out.unionByName(files.where(F.col("suffix") == suffix).select(*common, parsed("content").alias("text")))
    return out


def decoded(content):
    """UTF-8 bytes as text, without a byte order mark."""
    return F.regexp_replace(F.decode(content, "UTF-8"), "^﻿", "")


def one_per_content(docs: DataFrame) -> DataFrame:
    """One row for each content id: reading a file twice does not count twice."""
    return docs.dropDuplicates(["doc_id"])


def admit(files: DataFrame, max_file: int = MAX_FILE, max_files: int = MAX_FILES, max_total: int = MAX_TOTAL) -> DataFrame:
    """files (batch, pos, name, bytes) with the reason why each is refused, null where it is admitted.

    Files are taken in the order of pos within their batch; the limits are those of one batch.
    """
    order = W.partitionBy("batch").orderBy("pos")
    suffix = F.lower(F.substring_index("name", ".", -1))
    alone = F.when(~suffix.isin(*SUFFIXES) | ~F.col("name").contains("."), "unsupported").when(F.coalesce("bytes", F.lit(0)) <= 0, "empty").when(F.col("bytes") > max_file, "too large")
    rows = files.withColumn("reason", alone)
    fine = F.col("reason").isNull().cast("long")
    count = F.sum(fine).over(order.rowsBetween(W.unboundedPreceding, 0))
    total = F.sum(F.when(F.col("reason").isNull(), F.col("bytes")).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0))
    return rows.select("*", count.alias("__n"), total.alias("__total")).select(
        *files.columns, F.coalesce("reason", F.when(F.col("__n") > max_files, "too many").when(F.col("__total") > max_total, "too much")).alias("reason")
    )
