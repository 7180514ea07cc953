"""Line deduplication with levelled sorted runs of line hashes.

A line's key is the line stripped of `[\\x20\\x09-\\x0D]` at both ends, A-Z lower-cased. Each batch of documents is
merge-anti-joined with the runs that are there, which tells lines that are new from lines that some earlier batch had,
and adds its own run, sorted by key hash: (hash, number of documents, largest doc_id, whether it was new). Full levels
are compacted into the next. At the end most lines are new ones that no later batch had; only keys that some run has as
known, or that are frequent in one run by itself, are counted over all runs. The runs are a family of levels (levels.py) that a later call can open and go on with.

Whether a line goes depends on documents of every batch (their number, and the largest id), so documents are rewritten
once all batches are in.

Null and empty texts are one empty line. Documents without an id are not counted and keep their lines. Rows that share
an id are one document: they count once and are treated alike; they have to come in one batch. Hashes have 128 bits.
"""

from __future__ import annotations

from functools import reduce

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.arrow_rows import ASCII_LOWER, SPACES, drop_folder, drop_stored, free_name, map_rows, shared_folder, stored
from factloom.llm.levels import Levels, merged_by

#: A key is hot if it has more rows than this, and more than one in so many of all rows: at most HOT_SHARE keys of 16 bytes, which are broadcast.
HOT_ROWS, HOT_SHARE = 10_000, 1_000_000
_STRIP = SPACES.decode()


def line_key(line: str, min_chars: int) -> bytes | None:
    """The 16-byte hash of a line's key; None if the key is shorter than min_chars code points."""
    key = line.strip(_STRIP)
    return xxhash.xxh3_128_digest(key.encode().translate(ASCII_LOWER)) if len(key) >= min_chars else None


def line_keys(docs: DataFrame, min_chars: int, batches: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, batch: the distinct line keys of each document."""

    def run(cols):
        return [[list({k for line in text.split("\n") if (k := line_key(line, min_chars))}) if len(text) >= min_chars else [] for text in cols[0]]]

    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = map_rows(source, run, "keys array<binary>", keep=["doc_id"])
    return rows.select("doc_id", F.explode("keys").alias("key"), F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"))


class LineRuns:
    """Levels of sorted runs of (key, n_docs, last_doc, new); folder: of a family to go on with."""

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = 2):
        self.levels = Levels(spark, "key", folder, fanout)

    def add(self, keys: DataFrame) -> None:
        """Merge full levels, then put a batch's keys (doc_id, key) in: a document counts once for a key."""
        self.levels.compact(merge_runs)
        batch = keys.groupBy("key").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        found = F.lit(False)
        for k, run in enumerate(self.levels.tables()):
            batch = batch.hint("merge").join(run.select("key", F.lit(True).alias(f"in_{k}")), "key", "left")
            found = found | F.coalesce(f"in_{k}", F.lit(False))
        self.levels.add(batch.select("key", "n_docs", "last_doc", (~found).alias("new")))

    def frequent(self, min_docs: int) -> DataFrame | None:
        """key, n_docs, last_doc of the keys of at least min_docs documents; None without runs.

        A key that no run has as known stands in one run only, so its documents are all in that row; the others, which the anti-joins
        told, are summed up over the runs.
        """
        runs = self.levels.tables()
        if not runs:
            return None
        union = lambda parts: reduce(DataFrame.unionByName, parts)
        columns = ("key", "n_docs", "last_doc")
        known = stored(union([r.where(~F.col("new")).select("key") for r in runs]).distinct(), "line-known")
        met = union([r.select(*columns).join(known.hint("merge"), "key").withColumn("sum", F.col("n_docs")) for r in runs])
        alone = union([r.where(F.col("new") & (F.col("n_docs") >= min_docs)).select(*columns).withColumn("sum", F.lit(None).cast("long")) for r in runs])
        summed = met.unionByName(alone).groupBy("key").agg(F.coalesce(F.sum("sum"), F.max("n_docs")).alias("n_docs"), F.max("last_doc").alias("last_doc"))
        out = stored(summed.where(F.col("n_docs") >= min_docs), "line-frequent")
        drop_stored(known)
        return out


#: The merge join of two runs. A key has its documents counted over both, and was new in one of them.
merge_runs = merged_by(
    "key", n_docs=lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), last_doc=F.greatest,
    new=lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)),
)


def new_lines(runs: LineRuns, keys: DataFrame) -> DataFrame:
    """The keys (doc_id, key) of a batch, before it is added, that no earlier batch had."""
    for run in runs.levels.tables():
        keys = keys.join(run.hint("merge"), "key", "left_anti")
    return keys


def dropped_lines(keys: DataFrame, frequent: DataFrame) -> DataFrame:
    """Of keys (doc_id, key), those that are frequent (key, n_docs, last_doc) and stand in another document than the last.

    Hot keys are few by their share of the rows; they are broadcast, so no task gets all rows of one.
    """
    rows = keys.count()
    bound = max(HOT_ROWS, rows // HOT_SHARE)
    hot = frequent.where(F.col("n_docs") > bound).select("key", "last_doc")
    other = frequent.where(F.col("n_docs") <= bound).select("key", "last_doc")
    light = keys.join(F.broadcast(hot.select("key")), "key", "left_anti").join(other.hint("merge"), "key")
    return keys.join(F.broadcast(hot), "key").unionByName(light).where(F.col("doc_id") != F.col("last_doc")).select("doc_id", "key")


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 2, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """docs with the text rewritten, and n_lines, n_dropped (long; they replace columns of those names).

    Lines whose key stands in at least min_docs documents are dropped everywhere but in the largest id. folder: of a
    family of runs (an earlier call's, or to begin); docs are then added to it, lines of documents of earlier calls
    count too, and the family stays. Shuffles: the 16-byte keys, and the texts once, by id.
    """
    spark = docs.sparkSession
    path = shared_folder(spark, "line-keys")
    keys = line_keys(docs, min_chars, batches, id_col, text_col)
    keys.write.partitionBy("batch").parquet(path)
    keys = spark.read.schema(keys.schema).parquet(path)
    runs = LineRuns(spark, folder, fanout)
    for b in range(batches):
        runs.add(keys.where(F.col("batch") == b).select("doc_id", "key"))
    frequent = runs.frequent(min_docs)
    if folder is None:
        runs.levels.close()
    dropped = free_name("__gone", docs)
    gone = stored(dropped_lines(keys.select("doc_id", "key"), frequent).groupBy(F.col("doc_id").alias(id_col)).agg(F.collect_set("key").alias(dropped)), "line-gone")
    drop_stored(frequent)
    drop_folder(spark, path)
    taken = {"n_lines", "n_dropped"}
    source = docs.select([c for c in docs.columns if c not in taken])
    keep = [c for c in source.columns if c != text_col]
    # a merge join at every size: the plan of a small table is the plan of a large one
    source = source.join(gone.hint("merge"), id_col, "left").select(*keep, text_col, dropped)

    def run(cols):
        texts, gones = cols
        kept, n_lines, n_dropped = [], [], []
        for text, gone in zip(texts, gones, strict=True):
            lines = (text or "").split("\n")
            n_lines.append(len(lines))
            if gone:
                hit = set(gone)
                rest = [x for x in lines if line_key(x, min_chars) not in hit]
                n_dropped.append(len(lines) - len(rest))
                kept.append("\n".join(rest))
            else:
                n_dropped.append(0)
                kept.append(text)
        return [kept, n_lines, n_dropped]

    return map_rows(source, run, f"`{text_col}` string, n_lines long, n_dropped long", keep=keep)


def query(docs: DataFrame) -> DataFrame:
    out = line_dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, u.line, u.ord,
         translate(trim(u.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM documents, LATERAL (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS ord) u
), frequent AS (
  SELECT k, max(doc_id) AS last_doc FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.doc_id, l.line, l.ord, (f.k IS NOT NULL AND l.doc_id <> f.last_doc) AS gone
  FROM lines l LEFT JOIN frequent f ON l.k = f.k AND length(l.k) >= 20
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY ord) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
