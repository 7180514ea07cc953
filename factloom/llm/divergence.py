"""Source divergence audit: how far apart the term distributions of the sources of a language are, by count-level bitmaps.

Terms that stand in at least `least_docs` documents of a language are kept. Every group (lang, source) gives a kept
term of count c the probability p = 1 + floor(10^9 (c + 2) / (N + 2 V)), so p depends on the group and the count only: terms of one count
are one level. A level is a set of term ids, stored as words of 64 bits: (group, block of 64 terms, count, bits). The
cells that two groups have in common are AND plus popcount of their levels' words within a block; each cell's number
of terms is multiplied by f(p, q) = floor((p - q)^2 / (p + q)). Terms that one or both groups lack are counted by
complement: f enters the cells as f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0), levels' sizes as f(p, q0) - f(p0, q0),
and all V terms as f(p0, q0), where p0, q0 are the probabilities of count 0. Terms are numbered by falling frequency, so that a
block has few levels of any group.

Arithmetic is exact. Null text, lang and source count as ''. Documents are counted by row: repeated rows and null ids
count as they stand. A language without kept terms has value 0 for all pairs and no terms. An empty table has no rows.
Ties of value are ranked by the item's UTF-8 bytes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm.arrow_rows import ASCII_LOWER, bound_batches, drop_stored, slices, stored

#: Fixed value of the contract, on bytes: all but letters and bytes beyond ASCII separates terms.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: A task's table of counts is handed on when it has so many terms.
TERMS = 400_000
#: Rows of words that one task takes at once; a block's rows are never divided.
WORDS = 20_000
#: Groups up to which their table is broadcast.
GROUPS = 50_000


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: partial counts of occurrences and documents; a row with term '' for each group, even without terms."""
    bound_batches(docs.sparkSession)
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])

    def flushed(groups: dict) -> pa.RecordBatch:
        langs, sources, terms, ns, ds = [], [], [], [], []
        for (lang, source), (occurrences, documents) in groups.items():
            own = ["", *(t.decode() for t in occurrences)]
            terms += own
            ns += [0, *occurrences.values()]
            ds += [0, *(documents[t] for t in occurrences)]
            langs += [lang] * len(own)
            sources += [source] * len(own)
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(terms, pa.string()), pa.array(ns, pa.int64()), pa.array(ds, pa.int64())], names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict = {}
        for part in slices(batches):
            for lang, source, text in zip(*(part.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                terms = TERM.findall(text.encode().translate(ASCII_LOWER))
                occurrences, documents = groups.setdefault((lang, source), (Counter(), Counter()))
                occurrences.update(terms)
                documents.update(set(terms))
            if sum(len(o) for o, _ in groups.values()) >= TERMS:
                yield flushed(groups)
                groups = {}
        if groups:
            yield flushed(groups)

    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_terms(docs: DataFrame, least_docs: int = 10) -> DataFrame:
    """lang, term, n (occurrences in the language), cells array<struct<source, n>>; the row with term '' has all sources of the language.

    One shuffle by (lang, term), which both sums use.
    """
    by_term = term_counts(docs).repartition("lang", "term")
    by_cell = by_term.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    rows = by_cell.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("cells"))
    return rows.where((F.col("docs") >= least_docs) | (F.col("term") == "")).select("lang", "term", "n", "cells")


def probability(n: str, total: str):
    """1 + floor(10^9 (n + 2) / (total + 2 v)), in exact decimals; null where there are no terms."""
    return F.expr(f"1 + ((cast(1000000000 as decimal(18, 0)) * (cast({n} as decimal(18, 0)) + 2)) div nullif(cast({total} + 2 * v as decimal(20, 0)), 0))")


def distance(p: str, q: str):
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def group_table(kept: DataFrame) -> DataFrame:
    """lang, source, total, v (kept terms of the language), lang_total, p0."""
    langs = kept.groupBy("lang").agg(F.count_if(F.col("term") != "").alias("v"), F.sum("n").alias("lang_total"))
    groups = kept.select("lang", F.explode("cells").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("total"))
    return groups.join(langs, "lang").withColumn("p0", probability("0", "total"))


def bitmap_words(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, block, source, p, p0, bits: the levels of every group, 64 terms a block."""
    order = ("lang", F.desc("n"), "term")
    numbered = kept.where("term <> ''").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())
    cells = numbered.select("lang", "id", F.explode("cells").alias("c")).select("lang", "c.source", F.expr("shiftright(id, 6)").alias("block"), "c.n", F.expr("shiftleft(1L, cast(id & 63 as int))").alias("bit"))
    words = cells.groupBy("lang", "source", "block", "n").agg(F.bit_or("bit").alias("bits"))
    return words.join(groups, ["lang", "source"]).select("lang", "block", "source", probability("n", "total").alias("p"), "p0", "bits")


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def block_cells(source: np.ndarray, p: np.ndarray, p0: np.ndarray, bits: np.ndarray, total: np.ndarray, tile: int = 1024) -> None:
    """Add to total[source, source] the joint cells of one block: AND and popcount of its levels, by tiles of rows."""
    for a in range(0, len(p), tile):
        for b in range(0, len(p), tile):
            joint = np.bitwise_count(bits[a : a + tile, None] & bits[None, b : b + tile])
            i, j = np.nonzero(joint)
            n = joint[i, j].astype(np.int64)
            i, j = i + a, j + b
            value = _f(p[i], p[j]) - _f(p[i], p0[j]) - _f(p0[i], p[j]) + _f(p0[i], p0[j])
            np.add.at(total, (source[i], source[j]), n * value)


def joint_parts(words: DataFrame) -> DataFrame:
    """lang, source, item, value: sums over the blocks of a task of what pairs of groups have in common."""
    tasks = max(1, -(-words.count() // WORDS))

    def run(key, table):
        frame = table.to_pandas().sort_values(["lang", "block", "source"], kind="stable")
        out = []
        for lang, rows in frame.groupby("lang", sort=False):
            names, codes = np.unique(rows["source"].to_numpy(dtype=object), return_inverse=True)
            total = np.zeros((len(names), len(names)), dtype=np.int64)
            columns = [codes, *(rows[c].to_numpy(dtype=np.int64) for c in ("p", "p0")), rows["bits"].to_numpy(dtype=np.int64).view(np.uint64)]
            blocks = rows["block"].to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1), len(blocks)]
            for at, end in zip(edges, edges[1:], strict=False):
                block_cells(*(c[at:end] for c in columns), total)
            np.fill_diagonal(total, 0)
            i, j = np.nonzero(total)
            out.append((np.full(len(i), lang, dtype=object), names[i], names[j], total[i, j]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "source", "item", "value"])

    task = F.pmod(F.xxhash64("lang", "block"), F.lit(tasks))
    return words.withColumn("task", task).groupBy("task").applyInArrow(run, "lang string, source string, item string, value long")


def audit(docs: DataFrame, least_docs: int = 10, most_terms: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: of each group its pairs with all others of its language, and its `most_terms` terms that are furthest above the language's share."""
    kept = stored(kept_terms(docs, least_docs), "divergence-terms")
    table = stored(group_table(kept), "divergence-groups")
    groups = F.broadcast(table) if table.count() <= GROUPS else table
    words = stored(bitmap_words(kept, groups), "divergence-words")

    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    base = groups.join(other, "lang").where("source <> item").select("lang", "source", "item", F.coalesce(F.col("v") * distance("p0", "q0"), F.lit(0)).alias("value"))
    sizes = words.groupBy("lang", "source", "p", "p0").agg(F.sum(F.bit_count("bits")).alias("size"))
    single = sizes.join(other, "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("size") * (distance("p", "q0") - distance("p0", "q0"))).alias("value"))
    turned = single.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    parts = base.unionByName(single).unionByName(turned).unionByName(joint_parts(words))
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    cells = kept.where("term <> ''").select("lang", "term", F.col("n").alias("lang_n"), F.explode("cells").alias("c")).select("lang", "c.source", F.col("term").alias("item"), "lang_n", "c.n")
    met = cells.where("n > 0").join(groups, ["lang", "source"]).select("lang", "source", "item", probability("n", "total").alias("p"), probability("lang_n", "lang_total").alias("q"))
    terms = met.where("p > q").select("lang", "source", "item", distance("p", "q").alias("value"))

    ranked = lambda rows, part: rows.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    out = stored(ranked(pairs, "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= most_terms)), "divergence")
    for made in (kept, table, words):
        drop_stored(made)
    return out


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
t AS (SELECT row, lang, source, unnest(words) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT row) >= 10),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY 1, 2),
cell AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.total, 0) + 2 * l.v))::HUGEINT AS p,
    (1 + (1000000000::HUGEINT * (k.n + 2)) // (l.total + 2 * l.v))::HUGEINT AS q
  FROM g JOIN kept k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN s ON s.lang = g.lang AND s.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value FROM cell a JOIN cell b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT g.lang, g.source, h.source AS item, coalesce(apart.value, 0)::BIGINT AS value FROM g JOIN g h ON h.lang = g.lang AND h.source <> g.source LEFT JOIN apart ON apart.lang = g.lang AND apart.source = g.source AND apart.item = h.source),
terms AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM cell WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pairs
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM terms) WHERE rank <= 10
"""
