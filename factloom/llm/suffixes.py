"""Suffix-array dedup of long exact repeats with a logarithmic family of sorted suffix tables.

A byte goes if a string of `length` bytes that covers it also starts earlier (smaller doc_id, or the same document
and an earlier start). Suffixes are taken at anchors only: of the k-grams of each string of `length` bytes the one
with the least hash (the leftmost of equals). Equal strings have equal anchors at equal places, so every repeat
shows at an anchor; k is two fifths of `length`.

Documents come in batches of ascending doc_id. A batch's anchors are a sparse suffix array, sorted by the hash of all
bytes that strings with this anchor can cover (ch). It is merge-joined with the levels of the earlier batches, which
are sorted alike and dealt into the same buckets:
- an anchor whose ch came up before repeats wholly: all strings around it started earlier;
- an anchor whose ch is new is the first of its kind, and a row of the run that the batch adds.
Runs of equal size are merged, two at a time, before the next batch comes, so that their number grows with the
logarithm of the number of batches (levels.py); a later call can open the family and add batches of larger ids.

First anchors of one k-gram (kh) with several surroundings are candidates: their surroundings are fetched from the
texts, and the strings in them compared by 64-bit hashes of their bytes, so that repeats end at their exact bytes.

Null texts are empty. Documents without an id are neither looked at nor changed. Rows that share an id are one
document for the order: their common repeats at equal places stay.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm.arrow_rows import bound_batches, drop_folder, drop_stored, map_rows, shared_folder, slices, stored, whole
from factloom.llm.levels import Levels, merged_by

#: An odd multiplier and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Candidates of one k-gram beyond which their strings are dealt out singly.
GROUP_LIMIT = 20_000
#: A k-gram is hot if it has more first anchors than this, and more than one in so many of all: at most HOT_SHARE k-grams of 8 bytes, which are broadcast.
HOT_ROWS, HOT_SHARE = 10_000, 1_000_000
#: What a partition counts of a k-gram if it has so many rows of it at least, and rows that it counts at once.
SEEN_OFTEN, COUNT_ROWS = 32, 4_000_000


@lru_cache(maxsize=4)
def powers(n: int, base: int) -> np.ndarray:
    out, m = np.ones(n, dtype=np.uint64), 1
    while m < n:
        k = min(m, n - m)
        out[m : m + k] = out[:k] * np.uint64(pow(base, m, 1 << 64))
        m += k
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Sums:
    """Hashes of any stretches of a byte array from one running sum."""

    def __init__(self, data: np.ndarray):
        n = 1 << max(12, int(len(data) + 1).bit_length())
        self.inverse = powers(n, INVERSE)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(n, BASE)[: len(data)], out=self.sums[1:])

    def hash(self, start, end) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start])

    def all_of(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mixed((self.sums[k:] - self.sums[:n]) * self.inverse[:n])


def anchors(data: np.ndarray, lengths: np.ndarray, length: int, k: int):
    """Of texts laid end to end: the anchors' text, place in it, k-gram hash and surroundings' hash."""
    width = length - k + 1
    ends = np.cumsum(lengths)
    starts = ends - lengths
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    sums = Sums(data)
    grams = sums.all_of(k)
    low = np.uint64((1 << 28) - 1)  # slices are far shorter
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    step = 1
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < width:
        least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    inside = np.zeros(len(data) + 1, dtype=np.int32)  # strings that lie within one text
    long = lengths >= length
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - length + 1, -1)
    at = np.unique(least[np.cumsum(inside)[: len(least)] > 0] & low).astype(np.int64)
    text = np.searchsorted(ends, at, side="right")
    lo, hi = np.maximum(starts[text], at - (length - k)), np.minimum(ends[text], at + length)
    around = sums.hash(lo, hi) ^ mixed(((at - lo) << 20 | (hi - at)).astype(np.uint64))
    return text, at - starts[text], grams[at], around


#: Kinds of rows that batch_anchors() makes: repeats within a slice of documents, and the slice's first of each ch.
REPEAT, FIRST = 0, 1
SUFFIX = "kh long, ch long, doc long, pos int"


def batch_anchors(docs: DataFrame, length: int, k: int) -> DataFrame:
    """kh, ch, doc, pos, kind of all anchors of docs (doc_id, text), combined within slices."""

    def run(batches):
        for part in slices(batches):
            texts = [(t or "").encode() for t in part.column("text").to_pylist()]
            ids = part.column("doc_id").to_numpy()
            text, pos, kh, ch = anchors(np.frombuffer(b"".join(texts), dtype=np.uint8), np.array(list(map(len, texts)), dtype=np.int64), length, k)
            doc = ids[text]
            order = np.lexsort((pos, doc, ch))
            kh, ch, doc, pos = kh[order], ch[order], doc[order], pos[order]
            new = np.concatenate([[True], ch[1:] != ch[:-1]])[: len(ch)]
            first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(ch) else np.zeros(0, np.int64)
            # a place of its own kind's first is the same document's, in another row
            kept = new | (doc != doc[first]) | (pos != pos[first])
            columns = [pa.array(kh[kept].view(np.int64)), pa.array(ch[kept].view(np.int64)), pa.array(doc[kept]), pa.array(pos[kept].astype(np.int32)), pa.array(np.where(new[kept], FIRST, REPEAT).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["kh", "ch", "doc", "pos", "kind"])

    bound_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"{SUFFIX}, kind int")


#: The merge join of two runs; a ch has its row in one of them.
merge_runs = merged_by("ch", kh=F.coalesce, doc=F.coalesce, pos=F.coalesce)


class SuffixFamily:
    """Levels of runs (kh, ch, doc, pos: of each ch its first place), sorted by ch; folder: of a family to go on with."""

    def __init__(self, spark: SparkSession, length: int, folder: str | None = None):
        self.spark, self.length, self.k = spark, length, max(1, length * 2 // 5)
        self.levels = Levels(spark, "ch", folder)
        self.repeats: list[DataFrame] = []
        self.folders: list[str] = []

    def last_doc(self) -> int | None:
        return max((x for t in self.levels.tables() if (x := t.agg(F.max("doc")).first()[0]) is not None), default=None)

    def add(self, docs: DataFrame) -> None:
        """Merge-join a batch's anchors with all runs; its first ones become a run. Ids are above those of earlier batches."""
        self.levels.compact(merge_runs)
        made = shared_folder(self.spark, "anchors")
        batch_anchors(docs, self.length, self.k).write.partitionBy("kind").parquet(made)
        found = self.spark.read.schema(f"{SUFFIX}, kind int").parquet(made)
        own = W.partitionBy("ch").orderBy("doc", "pos")
        place = F.struct("doc", "pos")
        rows = found.where(F.col("kind") == FIRST).select("kh", "ch", "doc", "pos", F.row_number().over(own).alias("r"), (F.first(place).over(own) != place).alias("later"))
        known = F.lit(False)
        for n, run in enumerate(self.levels.tables()):
            rows = rows.hint("merge").join(run.select("ch", F.lit(True).alias(f"in_{n}")), "ch", "left")
            known = known | F.coalesce(f"in_{n}", F.lit(False))
        path = shared_folder(self.spark, "scanned")
        kind = F.when(known | F.col("later"), REPEAT).otherwise(FIRST)
        rows.where(known | F.col("later") | (F.col("r") == 1)).select("kh", "ch", "doc", "pos", kind.alias("kind")).write.partitionBy("kind").parquet(path)
        drop_folder(self.spark, f"{made}/kind={FIRST}")
        scanned = self.spark.read.schema(f"{SUFFIX}, kind int").parquet(path)
        self.repeats += [t.where(F.col("kind") == REPEAT).select("doc", "pos") for t in (found, scanned)]
        self.levels.add(scanned.where(F.col("kind") == FIRST).select("kh", "ch", "doc", "pos"))
        drop_folder(self.spark, f"{path}/kind={FIRST}")  # only what repeats is still needed
        self.folders += [made, path]

    def stretches(self, texts: DataFrame, since: int | None = None) -> DataFrame:
        """doc, start, stop of what repeats in the batches added by this object; texts: all documents, of earlier calls too. since: the first id of those batches."""
        repeated = reduce(DataFrame.unionByName, self.repeats).select("doc", (F.col("pos") - (self.length - self.k)).alias("start"), (F.col("pos") + self.length).alias("stop"))
        near = stored(surroundings(texts, self.candidates(since), self.length, self.k), "suffix-near")
        out = repeated.unionByName(repeats(near, self.length, self.k))
        out = stored(out if since is None else out.where(F.col("doc") >= since), "suffix-stretches")
        for folder in self.folders:
            drop_folder(self.spark, folder)
        drop_stored(near)
        return out

    def candidates(self, since: int | None) -> DataFrame:
        """kh, doc, pos of first anchors whose k-gram has several (one of them at least of a document from since on).

        Hot k-grams, found by what partitions see often, have several; all others are counted by a window each.
        """
        rows = reduce(DataFrame.unionByName, [t.select("kh", "doc", "pos") for t in self.levels.tables()])
        total = rows.count()

        def often(batches):
            held, size = [], 0

            def seen():
                kh, n = np.unique(np.concatenate(held), return_counts=True)
                some = n >= SEEN_OFTEN
                return pa.RecordBatch.from_arrays([pa.array(kh[some]), pa.array(n[some])], names=["kh", "n"])

            for batch in batches:
                held.append(batch.column(0).to_numpy())
                size += batch.num_rows
                if size >= COUNT_ROWS:
                    yield seen()
                    held, size = [], 0
            if held:
                yield seen()

        counted = rows.select("kh").mapInArrow(often, "kh long, n long").groupBy("kh").agg(F.sum("n").alias("n"))
        hot = stored(counted.where(F.col("n") > max(HOT_ROWS, total // HOT_SHARE)).select("kh"), "suffix-hot")
        group = W.partitionBy("kh")
        light = rows.join(F.broadcast(hot), "kh", "left_anti").select("kh", "doc", "pos", F.count("*").over(group).alias("n"), F.max("doc").over(group).alias("last")).where("n > 1")
        light = (light if since is None else light.where(F.col("last") >= since)).select("kh", "doc", "pos")
        return light.unionByName(rows.join(F.broadcast(hot), "kh"))


def surroundings(docs: DataFrame, candidates: DataFrame, length: int, k: int) -> DataFrame:
    """kh, doc, pos, before (bytes that there are before pos), around binary: the bytes that strings with this anchor can cover."""
    places = candidates.groupBy("doc").agg(F.collect_set(F.struct("kh", "pos")).alias("places"))
    met = docs.select(F.col("doc_id").alias("doc"), "text").join(places, "doc")

    def run(batches):
        for part in slices(batches):
            out = []
            for doc, text, places in zip(*(part.column(c).to_pylist() for c in ("doc", "text", "places")), strict=True):
                raw = (text or "").encode()
                for place in places:
                    pos = place["pos"]
                    lo = max(0, pos - (length - k))
                    out.append((place["kh"], doc, pos, pos - lo, raw[lo : pos + length]))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["kh", "doc", "pos", "before", "around"])

    return met.mapInArrow(run, "kh long, doc long, pos int, before int, around binary")


def strings(around: list[bytes], before: np.ndarray, length: int, width: int):
    """All strings of candidates: candidate, start before the anchor, hash; candidates in their order."""
    lengths = np.array(list(map(len, around)), dtype=np.int64)
    begins = np.cumsum(lengths) - lengths
    sums = Sums(np.frombuffer(b"".join(around), dtype=np.uint8))
    back = np.arange(width)
    first = before[:, None] - back[None, :]
    there = (first >= 0) & (first + length <= lengths[:, None])
    which, o = np.nonzero(there)
    start = begins[which] + first[which, o]
    return which, o, sums.hash(start, start + length)


def repeats(near: DataFrame, length: int, k: int) -> DataFrame:
    """doc, start, stop: of candidates with their surroundings, the stretches whose strings started earlier."""
    width = length - k + 1
    sizes = near.groupBy("kh").count()
    crowded = stored(sizes.where(F.col("count") > GROUP_LIMIT).select("kh"), "suffix-crowded")
    some = near.join(crowded, "kh", "left_anti")

    def within(batches):
        table = whole(batches)
        if table is None:
            return
        doc, pos, before = (table.column(c).to_numpy() for c in ("doc", "pos", "before"))
        order = np.lexsort((pos, doc))
        around = table.column("around").to_pylist()
        doc, pos, before, around = doc[order], pos[order].astype(np.int64), before[order].astype(np.int64), [around[i] for i in order]
        for own in blocks(table.column("kh").to_numpy()[order]):
            which, o, h = strings([around[i] for i in own], before[own], length, width)
            # strings that show once only are dropped before places are compared
            by = np.argsort(h)
            same = h[by[1:]] == h[by[:-1]]
            by = by[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
            # a string can show at several anchors: all places but its first one start later
            w, h = own[which[by]], h[by]
            place = np.cumsum(np.concatenate([[0], doc[own][1:] != doc[own][:-1]]))[which[by]] << 32 | (pos[w] - o[by])
            by = np.lexsort((place, h))
            h, place, w = h[by], place[by], w[by]
            group = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])[: len(h)])
            later = place != np.repeat(place[group], np.diff([*group, len(h)]))
            doc_of, start, stop = unite(doc[w[later]], place[later] & 0xFFFFFFFF, (place[later] & 0xFFFFFFFF) + length)
            yield pa.RecordBatch.from_arrays([pa.array(doc_of), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], names=["doc", "start", "stop"])

    found = some.repartition("kh").mapInArrow(within, "doc long, start int, stop int")
    if crowded.isEmpty():
        return found

    def singly(batches):
        for batch in batches:
            if batch.num_rows:
                doc, pos, before = (batch.column(c).to_numpy() for c in ("doc", "pos", "before"))
                which, o, h = strings(batch.column("around").to_pylist(), before.astype(np.int64), length, width)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(doc[which]), pa.array((pos[which] - o).astype(np.int32))], names=["h", "doc", "start"])

    rows = stored(near.join(crowded, "kh", "left_semi").mapInArrow(singly, "h long, doc long, start int"), "suffix-strings")
    firsts = stored(rows.groupBy("h").agg(F.min(F.struct("doc", "start")).alias("first")), "suffix-firsts")
    more = rows.join(firsts, "h").where(F.struct("doc", "start") != F.col("first")).select("doc", "start", (F.col("start") + length).alias("stop"))
    return found.unionByName(merged_stretches(more))


def blocks(kh: np.ndarray, most: int = 20_000):
    """Positions of whole groups of kh, about `most` at a time, each ascending."""
    order = np.argsort(kh, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], kh[order][1:] != kh[order][:-1], [True]]))
    at = 0
    while at < len(edges) - 1:
        upto = max(at + 1, int(np.searchsorted(edges, edges[at] + most, side="right")) - 1)
        yield np.sort(order[edges[at] : edges[upto]])
        at = upto


def merged_stretches(rows: DataFrame) -> DataFrame:
    """Stretches of one batch of rows united where they touch; a document's may still overlap across batches."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                doc, start, stop = unite(*(batch.column(c).to_numpy() for c in ("doc", "start", "stop")))
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], names=["doc", "start", "stop"])

    return rows.mapInArrow(run, "doc long, start int, stop int")


def unite(doc: np.ndarray, start: np.ndarray, stop: np.ndarray):
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order].astype(np.int64), stop[order].astype(np.int64)
    if not len(doc):
        return doc, start, stop
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    # running ends within a document: lift each document above the one before
    lift = np.cumsum(new) << 33
    reach = np.maximum.accumulate(stop + lift) - lift
    new[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return doc[first], start[first], np.maximum.reduceat(stop, first)


def batch_bounds(docs: DataFrame, batches: int) -> list[int]:
    """Upper ends (exclusive) of all but the last batch: about equal numbers of documents by ascending doc_id."""
    cuts = docs.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0]
    return sorted(set(cuts or []))


def suffix_dedup(docs: DataFrame, length: int = 100, batches: int = 4, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """doc_id, n_bytes, kept binary, removed array<struct<start, stop>> (bytes, maximal and ascending).

    folder: of a family of levels, to begin or to go on with; docs are added to it, and what repeats earlier calls'
    documents goes as well. earlier: the documents of those calls, whose ids have to be below those of docs.
    """
    spark, columns = docs.sparkSession, [F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")]
    source = docs.select(columns)
    family = SuffixFamily(spark, length, folder)
    last, since = family.last_doc(), source.agg(F.min("doc_id")).first()[0]
    if last is not None and since is not None and since <= last:
        raise ValueError(f"doc_id {since} is not above {last}, the last one of the family")
    bounds = [None, *batch_bounds(source, batches), None]
    for low, high in zip(bounds, bounds[1:], strict=False):
        here = source.where(F.col("doc_id").isNotNull() if low is None else F.col("doc_id") >= low)
        family.add(here if high is None else here.where(F.col("doc_id") < high))
    found = family.stretches(source if earlier is None else earlier.select(columns).unionByName(source), None if last is None else since)
    if folder is None:
        family.levels.close()
    per_doc = found.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("start", "stop")).alias("stretches"))
    met = source.join(stored(per_doc, "suffix-by-document"), "doc_id", "left")

    def run(cols):
        sizes, kept, removed = [], [], []
        for text, stretches in zip(*cols, strict=True):
            raw = text.encode()
            spans, parts, done = [], [], 0
            for s, e in sorted((max(0, x["start"]), min(len(raw), x["stop"])) for x in stretches or ()):
                if spans and s <= spans[-1]["stop"]:
                    spans[-1]["stop"] = max(spans[-1]["stop"], e)
                else:
                    spans.append({"start": s, "stop": e})
            for x in spans:
                parts.append(raw[done : x["start"]])
                done = x["stop"]
            sizes.append(len(raw))
            kept.append(b"".join([*parts, raw[done:]]))
            removed.append(spans)
        return [sizes, kept, removed]

    return map_rows(met, run, "n_bytes long, kept binary, removed array<struct<start:int,stop:int>>", keep=["doc_id"])


def query(docs: DataFrame) -> DataFrame:
    out = suffix_dedup(docs.select("doc_id", "text"))
    return out.select(
        "doc_id", "n_bytes", F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"]).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
