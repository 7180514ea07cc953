"""Quality classifier: ridge scores on random Fourier features, calibrated by isotonic regression.

Document statistics (shares of character kinds, word and line repetition, lengths, entropy) are standardised and
mapped to cosines whose inner products approximate a Gaussian kernel. Each partition of labelled rows sums its part
of the normal equations; the sums meet by matrix row, and only the finished matrix, whose size is a parameter,
reaches the driver. Other labelled rows, summed up in bins of the raw score, calibrate it by pooling adjacent
violators.

A text's score depends on the text alone. Null texts count as empty; an empty text has a score like any other.
Labels that are null are ignored; of several labels for one doc_id the largest counts. Without labelled rows every
score is 0.5. Rows that share a doc_id are scored one by one. A null doc_id counts as the empty text where folds are
dealt: such a row is held out (crc32 of nothing is 0), and has no label.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.arrow_rows import id_text, map_rows, slices, stored

#: Names of the statistics, in the order of the vectors.
STATISTICS = (
    "log_bytes", "log_words", "lower", "upper", "digit", "space", "newline", "plain_punctuation", "symbol", "high",
    "entropy", "word_mean", "word_deviation", "longest_word", "distinct_words", "top_word", "top_pair", "marked_words",
    "upper_words", "distinct_lines", "end_of_sentence", "symbol_kinds",
)
_KIND = np.zeros(256, dtype=np.int64)
for _chars, _kind in ((b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3), (b" \t\r\x0b\x0c", 4), (b"\n", 5), (b".,;:!?'\"()-", 6)):
    _KIND[list(_chars)] = _kind
_KIND[128:] = 7


def statistics(text: str | None) -> list[float]:
    """The vector of STATISTICS of one text."""
    raw = (text or "").encode()
    n = len(raw) or 1
    by_byte = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    kinds = np.bincount(_KIND, weights=by_byte, minlength=8) / n
    share = by_byte[by_byte > 0] / n
    words = raw.split()
    m = len(words) or 1
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    counts = Counter(words)
    pairs = Counter(zip(words, words[1:], strict=False))
    lines = raw.split(b"\n")
    ends = by_byte[46] + by_byte[33] + by_byte[63]
    return [
        math.log1p(len(raw)), math.log1p(len(words)), kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], kinds[0], kinds[7],
        float(-(share * np.log2(share)).sum()), float(lengths.mean()), float(lengths.std()), math.log1p(float(lengths.max())),
        len(counts) / m, max(counts.values(), default=0) / m, max(pairs.values(), default=0) / m,
        sum(c for w, c in counts.items() if not w.rstrip(b".,;:!?").isalnum() and w.isascii()) / m,
        sum(c for w, c in counts.items() if w.isupper() and len(w) > 1) / m,
        len(set(lines)) / len(lines), float(ends) / m, float((by_byte[_KIND == 0] > 0).sum()),
    ]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, x array<double>."""
    return map_rows(id_text(docs, id_col, text_col), lambda cols: [[statistics(t) for t in cols[0]]], "x array<double>", keep=["doc_id"])


@dataclass
class Model:
    """Everything a task needs to score statistics; its size is set by the parameters, not by the data."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        """1, the standardised statistics, and the random cosines."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        cosines = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases)
        return np.hstack([np.ones((len(x), 1)), z, cosines])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None or self.knots is None or not len(x):
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.raw(x), *self.knots), 0, 1)


def isotonic(at: np.ndarray, total: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins sorted by score: knots (score, probability), with half a case of each label added to a pool's ends."""
    pools: list[list[float]] = []  # total, ones, weighted score
    for a, t, o in zip(at.tolist(), total.tolist(), ones.tolist(), strict=True):
        pools.append([t, o, a * t])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[0] for p in pools]), np.array([(p[1] + 0.01) / (p[0] + 0.02) for p in pools])


def fold_of(id_col: str, folds: int):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held_out: int = 0, calibrate: int = 4,
        cosines: int = 160, width: float = 4.0, ridge: float = 1e-3, seed: int = 7, bins: int = 2000, parts: int = 32) -> Model:
    """Fit on labelled rows of stats (doc_id, x) by crc32(doc_id as text) mod folds: fold held_out is never used,
    fold calibrate calibrates, the others go into the normal equations. All labelled rows count."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("double")).alias("y"))
    rows = stats.join(known, "doc_id").withColumn("fold", fold_of("doc_id", folds))
    rows = stored(rows.where(F.col("fold") != held_out).select("doc_id", "x", "y", "fold"), "quality-labelled")
    train = rows.where(F.col("fold") != calibrate)
    n = len(STATISTICS)
    moments = train.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.coalesce(F.stddev_pop("v"), F.lit(0.0)).alias("s")).collect()
    random = np.random.default_rng(seed)
    mean, scale = np.zeros(n), np.ones(n)
    for k, m, s in moments:
        mean[k], scale[k] = m, s if s > 1e-9 else 1.0
    model = Model(mean, scale, random.normal(0, 1 / width, (n, cosines)), random.uniform(0, 2 * np.pi, cosines))
    if not moments:
        return model
    shared = stats.sparkSession.sparkContext.broadcast(model)
    size = 1 + n + cosines

    def sums(batches):
        a, b, count = np.zeros((size, size)), np.zeros(size), 0
        for batch in batches:
            if batch.num_rows:
                z = shared.value.features(np.array(batch.column("x").to_pylist(), dtype=np.float64))
                a += z.T @ z
                b += z.T @ np.array(batch.column("y").to_pylist())
                count += batch.num_rows
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(np.hstack([a, b[:, None]]).tolist(), pa.list_(pa.float64()))], names=["i", "row"])

    # a fixed number of partial matrices, whatever the number of rows; they meet row by row
    partial = train.select("x", "y").repartition(parts).mapInArrow(sums, "i int, row array<double>")
    summed = partial.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    system = np.zeros((size, size + 1))
    for i, j, v in summed:
        system[i, j] = v
    penalty = np.full(size, ridge * system[0, 0])
    penalty[0] = 1e-9
    model.weights = np.linalg.solve(system[:, :size] + np.diag(penalty), system[:, size])
    model.knots = calibration(rows, model, calibrate, bins)
    return model


def calibration(rows: DataFrame, model: Model, fold: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic knots from the labelled rows of one fold (all of them where that fold is empty), summed up in bins of the raw score."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(cols):
        return [np.floor(np.clip(shared.value.raw(np.array(cols[0])), -1, 2) * bins / 3).astype(int).tolist() if cols[0] else []]

    scored = map_rows(rows.select("y", "fold", "x"), run, "bin int", keep=["y", "fold"])
    summed = scored.groupBy((F.col("fold") == fold).alias("own"), "bin").agg(F.count("*").alias("n"), F.sum("y").alias("ones")).collect()
    own = [r for r in summed if r["own"]] or summed
    found = sorted((r["bin"], r["n"], r["ones"]) for r in own)
    at, n, ones = (np.array(c, dtype=np.float64) for c in zip(*found, strict=True))
    return isotonic((at + 0.5) * 3 / bins, n, ones)


def scores(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row of stats (doc_id, x)."""
    shared = stats.sparkSession.sparkContext.broadcast(model)
    run = lambda cols: [shared.value.score(np.array(cols[0], dtype=np.float64).reshape(len(cols[0]), -1)).tolist()]
    return map_rows(stats.select("doc_id", "x"), run, "score double", keep=["doc_id"])


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """docs whose score reaches threshold, all their columns as they are. Statistics of labelled texts only are made to
    fit (these meet their labels by a merge join at every size), and of all texts once, to score."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id").distinct()
    some = docs.select("doc_id", text_col).where("doc_id IS NOT NULL").join(known.hint("merge"), "doc_id", "left_semi")
    model = fit(with_statistics(some, text_col=text_col), labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part in slices(batches):
            x = np.array([statistics(t) for t in part.column(text_col).to_pylist()])
            yield part.filter(pa.array(shared.value.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    stats = stored(with_statistics(docs), "quality-statistics")
    scored = scores(stats, fit(stats, labels.select("doc_id", "quality")))
    return scored.select(
        "doc_id",
        (fold_of("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )
