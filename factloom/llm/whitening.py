"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the distributed, centred rows.

Entries become whole numbers x = floor(64 c) + 1000000. The fit list has each distinct x vector once; n of them have the
sums S, so that x - S / n is known exactly up to one division. A step of the bidiagonalisation is one pass over the
fit list: every task multiplies its rows by the newest right vector (X v), and sums up X'u together with what full
reorthogonalisation needs (u'u, and the products of u with all earlier left vectors). Left vectors, as long as the
list, are never stored: each is X times a short vector that the driver keeps, so a task makes its part of them from
its rows, and a lost executor costs no more than a re-read. Only vectors as long as an embedding reach the driver. As many steps as there are dimensions
make the bidiagonal matrix complete; its small SVD gives components and deviations.

Rows whose vector is null, is empty, or holds null or non-finite entries are dropped; so are those of another length
than most vectors have (of equally frequent lengths the shorter counts). Entries beyond 2^52 / 64 count as that. Rows
that repeat are transformed one by one. A null id stays. Components without variance have no rows: a table of one
distinct vector gives none, an empty table none. deviation is null beyond the range of a long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.arrow_rows import bound_batches, drop_stored, stored

#: Fixed values of the contract: what an entry is multiplied by, and what is added to it.
SCALE, OFFSET = 64.0, 1_000_000
#: Entries beyond this size count as that.
LARGEST = 2.0**52
#: As many partial sums go to the driver; where there are more, tasks add them up before.
PARTS = 512
#: Singular values below this share of the largest are none.
ZERO = 1e-10


@dataclass
class Model:
    """What a task needs to whiten rows; its size is set by the number of dimensions."""

    n: int
    sums: list[int]
    components: np.ndarray  # a column each
    eigenvalues: np.ndarray
    trace: float
    identity_error: float


def scaled(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, x array<long> of the rows that count."""
    rows = table.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = rows.where((F.size("v") > 0) & F.forall("v", fine))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    x = lambda c: F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), SCALE * c))) + OFFSET
    return rows.where(F.size("v") == (lengths["d"] if lengths else 0)).select("vec_id", F.transform("v", x).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def summed(vectors: DataFrame, fn: Callable[[np.ndarray], list]) -> list:
    """The sums over all rows of vectors (x) of the list of numbers that fn makes of a matrix of rows; [] without rows."""

    def adding(made: Callable[[np.ndarray], list]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    part = np.asarray(made(_matrix(batch.column(0))))
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], type=pa.list_(pa.float64()))], names=["s"])

        return run

    parts = vectors.select("x").mapInArrow(adding(fn), "s array<double>")
    if vectors.rdd.getNumPartitions() > PARTS:
        parts = parts.repartition(PARTS).mapInArrow(adding(lambda m: m.sum(0)), "s array<double>")
    rows = [r["s"] for r in parts.collect()]
    return np.sum(np.array(rows), axis=0).tolist() if rows else []


def whole_sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """Number and exact sums by dimension of vectors (x), whatever their size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column(0))
                made = [(int(h) << 26) + int(low) for h, low in zip((m >> 26).sum(0), (m & ((1 << 26) - 1)).sum(0), strict=True)]
                n, total = n + len(m), made if total is None else [a + b for a, b in zip(total, made, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([k for k in range(-1, len(total))], pa.int32()), pa.array([str(v) for v in [n, *total]])], names=["k", "s"])

    rows = vectors.select("x").mapInArrow(run, "k int, s string").groupBy("k").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("k").collect()
    return (int(rows[0]["s"]), [int(r["s"]) for r in rows[1:]]) if rows else (0, [])


class Centre:
    """x - S / n of whole rows: first the whole part of the mean is taken off, exactly, then the rest."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.whole, self.over = n, np.array([s // n for s in sums], dtype=np.int64), [s % n for s in sums]
        self.rest = np.array([r / n for r in self.over])

    def __call__(self, m: np.ndarray) -> np.ndarray:
        return (m - self.whole) - self.rest

    def deviations(self, m: np.ndarray) -> list[int | None]:
        """Of each row the sum over dimensions of (n x - S)^2."""
        off = m - self.whole
        most = self.n * (int(np.abs(off).max(initial=0)) + 1)
        if most * most * m.shape[1] < 1 << 63:
            return (np.square(off * self.n - np.array(self.over, dtype=np.int64)).sum(1)).tolist()
        exact = [sum((self.n * int(a) - r) ** 2 for a, r in zip(row, self.over, strict=True)) for row in off]
        return [v if v < 1 << 63 else None for v in exact]


def bidiagonal(vectors: DataFrame, centre: Centre, steps: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(V, B): orthonormal right vectors as columns, and the upper bidiagonal matrix of the centred rows in them.

    A left vector u is X y with a short y. Where a left or right vector vanishes, the rows have no more variance in
    what the vectors span so far, and the next right vector is drawn anew, orthogonal to all others: repeated singular
    values are found too.
    """
    d, rng = len(centre.rest), np.random.default_rng(seed)
    V, Y, XU = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))
    B = np.zeros((steps, steps))
    v, beta, size = rng.standard_normal(d), 0.0, 0.0
    v /= np.linalg.norm(v)
    for k in range(steps):
        if beta == 0 and k:
            v = rng.standard_normal(d)
            for _ in range(3):
                v -= V @ (V.T @ v)
                v /= np.linalg.norm(v)
        V = np.column_stack([V, v])
        new = v - beta * Y[:, -1] if beta else v

        def step(m: np.ndarray, new=new, earlier=Y) -> list[float]:
            c = centre(m)
            u = c @ new
            return [u @ u, *(c.T @ u), *((c @ earlier).T @ u)]

        got = np.array(summed(vectors, step))
        along = got[1 + d :]
        left = got[0] - along @ along
        alpha = float(np.sqrt(left)) if left > 0 else 0.0
        size = max(size, alpha, beta)
        if alpha <= ZERO * size:
            alpha, y, xu = 0.0, np.zeros(d), np.zeros(d)
        else:
            y, xu = (new - Y @ along) / alpha, (got[1 : 1 + d] - XU @ along) / alpha
        Y, XU = np.column_stack([Y, y]), np.column_stack([XU, xu])
        B[k, k] = alpha
        w = xu - alpha * v
        for _ in range(2):
            w -= V @ (V.T @ w)
        beta = float(np.linalg.norm(w))
        if beta <= ZERO * size or k + 1 == steps:
            beta = 0.0
        else:
            v, B[k, k + 1] = w / beta, beta
    return V, B


def fit(rows: DataFrame, most: int = 16, steps: int | None = None) -> Model | None:
    """Model of the distinct vectors of rows (x); None where there are none. steps: fewer passes than dimensions, for the leading components only."""
    vectors = stored(rows.select("x").distinct(), "whitening-vectors")
    n, sums = whole_sums(vectors)
    if not n:
        return None
    centre = Centre(n, sums)
    V, B = bidiagonal(vectors, centre, min(len(sums), steps or len(sums)))
    _, sizes, right = np.linalg.svd(B)
    kept = int((sizes[:most] > ZERO * max(sizes[0], 1e-300)).sum())
    components, eigenvalues = (V @ right.T)[:, :kept], sizes[:kept] ** 2 / n
    to = components / np.sqrt(eigenvalues)
    first = summed(vectors, lambda m: [np.square(centre(m)).sum(), *(centre(m) @ to).sum(0)])
    mean = np.array(first[1:]) / n
    second = summed(vectors, lambda m: ((z := centre(m) @ to - mean).T @ z).ravel())
    error = np.abs(np.array(second).reshape(kept, kept) / n - np.eye(kept)).max(initial=0)
    drop_stored(vectors)
    return Model(n, sums, components, eigenvalues, first[0] / n, float(error))


def whiten(rows: DataFrame, model: Model | None) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of rows (vec_id, x): a row for each one and component."""
    schema = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    kind = rows.schema["vec_id"].dataType.simpleString()
    if model is None or not len(model.eigenvalues):
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, {schema}")
    centre, to, k = Centre(model.n, model.sums), model.components / np.sqrt(model.eigenvalues), len(model.eigenvalues)
    explained = model.eigenvalues / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column("x"))
            at = np.repeat(np.arange(len(m)), k)
            own = pa.array(centre.deviations(m), pa.int64())
            columns = [
                batch.column("vec_id").take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(m))), pa.array(np.full(len(at), model.n)), own.take(pa.array(at)),
                pa.array((centre(m) @ to).ravel()), pa.array(np.tile(explained, len(m))), pa.array(np.full(len(at), model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    bound_batches(rows.sparkSession)
    return rows.mapInArrow(run, f"vec_id {kind}, {schema}")


def query(table: DataFrame, most: int = 16) -> DataFrame:
    rows = scaled(table)
    return whiten(rows, fit(rows, most))
