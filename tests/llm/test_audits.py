"""Source divergence and whitening, against plain versions in whole numbers and a full eigendecomposition."""

import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import divergence, whitening

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_audit(rows, least, most):
    """rows of (text, lang, source), term by term and pair by pair."""
    groups, documents = {}, Counter()
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))
        groups.setdefault((lang or "", source or ""), Counter()).update(terms)
        documents.update({(lang or "", t) for t in terms})
    out = []
    for lang, source in groups:
        kept = [t for (of, t), n in documents.items() if of == lang and n >= least]
        of = lambda c: {t: 1 + 1000000000 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) * (a - b) // (a + b)
        p, q = of(groups[lang, source]), of(sum((c for (o, _), c in groups.items() if o == lang), Counter()))
        pairs = [(-sum(f(p[t], r[t]) for t in kept), s) for (o, s), c in groups.items() if o == lang and s != source for r in [of(c)]]
        terms = [(-f(p[t], q[t]), t) for t in kept if groups[lang, source][t] and p[t] > q[t]]
        by = lambda x: (x[0], x[1].encode())
        out += [(lang, source, "pair", i, -v, k + 1) for k, (v, i) in enumerate(sorted(pairs, key=by))]
        out += [(lang, source, "term", i, -v, k + 1) for k, (v, i) in enumerate(sorted(terms, key=by)[:most])]
    return sorted(out)


def audited(docs, *args):
    return sorted(map(tuple, divergence.audit(docs, *args).collect()))


def test_audit_against_plain_counts(spark, odd, none, clashing):
    rng = random.Random(4)
    words = [f"w{'abcdefghij'[k % 10]}{'klmnop'[k // 10 % 6]}" + "é" * (k % 3) for k in range(150)]
    rows = [(" ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(150)], k=rng.randint(0, 80))).title(), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None, "é"])) for _ in range(260)]
    rows += rows[:40] + [("zz " * 5000, "en", "long"), ("", "en", "empty"), (None, "de", "x"), ("once", "de", "y"), ("12 3", "xx", "alone")]
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    assert audited(docs) == plain_audit(rows, 10, 10)
    assert audited(docs, 2, 3) == plain_audit(rows, 2, 3)
    plain = [(r["text"], r["lang"], r["source"]) for r in odd.collect()]
    assert audited(odd, 3, 10) == plain_audit(plain, 3, 10) == audited(clashing, 3, 10)
    assert audited(none) == []


def test_audit_in_many_tasks_and_tiles(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(" ".join(rng.choices([a + b for a in "abcdefgh" for b in "klmnopqrst"], k=60)), "en", f"s{k % 7}") for k in range(200)]
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string").repartition(5)
    monkeypatch.setattr(divergence, "WORDS", 50)
    monkeypatch.setattr(divergence, "GROUPS", 0)
    assert audited(docs) == plain_audit(rows, 10, 10)
    source, p, bits = np.array([0, 0, 1, 2, 2]), np.array([5, 9, 7, 5, 8]), np.array([3, 12, 9, 1, 14], dtype=np.uint64)
    whole, tiled = np.zeros((3, 3), dtype=np.int64), np.zeros((3, 3), dtype=np.int64)
    divergence.block_cells(source, p, np.full(5, 2), bits, whole)
    divergence.block_cells(source, p, np.full(5, 2), bits, tiled, tile=2)
    assert (whole == tiled).all() and whole.any()


def whitened(spark, vectors, **args):
    table = spark.createDataFrame([(k, v) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    return table, whitening.query(table, **args)


def against_numpy(rows, vectors, most):
    fine = {k: v for k, v in enumerate(vectors) if v and all(c is not None and math.isfinite(c) for c in v)}
    x = {k: tuple(math.floor(64 * float(np.float32(c))) + 1000000 for c in v) for k, v in fine.items()}
    fit = sorted(set(x.values()))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(v, sums, strict=True)] for v in fit])
    values, columns = np.linalg.eigh(centred.T @ centred / n)
    values, columns = values[::-1], columns[:, ::-1]
    rank = sum(values > 1e-9 * max(values[0], 1e-300))
    kept = min(most, rank)
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert set(got) == {(k, c) for k in x for c in range(1, kept + 1)}
    for c in range(1, kept + 1):
        want = {k: float(np.dot([float(Fraction(n * a - s, n)) for a, s in zip(v, sums, strict=True)], columns[:, c - 1]) / math.sqrt(values[c - 1])) for k, v in x.items()}
        gap = min(abs(values[c - 1] - values[i]) for i in range(len(values)) if i != c - 1) if len(values) > 1 else 1
        one = [got[k, c]["whitened"] for k in x]
        sign = math.copysign(1, np.dot(one, list(want.values())))
        if gap > 1e-6 * values[0]:
            assert one == pytest.approx([sign * w for w in want.values()], abs=1e-7)
        for k, v in x.items():
            r = got[k, c]
            assert r["n"] == n and r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))
            assert r["explained"] == pytest.approx(values[c - 1] / values.sum(), rel=1e-9) and r["identity_error"] < 1e-8


def test_whitening_against_full_decomposition(spark):
    rng = np.random.default_rng(2)
    spread = (rng.standard_normal((300, 24)) * np.linspace(3, 0.2, 24)) @ np.linalg.qr(rng.standard_normal((24, 24)))[0]
    vectors = [list(map(float, v)) for v in spread]
    vectors += vectors[:50] + vectors[:1] * 200
    odd = [None, [], [1.0], [float("nan")] * 24, [None] + [1.0] * 23, [float("inf")] * 24]
    _, out = whitened(spark, vectors + odd)
    against_numpy(out.collect(), vectors + [None] * len(odd), 16)


def test_whitening_without_full_rank_and_with_equal_variances(spark):
    rng = np.random.default_rng(3)
    flat = rng.standard_normal((80, 4)) @ rng.standard_normal((4, 9))
    vectors = [[*map(float, np.round(v, 3)), 2.0] for v in flat]  # rounding leaves a little variance in all but the last
    _, out = whitened(spark, vectors, most=20)
    against_numpy(out.collect(), vectors, 20)
    cross = [[float(s * (k == j)) for k in range(6)] for j in range(6) for s in (1, -1)]  # all variances are equal
    _, out = whitened(spark, cross)
    rows = out.collect()
    assert {r["component"] for r in rows} == set(range(1, 7)) and all(r["identity_error"] < 1e-12 and r["explained"] == pytest.approx(1 / 6) for r in rows)


def test_whitening_of_little_and_of_large(spark):
    table, out = whitened(spark, [])
    assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitened(spark, [[1.0, 2.0]] * 3)[1].collect() == []
    big = [[1e30, 0.0], [-1e30, 1.0], [0.0, 2.0]]
    rows = whitened(spark, big)[1].collect()
    assert len(rows) == 3 and sorted(r["deviation"] is None for r in rows) == [False, True, True]  # the second variance is nothing beside the first
    clash = spark.createDataFrame([(None, [1.0, 0.5], 1), (2, [0.0, 3.0], 2), (2, [4.0, 1.0], 3)], "vec_id long, embedding array<float>, n int").withColumn("component", F.lit("mine")).withColumn("x", F.lit(0))
    assert sorted(str(r["vec_id"]) for r in whitening.query(clash).collect()) == ["2"] * 4 + ["None"] * 2


def test_partial_sums_meet_in_tasks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vectors = [list(map(float, v)) for v in rng.standard_normal((60, 5))]
    plain = whitened(spark, vectors)[1].collect()
    monkeypatch.setattr(whitening, "PARTS", 1)
    table = spark.createDataFrame([(k, v) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(6)
    monkeypatch.setattr(whitening, "stored", lambda df, name: df.repartition(6))
    monkeypatch.setattr(whitening, "drop_stored", lambda df: None)
    for a, b in zip(sorted(plain), sorted(whitening.query(table).collect()), strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:])
