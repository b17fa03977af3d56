import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import whitening
from gridloom.llm.queries import QUERIES
from tests.llm.helpers import write

VECTORS = "vec_id long, embedding array<double>"


def vectors(n=200, d=20, seed=3):
    r = np.random.default_rng(seed)
    return (r.normal(size=(n, d)) @ r.normal(size=(d, d)) * 0.3).tolist()


def awkward_vectors():
    rows = list(enumerate(vectors()))
    rows += [(i, v) for i, v in rows[:70]] + [(None, rows[5][1]), (None, rows[6][1])] + [(1000 + i, rows[3][1]) for i in range(90)]
    bad = [None, [], [1.0] * 19, [None] + [0.0] * 19, [math.nan] + [0.0] * 19, [math.inf] + [0.0] * 19, [1e300] + [0.0] * 19]
    return rows + [(2000 + i, v) for i, v in enumerate(bad)] + [(3000, [0.0] * 20), (3001, [-0.001] * 20)]


def good(rows, d):
    return [(i, v) for i, v in rows if v is not None and len(v) == d and all(x is not None and abs(x) < 1e16 for x in v)]


def check(got, rows, d):
    """Against floating eigenvectors of the exact covariance."""
    rows = good(rows, d)
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows], object)
    fit = np.array(sorted({tuple(r) for r in x.tolist()}), object)
    n, sums = len(fit), fit.sum(axis=0)
    away = n * fit - sums
    cov = (away.T @ away).astype(float) / n**3
    e, vectors = np.linalg.eigh(cov)
    order = [i for i in np.argsort(-e) if e[i] > 1e-9 * max(e[-1], 1)][:16]
    assert len(got) == len(rows) * len(order)
    w = ((n * x - sums).astype(float) / n) @ vectors[:, order] / np.sqrt(e[order])
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    by = {}
    for r in got:
        assert r["n"] == n and r["identity_error"] < 1e-8
        assert abs(r["explained"] / (e[order[r["component"] - 1]] / np.trace(cov)) - 1) < 1e-9
        by.setdefault((r["vec_id"], int(r["deviation"])), {}).setdefault(r["component"], []).append(r["whitened"])
    want = {}
    for (i, _), row, dev in zip(rows, w, deviation):
        want.setdefault((i, int(dev)), []).append(row)
    assert by.keys() == want.keys()
    sign = {}
    for key, lines in want.items():
        for c in range(len(order)):
            a, b = sorted(by[key][c + 1]), sorted(line[c] for line in lines)
            if abs(b[0]) > 0.1:
                sign.setdefault(c, 1 if a[0] * b[0] > 0 and len(b) == 1 else None)
                sign[c] = sign[c] or (1 if np.allclose(a, b, rtol=1e-6, atol=1e-6) else -1)
    for key, lines in want.items():
        for c in range(len(order)):
            assert np.allclose(sorted(by[key][c + 1]), sorted(sign[c] * line[c] for line in lines), rtol=1e-6, atol=1e-7)


def test_query_on_awkward_vectors(spark, tmp_path):
    table = spark.createDataFrame(awkward_vectors(), VECTORS).withColumns({c: F.lit("x") for c in ("vector", "packed", "n", "component", "deviation")})
    got = QUERIES["op11_whitening"](spark, write(table, tmp_path, "embeddings")).collect()
    check(got, awkward_vectors(), 20)


def test_given_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, list(map(float, r.embedding))) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    check(QUERIES["op11_whitening"](spark, folder).collect(), rows, len(rows[0][1]))


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None), (2, [])]])
def test_nothing_to_whiten(spark, rows):
    made = whitening.whiten(spark.createDataFrame(rows, VECTORS))
    assert made.count() == 0 and made.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_equal_eigenvalues_and_few_dimensions(spark):
    cross = [(i, [float(s * (i == j)) for j in range(5)]) for i in range(5) for s in (1, -1)]
    got = whitening.whiten(spark.createDataFrame(cross, VECTORS)).collect()
    assert len(got) == 50 and all(abs(r.explained - 0.2) < 1e-12 and r.identity_error < 1e-12 for r in got)
    flat = [(i, [i * 1.0, i * 2.0, 7.0]) for i in range(9)]
    got = whitening.whiten(spark.createDataFrame(flat, VECTORS)).collect()
    assert len(got) == 9 and all(r.component == 1 and abs(r.explained - 1) < 1e-15 and r.identity_error < 1e-12 for r in got)


def test_very_large_entries(spark):
    rows = [(i, [(-1) ** i * 2.0**52 * (i + 1), float(i % 3), i * 1e9]) for i in range(12)]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    x = [[math.floor(64 * Fraction(c)) for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    want = {i: sum((12 * a - s) ** 2 for a, s in zip(row, sums)) for i, row in enumerate(x)}
    assert {r.vec_id: r.deviation for r in got} == {i: d if d < 10**38 else None for i, d in want.items()}
    assert {r.component for r in got} == {1, 2, 3}


def test_polynomial_and_roots(spark):
    r = np.random.default_rng(1)
    for d in (1, 2, 7, 12):
        m = r.integers(-50, 50, (d, d))
        m = (m @ m.T).tolist()
        coefficients = whitening.characteristic_polynomial(spark, m)
        assert np.allclose(np.array(coefficients[::-1], float), np.poly(np.array(m, float)), rtol=1e-6)
        e = np.sort(np.linalg.eigvalsh(np.array(m, float)))[::-1]
        roots = [float(v) for v, n in whitening.largest_roots(coefficients, 5) for _ in range(n)]
        assert np.allclose(roots, e[: len(roots)], rtol=1e-9) and len(roots) == min(5, d)
        for v, n in whitening.largest_roots(coefficients, 5):
            vector = whitening.null_vectors(m, v, n)[0]
            assert np.allclose(np.array(m) @ vector, float(v) * vector, atol=1e-9 * e[0])
    # A root of three times, at a place where intervals are halved.
    triple = np.poly1d([1, -2]) ** 3 * np.poly1d([1, -8])
    found = whitening.largest_roots([int(x) for x in triple.coeffs[::-1]], 4)
    assert [n for _, n in found] == [1, 3] and abs(found[0][0] - 8) < 1e-30 and abs(found[1][0] - 2) < 1e-25
    assert not whitening.is_prime(2**31 - 3) and whitening.is_prime(2**31 - 1)
