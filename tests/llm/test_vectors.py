import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import ann, exact_topk
from gridloom.llm.queries import ORACLES, QUERIES
from tests.llm.helpers import rows, write
from tools.check import compare, connect

SMALL = "/root/testdata/sf0.001"
SHAPE = "vec_id long, embedding array<float>, label int"


def clustered(n, dim=8, seed=1):
    """Clusters of different spread and length, many equal vectors, ties."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, dim)) * 3
    x = centres[r.integers(0, 12, n)] + r.normal(size=(n, dim)) * r.choice([0.05, 0.5, 1.5], n)[:, None]
    x[: n // 3] = centres[0]
    return np.float32(x)


def odd_rows(dim=8):
    nan, inf = float("nan"), float("inf")
    return [(None, [1.0] * dim), (100000, None), (100050, [nan] + [1.0] * (dim - 1)), (100100, [inf] + [1.0] * (dim - 1)),
            (100150, [None] + [1.0] * (dim - 1)), (100200, []), (100250, [0.0] * dim), (100300, [1.0] * (dim + 1)), (100301, [1e30] * dim)]


def frame(spark, x, extra=()):
    return spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in enumerate(x)] + [(i, v, 0) for i, v in extra], SHAPE)


def test_exact_against_brute_force(spark, tmp_path):
    x = clustered(700)
    folder = write(frame(spark, x, odd_rows()), tmp_path, "embeddings")
    got = rows(QUERIES["op8_exact_topk"](spark, folder))
    ids = [*range(700), 100250]
    v = np.floor(256 * np.vstack([x.astype(float), np.zeros((1, 8))])).astype(np.int64)
    want = []
    for i, q in enumerate(ids):
        if q % 50 == 0:
            scores = sorted((-int(v[i] @ v[j]), ids[j]) for j in range(len(ids)) if j != i)[:5]
            want += [(q, k + 1, j, -s) for k, (s, j) in enumerate(scores)]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("bucket, block, threshold", [(16, 8, 0.0), (64, 1000, 2.0), (5, 3, 0.5)])
def test_exact_in_many_buckets(spark, monkeypatch, bucket, block, threshold):
    """Both ways of pruning, alone and mixed, over small buckets."""
    monkeypatch.setattr(exact_topk, "BY_COORDINATE", threshold)
    x = clustered(200, dim=5, seed=bucket)
    v = np.floor(256 * x.astype(float)).astype(np.int64)
    got = rows(exact_topk.largest_products(frame(spark, x), F.col("id") % 7 == 0, top=4, bucket=bucket, query_block=block))
    want = []
    for q in range(0, 200, 7):
        want += [(q, k + 1, j, -s) for k, (s, j) in enumerate(sorted((-int(v[q] @ v[j]), j) for j in range(200) if j != q)[:4])]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("threshold", [0.0, 0.5, 2.0])
def test_bucket_search_loses_nothing(threshold):
    r = np.random.default_rng(4)
    for dim in (1, 2, 6):
        data = np.floor(r.normal(size=(300, dim)) * r.choice([1, 30, 300], 300)[:, None])
        queries = np.vstack([np.floor(r.normal(size=(20, dim)) * 50), np.zeros((1, dim))])
        full = data @ queries.T
        bounds = np.sort(full, axis=0)[-3 - np.arange(21) % 3, np.arange(21)]
        q, v, s = exact_topk.search_bucket(np.arange(300), data, 1000 + np.arange(21), queries, bounds, 3, threshold)
        for i in range(21):
            want = sorted(((-full[j, i], j) for j in range(300) if full[j, i] >= bounds[i]))[:3]
            assert sorted(zip(-s[q == 1000 + i], v[q == 1000 + i])) == want


def test_large_components_are_exact():
    data = np.array([[2.0**26, 3.0], [2.0**26 - 1, 5.0]])
    scores, fits = exact_topk.products(data, np.array([2.0**26, 7.0]))
    assert scores.tolist() == [2**52 + 21, (2**26 - 1) * 2**26 + 35] and fits.all()
    data = np.array([[2.0**31, 1.0], [-(2.0**32), 0.0], [2.0**60, 3.0], [1e300, -1e300], [0.0, 5.0], [-(2.0**40), 2.0**9]])
    for query in (np.array([2.0**31, 9.0]), np.array([1e300, 1e300]), np.array([1.0, 1.0])):
        want = [sum(int(a) * int(b) for a, b in zip(row, query)) for row in data]
        scores, fits = exact_topk.products(data, query)
        assert fits.tolist() == [-(2**63) <= w < 2**63 for w in want]
        assert [s for s, f in zip(scores.tolist(), fits) if f] == [w for w in want if -(2**63) <= w < 2**63]


def test_no_finite_vector_is_left_out(spark):
    r = np.random.default_rng(8)
    x = [*(r.normal(size=(300, 2)) * r.choice([1, 1e3, 1e6, 1e8], 300)[:, None]).tolist(), [300000.0, 0.0], [2.0**40, 2.0**40], [1e200, 0.0], [0.0, 0.0]]
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = rows(exact_topk.largest_products(table, F.col("id") % 3 == 0, top=5, bucket=32, query_block=16))
    v = [[math.floor(256 * Fraction(c)) for c in row] for row in x]
    want = []
    for q in range(0, len(x), 3):
        scores = sorted((-(v[q][0] * w[0] + v[q][1] * w[1]), j) for j, w in enumerate(v) if j != q)
        want += [(q, k + 1, j, -s) for k, (s, j) in enumerate([p for p in scores if -(2**63) < p[0] <= 2**63][:5])]
    assert got == sorted(want, key=repr)


def test_exact_oracle(spark):
    assert compare(QUERIES["op8_exact_topk"](spark, SMALL), connect(SMALL), ORACLES["op8_exact_topk"]) is None


def nearest_by_force(x, ids, every, top):
    out = {}
    for i, q in enumerate(ids):
        if q % every == 0:
            d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
            out[q] = sorted((d[j], ids[j]) for j in range(len(ids)) if j != i)[:top]
    return out


def test_nearest_recall_ties_and_odd_rows(spark, tmp_path):
    x = clustered(3000, seed=2)
    folder = write(frame(spark, x, odd_rows()), tmp_path, "embeddings")
    got = QUERIES["op2_ann"](spark, folder).collect()
    ids = [*range(3000), 100301]
    want = nearest_by_force(np.vstack([x.astype(float), np.full((1, 8), float(np.float32(1e30)))]), ids, 100, 10)
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    assert set(by) == set(want)
    hits = 0
    for q, found in by.items():
        found.sort()
        assert [k for k, _, _ in found] == list(range(1, 11))
        assert [(s, v) for _, s, v in found] == sorted((s, v) for _, s, v in found)
        hits += len({v for _, _, v in found} & {v for _, v in want[q]})
        if q < 1000:  # one of the equal vectors: its nearest are the others with the least ids
            assert {v for _, _, v in found} == {v for _, v in want[q]}
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_nearest_small_and_empty(spark):
    few = frame(spark, clustered(6, seed=3), [(0, [9.0] * 8)])
    got = ann.nearest(few, F.col("id") == 2, top=10).collect()
    assert len(got) == 6 and got[0].query_id == 2
    assert ann.nearest(few.limit(0), F.col("id") == 2).count() == 0
    assert exact_topk.largest_products(few.limit(0), F.col("id") == 2).count() == 0
    assert ann.nearest(few, F.col("id") == 77).count() == 0 == exact_topk.largest_products(few, F.col("id") == 77).count()


def test_every_query_has_its_neighbours(spark):
    """Four groups of 2000 vectors and four of 3: queries in small groups have their neighbours in other parts."""
    r = np.random.default_rng(6)
    centres = r.normal(size=(8, 16)) * 20
    group = np.repeat(np.arange(8), [2000] * 4 + [3] * 4)
    x = np.float32(centres[group] + r.normal(size=(len(group), 16)))
    ids = np.arange(len(x))
    wanted = [*range(0, 8000, 100), *range(8000, 8012)]
    got = ann.nearest(frame(spark, x), F.col("id").isin(wanted), top=10).collect()
    found = {q: {r.vec_id for r in got if r.query_id == q} for q in wanted}
    assert all(len(f) == 10 for f in found.values())
    d = ((x.astype(float)[wanted][:, None] - x.astype(float)[None]) ** 2).sum(axis=2)
    d[np.arange(len(wanted)), wanted] = np.inf
    recall = [len(found[q] & set(ids[np.argsort(d[i], kind="stable")[:10]])) / 10 for i, q in enumerate(wanted)]
    for g in range(8):
        assert np.mean([x for x, q in zip(recall, wanted) if group[q] == g]) >= 0.9


def test_parts_are_balanced_and_keep_neighbours():
    x = clustered(1500, seed=5)[500:]
    graph = ann.neighbour_graph(x, 10)
    label = ann.balanced_parts(graph, 8)
    sizes = np.bincount(label, minlength=8)
    assert sizes.max() <= 1.05 * 125 + 1
    assert (label[graph] == label[:, None]).mean() > 0.5


def test_tasks_get_plain_arrays():
    """What is broadcast has no class of this package in it, which executors needn't have."""
    import pickle

    from gridloom.llm import quality

    router, _ = ann.learn(clustered(400, seed=9), 4)
    model = quality.Model(np.zeros(3), 0.1, 1.0, 0.0)
    assert b"gridloom" not in pickle.dumps((router.plain(), model.plain()))
    assert (ann.Router.of(router.plain()).ranked(clustered(5), 2) == router.ranked(clustered(5), 2)).all()
