"""Approximate nearest neighbours by learned partitions.

A bounded sample gets its exact neighbour graph; the graph is cut into parts of equal size that keep neighbours together;
a small network learns to tell the part from the vector. Every row is indexed in its most probable part, a query is
compared with all rows of its most probable parts. How many parts that takes is measured on sample rows that the network
hasn't seen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from gridloom.llm.vectors import best, blocks, met, of_commonest_size, unpack, usable
from gridloom.session import settle

#: Rows that the partition is learned from at most.
SAMPLE = 8192
PARTS = 32
#: Share of true neighbours that unseen sample rows must find in their parts.
RECALL = 0.93
NEIGHBOURS, HIDDEN, EPOCHS = 12, 96, 20
BLOCK, QUERY_BLOCK = 2048, 512


def neighbour_graph(data: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest other rows of each row."""
    norms = (data * data).sum(axis=1)
    out = np.zeros((len(data), k), np.int64)
    for lo in range(0, len(data), 1024):
        d = norms[None, :] - 2 * data[lo : lo + 1024] @ data.T
        d[np.arange(len(d)), lo + np.arange(len(d))] = np.inf
        out[lo : lo + 1024] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 7) -> np.ndarray:
    """Cut a neighbour graph into parts of equal size (give or take one step of refinement) with few edges between them.

    Halves again and again along the slowest mode of diffusion over the graph, then moves single rows to the part that
    most of their neighbours have, as long as no part grows beyond a twentieth over its share.
    """
    n, k = graph.shape
    random = np.random.default_rng(seed)
    source, target = np.repeat(np.arange(n), k), graph.ravel()
    source, target = np.concatenate([source, target]), np.concatenate([target, source])
    label = np.zeros(n, np.int64)
    for level in range(int(np.log2(parts))):
        inside = label[source] == label[target]
        s, t = source[inside], target[inside]
        degree = np.maximum(1, np.bincount(s, minlength=n))
        size = np.maximum(1, np.bincount(label, minlength=1 << level))
        wave = random.normal(size=n)
        for _ in range(60):
            wave = 0.5 * wave + 0.5 * np.bincount(s, weights=wave[t], minlength=n) / degree
            mean = np.bincount(label, weights=wave, minlength=1 << level) / size
            wave -= mean[label]
            wave /= np.sqrt(np.bincount(label, weights=wave * wave, minlength=1 << level) / size)[label] + 1e-12
        order = np.lexsort((wave, label))
        rank = np.empty(n, np.int64)
        starts = np.concatenate([[0], np.cumsum(np.bincount(label, minlength=1 << level))])
        rank[order] = np.arange(n) - starts[label[order]]
        label = 2 * label + (rank >= (size[label] + 1) // 2)
    capacity = int(1.05 * n / parts) + 1
    sizes = np.bincount(label, minlength=parts)
    for _ in range(4):
        votes = np.bincount(source * parts + label[target], minlength=n * parts).reshape(n, parts)
        gain = votes.max(axis=1) > votes[np.arange(n), label]
        for i in random.permutation(np.flatnonzero(gain)):
            to = int(votes[i].argmax())
            if sizes[to] < capacity:
                sizes[label[i]] -= 1
                sizes[to] += 1
                label[i] = to
    return label


class Router:
    """A network with one hidden layer from a vector to the probabilities of the parts."""

    def __init__(self, data: np.ndarray, target: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 11):
        random = np.random.default_rng(seed)
        self.mean, self.spread = data.mean(axis=0), float(data.std()) or 1.0
        x = (data - self.mean) / self.spread
        sizes = [(x.shape[1], hidden), (hidden,), (hidden, target.shape[1]), (target.shape[1],)]
        self.weights = [random.normal(size=s) / np.sqrt(s[0]) if len(s) > 1 else np.zeros(s) for s in sizes]
        first, second = [np.zeros(s) for s in sizes], [np.zeros(s) for s in sizes]
        step = 0
        for epoch in range(epochs):
            rate = 0.004 * (1 - epoch / epochs) + 1e-4
            order = random.permutation(len(x))
            for lo in range(0, len(x), 256):
                rows = order[lo : lo + 256]
                step += 1
                for w, g, m, v in zip(self.weights, self._gradient(x[rows], target[rows]), first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def plain(self) -> tuple:
        """The router as arrays, for tasks that don't have this package."""
        return self.mean, self.spread, self.weights

    @classmethod
    def of(cls, plain: tuple) -> Router:
        own = cls.__new__(cls)
        own.mean, own.spread, own.weights = plain
        return own

    def _forward(self, x):
        a, b, c, d = self.weights
        inner = np.maximum(0, x @ a + b)
        return inner, inner @ c + d

    def _gradient(self, x, target):
        inner, out = self._forward(x)
        p = np.exp(out - out.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        back = (p - target) / len(x)
        inside = (back @ self.weights[2].T) * (inner > 0)
        return x.T @ inside, inside.sum(axis=0), inner.T @ back, back.sum(axis=0)

    def ranked(self, data: np.ndarray, n: int) -> np.ndarray:
        """The n most probable parts of each row, best first; one row's answer doesn't depend on its batch."""
        out = self._forward((data - self.mean) / self.spread)[1]
        return np.argsort(-np.round(out, 6), axis=1, kind="stable")[:, :n]


def learn(data: np.ndarray, parts: int = PARTS, recall: float = RECALL, top: int = 10) -> tuple[Router, int]:
    """Graph, parts and router from a sample, and the number of parts that a query must look at."""
    unseen = len(data) // 8
    seen = data[unseen:]
    k = min(NEIGHBOURS, len(seen) - 1)
    if k < 1 or parts < 2:
        return Router(data, np.ones((len(data), 1)), epochs=0), 1
    graph = neighbour_graph(seen, k)
    label = balanced_parts(graph, parts)
    # The target of a row is where its neighbours are, itself included.
    target = np.zeros((len(seen), parts))
    np.add.at(target, (np.repeat(np.arange(len(seen)), k), label[graph].ravel()), 1.0)
    target[np.arange(len(seen)), label] += k / 2
    router = Router(seen, target / target.sum(axis=1, keepdims=True))
    if not unseen:
        return router, parts
    # Indexed as all rows will be; neighbours in the whole table are nearer than these, so the estimate is a careful one.
    homes = router.ranked(seen, 1)[:, 0]
    d = (seen * seen).sum(axis=1)[None, :] - 2 * data[:unseen] @ seen.T
    true = homes[np.argpartition(d, min(top, len(seen)) - 1, axis=1)[:, :top]]
    order = router.ranked(data[:unseen], parts)
    place = np.argsort(order, axis=1)[np.arange(unseen)[:, None], true]
    found = np.cumsum(np.bincount(place.ravel(), minlength=parts)) / place.size
    return router, int(np.searchsorted(found, recall - 1e-12)) + 1


def nearest_in_block(
    ids: np.ndarray, data: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, top: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vec, distance) of every query's nearest in one block."""
    norms, own = (data * data).sum(axis=1), (queries * queries).sum(axis=1)
    rough = norms[None, :] + own[:, None] - 2 * queries @ data.T
    rough[query_ids[:, None] == ids[None, :]] = np.inf
    slack = 1e-9 * (norms.max(initial=0) + own)
    out = ([], [], [])
    for i, q in enumerate(query_ids):
        near = np.flatnonzero(np.isfinite(rough[i]))
        if len(near) > top:
            limit = np.partition(rough[i], top - 1)[top - 1] + slack[i]
            near = np.flatnonzero(rough[i] <= limit)
        distance = np.sqrt(((data[near] - queries[i]) ** 2).sum(axis=1))
        pick = np.lexsort((ids[near], distance))[:top]
        for values, x in zip(out, (np.full(len(pick), q), ids[near][pick], distance[pick])):
            values.append(x)
    return tuple(np.concatenate(x) if x else np.zeros(0) for x in out)


def nearest(
    table: DataFrame, is_query, top: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
    parts: int = PARTS, recall: float = RECALL, sample: int = SAMPLE, block: int = BLOCK, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``top`` smallest Euclidean distances among the parts it is sent to.

    ``is_query`` is a condition on ``id``; candidates are all rows with another id. Ties go to the smaller id. Vectors that are
    null, zero, hold null or non-finite components or have another size than most take no part. Rows that repeat an id and
    vector are one candidate. A query whose parts hold fewer than ``top`` others is sent to all parts, and one that lies apart from
    the rows of its part to all that reach nearer than the last it found. Other columns are left alone; an empty table gives an empty result.
    ``sample`` bounds the rows that are learned from (and what the driver gets); every row is indexed, whatever its part holds.
    """
    rows, n, _ = of_commonest_size(usable(table, id_col, vector_col, zero=False).distinct())
    learned = rows.groupBy("vector").agg(F.min("id").alias("id")).orderBy(F.xxhash64("id"), "id").limit(sample).select("vector")
    data = np.array([r[0] for r in learned.toLocalIterator()])
    if not len(data):
        empty = StructType([StructField("query_id", LongType()), StructField("vec_id", LongType()), StructField("score", DoubleType())])
        return best(table.sparkSession.createDataFrame([], empty), top, descending=False)
    # Small tables have small parts: a part should hold a few neighbourhoods at least.
    parts = 1 << int(np.log2(max(1, min(parts, len(data) // (4 * NEIGHBOURS)))))
    router, probes = learn(data, parts, recall, top)
    shared = table.sparkSession.sparkContext.broadcast(router.plain())
    routed = StructType([*rows.schema, StructField("parts", ArrayType(LongType()))])

    def route(batches):
        router = Router.of(shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            order = router.ranked(vectors, probes).astype(np.int64)
            offsets = pa.array(np.arange(len(order) + 1, dtype=np.int32) * order.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(order.ravel()))], names=routed.names)

    ranked = settle(rows.select("id", "vector").mapInArrow(route, routed))
    index = blocks(ranked.select("id", "vector", F.element_at("parts", 1).alias("part")), n, block)
    result = StructType([StructField("query_id", LongType()), StructField("vec_id", LongType()), StructField("score", DoubleType())])

    def search(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                d_ids, d, q_ids, q = (batch.column(c)[i].as_py() for c in range(4))
                q, v, s = nearest_in_block(*unpack(d_ids, d), *unpack(q_ids, q), top)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q.astype(np.int64)), pa.array(v.astype(np.int64)), pa.array(s.astype(float))], names=result.names)

    def asked(queries: DataFrame, wanted) -> DataFrame:
        spread = queries.select("id", "vector", F.explode(wanted).alias("part"))
        packed = blocks(spread, spread.count(), query_block)
        pairs = index.select(F.col("block").alias("d_block"), "part").join(
            packed.select(F.col("block").alias("q_block"), "part"), "part").select("d_block", "q_block")
        return best(met(index, packed, pairs).mapInArrow(search, result), top, descending=False)

    queries = ranked.where(is_query)
    found = settle(asked(queries, F.col("parts")))
    if probes == parts:
        return found
    # A query whose last one found is farther than rows of its part are from each other lies apart from its part: it goes on
    # to every part that reaches nearer than that.
    last = found.where(F.col("rank") == top).select(F.col("query_id").alias("id"), F.col("score").alias("last"))
    wider = StructType([*rows.schema, StructField("more", ArrayType(LongType()))])
    typical = table.sparkSession.sparkContext.broadcast(part_shapes(data, router.ranked(data, 1)[:, 0], parts))

    def widen(batches):
        centres, apart, reach = typical.value
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            limit = np.nan_to_num(batch.column(3).to_numpy(zero_copy_only=False), nan=np.inf, posinf=np.inf)
            far = (vectors * vectors).sum(axis=1)[:, None] - 2 * vectors @ centres.T + (centres * centres).sum(axis=1)
            near = np.sqrt(np.maximum(far, 0)) - reach <= limit[:, None]
            homes = batch.column(2).to_pylist()
            outside = limit > apart[[h[0] for h in homes]]
            more = [np.setdiff1d(np.flatnonzero(row & out), seen).tolist() for row, out, seen in zip(near, outside, homes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(more, pa.list_(pa.int64()))], names=wider.names)

    more = settle(queries.join(last, "id", "left").select("id", "vector", "parts", "last").mapInArrow(widen, wider).where(F.size("more") > 0))
    if more.isEmpty():
        return found
    return best(found.drop("rank").union(asked(more, F.col("more")).drop("rank")), top, descending=False)


def part_shapes(data: np.ndarray, part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre of each part, the usual distance of two of its rows, and how far its rows are from the centre at most.

    A part without rows has no usual distance, and reaches everywhere.
    """
    n = np.bincount(part, minlength=parts)
    centres = np.zeros((parts, data.shape[1]))
    np.add.at(centres, part, data)
    centres /= np.maximum(n, 1)[:, None]
    away = ((data - centres[part]) ** 2).sum(axis=1)
    reach = np.where(n > 0, 0.0, np.inf)
    np.maximum.at(reach, part, np.sqrt(away))
    return centres, np.sqrt(2 * np.bincount(part, weights=away, minlength=parts) / np.maximum(n, 1)), reach
