"""Exact largest inner products: vectors in buckets of similar length, pruned per bucket by length or by coordinates.

A query's k-th best score among the longest vectors bounds its final k-th score from below. In a bucket whose longest
vector has length L, only vectors with a cosine of at least bound / (|query| * L) can reach it. Above 1 the bucket is
skipped; a high threshold prunes by single coordinates, a low one by length; what is left is verified by its product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gridloom.llm.vectors import best, blocks, met, of_commonest_size, unpack, usable
from gridloom.session import settle

BUCKET, QUERY_BLOCK = 2048, 1024
#: From this local cosine on coordinates prune more than they cost.
BY_COORDINATE = 0.5
FOCUS = 3
#: Products below these are exact in double precision, and in 64-bit integers.
EXACT, LONG = float(1 << 53), float(1 << 62)
SLACK = 1e-9


def lengths(data: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((data * data).sum(axis=1))


def products(data: np.ndarray, query: np.ndarray, length: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Integer inner products, exact, and which of them fit in 64 bits (the others are 0 here).

    Doubles where they are exact, then 64-bit integers, and integers of any size for the rest.
    """
    length = lengths(data) if length is None else length
    with np.errstate(over="ignore", invalid="ignore"):
        bound = length * lengths(query[None])[0]
    fits = np.ones(len(data), bool)
    if not len(data) or bound.max() < EXACT:
        return np.rint(data @ query).astype(np.int64), fits
    out = np.zeros(len(data), np.int64)
    doubles = bound < EXACT
    out[doubles] = np.rint(data[doubles] @ query).astype(np.int64)
    longs = ~doubles & (bound < LONG) & (np.abs(data).max(axis=1) < LONG)
    if np.abs(query).max() >= LONG:
        longs[:] = False
    out[longs] = data[longs].astype(np.int64) @ query.astype(np.int64) if longs.any() else 0
    whole = [int(c) for c in query] if not (doubles | longs).all() else []
    for i in np.flatnonzero(~doubles & ~longs):
        value = sum(int(a) * b for a, b in zip(data[i], whole))
        fits[i] = -(2**63) <= value < 2**63
        out[i] = value if fits[i] else 0
    return out, fits


def _kth(scores: np.ndarray, top: int) -> float:
    return float(np.partition(scores, len(scores) - top)[len(scores) - top]) if len(scores) >= top else -np.inf


def search_bucket(
    ids: np.ndarray, data: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, top: int,
    by_coordinate: float = BY_COORDINATE,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vec, score) of every query's best in one bucket that reach its bound."""
    length = lengths(data)
    order = np.argsort(-length, kind="stable")
    ids, data, length = ids[order], data[order], length[order]
    unit = data / np.maximum(length, 1e-300)[:, None]
    found_q, found_v, found_s = [], [], []
    sizes = lengths(queries)
    for q, query, size, bound in zip(query_ids, queries, sizes, bounds):
        n = len(ids)
        rows = slice(0, n)
        if size > 0 and bound > 0:
            cosine = bound / (size * max(length[0], 1e-300))
            if cosine > 1 + SLACK:
                continue
            # Sorted by length: what is too short even in the query's direction is a tail.
            n = int(np.searchsorted(-length, -(bound / size) * (1 - SLACK), side="right"))
            rows = slice(0, n)
            if cosine >= by_coordinate:
                # A unit vector within the cosine of the query's direction lies within a band in every coordinate.
                direction = query / size
                focus = np.argsort(-np.abs(direction))[:FOCUS]
                near = np.ones(n, bool)
                for f in focus:
                    middle = direction[f] * cosine
                    reach = np.sqrt(max(0.0, (1 - cosine**2) * (1 - direction[f] ** 2))) + 1e-7
                    # Larger cosines than the threshold may lie nearer to the direction itself.
                    low = -1.0 if direction[f] <= -cosine else middle - reach
                    high = 1.0 if direction[f] >= cosine else middle + reach
                    near &= (unit[:n, f] >= low) & (unit[:n, f] <= high)
                rows = np.flatnonzero(near)
        scores, fits = products(data[rows], query, length[rows])
        names = ids[rows]
        good = (scores >= bound) & (names != q) & fits
        scores, names = scores[good], names[good]
        if len(scores) > top:
            good = scores >= _kth(scores, top)
            scores, names = scores[good], names[good]
            pick = np.lexsort((names, ~scores))[:top]
            scores, names = scores[pick], names[pick]
        found_q.append(np.full(len(names), q))
        found_v.append(names)
        found_s.append(scores)
    none = [np.zeros(0, np.int64)]
    return tuple(np.concatenate(x or none) for x in (found_q, found_v, found_s))


def largest_products(
    table: DataFrame, is_query, top: int = 5, factor: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding",
    bucket: int = BUCKET, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``top`` largest inner products of floor(factor * component).

    ``is_query`` is a condition on ``id``; candidates are all rows with another id. Ties go to the smaller id; fewer rows than
    ``top`` are all returned. Vectors that are null, hold null or non-finite components (before or after scaling) or have another
    size than most take no part; zero vectors do. A product that doesn't fit in 64 bits has no score, and its pair no row. Rows
    that repeat an id and vector are one candidate. Other columns are left alone; an empty table gives an empty result.
    """
    rows = usable(table, id_col, vector_col, zero=True)
    def whole(x):
        y = F.lit(factor) * x
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)  # larger doubles are integers

    scaled = F.transform("vector", whole)
    finite = F.forall("vector", lambda x: F.abs(F.lit(factor) * x) < float("inf"))
    rows = rows.where(finite).select("id", scaled.alias("vector")).distinct()
    rows, n, _ = of_commonest_size(rows)
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    rows = rows.withColumns({"length": -length, "part": F.lit(0).cast("long")})
    data = blocks(rows, n, bucket, "length")
    asked = rows.where(is_query)
    n_asked = asked.count()
    queries = blocks(asked, n_asked, query_block, "length")
    # The bucket of the longest vectors, of bounded size, gives every query its first bound.
    seeds = data.orderBy("low", "block").limit(1).select("ids", "matrix").collect()
    shared = table.sparkSession.sparkContext.broadcast([(bytes(r[0]), bytes(r[1])) for r in seeds])

    def first_bounds(query_ids, matrix):
        bounds = np.full(len(query_ids), -np.inf)
        for ids, data in shared.value:
            ids, data = unpack(ids, data)
            for i, q in enumerate(query_ids):
                scores, fits = products(data, matrix[i])
                bounds[i] = max(bounds[i], _kth(scores[fits & (ids != q)], top))
        return bounds

    needs = StructType([StructField("q_block", LongType()), StructField("need", data.schema["low"].dataType)])

    def need(batches):
        for batch in batches:
            found = []
            for ids, matrix in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                ids, matrix = unpack(ids, matrix)
                size = lengths(matrix)
                bounds = first_bounds(ids, matrix)
                # The length that a vector needs to reach the bound of at least one query.
                found.append(float(np.where((bounds > 0) & (size > 0), bounds / np.maximum(size, 1e-300), 0.0).min()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["q_block", "need"])

    wanted = queries.select("block", "ids", "matrix").mapInArrow(need, needs)
    # Bucket against block of queries, one row each; buckets too short for a whole block of queries drop out here. Lengths are
    # rounded to steps (a 64th of a doubling), of which doubles have a bounded number, so that the two sides join on them.
    def step(value):
        return F.when(value > 0, F.floor(64 * F.log2(F.least(value, F.lit(1e308))))).otherwise(F.lit(-100_000)).cast("int")

    reach = settle(data.select(F.col("block").alias("d_block"), (-F.col("low")).alias("longest")).withColumn("step", step(F.col("longest"))))
    there = sorted(r["step"] for r in reach.select("step").distinct().collect())
    least = F.col("need") * (1 - SLACK)
    steps = F.filter(F.array(*[F.lit(x) for x in there]).cast("array<int>"), lambda x: x >= step(least))
    asking = wanted.select("q_block", "need", F.explode(steps).alias("step"))
    pairs = reach.join(asking, "step").where(F.col("longest") >= least).select("d_block", "q_block")
    result = StructType([StructField(name, LongType()) for name in ("query_id", "vec_id", "score")])

    def search(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                d_ids, d, q_ids, q = (batch.column(c)[i].as_py() for c in range(4))
                ids, vectors = unpack(d_ids, d)
                query_ids, asked = unpack(q_ids, q)
                found = search_bucket(ids, vectors, query_ids, asked, first_bounds(query_ids, asked), top)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

    return best(met(data, queries, pairs).mapInArrow(search, result), top, descending=True)
