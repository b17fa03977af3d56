"""Vectors as Spark rows and as blocks: rows of bounded size that hold many vectors as one matrix."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

from gridloom.llm.common import ready
from gridloom.session import settle

BLOCK_FIELDS = [
    StructField("block", LongType()), StructField("part", LongType()), StructField("ids", BinaryType()),
    StructField("matrix", BinaryType()), StructField("low", DoubleType()), StructField("high", DoubleType()),
]


def usable(table: DataFrame, id_col: str, vector_col: str, zero: bool) -> DataFrame:
    """id, vector (doubles) of the rows that can be compared, and their size.

    Vectors that are null, hold null or non-finite components, or differ from the commonest size, and rows without an id take no
    part; zero vectors only if ``zero`` says so.
    """
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where((F.size(vector_col) > 0) & finite)
    if not zero:
        rows = rows.where(F.exists(vector, lambda x: x != 0))
    return rows.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"))


def of_commonest_size(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """The rows whose vectors have the commonest size (the smallest of equals), their number and that size."""
    sizes = rows.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    if not sizes:
        return rows, 0, 0
    return rows.where(F.size("vector") == sizes[0]["size"]), sizes[0]["n"], sizes[0]["size"]


def blocks(rows: DataFrame, n_rows: int, size: int, order: str | None = None) -> DataFrame:
    """Pack (id, vector, part) into blocks of at most ``size`` vectors of one part, written once.

    Rows are spread by range of (part, order, hash of the id), so that a part or value that holds most rows is still many
    blocks of even size. ``low`` and ``high`` are the least and greatest ``order`` value in a block (0 without).
    """
    spark = ready(rows.sparkSession)
    keys = ["part", *([order] if order else []), "_spread"]
    rows = rows.withColumn("_spread", F.xxhash64("id"))
    dealt = rows.repartitionByRange(max(1, -(-n_rows // size)), *keys).sortWithinPartitions(*keys)
    columns = ["part", "id", "vector", *([order] if order else [])]
    names = [f.name for f in BLOCK_FIELDS]

    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def emit():
            nonlocal made
            ids, matrix, value = (np.concatenate(x) for x in list(zip(*held))[1:])
            row = [(task << 32) + made, held[0][0], ids.tobytes(), matrix.tobytes(), float(value.min()), float(value.max())]
            made += 1
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0).to_numpy()
            ids = batch.column(1).to_numpy()
            vector = batch.column(2)
            matrix = vector.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            value = batch.column(3).to_numpy().astype(float) if order else np.zeros(len(ids))
            edges = np.flatnonzero(np.diff(part, prepend=part[0] - 1)).tolist() + [len(part)]
            for lo, hi in zip(edges, edges[1:]):
                if held and held[0][0] != part[lo]:
                    yield emit()
                while lo < hi:
                    have = sum(len(h[1]) for h in held)
                    to = min(hi, lo + size - have)
                    held.append((int(part[lo]), ids[lo:to], matrix[lo:to], value[lo:to]))
                    lo = to
                    if have + len(held[-1][1]) >= size:
                        yield emit()
        if held:
            yield emit()

    return settle(dealt.select(*columns).mapInArrow(run, StructType(BLOCK_FIELDS)))


def met(data: DataFrame, queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """For (data block, query block) pairs the contents of both; joined by block, so no part gathers in a task."""
    d = reduce(lambda t, c: t.withColumnRenamed(c, f"d_{c}"), ("block", "ids", "matrix"), data.select("block", "ids", "matrix"))
    q = reduce(lambda t, c: t.withColumnRenamed(c, f"q_{c}"), ("block", "ids", "matrix"), queries.select("block", "ids", "matrix"))
    return pairs.join(d, "d_block").join(q, "q_block").select("d_ids", "d_matrix", "q_ids", "q_matrix")


def unpack(ids: bytes, matrix: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(matrix, np.float64).reshape(len(ids), -1)


def best(found: DataFrame, top: int, descending: bool) -> DataFrame:
    """query_id, rank, vec_id, score: the best rows of each query, ties to the smaller id, each id once."""
    score = F.desc("score") if descending else F.asc("score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(score, "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
