"""Best-fit-decreasing packing of pieces into sequences of fixed capacity, planned on the histogram of lengths.

Pieces of one length are alike, so the driver packs lengths with their counts: at most ``capacity`` rows whatever the
size of the table. A segment tree over remaining capacities finds the tightest open bin in logarithmic time, and one
step fills all bins of that capacity. The plan is a list of ranges (of the n-th pieces of a length, of bins); tasks look
up their pieces in it.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from gridloom.llm.bpe import encoder
from gridloom.llm.common import list_array, map_documents, ready
from gridloom.session import settle

CAPACITY = 2048


class TightestBin:
    """Segment tree over remaining capacities: does a range hold an open bin, and which is the least such capacity?"""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, capacity: int, present: bool) -> None:
        node = capacity + self.size
        self.any[node] = present
        while node > 1:
            node >>= 1
            self.any[node] = self.any[2 * node] or self.any[2 * node + 1]

    def at_least(self, capacity: int) -> int | None:
        node = capacity + self.size
        if self.any[node]:
            return capacity
        # Up until a right neighbour holds something, then down to its leftmost leaf.
        while node > 1 and not (node % 2 == 0 and self.any[node + 1]):
            node >>= 1
        if node <= 1:
            return None
        node += 1
        while node < self.size:
            node = 2 * node if self.any[2 * node] else 2 * node + 1
        return node - self.size


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Pack ``counts[length]`` pieces of each length; returns the ranges and the number of bins.

    A range is (length, first rank, pieces, pieces per bin, first bin, first offset): the pieces of that length with
    ranks from the first on go to consecutive bins, so many to each, one behind the other.
    """
    tree, opened = TightestBin(capacity), [deque() for _ in range(capacity + 1)]
    ranges, bins = [], 0

    def leave(room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            if not opened[room]:
                tree.set(room, True)
            opened[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.at_least(length)
            if room is None:
                per, room = capacity // length, capacity
                first, n = bins, -(-left // per)
                bins += n
            else:
                first, n = opened[room].popleft()
                if not opened[room]:
                    tree.set(room, False)
                per = room // length
            # A bin that took one piece is the tightest for the next one too, so it is filled first.
            used = min(n, -(-left // per))
            placed = min(left, used * per)
            ranges.append((length, rank, placed, per, first, capacity - room))
            whole = placed // per
            leave(room - per * length, first, whole)
            if used > whole:
                leave(room - (placed - whole * per) * length, first + whole, 1)
            leave(room, first + used, n - used)
            left, rank = left - placed, rank + placed
    return np.array(ranges, np.int64).reshape(-1, 6), bins


def cut(total: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces: only the first may be shorter than the capacity."""
    if total <= capacity:
        return [(0, total)]
    head = total % capacity or capacity
    return [(0, head), *((s, capacity) for s in range(head, total, capacity))]


def tokenize(
    docs: DataFrame, path: str | Callable[[], str], end_id: int = 0, capacity: int = CAPACITY,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 and, if asked for, the token ids.

    A document's ids are those of its text, then ``end_id``; null and empty texts have only that one. Special tokens that
    stand in a text are recognised. Null ids and repeated rows are kept, an empty table gives an empty result.
    """
    fields = [
        docs.schema[id_col], StructField("piece", IntegerType()), StructField("start", LongType()),
        StructField("length", LongType()), StructField("ids_crc32", LongType()),
    ]
    schema = StructType(fields)
    if with_ids:
        schema = StructType([*fields, StructField("ids", ArrayType(IntegerType()))])

    def start():
        tokens = encoder(path if isinstance(path, str) else path())

        def work(rows):
            ids, counts = tokens.encode(rows[text_col])
            ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
            view, at = memoryview(ids).cast("B"), 0
            out = {f.name: [] for f in fields}
            for key, n in zip(rows[id_col], (counts + 1).tolist()):
                for k, (s, length) in enumerate(cut(n, capacity)):
                    out[id_col].append(key)
                    out["piece"].append(k)
                    out["start"].append(s)
                    out["length"].append(length)
                    out["ids_crc32"].append(zlib.crc32(view[4 * (at + s) : 4 * (at + s + length)]))
                at += n
            if with_ids:
                out["ids"] = list_array(np.array(out["length"], np.int64), ids.astype(np.int32), pa.int32())
            return out

        return work

    return map_documents(docs, [id_col, text_col], text_col, schema, start)


def pack(pieces: DataFrame, length_col: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """The same rows and columns with ``sequence_id`` and ``offset``.

    Sequences are filled from offset 0 without gaps. A row without a length, or with one below 1 or over the capacity,
    fits nowhere and gets nulls. Ties (equal lengths) are told apart by where their rows stand. An empty table gives an
    empty result. The pieces are written once, so that a repeated task can't number them otherwise.
    """
    spark = ready(pieces.sparkSession)
    taken = {"sequence_id", "offset", "_task", "_nth"} & set(pieces.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are results of packing; rename them first")
    schema = StructType([*pieces.schema, StructField("_task", IntegerType()), StructField("_nth", LongType())])
    arrow, where = to_arrow_schema(schema), pieces.columns.index(length_col)

    def number(batches):
        task, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            nth = []
            for length in batch.column(where).to_pylist():
                seen[length] = n = seen.get(length, -1) + 1
                nth.append(n)
            columns = [*batch.columns, pa.array([task] * len(nth), pa.int32()), pa.array(nth, pa.int64())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    numbered = settle(pieces.mapInArrow(number, schema))
    length = F.col(length_col)
    fits = numbered.where((length >= 1) & (length <= capacity))
    per_task = fits.groupBy(length.alias("_length"), F.col("_task").alias("_of")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_length").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    bases = settle(per_task.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))))
    # At most one row per length: bounded by the capacity.
    counts = {r[0]: r[1] for r in bases.groupBy("_length").agg(F.sum("_n")).collect()}
    ranges, _ = plan(counts, capacity)
    order = np.lexsort((ranges[:, 1], ranges[:, 0]))
    ranges = ranges[order]
    final = StructType([*pieces.schema, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    final_arrow = to_arrow_schema(final)
    shared = spark.sparkContext.broadcast(ranges)

    def place(batches):
        ranges = shared.value
        for batch in batches:
            lengths = batch.column(where).to_numpy(zero_copy_only=False)
            base = batch.column(len(batch.columns) - 1)
            known = ~np.asarray(base.is_null())
            rank = np.where(known, np.nan_to_num(base.to_numpy(zero_copy_only=False)), 0).astype(np.int64)
            rank += batch.column(len(batch.columns) - 2).to_numpy()
            length = np.where(known, lengths, 0).astype(np.int64)
            bins, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            if len(ranges) and known.any():
                # The last range of the length that starts at the rank or before it.
                key = ranges[:, 0].astype(np.float64)
                at = _last_at_most(key, ranges[:, 1], length.astype(np.float64), rank)
                _, first, _, per, first_bin, first_offset = ranges[at].T
                bins = first_bin + (rank - first) // per
                offset = first_offset + (rank - first) % per * length
            mask = ~known
            out = [*batch.columns[:-3], pa.array(bins, mask=mask), pa.array(offset, mask=mask)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(out, final_arrow)], schema=final_arrow)

    joined = numbered.join(bases, (length == F.col("_length")) & (F.col("_task") == F.col("_of")), "left")
    return joined.select(*pieces.columns, "_task", "_nth", "_base").mapInArrow(place, final)


def _last_at_most(lengths: np.ndarray, firsts: np.ndarray, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Index of the last (length, first) not above (length, rank), both sorted by length, then first."""
    lo, hi = np.searchsorted(lengths, length), np.searchsorted(lengths, length, side="right")
    while True:
        open_ = hi - lo > 1
        if not open_.any():
            return np.minimum(lo, len(lengths) - 1)
        middle = (lo + hi) // 2
        below = firsts[np.minimum(middle, len(firsts) - 1)] <= rank
        lo = np.where(open_ & below, middle, lo)
        hi = np.where(open_ & ~below, middle, hi)


def pack_documents(docs: DataFrame, path: str | Callable[[], str], end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise documents and pack their pieces: the rows of ``tokenize`` with ``sequence_id`` and ``offset``."""
    return pack(tokenize(docs, path, end_id, capacity), "length", capacity)


def sequences(
    docs: DataFrame, placed: DataFrame, path: str | Callable[[], str], end_id: int = 0, capacity: int = CAPACITY
) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (at most ``capacity`` of them). Needs unique document ids."""
    ids = tokenize(docs, path, end_id, capacity, with_ids=True).select("doc_id", "piece", "ids")
    parts = placed.select("doc_id", "piece", "sequence_id", "offset").join(ids, ["doc_id", "piece"])
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("ids"))
