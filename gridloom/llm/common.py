"""Helpers shared by the operators: settings, Arrow loops over documents, vectorised word hashing."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of text that one vectorised step works on; longer documents are a step of their own.
STEP_BYTES = 1 << 20
#: Bytes of one Arrow batch sent to a Python worker.
BATCH_BYTES = 4 << 20

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Odd base of the polynomial hashes and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def ready(spark: SparkSession) -> SparkSession:
    """Bound the size of Arrow batches, so that very long texts don't pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    return spark


def worker_state() -> dict:
    """A dictionary that lives as long as the Python worker, across tasks."""
    return sys.modules.setdefault("_gridloom_worker", types.ModuleType("_gridloom_worker")).__dict__


def tidy(kept: set) -> None:
    """At a task's end: forget what no operator of this task has used, and give free memory back to the system.

    Idle workers stay alive beside those of the next stage.
    """
    state = worker_state()
    for key in [k for k in state if isinstance(k, tuple) and k not in kept]:
        del state[key]
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return  # another C library


def steps(lengths: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows whose lengths sum to at most ``limit``, one row at least."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def map_documents(
    df: DataFrame, columns: list[str], text: str, schema: StructType,
    start: Callable[[], Callable[[dict[str, list]], dict]], limit: int = STEP_BYTES,
) -> DataFrame:
    """Run a function over rows in steps of bounded text size.

    ``start`` is called once per task and returns a function from columns (lists) to output columns.
    """
    ready(df.sparkSession)
    arrow = to_arrow_schema(schema)

    def run(batches):
        state = worker_state()
        state["used"] = set()
        work = start()
        tidy(state["used"])
        for batch in batches:
            rows = {name: batch.column(i).to_pylist() for i, name in enumerate(columns)}
            sizes = [len(t) if t else 0 for t in rows[text]]
            for lo, hi in steps(sizes, limit):
                out = work({name: values[lo:hi] for name, values in rows.items()})
                yield pa.RecordBatch.from_arrays([_array(out[f.name], f.type) for f in arrow], schema=arrow)
        del work
        tidy(state["used"])

    # Columns go in by number: names may hold dots.
    return df.select(*[F.col(quoted(c)).alias(f"i{k}") for k, c in enumerate(columns)]).mapInArrow(run, schema)


def quoted(name: str) -> str:
    """A column's name as a reference, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values
    return pa.array(values, type=kind)


def numbered(df: DataFrame, *columns: str) -> tuple[DataFrame, list[str]]:
    """The table with its columns called c0, c1, …, which no name of ours can clash with, and the new names of some."""
    names = df.columns
    return df.toDF(*[f"c{i}" for i in range(len(names))]), [f"c{names.index(c)}" for c in columns]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept in the worker and grown by doubling."""
    state = worker_state()
    have = state.get(("powers", base))
    if have is None or len(have) < n:
        size = 1 << max(10, (n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        state[("powers", base)] = have
    return have[:n]


class Rolling:
    """Hashes of any byte ranges of one buffer from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        # Bytes are spread first: a sum of raw small digits has weak low bits.
        spread = mix(np.arange(1, 257, dtype=np.uint64))
        np.cumsum(spread[data] * _powers(BASE, n), out=self.prefix[1:])
        self.inverse = _powers(BASE_INVERSE, n + 1)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of data[start:end] for each pair; equal bytes give equal hashes wherever they stand."""
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def windows(self, width: int) -> np.ndarray:
        """Hash of every range of one width."""
        n = len(self.prefix) - width
        return mix((self.prefix[width:] - self.prefix[:n]) * self.inverse[:n] + np.uint64(width))


_SEPARATORS = bytes([9, 10, 11, 12, 13, 32])
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(_SEPARATORS)] = False
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of several texts at once.

    ``data`` holds the UTF-8 bytes of all texts, one separator after each; ``start`` and ``end`` bound the words in
    it, ``doc`` numbers the text of each word, ``first`` is each text's first word (one more entry than texts).
    """

    def __init__(self, texts: list[str | None], lower: bool = False):
        raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        joined = b" ".join(raw) + b" "
        if lower:
            joined = joined.translate(_LOWER)
        self.bytes = joined
        self.data = np.frombuffer(joined, dtype=np.uint8)
        self.sizes = np.array([len(r) for r in raw], dtype=np.int64)
        self.offsets = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum(self.sizes + 1, out=self.offsets[1:])
        inside = _IS_WORD[self.data]
        edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
        self.start, self.end = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(raw)), self.counts)

    def hashes(self) -> np.ndarray:
        """Quick hashes of the words, for statistics: words may be built to have equal ones."""
        return Rolling(self.data).ranges(self.start, self.end)

    def keys(self, lane: int = 0) -> np.ndarray:
        """Hashes that stand for the words."""
        return range_hashes(self.data, self.start, self.end, lane)


#: Odd multipliers of two independent hashes, and what they start with.
_LANES = ((0x9E3779B97F4A7C15, 0x243F6A8885A308D3), (0xC2B2AE3D27D4EB4F, 0x13198A2E03707344))
#: Ranges beyond this many bytes are hashed one by one.
LONG_RANGE = 512


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hash of data[start:end] for each pair: blocks of 8 bytes, each mixed before the next, so no pattern of bytes cancels out.

    The two lanes are independent; together they are 128 bits.
    """
    odd, seed = (np.uint64(x) for x in _LANES[lane])
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    blocks = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    size = end - start
    masks = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
    out = mix((blocks[start] & masks[np.minimum(size, 8)]) * odd + seed)
    long = size > LONG_RANGE
    rows, at = np.flatnonzero((size > 8) & ~long), 8
    while len(rows):
        value = blocks[start[rows] + at] & masks[np.minimum(size[rows] - at, 8)]
        out[rows] = mix((out[rows] + seed) * odd + value)
        at += 8
        rows = rows[size[rows] > at]
    for i in np.flatnonzero(long).tolist():
        digest = hashlib.blake2b(data[start[i] : end[i]], digest_size=16).digest()
        out[i] = int.from_bytes(digest[8 * lane : 8 * lane + 8], "little")
    return mix(out + size.astype(np.uint64) * odd)


def _joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hashes of its two halves."""
    return mix(mix(first * np.uint64(_LANES[0][0]) + np.uint64(_LANES[1][1])) + second)


def runs_of_words(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive words (across texts; the caller leaves out those): runs of 1, 2, 4 … are joined."""
    if len(hashes) < width:
        return np.zeros(0, dtype=np.uint64)
    done, size, power, level = None, 0, hashes, 1
    while True:
        if width & level:
            n = len(power) - size
            done, size = (power if done is None else _joined(done[:n], power[size:])), size + level
        if 2 * level > width:
            return mix(done + np.uint64(width))
        power, level = _joined(power[:-level], power[level:]), 2 * level


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_array(counts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Arrow lists of the given lengths over flat values."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values, by doubling."""
    if len(values) < width:
        return values[:0]
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """For every ``width`` consecutive hashes the place of the least, the leftmost of equals.

    The choice depends on the hashes inside alone, so equal stretches choose equal places.
    """
    bits = np.uint64(max(1, len(hashes).bit_length()))
    mask = (np.uint64(1) << bits) - np.uint64(1)
    coded = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
    return (sliding_min(coded, width) & mask).astype(np.int64)


def text_key(text_col):
    """Two 64-bit hashes that stand for a whole text."""
    return [F.xxhash64(text_col).alias("x1"), F.xxhash64(F.lit("second"), text_col).alias("x2")]
