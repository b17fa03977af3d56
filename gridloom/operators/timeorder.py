"""Work in time order without moving the whole table into one task.

A window ordered by time but without a partition key runs in a single task. Here the time axis
is cut into *slices* of roughly equal row count. The cut points come from a tree of quantile sketches,
so a burst holding a third of all rows is spread over a third of the slices. Cut points are
literals in the plan: every branch and every retry assigns a row to the same slice.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gridloom.session import settle

SLICE = "_slice"
HALO = "_halo"
ROWS_PER_SLICE = 2_000_000
MAX_SLICES = 8192
_FIRST_SKETCH = 1024
_SMALL_SLICE = 500
_FEW_SLICES = 8
_MID_BITS = 33
#: Shares of the tasks whose sketches are merged apart: a hundredth part of them and less in each.
_SHARES = 128
_WHOLE = ("tinyint", "smallint", "int", "bigint")
#: Letters of the texts at a crowd's ends that are compared to find what they begin with.
_TIE_HEAD = 1024


def micros(column: str | Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone (session zone UTC)."""
    column = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(column.cast("timestamp"))


def seconds_between(start: str | Column, end: str | Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(1_000_000.0)


@dataclass(frozen=True)
class Slices:
    """Cut points over a long key; a key equal to a cut belongs to the slice on its right.

    A key value that alone holds many rows (a crowd of equal timestamps) forms its own slice,
    which ``crowded`` cuts again along the tie-breaker: (number of the slice, tie cuts, bytes that all
    text ties of the crowd begin with).
    """

    cuts: tuple[int, ...]
    rows: int
    crowded: tuple[tuple[int, tuple[float, ...], int], ...] = ()
    counts: tuple[int, ...] = ()

    @property
    def n(self) -> int:
        return len(self.cuts) + 1 + sum(len(t) for _, t, _ in self.crowded)

    def without_ties(self) -> Slices:
        """The same cuts for rows that have no tie-breaker: a crowd stays one slice."""
        return replace(self, crowded=(), counts=())

    def assign(
        self, df: DataFrame, key: Column, tie: str | None = None, name: str = SLICE, nulls_last: bool = False
    ) -> DataFrame:
        """Add the slice number: binary searches over the cuts inside the JVM. ``nulls_last``: missing ties end a crowd."""
        if not self.cuts:
            return df.withColumn(name, F.lit(0))
        out = _locate(df, key, self.cuts, "_base")
        base, number = F.col("_base"), F.col("_base")
        for i, (at, tie_cuts, skip) in enumerate(self.crowded):
            place = tie_number(df, tie, skip)
            if nulls_last:
                place = F.coalesce(place, F.lit(float("inf")))
            out = _locate(out, F.when(base == at, place).otherwise(F.lit(float("-inf"))), tie_cuts, f"_sub{i}")
            number = number + F.when(base > at, len(tie_cuts)).otherwise(F.col(f"_sub{i}"))
        return out.withColumn(name, number).drop("_base", *[f"_sub{i}" for i in range(len(self.crowded))])

    def lending(self, back: int) -> list[tuple[int, int, int]]:
        """(from, to, rows between): slices whose newest rows another slice needs behind it."""
        lent = []
        for start in range(len(self.counts)):
            between = 0
            for to in range(start + 1, len(self.counts)):
                if between >= back:
                    break
                if self.counts[to]:
                    lent.append((start, to, between))
                between += self.counts[to]
        return lent


def tie_number(df: DataFrame, column: str, skip: int = 0) -> Column | None:
    """A number that never falls where the column rises; None for types without one.

    Of a text it is the six bytes that follow the first ``skip``: texts are ordered by their bytes, so texts with
    equal numbers have to stay together and all others are apart in the right order.
    """
    kind, c = dict(df.dtypes)[column], F.col(column)
    if kind == "string":
        six = F.substring(F.encode(c, "UTF-8"), skip + 1, 6)
        return F.conv(F.rpad(F.hex(six), 12, "0"), 16, 10).cast("double")
    if kind in ("double", "float"):
        return F.when(F.isnan(c), F.lit(float("inf"))).otherwise(c.cast("double"))
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return micros(c).cast("double")
    return c.cast("double") if kind in (*_WHOLE, "boolean") or kind.startswith("decimal") else None


def _shared_bytes(low: str, high: str) -> int:
    """Bytes that two texts, and all between them, begin with."""
    a, b = low.encode(), high.encode()
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def _tie_cuts(rows: DataFrame, tie: str, by: str, parts: int) -> dict[object, tuple[tuple[float, ...], int]]:
    """Per value of ``by`` (few): cuts along the tie into parts of equal size, and the bytes its text ties share."""
    skips = {}
    if dict(rows.dtypes)[tie] == "string":
        head = F.left(F.col(tie), F.lit(_TIE_HEAD))
        ends = rows.groupBy(by).agg(F.min(head).alias("a"), F.max(head).alias("b")).where("a is not null")
        skips = {r[by]: _shared_bytes(r["a"], r["b"]) for r in ends.collect()}
    place = tie_number(rows, tie)
    for value, skip in skips.items():
        place = F.when(F.col(by) == value, tie_number(rows, tie, skip)).otherwise(place)
    found = _tree_marks(rows.select(by, place.alias("_tie")), F.col("_tie"), parts, [by]).where("q is not null").collect()
    finite = {r[by]: sorted({float(v) for v in r["q"]} - {float("inf"), float("-inf")}) for r in found}
    return {value: (tuple(cuts), skips.get(value, 0)) for value, cuts in sorted(finite.items()) if cuts}


def _locate(df: DataFrame, key: Column, cuts: Sequence[float], name: str) -> DataFrame:
    finder = Bucketizer(
        splits=[float("-inf"), *map(float, cuts), float("inf")], inputCol="_cut_key", outputCol="_cut_slice"
    )
    keyed = finder.transform(df.withColumn("_cut_key", key.cast("double")))
    # A missing key goes to the first slice; a column without nulls spares the filters of later joins.
    return keyed.withColumn(name, F.coalesce(F.col("_cut_slice").cast("int"), F.lit(0))).drop("_cut_key", "_cut_slice")


def _tree_marks(df: DataFrame, key: Column, parts: int, by: Sequence[str] = ()) -> DataFrame:
    """Per group: rows with a key, and ``q``, the keys that cut them into ``parts`` of equal size (null without rows).

    Sketches are merged in two steps, those of a share of the tasks first, so that no task merges all of them.
    """
    kind = "bigint" if dict(df.select(key.alias("_k")).dtypes)["_k"] in _WHOLE else "double"
    size = min(65_535, max(1024, 8 * parts))
    shares = ",".join(f"{i / parts:.10f}D" for i in range(1, parts))
    rows = df.select(*by, key.cast(kind).alias("_k"), F.pmod(F.spark_partition_id(), F.lit(_SHARES)).alias("_share"))
    some = rows.groupBy(*by, "_share").agg(F.count("_k").alias("n"), F.expr(f"kll_sketch_agg_{kind}(_k, {size})").alias("s"))
    whole = some.groupBy(*by).agg(F.sum("n").alias("n"), F.expr(f"kll_merge_agg_{kind}(s, {size})").alias("s"))
    found = F.expr(f"CASE WHEN n > 0 THEN kll_sketch_get_quantile_{kind}(s, array({shares})) END")
    return whole.select(*by, F.coalesce("n", F.lit(0)).alias("n"), found.alias("q"))


def _sketch(df: DataFrame, key: Column, parts: int) -> tuple[int, list[int]]:
    row = _tree_marks(df, key, parts).first()
    return row["n"], list(row["q"] or [])


def plan_slices(
    df: DataFrame,
    key: Column,
    tie: str | None = None,
    count: bool = False,
    rows_per_slice: int | None = None,
    axis: DataFrame | None = None,
) -> Slices:
    """Choose the cuts; with ``count`` the rows of every slice are counted too.

    ``axis`` (one column ``_k``) sets the cuts from other rows than the counted ones. The driver
    receives at most ``MAX_SLICES`` numbers whatever the size of the table.
    """
    target = rows_per_slice or ROWS_PER_SLICE
    if tie is not None and tie_number(df, tie) is None:
        tie = None
    whole = df.select(key.alias("_k")) if axis is None else axis
    rows, marks = _sketch(whole, F.col("_k"), _FIRST_SKETCH)
    wanted = max(-(-rows // target), min(_FEW_SLICES, rows // _SMALL_SLICE), 1)
    wanted = min(wanted, MAX_SLICES)
    if wanted > _FIRST_SKETCH:
        _, marks = _sketch(whole, F.col("_k"), wanted)
    elif marks:
        marks = [marks[(i * _FIRST_SKETCH) // wanted - 1] for i in range(1, wanted)]
    seen = Counter(marks)
    crowds = [v for v, c in seen.items() if c >= 2] if tie else []
    cuts = tuple(sorted(set(marks) | {v + 1 for v in crowds}))
    crowded = []
    if crowds:
        parts = max(seen[v] for v in crowds) + 1
        crowd = df.where(key.isin(crowds)).select(key.alias("_crowd"), tie)
        for value, (tie_cuts, skip) in _tie_cuts(crowd, tie, "_crowd", parts).items():
            crowded.append((cuts.index(value) + 1, tie_cuts, skip))
    slices = Slices(cuts, rows, tuple(crowded))
    if not count:
        return slices
    sizes = slices.assign(df.where(key.isNotNull()), key, tie).groupBy(SLICE).count().collect()
    by_slice = {r[SLICE]: r["count"] for r in sizes}
    return replace(slices, counts=tuple(by_slice.get(i, 0) for i in range(slices.n)))


def cut_with_halo(
    df: DataFrame, ts: str, back: int, tie: Sequence[str] = (), slices: Slices | None = None
) -> DataFrame:
    """Rows with their slice, and copies of the ``back`` rows before each slice marked ``_halo``.

    How far back a slice must reach is known from the row counts, so slices with fewer than
    ``back`` rows, or none, are handled.
    """
    first_tie = tie[0] if tie else None
    if slices is None:
        slices = plan_slices(df, micros(ts), first_tie, count=back > 0)
    cut = slices.assign(df.where(F.col(ts).isNotNull()), micros(ts), first_tie)
    own = cut.withColumn(HALO, F.lit(False))
    lent = slices.lending(back)
    if not back or not lent:
        return own
    newest = Window.partitionBy(SLICE).orderBy(*[F.col(c).desc() for c in (ts, *tie)])
    tails = cut.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= back)
    if all(to == start + 1 for start, to, _ in lent):
        moved = tails.where(F.col(SLICE) < slices.n - 1).withColumn(SLICE, F.col(SLICE) + 1)
    else:
        plan = df.sparkSession.createDataFrame(lent, f"{SLICE} int, _to int, _between int")
        moved = (
            tails.join(F.broadcast(plan), SLICE)
            .where(F.col("_rank") + F.col("_between") <= back)
            .withColumn(SLICE, F.col("_to"))
            .drop("_to", "_between")
        )
    return own.unionByName(moved.drop("_rank").withColumn(HALO, F.lit(True)))


def ordered(
    df: DataFrame,
    ts: str,
    back: int,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    tie: Sequence[str] = (),
    restart: Sequence[str] = (),
    slices: Slices | None = None,
) -> DataFrame:
    """Run a time-ordered window that looks at most ``back`` rows behind.

    ``build(frame, window)`` adds its columns over ``window``. ``restart`` names columns that
    follow from the timestamp (a year, a day): windows never cross a change of theirs.

    Give ``tie`` where timestamps repeat: it makes the order, and so the result, definite, and its
    first column (a number, a time or a text) lets a crowded instant be cut.
    """
    cut = cut_with_halo(df, ts, back, tie, slices)
    window = Window.partitionBy(SLICE, *restart).orderBy(*[F.col(c) for c in (ts, *tie)])
    return build(cut, window).where(~F.col(HALO)).drop(HALO)


def scan_ordered(
    df: DataFrame,
    ts: str,
    value: str,
    back: int,
    step: Callable[[pd.Series], Mapping[str, pd.Series]],
    added: Sequence[str],
    tie: Sequence[str] = (),
) -> DataFrame:
    """Like :func:`ordered` for windows too wide for the JVM frames, which recompute every row.

    Slices are sorted by Spark and pass as Arrow batches; only the value column becomes numbers
    in Python, the others stay as they are. Between batches the last ``back`` values are kept.
    ``step`` gets consecutive values of one slice and returns the added columns, as long.
    """
    placed = cut_with_halo(df, ts, back, tie).repartition(SLICE).sortWithinPartitions(SLICE, ts, *tie)
    kept = list(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, lead = None, np.empty(0)
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = batch.column(SLICE).to_numpy(zero_copy_only=False)
            values = batch.column(value).to_numpy(zero_copy_only=False).astype(float)
            new = {c: np.empty(len(values)) for c in added}
            edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1), len(numbers)]
            for start, end in zip(edges, edges[1:]):
                if numbers[start] != current:
                    current, lead = numbers[start], values[:0]
                whole = np.concatenate([lead, values[start:end]])
                done = step(pd.Series(whole))
                for c in added:
                    new[c][start:end] = done[c].to_numpy(dtype=float)[len(lead) :]
                lead = whole[max(0, len(whole) - back) :]
            columns = [batch.column(c) for c in kept] + [pa.array(new[c], from_pandas=True) for c in added]
            own = pa.array(~batch.column(HALO).to_numpy(zero_copy_only=False).astype(bool))
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *added]).filter(own)

    schema = StructType([*df.schema.fields, *[StructField(c, DoubleType()) for c in added]])
    return placed.mapInArrow(run, schema)


def running_total(
    df: DataFrame, order: Sequence[str], add: Column, name: str, inclusive: bool = True
) -> DataFrame:
    """Running sum of ``add`` over a frame that carries ``_slice`` (see :func:`ordered`).

    Sums inside each slice plus the total of all earlier slices; the table of totals has one row
    per slice and is broadcast.
    """
    totals = df.groupBy(SLICE).agg(F.sum(add).alias("_sum"))
    before = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(SLICE, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(SLICE).orderBy(*order)
    local = F.sum(add).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    if not inclusive:
        local = local - add
    return (
        df.withColumn("_local", local)
        .join(F.broadcast(offsets), SLICE)
        .withColumn(name, F.col("_local") + F.col("_before"))
        .drop("_local", "_before")
    )


def range_ordered(df: DataFrame, order: Sequence[str], nulls_last: bool = True) -> DataFrame:
    """Rows in range partitions of the given order, with ``_slice`` and the position inside it.

    Range partitioning on all the order columns copes with equal timestamps; the position inside
    a sorted partition is free (``monotonically_increasing_id``). The rows are written once, so
    partition numbers cannot change between two uses of the result.
    """
    keys = _in_order(order, nulls_last)
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    fixed = settle(placed.withColumn("_mid", F.monotonically_increasing_id()))
    return (
        fixed.withColumn(SLICE, F.shiftright("_mid", _MID_BITS))
        .withColumn("_local", F.col("_mid").bitwiseAND(F.lit((1 << _MID_BITS) - 1)))
        .drop("_mid")
    )


def cut_by_order(
    df: DataFrame, order: Sequence[str], nulls_last: bool = True, keys: Sequence[str] = ()
) -> tuple[DataFrame, dict[int, int]] | None:
    """Rows with ``_slice``, which never falls along the order, and the rows of each slice.

    Nothing is written: cut points are literals. None where the first order column is neither a time nor a whole
    number. Rows without it have slices of their own behind (or before) all others. With ``keys`` rows aren't counted.
    """
    kind = dict(df.dtypes)[order[0]]
    if kind not in (*_WHOLE, "date", "timestamp", "timestamp_ntz"):
        return None
    first = F.col(order[0])
    key = first.cast("bigint") if kind in _WHOLE else micros(order[0])
    tie = next(iter(order[1:]), None)
    if tie is not None and tie_number(df, tie) is None:
        tie = None
    slices = plan_slices(df, key, tie)
    cut = slices.assign(df, key, tie, nulls_last=nulls_last)
    missing = df.where(first.isNull())
    parts = min(-(-missing.count() // ROWS_PER_SLICE), MAX_SLICES)
    if parts:
        place, last = F.lit(0), 0
        if tie and parts > 1:
            rows = missing.select(F.lit(0).alias("_all"), tie)
            tie_cuts, skip = _tie_cuts(rows, tie, "_all", parts).get(0, ((), 0))
            if tie_cuts:
                end = F.lit(float("inf") if nulls_last else float("-inf"))
                cut = _locate(cut, F.coalesce(tie_number(df, tie, skip), end), tie_cuts, "_sub")
                place, last = F.col("_sub"), len(tie_cuts)
        number = F.when(first.isNull(), place + (slices.n if nulls_last else -last - 1)).otherwise(F.col(SLICE))
        cut = cut.withColumn(SLICE, number).drop("_sub")
    if keys:
        return cut, {}
    return cut, {r[SLICE]: r["count"] for r in cut.groupBy(SLICE).count().collect()}


def _in_order(order: Sequence[str], nulls_last: bool = True) -> list[Column]:
    return [F.col(c).asc_nulls_last() if nulls_last else F.col(c).asc_nulls_first() for c in order]


def select_positions(
    df: DataFrame,
    order: Sequence[str],
    wanted: Callable[[int], tuple[Callable[[int, int], bool], Column]],
    name: str = "row_no",
    nulls_last: bool = True,
) -> DataFrame:
    """Rows whose zero-based position in order is wanted, with the position.

    ``wanted`` gets the number of rows and returns a test of an interval of positions (may it hold a wanted one?) and
    the test of a single position. Ranks become slices by their counts; only slices that may hold a wanted row are
    shuffled and sorted. The order should be definite: rows equal in all its columns may swap places.
    """
    found = cut_by_order(df, order, nulls_last)
    if found is None:
        indexed = _indexed_by_range(df, order, name, nulls_last)
        return indexed.where(wanted(indexed.count())[1])
    cut, counts = found
    may, exact = wanted(sum(counts.values()))
    starts, at = {}, 0
    for i in sorted(counts):
        if may(at, at + counts[i]):
            starts[i] = at
        at += counts[i]
    if not starts:
        return cut.where(F.lit(False)).withColumn(name, F.lit(0).cast("bigint")).drop(SLICE)
    if len(starts) < len(counts):
        cut = cut.where(F.col(SLICE).isin(list(starts)))
    before = df.sparkSession.createDataFrame(list(starts.items()), f"{SLICE} int, _before bigint")
    inside = Window.partitionBy(SLICE).orderBy(*_in_order(order, nulls_last))
    local = cut.withColumn("_local", F.row_number().over(inside) - 1)
    return (
        local.join(F.broadcast(before), SLICE)
        .withColumn(name, F.col("_local") + F.col("_before"))
        .drop(SLICE, "_local", "_before")
        .where(exact)
    )


def row_index(df: DataFrame, order: Sequence[str], name: str = "row_no") -> DataFrame:
    """Zero-based global position in the given order, missing values last."""
    return select_positions(df, order, lambda n: (lambda start, end: True, F.lit(True)), name)


def _indexed_by_range(df: DataFrame, order: Sequence[str], name: str, nulls_last: bool = True) -> DataFrame:
    """Positions from range partitions, for an order that starts with a column of any type; offsets are one row each."""
    placed = range_ordered(df, order, nulls_last)
    sizes = placed.groupBy(SLICE).count()
    before = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(SLICE, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    return (
        placed.join(F.broadcast(offsets), SLICE)
        .withColumn(name, F.col("_local") + F.col("_before"))
        .drop(SLICE, "_local", "_before")
    )


def position_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "row_no") -> DataFrame:
    """Zero-based position inside each group, for groups of any size.

    Groups are cut along the order: a group holding a third of the table is spread over the slices that it covers.
    Rows that a group has in earlier slices come in as one carry row per group and slice, ahead of the rows.
    """
    if not keys:
        return row_index(df, order, name)
    found = cut_by_order(df, order, keys=keys)
    if found is None:
        return _positions_by_range(df, keys, order, name)
    cut, _ = found
    sizes = cut.groupBy(*keys, SLICE).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = sizes.select(*keys, SLICE, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    both = cut.withColumn("_carry", F.lit(0)).unionByName(carry.withColumn("_carry", F.lit(1)), allowMissingColumns=True)
    inside = Window.partitionBy(*keys, SLICE).orderBy(F.col("_carry").desc(), *_in_order(order))
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    return (
        both.withColumn(name, F.row_number().over(inside) - 2 + F.first("_before").over(so_far))
        .where("_carry = 0")
        .drop(SLICE, "_carry", "_before")
    )


def _positions_by_range(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """One index over (keys, order), less the index of the first row of the group."""
    indexed = _indexed_by_range(df, [*keys, *order], name)
    starts = indexed.groupBy(*[F.col(k).alias(f"_start_{k}") for k in keys]).agg(F.min(name).alias("_first"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_start_{k}"))
    return (
        indexed.join(starts, same)
        .withColumn(name, F.col(name) - F.col("_first"))
        .drop("_first", *[f"_start_{k}" for k in keys])
    )
