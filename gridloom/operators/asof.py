"""As-of joins: each left row meets the nearest row of one or more other tables in time.

All tables go into one union that is shuffled once by (by-columns, slice) and sorted by time.
The newest row before and the oldest row after a slice are brought in as carry rows, so a match
may lie any number of slices away and no tolerance is needed for the plan to be exact.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    ByteType,
    DateType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    ShortType,
    StructType,
    TimestampNTZType,
    TimestampType,
)

from gridloom.operators.timeorder import SLICE, Slices, micros, plan_slices

_T = "_t"
_SIDE = "_side"
_EDGE = "_edge"


@dataclass(frozen=True)
class Source:
    """A table to look up.

    ``seq`` orders rows with an equal timestamp: looking back takes the last of them, looking
    forward the first. ``tolerance`` is in seconds and inclusive; None means any distance.
    ``unique`` promises one row per (by, timestamp) and saves the shuffle that ensures it.
    """

    df: DataFrame
    ts: str
    columns: Sequence[str]
    prefix: str = ""
    direction: str = "nearest"
    tolerance: float | None = None
    tie: str = "earlier"
    seq: str | None = None
    unique: bool = False

    def __post_init__(self) -> None:
        if self.direction not in ("nearest", "backward", "forward"):
            raise ValueError(f"direction {self.direction!r}")
        if self.tie not in ("earlier", "later"):
            raise ValueError(f"tie {self.tie!r}")


def time_axis(tables: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """All instants of several tables in one column, to cut their common time axis."""
    return reduce(lambda a, b: a.unionByName(b), [df.select(micros(ts).alias("_k")) for df, ts in tables])


#: Types whose aggregation buffers are updated in place, so that Spark aggregates by hash and sorts nothing.
_FIXED = (ByteType, ShortType, IntegerType, LongType, FloatType, DoubleType, BooleanType, DateType, TimestampType, TimestampNTZType)


def _row_at(pick: Callable[[Column, Column], Column], row: Column, kind: StructType, rank: Column, fixed: bool = True) -> Column:
    """The struct ``row`` at the largest (``F.max_by``) or least rank; null where no rank is known.

    Structs of fixed-size fields are looked up field by field: all fields follow one rank, so they come from one row.
    """
    if not fixed or not all(isinstance(f.dataType, _FIXED) for f in kind.fields):
        return pick(row, rank)
    return F.when(F.count(rank) > 0, F.struct(*[pick(row[f.name], rank).alias(f.name) for f in kind.fields]))


def _compact(source: Source, by: Sequence[str]) -> DataFrame:
    """One row per (by, instant) with the first and the last of the rows sharing it."""
    payload = F.struct(F.col(source.ts).alias("at"), *[F.col(c) for c in source.columns])
    rank = F.col(source.seq) if source.seq else F.struct(*[F.col(c) for c in source.columns])
    frame = source.df.where(F.col(source.ts).isNotNull())
    if source.unique:
        return frame.select(*by, micros(source.ts).alias(_T), payload.alias("last"), payload.alias("first"))
    kind = frame.select(payload.alias("_p"), rank.alias("_r")).schema
    fixed = isinstance(kind["_r"].dataType, _FIXED)
    return frame.groupBy(*by, micros(source.ts).alias(_T)).agg(
        _row_at(F.max_by, payload, kind["_p"].dataType, rank, fixed).alias("last"),
        _row_at(F.min_by, payload, kind["_p"].dataType, rank, fixed).alias("first"),
    )


def _carry(keys: DataFrame, rights: DataFrame, by: Sequence[str], n: int, slices: int) -> DataFrame:
    """For each (by, slice) holding left rows: the rows of every source just before and after it."""

    def edge(pick: Callable[[Column, Column], Column], name: str) -> Column:
        row = F.col(name)
        return _row_at(pick, row, rights.schema[name].dataType, F.when(row.isNotNull(), F.col(_T))).alias(name)

    edges = rights.groupBy(*by, SLICE).agg(
        *[edge(F.max_by, f"_last{i}") for i in range(n)], *[edge(F.min_by, f"_first{i}") for i in range(n)]
    )
    # Without by-columns every slice gets its carry row; no need to look which ones hold left rows.
    pairs = keys.select(*by, SLICE).distinct() if by else keys.sparkSession.range(slices).select(F.col("id").cast("int").alias(SLICE))
    wanted = pairs.withColumn("_want", F.lit(True))
    both = edges.withColumn("_want", F.lit(False)).unionByName(wanted, allowMissingColumns=True)
    # At most two rows per slice and by-value, so these windows stay small.
    past = Window.partitionBy(*by).orderBy(SLICE).rangeBetween(Window.unboundedPreceding, -1)
    future = Window.partitionBy(*by).orderBy(F.col(SLICE).desc()).rangeBetween(Window.unboundedPreceding, -1)
    return both.select(
        *by,
        SLICE,
        "_want",
        *[F.last(f"_last{i}", True).over(past).alias(f"_last{i}") for i in range(n)],
        *[F.last(f"_first{i}", True).over(future).alias(f"_first{i}") for i in range(n)],
    ).where("_want").drop("_want")


def _pick(source: Source, i: int) -> Column:
    back, ahead = F.col(f"_back{i}"), F.col(f"_ahead{i}")
    here = F.col(_T)
    limit = None if source.tolerance is None else round(source.tolerance * 1_000_000)
    back_gap = here - micros(back["at"])
    ahead_gap = micros(ahead["at"]) - here
    if limit is not None:
        back_ok, ahead_ok = back_gap <= limit, ahead_gap <= limit
    else:
        back_ok, ahead_ok = back.isNotNull(), ahead.isNotNull()
    if source.direction == "backward":
        return F.when(back_ok, back)
    if source.direction == "forward":
        return F.when(ahead_ok, ahead)
    prefer_back = back_gap <= ahead_gap if source.tie == "earlier" else back_gap < ahead_gap
    nearest = F.when(ahead.isNull() | prefer_back, back).otherwise(ahead)
    near_ok = F.when(ahead.isNull() | prefer_back, back_ok).otherwise(ahead_ok)
    return F.when(near_ok, nearest)


def fuse(
    left: DataFrame,
    ts: str,
    sources: Sequence[Source],
    by: Sequence[str] = (),
    unique_left: bool = False,
    slices: Slices | None = None,
) -> DataFrame:
    """Left rows with the match of every source: prefixed columns, ``<prefix>ts``, ``<prefix>offset_s``.

    Left rows sharing (by, ts) are looked up once and the match is joined back, so a crowd of
    equal timestamps is left to the adaptive skew join. ``unique_left`` promises that (by, ts)
    is unique and not null, and then no join is needed.
    """
    if unique_left:
        # One column each, so that Spark can leave out those nobody asks for.
        own = [F.col(c).alias(f"_left{i}") for i, c in enumerate(left.columns)]
        keys = left.select(*by, micros(ts).alias(_T), *own)
    else:
        keys = left.select(*by, micros(ts).alias(_T)).where(F.col(_T).isNotNull()).distinct()
    rights = [_compact(s, by) for s in sources]
    if slices is None:
        slices = plan_slices(left, micros(ts), axis=time_axis([(left, ts), *[(s.df, s.ts) for s in sources]]))
    slices = slices.without_ties()
    keys = slices.assign(keys, F.col(_T))
    renamed = [
        r.withColumnsRenamed({"last": f"_last{i}", "first": f"_first{i}"}) for i, r in enumerate(rights)
    ]
    context = slices.assign(
        reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), renamed), F.col(_T)
    )
    union = keys.withColumns({_SIDE: F.lit(1), _EDGE: F.lit(0)}).unionByName(
        context.withColumns({_SIDE: F.lit(0), _EDGE: F.lit(0)}), allowMissingColumns=True
    )
    if slices.n > 1:
        edge = _carry(keys, context, by, len(sources), slices.n).withColumns({_SIDE: F.lit(0), _EDGE: F.lit(1)})
        union = union.unionByName(edge, allowMissingColumns=True)

    # Looking ahead is looking back on the reversed axis: both frames grow row by row. The carry
    # row comes first on either axis.
    group = Window.partitionBy(*by, SLICE)
    edge_first = F.col(_EDGE).desc()
    back = group.orderBy(edge_first, _T, _SIDE).rowsBetween(Window.unboundedPreceding, 0)
    ahead = group.orderBy(edge_first, F.col(_T).desc(), _SIDE).rowsBetween(Window.unboundedPreceding, 0)
    looked = union
    for i, source in enumerate(sources):
        if source.direction != "forward":
            looked = looked.withColumn(f"_back{i}", F.last(f"_last{i}", True).over(back))
    for i, source in enumerate(sources):
        if source.direction != "backward":
            looked = looked.withColumn(f"_ahead{i}", F.last(f"_first{i}", True).over(ahead))
    looked = looked.where(F.col(_SIDE) == 1)
    for i, source in enumerate(sources):
        looked = looked.withColumn(f"_match{i}", _pick(source, i))

    picked: list[Column] = []
    for i, source in enumerate(sources):
        match = F.col(f"_match{i}")
        picked += [match[c].alias(f"{source.prefix}{c}") for c in source.columns]
        picked.append(match["at"].alias(f"{source.prefix}ts"))
        picked.append((F.abs(F.col(_T) - micros(match["at"])) / 1_000_000.0).alias(f"{source.prefix}offset_s"))
    if unique_left:
        return looked.select(*[F.col(f"_left{i}").alias(c) for i, c in enumerate(left.columns)], *picked)
    matches = looked.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col(_T).alias("_mt"), *picked)
    condition = F.col("_lt") == F.col("_mt")
    for c in by:
        condition = condition & (F.col(c) == F.col(f"_by_{c}"))
    return (
        left.withColumn("_lt", micros(ts))
        .join(matches, condition, "left")
        .drop("_lt", "_mt", *[f"_by_{c}" for c in by])
    )


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_ts: str,
    right_ts: str,
    columns: Sequence[str],
    by: Sequence[str] = (),
    prefix: str = "matched_",
    direction: str = "nearest",
    tolerance: float | None = None,
    tie: str = "earlier",
    seq: str | None = None,
    unique_left: bool = False,
) -> DataFrame:
    """As-of join of two tables; see :class:`Source` for the matching rules."""
    source = Source(right, right_ts, columns, prefix, direction, tolerance, tie, seq)
    return fuse(left, left_ts, [source], by, unique_left)


#: Reach of the looks around an instant, each wider than the one before.
_REACHES = ("1 hour", "1 day", "30 days", "1000 days")


def nearest_row(df: DataFrame, ts: str, instant: str) -> DataFrame:
    """The row nearest to one instant; of two equally near rows the later one.

    Looks at a narrow interval first, whose bounds reach the scan, and widens it until it holds a row: what lies outside is
    farther away than anything inside. Rows without a time are never nearest, unless there are no others.
    """
    kind = dict(df.dtypes)[ts]
    at = F.lit(instant).cast("timestamp")
    part = df
    for reach in _REACHES:
        low, high = ((at + F.expr(f"{sign} INTERVAL {reach}")).cast(kind) for sign in ("-", "+"))
        near = df.where((F.col(ts) >= low) & (F.col(ts) <= high))
        if not near.isEmpty():
            part = near
            break
    return part.orderBy(F.abs(micros(ts) - F.unix_micros(at)).asc_nulls_last(), F.col(ts).desc()).limit(1)


def context_rows(df: DataFrame, ts: str, instant: str, rows: int) -> DataFrame:
    """``rows`` rows centred on the row nearest to an instant, shifted inward at the ends.

    Two top-k reads either side of the instant are enough; nothing else leaves the executors.
    """
    at = F.unix_micros(F.lit(instant).cast("timestamp"))
    key = micros(ts)
    before = df.where(key <= at).orderBy(F.col(ts).desc()).limit(2 * rows)
    after = df.where(key > at).orderBy(F.col(ts)).limit(2 * rows)
    around = before.unionByName(after)
    whole = Window.orderBy(ts)
    numbered = around.withColumn("_pos", F.row_number().over(whole) - 1).withColumn(
        "_gap", F.struct(F.abs(key - at).alias("gap"), (-key).alias("late"))
    )
    every = Window.partitionBy(F.lit(1))
    centre = F.min_by("_pos", "_gap").over(every)
    count = F.count(F.lit(1)).over(every)
    start = F.greatest(F.lit(0), F.least(centre - rows // 2, count - rows))
    return (
        numbered.withColumn("_start", start)
        .where((F.col("_pos") >= F.col("_start")) & (F.col("_pos") < F.col("_start") + rows))
        .withColumn("rank", (F.col("_pos") - F.col("_start")).cast("int"))
        .drop("_pos", "_gap", "_start")
    )
