"""Window functions over a time-ordered signal."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.timeorder import (
    SLICE,
    Slices,
    micros,
    ordered,
    plan_slices,
    range_ordered,
    running_total,
    scan_ordered,
    seconds_between,
)


def rocof(
    df: DataFrame,
    ts: str = "ts",
    value: str = "value",
    stamp: str = "midpoint",
    tie: Sequence[str] = (),
    slices: Slices | None = None,
) -> DataFrame:
    """Sample-to-sample rate of change; rows without a usable predecessor are left out."""

    def build(frame: DataFrame, w) -> DataFrame:
        return frame.withColumns({"_ts0": F.lag(ts).over(w), "_v0": F.lag(value).over(w)})

    pairs = ordered(df.select(ts, value, *tie), ts, 1, build, tie, slices=slices)
    dt = seconds_between("_ts0", ts)
    out = pairs.select(
        F.col("_ts0").alias("sample_start_ts"),
        F.col(ts).alias("sample_end_ts"),
        F.col("_v0").alias("f_start_hz"),
        F.col(value).alias("f_end_hz"),
        dt.alias("delta_t_s"),
        (F.col(value) - F.col("_v0")).alias("delta_f_hz"),
    ).where("delta_t_s > 0")
    rate = F.try_divide("delta_f_hz", "delta_t_s")
    out = out.withColumn("rocof_hz_per_s", rate).where(
        F.col("rocof_hz_per_s").isNotNull() & ~F.isnan("rocof_hz_per_s") & (F.abs("rocof_hz_per_s") < float("inf"))
    )
    return out.withColumn("rocof_timestamp", _stamp(stamp))


def _stamp(mode: str) -> Column:
    start, end = F.col("sample_start_ts").cast("timestamp"), F.col("sample_end_ts").cast("timestamp")
    if mode == "start":
        return start
    if mode == "end":
        return end
    gap = F.unix_micros(end) - F.unix_micros(start)
    return F.timestamp_micros(F.unix_micros(start) + F.floor(gap / 2).cast("long"))


def lag_features(
    df: DataFrame, ts: str, value: str, lags: Sequence[int] = (1, 5), mean_of: int = 10, tie: Sequence[str] = ()
) -> DataFrame:
    """Lagged values and the mean of the newest samples, the current one included."""

    def build(frame: DataFrame, w) -> DataFrame:
        added = {f"lag_{k}": F.lag(value, k).over(w) for k in lags}
        added[f"rolling_mean_{mean_of}"] = F.avg(value).over(w.rowsBetween(-(mean_of - 1), 0))
        return frame.withColumns(added)

    out = ordered(df, ts, max(*lags, mean_of - 1), build, tie)
    return out.na.drop(subset=[f"lag_{k}" for k in lags]).drop("_slice")


def rolling_stats(
    df: DataFrame,
    ts: str,
    value: str,
    windows: Sequence[int] = (5, 30, 120, 600),
    diffs: Sequence[int] = (1, 5, 30),
    tie: Sequence[str] = (),
) -> DataFrame:
    """Differences and rolling mean/std/min/max; null until max(2, w // 3) samples are there."""
    kinds = ("mean", "std", "min", "max")
    added = [f"diff_{k}" for k in diffs] + [f"roll{n}_{kind}" for n in windows for kind in kinds]

    def step(v: pd.Series) -> dict[str, pd.Series]:
        new = {f"diff_{k}": v.diff(k) for k in diffs}
        for n in windows:
            rolled = v.rolling(n, min_periods=max(2, n // 3))
            new.update({f"roll{n}_{kind}": getattr(rolled, kind)() for kind in kinds})
        return new

    return scan_ordered(df, ts, value, max(*diffs, *[n - 1 for n in windows]), step, added, tie)


def rolling_quantile_excess(
    df: DataFrame, ts: str, value: str, rows: int = 336, min_rows: int = 48, q: float = 0.95, tie: Sequence[str] = ()
) -> DataFrame:
    """How far the signal lies under its rolling quantile, never negative."""

    def step(v: pd.Series) -> dict[str, pd.Series]:
        return {"rolling_q": v.rolling(rows, min_periods=min_rows).quantile(q)}

    out = scan_ordered(df, ts, value, rows - 1, step, ["rolling_q"], tie)
    below = F.greatest(F.lit(0.0), F.col("rolling_q") - F.col(value))
    return out.withColumn("proxy", F.when(F.col("rolling_q").isNotNull(), below))


def rolling_std(
    df: DataFrame, ts: str, value: str, rows: int = 10, tie: Sequence[str] = (), restart: Sequence[str] = ()
) -> DataFrame:
    """Rolling standard deviation, null until the window is full."""

    def build(frame: DataFrame, w) -> DataFrame:
        frameset = w.rowsBetween(-(rows - 1), 0)
        full = F.count(value).over(frameset) >= rows
        return frame.withColumn(f"std_{rows}", F.when(full, F.stddev_samp(value).over(frameset)))

    return ordered(df, ts, rows - 1, build, tie, restart).drop("_slice")


def sample_durations(df: DataFrame, ts: str, tie: Sequence[str] = (), restart: Sequence[str] = ()) -> DataFrame:
    """Seconds since the sample before, 0 for the first."""

    def build(frame: DataFrame, w) -> DataFrame:
        return frame.withColumn("dt_s", F.coalesce(seconds_between(F.lag(ts).over(w), ts), F.lit(0.0)))

    return ordered(df, ts, 1, build, tie, restart).drop("_slice")


def with_difference(
    df: DataFrame, ts: str, value: str, tie: Sequence[str] = (), restart: Sequence[str] = ()
) -> DataFrame:
    """Plain difference to the sample before."""

    def build(frame: DataFrame, w) -> DataFrame:
        return frame.withColumn("diff", F.col(value) - F.lag(value).over(w))

    return ordered(df, ts, 1, build, tie, restart).drop("_slice")


def running_sum(df: DataFrame, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Running total of a column in a total order, ties in the timestamp included."""
    placed = range_ordered(df, order).withColumnRenamed("_local", "_at")
    return running_total(placed, ["_at"], F.col(value), name).drop(SLICE, "_at")


def label_changes(df: DataFrame, ts: str, label: str, tie: Sequence[str] = (), calm: str = "STABLE") -> DataFrame:
    """Rows whose label differs from the row before, and whether they return to the calm label."""

    def build(frame: DataFrame, w) -> DataFrame:
        return frame.withColumn("previous_label", F.lag(label).over(w))

    out = ordered(df, ts, 1, build, tie).drop("_slice")
    changed = out.where(F.col("previous_label").isNotNull() & (F.col(label) != F.col("previous_label")))
    return changed.withColumn("returned", (F.col(label) == calm).cast("int"))


def last_rows_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The newest n rows of each key; Spark cuts to n rows per key before the shuffle."""
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= n).drop("_rank")


def fill_forward(df: DataFrame, ts: str, columns: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """Fill gaps forward, then backward, then with 0, in time order.

    Inside a slice a window fills; what a slice lacks comes from the nearest slice that has a
    value, found on a table with one row per slice.
    """
    first_tie = next(iter(tie), None)
    slices = plan_slices(df, micros(ts), first_tie)
    cut = slices.assign(df, micros(ts), first_tie)
    moment = F.struct(F.col(ts), *[F.col(c) for c in tie])
    edges = cut.groupBy(SLICE).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), moment)).alias(f"_tail_{c}") for c in columns],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), moment)).alias(f"_head_{c}") for c in columns],
    )
    past = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    future = Window.orderBy(F.col(SLICE).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(
        SLICE,
        *[F.last(f"_tail_{c}", True).over(past).alias(f"_before_{c}") for c in columns],
        *[F.last(f"_head_{c}", True).over(future).alias(f"_after_{c}") for c in columns],
    )
    order = [F.col(ts), *[F.col(c) for c in tie]]
    up = Window.partitionBy(SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(SLICE).orderBy(*[c.desc() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    filled = cut.join(F.broadcast(carried), SLICE)
    forward = {f"_ff_{c}": F.coalesce(F.last(c, True).over(up), F.col(f"_before_{c}")) for c in columns}
    backward = {f"_bf_{c}": F.coalesce(F.last(c, True).over(down), F.col(f"_after_{c}")) for c in columns}
    filled = filled.withColumns(forward).withColumns(backward)
    return filled.select(
        *[c for c in df.columns if c not in columns],
        *[F.coalesce(f"_ff_{c}", f"_bf_{c}", F.lit(0)).alias(c) for c in columns],
    )
