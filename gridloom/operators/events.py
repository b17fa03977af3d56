"""Event detection: runs of consecutive samples, hysteresis, clusters split by a gap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import physics
from gridloom.operators.timeorder import HALO, SLICE, micros, ordered, plan_slices, running_total, seconds_between
from gridloom.session import settle


def find_runs(
    df: DataFrame,
    ts: str,
    value: str,
    label: Column,
    tie: Sequence[str] = (),
    restart: Sequence[str] = (),
) -> DataFrame:
    """Runs of consecutive rows with one label: ``run``, ``label``, points, start, end, low, high.

    A change of a ``restart`` column ends a run too. Each slice aggregates its own pieces, behind
    the one shuffle that brings a slice together. The pieces are written; a piece that continues
    the slice before gets that run's number from the piece counts of the earlier slices, and the
    pieces of a run are merged.
    """

    def build(frame: DataFrame, w) -> DataFrame:
        state = F.struct("label", *restart)
        changed = F.lag(state).over(w)
        frame = frame.withColumn("label", label).withColumn("_was", changed)
        fresh = F.when(F.col(HALO) | F.col("_was").eqNullSafe(state), 0).otherwise(1)
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        return frame.withColumn("_new", fresh).withColumn("_piece", F.sum("_new").over(upto))

    numbered = ordered(df.select(ts, value, *tie, *restart), ts, 1, build, tie)
    v = F.col(value)
    pieces = settle(
        numbered.groupBy(SLICE, "_piece", "label", *restart).agg(
            F.count(F.lit(1)).alias("points"),
            F.min(ts).alias("start"),
            F.max(ts).alias("end"),
            F.min(v).alias("low"),
            F.max(v).alias("high"),
        )
    )
    counts = pieces.groupBy(SLICE).agg(F.max("_piece").alias("_n"))
    before = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(SLICE, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = pieces.join(F.broadcast(offsets), SLICE).withColumn("run", F.col("_piece") + F.col("_before"))
    return placed.groupBy("run", "label", *restart).agg(
        F.sum("points").alias("points"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.min(SLICE).alias(SLICE),
    )


def breach_windows(
    df: DataFrame,
    ts: str = "ts",
    value: str = "value",
    low: float | None = 49.5,
    high: float | None = 50.5,
    min_duration_s: float = 0.0,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Contiguous stretches under ``low`` or over ``high``; a direct flip starts a new window."""
    v = F.col(value)
    side = F.lit(None).cast("string")
    if high is not None:
        side = F.when(v > high, "over").otherwise(side)
    if low is not None:
        side = F.when(v < low, "under").otherwise(side)
    runs = find_runs(df, ts, value, side, tie).where("label is not null")
    worst = F.when(F.col("label") == "under", F.col("low")).otherwise(F.col("high"))
    return runs.select(
        F.col("label").alias("breach_type"),
        "start",
        "end",
        "points",
        F.col("low").alias("min_hz"),
        F.col("high").alias("max_hz"),
        seconds_between("start", "end").alias("duration_s"),
        worst.alias("worst_hz"),
    ).where(F.col("duration_s") >= min_duration_s)


def low_value_events(
    df: DataFrame,
    ts: str = "ts",
    value: str = "value",
    threshold: float = 49.0,
    min_duration_s: float = 0.0,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Contiguous stretches strictly below the threshold."""
    return breach_windows(df, ts, value, threshold, None, min_duration_s, tie).drop("breach_type")


def excursions(
    df: DataFrame,
    ts: str = "ts",
    value: str = "value",
    low: float = 49.95,
    high: float = 50.05,
    mode: str = "under",
    start_rows: int = 1,
    end_rows: int = 3,
    min_duration_s: int = 2,
    period: Column | None = None,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Excursions with hysteresis, per period (a year unless given).

    An excursion opens at the first row of a run of at least ``start_rows`` rows beyond the limit
    and closes at the first row of the next run of at least ``end_rows`` rows back inside, or at
    the last row of the period. Runs come first; long inside runs then cut the runs into groups,
    and each group holds at most one excursion.
    """
    v = F.col(value)
    beyond = v < low if mode == "under" else v > high
    period = F.year(ts) if period is None else period
    signal = df.select(ts, value, *tie).na.drop(subset=[ts, value]).withColumn("period", period)
    # A run keeps the slice of its first piece, so the second pass needs no new cut points.
    runs = find_runs(signal, ts, value, beyond, tie, ["period"])
    runs = runs.withColumnsRenamed({"label": "beyond", "points": "n"})
    divider = ~F.col("beyond") & (F.col("n") >= end_rows)
    runs = runs.withColumn("_cut", F.when(divider, 1).otherwise(0))
    groups = running_total(runs, ["run"], F.col("_cut"), "grp")
    # A divider also closes the group before it.
    roles = F.when(
        F.col("_cut") == 1, F.array(F.struct(F.col("grp"), F.lit(False).alias("closes")),
                                    F.struct((F.col("grp") - 1).alias("grp"), F.lit(True).alias("closes")))
    ).otherwise(F.array(F.struct(F.col("grp"), F.lit(False).alias("closes"))))
    placed = groups.select("period", "beyond", "n", "start", "end", F.explode(roles).alias("role"))
    opens = F.col("beyond") & (F.col("n") >= start_rows) & ~F.col("role.closes")
    found = placed.groupBy("period", "role.grp").agg(
        F.min(F.when(opens, F.col("start"))).alias("start"),
        F.min(F.when(F.col("role.closes"), F.col("start"))).alias("closed_at"),
        F.max(F.when(~F.col("role.closes"), F.col("end"))).alias("last_row"),
    )
    end = F.coalesce("closed_at", "last_row")
    duration = F.floor(seconds_between("start", "end")).cast("long")
    return (
        found.where("start is not null")
        .select("period", "start", end.alias("end"), F.col("closed_at").isNull().alias("open_tail"))
        .withColumn("duration_s", duration)
        .where(F.col("duration_s") >= min_duration_s)
    )


def average_recovery(events: DataFrame, periods: DataFrame) -> DataFrame:
    """Events, total and average duration per period; 0 for periods without events."""
    per = events.groupBy("period").agg(F.count(F.lit(1)).alias("events"), F.sum("duration_s").alias("total_s"))
    joined = periods.join(per, "period", "left")
    n, total = F.coalesce("events", F.lit(0)), F.coalesce("total_s", F.lit(0))
    return joined.select(
        "period", n.alias("events"), total.alias("total_s"), F.when(n > 0, total / n).otherwise(0.0).alias("avg_s")
    )


def rate_clusters(
    df: DataFrame,
    ts: str = "ts",
    value: str = "value",
    delta: float = 0.125,
    gap_s: float = 10.0,
    min_duration_s: float = 0.0,
    inertia_gvas: float = 200.0,
    f0: float = 50.0,
    tie: Sequence[str] = (),
    restart: Sequence[str] = (),
) -> DataFrame:
    """Clusters of samples whose jump exceeds ``delta``; a pause longer than ``gap_s`` splits.

    The jump is found per slice with one lent row. The exceedances alone are written; the time of
    the one before, across slices, comes from a table with one row per slice.
    """
    slices = plan_slices(df, micros(ts), next(iter(tie), None), count=True)

    def jump(frame: DataFrame, w) -> DataFrame:
        return frame.withColumn("jump", F.col(value) - F.lag(value).over(w))

    hits = ordered(df.select(ts, value, *tie, *restart), ts, 1, jump, tie, restart, slices)
    hits = settle(hits.where(F.abs("jump") > delta).select(ts, *tie, *restart, "jump", SLICE))
    latest = hits.groupBy(SLICE, *restart).agg(F.max(ts).alias("_tail"))
    past = Window.partitionBy(*restart).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = latest.select(SLICE, *restart, F.max("_tail").over(past).alias("_carry"))
    inside = Window.partitionBy(SLICE, *restart).orderBy(ts, *tie)
    previous = F.coalesce(F.lag(ts).over(inside), F.col("_carry"))
    # One row per slice; with restart values there are more, and their size is for Spark to judge.
    marked = hits.join(carried if restart else F.broadcast(carried), [SLICE, *restart]).withColumn("_prev", previous)
    starts = F.when(F.col("_prev").isNull() | (seconds_between("_prev", ts) > gap_s), 1).otherwise(0)
    numbered = running_total(marked.withColumn("_new", starts), [ts, *tie], F.col("_new"), "cluster")
    found = numbered.groupBy("cluster", *restart).agg(
        F.min(ts).alias("start"),
        F.max(ts).alias("end"),
        F.max(F.abs("jump")).alias("peak_rocof"),
        F.count(F.lit(1)).alias("points"),
    )
    dp = physics.power_imbalance(F.lit(inertia_gvas), F.col("peak_rocof"), f0)
    need = physics.required_inertia(dp, F.lit(delta), f0)
    return (
        found.where(seconds_between("start", "end") + 1 >= min_duration_s)
        .withColumn("inertia_gvas", F.lit(inertia_gvas))
        .withColumn("dp_mw", dp)
        .withColumn("dp_gw", dp / 1000.0)
        .withColumn("required_gvas", need)
        .withColumn("extra_gvas", need - inertia_gvas)
        .withColumn("event_class", physics.event_class(dp))
        .drop("cluster")
    )


def event_summary(windows: DataFrame) -> DataFrame:
    """Count, total, longest and worst of breach windows, with the under/over split."""
    under, over = F.col("breach_type") == "under", F.col("breach_type") == "over"
    return windows.agg(
        F.count(F.lit(1)).alias("events"),
        F.coalesce(F.sum("duration_s"), F.lit(0.0)).alias("total_s"),
        F.coalesce(F.sum(F.when(under, F.col("duration_s"))), F.lit(0.0)).alias("under_s"),
        F.coalesce(F.sum(F.when(over, F.col("duration_s"))), F.lit(0.0)).alias("over_s"),
        F.coalesce(F.max("duration_s"), F.lit(0.0)).alias("longest_s"),
        F.count_if(under).alias("under_events"),
        F.count_if(over).alias("over_events"),
        F.min(F.when(under, F.col("min_hz"))).alias("worst_under_hz"),
        F.max(F.when(over, F.col("max_hz"))).alias("worst_over_hz"),
    )


def longest_events(events: DataFrame, n: int = 10) -> DataFrame:
    return events.orderBy(F.col("duration_s").desc(), F.col("start")).limit(n)
