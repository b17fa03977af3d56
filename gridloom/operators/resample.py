"""Fixed-grid resampling and per-bucket statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.quantiles import medians, quantiles
from gridloom.operators.timeorder import micros, ordered, plan_slices
from gridloom.session import settle

SECOND = 1_000_000


def bucket_start(ts: str | Column, seconds: int) -> Column:
    """Start of the fixed bucket holding the instant."""
    width = seconds * SECOND
    key = micros(ts)
    return F.timestamp_micros(key - F.pmod(key, F.lit(width)))


def spine(df: DataFrame, ts: str, seconds: int) -> DataFrame:
    """Every bucket between the first and the last row, produced by the executors."""
    width = seconds * SECOND
    row = df.agg(F.min(micros(ts)).alias("a"), F.max(micros(ts)).alias("b")).first()
    if row["a"] is None:
        first, last = 0, -1
    else:
        first, last = row["a"] // width, row["b"] // width
    ids = df.sparkSession.range(first, last + 1)
    return ids.select(F.timestamp_micros(F.col("id") * width).alias("bucket"))


def resample(
    df: DataFrame, ts: str, seconds: int, means: Sequence[str] = (), sums: Sequence[str] = (), gaps: bool = True
) -> DataFrame:
    """Bucket means and sums; with ``gaps`` empty buckets appear (null mean, 0 sum)."""
    grouped = df.groupBy(bucket_start(ts, seconds).alias("bucket")).agg(
        *[F.avg(c).alias(f"{c}_mean") for c in means], *[F.sum(c).alias(f"{c}_sum") for c in sums]
    )
    if not gaps:
        return grouped
    full = spine(df, ts, seconds).join(grouped, "bucket", "left")
    return full.withColumns({f"{c}_sum": F.coalesce(f"{c}_sum", F.lit(0.0)) for c in sums})


def bucket_targets(
    df: DataFrame,
    ts: str,
    value: str,
    seconds: int = 3600,
    nominal: float = 50.0,
    low: float = 49.95,
    high: float = 50.05,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Per-bucket signal statistics; differences start anew in every bucket."""
    framed = df.select(ts, value, *tie).withColumn("bucket", bucket_start(ts, seconds))

    def build(frame: DataFrame, w) -> DataFrame:
        return frame.withColumn("_diff", F.abs(F.col(value) - F.lag(value).over(w)))

    slices = plan_slices(framed, micros(ts), next(iter(tie), None), count=True)
    stepped = ordered(framed, ts, 1, build, tie, ["bucket"], slices)
    v = F.col(value)
    rows = F.count(F.lit(1))
    grouped = stepped.groupBy("bucket").agg(
        F.avg(v).alias("freq_mean"),
        F.stddev_samp(v).alias("freq_std"),
        F.min(v).alias("freq_min"),
        F.max(v).alias("freq_max"),
        F.count(v).alias("freq_count"),
        F.avg(F.abs(v - nominal)).alias("abs_dev_mean"),
        F.avg(((v < low) | (v > high)).cast("int")).alias("outside_share"),
        F.when(rows > 1, F.max("_diff")).alias("rocof_abs_max"),
        rows.alias("_rows"),
    )
    tail = quantiles(stepped, F.col("_diff"), [0.95], ["_p95"], ["bucket"])
    grouped = grouped.join(tail, "bucket", "left")
    return grouped.withColumn("rocof_abs_p95", F.when(F.col("_rows") > 2, F.col("_p95"))).drop("_rows", "_p95")


def instability(targets: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Weighted sum of robust z-scores: (x - median) / (MAD + 1e-9) per column.

    The targets, one row per bucket, are written once and read for medians, spreads and scores.
    """
    columns = list(weights)
    targets = settle(targets)
    middle = medians(targets, columns)
    centred = {c: F.col(c) - F.lit(middle[c]) for c in columns}
    spreads = medians(targets.select(*[F.abs(centred[c]).alias(c) for c in columns]), columns)
    score = sum((centred[c] / (F.lit(spreads[c]) + 1e-9) * w for c, w in weights.items()), F.lit(0.0))
    return targets.withColumn("instability_score", score)
