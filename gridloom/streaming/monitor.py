"""Windowed monitoring of a stream: tumbling, sliding and session windows under a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_bucket(
    stream: DataFrame, ts: str, site: str, columns: Sequence[str], period: str = "30 minutes", delay: str = "1 hour",
    tie: Sequence[str] = (),
) -> DataFrame:
    """Newest row of each site in each bucket; of equal times the one with the greatest ``tie`` columns.

    No filter on the site here: the optimiser would move it below the watermark, and rows it
    drops would no longer advance time.
    """
    row = F.struct(F.col(ts), *[F.col(c) for c in columns])
    newest = (
        stream.withWatermark(ts, delay)
        .groupBy(F.window(ts, period), F.col(site))
        .agg(F.max_by(row, F.struct(ts, *tie)).alias("row"))
    )
    return newest.select(F.col("window.start").alias("bucket"), site, "row.*")


def sliding_stats(
    stream: DataFrame, ts: str, value: str, width: str = "10 minutes", slide: str = "1 minute", delay: str = "1 hour"
) -> DataFrame:
    """Count, extremes and mean of overlapping windows; partial sums are combined before the shuffle."""
    return (
        stream.withWatermark(ts, delay)
        .groupBy(F.window(ts, width, slide))
        .agg(
            F.count(value).alias("points"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
            F.avg(value).alias("mean"),
        )
        .where("points > 0")
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "points", "min", "max", "mean")
    )


def exceedance_sessions(
    stream: DataFrame, ts: str, site: str, value: str, limit: float, gap: str = "10 seconds", delay: str = "1 hour"
) -> DataFrame:
    """Clusters of exceedances per site, split by a pause longer than the gap.

    Rows inside the limit still move the watermark: the condition names the event time, so the
    optimiser keeps it above.
    """
    hit = F.coalesce((F.abs(value) > limit) & F.col(ts).isNotNull(), F.lit(False))
    marked = stream.withWatermark(ts, delay).withColumn("hit", hit)
    return (
        marked.where("hit")
        .groupBy(F.session_window(ts, gap), F.col(site))
        .agg(F.count(F.lit(1)).alias("points"), F.max(value).alias("peak"), F.min(ts).alias("start"), F.max(ts).alias("end"))
        .select(site, "start", "end", "points", "peak")
    )
