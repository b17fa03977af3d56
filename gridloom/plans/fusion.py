"""Training tables: the signal on a fixed clock, its features, and every context source beside it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from gridloom.functions.features import cyclical
from gridloom.operators.asof import Source, fuse
from gridloom.operators.resample import resample
from gridloom.operators.windows import rolling_stats
from gridloom.session import settle


def fused_table(
    signal: DataFrame,
    ts: str,
    value: str,
    seconds: int,
    sources: Sequence[Source],
    windows: Sequence[int] = (5, 30),
    diffs: Sequence[int] = (1, 5),
) -> DataFrame:
    """Resampled signal with calendar and rolling features, and the nearest row of each source.

    Buckets are distinct, so all sources share one shuffle and nothing is joined back.
    """
    clock = settle(resample(signal, ts, seconds, means=[value], gaps=False).withColumnRenamed(f"{value}_mean", value))
    featured = rolling_stats(clock, "bucket", value, windows, diffs).withColumns(cyclical("bucket"))
    return fuse(featured, "bucket", sources, unique_left=True)

