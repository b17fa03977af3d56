"""Signal to summary: rate of change, alignment with context tables, replay frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.clean import keep_last
from gridloom.operators.asof import Source, fuse, time_axis
from gridloom.operators.sampling import even_downsample, window_slice
from gridloom.operators.stats import rate_summary
from gridloom.operators.timeorder import Slices, micros, plan_slices
from gridloom.operators.windows import rocof
from gridloom.sources.sink import replay_frames


def aligned_rocof(
    signal: DataFrame,
    context: DataFrame,
    ts: str,
    value: str,
    context_ts: str,
    columns: Sequence[str],
    tolerance_s: float = 1800.0,
    stamp: str = "midpoint",
    tie: Sequence[str] = (),
    slices: Slices | None = None,
) -> DataFrame:
    """Rate of change per sample with the nearest context row within the tolerance.

    Midpoints of one signal are distinct, so the samples go through the join without a lookup
    back. Both steps use one set of cuts, taken from the raw time columns.
    """
    if slices is None:
        slices = shared_slices(signal, ts, context, context_ts, tie)
    rates = rocof(signal, ts, value, stamp, tie, slices)
    source = Source(context, context_ts, columns, "matched_", tolerance=tolerance_s)
    return fuse(rates, "rocof_timestamp", [source], unique_left=True, slices=slices)


def shared_slices(signal: DataFrame, ts: str, context: DataFrame, context_ts: str, tie: Sequence[str] = ()) -> Slices:
    axis = time_axis([(signal, ts), (context, context_ts)])
    return plan_slices(signal, micros(ts), next(iter(tie), None), count=True, axis=axis)


def rocof_report(signal: DataFrame, context: DataFrame, ts: str, value: str, context_ts: str, **how) -> DataFrame:
    """Summary of the aligned rates; only the match itself is carried through the join."""
    slices = shared_slices(signal, ts, context, context_ts, how.get("tie", ()))
    aligned = aligned_rocof(signal, context, ts, value, context_ts, [], slices=slices, **how)
    return rate_summary(aligned, matched="matched_ts")


def replay_table(
    signal: DataFrame, ts: str, value: str, sources: Sequence[Source], stamp: str = "midpoint", seq: str | None = None
) -> DataFrame:
    """Rates of a raw signal beside several context tables, with the estimated demand.

    Samples sharing an instant are reduced to the last one first.
    """
    samples = keep_last(signal, [ts], [seq] if seq else [value])
    slices = plan_slices(samples, micros(ts), count=True, axis=time_axis([(samples, ts), *[(s.df, s.ts) for s in sources]]))
    rates = rocof(samples, ts, value, stamp, slices=slices)
    return estimated_demand(fuse(rates, "rocof_timestamp", sources, unique_left=True, slices=slices))


def replay_output(
    table: DataFrame, seconds: float | None, start: str | None, max_frames: int, numbers: Sequence[str]
) -> DataFrame:
    """Frames of one stretch of time, thinned evenly, as JSON in time order."""
    part = window_slice(table, "rocof_timestamp", seconds, start) if seconds else table
    thin = even_downsample(part, ["rocof_timestamp"], max_frames)
    return replay_frames(thin, "row_no", ["rocof_timestamp"], numbers)


def estimated_demand(df: DataFrame) -> DataFrame:
    """Demand from national demand, transmission demand, generation or the modelled sum, in this order."""
    have = [c for c in ("ND", "TSD", "GENERATION" if "GENERATION" in df.columns else "MODELLED_ONLINE_MW") if c in df.columns]
    power = [c for c in ("GENERATION", "MODELLED_ONLINE_MW") if c in df.columns]
    none = F.lit(None).cast("double")
    return df.withColumns(
        {
            "estimated_demand_mw": F.coalesce(*[F.col(c).cast("double") for c in have], none),
            "total_generation_mw": F.coalesce(*[F.col(c).cast("double") for c in power], none),
        }
    )
