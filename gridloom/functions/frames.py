"""Replay frame columns: defaults, breakdowns to long form, utilisation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frame_defaults(
    f_start: str, f_end: str, rate: str, generation: str, demand: str, zeros: Sequence[str]
) -> dict[str, Column]:
    """Start frequency falls back to the end, demand to generation, rate and flows to 0."""
    out = {
        f_start: F.coalesce(f_start, f_end),
        rate: F.coalesce(rate, F.lit(0.0)),
        demand: F.coalesce(demand, generation),
    }
    out.update({c: F.coalesce(c, F.lit(0.0)) for c in zeros})
    return out


def breakdown(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per (frame, name) with 0 for missing values."""
    return df.unpivot(list(keys), list(columns), "name", "mw").withColumn("mw", F.coalesce("mw", F.lit(0.0)))


def utilisation(df: DataFrame, fuels: Sequence[str], known: Mapping[str, float] | None = None) -> DataFrame:
    """Each fuel as a percentage of its maximum, 0 to 100.

    Maxima that are not known come from the data; a maximum of 0 counts as 1.
    """
    known = dict(known or {})
    missing = [f for f in fuels if f not in known]
    if missing:
        seen = df.agg(*[F.max(f).alias(f) for f in missing]).first()
        known.update({f: seen[f] or 1.0 for f in missing})

    def share(f: str) -> Column:
        pct = F.coalesce(F.col(f), F.lit(0.0)) / (known[f] or 1.0) * 100.0
        return F.greatest(F.lit(0.0), F.least(F.lit(100.0), pct))

    return df.withColumns({f"{f}_pct": share(f) for f in fuels})


def link_utilisation(flows: Sequence[str]) -> dict[str, Column]:
    """Each interconnector as a percentage of the largest flow of its frame (at least 1 MW)."""
    size = {f: F.abs(F.coalesce(F.col(f), F.lit(0.0))) for f in flows}
    peak = F.greatest(F.lit(1.0), *size.values())
    return {f"{f}_pct": s / peak * 100.0 for f, s in size.items()}
