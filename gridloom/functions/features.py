"""Calendar features and flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def date_parts(ts: str | Column) -> dict[str, Column]:
    ts = _c(ts)
    return {"year": F.year(ts), "month": F.month(ts), "iso_week": F.weekofyear(ts)}


def calendar(ts: str | Column) -> dict[str, Column]:
    """Hour, weekday (Monday 0), month and season (winter 1 .. autumn 4)."""
    ts = _c(ts)
    month = F.month(ts)
    return {
        "hour": F.hour(ts),
        "weekday": F.weekday(ts),
        "month": month,
        "season": F.floor((month % 12 + 3) / 3).cast("int"),
    }


def cyclical(ts: str | Column) -> dict[str, Column]:
    ts = _c(ts)
    parts = {"hour": (F.hour(ts), 24), "dow": (F.weekday(ts), 7), "month": (F.month(ts), 12)}
    out: dict[str, Column] = {}
    for name, (value, period) in parts.items():
        angle = value * (2.0 * F.pi() / period)
        out[f"{name}_sin"] = F.sin(angle)
        out[f"{name}_cos"] = F.cos(angle)
    return out


def threshold_flags(f: str | Column, low: float = 49.8, very_low: float = 49.5, high: float = 50.2) -> dict[str, Column]:
    f = _c(f)
    return {
        "is_low": (f < low).cast("int"),
        "is_very_low": (f < very_low).cast("int"),
        "is_high": (f > high).cast("int"),
        "is_event": ((f < low) | (f > high)).cast("int"),
    }


def year_week(ts: str | Column) -> dict[str, Column]:
    """Partition keys: calendar year with ISO week, zero-padded; ``unknown``/``00`` without a time.

    The pair is a pruning key only: the last days of a year can carry week 01 of the next.
    """
    ts = _c(ts)
    return {
        "year": F.coalesce(F.lpad(F.year(ts).cast("string"), 4, "0"), F.lit("unknown")),
        "week": F.coalesce(F.lpad(F.weekofyear(ts).cast("string"), 2, "0"), F.lit("00")),
    }
