"""Cleaning columns: nulls, non-finite values, clamps, scales, duplicates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def finite(value: str | Column) -> Column:
    """NaN and infinities become null."""
    value = _c(value)
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def clamp(value: str | Column, low: float | None = None, high: float | None = None) -> Column:
    value = _c(value)
    bounded = value
    if high is not None:
        bounded = F.least(F.lit(high), bounded)
    if low is not None:
        bounded = F.greatest(F.lit(low), bounded)
    return F.when(value.isNotNull(), bounded)


def family_sum(columns: Sequence[str | Column]) -> Column:
    """Row-wise sum that skips nulls."""
    return reduce(lambda a, b: a + b, [F.coalesce(_c(c), F.lit(0.0)) for c in columns])


def pick_family(df: DataFrame, suffix: str) -> list[str]:
    return [c for c in df.columns if c.upper().endswith(suffix.upper())]


def drop_nulls(df: DataFrame, how: str = "any", subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(how, subset=list(subset) if subset else None)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last in the given order; combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(newest.alias("_row")).select(*keys, "_row.*")


def autoscale(df: DataFrame, column: str) -> DataFrame:
    """Scale a MW column to MW, GW or TW by its largest magnitude; the unit becomes a column."""
    peak = df.agg(F.max(F.abs(F.col(column)))).first()[0] or 0.0
    factor, unit = (1e6, "TW") if peak >= 1e6 else (1e3, "GW") if peak >= 1e3 else (1.0, "MW")
    return df.withColumn(f"{column}_scaled", F.col(column) / factor).withColumn("unit", F.lit(unit))
