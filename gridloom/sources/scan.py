"""Scans of partitioned tables and of single snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.windows import last_rows_per_key


def scan_years(df: DataFrame, years: int | Sequence[int] | None = None, year: str = "year") -> DataFrame:
    """All rows, or those of some years; on a partition column this prunes files."""
    if years is None:
        return df
    wanted = [years] if isinstance(years, int) else list(years)
    return df.where(F.col(year).isin(wanted))


def scan_range(
    df: DataFrame, ts: str, start: str | None, end: str | None, years: Sequence[int] | None = None, year: str | None = None
) -> DataFrame:
    """Closed time interval, and a list of years where the table has such a column.

    Bounds are literals of the column's own type, so they reach the Parquet reader.
    """
    kind = dict(df.dtypes)[ts]
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start).cast(kind))
    if end is not None:
        df = df.where(F.col(ts) <= F.lit(end).cast(kind))
    if years is not None:
        df = scan_years(df, years, year) if year else df.where(year_ranges(ts, years, kind))
    return df


def year_ranges(ts: str, years: Sequence[int], kind: str = "timestamp") -> Column:
    """Membership in a list of years as time ranges, which Parquet statistics can rule out."""
    whole = F.lit(False)
    for y in years:
        start, end = (F.lit(f"{n:04d}-01-01 00:00:00").cast(kind) for n in (y, y + 1))
        whole = whole | ((F.col(ts) >= start) & (F.col(ts) < end))
    return whole


def partitions(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Available partition values; answered from file names when the keys are partition columns."""
    return df.select(*keys).distinct().orderBy(*keys)


def scan_csv(
    spark: SparkSession, path: str, schema: str, ts: str, start: str, end: str, columns: Sequence[str]
) -> DataFrame:
    """Typed CSV scan with a date filter and a projection."""
    frame = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return scan_range(frame, ts, start, end).select(*columns)


# Names of time columns, best first.
TIME_COLUMNS = ("DatetimeUTC", "Date", "timestamp", "DATETIME", "datetime", "ts", "time")


def first_named(df: DataFrame, names: Sequence[str]) -> str | None:
    lowered = {c.lower(): c for c in df.columns}
    return next((lowered[n.lower()] for n in names if n.lower() in lowered), None)


def snapshot(
    df: DataFrame, preferred: Sequence[str], year: int, max_columns: int | None = None, time_columns: Sequence[str] = TIME_COLUMNS
) -> DataFrame:
    """Time column, the preferred columns and the others (up to ``max_columns`` in all where given); rows
    within a year of ``year``."""
    ts = first_named(df, time_columns)
    if ts is None:
        raise ValueError("no time column")
    rest = [c for c in df.columns if c != ts]
    shown = [c for c in preferred if c in rest]
    others = [c for c in rest if c not in shown]
    shown += others if max_columns is None else others[: max(0, max_columns - 1 - len(shown))]
    near = scan_range(df, ts, f"{year - 1}-01-01 00:00:00", f"{year + 1}-12-31 23:59:59.999999")
    return near.select(F.col(ts).alias("timestamp"), *shown)


def site_column(df: DataFrame, preferred: Sequence[str]) -> Column:
    """The site of a row: the first preferred column, blanks as ``Unknown Site``."""
    name = first_named(df, preferred)
    if name is None:
        return F.lit("All Sites")
    text = F.trim(F.col(name).cast("string"))
    blank = F.col(name).isNull() | (text == "") | (F.lower(text) == "nan")
    return F.when(blank, "Unknown Site").otherwise(text)


def scan_sites(df: DataFrame, preferred: Sequence[str], ts: str) -> DataFrame:
    """One table for all sites, keyed by ``site``; rows without a time are left out."""
    return df.withColumn("site", site_column(df, preferred)).where(F.col(ts).isNotNull())


def tail_per_source(df: DataFrame, source: str, position: Sequence[str], n: int = 10) -> DataFrame:
    """The last n rows of each source; inputs are never modified."""
    return last_rows_per_key(df, [source], position, n)
