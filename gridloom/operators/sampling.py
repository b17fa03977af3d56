"""Sort, limit, top-k, thinning, sampling and splitting."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.timeorder import position_in_group, select_positions

#: Most rows that one task puts together from the best rows of all tasks; larger selections go by counts per slice.
HEAP_ROWS = 100_000


def head_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows in order (a distributed top-k, no full sort); missing values come first."""
    if n <= HEAP_ROWS:
        return df.orderBy(*order).limit(n)
    first = select_positions(df, order, lambda rows: (lambda start, end: start < n, F.col("_at") < n), "_at", nulls_last=False)
    return first.drop("_at")


def tail_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The newest n rows, oldest first. Large selections come in range partitions instead of one."""
    if n <= HEAP_ROWS:
        return df.orderBy(*[F.col(c).desc() for c in order]).limit(n).orderBy(*order)
    last = select_positions(
        df, order, lambda rows: (lambda start, end: end > rows - n, F.col("_at") >= rows - n), "_at", nulls_last=False
    )
    return last.orderBy("_at").drop("_at")


def top_n(df: DataFrame, by: str, n: int, ties: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.col(by).desc_nulls_last(), *ties).limit(n)


def top_k_per_group(df: DataFrame, group: Sequence[str], by: str, k: int, ties: Sequence[str] = ()) -> DataFrame:
    ranked = Window.partitionBy(*group).orderBy(F.col(by).desc_nulls_last(), *ties)
    return df.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def row_stride(df: DataFrame, order: Sequence[str], stride: int, source: str | None = None) -> DataFrame:
    """Every n-th row in order, counted anew for each source."""
    keys = [source] if source else []
    indexed = position_in_group(df, keys, order)
    return indexed.where(F.col("row_no") % stride == 0).drop("row_no")


def even_downsample(df: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """k rows at evenly spaced positions, first and last included; all rows when there are fewer."""

    def wanted(n: int) -> tuple[Callable[[int, int], bool], Column]:
        if k <= 0 or n <= k:
            return (lambda start, end: True), F.lit(True)
        if k == 1:
            return (lambda start, end: start == 0), F.col("row_no") == 0
        # Row p is position floor(i * (n - 1) / (k - 1)) for some i, exactly when the step lands on it.
        step = f"((row_no * {k - 1}L + {n - 2}L) div {n - 1}L)"

        def may(start: int, end: int) -> bool:
            return (start * (k - 1) + n - 2) // (n - 1) * (n - 1) // (k - 1) < end

        return may, F.expr(f"({step} * {n - 1}L) div {k - 1}L = row_no")

    return select_positions(df, order, wanted)


def window_slice(df: DataFrame, ts: str, seconds: float, start: str | None = None) -> DataFrame:
    """Rows in [start, start + seconds); the whole table when that is empty."""
    begin = F.lit(start).cast("timestamp") if start else F.lit(df.agg(F.min(ts)).first()[0]).cast("timestamp")
    end = begin + F.make_dt_interval(secs=F.lit(seconds))
    moment = F.col(ts).cast("timestamp")
    part = df.where((moment >= begin) & (moment < end))
    return df if part.isEmpty() else part


def sample_rows(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """n rows chosen by a seeded hash of the key: repeatable whatever the partitioning."""
    drawn = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]))
    if n <= HEAP_ROWS:
        return df.orderBy(drawn, *key).limit(n)
    # The first digits as a number never fall where the whole hash rises.
    marked = df.withColumns({"_draw": drawn, "_draw_no": F.conv(F.left(drawn, F.lit(12)), 16, 10).cast("bigint")})
    return head_rows(marked, ["_draw_no", "_draw", *key], n).drop("_draw", "_draw_no")


def chronological_split(df: DataFrame, order: Sequence[str], share: float = 0.8) -> DataFrame:
    """Mark the first ``int(n * share)`` rows, at least 1 and at most n - 1, as ``train``."""
    cut = 0

    def wanted(n: int) -> tuple[Callable[[int, int], bool], Column]:
        nonlocal cut
        cut = min(max(int(n * share), 1), max(n - 1, 1))
        return (lambda start, end: True), F.lit(True)

    indexed = select_positions(df, order, wanted)
    return indexed.withColumn("part", F.when(F.col("row_no") < cut, "train").otherwise("test"))
