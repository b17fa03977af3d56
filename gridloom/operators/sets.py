"""Unions, differences and lookups between tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.clean import keep_last


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def union_reconciled(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column a frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_required(frames: Sequence[DataFrame], required: Sequence[str]) -> DataFrame:
    """Only the required columns, null where a frame lacks one; frames with none are left out."""
    kept = []
    for frame in frames:
        have = [c for c in required if c in frame.columns]
        if have:
            kept.append(frame.select(*have))
    whole = union_reconciled(kept)
    return whole.select(*[F.col(c) if c in whole.columns else F.lit(None).alias(c) for c in required])


def difference_both(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows only in one of two tables, as sets, with the side they miss from.

    Both sides become sets before they meet: copies are combined ahead of the shuffle.
    """
    expected, actual = expected.distinct(), actual.distinct()
    missing = expected.subtract(actual).withColumn("side", F.lit("missing"))
    unexpected = actual.subtract(expected).withColumn("side", F.lit("unexpected"))
    return missing.unionByName(unexpected)


def merge_on(frames: Sequence[DataFrame], key: str, how: str = "inner") -> DataFrame:
    """Join tables on one shared key, inner or full outer."""
    return reduce(lambda a, b: a.join(b, key, how), frames)


def left_join_all(left: DataFrame, others: Sequence[DataFrame], key: str) -> DataFrame:
    return reduce(lambda a, b: a.join(b, key, "left"), others, left)


def lookup(left: DataFrame, table: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Left join on a key; of several table rows with the key the last in order counts."""
    return left.join(keep_last(table, [key], order), key, "left")
