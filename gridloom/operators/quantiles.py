"""Exact interpolated quantiles whose memory need does not grow with the table.

The built-in exact percentile keeps every distinct value of a group in one task. Here a sketch
brackets each wanted rank; only the distinct values inside the brackets are counted, ranked by a
(spilling) window, and the two neighbours of the rank are interpolated. The result is the same
number, and the plan is the same at every size.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ACCURACY = 100_000
#: Half widths of the brackets, narrowest first, and the group size from which each surely holds both neighbours of the rank
#: (one part in n, and the error of the sketch). Smaller groups are looked at whole.
_SPREADS = tuple((s, int(1 / (s - 4.0 / _ACCURACY)) + 2) for s in (8e-5, 2e-3, 0.2))


def quantiles(
    df: DataFrame,
    value: Column,
    probs: Sequence[float],
    names: Sequence[str],
    by: Sequence[str] = (),
) -> DataFrame:
    """One row per group with values (one row at all without ``by``), a column per quantile."""
    rows = df.select(*by, value.cast("double").alias("_v")).where("_v is not null")
    if len(probs) > 30:
        raise ValueError("at most 30 quantiles at once")
    lows = ",".join(f"{max(0.0, p - s):.12f}D" for s, _ in _SPREADS for p in probs)
    highs = ",".join(f"{min(1.0, p + s):.12f}D" for s, _ in _SPREADS for p in probs)
    whole = rows if by else rows.withColumn("_all", F.lit(0))
    keys = list(by) or ["_all"]
    marks = whole.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.expr(f"percentile_approx(_v, array({lows}), {_ACCURACY})").alias("_lo"),
        F.expr(f"percentile_approx(_v, array({highs}), {_ACCURACY})").alias("_hi"),
    )

    def edge(found: str, end: str, i: int, sign: int) -> Column:
        """The bracket's end: of the narrowest spread that is wide enough for the group's size, or the group's own end."""
        out = F.col(end)
        for level in range(len(_SPREADS) - 1, -1, -1):
            spread, least = _SPREADS[level]
            if 0 < probs[i] + sign * spread < 1:
                out = F.when(F.col("_n") >= least, F.get(found, F.lit(level * len(probs) + i))).otherwise(out)
            else:
                out = F.when(F.col("_n") >= least, F.col(end)).otherwise(out)
        return out

    ranks = [
        F.struct(
            F.lit(i).alias("i"),
            ((F.col("_n") - 1) * F.lit(float(p))).alias("at"),
            edge("_lo", "_min", i, -1).alias("lo"),
            edge("_hi", "_max", i, 1).alias("hi"),
        )
        for i, p in enumerate(probs)
    ]
    wanted = marks.select(*[F.col(k).alias(f"_by_{k}") for k in keys], F.array(*ranks).alias("_r"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_by_{k}"))
    # A row inside a bracket keeps its value; any other row only tells which brackets lie above
    # it, so rows shrink to a few counts before the brackets are looked at one by one.
    edges = [F.get("_r", F.lit(i)) for i in range(len(probs))]
    within = reduce(lambda x, y: x | y, [(F.col("_v") >= e["lo"]) & (F.col("_v") <= e["hi"]) for e in edges])
    under = sum((F.when(F.col("_v") < e["lo"], 1 << i).otherwise(0) for i, e in enumerate(edges)), F.lit(0))
    counted = (
        whole.join(wanted, same)
        .groupBy(*keys, under.alias("under"), F.when(within, F.col("_v")).alias("v"))
        .agg(F.count(F.lit(1)).alias("c"))
    )
    each = counted.join(wanted, same).select(*keys, "under", "v", "c", F.explode("_r").alias("r")).select(
        *keys, F.col("r.i").alias("i"), F.col("r.at").alias("at"), "c",
        F.expr("(under & shiftleft(1, r.i)) <> 0").alias("below"),
        F.when((F.col("v") >= F.col("r.lo")) & (F.col("v") <= F.col("r.hi")), F.col("v")).alias("v"),
    )
    climb = Window.partitionBy(*keys, "i").orderBy(F.col("v").asc_nulls_first())
    ranked = each.where("below or v is not null").withColumn("upto", F.sum("c").over(climb)).where("v is not null")
    picked = ranked.groupBy(*keys, "i", "at").agg(
        F.min(F.when(F.col("upto") > F.floor("at"), F.col("v"))).alias("a"),
        F.min(F.when(F.col("upto") > F.ceil("at"), F.col("v"))).alias("b"),
    )
    share = F.col("at") - F.floor("at")
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") * (1 - share) + F.col("b") * share)
    parts = [F.max(F.when(F.col("i") == i, value)).alias(n) for i, n in enumerate(names)]
    return picked.groupBy(*keys).agg(*parts).select(*by, *names)


def quantile_values(df: DataFrame, value: Column, probs: Sequence[float]) -> list[float | None]:
    """Quantiles of a whole column as numbers."""
    names = [f"q{i}" for i in range(len(probs))]
    row = quantiles(df, value, probs, names).first()
    return [None] * len(probs) if row is None else [row[n] for n in names]


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Median of each column, all of them in the same passes."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column", "v")
    found = {r["column"]: r["m"] for r in quantiles(long, F.col("v"), [0.5], ["m"], ["column"]).collect()}
    return {c: found.get(c) for c in columns}


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill nulls with the exact column median."""
    middle = medians(df, columns)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(middle[c])) for c in columns})
