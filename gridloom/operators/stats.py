"""Aggregations and statistics over tables of measures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.quantiles import quantile_values, quantiles
from gridloom.operators.timeorder import SLICE, range_ordered, running_total, seconds_between
from gridloom.operators.windows import rolling_std, sample_durations, with_difference


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    kinds = ("double", "float", "int", "bigint", "smallint", "tinyint")
    return [c for c, t in df.dtypes if (t in kinds or t.startswith("decimal")) and c not in exclude]


def basic(df: DataFrame, period: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*period).agg(
        F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max")
    )


def volatility(df: DataFrame, ts: str, value: str, period: str, rows: int = 10, tie: Sequence[str] = ()) -> DataFrame:
    """Standard deviation, and mean of the rolling one; both start anew per period."""
    rolled = rolling_std(df, ts, value, rows, tie, [period])
    return rolled.groupBy(period).agg(
        F.stddev_samp(value).alias("std"), F.avg(f"std_{rows}").alias("rolling_std_mean")
    )


def jump_count(df: DataFrame, ts: str, value: str, period: str, delta: float, tie: Sequence[str] = ()) -> DataFrame:
    stepped = with_difference(df, ts, value, tie, [period])
    return stepped.groupBy(period).agg(F.count_if(F.abs("diff") > delta).alias("exceedances"))


def jump_quantile(df: DataFrame, ts: str, value: str, period: str, q: float, tie: Sequence[str] = ()) -> DataFrame:
    stepped = with_difference(df, ts, value, tie, [period])
    return quantiles(stepped, F.abs("diff"), [q], ["jump_q"], [period])


def time_in_band(
    df: DataFrame,
    ts: str,
    value: str,
    period: str,
    low: float,
    high: float,
    tie: Sequence[str] = (),
    unit: str = "s",
) -> DataFrame:
    """Seconds (``s``) or hours (``h``) below, above and inside the band; an interval counts for the
    sample that ends it."""
    timed = sample_durations(df, ts, tie, [period])
    v = F.col(value)

    def spent(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("dt_s")).otherwise(0.0)) / (3600.0 if unit == "h" else 1.0)

    return timed.groupBy(period).agg(
        spent(v < low).alias(f"below_{unit}"),
        spent(v > high).alias(f"above_{unit}"),
        spent(v.between(low, high)).alias(f"within_{unit}"),
    )


def column_stats(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    parts = []
    for c in columns:
        parts += [
            F.avg(c).alias(f"{c}_mean"),
            F.min(c).alias(f"{c}_min"),
            F.max(c).alias(f"{c}_max"),
            F.stddev_samp(c).alias(f"{c}_std"),
        ]
    return df.groupBy(*by).agg(*parts)


def totals(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Sums per group; a group without values gives 0."""
    return df.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(f"{c}_total") for c in columns])


def cost_overview(df: DataFrame, period: str, columns: Sequence[str], hours_per_row: float = 0.5) -> DataFrame:
    """Sums, periods, hours and unit costs per period, with a grand-total row labelled ``Total``."""
    whole = F.coalesce(F.sum(sum((F.coalesce(c, F.lit(0.0)) for c in map(F.col, columns)), F.lit(0.0))), F.lit(0.0))
    rolled = df.rollup(period).agg(
        F.grouping(period).alias("_all"),
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(f"{c}_total") for c in columns],
        whole.alias("cost_total"),
        F.count(F.lit(1)).alias("periods"),
    )
    label = F.when(F.col("_all") == 1, "Total").otherwise(F.col(period).cast("string"))
    hours = F.col("periods") * hours_per_row
    return rolled.withColumns(
        {
            "label": label,
            "hours": hours,
            "cost_per_period": F.col("cost_total") / F.col("periods"),
            "cost_per_hour": F.col("cost_total") / hours,
        }
    ).drop("_all", period)


def burden(df: DataFrame, period: str, columns: Sequence[str], meters: float, hours_per_row: float = 0.5) -> DataFrame:
    """Cost per meter: each column, the whole period, per half hour and per hour."""
    sums = df.groupBy(period).agg(
        *[(F.coalesce(F.sum(c), F.lit(0.0)) / meters).alias(f"{c}_per_meter") for c in columns],
        F.count(F.lit(1)).alias("periods"),
    )
    whole = sum((F.col(f"{c}_per_meter") for c in columns), F.lit(0.0))
    return sums.withColumns(
        {
            "hours": F.col("periods") * F.lit(float(hours_per_row)),
            "per_meter_total": whole,
            "per_meter_per_period": whole / F.col("periods"),
            "per_meter_per_hour": whole / (F.col("periods") * hours_per_row),
        }
    )


def cost_summary(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Rows, zero and positive counts, means over all and over the positive (0 when none), extremes, total."""
    v = F.col(value)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("days"),
        F.count_if(v == 0).alias("zero_days"),
        F.count_if(v > 0).alias("nonzero_days"),
        F.avg(v).alias("avg"),
        F.coalesce(F.avg(F.when(v > 0, v)), F.lit(0.0)).alias("nonzero_avg"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.coalesce(F.sum(v), F.lit(0.0)).alias("total"),
    )


def five(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(
        F.avg(value).alias("mean"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.sum(value).alias("sum"),
        F.count(value).alias("count"),
    )


def zero_share(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg((F.avg((F.col(value) == 0).cast("int")) * 100.0).alias("zero_pct"))


def modal_step(df: DataFrame, by: Sequence[str], step: str) -> DataFrame:
    """Most common positive value per group, the smallest on a tie.

    Values are counted across the cluster; a group then keeps one candidate per task.
    """
    counted = df.where(F.col(step) > 0).groupBy(*by, step).agg(F.count(F.lit(1)).alias("_c"))
    best = F.max(F.struct(F.col("_c"), (-F.col(step)).alias("_s")))
    return counted.groupBy(*by).agg((-best["_s"]).alias("step_s"))


def energy_summary(
    df: DataFrame,
    ts: str,
    families: Mapping[str, Sequence[str]],
    period: str,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Per period and family: mean power in GW, and energy in TWh as mean power x rows x usual step."""
    steps = modal_step(sample_durations(df.select(ts, *tie, period), ts, tie, [period]), [period], "dt_s")

    def power(names: Sequence[str]) -> Column:
        return sum((F.coalesce(F.avg(c), F.lit(0.0)) for c in names), F.lit(0.0))

    means = df.groupBy(period).agg(
        F.count(F.lit(1)).alias("rows"), *[power(names).alias(f"_{f}") for f, names in families.items()]
    )
    hours = F.col("rows") * F.col("step_s") / 3600.0
    out = means.join(steps, period, "left")
    for f in families:
        out = out.withColumn(f"{f}_gw", F.col(f"_{f}") / 1000.0).withColumn(f"{f}_twh", F.col(f"_{f}") * hours / 1e6)
    return out.drop(*[f"_{f}" for f in families])


def describe(df: DataFrame, value: Column, by: Sequence[str] = ()) -> DataFrame:
    """count, mean, std, min, quartiles and max."""
    keys = list(by) or ["_all"]
    rows = df.select(*by, value.alias("_x")) if by else df.select(F.lit(0).alias("_all"), value.alias("_x"))
    moments = rows.groupBy(*keys).agg(
        F.count("_x").alias("count"),
        F.avg("_x").alias("mean"),
        F.stddev_samp("_x").alias("std"),
        F.min("_x").alias("min"),
        F.max("_x").alias("max"),
    )
    quarters = quantiles(rows, F.col("_x"), [0.25, 0.5, 0.75], ["q25", "q50", "q75"], keys)
    return moments.join(quarters, keys, "left").drop("_all")


def guarded_ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) != 0, F.col(a) / F.col(b))


def correlation_rank(df: DataFrame, target: str, columns: Sequence[str], n: int) -> DataFrame:
    """Pearson correlation of every column with the target, strongest first."""
    row = df.agg(*[F.corr(c, target).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("corr")) for c in columns]))
    long = row.select(pairs.alias("p")).select("p.*").where("corr is not null")
    return long.withColumn("abs_corr", F.abs("corr")).orderBy(F.col("abs_corr").desc(), "feature").limit(n)


def width_bins(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """Equal-width, right-closed bins of x with statistics of y and x; empty bins are kept."""
    low, high = df.agg(F.min(x), F.max(x)).first()
    ids = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    if low is None:
        low, high = 0.0, 1.0
    if low == high:
        pad = abs(low) * 0.001 or 0.001
        low, high = low - pad, high + pad
    width = (high - low) / bins
    place = F.ceil((F.col(x) - F.lit(low)) / width).cast("int")
    inside = F.greatest(F.lit(1), F.least(F.lit(bins), place))
    grouped = df.where(F.col(x).isNotNull()).groupBy(inside.alias("bin")).agg(
        F.count(y).alias("count"),
        F.avg(y).alias("mean"),
        F.stddev_samp(y).alias("std"),
        F.min(y).alias("min"),
        F.max(y).alias("max"),
        F.avg(x).alias("x_mean"),
        F.min(x).alias("x_min"),
        F.max(x).alias("x_max"),
    )
    return ids.join(F.broadcast(grouped), "bin", "left").withColumn("count", F.coalesce("count", F.lit(0)))


def quantile_bins(
    df: DataFrame, x: str, target: str, bins: int = 5, min_rows: int = 250, min_distinct: int = 5
) -> DataFrame:
    """Bins between the quantiles of x (right-closed, equal edges merged) with target statistics."""
    pairs = df.select(x, target).na.drop()
    marks = [i / bins for i in range(bins + 1)]
    enough = len(pairs.limit(min_rows).select(F.lit(1)).collect()) >= min_rows
    varied = len(pairs.select(x).distinct().limit(min_distinct).collect()) >= min_distinct
    if not (enough and varied):
        return pairs.limit(0).select(
            F.lit(0).alias("bin"),
            F.lit(0).cast("bigint").alias("window_count"),
            *[F.lit(0.0).alias(f"target_{s}") for s in ("mean", "median", "max")],
        )
    edges = sorted(set(quantile_values(pairs, F.col(x), marks)))
    bin_no = F.lit(1)
    for i, edge in enumerate(edges[1:-1], start=2):
        bin_no = F.when(F.col(x) > edge, i).otherwise(bin_no)
    binned = pairs.withColumn("bin", bin_no)
    moments = binned.groupBy("bin").agg(
        F.count(F.lit(1)).alias("window_count"), F.avg(target).alias("target_mean"), F.max(target).alias("target_max")
    )
    return moments.join(quantiles(binned, F.col(target), [0.5], ["target_median"], ["bin"]), "bin", "left")


def histogram2d(df: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    """Counts on an equal-width grid; the largest value belongs to the last cell."""
    pairs = df.select(x, y).na.drop()
    r = pairs.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")).first()

    def cell(c: str, low: float, high: float) -> Column:
        width = (high - low) / bins or 1.0
        return F.least(F.lit(bins - 1), F.floor((F.col(c) - F.lit(low)) / F.lit(width)).cast("int"))

    if r["x0"] is None:
        r = {"x0": 0.0, "x1": 1.0, "y0": 0.0, "y1": 1.0}
    grid = pairs.groupBy(cell(x, r["x0"], r["x1"]).alias("x_bin"), cell(y, r["y0"], r["y1"]).alias("y_bin"))
    return grid.agg(F.count(F.lit(1)).alias("count"))


def quadratic_fit(df: DataFrame, x: str, y: str, points: int = 100) -> DataFrame:
    """Least-squares parabola from centred power sums, evaluated on an even grid."""
    import numpy as np

    pairs = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).na.drop()
    head = pairs.agg(F.avg("x"), F.stddev_pop("x"), F.min("x"), F.max("x"), F.count("x")).first()
    mean, spread, low, high, n = head
    if n < 3 or not spread:
        raise ValueError("a parabola needs three different x values")
    z = (F.col("x") - mean) / spread
    sums = pairs.select(z.alias("z"), "y").agg(
        *[F.sum(F.pow("z", F.lit(k))).alias(f"s{k}") for k in range(5)],
        *[F.sum(F.col("y") * F.pow("z", F.lit(k))).alias(f"t{k}") for k in range(3)],
    ).first()
    matrix = np.array([[sums[f"s{i + j}"] for j in range(3)] for i in range(3)])
    c0, c1, c2 = (float(v) for v in np.linalg.solve(matrix, [sums[f"t{i}"] for i in range(3)]))
    grid = df.sparkSession.range(points).select(
        (F.lit(low) + F.col("id") * ((high - low) / (points - 1))).alias("x")
    )
    at = (F.col("x") - mean) / spread
    return grid.withColumn("fit", c0 + at * c1 + at * at * c2)


def calibration(df: DataFrame, x: str, y: str, min_points: int = 24) -> DataFrame:
    """Line of y on x with R²; null figures below ``min_points`` or without spread in x."""
    pairs = df.select(F.col(x).alias("x"), F.col(y).alias("y")).na.drop()
    row = pairs.agg(
        F.count(F.lit(1)).alias("points"),
        F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"),
        F.regr_r2("y", "x").alias("r2"),
        F.stddev_pop("x").alias("spread"),
    )
    usable = (F.col("points") >= min_points) & (F.col("spread") > 1e-8)
    return row.select("points", *[F.when(usable, F.col(c)).alias(c) for c in ("slope", "intercept", "r2")])


def calibrated(value: Column, slope: Column, intercept: Column) -> Column:
    return F.greatest(F.lit(0.0), intercept + slope * value)


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of non-null values per column and whether it varies, as rows."""
    row = df.agg(
        *[F.avg(F.col(c).isNotNull().cast("int")).alias(f"r_{c}") for c in columns],
        *[F.coalesce(F.min(c) < F.max(c), F.lit(False)).alias(f"v_{c}") for c in columns],
        *[F.count(c).alias(f"n_{c}") for c in columns],
    )
    each = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(i).alias("position"),
            F.col(f"n_{c}").alias("known"),
            F.col(f"r_{c}").alias("ratio"),
            F.col(f"v_{c}").alias("varies"),
        )
        for i, c in enumerate(columns)
    ]
    return row.select(F.explode(F.array(*each)).alias("c")).select("c.*")


def sparse_columns(df: DataFrame, share: float = 0.98) -> list[str]:
    """Columns whose nulls exceed the share of rows (rounded down)."""
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in df.columns]).first()
    limit = int(share * row["_n"])
    return [c for c in df.columns if row["_n"] - row[c] > limit]


def drop_sparse(df: DataFrame, share: float = 0.98) -> DataFrame:
    return df.drop(*sparse_columns(df, share))


def select_targets(
    df: DataFrame, candidates: Sequence[str], min_ratio: float = 0.35, max_targets: int | None = None, min_joint_rows: int = 0
) -> DataFrame:
    """Varying columns with enough values, best covered first; the sparsest leave until enough
    rows are complete. One pass counts the complete rows of every shortened list."""
    rows = coverage(df, candidates).where((F.col("ratio") >= min_ratio) & F.col("varies"))
    ranked = sorted(rows.collect(), key=lambda r: (-r["ratio"], r["position"]))[:max_targets]
    # Of equally covered columns the earlier one leaves first.
    names = [r["column"] for r in sorted(ranked, key=lambda r: (-r["ratio"], -r["position"]))]
    if not names:
        return rows.limit(0)
    checks, known = [], F.lit(True)
    for i, c in enumerate(names):
        known = known & F.col(c).isNotNull()
        checks.append(F.count_if(known).alias(f"k{i}"))
    complete = df.agg(*checks).first()
    size = len(names)
    while size > 1 and complete[f"k{size - 1}"] < min_joint_rows:
        size -= 1
    chosen = Window.orderBy(F.col("ratio").desc(), "position")
    return (
        rows.where(F.col("column").isin(names[:size]))
        .withColumn("rank", F.row_number().over(chosen))
        .select("rank", "column", "known", "ratio", F.lit(complete[f"k{size - 1}"]).alias("joint_rows"))
    )


def select_features(
    df: DataFrame, candidates: Sequence[str], min_ratio: float, fallback: int | None = None, cap: int | None = None
) -> DataFrame:
    """Columns covered well enough; the best ``fallback`` (or all) when none is; at most ``cap`` where one is given."""
    rows = coverage(df, candidates)
    good = rows.where(F.col("ratio") >= min_ratio)
    order = [F.col("ratio").desc(), F.col("position")]
    chosen, most = (good, cap) if good.limit(1).count() else (rows, fallback)
    picked = chosen.orderBy(*order) if most is None else chosen.orderBy(*order).limit(most)
    return picked.select("column", "known", "ratio")


def rate_summary(
    df: DataFrame,
    rate: str = "rocof_hz_per_s",
    ts: str = "rocof_timestamp",
    matched: str | None = None,
) -> DataFrame:
    """Rows, match rate, bounds, and mean/std/p95/max of the rate."""
    hit = F.count(matched) if matched else F.lit(0).cast("bigint")
    size = F.abs(F.col(rate))
    rows = F.count(F.lit(1))
    moments = df.agg(
        rows.alias("rows"),
        hit.alias("matched_rows"),
        F.when(rows > 0, hit / rows).otherwise(0.0).alias("match_rate"),
        F.min(ts).alias("time_start"),
        F.max(ts).alias("time_end"),
        F.avg(rate).alias("rocof_mean"),
        F.stddev_samp(rate).alias("rocof_std"),
        F.max(size).alias("rocof_abs_max"),
    )
    return moments.withColumn("rocof_abs_p95", F.lit(quantile_values(df.select(rate), size, [0.95])[0]).cast("double"))


def regression_metrics(df: DataFrame, truth: str, guess: str, by: Sequence[str] = ()) -> DataFrame:
    """rmse, mae and r2 (0 when the truth does not vary)."""
    e = F.col(truth) - F.col(guess)
    scored = df.groupBy(*by).agg(
        F.count(e).alias("rows"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.sum(e * e).alias("_sse"),
        (F.var_pop(truth) * F.count(truth)).alias("_sst"),
    )
    r2 = F.when(F.col("_sst") > 0, 1.0 - F.col("_sse") / F.col("_sst")).otherwise(0.0)
    return scored.withColumn("r2", r2).drop("_sse", "_sst")


def cadence(df: DataFrame, site: str, ts: str, sites: int | None = None, steps: int | None = None) -> DataFrame:
    """Bucket period from the median positive step between neighbouring rows of a site.

    All sites and steps count; ``sites`` and ``steps`` restrict them to the first ones. Rows are sorted by (site, time) in
    range partitions, so a site of any length is spread out; each partition borrows the last row before it.
    """
    rows = df.select(F.col(site).alias("_site"), F.col(ts).alias("_ts")).where("_ts is not null and _site is not null")
    if sites is not None:
        rows = rows.join(rows.select("_site").distinct().orderBy("_site").limit(sites), "_site", "left_semi")
    if steps is not None:
        head = Window.partitionBy("_site").orderBy("_ts")
        rows = rows.withColumn("_n", F.row_number().over(head)).where(F.col("_n") <= steps + 1).drop("_n")
    placed = range_ordered(rows, ["_site", "_ts"])
    here = F.struct("_site", "_ts")
    ends = placed.groupBy(SLICE).agg(F.max_by(here, "_local").alias("_end"))
    ends = ends.select(SLICE, F.lag("_end").over(Window.orderBy(SLICE)).alias("_carried"))
    before = F.coalesce(F.lag(here).over(Window.partitionBy(SLICE).orderBy("_local")), "_carried")
    stepped = placed.join(F.broadcast(ends), SLICE).withColumn("_before", before).where("_before._site = _site")
    stepped = stepped.select(seconds_between("_before._ts", "_ts").alias("step")).where("step > 0")
    median = df.sparkSession.range(1).select(F.lit(quantile_values(stepped, F.col("step"), [0.5])[0]).cast("double").alias("median_s"))
    # Limits and periods in seconds.
    period = (
        F.when(F.col("median_s").isNull(), 1800)
        .when(F.col("median_s") <= 2700, 1800)
        .when(F.col("median_s") <= 5400, 3600)
        .when(F.col("median_s") <= 21600, 21600)
        .when(F.col("median_s") <= 43200, 43200)
        .otherwise(86400)
    )
    return median.withColumn("period_s", period)


def bounds(df: DataFrame, ts: str) -> DataFrame:
    return df.agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def file_totals(files: DataFrame, columns_col: str = "columns") -> DataFrame:
    """Rows and datapoints per file with rank by size, running sum and status.

    ``files`` has one row per file (file, rows, columns); a file without a row count failed.
    """
    points = files.withColumn("datapoints", F.col("rows") * F.col(columns_col)).withColumns(
        {
            "status": F.when(F.col("rows").isNull(), "failed").otherwise("ok"),
            "_less": -F.col("datapoints"),
        }
    )
    placed = range_ordered(points, ["_less", "file"]).withColumnRenamed("_local", "_at")
    ranked = running_total(placed, ["_at"], F.lit(1), "rank")
    whole = running_total(ranked, ["_at"], F.coalesce("datapoints", F.lit(0)), "running")
    return whole.drop(SLICE, "_at", "_less")
