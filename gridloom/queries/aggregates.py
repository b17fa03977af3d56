"""Aggregations and statistics on the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import physics
from gridloom.operators import resample, stats, windows
from gridloom.queries.registry import MIX_SQL, Tables, query, rounded

TIE = ["event_id"]
KINDS = ["click", "error", "purchase", "signup", "view"]
DAY = "date_trunc('day', ts)"

DIFF_SQL = f"""SELECT {DAY} AS day, ts, event_id, value,
   value - lag(value) OVER w AS diff,
   coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6, 0) AS dt
   FROM events WINDOW w AS (PARTITION BY {DAY} ORDER BY ts, event_id)"""


def daily(t: Tables) -> DataFrame:
    return t.signal().withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))


def yearly(t: Tables) -> DataFrame:
    return t.orders.withColumn("year", F.year("o_orderdate"))


YEAR = "CAST(year(o_orderdate) AS INTEGER) AS year"


@query(
    "yearly_basic",
    f"""SELECT {YEAR}, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS min, max(o_totalprice) AS max
        FROM orders GROUP BY 1""",
)
def yearly_basic(t: Tables) -> DataFrame:
    return rounded(stats.basic(yearly(t), ["year"], "o_totalprice"), 4)


@query(
    "volatility",
    f"""WITH r AS (SELECT {DAY} AS day, value, CASE WHEN count(value) OVER w >= 10 THEN stddev_samp(value) OVER w END AS s
          FROM events WINDOW w AS (PARTITION BY {DAY} ORDER BY ts, event_id ROWS 9 PRECEDING))
        SELECT day, round(stddev_samp(value), 6) AS std, round(avg(s), 6) AS rolling_std_mean FROM r GROUP BY 1""",
)
def volatility(t: Tables) -> DataFrame:
    return rounded(stats.volatility(daily(t), "ts", "value", "day", tie=TIE))


@query(
    "nadir_zenith",
    f"SELECT {YEAR}, min(o_totalprice) AS nadir, max(o_totalprice) AS zenith FROM orders GROUP BY 1",
)
def nadir_zenith(t: Tables) -> DataFrame:
    found = stats.basic(yearly(t), ["year"], "o_totalprice")
    return found.select("year", F.col("min").alias("nadir"), F.col("max").alias("zenith"))


@query(
    "rocof_count",
    f"SELECT day, count(*) FILTER (WHERE abs(diff) > 20.125) AS exceedances FROM ({DIFF_SQL}) GROUP BY 1",
)
def rocof_count(t: Tables) -> DataFrame:
    return stats.jump_count(daily(t), "ts", "value", "day", 20.125, TIE)


@query(
    "inertia_trend",
    f"""SELECT day, round(quantile_cont(abs(diff), 0.95), 6) AS rocof_p95,
          round(1000.0 * 50.0 / (2 * quantile_cont(abs(diff), 0.95)) / 1000.0, 6) AS required_gvas
        FROM ({DIFF_SQL}) GROUP BY 1""",
)
def inertia_trend(t: Tables) -> DataFrame:
    q = stats.jump_quantile(daily(t), "ts", "value", "day", 0.95, TIE)
    need = physics.required_inertia(F.lit(1000.0), F.col("jump_q"))
    return rounded(q.select("day", F.col("jump_q").alias("rocof_p95"), need.alias("required_gvas")))


@query(
    "time_in_band",
    f"""SELECT day, round(coalesce(sum(dt) FILTER (WHERE value < 5), 0), 6) AS below_s,
          round(coalesce(sum(dt) FILTER (WHERE value > 120), 0), 6) AS above_s,
          round(coalesce(sum(dt) FILTER (WHERE value BETWEEN 5 AND 120), 0), 6) AS within_s FROM ({DIFF_SQL}) GROUP BY 1""",
)
def time_in_band(t: Tables) -> DataFrame:
    return rounded(stats.time_in_band(daily(t), "ts", "value", "day", 5.0, 120.0, TIE), 6)


@query(
    "col_stats",
    "SELECT "
    + ", ".join(
        f"round(avg({c}), 4) AS {c}_mean, min({c}) AS {c}_min, max({c}) AS {c}_max, round(stddev_samp({c}), 4) AS {c}_std"
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    )
    + " FROM lineitem",
)
def col_stats(t: Tables) -> DataFrame:
    return rounded(stats.column_stats(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), 4)


def money(df: DataFrame, *names: str) -> DataFrame:
    """Money columns as decimals: exact sums whatever the order of addition."""
    return df.withColumns({c: F.col(c).cast("decimal(18,2)") for c in names})


@query(
    "yearly_totals",
    """SELECT CAST(year(l_shipdate) AS INTEGER) AS year, sum(l_quantity) AS l_quantity_total,
         round(sum(l_extendedprice), 2) AS l_extendedprice_total, round(sum(l_discount), 2) AS l_discount_total,
         round(sum(l_tax), 2) AS l_tax_total FROM lineitem GROUP BY 1""",
)
def yearly_totals(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("year", F.year("l_shipdate"))
    measures = [c for c in stats.numeric_columns(t.lineitem) if dict(t.lineitem.dtypes)[c] == "double"]
    return rounded(stats.totals(rows, ["year"], measures), 2)


@query(
    "monthly_agg",
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
         round(avg(o_totalprice), 4) AS o_totalprice_mean, round(sum(o_totalprice), 2) AS o_totalprice_total FROM orders GROUP BY 1, 2""",
)
def monthly_agg(t: Tables) -> DataFrame:
    rows = yearly(t).withColumn("month", F.month("o_orderdate"))
    out = rows.groupBy("year", "month").agg(
        F.avg("o_totalprice").alias("o_totalprice_mean"), F.sum("o_totalprice").alias("o_totalprice_total")
    )
    return rounded(out, 4, o_totalprice_total=2)


@query(
    "overview_rollup",
    """SELECT label, round(p, 2) AS l_extendedprice_total, round(x, 2) AS l_tax_total, round(p + x, 2) AS cost_total, n AS periods,
         n * 0.5 AS hours, round((p + x) / n, 4) AS cost_per_period, round((p + x) / (n * 0.5), 4) AS cost_per_hour
       FROM (SELECT CASE WHEN grouping(y) = 1 THEN 'Total' ELSE CAST(y AS VARCHAR) END AS label, sum(l_extendedprice) AS p,
               sum(l_tax) AS x, count(*) AS n FROM (SELECT year(l_shipdate) AS y, * FROM lineitem) GROUP BY ROLLUP (y))""",
)
def overview_rollup(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("year", F.year("l_shipdate"))
    out = stats.cost_overview(rows, "year", ["l_extendedprice", "l_tax"])
    return rounded(out.withColumn("hours", F.col("hours").cast("double")), 4, l_extendedprice_total=2, l_tax_total=2, cost_total=2)


@query(
    "burden",
    f"""SELECT year, round(p, 6) AS o_totalprice_per_meter, n AS periods, n * 0.5::DOUBLE AS hours, round(p, 6) AS per_meter_total,
          round(p / n, 9) AS per_meter_per_period, round(p / (n * 0.5), 9) AS per_meter_per_hour
        FROM (SELECT {YEAR}, sum(o_totalprice) / 29000000.0 AS p, count(*) AS n FROM orders GROUP BY 1)""",
)
def burden(t: Tables) -> DataFrame:
    out = stats.burden(yearly(t), "year", ["o_totalprice"], 29_000_000.0)
    return rounded(out, 6, per_meter_per_period=9, per_meter_per_hour=9)


@query(
    "inertia_yearly",
    f"""WITH q AS (SELECT {YEAR}, min(o_totalprice) AS lo, quantile_cont(o_totalprice, 0.5) AS mid, max(o_totalprice) AS hi
          FROM orders GROUP BY 1)
        SELECT year, lo AS min_gvas, round(mid, 6) AS median_gvas, hi AS max_gvas, round(mid * 1000, 3) AS median_mws,
          round(mid * 1000 * 2 / 50, 3) AS median_mw_at_1hz_s, round(mid * 1000 * 2 / 50 / 60000 * 100, 4) AS median_pct_capacity FROM q""",
)
def inertia_yearly(t: Tables) -> DataFrame:
    per = stats.describe(yearly(t), F.col("o_totalprice"), ["year"])
    units = physics.inertia_units(F.col("q50"))
    out = per.select(
        "year",
        F.col("min").alias("min_gvas"),
        F.col("q50").alias("median_gvas"),
        F.col("max").alias("max_gvas"),
        *[c.alias(f"median_{n}") for n, c in units.items()],
    )
    return rounded(out, 6, median_mws=3, median_mw_at_1hz_s=3, median_pct_capacity=4)


@query(
    "inertia_units",
    """SELECT event_id, value AS gvas, round(value * 1000, 4) AS mws, round(value * 1000 * 2 / 50, 4) AS mw_at_1hz_s,
         round(value * 1000 * 2 / 50 / 60000 * 100, 6) AS pct_capacity FROM events""",
)
def inertia_units(t: Tables) -> DataFrame:
    units = physics.inertia_units(F.col("value"))
    out = t.events.select("event_id", F.col("value").alias("gvas"), *[c.alias(n) for n, c in units.items()])
    return rounded(out, 4, pct_capacity=6)


@query(
    "avg_gap",
    """SELECT l_returnflag, round(avg(l_extendedprice - l_quantity), 4) AS gap FROM lineitem GROUP BY 1""",
)
def avg_gap(t: Tables) -> DataFrame:
    gap = F.avg(F.col("l_extendedprice") - F.col("l_quantity")).alias("gap")
    return rounded(t.lineitem.groupBy("l_returnflag").agg(gap), 4)


COST_SQL = "(SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_tax AS cost FROM lineitem)"


def costs(t: Tables) -> DataFrame:
    return t.lineitem.select(F.year("l_shipdate").alias("year"), F.col("l_tax").alias("cost"))


@query(
    "cost_summary",
    f"""SELECT year, count(*) AS days, count(*) FILTER (WHERE cost = 0) AS zero_days, round(avg(cost), 6) AS avg, min(cost) AS min, max(cost) AS max,
          count(*) FILTER (WHERE cost > 0) AS nonzero_days, round(coalesce(avg(cost) FILTER (WHERE cost > 0), 0), 6) AS nonzero_avg,
          round(sum(cost), 4) AS total FROM {COST_SQL} GROUP BY 1""",
)
def cost_summary(t: Tables) -> DataFrame:
    return rounded(stats.cost_summary(costs(t), ["year"], "cost"), 6, total=4)


@query(
    "monthly_five",
    f"""SELECT {YEAR}, CAST(month(o_orderdate) AS INTEGER) AS month, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS min,
          max(o_totalprice) AS max, round(sum(o_totalprice), 2) AS sum, count(o_totalprice) AS count FROM orders GROUP BY 1, 2""",
)
def monthly_five(t: Tables) -> DataFrame:
    rows = yearly(t).withColumn("month", F.month("o_orderdate"))
    return rounded(stats.five(rows, ["year", "month"], "o_totalprice"), 4, sum=2)


@query(
    "zero_pct",
    f"SELECT year, round(100.0 * avg(CAST(cost = 0 AS INTEGER)), 6) AS zero_pct FROM {COST_SQL} GROUP BY 1",
)
def zero_pct(t: Tables) -> DataFrame:
    return rounded(stats.zero_share(costs(t), ["year"], "cost"))


@query(
    "family_totals",
    f"""WITH mix AS ({MIX_SQL}) SELECT date_trunc('day', hour) AS day,
          round(coalesce(sum(click),0) + coalesce(sum(error),0) + coalesce(sum(purchase),0), 4) AS source_mwh,
          round(coalesce(sum(signup),0) + coalesce(sum(view),0), 4) AS link_mwh FROM mix GROUP BY 1""",
)
def family_totals(t: Tables) -> DataFrame:
    day = F.date_trunc("day", "hour").cast("timestamp_ntz").alias("day")
    sums = stats.totals(t.mix().select("*", day), ["day"], KINDS)
    source = F.col("click_total") + F.col("error_total") + F.col("purchase_total")
    link = F.col("signup_total") + F.col("view_total")
    return rounded(sums.select("day", source.alias("source_mwh"), link.alias("link_mwh")), 4)


@query(
    "energy_summary",
    f"""WITH mix AS (SELECT date_trunc('day', hour) AS day, * FROM ({MIX_SQL})),
        d AS (SELECT day, (epoch_us(hour) - epoch_us(lag(hour) OVER (PARTITION BY day ORDER BY hour))) / 1e6 AS dt FROM mix),
        m AS (SELECT day, dt FROM (SELECT day, dt, row_number() OVER (PARTITION BY day ORDER BY count(*) DESC, dt) AS rn FROM d WHERE dt > 0 GROUP BY day, dt) WHERE rn = 1),
        s AS (SELECT day, coalesce(avg(click),0) + coalesce(avg(error),0) AS src, coalesce(avg(signup),0) + coalesce(avg(view),0) AS lnk,
                coalesce(avg(purchase), 0) AS dem, count(*) AS n FROM mix GROUP BY day)
        SELECT day, n AS rows, dt AS step_s, round(src / 1000, 9) AS generation_gw, round(src * n * dt / 3600 / 1e6, 12) AS generation_twh,
          round(lnk / 1000, 9) AS imports_gw, round(lnk * n * dt / 3600 / 1e6, 12) AS imports_twh,
          round(dem / 1000, 9) AS demand_gw, round(dem * n * dt / 3600 / 1e6, 12) AS demand_twh FROM s LEFT JOIN m USING (day)""",
)
def energy_summary(t: Tables) -> DataFrame:
    mix = t.mix().withColumn("day", F.date_trunc("day", "hour").cast("timestamp_ntz"))
    families = {"generation": KINDS[:2], "imports": KINDS[3:], "demand": KINDS[2:3]}
    out = stats.energy_summary(mix, "hour", families, "day")
    return rounded(out, 9, **{f"{f}_twh": 12 for f in families})


def _describe_sql(v: str) -> str:
    return f"""count({v}) AS count, round(avg({v}), 6) AS mean, round(stddev_samp({v}), 6) AS std, round(min({v}), 6) AS min,
      round(quantile_cont({v}, 0.25), 6) AS q25, round(quantile_cont({v}, 0.5), 6) AS q50, round(quantile_cont({v}, 0.75), 6) AS q75,
      round(max({v}), 6) AS max"""


@query(
    "describe_ratio",
    f"""SELECT 'price' AS series, {_describe_sql("l_extendedprice / 1000.0")} FROM lineitem
        UNION ALL SELECT 'ratio', {_describe_sql("CASE WHEN l_tax <> 0 THEN l_discount / l_tax END")} FROM lineitem""",
)
def describe_ratio(t: Tables) -> DataFrame:
    price = stats.describe(t.lineitem, F.col("l_extendedprice") / 1000.0).withColumn("series", F.lit("price"))
    ratio = stats.describe(t.lineitem, stats.guarded_ratio("l_discount", "l_tax")).withColumn("series", F.lit("ratio"))
    return rounded(price.unionByName(ratio))


@query("pearson", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS corr FROM lineitem")
def pearson(t: Tables) -> DataFrame:
    return rounded(t.lineitem.agg(F.corr("l_quantity", "l_extendedprice").alias("corr")))


@query(
    "corr_rank",
    """WITH c AS (SELECT unnest([{'f': 'l_quantity', 'c': corr(l_quantity, l_extendedprice)},
         {'f': 'l_discount', 'c': corr(l_discount, l_extendedprice)}, {'f': 'l_tax', 'c': corr(l_tax, l_extendedprice)},
         {'f': 'l_linenumber', 'c': corr(l_linenumber, l_extendedprice)}]) AS p FROM lineitem)
       SELECT p.f AS feature, round(p.c, 6) AS corr, round(abs(p.c), 6) AS abs_corr FROM c ORDER BY abs(p.c) DESC LIMIT 3""",
)
def corr_rank(t: Tables) -> DataFrame:
    names = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    return rounded(stats.correlation_rank(t.lineitem, "l_extendedprice", names, 3))


@query(
    "width_bins",
    """WITH e AS (SELECT min(l_quantity) AS lo, (max(l_quantity) - min(l_quantity)) / 20 AS w FROM lineitem),
       b AS (SELECT CAST(greatest(1, least(20, ceil((l_quantity - lo) / w))) AS INTEGER) AS bin, l_extendedprice AS y, l_quantity AS x FROM lineitem, e)
       SELECT round(avg(x), 4) AS x_mean, min(x) AS x_min, max(x) AS x_max, CAST(i AS INTEGER) AS bin, count(y) AS count, round(avg(y), 4) AS mean, round(stddev_samp(y), 4) AS std, min(y) AS min, max(y) AS max
       FROM range(1, 21) g(i) LEFT JOIN b ON b.bin = i GROUP BY i""",
)
def width_bins(t: Tables) -> DataFrame:
    return rounded(stats.width_bins(t.lineitem, "l_quantity", "l_extendedprice"), 4)


@query(
    "quantile_bins",
    """WITH q AS (SELECT quantile_cont(l_extendedprice, [0.2, 0.4, 0.6, 0.8]) AS e FROM lineitem),
       b AS (SELECT 1 + CAST(l_extendedprice > e[1] AS INTEGER) + CAST(l_extendedprice > e[2] AS INTEGER)
               + CAST(l_extendedprice > e[3] AS INTEGER) + CAST(l_extendedprice > e[4] AS INTEGER) AS bin, l_quantity AS y FROM lineitem, q)
       SELECT bin, count(*) AS window_count, round(avg(y), 6) AS target_mean, round(quantile_cont(y, 0.5), 6) AS target_median,
         max(y) AS target_max FROM b GROUP BY 1""",
)
def quantile_bins(t: Tables) -> DataFrame:
    return rounded(stats.quantile_bins(t.lineitem, "l_extendedprice", "l_quantity"))


@query(
    "hist2d",
    """WITH e AS (SELECT min(l_quantity) AS x0, (max(l_quantity) - min(l_quantity)) / 50 AS wx, min(l_extendedprice) AS y0,
                   (max(l_extendedprice) - min(l_extendedprice)) / 50 AS wy FROM lineitem)
       SELECT CAST(least(49, floor((l_quantity - x0) / wx)) AS INTEGER) AS x_bin,
         CAST(least(49, floor((l_extendedprice - y0) / wy)) AS INTEGER) AS y_bin, count(*) AS count FROM lineitem, e GROUP BY 1, 2""",
)
def hist2d(t: Tables) -> DataFrame:
    return stats.histogram2d(t.lineitem, "l_quantity", "l_extendedprice")


@query(
    "quad_fit",
    """WITH b AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem),
       z AS (SELECT (l_quantity - m) / s AS z, l_extendedprice AS y FROM lineitem, b),
       p AS (SELECT count(*) AS s0, sum(z) AS s1, sum(z*z) AS s2, sum(z*z*z) AS s3, sum(z*z*z*z) AS s4, sum(y) AS t0, sum(y*z) AS t1,
               sum(y*z*z) AS t2 FROM z),
       d AS (SELECT *, s0*(s2*s4-s3*s3) - s1*(s1*s4-s3*s2) + s2*(s1*s3-s2*s2) AS det FROM p),
       c AS (SELECT (t0*(s2*s4-s3*s3) - s1*(t1*s4-s3*t2) + s2*(t1*s3-s2*t2)) / det AS c0,
                    (s0*(t1*s4-t2*s3) - t0*(s1*s4-s3*s2) + s2*(s1*t2-t1*s2)) / det AS c1,
                    (s0*(s2*t2-s3*t1) - s1*(s1*t2-t1*s2) + t0*(s1*s3-s2*s2)) / det AS c2 FROM d)
       SELECT round(lo + i * (hi - lo) / 99, 6) AS x, round(c0 + c1 * ((lo + i * (hi - lo) / 99 - m) / s)
         + c2 * ((lo + i * (hi - lo) / 99 - m) / s) * ((lo + i * (hi - lo) / 99 - m) / s), 3) AS fit FROM range(100) g(i), b, c""",
)
def quad_fit(t: Tables) -> DataFrame:
    return rounded(stats.quadratic_fit(t.lineitem, "l_quantity", "l_extendedprice"), 6, fit=3)


@query(
    "calibration",
    """SELECT count(*) AS points, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
         round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2,
         round(greatest(0, regr_intercept(l_extendedprice, l_quantity) + 25 * regr_slope(l_extendedprice, l_quantity)), 4) AS calibrated FROM lineitem""",
)
def calibration(t: Tables) -> DataFrame:
    line = stats.calibration(t.lineitem, "l_quantity", "l_extendedprice")
    at = stats.calibrated(F.lit(25.0), F.col("slope"), F.col("intercept"))
    return rounded(line.withColumn("calibrated", at), 4, r2=6)


@query(
    "resample",
    """WITH b AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS bucket, avg(value) AS m, sum(value) AS s FROM events GROUP BY 1),
       g AS (SELECT unnest(generate_series((SELECT min(bucket) FROM b), (SELECT max(bucket) FROM b), INTERVAL 5 MINUTE)) AS bucket)
       SELECT bucket, round(m, 6) AS value_mean, round(coalesce(s, 0), 4) AS value_sum FROM g LEFT JOIN b USING (bucket)""",
)
def resampled(t: Tables) -> DataFrame:
    out = resample.resample(t.signal(), "ts", 300, ["value"], ["value"])
    return rounded(out.withColumn("bucket", F.col("bucket").cast("timestamp_ntz")), 6, value_sum=4)


TARGETS_SQL = """WITH d AS (SELECT date_trunc('hour', ts) AS bucket, value,
     abs(value - lag(value) OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id)) AS diff FROM events)
   SELECT bucket, avg(value) AS freq_mean, stddev_samp(value) AS freq_std, min(value) AS freq_min, max(value) AS freq_max,
     count(value) AS freq_count, avg(abs(value - 50)) AS abs_dev_mean, avg(CAST(value < 5 OR value > 120 AS INTEGER)) AS outside_share,
     CASE WHEN count(*) > 2 THEN quantile_cont(diff, 0.95) END AS rocof_abs_p95, CASE WHEN count(*) > 1 THEN max(diff) END AS rocof_abs_max
   FROM d GROUP BY 1"""


def hourly_targets(t: Tables) -> DataFrame:
    out = resample.bucket_targets(t.signal(), "ts", "value", 3600, 50.0, 5.0, 120.0, TIE)
    return out.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query(
    "bucket_targets",
    f"""SELECT bucket, round(freq_mean, 6) AS freq_mean, round(freq_std, 6) AS freq_std, freq_min, freq_max, freq_count,
          round(abs_dev_mean, 6) AS abs_dev_mean, round(outside_share, 6) AS outside_share, round(rocof_abs_p95, 6) AS rocof_abs_p95,
          round(rocof_abs_max, 6) AS rocof_abs_max FROM ({TARGETS_SQL})""",
)
def bucket_targets(t: Tables) -> DataFrame:
    return rounded(hourly_targets(t))


@query(
    "instability",
    f"""WITH t AS ({TARGETS_SQL}), m AS (SELECT quantile_cont(freq_std, 0.5) AS a, quantile_cont(abs_dev_mean, 0.5) AS b,
          quantile_cont(outside_share, 0.5) AS c FROM t),
        s AS (SELECT quantile_cont(abs(freq_std - a), 0.5) AS sa, quantile_cont(abs(abs_dev_mean - b), 0.5) AS sb,
          quantile_cont(abs(outside_share - c), 0.5) AS sc FROM t, m)
        SELECT bucket, round(0.5 * (freq_std - a) / (sa + 1e-9) + 0.3 * (abs_dev_mean - b) / (sb + 1e-9)
          + 0.2 * (outside_share - c) / (sc + 1e-9), 5) AS instability_score FROM t, m, s""",
)
def instability(t: Tables) -> DataFrame:
    weights = {"freq_std": 0.5, "abs_dev_mean": 0.3, "outside_share": 0.2}
    scored = resample.instability(hourly_targets(t), weights)
    return rounded(scored.select("bucket", "instability_score"), 5)


WIDE_SQL = """SELECT event_id, value AS a, CASE WHEN event_type = 'view' THEN user_id END AS b,
   CASE WHEN event_id % 100 = 0 THEN value END AS c, CASE WHEN event_id % 10 <> 0 THEN value * 2 END AS d, 1.0::DOUBLE AS e FROM events"""


def wide(t: Tables) -> DataFrame:
    key = F.col("event_id")
    return t.events.select(
        "event_id",
        F.col("value").alias("a"),
        F.when(F.col("event_type") == "view", F.col("user_id")).alias("b"),
        F.when(key % 100 == 0, F.col("value")).alias("c"),
        F.when(key % 10 != 0, F.col("value") * 2).alias("d"),
        F.lit(1.0).alias("e"),
    )


@query("drop_sparse", f"SELECT event_id, a, b, d, e FROM ({WIDE_SQL})")
def drop_sparse(t: Tables) -> DataFrame:
    return stats.drop_sparse(wide(t), 0.98)


@query(
    "select_targets",
    f"""WITH w AS ({WIDE_SQL}), n AS (SELECT count(*) AS n, count(a) AS a, count(d) AS d, count(*) FILTER (WHERE a IS NOT NULL AND d IS NOT NULL) AS j FROM w)
        SELECT 1 AS rank, 'a' AS "column", a AS known, round(a / n, 6) AS ratio, j AS joint_rows FROM n
        UNION ALL SELECT 2, 'd', d, round(d / n, 6), j FROM n""",
)
def select_targets(t: Tables) -> DataFrame:
    rows = wide(t)
    half = int(rows.count() * 0.5)
    return rounded(stats.select_targets(rows, ["a", "b", "c", "d", "e"], 0.15, 24, half))


@query(
    "select_features",
    f"""WITH w AS ({WIDE_SQL}) SELECT * FROM (SELECT 'a' AS "column", count(a) AS known, round(count(a) / count(*), 6) AS ratio FROM w
        UNION ALL SELECT 'b', count(b), round(count(b) / count(*), 6) FROM w UNION ALL SELECT 'd', count(d), round(count(d) / count(*), 6) FROM w
        UNION ALL SELECT 'e', count(e), round(count(e) / count(*), 6) FROM w) WHERE ratio >= 0.1""",
)
def select_features(t: Tables) -> DataFrame:
    return rounded(stats.select_features(wide(t), ["a", "b", "c", "d", "e"], 0.1))


@query(
    "file_totals",
    """WITH f AS (SELECT 'f-' || strftime(o_orderdate, '%Y-%m') AS file, count(*) AS rows, 6 AS columns FROM orders GROUP BY 1),
       p AS (SELECT *, rows * columns AS datapoints FROM f)
       SELECT file, rows, columns, datapoints, 'ok' AS status, row_number() OVER w AS rank, CAST(sum(datapoints) OVER w AS BIGINT) AS running
       FROM p WINDOW w AS (ORDER BY datapoints DESC, file)""",
)
def file_totals(t: Tables) -> DataFrame:
    name = F.concat(F.lit("f-"), F.date_format("o_orderdate", "yyyy-MM"))
    width = len(t.orders.columns)
    files = t.orders.groupBy(name.alias("file")).agg(F.count(F.lit(1)).alias("rows"), F.lit(width).alias("columns"))
    return stats.file_totals(files)


@query(
    "cadence",
    """WITH d AS (SELECT (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) / 1e6 AS step FROM events),
       m AS (SELECT quantile_cont(step, 0.5) AS m FROM d WHERE step > 0)
       SELECT round(m, 6) AS median_s, CASE WHEN m IS NULL THEN 1800 WHEN m <= 2700 THEN 1800 WHEN m <= 5400 THEN 3600
         WHEN m <= 21600 THEN 21600 WHEN m <= 43200 THEN 43200 ELSE 86400 END AS period_s FROM m""",
)
def cadence(t: Tables) -> DataFrame:
    return rounded(stats.cadence(t.events, "user_id", "ts"))


@query(
    "reg_metrics",
    """WITH p AS (SELECT event_type, value AS y, lag(value) OVER (ORDER BY ts, event_id) AS g FROM events)
       SELECT event_type, count(y - g) AS rows, round(sqrt(avg((y-g)*(y-g))), 6) AS rmse, round(avg(abs(y-g)), 6) AS mae,
         round(1 - sum((y-g)*(y-g)) / (var_pop(y) * count(y)), 6) AS r2 FROM p WHERE g IS NOT NULL GROUP BY 1""",
)
def reg_metrics(t: Tables) -> DataFrame:
    rows = windows.lag_features(t.events.select("event_type", "ts", "event_id", "value"), "ts", "value", (1,), 1, TIE)
    return rounded(stats.regression_metrics(rows, "value", "lag_1", ["event_type"]))


@query("bounds", "SELECT min(ts) AS first_ts, max(ts) AS last_ts FROM events")
def bounds(t: Tables) -> DataFrame:
    return stats.bounds(t.events, "ts")


@query(
    "chart_series",
    f"""WITH mix AS ({MIX_SQL}) SELECT date_trunc('day', hour) AS day, round(sum(click), 4) AS click_sum, round(avg(error) / 1000.0, 9) AS error_gw,
          round(100.0 * coalesce(sum(purchase), 0) / sum(coalesce(click,0)+coalesce(error,0)+coalesce(purchase,0)+coalesce(signup,0)+coalesce(view,0)), 6)
            AS purchase_pct FROM mix GROUP BY 1""",
)
def chart_series(t: Tables) -> DataFrame:
    whole = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in KINDS), F.lit(0.0))
    daily_mix = t.mix().withColumn("whole", whole)
    grid = resample.resample(daily_mix, "hour", 86400, ["error"], ["click", "purchase", "whole"], gaps=False)
    out = grid.select(
        F.col("bucket").cast("timestamp_ntz").alias("day"),
        F.col("click_sum"),
        (F.col("error_mean") / 1000.0).alias("error_gw"),
        (100.0 * F.coalesce("purchase_sum", F.lit(0.0)) / F.col("whole_sum")).alias("purchase_pct"),
    )
    return rounded(out, 6, click_sum=4, error_gw=9)


