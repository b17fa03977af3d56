"""Grid physics on the provided tables: event types stand in for fuels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import frames, physics
from gridloom.functions.clean import family_sum
from gridloom.operators import asof
from gridloom.operators.asof import Source
from gridloom.plans.alignment import replay_output, replay_table, rocof_report
from gridloom.queries.aggregates import YEAR, yearly
from gridloom.queries.ordering import ROCOF_SQL
from gridloom.queries.registry import MIX_SQL, Tables, query, rounded

FUELS = {"GAS": "click", "COAL": "error", "NUCLEAR": "purchase", "WIND": "signup", "SOLAR": "view"}


@query(
    "swing_equation",
    """SELECT event_id, round(200.0 * 1000 * 2 / 50 * value / 1000, 6) AS dp_mw,
         round(200.0 * 1000 * 2 / 50 * value / 1000 * 50 / (2 * 0.125) / 1000, 6) AS required_gvas FROM events""",
)
def swing_equation(t: Tables) -> DataFrame:
    dp = physics.power_imbalance(F.lit(200.0), F.col("value") / 1000.0)
    need = physics.required_inertia(dp, F.lit(0.125))
    return rounded(t.events.select("event_id", dp.alias("dp_mw"), need.alias("required_gvas")))


def h_sum(level: int) -> str:
    table = physics.H_SECONDS
    return "(" + " + ".join(f"greatest(coalesce({c}, 0), 0) * {table[f][level]}" for f, c in FUELS.items()) + ") / 1000.0"


WHOLE = "coalesce(click,0)+coalesce(error,0)+coalesce(purchase,0)+coalesce(signup,0)+coalesce(view,0)"


@query(
    "inertia_estimate",
    f"""WITH mix AS ({MIX_SQL}) SELECT hour, round({h_sum(0)}, 6) AS inertia_low_gvas, round({h_sum(1)}, 6) AS inertia_best_gvas,
          round({h_sum(2)}, 6) AS inertia_high_gvas, round(coalesce(signup, 0) + coalesce(view, 0), 4) AS renewables_mw,
          round({WHOLE}, 4) AS modelled_mw, round(CASE WHEN click > 0 THEN ({WHOLE}) / click END, 6) AS modelled_share FROM mix""",
)
def inertia_estimate(t: Tables) -> DataFrame:
    parts = physics.inertia_estimate(FUELS)
    share = physics.modelled_share(parts["modelled_mw"], F.col("click"))
    out = t.mix().select("hour", *[c.alias(n) for n, c in parts.items()], share.alias("modelled_share"))
    return rounded(out, 6, renewables_mw=4, modelled_mw=4)


@query(
    "inertia_vs_reported",
    f"""WITH mix AS ({MIX_SQL}), e AS (SELECT hour, {h_sum(1)} AS best FROM mix),
        r AS (SELECT ts, value AS outturn, value / 2 AS market FROM events WHERE event_type = 'error'),
        b AS (SELECT e.*, r.ts AS bts, outturn AS bo, market AS bm FROM e ASOF LEFT JOIN r ON e.hour >= r.ts),
        a AS (SELECT e.hour, r.ts AS ats, outturn AS ao, market AS am FROM e ASOF LEFT JOIN r ON e.hour <= r.ts),
        j AS (SELECT *, epoch_us(hour) - epoch_us(bts) AS bd, epoch_us(ats) - epoch_us(hour) AS ad FROM b JOIN a USING (hour)),
        p AS (SELECT *, (ad IS NULL OR coalesce(bd <= ad, FALSE)) AS back FROM j),
        m AS (SELECT hour, best, CASE WHEN back THEN bo ELSE ao END AS o, CASE WHEN back THEN bm ELSE am END AS k,
                CASE WHEN back THEN bd ELSE ad END AS d FROM p)
        SELECT hour, round(best, 6) AS inertia_best_gvas, round(CASE WHEN o > 0 THEN best / o END, 6) AS best_vs_reported_ratio,
          round(d / 1e6, 6) AS reported_offset_s, round(o - k, 6) AS reported_gap_gvas FROM m WHERE d <= 1200000000""",
)
def inertia_vs_reported(t: Tables) -> DataFrame:
    best = physics.inertia_estimate(FUELS)["inertia_best_gvas"]
    estimate = t.mix().select("hour", best.alias("inertia_best_gvas"))
    reported = t.kind("error").select(
        "ts", "event_id", F.col("value").alias("outturn"), (F.col("value") / 2).alias("market")
    )
    joined = asof.asof_join(
        estimate, reported, "hour", "ts", ["outturn", "market"], prefix="r_", tolerance=1200.0, seq="event_id", unique_left=True
    ).where("r_ts is not null")
    figures = physics.against_reported(
        F.col("inertia_best_gvas"), F.col("r_outturn"), F.col("r_market"), F.col("r_offset_s")
    )
    return rounded(joined.select("hour", "inertia_best_gvas", *[c.alias(n) for n, c in figures.items()]))


@query(
    "event_class",
    """SELECT o_orderkey, CASE WHEN o_totalprice / 200 < 500 THEN 'Balancing / minor fluctuation'
         WHEN o_totalprice / 200 < 1500 THEN 'Medium event (possible gen trip or wind block)'
         ELSE 'Major event (likely generator or interconnector loss)' END AS event_class FROM orders""",
)
def event_class(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", physics.event_class(F.col("o_totalprice") / 200).alias("event_class"))


FRAME_SQL = f"""SELECT hour, 49.0 + coalesce(click, 0) / 500.0 AS f_end, (coalesce(error, 0) - 200) / 1000.0 AS rate, {WHOLE} AS generation,
    coalesce(purchase, 0) * 5 AS demand, click, error, purchase FROM mix"""


def frame(t: Tables) -> DataFrame:
    whole = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in FUELS.values()), F.lit(0.0))
    return t.mix().select(
        "hour",
        (49.0 + F.coalesce("click", F.lit(0.0)) / 500.0).alias("f_end"),
        ((F.coalesce("error", F.lit(0.0)) - 200.0) / 1000.0).alias("rate"),
        whole.alias("generation"),
        (F.coalesce("purchase", F.lit(0.0)) * 5).alias("demand"),
        "click",
        "error",
        "purchase",
    )


RATE_LABEL = "CASE WHEN abs({r}) < 0.005 THEN 'STABLE' WHEN abs({r}) < 0.05 THEN 'SHIVERING' WHEN abs({r}) < 0.75 THEN 'STRESSED' ELSE 'LFDD ARMED' END"
FREQ_LABEL = """CASE WHEN f_end < 49.1 OR f_end > 50.9 THEN 'LFDD ARMED' WHEN f_end < 49.5 OR f_end > 50.5 THEN 'OUTSIDE STAT LIMIT'
   WHEN f_end BETWEEN 49.95 AND 50.05 THEN 'STABLE' ELSE 'STRESSED' END"""
FLOW_LABEL = "CASE WHEN generation - demand > 500 THEN 'EXPORTING' WHEN generation - demand < -500 THEN 'IMPORTING' ELSE 'BALANCED' END"


@query(
    "replay_metrics",
    f"""WITH mix AS ({MIX_SQL}), f AS ({FRAME_SQL}), q AS (SELECT *, CASE WHEN abs(rate) < 0.005 THEN 0 ELSE rate END AS calm,
          generation * f_end / 50 AS inst, (coalesce(click,0) * 5 + coalesce(error,0) * 6 + coalesce(purchase,0) * 6) / 1000.0 AS nominal FROM f)
        SELECT hour, round(f_end, 6) AS frequency_hz, round(calm, 6) AS rocof_hz_per_s, round(f_end * 60, 6) AS rpm,
          round(generation - demand, 4) AS delta_mw, {FLOW_LABEL} AS flow, {FREQ_LABEL} AS frequency_status,
          round(inst, 4) AS instant_generation_mw, round(inst - demand, 4) AS instant_balance_mw,
          round(generation * 3183 / 1e6, 9) AS torque_demand_mnm,
          round(generation * 3183 * greatest(0.2, least(1.8, 1 - calm / 0.7)) / 1e6, 9) AS torque_actual_mnm,
          round(nominal, 6) AS nominal_inertia_gva, round(nominal * (f_end * 60 / 3000) * (f_end * 60 / 3000), 6) AS instant_inertia_gva,
          round(nominal * (f_end * 60 / 3000) * (f_end * 60 / 3000) - 150, 6) AS inertia_delta_gva,
          round(CASE WHEN demand > 0 THEN inst / demand * 100 ELSE 0 END, 4) AS demand_coverage_pct,
          {RATE_LABEL.format(r="calm")} AS system_status FROM q""",
)
def replay_metrics(t: Tables) -> DataFrame:
    fuels = {f: F.col(c) for f, c in FUELS.items() if c in ("click", "error", "purchase")}
    parts = physics.replay_metrics(
        F.lit(None).cast("double"), F.col("f_end"), F.col("rate"), F.col("generation"), F.col("demand"), fuels
    )
    out = frame(t).select("hour", *[c.alias(n) for n, c in parts.items()])
    four = {c: 4 for c in ("delta_mw", "instant_generation_mw", "instant_balance_mw", "demand_coverage_pct")}
    return rounded(out, 6, torque_demand_mnm=9, torque_actual_mnm=9, **four)


@query(
    "status_labels",
    f"""WITH mix AS ({MIX_SQL}), f AS ({FRAME_SQL}) SELECT hour, {RATE_LABEL.format(r="rate")} AS rate, {FREQ_LABEL} AS frequency, {FLOW_LABEL} AS flow,
          CASE WHEN demand - generation > 500 THEN 'INSTANT EXPORT' WHEN demand - generation < -500 THEN 'INSTANT IMPORT' ELSE 'BALANCED' END AS instant,
          CASE WHEN click IS NULL THEN 'UNKNOWN' WHEN abs(click - 200) <= 10 THEN 'IDEAL' WHEN click - 200 < 0 THEN 'LIGHT' ELSE 'HEAVY' END AS inertia FROM f""",
)
def status_labels(t: Tables) -> DataFrame:
    return frame(t).select(
        "hour",
        physics.rate_label(F.col("rate")).alias("rate"),
        physics.frequency_label(F.col("f_end")).alias("frequency"),
        physics.flow_label(F.col("generation"), F.col("demand")).alias("flow"),
        physics.instant_label(F.col("demand") - F.col("generation")).alias("instant"),
        physics.inertia_label(F.col("click") - 200.0).alias("inertia"),
    )


@query(
    "stability_regime",
    f"""WITH mix AS ({MIX_SQL}), g AS (SELECT hour, click, {WHOLE} AS generation, (coalesce(click,0) + coalesce(error,0)) * 3 AS fossil,
          (coalesce(signup,0) + coalesce(view,0)) * 3 AS renewable, coalesce(purchase, 0) AS demand FROM mix)
        SELECT hour, CASE WHEN abs(fossil - renewable) <= 500 THEN 'Hybrid Anchored' WHEN fossil > renewable THEN 'Intrinsic' ELSE 'Digital Mediation' END AS mode,
          CAST(coalesce(renewable > fossil AND generation - demand > 500 AND click / 600.0 * 100 < 15, FALSE) AS INTEGER) AS gas_margin FROM g""",
)
def stability_regime(t: Tables) -> DataFrame:
    fossil, renewable = family_sum(["click", "error"]) * 3, family_sum(["signup", "view"]) * 3
    exporting = physics.flow_label(family_sum(list(FUELS.values())), F.col("purchase")) == "EXPORTING"
    margin = physics.gas_margin(fossil, renewable, exporting, F.col("click"), 600.0)
    return t.mix().select(
        "hour", physics.stability_mode(fossil, renewable).alias("mode"), margin.cast("int").alias("gas_margin")
    )


@query(
    "utilisation_pct",
    f"""WITH mix AS ({MIX_SQL}), m AS (SELECT max(click) AS c, max(error) AS e FROM mix)
        SELECT hour, round(coalesce(click, 0) / c * 100, 6) AS click_pct, round(coalesce(error, 0) / e * 100, 6) AS error_pct,
          round(least(100, coalesce(purchase, 0) / 500 * 100), 6) AS purchase_pct,
          round(coalesce(signup, 0) / greatest(1, coalesce(signup, 0), coalesce(view, 0)) * 100, 6) AS signup_pct,
          round(coalesce(view, 0) / greatest(1, coalesce(signup, 0), coalesce(view, 0)) * 100, 6) AS view_pct FROM mix, m""",
)
def utilisation_pct(t: Tables) -> DataFrame:
    out = frames.utilisation(t.mix(), ["click", "error", "purchase"], {"purchase": 500.0})
    out = out.withColumns(frames.link_utilisation(["signup", "view"]))
    return rounded(out.select("hour", *[f"{c}_pct" for c in FUELS.values()]))


@query("co2_rate", f"WITH mix AS ({MIX_SQL}) SELECT hour, round(click * 0.38, 6) AS co2_t_h FROM mix")
def co2_rate(t: Tables) -> DataFrame:
    return rounded(t.mix().select("hour", physics.co2_rate(F.col("click")).alias("co2_t_h")))


@query(
    "shortfall",
    f"""SELECT year, round((500000.0 - lo) / 500000 * 60000, 6) AS shortfall, round((500000.0 - hi) / 500000 * 60000, 6) AS surplus
        FROM (SELECT {YEAR}, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1)""",
)
def shortfall(t: Tables) -> DataFrame:
    found = yearly(t).groupBy("year").agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    return rounded(
        found.select(
            "year",
            physics.shortfall(F.col("lo"), 60_000.0, 500_000.0).alias("shortfall"),
            physics.shortfall(F.col("hi"), 60_000.0, 500_000.0).alias("surplus"),
        )
    )


@query(
    "frame_defaults",
    f"""WITH mix AS ({MIX_SQL}) SELECT hour, coalesce(click, error) AS click, error, coalesce(purchase, 0) AS purchase, signup,
          coalesce(view, signup) AS view FROM mix""",
)
def frame_defaults(t: Tables) -> DataFrame:
    columns = frames.frame_defaults("click", "error", "purchase", "signup", "view", [])
    return t.mix().withColumns(columns)


@query(
    "fuel_unpivot",
    f"""WITH mix AS ({MIX_SQL}), n AS (SELECT hour, coalesce(click,0) AS click, coalesce(error,0) AS error, coalesce(purchase,0) AS purchase,
          coalesce(signup,0) AS signup, coalesce(view,0) AS view FROM mix)
        SELECT hour, name, mw FROM n UNPIVOT (mw FOR name IN (click, error, purchase, signup, view))""",
)
def fuel_unpivot(t: Tables) -> DataFrame:
    return frames.breakdown(t.mix(), ["hour"], list(FUELS.values()))


ALIGNED_SQL = f"""WITH s AS (SELECT make_timestamp(epoch_us(sample_start_ts) + dus // 2) AS ts, (f_end_hz - f_start_hz) / (dus / 1e6) AS rate
      FROM ({ROCOF_SQL}) WHERE dus > 0),
   r AS (SELECT ts AS r_ts FROM events WHERE event_type = 'error'),
   b AS (SELECT s.*, r_ts AS bts FROM s ASOF LEFT JOIN r ON s.ts >= r.r_ts),
   j AS (SELECT b.*, r_ts AS ats FROM b ASOF LEFT JOIN r ON b.ts <= r.r_ts),
   m AS (SELECT *, coalesce(least(epoch_us(ts) - epoch_us(bts), epoch_us(ats) - epoch_us(ts)), epoch_us(ts) - epoch_us(bts), epoch_us(ats) - epoch_us(ts)) <= 600000000 AS hit FROM j)
   SELECT count(*) AS rows, count(*) FILTER (WHERE hit) AS matched_rows, round(count(*) FILTER (WHERE hit) / count(*), 6) AS match_rate,
     min(ts) AS time_start, max(ts) AS time_end, round(avg(rate), 6) AS rocof_mean, round(stddev_samp(rate), 6) AS rocof_std,
     round(quantile_cont(abs(rate), 0.95), 6) AS rocof_abs_p95, round(max(abs(rate)), 6) AS rocof_abs_max FROM m"""


@query("rocof_summary", ALIGNED_SQL)
def rocof_summary(t: Tables) -> DataFrame:
    out = rocof_report(t.signal(), t.kind("error"), "ts", "value", "ts", tolerance_s=600.0, tie=["event_id"])
    return rounded(out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("time_start", "time_end")}))


@query(
    "replay_dataset",
    f"""WITH s AS (SELECT make_timestamp(epoch_us(sample_start_ts) + dus // 2) AS ts, f_end_hz FROM ({ROCOF_SQL}) WHERE dus > 0),
        w AS (SELECT * FROM s WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-10' + INTERVAL 5 DAY),
        n AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS row_no, count(*) OVER () AS n FROM w),
        p AS (SELECT DISTINCT (i * ((SELECT count(*) FROM w) - 1)) // 99 AS pos FROM range(100) g(i)),
        r AS (SELECT ts AS r_ts, value FROM events WHERE event_type = 'error'),
        b AS (SELECT n.*, r_ts AS bts, value AS bv FROM n ASOF LEFT JOIN r ON n.ts >= r_ts WHERE row_no IN (SELECT pos FROM p)),
        j AS (SELECT b.*, r_ts AS ats, value AS av FROM b ASOF LEFT JOIN r ON b.ts <= r_ts),
        m AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(bts) <= epoch_us(ats) - epoch_us(ts), ats IS NULL) AS back,
                least(epoch_us(ts) - epoch_us(bts), epoch_us(ats) - epoch_us(ts)) <= 1800000000 AS hit FROM j)
        SELECT row_no, '{{"rocof_timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","f_end_hz":' || CAST(f_end_hz AS VARCHAR)
          || ',"total_generation_mw":' || coalesce(CAST(CASE WHEN hit THEN CASE WHEN back THEN bv ELSE av END END AS VARCHAR), 'null') || '}}' AS frame FROM m""",
)
def replay_dataset(t: Tables) -> DataFrame:
    context = t.kind("error").select("ts", "event_id", F.col("value").alias("GENERATION"))
    table = replay_table(
        t.signal(), "ts", "value", [Source(context, "ts", ["GENERATION"], tolerance=1800.0, seq="event_id")], seq="event_id"
    )
    return replay_output(
        table.drop("ts", "offset_s"), 5 * 86_400, "2024-01-10 00:00:00", 100, ["f_end_hz", "total_generation_mw"]
    )
