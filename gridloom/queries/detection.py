"""Event detection on the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import events
from gridloom.queries.registry import Tables, query, rounded

TIE = ["event_id"]

BREACH_SQL = """WITH c AS (SELECT ts, event_id, value, CASE WHEN value < 5 THEN 'under' WHEN value > 120 THEN 'over' END AS side FROM events),
   f AS (SELECT *, CASE WHEN side IS DISTINCT FROM lag(side) OVER (ORDER BY ts, event_id) THEN 1 ELSE 0 END AS new FROM c),
   g AS (SELECT *, sum(new) OVER (ORDER BY ts, event_id) AS run FROM f),
   w AS (SELECT side AS breach_type, min(ts) AS start, max(ts) AS "end", count(*) AS points, min(value) AS min_hz, max(value) AS max_hz
         FROM g WHERE side IS NOT NULL GROUP BY run, side),
   b AS (SELECT *, (epoch_us("end") - epoch_us(start)) / 1e6 AS duration_s,
           CASE WHEN breach_type = 'under' THEN min_hz ELSE max_hz END AS worst_hz FROM w)"""


def breaches(t: Tables) -> DataFrame:
    return events.breach_windows(t.signal(), low=5.0, high=120.0, tie=TIE)


@query(
    "breach_windows",
    f"""{BREACH_SQL} SELECT breach_type, start, "end", points, min_hz, max_hz, round(duration_s, 6) AS duration_s, worst_hz
        FROM b WHERE duration_s >= 30""",
)
def breach_windows(t: Tables) -> DataFrame:
    return rounded(events.breach_windows(t.signal(), low=5.0, high=120.0, min_duration_s=30.0, tie=TIE))


LOW_SQL = BREACH_SQL.replace("WHEN value > 120 THEN 'over' ", "").replace("value < 5", "value < 10")


@query(
    "lfdd_events",
    f"""{LOW_SQL} SELECT start, "end", points, min_hz, max_hz, round(duration_s, 6) AS duration_s, worst_hz FROM b""",
)
def lfdd_events(t: Tables) -> DataFrame:
    return rounded(events.low_value_events(t.signal(), threshold=10.0, tie=TIE))


@query(
    "longest_events",
    f"""{LOW_SQL} SELECT start, "end", points, min_hz, max_hz, round(duration_s, 6) AS duration_s, worst_hz FROM b
        ORDER BY b.duration_s DESC, start LIMIT 10""",
)
def longest_events(t: Tables) -> DataFrame:
    return rounded(events.longest_events(events.low_value_events(t.signal(), threshold=10.0, tie=TIE)))


@query(
    "event_summary",
    f"""{BREACH_SQL} SELECT count(*) AS events, round(sum(duration_s), 4) AS total_s, round(sum(duration_s) FILTER (WHERE breach_type = 'under'), 4) AS under_s,
          round(sum(duration_s) FILTER (WHERE breach_type = 'over'), 4) AS over_s, round(max(duration_s), 6) AS longest_s,
          count(*) FILTER (WHERE breach_type = 'under') AS under_events, count(*) FILTER (WHERE breach_type = 'over') AS over_events,
          min(min_hz) FILTER (WHERE breach_type = 'under') AS worst_under_hz,
          max(max_hz) FILTER (WHERE breach_type = 'over') AS worst_over_hz FROM b""",
)
def event_summary(t: Tables) -> DataFrame:
    return rounded(events.event_summary(breaches(t)), 6, total_s=4, under_s=4, over_s=4)


EXCURSION_SQL = """WITH s AS (SELECT date_trunc('day', ts) AS period, ts, event_id, value < 20 AS beyond FROM events),
   f AS (SELECT *, CASE WHEN beyond IS DISTINCT FROM lag(beyond) OVER w THEN 1 ELSE 0 END AS new FROM s
         WINDOW w AS (PARTITION BY period ORDER BY ts, event_id)),
   g AS (SELECT *, sum(new) OVER (PARTITION BY period ORDER BY ts, event_id) AS run FROM f),
   r AS (SELECT period, run, beyond, count(*) AS n, min(ts) AS s, max(ts) AS e FROM g GROUP BY 1, 2, 3),
   k AS (SELECT *, sum(CASE WHEN NOT beyond AND n >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY period ORDER BY run) AS grp FROM r),
   h AS (SELECT period, grp, min(s) FILTER (WHERE beyond AND n >= 2) AS start, max(e) AS last_row,
           min(s) FILTER (WHERE NOT beyond AND n >= 3) AS head FROM k GROUP BY 1, 2),
   c AS (SELECT *, lead(head) OVER (PARTITION BY period ORDER BY grp) AS closed_at FROM h),
   x AS (SELECT period, start, coalesce(closed_at, last_row) AS "end", closed_at IS NULL AS open_tail,
           (epoch_us(coalesce(closed_at, last_row)) - epoch_us(start)) // 1000000 AS duration_s FROM c WHERE start IS NOT NULL),
   o AS (SELECT * FROM x WHERE duration_s >= 2)"""


def found(t: Tables) -> DataFrame:
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    return events.excursions(
        t.signal(), low=20.0, mode="under", start_rows=2, end_rows=3, min_duration_s=2, period=day, tie=TIE
    )


@query("excursions", f"""{EXCURSION_SQL} SELECT period, start, "end", open_tail, duration_s FROM o""")
def excursions(t: Tables) -> DataFrame:
    return found(t)


@query(
    "avg_recovery",
    f"""{EXCURSION_SQL}, p AS (SELECT DISTINCT date_trunc('day', ts) AS period FROM events)
        SELECT period, count(duration_s) AS events, CAST(coalesce(sum(duration_s), 0) AS BIGINT) AS total_s, round(coalesce(avg(duration_s), 0), 6) AS avg_s
        FROM p LEFT JOIN o USING (period) GROUP BY 1""",
)
def avg_recovery(t: Tables) -> DataFrame:
    periods = t.events.select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("period")).distinct()
    return rounded(events.average_recovery(found(t), periods))


@query(
    "rocof_clusters",
    """WITH d AS (SELECT ts, event_id, value - lag(value) OVER (ORDER BY ts, event_id) AS jump FROM events),
       h AS (SELECT * FROM d WHERE abs(jump) > 40.125),
       f AS (SELECT *, CASE WHEN coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts, event_id)) > 600000000, TRUE) THEN 1 ELSE 0 END AS new FROM h),
       g AS (SELECT *, sum(new) OVER (ORDER BY ts, event_id) AS c FROM f),
       a AS (SELECT min(ts) AS start, max(ts) AS "end", max(abs(jump)) AS peak, count(*) AS points FROM g GROUP BY c),
       p AS (SELECT *, 200.0 * 1000 * 2 / 50 * peak AS dp FROM a WHERE (epoch_us("end") - epoch_us(start)) / 1e6 + 1 >= 5)
       SELECT start, "end", round(peak, 6) AS peak_rocof, points, 200.0::DOUBLE AS inertia_gvas, round(dp, 4) AS dp_mw, round(dp / 1000, 6) AS dp_gw,
         round(dp * 50 / (2 * 40.125) / 1000, 6) AS required_gvas, round(dp * 50 / (2 * 40.125) / 1000 - 200, 6) AS extra_gvas,
         CASE WHEN dp < 500 THEN 'Balancing / minor fluctuation' WHEN dp < 1500 THEN 'Medium event (possible gen trip or wind block)'
           ELSE 'Major event (likely generator or interconnector loss)' END AS event_class FROM p""",
)
def rocof_clusters(t: Tables) -> DataFrame:
    out = events.rate_clusters(t.signal(), delta=40.125, gap_s=600.0, min_duration_s=5.0, inertia_gvas=200.0, tie=TIE)
    return rounded(out, 6, dp_mw=4)


