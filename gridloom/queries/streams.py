"""Streaming twins on the provided tables: the events laid out as a feed and run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.asof import Source
from gridloom.queries.joining import LEFT, asof_sql, left, right
from gridloom.queries.ordering import ROCOF_SQL
from gridloom.queries.registry import Tables, query, rounded
from gridloom.streaming import detector, feed, monitor, replay


def stamped(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def open_feed(t: Tables, df: DataFrame, close: bool = True) -> DataFrame:
    path = feed.write_feed(df, "ts", close=close)
    return feed.read_feed(t.spark, path, df.schema)


def naive(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


@query(
    "stream_rocof",
    f"""SELECT sample_start_ts, sample_end_ts, f_start_hz, f_end_hz, round(dus / 1e6, 6) AS delta_t_s,
         round((f_end_hz - f_start_hz) / (dus / 1e6), 6) AS rocof_hz_per_s FROM ({ROCOF_SQL}) WHERE dus > 0""",
)
def stream_rocof(t: Tables) -> DataFrame:
    stream = open_feed(t, t.events.select("ts", "value"), close=False)
    out = replay.stream_rocof(stream, "ts", "value").drop("rocof_timestamp", "delta_f_hz")
    return rounded(out)


@query("stream_enrich", asof_sql(LEFT, "SELECT ts AS r_ts, event_id AS r_id, value AS r_value FROM events WHERE event_type = 'error'", "later", 7200))
def stream_enrich(t: Tables) -> DataFrame:
    stream = open_feed(t, left(t), close=False).drop("year", "month")
    static = Source(right(t), "r_ts", ["r_id", "r_value"], "m_", tolerance=7200.0, tie="later", seq="r_id")
    return rounded(replay.stream_enrich(stream, "ts", [static]))


@query("stream_seek", "SELECT ts, event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00'")
def stream_seek(t: Tables) -> DataFrame:
    stream = feed.seek(open_feed(t, t.signal(), close=False), "ts", "2024-01-20 00:00:00")
    return feed.run_to_end(stream.drop("year", "month"), "seek")


@query(
    "stream_tumbling",
    """SELECT bucket, user_id, ts, value FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS bucket, user_id, ts, value,
         row_number() OVER (PARTITION BY time_bucket(INTERVAL 6 HOUR, ts), user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def stream_tumbling(t: Tables) -> DataFrame:
    stream = open_feed(t, stamped(t.events.select("ts", "user_id", "value", "event_id")))
    newest = monitor.latest_per_bucket(stream, "ts", "user_id", ["value"], "6 hours", tie=["event_id"])
    out = feed.run_to_end(newest, "tumbling")
    return naive(out, "bucket", "ts")


@query(
    "stream_sliding",
    """WITH s AS (SELECT time_bucket(INTERVAL 10 MINUTE, ts) - INTERVAL 10 MINUTE * i AS start, value FROM events, range(3) g(i))
       SELECT start, start + INTERVAL 30 MINUTE AS "end", count(*) AS points, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean
       FROM s GROUP BY 1""",
)
def stream_sliding(t: Tables) -> DataFrame:
    stream = open_feed(t, stamped(t.events.select("ts", "value")))
    out = feed.run_to_end(monitor.sliding_stats(stream, "ts", "value", "30 minutes", "10 minutes"), "sliding")
    return rounded(naive(out, "start", "end"))


@query(
    "stream_sessions",
    """WITH j AS (SELECT user_id, ts, event_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS jump FROM events),
       h AS (SELECT * FROM j WHERE jump > 20),
       f AS (SELECT *, CASE WHEN coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) > 86400000000, TRUE) THEN 1 ELSE 0 END AS new FROM h
             WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
       g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS c FROM f)
       SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS points, round(max(jump), 6) AS peak FROM g GROUP BY user_id, c""",
)
def stream_sessions(t: Tables) -> DataFrame:
    """Clusters of jumps per site: of samples that differ by more than 20 from the one before, at most a day apart."""
    rows = stamped(t.events.select("ts", "user_id", "value", "event_id"))
    path = feed.write_feed(rows, "ts", close_after_s=3 * 86_400)
    stream = feed.read_feed(t.spark, path, rows.schema)
    found = detector.stream_jump_clusters(stream, "ts", "user_id", "value", 20.0, 86_400.0, tie="event_id")
    out = feed.run_to_end(found, "sessions")
    return rounded(naive(out.withColumn("user_id", F.col("site").cast("long")).drop("site"), "start", "end"))


EXCURSIONS_BY_SITE = """WITH s AS (SELECT user_id, ts, value < 20 AS beyond FROM events),
   f AS (SELECT *, CASE WHEN beyond IS DISTINCT FROM lag(beyond) OVER w THEN 1 ELSE 0 END AS new FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
   g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM f),
   r AS (SELECT user_id, run, beyond, count(*) AS n, min(ts) AS s, max(ts) AS e FROM g GROUP BY 1, 2, 3),
   k AS (SELECT *, sum(CASE WHEN NOT beyond AND n >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY run) AS grp FROM r),
   h AS (SELECT user_id, grp, min(s) FILTER (WHERE beyond AND n >= 1) AS start, max(e) AS last_row,
           min(s) FILTER (WHERE NOT beyond AND n >= 2) AS head FROM k GROUP BY 1, 2),
   c AS (SELECT *, lead(head) OVER (PARTITION BY user_id ORDER BY grp) AS closed_at FROM h)
   SELECT CAST(user_id AS VARCHAR) AS site, start, coalesce(closed_at, last_row) AS "end", closed_at IS NULL AS open_tail,
     (epoch_us(coalesce(closed_at, last_row)) - epoch_us(start)) // 1000000 AS duration_s FROM c
   WHERE start IS NOT NULL AND epoch_us(coalesce(closed_at, last_row)) - epoch_us(start) >= 2000000"""


@query("stream_excursions", EXCURSIONS_BY_SITE)
def stream_excursions(t: Tables) -> DataFrame:
    rows = stamped(t.events.select("ts", "user_id", "value"))
    path = feed.write_feed(rows, "ts", close_after_s=60 * 86_400)
    stream = feed.read_feed(t.spark, path, rows.schema)
    found = detector.stream_excursions(stream, "ts", "user_id", "value", 20.0, 1, 2, 2, idle_s=40 * 86_400)
    return naive(feed.run_to_end(found, "excursions"), "start", "end")


@query("stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(t: Tables) -> DataFrame:
    rows = t.events.select("ts", "user_id", "event_type")
    stream = feed.read_feed(t.spark, feed.write_feed(rows, "ts", close=False), rows.schema, with_file=True)
    return replay.stream_append(stream, ["user_id", "event_type"])
