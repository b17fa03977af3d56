"""Window functions, sorting, sampling and set operations on the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import quality, sampling, sets, windows
from gridloom.queries.registry import Tables, query, rounded

TIE = ["event_id"]

ROCOF_SQL = """SELECT lag(ts) OVER w AS sample_start_ts, ts AS sample_end_ts, lag(value) OVER w AS f_start_hz, value AS f_end_hz,
         epoch_us(ts) - epoch_us(lag(ts) OVER w) AS dus FROM events WINDOW w AS (ORDER BY ts, event_id)"""


@query(
    "rocof",
    f"""SELECT sample_start_ts, sample_end_ts, make_timestamp(epoch_us(sample_start_ts) + dus // 2) AS rocof_timestamp,
         f_start_hz, f_end_hz, round(dus / 1e6, 6) AS delta_t_s, round(f_end_hz - f_start_hz, 6) AS delta_f_hz,
         round((f_end_hz - f_start_hz) / (dus / 1e6), 6) AS rocof_hz_per_s FROM ({ROCOF_SQL}) WHERE dus > 0""",
)
def rocof(t: Tables) -> DataFrame:
    out = windows.rocof(t.signal(), tie=TIE)
    return rounded(out.withColumn("rocof_timestamp", F.col("rocof_timestamp").cast("timestamp_ntz")))


@query(
    "lag_features",
    """SELECT * FROM (SELECT ts, event_id, value, lag(value, 1) OVER w AS lag_1, lag(value, 5) OVER w AS lag_5,
         round(avg(value) OVER (ORDER BY ts, event_id ROWS 9 PRECEDING), 6) AS rolling_mean_10
       FROM events WINDOW w AS (ORDER BY ts, event_id)) WHERE lag_1 IS NOT NULL AND lag_5 IS NOT NULL""",
)
def lag_features(t: Tables) -> DataFrame:
    return rounded(windows.lag_features(t.signal(), "ts", "value", tie=TIE))


def _roll_sql(n: int) -> str:
    frame = f"(ORDER BY ts, event_id ROWS {n - 1} PRECEDING)"
    gate = f"count(value) OVER {frame} >= {max(2, n // 3)}"
    return ", ".join(
        f"CASE WHEN {gate} THEN round({fn}(value) OVER {frame}, 6) END AS roll{n}_{label}"
        for label, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))
    )


@query(
    "rolling_stats",
    f"""SELECT ts, event_id, value, {", ".join(f"round(value - lag(value, {k}) OVER w, 6) AS diff_{k}" for k in (1, 5, 30))},
         {", ".join(_roll_sql(n) for n in (5, 30, 120, 600))} FROM events WINDOW w AS (ORDER BY ts, event_id)""",
)
def rolling_stats(t: Tables) -> DataFrame:
    return rounded(windows.rolling_stats(t.signal(), "ts", "value", tie=TIE))


@query(
    "rolling_quantile",
    """SELECT ts, event_id, value, CASE WHEN n >= 48 THEN round(q, 6) END AS rolling_q,
         CASE WHEN n >= 48 THEN round(greatest(0.0, q - value), 6) END AS proxy
       FROM (SELECT ts, event_id, value, count(value) OVER w AS n, quantile_cont(value, 0.95) OVER w AS q FROM events
             WINDOW w AS (ORDER BY ts, event_id ROWS 335 PRECEDING))""",
)
def rolling_quantile(t: Tables) -> DataFrame:
    return rounded(windows.rolling_quantile_excess(t.signal(), "ts", "value", tie=TIE))


@query(
    "rolling_std",
    """SELECT ts, event_id, value, CASE WHEN count(value) OVER w >= 10 THEN round(stddev_samp(value) OVER w, 6) END AS std_10
       FROM events WINDOW w AS (ORDER BY ts, event_id ROWS 9 PRECEDING)""",
)
def rolling_std(t: Tables) -> DataFrame:
    return rounded(windows.rolling_std(t.signal(), "ts", "value", tie=TIE))


@query(
    "halo_carry",
    """SELECT * FROM (SELECT ts, event_id, value, lag(value, 1) OVER w AS lag_1, lag(value, 12) OVER w AS lag_12,
         round(avg(value) OVER (ORDER BY ts, event_id ROWS 11 PRECEDING), 6) AS rolling_mean_12
       FROM events WINDOW w AS (ORDER BY ts, event_id)) WHERE lag_12 IS NOT NULL""",
)
def halo_carry(t: Tables) -> DataFrame:
    return rounded(windows.lag_features(t.signal(), "ts", "value", lags=(1, 12), mean_of=12, tie=TIE))


@query(
    "running_total",
    """SELECT o_orderkey, CAST(sum(o_custkey) OVER (ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS running FROM orders""",
)
def running_total(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_orderdate", "o_custkey")
    out = windows.running_sum(rows, ["o_orderdate", "o_orderkey"], "o_custkey", "running")
    return out.select("o_orderkey", "running")


@query(
    "last_n",
    """SELECT user_id, ts, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
       FROM events) WHERE rn <= 24""",
)
def last_n(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "ts", "event_id", "value")
    return windows.last_rows_per_key(rows, ["user_id"], ["ts", "event_id"], 24)


@query(
    "label_changes",
    """WITH l AS (SELECT ts, event_id, CASE WHEN value < 5 THEN 'LOW' WHEN value > 120 THEN 'HIGH' ELSE 'STABLE' END AS label
                  FROM events),
       p AS (SELECT *, lag(label) OVER (ORDER BY ts, event_id) AS previous_label FROM l)
       SELECT ts, event_id, label, previous_label, CAST(label = 'STABLE' AS INTEGER) AS returned FROM p
       WHERE previous_label IS NOT NULL AND label <> previous_label""",
)
def label_changes(t: Tables) -> DataFrame:
    v = F.col("value")
    labelled = t.signal().select("ts", "event_id", F.when(v < 5, "LOW").when(v > 120, "HIGH").otherwise("STABLE").alias("label"))
    return windows.label_changes(labelled, "ts", "label", TIE)


@query(
    "sample_dt",
    """SELECT ts, event_id, round(coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts, event_id))) / 1e6, 0), 6) AS dt_s
       FROM events""",
)
def sample_dt(t: Tables) -> DataFrame:
    return rounded(windows.sample_durations(t.signal().select("ts", "event_id"), "ts", TIE))


@query(
    "topn_days",
    """SELECT day, cost FROM (SELECT o_orderdate AS day, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS cost
       FROM orders GROUP BY 1) ORDER BY cost DESC, day LIMIT 10""",
)
def topn_days(t: Tables) -> DataFrame:
    cost = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    daily = t.orders.groupBy(F.col("o_orderdate").alias("day")).agg(cost.alias("cost"))
    return sampling.top_n(daily, "cost", 10, ["day"])


@query(
    "topk_features",
    """SELECT l_suppkey, l_partkey, qty, CAST(rank AS INTEGER) AS rank FROM (
         SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY qty DESC, l_partkey) AS rank FROM (
           SELECT l_suppkey, l_partkey, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2)) WHERE rank <= 5""",
)
def topk_features(t: Tables) -> DataFrame:
    qty = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("qty"))
    return sampling.top_k_per_group(qty, ["l_suppkey"], "qty", 5, ["l_partkey"])


@query(
    "even_downsample",
    """WITH r AS (SELECT ts, event_id, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_no, count(*) OVER () AS n FROM events),
       p AS (SELECT DISTINCT (i * (SELECT count(*) - 1 FROM events)) // 299 AS pos FROM range(300) g(i))
       SELECT row_no, ts, event_id, value FROM r WHERE row_no IN (SELECT pos FROM p)""",
)
def even_downsample(t: Tables) -> DataFrame:
    return sampling.even_downsample(t.signal(), ["ts", "event_id"], 300)


@query(
    "window_slice",
    """SELECT ts, event_id, value FROM events
       WHERE ts >= TIMESTAMP '2024-01-07 06:00:00' AND ts < TIMESTAMP '2024-01-07 06:00:00' + INTERVAL 86400 SECOND""",
)
def window_slice(t: Tables) -> DataFrame:
    return sampling.window_slice(t.signal(), "ts", 86400, "2024-01-07 06:00:00")


@query("sample_n", "SELECT ts, event_id, value FROM events ORDER BY md5('42|' || event_id), event_id LIMIT 1000")
def sample_n(t: Tables) -> DataFrame:
    return sampling.sample_rows(t.signal(), 1000, ["event_id"])


@query(
    "chrono_split",
    """SELECT event_id, row_no, CASE WHEN row_no < least(greatest(CAST(floor(n * 0.8) AS BIGINT), 1), n - 1) THEN 'train' ELSE 'test' END AS part
       FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_no, count(*) OVER () AS n FROM events)""",
)
def chrono_split(t: Tables) -> DataFrame:
    return sampling.chronological_split(t.signal(), ["ts", "event_id"], 0.8).select("event_id", "row_no", "part")


@query(
    "union_all",
    """SELECT ts, event_id, value FROM events WHERE event_type = 'click'
       UNION ALL SELECT ts, event_id, value FROM events WHERE event_type = 'view'
       UNION ALL SELECT ts, event_id, value FROM events WHERE event_type = 'click'""",
)
def union_all(t: Tables) -> DataFrame:
    return sets.union_all([t.kind("click"), t.kind("view"), t.kind("click")])


@query(
    "union_by_name",
    """SELECT ts, event_id, value, NULL::VARCHAR AS status FROM events WHERE event_type = 'click'
       UNION ALL SELECT o_orderdate, NULL, NULL, o_orderstatus FROM orders""",
)
def union_by_name(t: Tables) -> DataFrame:
    other = t.orders.select(F.col("o_orderdate").alias("ts"), F.col("o_orderstatus").alias("status"))
    return sets.union_reconciled([t.kind("click"), other])


@query(
    "except_both",
    """WITH e AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'),
            a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P')
       SELECT o_custkey, 'missing' AS side FROM (SELECT * FROM e EXCEPT SELECT * FROM a)
       UNION ALL SELECT o_custkey, 'unexpected' FROM (SELECT * FROM a EXCEPT SELECT * FROM e)""",
)
def except_both(t: Tables) -> DataFrame:
    expected = t.orders.where("o_orderstatus = 'F'").select("o_custkey")
    actual = t.orders.where("o_orderstatus = 'P'").select("o_custkey")
    return sets.difference_both(expected, actual)


@query("distinct_headers", "SELECT DISTINCT l_suppkey AS dataset, p_name AS name FROM lineitem JOIN part ON p_partkey = l_partkey")
def distinct_headers(t: Tables) -> DataFrame:
    joined = t.lineitem.select("l_partkey", "l_suppkey").join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    return quality.distinct_headers(joined.select(F.col("l_suppkey").alias("dataset"), F.col("p_name").alias("name")))

