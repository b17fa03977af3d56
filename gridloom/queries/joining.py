"""Joins in time and by key on the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import asof, sets
from gridloom.operators.asof import Source
from gridloom.queries.registry import Tables, query, rounded
from gridloom.sources import sink


def asof_sql(left: str, right: str, tie: str, tolerance: float | None, by: str = "") -> str:
    """Nearest match from two one-sided joins, for right rows with unique keys (r_ts, r_id, r_value)."""
    match = f"{'l.' + by + ' = r.' + by + ' AND ' if by else ''}"
    pick = "bd <= ad" if tie == "earlier" else "bd < ad"
    ok = "TRUE" if tolerance is None else f"d <= {round(tolerance * 1e6)}"
    return f"""WITH l AS ({left}), r AS ({right}),
      b AS (SELECT l.*, r.r_ts AS bts, r.r_id AS bid, r.r_value AS bv FROM l ASOF LEFT JOIN r ON {match} l.ts >= r.r_ts),
      a AS (SELECT l.event_id, r.r_ts AS ats, r.r_id AS aid, r.r_value AS av FROM l ASOF LEFT JOIN r ON {match} l.ts <= r.r_ts),
      j AS (SELECT b.*, ats, aid, av, epoch_us(ts) - epoch_us(bts) AS bd, epoch_us(ats) - epoch_us(ts) AS ad FROM b JOIN a USING (event_id)),
      p AS (SELECT *, (ad IS NULL OR coalesce({pick}, FALSE)) AS back FROM j),
      d AS (SELECT *, CASE WHEN back THEN bd ELSE ad END AS d FROM p)
      SELECT ts, event_id, {by + ', ' if by else ''} CASE WHEN {ok} THEN CASE WHEN back THEN bid ELSE aid END END AS m_r_id,
        CASE WHEN {ok} THEN CASE WHEN back THEN bv ELSE av END END AS m_r_value,
        CASE WHEN {ok} THEN CASE WHEN back THEN bts ELSE ats END END AS m_ts, round(CASE WHEN {ok} THEN d / 1e6 END, 6) AS m_offset_s FROM d"""


LEFT = "SELECT ts, event_id FROM events WHERE event_type = 'purchase'"
RIGHT = "SELECT ts AS r_ts, event_id AS r_id, value AS r_value FROM events WHERE event_type = 'error'"


def left(t: Tables) -> DataFrame:
    return t.kind("purchase").select("ts", "event_id")


def right(t: Tables, kind: str = "error") -> DataFrame:
    return t.kind(kind).select(F.col("ts").alias("r_ts"), F.col("event_id").alias("r_id"), F.col("value").alias("r_value"))


def joined(t: Tables, **how) -> DataFrame:
    return rounded(asof.asof_join(left(t), right(t), "ts", "r_ts", ["r_id", "r_value"], prefix="m_", seq="r_id", **how))


@query("asof_nearest", asof_sql(LEFT, RIGHT, "earlier", 600))
def asof_nearest(t: Tables) -> DataFrame:
    return joined(t, tolerance=600.0)


@query(
    "asof_backward",
    f"""WITH l AS ({LEFT}), r AS ({RIGHT}) SELECT ts, event_id, r_id AS m_r_id, r_value AS m_r_value, r_ts AS m_ts,
          round((epoch_us(ts) - epoch_us(r_ts)) / 1e6, 6) AS m_offset_s FROM l ASOF JOIN r ON l.ts >= r.r_ts
        WHERE epoch_us(ts) - epoch_us(r_ts) <= 3600000000""",
)
def asof_backward(t: Tables) -> DataFrame:
    return joined(t, direction="backward", tolerance=3600.0).na.drop()


@query("asof_tie_later", asof_sql(LEFT, RIGHT, "later", None))
def asof_tie_later(t: Tables) -> DataFrame:
    return joined(t, tie="later")


@query(
    "asof_by_site",
    asof_sql(
        "SELECT ts, event_id, user_id FROM events WHERE event_type = 'purchase'",
        "SELECT ts AS r_ts, event_id AS r_id, value AS r_value, user_id FROM events WHERE event_type = 'error'",
        "earlier",
        None,
        "user_id",
    ),
)
def asof_by_site(t: Tables) -> DataFrame:
    a = t.events.where("event_type = 'purchase'").select("ts", "event_id", "user_id")
    b = t.events.where("event_type = 'error'").select(
        F.col("ts").alias("r_ts"), F.col("event_id").alias("r_id"), F.col("value").alias("r_value"), "user_id"
    )
    return rounded(asof.asof_join(a, b, "ts", "r_ts", ["r_id", "r_value"], by=["user_id"], prefix="m_", seq="r_id"))


@query(
    "nearest_one",
    """SELECT ts, event_id, value FROM events ORDER BY abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')), ts DESC LIMIT 1""",
)
def nearest_one(t: Tables) -> DataFrame:
    return asof.nearest_row(t.signal(), "ts", "2024-01-15 12:00:00")


def _one(kind: str) -> str:
    right_sql = RIGHT.replace("'error'", f"'{kind}'")
    return (
        f"SELECT ts, event_id, m_r_value AS {kind}_r_value, m_ts AS {kind}_ts, m_offset_s AS {kind}_offset_s FROM "
        f"({asof_sql(LEFT, right_sql, 'earlier', 2100)})"
    )


@query(
    "fusion_chain",
    f"""SELECT * FROM ({_one("error")}) JOIN ({_one("click")}) USING (ts, event_id) JOIN ({_one("view")}) USING (ts, event_id)
        JOIN ({_one("signup")}) USING (ts, event_id)""",
)
def fusion_chain(t: Tables) -> DataFrame:
    sources = [
        Source(right(t, k), "r_ts", ["r_value"], f"{k}_", tolerance=2100.0, seq="r_value")
        for k in ("error", "click", "view", "signup")
    ]
    return rounded(asof.fuse(left(t), "ts", sources))


HOURLY = "SELECT date_trunc('hour', ts) AS hour, max(value) AS {k} FROM events WHERE event_type = '{k}' GROUP BY 1"


def hourly(t: Tables, kind: str) -> DataFrame:
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")
    return t.kind(kind).groupBy(hour).agg(F.max("value").alias(kind))


@query(
    "merge_all",
    f"""SELECT hour, click, view, error FROM ({HOURLY.format(k='click')}) FULL JOIN ({HOURLY.format(k='view')}) USING (hour)
        FULL JOIN ({HOURLY.format(k='error')}) USING (hour)""",
)
def merge_all(t: Tables) -> DataFrame:
    return sets.merge_on([hourly(t, k) for k in ("click", "view", "error")], "hour", "full")


@query(
    "left_join_buckets",
    f"""SELECT hour, click, view, error FROM ({HOURLY.format(k='click')}) LEFT JOIN ({HOURLY.format(k='view')}) USING (hour)
        LEFT JOIN ({HOURLY.format(k='error')}) USING (hour)""",
)
def left_join_buckets(t: Tables) -> DataFrame:
    return sets.left_join_all(hourly(t, "click"), [hourly(t, "view"), hourly(t, "error")], "hour")


@query(
    "lookup_join",
    """WITH y AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS fy, arg_max(o_totalprice, o_orderkey) AS price, max(o_orderkey) AS o_orderkey
                  FROM orders GROUP BY 1),
       m AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS fy, CAST(month(l_shipdate) AS INTEGER) AS month, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2)
       SELECT fy, month, qty, price, o_orderkey FROM m LEFT JOIN y USING (fy)""",
)
def lookup_join(t: Tables) -> DataFrame:
    monthly = t.lineitem.groupBy(F.year("l_shipdate").alias("fy"), F.month("l_shipdate").alias("month")).agg(
        F.sum("l_quantity").alias("qty")
    )
    table = t.orders.select(F.year("o_orderdate").alias("fy"), F.col("o_totalprice").alias("price"), "o_orderkey")
    return sets.lookup(monthly, table, "fy", ["o_orderkey"])


@query(
    "anti_join",
    """SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 1
       EXCEPT SELECT user_id, event_type FROM events WHERE event_id % 2 = 0 AND event_type <> 'view'""",
)
def anti_join(t: Tables) -> DataFrame:
    history = t.events.where("event_id % 2 = 0 AND event_type <> 'view'").select("user_id", "event_type")
    batch = t.events.where("event_id % 2 = 1").select("user_id", "event_type")
    return sink.new_rows(history, batch)


@query(
    "context_rows",
    """WITH r AS (SELECT ts, event_id, value, row_number() OVER (ORDER BY ts) - 1 AS pos, count(*) OVER () AS n FROM events),
       c AS (SELECT pos, n FROM r ORDER BY abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')), ts DESC LIMIT 1),
       s AS (SELECT greatest(0, least(pos - 4, n - 8)) AS s FROM c)
       SELECT ts, event_id, value, CAST(pos - s AS INTEGER) AS rank FROM r, s WHERE pos >= s AND pos < s + 8""",
)
def context_rows(t: Tables) -> DataFrame:
    return asof.context_rows(t.signal(), "ts", "2024-01-15 12:00:00", 8)


