"""Scans, sources and sinks on the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import parse
from gridloom.operators import sampling, sets
from gridloom.queries.registry import Tables, query
from gridloom.session import scratch_path
from gridloom.sources import convert, ingest, scan, sink


def by_year(t: Tables) -> DataFrame:
    """Orders as a Hive-partitioned table, so that years prune folders."""
    path = scratch_path(t.spark, "orders")
    rows = t.orders.select("o_orderkey", "o_orderdate", "o_totalprice", F.year("o_orderdate").alias("year"))
    rows.write.partitionBy("year").parquet(path)
    return t.spark.read.parquet(path)


@query(
    "scan_year",
    """SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE year(o_orderdate) IN (1996, 1998)""",
)
def scan_year(t: Tables) -> DataFrame:
    return scan.scan_range(by_year(t), "o_orderdate", None, None, years=[1996, 1998], year="year").select(
        "o_orderkey", "o_orderdate", "o_totalprice"
    )


@query(
    "scan_date_range",
    """SELECT event_id, ts, value FROM events
       WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00'
         AND year(ts) IN (2023, 2024)""",
)
def scan_date_range(t: Tables) -> DataFrame:
    frame = t.events.select("event_id", "ts", "value")
    return scan.scan_range(frame, "ts", "2024-01-05 00:00:00", "2024-01-12 12:00:00", years=[2023, 2024])


@query("list_partitions", "SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders")
def list_partitions(t: Tables) -> DataFrame:
    return scan.partitions(by_year(t), ["year"])


@query(
    "scan_generation",
    """WITH mix AS (SELECT date_trunc('hour', ts) AS hour,
         CAST(sum(CAST(value AS DECIMAL(18,2))) FILTER (WHERE event_type = 'click') AS DOUBLE) AS click,
         CAST(sum(CAST(value AS DECIMAL(18,2))) FILTER (WHERE event_type = 'view') AS DOUBLE) AS view
       FROM events GROUP BY 1)
       SELECT hour, click, view FROM mix
       WHERE hour BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20'""",
)
def scan_generation(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "generation")
    t.mix().write.option("header", True).csv(path)
    schema = "hour timestamp_ntz, click double, error double, purchase double, signup double, view double"
    return scan.scan_csv(
        t.spark, path, schema, "hour", "2024-01-03 00:00:00", "2024-01-20 00:00:00", ["hour", "click", "view"]
    )


@query(
    "ingest_signal_csv",
    """SELECT CASE event_id % 8 WHEN 5 THEN date_trunc('millisecond', ts) WHEN 7 THEN date_trunc('minute', ts)
         ELSE date_trunc('second', ts) END AS Date, value AS Value FROM events WHERE event_id % 8 NOT IN (3, 4)""",
)
def ingest_signal_csv(t: Tables) -> DataFrame:
    form = F.col("event_id") % 8
    date = (
        F.when(form == 0, F.date_format("ts", "dd/MM/yyyy HH:mm:ss"))
        .when(form == 1, F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00")))
        .when(form == 3, F.lit("not a date"))
        .when(form == 5, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
        .when(form == 6, F.date_format("ts", "d/M/yyyy HH:mm:ss"))
        .when(form == 7, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm"), F.lit(":00+0000")))
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    )
    value = F.when(form == 4, F.lit("n/a")).otherwise(F.col("value").cast("string"))
    path = scratch_path(t.spark, "signal")
    t.events.select(date.alias("dtm"), value.alias("f")).write.option("header", True).csv(path)
    return ingest.signal_csv(t.spark, path).withColumn("Date", F.col("Date").cast("timestamp_ntz"))


def through_csv(t: Tables, raw: DataFrame) -> DataFrame:
    """Write text columns as CSV with a header and read them as any other file."""
    path = scratch_path(t.spark, "csv")
    raw.write.option("header", True).csv(path)
    return ingest.read_text_csv(t.spark, path)


@query(
    "ingest_contract",
    """SELECT o_orderdate + INTERVAL 30 MINUTE * (CAST(o_orderkey % 48 AS INTEGER)) AS DatetimeUTC,
         o_custkey AS CUST, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS ND,
         CAST(o_orderkey % 48 + 1 AS BIGINT) AS SETTLEMENT_PERIOD
       FROM orders WHERE o_orderkey % 11 <> 0""",
)
def ingest_contract(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    raw = t.orders.select(
        F.when(key % 11 != 0, F.date_format("o_orderdate", "dd-MMM-yyyy")).alias("SETTLEMENT_DATE"),
        (key % 48 + 1).cast("string").alias("SETTLEMENT_PERIOD"),
        F.col("o_custkey").cast("string").alias("CUST"),
        F.when(key % 7 == 0, "-").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("ND"),
    )
    contract = {"SETTLEMENT_PERIOD": "integer", "CUST": "integer", "SETTLEMENT_DATE": "string"}
    stamp = parse.settlement_instant(parse.date_multi("SETTLEMENT_DATE"), "SETTLEMENT_PERIOD").cast("timestamp_ntz")
    return ingest.contract_rows(through_csv(t, raw), contract, stamp).drop("SETTLEMENT_DATE")


@query(
    "ingest_alias",
    """SELECT o_orderdate AS DatetimeUTC, o_totalprice AS Cost_per_GVAs FROM orders WHERE o_orderkey % 9 <> 0""",
)
def ingest_alias(t: Tables) -> DataFrame:
    raw = t.orders.select(
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("Settlement Date"),
        F.when(F.col("o_orderkey") % 9 != 0, F.format_number("o_totalprice", 2)).alias("Cost"),
    )
    out = ingest.aliased_cost(through_csv(t, raw), "Settlement Date", ["Cost_per_GVAs", "Cost"], "Cost_per_GVAs")
    return out.withColumn("DatetimeUTC", F.col("DatetimeUTC").cast("timestamp_ntz"))


@query(
    "ingest_chunks",
    "SELECT date_trunc('second', ts) AS timestamp, value AS demand, CAST(user_id AS DOUBLE) AS id FROM events",
)
def ingest_chunks(t: Tables) -> DataFrame:
    """Two chunks, the second with its columns in another order and one more."""
    folder = scratch_path(t.spark, "snapshots")
    rows = t.events.select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col("value").alias("demand"), F.col("user_id").alias("id")
    )
    half = F.xxhash64("timestamp", "id") % 2 == 0
    rows.where(half).write.option("header", True).csv(f"{folder}/snapshot_chunk_1.csv")
    rows.where(~half).select("id", F.lit("x").alias("note"), "timestamp", "demand").write.option("header", True).csv(f"{folder}/snapshot_chunk_2.csv")
    path = ingest.chunk_paths(t.spark, folder, "snapshot_chunk_*.csv", "snapshot.csv")
    out = ingest.all_double(ingest.read_text_csv(t.spark, path).drop("note"), "timestamp")
    return out.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query(
    "ingest_weather",
    """SELECT date_trunc('minute', ts) AS Date, CAST(value AS FLOAT) AS Temperature_C,
         CAST(user_id AS FLOAT) AS Wind_Speed_100m_kph FROM events WHERE event_id % 13 <> 0""",
)
def ingest_weather(t: Tables) -> DataFrame:
    good = F.col("event_id") % 13 != 0
    raw = t.events.select(
        F.when(good, F.date_format("ts", "yyyy-MM-dd'T'HH:mm")).otherwise(F.lit("2024-13-01T00:00")).alias("Date"),
        F.col("value").cast("string").alias("Temperature_C"),
        F.col("user_id").cast("string").alias("Wind_Speed_100m_kph"),
    )
    out = ingest.weather_rows(through_csv(t, raw), "Date", ["Temperature_C", "Wind_Speed_100m_kph"])
    return out.withColumn("Date", F.col("Date").cast("timestamp_ntz"))


@query(
    "infer_types",
    """SELECT o_orderdate AS order_date, o_totalprice AS price, o_orderstatus AS status,
         CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_custkey AS DOUBLE) END AS cust
       FROM orders WHERE o_orderkey % 17 <> 0""",
)
def infer_types(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    blank = key % 17 == 0

    def unless_blank(column):
        return F.when(~blank, column)

    raw = t.orders.select(
        unless_blank(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("order_date"),
        unless_blank(F.format_number("o_totalprice", 2)).alias("price"),
        unless_blank(F.col("o_orderstatus")).alias("status"),
        unless_blank(F.when(key % 10 == 0, "x").otherwise(F.col("o_custkey").cast("string"))).alias("cust"),
    )
    out = ingest.infer_rows(through_csv(t, raw))
    return out.withColumn("order_date", F.col("order_date").cast("timestamp_ntz"))


@query(
    "ingest_slugs",
    """SELECT event_type AS slug, count(*) AS rows, count(DISTINCT value) AS values FROM events GROUP BY 1""",
)
def ingest_slugs(t: Tables) -> DataFrame:
    folder = scratch_path(t.spark, "slugs")
    kinds = ("click", "error", "purchase", "signup", "view")
    rows = t.events.select("event_id", "value", "event_type")
    for part, columns in ((0, ["event_id", "value"]), (1, ["value", "event_id"])):
        # Half of each dataset's files have their columns the other way round.
        rows.where(F.col("event_id") % 2 == part).select(*columns, "event_type").write.mode("append").partitionBy("event_type").option("header", True).csv(folder)
    whole = ingest.slug_table(t.spark, folder, [f"event_type={k}" for k in kinds])
    return whole.groupBy(F.substring_index("slug", "=", -1).alias("slug")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("value").alias("values")
    )


@query(
    "sink_year_week",
    """SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'orders of' ELSE 'orders_of' END AS source, lpad(CAST(year(l_shipdate) AS VARCHAR), 4, '0') AS year,
         lpad(CAST(weekofyear(l_shipdate) AS VARCHAR), 2, '0') AS week,
         count(*) AS rows, min(l_shipdate) AS first_ts, max(l_shipdate) AS last_ts
       FROM lineitem WHERE l_orderkey % 2 = 1 OR year(l_shipdate) = 1995 GROUP BY 1, 2, 3""",
)
def sink_year_week(t: Tables) -> DataFrame:
    """Two sources that share every week and nearly a name; the first runs again with one year alone."""
    path = scratch_path(t.spark, "weeks")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate")
    for part, name, again in ((0, "orders of", False), (1, "orders_of", False), (0, "orders of", True)):
        source = rows.where(F.col("l_orderkey") % 2 == part)
        if again:
            source = source.where(F.year("l_shipdate") == 1995)
        sink.write_year_week(source, path, "l_shipdate", name, "lines")
    back = sink.read_year_week(t.spark, path)
    return back.groupBy("source", "year", "week").agg(
        F.count(F.lit(1)).alias("rows"), F.min("l_shipdate").alias("first_ts"), F.max("l_shipdate").alias("last_ts")
    )


@query("incremental_files", "SELECT DISTINCT CAST(ts AS DATE) AS day FROM events WHERE day(ts) % 3 <> 0")
def incremental_files(t: Tables) -> DataFrame:
    """Days whose files wait for conversion, when every third day is done."""
    path = scratch_path(t.spark, "daily")
    t.events.select("event_id", F.to_date("ts").alias("day")).write.partitionBy("day").parquet(path)
    listing = sink.file_listing(t.spark, path, "*.parquet")
    day = F.to_date(F.regexp_extract("path", r"day=(\d{4}-\d{2}-\d{2})", 1))
    done = listing.where(F.day(day) % 3 == 0).select("path", "mtime")
    return sink.pending_files(listing, done).select(day.alias("day")).distinct()


@query(
    "convert_files",
    """SELECT CAST(user_id % 7 AS VARCHAR) AS part, count(*) AS rows, CAST(count(*) FILTER (WHERE user_id % 7 < 3) > 0 AS BOOLEAN) AS newer,
         max(value) AS max_value FROM events GROUP BY 1""",
)
def convert_files(t: Tables) -> DataFrame:
    """Conversion of CSV files, run again when nothing is new, and once more for added files."""
    folder, out, manifest = (scratch_path(t.spark, n) for n in ("incoming", "converted", "manifest"))
    text = t.events.select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col("value").alias("x"), (F.col("user_id") % 7).alias("part"))

    def typed(raw: DataFrame) -> DataFrame:
        # The folder a file lies in names its part.
        part = F.regexp_extract(convert.SOURCE, r"part=(\d+)/", 1)
        stamp = parse.timestamp_multi("timestamp").alias("timestamp")
        return raw.select(stamp, parse.plain_number("x").alias("x"), part.alias("part"), convert.SOURCE).na.drop(subset=["timestamp"])

    for condition in ("part >= 3", None, "part < 3"):
        if condition:
            # Later files have the columns in another order, and one more.
            rows = text.where(condition)
            rows = rows if condition == "part >= 3" else rows.select("x", F.lit(None).cast("string").alias("note"), "timestamp", "part")
            rows.write.mode("append").partitionBy("part").option("header", True).csv(folder)
        convert.convert_pending(t.spark, folder, out, manifest, typed, "timestamp")
    return sink.read_year_week(t.spark, out).groupBy("part").agg(
        F.count(F.lit(1)).alias("rows"), (F.min(F.col("part").cast("int")) < 3).alias("newer"), F.max("x").alias("max_value"))


@query(
    "union_missing_cols",
    """SELECT ts, value AS nd, NULL::BIGINT AS users FROM events WHERE event_type = 'click'
       UNION ALL SELECT ts, NULL::DOUBLE, user_id FROM events WHERE event_type = 'view'""",
)
def union_missing_cols(t: Tables) -> DataFrame:
    ev = t.events
    a = ev.where("event_type = 'click'").select("ts", F.col("value").alias("nd"))
    b = ev.where("event_type = 'view'").select("ts", F.col("user_id").alias("users"))
    c = ev.where("event_type = 'error'").select(F.col("props").alias("other"))
    return sets.union_required([a, b, c], ["ts", "nd", "users"])


@query(
    "snapshot_scan",
    """SELECT ts AS timestamp, value, event_type, event_id FROM events WHERE year(ts) BETWEEN 2023 AND 2025""",
)
def snapshot_scan(t: Tables) -> DataFrame:
    return scan.snapshot(t.events, ["value", "event_type"], 2024, max_columns=4)


@query("tail_rows", "SELECT ts, event_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def tail_rows(t: Tables) -> DataFrame:
    return sampling.tail_rows(t.signal(), ["ts", "event_id"], 500)


@query("head_rows", "SELECT ts, event_id, value FROM events ORDER BY ts, event_id LIMIT 500")
def head_rows(t: Tables) -> DataFrame:
    return sampling.head_rows(t.signal(), ["ts", "event_id"], 500)


@query("preview", "SELECT * FROM events ORDER BY ts, event_id LIMIT 5")
def preview(t: Tables) -> DataFrame:
    return sampling.head_rows(t.events, ["ts", "event_id"], 5)


@query(
    "row_stride",
    """SELECT event_type, ts, event_id, value FROM (
         SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS rn FROM events)
       WHERE rn % 8 = 0""",
)
def row_stride(t: Tables) -> DataFrame:
    rows = t.events.select("event_type", "ts", "event_id", "value")
    return sampling.row_stride(rows, ["ts", "event_id"], 8, "event_type")


@query(
    "file_order_key",
    """WITH f AS (SELECT 'f-' || year(o_orderdate) || '-' || month(o_orderdate) || '.csv' AS file,
                  year(o_orderdate) * 100 + month(o_orderdate) AS k FROM orders)
       SELECT file, CAST(k AS INTEGER) AS order_key, count(*) AS rows FROM f GROUP BY 1, 2""",
)
def file_order_key(t: Tables) -> DataFrame:
    name = F.concat(F.lit("f-"), F.year("o_orderdate"), F.lit("-"), F.month("o_orderdate"), F.lit(".csv"))
    files = t.orders.select(name.alias("file"))
    keyed = files.groupBy("file", parse.file_month("file").alias("order_key")).agg(F.count(F.lit(1)).alias("rows"))
    return keyed.orderBy("order_key")


@query(
    "sink_results",
    """SELECT k AS format, count(*) AS rows, min(value) AS min_value, max(value) AS max_value
       FROM events, (VALUES ('csv'), ('json'), ('parquet')) v(k) WHERE event_type = 'error' GROUP BY 1""",
)
def sink_results(t: Tables) -> DataFrame:
    folder = scratch_path(t.spark, "results")
    sink.write_results(t.kind("error"), folder)
    schema = "ts timestamp_ntz, event_id bigint, value double"
    back = {
        "csv": t.spark.read.schema(schema).option("header", True).csv(f"{folder}/csv"),
        "json": t.spark.read.schema(schema).json(f"{folder}/json"),
        "parquet": t.spark.read.parquet(f"{folder}/parquet"),
    }
    whole = sets.union_all([frame.withColumn("format", F.lit(k)) for k, frame in back.items()])
    return whole.groupBy("format").agg(
        F.count(F.lit(1)).alias("rows"), F.min("value").alias("min_value"), F.max("value").alias("max_value")
    )


@query(
    "replay_payload",
    """SELECT event_id, '{"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","missing":"","value":'
         || CASE WHEN event_type = 'view' THEN 'null' ELSE CAST(value AS VARCHAR) END || '}' AS frame FROM events""",
)
def replay_payload(t: Tables) -> DataFrame:
    value = F.when(F.col("event_type") == "view", float("nan")).otherwise(F.col("value"))
    rows = t.events.select("event_id", "ts", F.lit(None).cast("timestamp").alias("missing"), value.alias("value"))
    return sink.replay_frames(rows, "event_id", ["ts", "missing"], ["value"])


@query(
    "append_dedupe",
    """SELECT DISTINCT user_id::VARCHAR AS user_id, event_type, NULL::VARCHAR AS k FROM events WHERE event_id % 2 = 0
       UNION ALL
       SELECT DISTINCT user_id::VARCHAR, event_type, props FROM events WHERE event_id % 2 = 1""",
)
def append_dedupe(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "history")
    text = t.events.select(F.col("user_id").cast("string"), "event_type", "props", "event_id")
    first = text.where("event_id % 2 = 0").select("user_id", "event_type")
    second = text.where("event_id % 2 = 1").select("user_id", "event_type", F.col("props").alias("k"))
    for batch in (first, first, second, second):
        history = sink.append_history(t.spark, path, batch, digits=1)
    return history


@query(
    "tail_per_source",
    """SELECT event_type, ts, event_id, value FROM (
         SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
       WHERE rn <= 10""",
)
def tail_per_source(t: Tables) -> DataFrame:
    rows = t.events.select("event_type", "ts", "event_id", "value")
    return scan.tail_per_source(rows, "event_type", ["ts", "event_id"], 10)


@query(
    "site_scan",
    """WITH s AS (SELECT ts, value, CASE user_id % 10 WHEN 0 THEN ' ' WHEN 1 THEN 'nan' WHEN 2 THEN NULL
                   ELSE 'Site ' || (user_id % 10) END AS name FROM events)
       SELECT coalesce(CASE WHEN trim(name) IN ('', 'nan') THEN NULL ELSE trim(name) END, 'Unknown Site') AS site,
         count(*) AS rows, min(ts) AS first_ts, max(value) AS max_value FROM s GROUP BY 1""",
)
def site_scan(t: Tables) -> DataFrame:
    group = F.col("user_id") % 10
    name = (
        F.when(group == 0, " ").when(group == 1, "nan").when(group > 2, F.concat(F.lit("Site "), group.cast("string")))
    )
    rows = t.events.select("ts", "value", name.alias("Location_Hint"))
    return scan.scan_sites(rows, ["site", "location_hint"], "ts").groupBy("site").agg(
        F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"), F.max("value").alias("max_value")
    )


