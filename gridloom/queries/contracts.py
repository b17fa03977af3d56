"""Contract, header and freshness jobs; catalogues are drawn from the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import quality
from gridloom.queries.registry import Tables, query
from gridloom.sources import ingest


@query(
    "snake_headers",
    """WITH h AS (SELECT p_partkey, lower(p_type || ' No. (' || p_name || ') ' || p_brand || ' ' || p_brand || ' %/DateTime [' || p_size || ']') AS t FROM part),
       w AS (SELECT p_partkey, string_split(trim(regexp_replace(regexp_replace(replace(replace(replace(t, '%', ' percent '), '#', ' number '), '&', ' and '),
              '[/\\\\()\\[\\]{}\\-.:;,]', ' ', 'g'), '\\s+', ' ', 'g')), ' ') AS ws FROM h),
       m AS (SELECT p_partkey, list_filter(list_transform(ws, lambda x: CASE WHEN x IN ('no','num','number') THEN 'id' WHEN x IN ('dt','dttm','datetime') THEN 'timestamp'
              ELSE regexp_replace(x, '[^a-z0-9_]', '', 'g') END), lambda x: x <> '') AS ws FROM w)
       SELECT p_partkey, array_to_string(list_filter(ws, lambda x, i: i = 1 OR ws[i - 1] <> x), '_') AS header FROM m""",
)
def snake_headers(t: Tables) -> DataFrame:
    raw = F.concat(
        "p_type", F.lit(" No. ("), "p_name", F.lit(") "), "p_brand", F.lit(" "), "p_brand", F.lit(" %/DateTime ["),
        F.col("p_size").cast("string"), F.lit("]"),
    )
    return t.part.select("p_partkey", quality.snake(raw).alias("header"))


# Header endings that the type hints are tried on, with the type each suggests.
ENDINGS = (
    ("timestamp", "timestamp"),
    ("active mw", "float64"),
    ("trading date", "date"),
    ("month", "int64"),
    (" flag ", "bool"),
    ("kwh", "float64"),
    ("status", "string"),
    ("colour", "string"),
)


@query(
    "dtype_hint",
    "SELECT p_partkey, CASE p_partkey % 8 "
    + " ".join(f"WHEN {i} THEN '{kind}'" for i, (_, kind) in enumerate(ENDINGS))
    + " END AS hint FROM part",
)
def dtype_hint(t: Tables) -> DataFrame:
    source = F.lit(None).cast("string")
    for i, (text, _) in enumerate(ENDINGS):
        source = F.when(F.col("p_partkey") % 8 == i, text).otherwise(source)
    raw = F.concat(F.col("p_name"), F.lit(" "), source)
    return t.part.select("p_partkey", quality.dtype_hint(raw, quality.snake(raw)).alias("hint"))


@query(
    "wide_to_long",
    """SELECT event_type AS file, date_trunc('second', ts) AS ts, name, CASE name WHEN 'main_st_mw' THEN value WHEN 'main_st_mvar' THEN CAST(user_id AS DOUBLE)
         ELSE CAST(event_id AS DOUBLE) END AS value FROM events, (VALUES ('main_st_mw'), ('main_st_mvar'), ('node_002_mw')) v(name)""",
)
def wide_to_long(t: Tables) -> DataFrame:
    line = F.concat_ws(",", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "value", "user_id", "event_id")
    data = t.events.select(F.col("event_type").alias("file"), (F.col("event_id") + 3).alias("line_no"), line.alias("line"))
    # Line numbers have gaps per file, so the label line must sit right above its first data line.
    first = data.groupBy("file").agg(F.min("line_no").alias("line_no"))
    labels = first.select("file", (F.col("line_no") - 1).alias("line_no"), F.lit("Date,Main St,Main St,").alias("line"))
    units = first.select("file", (F.col("line_no") - 2).alias("line_no"), F.lit("Power,MW,MVAr,").alias("line"))
    out = ingest.wide_load_rows(data.unionByName(labels).unionByName(units))
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    "validate_contract",
    """WITH k AS (SELECT DISTINCT o_custkey AS dataset, o_orderpriority AS name FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 10 <> 0
                  UNION SELECT DISTINCT o_custkey, 'all raw columns' FROM orders WHERE o_custkey % 31 = 0),
       d AS (SELECT dataset FROM k UNION SELECT o_custkey FROM orders WHERE o_custkey % 10 = 0),
       a AS (SELECT DISTINCT o_custkey AS dataset, o_orderpriority AS name FROM orders WHERE o_orderstatus = 'O'),
       j AS (SELECT coalesce(k.dataset, a.dataset) AS dataset, k.name AS w, a.name AS h FROM k FULL JOIN a ON k.dataset = a.dataset AND k.name = a.name),
       g AS (SELECT dataset, count(w) AS nw, count(h) AS nh, count(*) FILTER (WHERE w = 'all raw columns') AS loose,
               coalesce(string_agg(w, ',' ORDER BY w) FILTER (WHERE h IS NULL), '') AS missing,
               coalesce(string_agg(h, ',' ORDER BY h) FILTER (WHERE w IS NULL), '') AS unexpected FROM j GROUP BY 1),
       s AS (SELECT d.dataset, CASE WHEN coalesce(nh, 0) = 0 THEN 'SKIP' WHEN coalesce(nw, 0) = 0 THEN 'WARN' WHEN loose > 0 THEN 'SKIP'
               WHEN missing = '' AND unexpected = '' THEN 'PASS' ELSE 'FAIL' END AS status, missing, unexpected FROM d LEFT JOIN g USING (dataset))
       SELECT dataset, 'raw' AS target, status, CASE WHEN status = 'FAIL' THEN missing ELSE '' END AS missing,
         CASE WHEN status = 'FAIL' THEN unexpected ELSE '' END AS unexpected FROM s""",
)
def validate_contract(t: Tables) -> DataFrame:
    cust, name = F.col("o_custkey").alias("dataset"), F.col("o_orderpriority").alias("name")
    target = F.lit("raw").alias("target")
    named = t.orders.where("o_orderstatus = 'F' and o_custkey % 10 <> 0").select(cust, target, name)
    loose = t.orders.where("o_custkey % 31 = 0").select(cust, target, F.lit("all raw columns").alias("name"))
    bare = t.orders.where("o_custkey % 10 = 0").select(cust, target, F.lit(None).cast("string").alias("name"))
    catalogue = t.orders.where("o_orderstatus = 'O'").select(cust, target, name)
    return quality.validate_contract(named.unionByName(loose).unionByName(bare), catalogue)


@query(
    "normalise_contract",
    """WITH r AS (SELECT o_custkey AS dataset, o_orderkey AS position, o_orderpriority AS name, o_orderstatus AS type,
                    CASE o_custkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS level FROM orders),
       u AS (SELECT * FROM r UNION ALL SELECT dataset, position, name, 'old', level + 1 FROM r WHERE level < 2),
       b AS (SELECT dataset, min(level) AS level FROM u GROUP BY 1)
       SELECT dataset, min(position) AS position, name, CASE WHEN min(type) = max(type) THEN min(type) ELSE 'mixed' END AS type
       FROM u JOIN b USING (dataset, level) GROUP BY dataset, name""",
)
def normalise_contract(t: Tables) -> DataFrame:
    rows = t.orders.select(
        F.col("o_custkey").alias("dataset"), F.col("o_orderkey").alias("position"), F.col("o_orderpriority").alias("name"),
        F.col("o_orderstatus").alias("type"),
    )
    old = rows.withColumn("type", F.lit("old"))
    discovered = rows.where("dataset % 3 = 0")
    existing = rows.where("dataset % 3 = 1").unionByName(old.where("dataset % 3 = 0"))
    stored = rows.where("dataset % 3 = 2").unionByName(old.where("dataset % 3 = 1"))
    return quality.normalise_contract(discovered, existing, stored)


@query(
    "header_template",
    """WITH c AS (SELECT l_suppkey AS dataset, l_orderkey AS file, p_type AS name FROM lineitem JOIN part ON p_partkey = l_partkey)
       SELECT dataset, count(DISTINCT name) AS columns, count(DISTINCT file) AS files, string_agg(DISTINCT name, ',' ORDER BY name) AS names
       FROM c GROUP BY 1""",
)
def header_template(t: Tables) -> DataFrame:
    items = t.lineitem.select("l_suppkey", "l_orderkey", "l_partkey").join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    catalogue = items.select(
        F.col("l_suppkey").alias("dataset"), F.col("l_orderkey").alias("file"), F.col("p_type").alias("name")
    )
    return quality.header_template(catalogue).withColumn("names", F.array_join("names", ","))


def headers(t: Tables, name: str) -> DataFrame:
    return t.lineitem.select(
        F.col("l_orderkey").alias("dataset"), F.col("l_linenumber").alias("position"), F.expr(name).alias("name")
    )


OUTPUT = "CASE WHEN l_orderkey % 5 = 0 THEN l_linestatus ELSE l_returnflag END"


@query(
    "header_roundtrip",
    f"""WITH a AS (SELECT l_orderkey AS dataset, list(l_returnflag ORDER BY l_linenumber, l_returnflag) AS h FROM lineitem GROUP BY 1),
        b AS (SELECT l_orderkey AS dataset, list({OUTPUT} ORDER BY l_linenumber, {OUTPUT}) AS h FROM lineitem WHERE l_orderkey % 7 <> 0 GROUP BY 1)
        SELECT a.dataset, len(a.h) AS columns, CAST(coalesce(a.h = b.h, FALSE) AS INTEGER) AS same FROM a LEFT JOIN b USING (dataset)""",
)
def header_roundtrip(t: Tables) -> DataFrame:
    return quality.header_roundtrip(headers(t, "l_returnflag"), headers(t, OUTPUT).where("dataset % 7 <> 0"))


@query(
    "header_drift",
    f"""WITH a AS (SELECT l_orderkey AS dataset, list(l_returnflag ORDER BY l_linenumber, l_returnflag) AS h FROM lineitem WHERE l_orderkey % 11 <> 0 GROUP BY 1),
        b AS (SELECT l_orderkey AS dataset, list({OUTPUT} ORDER BY l_linenumber, {OUTPUT}) AS h FROM lineitem WHERE l_orderkey % 7 <> 0 GROUP BY 1)
        SELECT coalesce(a.dataset, b.dataset) AS dataset, CASE WHEN b.h IS NULL THEN 'removed' WHEN a.h IS NULL THEN 'added'
          WHEN a.h <> b.h THEN 'changed' ELSE 'same' END AS state FROM a FULL JOIN b ON a.dataset = b.dataset""",
)
def header_drift(t: Tables) -> DataFrame:
    previous = headers(t, "l_returnflag").where("dataset % 11 <> 0")
    current = headers(t, OUTPUT).where("dataset % 7 <> 0")
    return quality.header_drift(previous, current)


@query(
    "mapping_merge",
    """WITH f AS (SELECT o_custkey AS dataset, o_orderpriority AS header, o_orderkey AS position, lower(o_orderpriority) AS parquet_name, '' AS notes FROM orders),
       n AS (SELECT *, row_number() OVER (PARTITION BY dataset, header ORDER BY position) AS nth FROM f),
       o AS (SELECT o_custkey AS dataset, o_orderpriority AS header, CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE ' manual ' END AS p, 'note ' || o_orderkey AS q,
               row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS nth FROM orders WHERE o_orderkey % 2 = 0)
       SELECT dataset, header, nth, position, coalesce(nullif(trim(p), ''), parquet_name) AS parquet_name,
         coalesce(nullif(trim(q), ''), notes) AS notes FROM n LEFT JOIN o USING (dataset, header, nth)""",
)
def mapping_merge(t: Tables) -> DataFrame:
    base = t.orders.select(
        F.col("o_custkey").alias("dataset"), F.col("o_orderpriority").alias("header"), F.col("o_orderkey").alias("position")
    )
    fresh = base.select("*", F.lower("header").alias("parquet_name"), F.lit("").alias("notes"))
    manual = F.when(F.col("position") % 3 == 0, " ").otherwise(" manual ")
    earlier = base.where("position % 2 = 0").select(
        "*", manual.alias("parquet_name"), F.concat(F.lit("note "), F.col("position").cast("string")).alias("notes")
    )
    return quality.merge_mapping(fresh, earlier, ["parquet_name", "notes"])


FRESH_SQL = """WITH i AS (SELECT o_custkey AS dataset, o_orderkey AS stem, o_orderdate AS mtime FROM orders),
   o AS (SELECT o_custkey AS dataset, l_orderkey AS stem, max(l_shipdate) AS output_mtime FROM lineitem JOIN orders ON o_orderkey = l_orderkey
         WHERE l_returnflag = 'A' GROUP BY 1, 2),
   s AS (SELECT dataset, stem, mtime, output_mtime, CASE WHEN output_mtime IS NULL THEN 'missing' WHEN output_mtime < mtime THEN 'stale' ELSE 'ok' END AS state
         FROM i LEFT JOIN o USING (dataset, stem))"""


def freshness_rows(t: Tables) -> DataFrame:
    inputs = t.orders.select(
        F.col("o_custkey").alias("dataset"), F.col("o_orderkey").alias("stem"), F.col("o_orderdate").alias("mtime")
    )
    shipped = t.lineitem.where("l_returnflag = 'A'").join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    outputs = shipped.select(
        F.col("o_custkey").alias("dataset"), F.col("l_orderkey").alias("stem"), F.col("l_shipdate").alias("mtime")
    )
    return quality.freshness(inputs, outputs)


@query("freshness_join", f"{FRESH_SQL} SELECT dataset, stem, mtime, output_mtime, state FROM s")
def freshness_join(t: Tables) -> DataFrame:
    return freshness_rows(t)


@query("freshness", f"{FRESH_SQL} SELECT state, count(*) AS files FROM s GROUP BY 1")
def freshness(t: Tables) -> DataFrame:
    return freshness_rows(t).groupBy("state").agg(F.count(F.lit(1)).alias("files"))


@query(
    "dropped_rows",
    """SELECT event_type, count(*) AS rows_read, count(*) FILTER (WHERE value >= 5) AS rows_kept, count(*) FILTER (WHERE value < 5) AS rows_dropped
       FROM events GROUP BY 1""",
)
def dropped_rows(t: Tables) -> DataFrame:
    return quality.dropped_rows(t.events, "event_type", F.col("value") >= 5)
