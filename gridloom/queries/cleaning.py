"""Parsing, cleaning and feature columns on the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import clean, features, parse
from gridloom.operators import quantiles
from gridloom.operators.windows import fill_forward
from gridloom.plans.alignment import estimated_demand
from gridloom.queries.registry import MIX_SQL, Tables, query, rounded


def ntz(*names: str):
    return {n: F.col(n).cast("timestamp_ntz") for n in names}


@query(
    "parse_ts_multi",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 3 THEN NULL WHEN o_orderkey % 9 = 4 THEN o_orderdate + INTERVAL 500 MILLISECOND
         ELSE o_orderdate END AS parsed FROM orders""",
)
def parse_ts_multi(t: Tables) -> DataFrame:
    form = F.col("o_orderkey") % 9
    text = (
        F.when(form == 0, F.date_format("o_orderdate", "dd/MM/yyyy HH:mm:ss"))
        .when(form == 1, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit(" +00:00")))
        .when(form == 2, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(form == 4, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit(".5")))
        .when(form == 5, F.date_format("o_orderdate", "d/M/yyyy HH:mm:ss"))
        .when(form == 6, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm"))
        .when(form == 7, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0000")))
        .when(form == 8, F.date_format("o_orderdate", "dd-MMM-yyyy"))
        .otherwise("junk")
    )
    return t.orders.select("o_orderkey", parse.timestamp_multi(text).cast("timestamp_ntz").alias("parsed"))


@query(
    "settlement_ts",
    """SELECT o_orderkey, o_orderdate + INTERVAL 30 MINUTE *
         CAST(greatest(coalesce(CASE WHEN o_orderkey % 50 = 49 THEN NULL ELSE o_orderkey % 50 END, 1), 1) - 1 AS INTEGER)
         AS instant FROM orders""",
)
def settlement_ts(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    text = (
        F.when(key % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(key % 3 == 1, F.date_format("o_orderdate", "dd-MMM-yyyy"))
        .otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    )
    period = F.when(key % 50 != 49, (key % 50).cast("int"))
    raw = t.orders.select("o_orderkey", parse.date_multi(text).alias("day"), period.alias("period"))
    return raw.select("o_orderkey", parse.settlement_instant("day", "period").cast("timestamp_ntz").alias("instant"))


@query("dayfirst_detect", "SELECT o_orderkey, o_orderdate AS parsed FROM orders")
def dayfirst_detect(t: Tables) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd")
    )
    out = parse.parse_detected(t.orders.select("o_orderkey", text.alias("d")), "d", "parsed")
    return out.select("o_orderkey", *[c.alias(n) for n, c in ntz("parsed").items()])


@query(
    "numeric_coerce",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN NULL ELSE o_totalprice END AS price FROM orders""",
)
def numeric_coerce(t: Tables) -> DataFrame:
    form = F.col("o_orderkey") % 3
    text = (
        F.when(form == 0, F.format_number("o_totalprice", 2))
        .when(form == 1, F.concat(F.lit(" "), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(" ")))
        .otherwise("abc")
    )
    return t.orders.select("o_orderkey", parse.number(text).alias("price"))


@query(
    "infer_year",
    """WITH r AS (SELECT o_custkey, o_orderkey, CASE WHEN o_custkey % 3 = 0 AND o_orderkey % 2 = 0 THEN o_orderdate END AS d
                  FROM orders)
       SELECT o_custkey, coalesce(CAST(year(arg_min(d, o_orderkey) FILTER (WHERE d IS NOT NULL)) AS VARCHAR),
         CASE WHEN o_custkey % 3 = 1 THEN '2019' ELSE 'unknown' END) AS inferred_year FROM r GROUP BY o_custkey""",
)
def infer_year(t: Tables) -> DataFrame:
    cust = F.col("o_custkey")
    raw = t.orders.select(
        "o_custkey",
        "o_orderkey",
        F.when((cust % 3 == 0) & (F.col("o_orderkey") % 2 == 0), F.date_format("o_orderdate", "yyyy-MM-dd"))
        .otherwise("n/a")
        .alias("date_text"),
        F.when(cust % 3 == 1, "demand_2019.csv").otherwise("demand.csv").alias("file"),
    )
    return parse.infer_year(raw, "o_custkey", "date_text", "file", "o_orderkey")


@query(
    "drop_nulls",
    """WITH r AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS a,
                         CASE WHEN event_id % 2 = 0 THEN NULL ELSE user_id END AS b FROM events)
       SELECT 'any' AS how, count(*) AS rows FROM r WHERE a IS NOT NULL AND b IS NOT NULL
       UNION ALL SELECT 'all', count(*) FROM r WHERE a IS NOT NULL OR b IS NOT NULL
       UNION ALL SELECT 'subset', count(*) FROM r WHERE a IS NOT NULL""",
)
def drop_nulls(t: Tables) -> DataFrame:
    key = F.col("event_id")
    raw = t.events.select(F.when(key % 3 != 0, F.col("value")).alias("a"), F.when(key % 2 != 0, F.col("user_id")).alias("b"))
    kept = [("any", clean.drop_nulls(raw)), ("all", clean.drop_nulls(raw, "all")), ("subset", clean.drop_nulls(raw, "any", ["a"]))]
    parts = [f.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(h).alias("how"), "rows") for h, f in kept]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query(
    "dedupe_keep_last",
    """SELECT minute, event_id, value FROM (SELECT date_trunc('minute', ts) AS minute, event_id, value,
         row_number() OVER (PARTITION BY date_trunc('minute', ts) ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def dedupe_keep_last(t: Tables) -> DataFrame:
    rows = t.events.select(F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute"), "event_id", "value")
    return clean.keep_last(rows, ["minute"], ["event_id"])


@query(
    "parse_fiscal",
    """SELECT o_orderkey, date_trunc('month', o_orderdate) AS month, make_date(year(o_orderdate), 4, 1) AS fiscal_start
       FROM orders""",
)
def parse_fiscal(t: Tables) -> DataFrame:
    label = F.date_format("o_orderdate", "MMM-yy")
    fiscal = F.concat(F.year("o_orderdate").cast("string"), F.lit("/"), F.date_format("o_orderdate", "yy"))
    return t.orders.select(
        "o_orderkey",
        parse.month_label(label).cast("timestamp_ntz").alias("month"),
        parse.fiscal_start(fiscal).alias("fiscal_start"),
    )


@query(
    "finite_or_null",
    "SELECT event_id, CASE WHEN event_id % 5 < 3 THEN NULL ELSE value END AS value FROM events",
)
def finite_or_null(t: Tables) -> DataFrame:
    form = F.col("event_id") % 5
    raw = (
        F.when(form == 0, float("nan")).when(form == 1, float("inf")).when(form == 2, float("-inf")).otherwise(F.col("value"))
    )
    return t.events.select("event_id", clean.finite(raw).alias("value"))


@query(
    "fill_chain",
    """WITH r AS (SELECT ts, event_id, CASE WHEN event_type = 'error' THEN value END AS v FROM events),
       f AS (SELECT *, last_value(v IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS ff,
                    first_value(v IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bf
             FROM r)
       SELECT ts, event_id, coalesce(ff, bf, 0) AS v FROM f""",
)
def fill_chain(t: Tables) -> DataFrame:
    raw = t.events.select("ts", "event_id", F.when(F.col("event_type") == "error", F.col("value")).alias("v"))
    return fill_forward(raw, "ts", ["v"], ["event_id"])


@query(
    "impute_median",
    """WITH r AS (SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE value END AS v FROM events)
       SELECT event_id, round(coalesce(v, (SELECT quantile_cont(v, 0.5) FROM r)), 6) AS v FROM r""",
)
def impute_median(t: Tables) -> DataFrame:
    raw = t.events.select("event_id", F.when(F.col("event_type") != "view", F.col("value")).alias("v"))
    return rounded(quantiles.impute_median(raw, ["v"]))


@query(
    "coalesce_chain",
    f"""WITH mix AS ({MIX_SQL})
       SELECT hour, coalesce(click, error, purchase) AS estimated_demand_mw, coalesce(purchase, view) AS total_generation_mw FROM mix""",
)
def coalesce_chain(t: Tables) -> DataFrame:
    named = t.mix().withColumnsRenamed(
        {"click": "ND", "error": "TSD", "purchase": "GENERATION", "view": "MODELLED_ONLINE_MW"}
    )
    return estimated_demand(named).select("hour", "estimated_demand_mw", "total_generation_mw")


@query(
    "row_family_sum",
    f"""WITH mix AS ({MIX_SQL})
       SELECT hour, round(coalesce(click,0)+coalesce(error,0)+coalesce(purchase,0)+coalesce(signup,0)+coalesce(view,0), 4)
         AS modelled FROM mix""",
)
def row_family_sum(t: Tables) -> DataFrame:
    names = ["click", "error", "purchase", "signup", "view"]
    flows = t.mix().withColumnsRenamed({n: f"{n}_FLOW" for n in names})
    return rounded(flows.select("hour", clean.family_sum(clean.pick_family(flows, "_flow")).alias("modelled")), 4)


@query("clamp", "SELECT event_id, greatest(5.0, least(120.0, value)) AS v FROM events")
def clamp(t: Tables) -> DataFrame:
    return t.events.select("event_id", clean.clamp("value", 5.0, 120.0).alias("v"))


@query(
    "autoscale",
    """SELECT o_orderkey, round(o_totalprice / 1000.0, 8) AS o_totalprice_scaled, 'GW' AS unit FROM orders""",
)
def autoscale(t: Tables) -> DataFrame:
    out = clean.autoscale(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice")
    return rounded(out.drop("o_totalprice"), 8)


@query(
    "format_money",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE '£' || format('{:,}', CAST(o_totalprice * 100 AS BIGINT) // 100)
         || '.' || lpad(CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') END AS cost FROM orders""",
)
def format_money(t: Tables) -> DataFrame:
    price = F.when(F.col("o_orderkey") % 6 != 0, F.col("o_totalprice"))
    return t.orders.select("o_orderkey", parse.money(price, 2).alias("cost"))


@query(
    "nominal_kv",
    """WITH p AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name
                  ELSE p_name || ' ' || (p_size + 10) || CASE WHEN p_size % 3 = 1 THEN 'kV' ELSE ' KV' END END AS site,
                  p_size FROM part)
       SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 33 ELSE p_size + 10 END AS kv FROM p""",
)
def nominal_kv(t: Tables) -> DataFrame:
    size = F.col("p_size")
    tail = F.when(size % 3 == 1, "kV").otherwise(" KV")
    site = F.when(size % 3 == 0, F.col("p_name")).otherwise(
        F.concat("p_name", F.lit(" "), (size + 10).cast("string"), tail)
    )
    return t.part.select("p_partkey", parse.nominal_kv(site).alias("kv"))


@query(
    "slugify",
    """SELECT p_partkey, trim(regexp_replace(lower(trim(p_brand || ' / ' || p_name || '!')), '[^a-z0-9]+', '_', 'g'), '_') AS slug,
         trim(regexp_replace(lower(trim(p_brand || ' / ' || p_name || '!')), '[^a-z0-9]+', '-', 'g'), '-') AS dashed FROM part""",
)
def slugify(t: Tables) -> DataFrame:
    name = F.concat("p_brand", F.lit(" / "), "p_name", F.lit("!"))
    return t.part.select("p_partkey", parse.slug(name).alias("slug"), parse.slug(name, "-", "uncategorized").alias("dashed"))


@query(
    "date_parts",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
         CAST(weekofyear(o_orderdate) AS INTEGER) AS iso_week FROM orders""",
)
def date_parts(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", *[c.alias(n) for n, c in features.date_parts("o_orderdate").items()])


@query(
    "calendar_features",
    """SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS weekday,
         CAST(month(ts) AS INTEGER) AS month, CAST((month(ts) % 12 + 3) // 3 AS INTEGER) AS season FROM events""",
)
def calendar_features(t: Tables) -> DataFrame:
    return t.events.select("event_id", *[c.alias(n) for n, c in features.calendar("ts").items()])


@query(
    "cyclical_features",
    """SELECT event_id, round(sin(2*pi()*hour(ts)/24), 6) + 0.0 AS hour_sin, round(cos(2*pi()*hour(ts)/24), 6) + 0.0 AS hour_cos,
         round(sin(2*pi()*(isodow(ts)-1)/7), 6) + 0.0 AS dow_sin, round(cos(2*pi()*(isodow(ts)-1)/7), 6) + 0.0 AS dow_cos,
         round(sin(2*pi()*month(ts)/12), 6) + 0.0 AS month_sin, round(cos(2*pi()*month(ts)/12), 6) + 0.0 AS month_cos FROM events""",
)
def cyclical_features(t: Tables) -> DataFrame:
    columns = features.cyclical("ts").items()
    return t.events.select("event_id", *[(F.round(c, 6) + 0.0).alias(n) for n, c in columns])


@query(
    "threshold_flags",
    """SELECT event_id, CAST(value < 20 AS INTEGER) AS is_low, CAST(value < 5 AS INTEGER) AS is_very_low,
         CAST(value > 120 AS INTEGER) AS is_high, CAST(value < 20 OR value > 120 AS INTEGER) AS is_event FROM events""",
)
def threshold_flags(t: Tables) -> DataFrame:
    flags = features.threshold_flags("value", 20.0, 5.0, 120.0)
    return t.events.select("event_id", *[c.alias(n) for n, c in flags.items()])


@query(
    "iso_render",
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS text FROM events""",
)
def iso_render(t: Tables) -> DataFrame:
    return t.events.select("event_id", parse.iso_z(F.when(F.col("event_id") % 4 != 0, F.col("ts"))).alias("text"))
