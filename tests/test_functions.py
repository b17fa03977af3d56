"""Edge cases of parsing, cleaning, quality jobs, sinks and statistics."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.functions import clean, parse, physics
from gridloom.operators import quality, resample, stats
from gridloom.operators.quantiles import quantiles
from gridloom.sources import ingest, sink


def one(spark, column, value="x"):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("o")).first()["o"]


@pytest.mark.parametrize(
    "text,want",
    [
        ("13/02/2024 01:02:03", dt.datetime(2024, 2, 13, 1, 2, 3)),
        ("2024-02-13 01:02:03 +00:00", dt.datetime(2024, 2, 13, 1, 2, 3)),
        ("2024-02-13T01:02:03Z", dt.datetime(2024, 2, 13, 1, 2, 3)),
        (" 2024-02-13 ", dt.datetime(2024, 2, 13)),
        ("2024-02-31", None),
        ("", None),
        ("junk", None),
    ],
)
def test_timestamps(spark, text, want):
    assert one(spark, parse.timestamp_multi("v"), text) == want


def test_settlement(spark):
    for period, minutes in (("0", 0), ("1", 0), ("48", 1410), ("50", 1470), (None, 0), ("x", 0), ("NaN", 0), ("2.0", 30)):
        made = parse.settlement_instant(parse.date_multi(F.lit("13-Feb-2024")), F.lit(period))
        assert one(spark, made) == dt.datetime(2024, 2, 13) + dt.timedelta(minutes=minutes)


@pytest.mark.parametrize("text,want", [("1,234", 1234.0), (" 5 ", 5.0), ("abc", None), ("1e3", 1000.0), ("", None)])
def test_numbers(spark, text, want):
    assert one(spark, parse.number("v"), text) == want


def test_finite_and_clamp(spark):
    for value in (float("nan"), float("inf"), float("-inf")):
        assert one(spark, clean.finite(F.lit(value))) is None
    assert one(spark, clean.clamp(F.lit(None).cast("double"), 0.0, 1.0)) is None
    assert one(spark, clean.clamp(F.lit(7.0), 0.0, 1.0)) == 1.0


def test_labels(spark):
    assert one(spark, parse.month_label(F.lit("Apr-23"))) == dt.datetime(2023, 4, 1)
    assert one(spark, parse.month_label(F.lit("Dec-99"))) == dt.datetime(1999, 12, 1)
    assert one(spark, parse.fiscal_start(F.lit("2022/23"))) == dt.date(2022, 4, 1)
    assert one(spark, parse.fiscal_start(F.lit("n/a"))) is None
    assert one(spark, parse.money(F.lit(-1234567.4))) == "£-1,234,567"
    assert one(spark, parse.money(F.lit(None).cast("double"))) == ""
    assert one(spark, parse.slug(F.lit("  Grid Supply / 33 kV "), "-")) == "grid-supply-33-kv"
    assert one(spark, parse.nominal_kv(F.lit("West 132 KV"))) == 132
    assert one(spark, parse.file_month(F.lit("f-2021-3.csv"))) == 202103


@pytest.mark.parametrize(
    "text,want",
    [
        ("Meter No.", "meter_id"),
        ("Date/Time", "date_time"),
        ("Load (%)", "load_percent"),
        ("Site Site Name", "site_name"),
        ("DateTime", "timestamp"),
        ("£££", ""),
        ("", ""),
    ],
)
def test_snake(spark, text, want):
    assert one(spark, quality.snake("v"), text) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("  no NO num# (Dt) dttm no! no", "id_timestamp_no_id"),
        ("\tA\n\n a  B.b_c\u00a0d é e\u0130", "a_b_b_cd_ei"),
        ("% %", "percent"),
        (None, None),
    ],
)
def test_snake_odd_words(spark, text, want):
    assert one(spark, quality.snake("v"), text) == want


def test_header_expressions_are_computed_once(spark):
    """The words of a header stood in the plan once more for every look at the word before, which ran them for each word again."""
    raw = spark.createDataFrame([("Meter No.",)], "v string")
    for column in (quality.snake("v"), quality.dtype_hint("v", quality.snake("v"))):
        plan = raw.select(column.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(") == 1


def test_unique_headers(spark):
    rows = spark.createDataFrame([("d", i, h) for i, h in enumerate(["a", "b", "a", "", "a", None])], "d string, p int, h string")
    got = quality.unique_headers(rows, "d", "h", "p").orderBy("p").collect()
    assert [r["unique_name"] for r in got] == ["a", "b", "a__2", "unnamed", "a__3", "unnamed__2"]


def test_iso_year_edges(spark, tmp_path):
    days = [dt.datetime(2024, 12, 30), dt.datetime(2021, 1, 3), None]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "i int, d timestamp")
    path = str(tmp_path / "w")
    sink.write_year_week(df, path, "d", "a.csv")
    got = {r["i"]: (r["year"], r["week"]) for r in sink.read_year_week(spark, path).collect()}
    assert got == {0: ("2024", "01"), 1: ("2021", "53"), 2: ("unknown", "00")}
    sink.write_year_week(df.where("i = 0"), path, "d", "a.csv", whole=False)
    assert sink.read_year_week(spark, path).count() == 3


def test_sources_of_one_week_stand_side_by_side(spark, tmp_path):
    path = str(tmp_path / "w")
    july = spark.createDataFrame([(1, dt.datetime(2024, 7, 30))], "i int, d timestamp")
    august = spark.createDataFrame([(2, dt.datetime(2024, 8, 1)), (3, dt.datetime(2024, 8, 2))], "i int, d timestamp")
    for rows, source in ((july, "f-2024-7.csv"), (august, "f-2024-8.csv"), (august, "f-2024-8.csv"), (july, "f-2024-7.csv")):
        sink.write_year_week(rows, path, "d", source, "NESO data")
    back = sink.read_year_week(spark, path)
    assert sorted(r["i"] for r in back.collect()) == [1, 2, 3]
    assert {(r["week"], r["database"]) for r in back.collect()} == {("31", "NESO_data")}


@pytest.mark.parametrize("ts", [None, "d"])
def test_fallback_year(spark, tmp_path, ts):
    df = spark.createDataFrame([(1, None)], "i int, d timestamp")
    sink.write_year_week(df, str(tmp_path / "w"), ts, "x", fallback_year=2019)
    assert [(r["year"], r["week"]) for r in sink.read_year_week(spark, str(tmp_path / "w")).collect()] == [("2019", "00")]


def test_csv_lines_of_all_lengths(spark, tmp_path):
    (tmp_path / "f.csv").write_text('a, b ,c\n1,2,3\n4,5\n6\n7,8,9,10\n"x,y", "q""z",3\n,,\n')
    raw = ingest.read_text_csv(spark, str(tmp_path / "f.csv"))
    assert raw.columns == ["a", "b", "c"]
    want = [("1", "2", "3"), ("4", "5", None), ("6", None, None), ("x,y", 'q"z', "3"), (None, None, None)]
    assert sorted(map(tuple, raw.collect()), key=str) == sorted(want, key=str)
    assert raw.count() == len(want) == raw.select("a").count() == len(raw.select("c").collect())
    (tmp_path / "m.csv").write_text('a,b\n1,"two\nlines"\n3,4\n')
    assert ingest.read_text_csv(spark, str(tmp_path / "m.csv"), multi_line=True).count() == 2
    (tmp_path / "l.csv").write_bytes("a,b\n1,caf\xe9\n".encode("latin-1"))
    assert ingest.read_text_csv(spark, str(tmp_path / "l.csv"), encoding="ISO-8859-1").first()["b"] == "café"


def test_chunks_or_the_whole_file(spark, tmp_path):
    (tmp_path / "whole.csv").write_text("timestamp,x\n")
    assert ingest.chunk_paths(spark, str(tmp_path), "part_*.csv", "whole.csv").endswith("whole.csv")
    (tmp_path / "part_1.csv").write_text("timestamp,x\n")
    assert ingest.chunk_paths(spark, str(tmp_path), "part_*.csv", "whole.csv").endswith("part_*.csv")


@pytest.mark.parametrize("text, want", [
    ("2024-01-02T03:04:05.123Z", dt.datetime(2024, 1, 2, 3, 4, 5, 123000)),
    ("2024-01-02 03:04:05.5", dt.datetime(2024, 1, 2, 3, 4, 5, 500000)),
    ("1/2/2024 03:04:05", dt.datetime(2024, 2, 1, 3, 4, 5)),
    ("2024-01-02T03:04", dt.datetime(2024, 1, 2, 3, 4)),
    ("2024-01-02T03:04:05+0000", dt.datetime(2024, 1, 2, 3, 4, 5)),
    ("2024-01-02 05:04:05 +0200", dt.datetime(2024, 1, 2, 3, 4, 5)),
    ("01-Feb-2024", dt.datetime(2024, 2, 1)), ("1-feb-2024", dt.datetime(2024, 2, 1)),
    ("2024/1/2", dt.datetime(2024, 1, 2)), ("3-4-2024", dt.datetime(2024, 4, 3)),
    ("12", None), ("2024-13-02", None), ("nothing", None), ("", None),
])
def test_general_timestamps(spark, text, want):
    got = one(spark, parse.timestamp_multi("v").cast("timestamp_ntz"), text)
    assert got == want


def test_append_is_idempotent_and_header_grows(spark, tmp_path):
    path = str(tmp_path / "h")
    first = spark.createDataFrame([("1", "a"), ("1", " a "), ("2", "b")], "x string, y string")
    history = sink.append_history(spark, path, first, None)
    history = sink.append_history(spark, path, first, history)
    assert history.count() == 2
    wider = spark.createDataFrame([("1", "a", "new"), ("2", "b", "")], "x string, y string, z string")
    history = sink.append_history(spark, path, wider, history)
    assert history.columns == ["x", "y", "z"] and history.count() == 3


def test_infer_types(spark):
    raw = spark.createDataFrame(
        [("2024-01-01", "1,000", "a", None), ("2024-01-02", "1", "b", None), ("bad", "2", "c", None), (None, "3", None, "7"),
         ("2024-01-05", "4", "5", None), (None, None, None, None)],
        "run_date string, amount string, note string, blank string",
    )
    out = ingest.infer_rows(raw)
    assert [t for _, t in out.dtypes] == ["timestamp", "double", "string", "double"]
    assert out.count() == 5


def test_width_bins_edges_and_constant(spark):
    df = spark.createDataFrame([(float(i), float(i)) for i in range(0, 21)], "x double, y double")
    rows = {r["bin"]: r["count"] for r in stats.width_bins(df, "x", "y", 20).collect()}
    assert rows[1] == 2 and all(rows[i] == 1 for i in range(2, 21))
    for constant in (5.0, 0.0):
        flat = stats.width_bins(df.withColumn("x", F.lit(constant)), "x", "y", 4)
        assert sum(r["count"] for r in flat.collect()) == 21


def test_quantile_bins_need_variety(spark):
    df = spark.range(300).select((F.col("id") % 3).cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    assert stats.quantile_bins(df, "x", "y").count() == 0


def test_resample_shows_gaps(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 5), 1.0), (dt.datetime(2024, 1, 1, 2, 5), 3.0)], "ts timestamp, v double")
    rows = resample.resample(df, "ts", 3600, ["v"], ["v"]).orderBy("bucket").collect()
    assert [r["v_mean"] for r in rows] == [1.0, None, 3.0] and [r["v_sum"] for r in rows] == [1.0, 0.0, 3.0]


def test_bracketed_quantiles_are_exact(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": ["hot"] * 4000 + ["cold"] * 2000, "v": np.r_[rng.normal(size=2000), np.zeros(2000), rng.normal(size=2000)]})
    probs, names = [0.0, 0.05, 0.5, 0.731, 0.95, 1.0], list("abcdef")
    got = quantiles(spark.createDataFrame(pdf), F.col("v"), probs, names, ["k"]).collect()
    for r in got:
        want = pdf[pdf["k"] == r["k"]]["v"].quantile(probs)
        np.testing.assert_allclose([r[n] for n in names], want, rtol=1e-12, atol=1e-15)


def test_quantiles_of_groups_of_all_sizes(spark):
    rng = np.random.default_rng(2)
    sizes = [1, 2, 3, 5, 8, 30, 600, 700, 3000]
    pdf = pd.DataFrame({"k": np.repeat(sizes, sizes), "v": rng.normal(size=sum(sizes))})
    probs, names = [0.0, 0.05, 0.5, 0.95, 1.0], list("abcde")
    got = {r["k"]: r for r in quantiles(spark.createDataFrame(pdf), F.col("v"), probs, names, ["k"]).collect()}
    assert len(got) == len(sizes)
    for k in sizes:
        np.testing.assert_allclose([got[k][n] for n in names], pdf[pdf["k"] == k]["v"].quantile(probs), rtol=1e-12, atol=1e-15)


def test_medians_by_brackets(spark):
    from gridloom.operators import quantiles as q

    df = spark.range(101).select((F.col("id") * 1.5).alias("a"), F.when(F.col("id") < 4, F.col("id")).alias("b"), F.lit(None).cast("double").alias("c"))
    assert q.medians(df, ["a", "b", "c"]) == {"a": 75.0, "b": 1.5, "c": None}


def test_wide_files(spark):
    lines = [
        ("f", 1, "Title,,"), ("f", 2, "Units,MW,MVAr"), ("f", 3, "Time,North St.,North St."),
        ("f", 4, "2024-01-01 00:00:00,1.5,2"), ("f", 5, "2024-01-01 00:30:00,x,3"),
        ("g", 1, "2024-01-01 00:00:00,7,8"),
    ]
    out = ingest.wide_load_rows(spark.createDataFrame(lines, "file string, line_no int, line string"))
    got = {(r["file"], r["ts"].minute, r["name"]): r["value"] for r in out.collect()}
    assert got[("f", 0, "north_st_mw")] == 1.5 and got[("f", 30, "north_st_mvar")] == 3.0
    assert got[("f", 30, "north_st_mw")] is None


def test_no_limit_gives_no_inertia(spark):
    assert one(spark, physics.required_inertia(F.lit(100.0), F.lit(0.0))) is None


def test_contract_rows_keep_going_on_bad_numbers(spark):
    raw = spark.createDataFrame([("2024-01-01", "7", "1.5"), ("2024-01-02", "NaN", "x"), ("bad", "1", "1")], "d string, n string, m string")
    out = ingest.contract_rows(raw, {"d": "string", "n": "integer"}, parse.date_multi("d")).orderBy("d").collect()
    assert [(r["n"], r["m"]) for r in out] == [(7, 1.5), (None, None)]


def test_h_overrides():
    assert physics.check_h_table({"GAS": (1, 2, 3)})["GAS"] == (1.0, 2.0, 3.0)
    with pytest.raises(ValueError):
        physics.check_h_table({"GAS": (3, 2, 1)})


def test_quadratic_fit(spark):
    df = spark.range(200).select(F.col("id").cast("double").alias("x")).withColumn("y", 3 + 2 * F.col("x") - 0.5 * F.col("x") ** 2)
    for r in stats.quadratic_fit(df, "x", "y", 10).collect():
        assert math.isclose(r["fit"], 3 + 2 * r["x"] - 0.5 * r["x"] ** 2, abs_tol=1e-6)


def test_calibration_guards(spark):
    flat = spark.range(50).select(F.lit(1.0).alias("x"), F.col("id").cast("double").alias("y"))
    row = stats.calibration(flat, "x", "y").first()
    assert row["points"] == 50 and row["slope"] is None
    assert stats.calibration(flat.limit(3), "x", "y").first()["r2"] is None


def test_bump_patch():
    assert quality.bump_patch("1.0.4", True) == "1.0.5" and quality.bump_patch("1.0.4", False) == "1.0.4"
