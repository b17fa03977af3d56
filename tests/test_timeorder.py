"""Ordered operators on many small slices, with a third of the rows on one instant, against pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.operators import events, sampling, timeorder, windows
from gridloom.operators.sampling import chronological_split, even_downsample, row_stride
from gridloom.operators.timeorder import micros, plan_slices
from gridloom.plans import alignment

N = 1500


@pytest.fixture(scope="module")
def crowd(spark):
    """Signal with gaps; 500 rows share one instant, and another 100 a second one."""
    rng = np.random.default_rng(7)
    seconds = np.sort(rng.integers(0, 5000, N))
    seconds[400:900] = seconds[400]
    seconds[1200:1300] = seconds[1200]
    pdf = pd.DataFrame(
        {
            "ts": pd.Timestamp("2024-03-01") + pd.to_timedelta(np.sort(seconds), unit="s"),
            "id": np.arange(N),
            "value": np.round(50 + rng.normal(0, 1, N), 3),
        }
    )
    shuffled = pdf.sample(frac=1, random_state=1)
    return pdf, spark.createDataFrame(shuffled).repartition(5)


def collect(df, order=("ts", "id")):
    return df.toPandas().sort_values(list(order)).reset_index(drop=True)


def test_crowded_instant_is_cut_again(crowd, many_slices):
    _, df = crowd
    slices = plan_slices(df, micros("ts"), "id", count=True)
    assert slices.crowded and sum(slices.counts) == N
    assert max(slices.counts) < N / 6
    numbered = collect(slices.assign(df, micros("ts"), "id"))
    assert numbered["_slice"].is_monotonic_increasing


def test_lags_and_rolling(crowd, many_slices):
    pdf, df = crowd
    got = collect(windows.rolling_stats(df, "ts", "value", (5, 120), (1, 30), ["id"]))
    v = pdf["value"]
    np.testing.assert_allclose(got["diff_30"], v.diff(30))
    np.testing.assert_allclose(got["roll120_max"], v.rolling(120, min_periods=40).max())
    np.testing.assert_allclose(got["roll5_std"], v.rolling(5, min_periods=2).std(), atol=1e-9)
    lagged = collect(windows.lag_features(df, "ts", "value", tie=["id"]))
    want = pd.DataFrame({"a": v.shift(1), "b": v.shift(5), "m": v.rolling(10, min_periods=1).mean()}).dropna()
    np.testing.assert_allclose(lagged[["lag_1", "lag_5", "rolling_mean_10"]], want)
    q = collect(windows.rolling_quantile_excess(df, "ts", "value", 336, 48, tie=["id"]))
    np.testing.assert_allclose(q["rolling_q"].astype(float), v.rolling(336, min_periods=48).quantile(0.95))


def test_halo_reaches_over_short_slices(spark, many_slices):
    pdf = pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=300, freq="s"), "id": range(300)})
    pdf["value"] = pdf["id"].astype(float)
    got = collect(windows.lag_features(spark.createDataFrame(pdf), "ts", "value", (1, 90), 100, ["id"]))
    assert (got["lag_90"] == got["value"] - 90).all()
    want = pdf["value"].rolling(100, min_periods=1).mean()[90:]
    np.testing.assert_allclose(got["rolling_mean_100"], want)


def test_fill(crowd, many_slices):
    pdf, df = crowd
    holes = df.withColumn("value", F.when(F.col("id") % 97 == 60, F.col("value")))
    got = collect(windows.fill_forward(holes, "ts", ["value"], ["id"]))
    want = pdf["value"].where(pdf["id"] % 97 == 60).ffill().bfill().fillna(0)
    np.testing.assert_allclose(got["value"], want)
    empty = collect(windows.fill_forward(df.withColumn("value", F.lit(None).cast("double")), "ts", ["value"], ["id"]))
    assert (empty["value"] == 0).all()


def test_running_sum_and_index(crowd):
    pdf, df = crowd
    got = collect(windows.running_sum(df, ["ts", "id"], "value", "run"))
    np.testing.assert_allclose(got["run"], pdf["value"].cumsum())
    index = collect(timeorder.row_index(df, ["ts", "id"]))
    assert (index["row_no"] == np.arange(N)).all()


def test_positions_in_a_hot_group(spark):
    pdf = pd.DataFrame({"k": ["hot"] * 400 + [None] * 50 + list("abcde") * 30, "id": range(600)})
    got = timeorder.position_in_group(spark.createDataFrame(pdf), ["k"], ["id"]).toPandas().sort_values("id")
    want = pdf.groupby("k", dropna=False).cumcount()
    assert (got["row_no"].to_numpy() == want.to_numpy()).all()


@pytest.mark.parametrize("k", [1, 2, 7, 100, 1499, 1500, 4000])
def test_even_downsample(crowd, k):
    pdf, df = crowd
    got = collect(even_downsample(df, ["ts", "id"], k))
    want = range(N) if k >= N else sorted({i * (N - 1) // max(k - 1, 1) for i in range(k)})
    assert got["id"].tolist() == list(want)


def test_stride_and_split(crowd):
    pdf, df = crowd
    assert collect(row_stride(df, ["ts", "id"], 8))["id"].tolist() == list(range(0, N, 8))
    parts = chronological_split(df, ["ts", "id"], 0.8).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in parts} == {"train": 1200, "test": 300}


def brute_excursions(pdf, low, start_rows, end_rows, min_s):
    """The rule stated row by row."""
    found, start, below, back = [], None, 0, 0
    times, values = pdf["ts"].tolist(), pdf["value"].tolist()
    for i, v in enumerate(values):
        if v < low:
            below, back = below + 1, 0
            if start is None and below >= start_rows:
                start = i - start_rows + 1
            continue
        below = 0
        if start is None:
            continue
        back += 1
        if back >= end_rows:
            found.append((times[start], times[i - end_rows + 1]))
            start, back = None, 0
    if start is not None:
        found.append((times[start], times[-1]))
    return [(a, b) for a, b in found if int((b - a).total_seconds()) >= min_s]


@pytest.mark.parametrize("start_rows,end_rows", [(1, 1), (1, 3), (2, 3), (3, 2)])
def test_excursions(crowd, many_slices, start_rows, end_rows):
    pdf, df = crowd
    got = events.excursions(df, low=49.8, start_rows=start_rows, end_rows=end_rows, min_duration_s=1, tie=["id"])
    rows = sorted((r["start"], r["end"]) for r in got.collect())
    assert rows == sorted(brute_excursions(pdf, 49.8, start_rows, end_rows, 1))


def test_excursions_over_and_periods(crowd, many_slices):
    pdf, df = crowd
    got = events.excursions(df, high=50.4, mode="over", min_duration_s=0, period=F.floor(F.minute("ts") / 20), tie=["id"])
    mirrored = pdf.assign(value=-pdf["value"])
    want = []
    for _, part in mirrored.groupby(pdf["ts"].dt.minute // 20 + pdf["ts"].dt.hour * 3):
        want += brute_excursions(part.reset_index(drop=True), -50.4, 1, 3, 0)
    assert sorted((r["start"], r["end"]) for r in got.collect()) == sorted(want)


def test_breach_windows_flip_and_crowd(crowd, many_slices):
    pdf, df = crowd
    got = events.breach_windows(df, low=49.5, high=50.5, tie=["id"])
    side = np.where(pdf["value"] < 49.5, "under", np.where(pdf["value"] > 50.5, "over", ""))
    run = pd.Series(side).ne(pd.Series(side).shift()).cumsum()
    want = []
    for _, part in pdf.assign(side=side).groupby(run):
        if part["side"].iloc[0]:
            want.append((part["side"].iloc[0], part["ts"].min(), part["ts"].max(), len(part)))
    rows = [(r["breach_type"], r["start"], r["end"], r["points"]) for r in got.collect()]
    assert sorted(rows) == sorted(want)


def test_one_long_run_spans_every_slice(spark, many_slices):
    pdf = pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=500, freq="s"), "value": 48.0})
    rows = events.low_value_events(spark.createDataFrame(pdf)).collect()
    assert len(rows) == 1 and rows[0]["points"] == 500 and rows[0]["duration_s"] == 499


def test_rate_clusters(crowd, many_slices):
    pdf, df = crowd
    got = events.rate_clusters(df, delta=1.5, gap_s=10.0, tie=["id"])
    hits = pdf.assign(jump=pdf["value"].diff())
    hits = hits[hits["jump"].abs() > 1.5]
    number = (hits["ts"].diff().dt.total_seconds() > 10).cumsum()
    want = hits.groupby(number).agg(start=("ts", "min"), end=("ts", "max"), peak=("jump", lambda j: j.abs().max()))
    rows = sorted((r["start"], r["end"], round(r["peak_rocof"], 9)) for r in got.collect())
    assert rows == sorted((r.start, r.end, round(r.peak, 9)) for r in want.itertuples())


def test_rocof_leaves_out_equal_instants(crowd, many_slices):
    pdf, df = crowd
    got = windows.rocof(df, tie=["id"]).toPandas().sort_values("sample_end_ts")
    dt = pdf["ts"].diff().dt.total_seconds()
    want = (pdf["value"].diff() / dt)[dt > 0]
    np.testing.assert_allclose(got["rocof_hz_per_s"], want)


def test_empty_input(spark, many_slices):
    empty = spark.createDataFrame([], "ts timestamp, id long, value double")
    assert windows.rocof(empty, tie=["id"]).count() == 0
    assert events.breach_windows(empty, tie=["id"]).count() == 0
    assert events.excursions(empty, tie=["id"]).count() == 0
    assert windows.fill_forward(empty, "ts", ["value"], ["id"]).count() == 0
    assert windows.rolling_stats(empty, "ts", "value", tie=["id"]).count() == 0


def test_cadence_counts_every_site_and_step(spark):
    from gridloom.operators.stats import cadence

    rows = [(s, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=(s + 1) * 600 * i)) for s in range(20) for i in range(40)]
    got = cadence(spark.createDataFrame(rows, "site int, ts timestamp"), "site", "ts").first()
    assert got["median_s"] == 10.5 * 600 and got["period_s"] == 21600
    few = cadence(spark.createDataFrame(rows, "site int, ts timestamp"), "site", "ts", sites=1, steps=3).first()
    assert few["median_s"] == 600 and few["period_s"] == 1800
    assert cadence(spark.createDataFrame([], "site int, ts timestamp"), "site", "ts").first()["period_s"] == 1800


@pytest.fixture(scope="module")
def named_crowd(crowd, spark):
    """The same signal with text ties that share a long beginning; some are missing, and so are some times."""
    pdf, _ = crowd
    named = pdf.assign(name=[None if i % 50 == 7 else f"site/öst/meter-{i:06d}" for i in range(N)])
    named = named.assign(ts=[None if i % 9 == 4 else t for i, t in enumerate(named["ts"])])
    shuffled = named.sample(frac=1, random_state=2)
    rows = [(None if pd.isna(t) else t.to_pydatetime(), i, v, n) for t, i, v, n in shuffled.itertuples(index=False)]
    return named, spark.createDataFrame(rows, "ts timestamp, id long, value double, name string").repartition(5)


def in_order(pdf, nulls):
    missing = -1 if nulls == "first" else 1
    rows = pdf.to_dict("records")
    rows.sort(key=lambda r: (missing * pd.isna(r["ts"]), 0 if pd.isna(r["ts"]) else r["ts"].value,
                             missing * (r["name"] is None), r["name"] or "", r["id"]))
    return [r["id"] for r in rows]


def test_text_tie_cuts_a_crowd(named_crowd, many_slices):
    named, df = named_crowd
    slices = plan_slices(df, micros("ts"), "name", count=True)
    assert slices.crowded and all(skip >= len("site/öst/meter-0".encode()) for _, _, skip in slices.crowded)
    timed = named[named["ts"].notna()]
    assert sum(slices.counts) == len(timed) and max(slices.counts) < N / 6
    got = collect(windows.lag_features(df, "ts", "value", (1,), 1, ["name", "id"]), ["id"])
    values = dict(zip(named["id"], named["value"]))
    order = [i for i in in_order(named, "first") if pd.notna(named["ts"][i])]
    before = {b: values[a] for a, b in zip(order, order[1:])}
    assert len(got) == len(before) and all(before[r.id] == r.lag_1 for r in got.itertuples())


def test_positions_with_missing_times_and_ties(named_crowd, many_slices):
    named, df = named_crowd
    want = {i: at for at, i in enumerate(in_order(named, "last"))}
    order = ["ts", "name", "id"]
    index = timeorder.row_index(df, order).toPandas()
    assert len(index) == N and all(want[r.id] == r.row_no for r in index.itertuples())
    by_text = timeorder.row_index(df, ["name", "id"]).toPandas().sort_values("row_no")
    missing_last = sorted(range(N), key=lambda i: (named["name"][i] is None, named["name"][i] or "", i))
    assert by_text["id"].tolist() == missing_last
    groups = df.withColumn("k", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 != 0, F.concat(F.lit("k"), F.col("id") % 5)))
    seen, place = {}, {}
    keys = {r["id"]: r["k"] for r in groups.select("id", "k").collect()}
    for i in in_order(named, "last"):
        place[i] = seen[keys[i]] = seen.get(keys[i], -1) + 1
    got = timeorder.position_in_group(groups, ["k"], order).toPandas()
    assert len(got) == N and all(place[r.id] == r.row_no for r in got.itertuples())


@pytest.mark.parametrize("n", [0, 1, 333, 1400, N, 5000])
def test_large_selections_equal_small_ones(named_crowd, many_slices, monkeypatch, n):
    named, df = named_crowd
    order, first = ["ts", "name", "id"], in_order(named, "first")
    drawn = sorted(r["id"] for r in sampling.sample_rows(df, n, ["id"]).collect())
    monkeypatch.setattr(sampling, "HEAP_ROWS", -1)
    assert sorted(r["id"] for r in sampling.head_rows(df, order, n).collect()) == sorted(first[:n])
    assert [r["id"] for r in sampling.tail_rows(df, order, n).collect()] == first[max(N - n, 0):]
    assert sorted(r["id"] for r in sampling.sample_rows(df, n, ["id"]).collect()) == drawn


def test_selections_write_nothing_and_skip_slices(crowd, many_slices, monkeypatch):
    def refuse(*_):
        raise AssertionError("a selection by counts writes no table")

    _, df = crowd
    monkeypatch.setattr(timeorder, "settle", refuse)
    assert chronological_split(df, ["ts", "id"], 0.8).where("part = 'train'").count() == 1200
    assert row_stride(df.withColumn("k", F.col("id") % 2), ["ts", "id"], 8, "k").count() == 188
    assert even_downsample(df, ["ts", "id"], 3).count() == 3
    plan = even_downsample(df, ["ts", "id"], 3)._jdf.queryExecution().optimizedPlan().toString()
    assert " IN (" in plan or "INSET" in plan
    assert even_downsample(df.limit(0), ["ts", "id"], 3).count() == 0


def test_shared_cuts_take_the_tie(crowd, spark, many_slices):
    pdf, df = crowd
    context = spark.createDataFrame(pdf[["ts", "value"]].drop_duplicates("ts").iloc[::7])
    slices = alignment.shared_slices(df, "ts", context, "ts", ["id"])
    assert slices.crowded and max(slices.counts) < N / 6
    aligned = alignment.aligned_rocof(df, context, "ts", "value", "ts", ["value"], tie=["id"]).toPandas()
    assert len(aligned) == pdf["ts"].nunique() - 1
