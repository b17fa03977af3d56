"""Pieces of the streaming jobs that need no running query."""

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from gridloom.operators.asof import Source
from gridloom.operators.events import rate_clusters
from gridloom.streaming import detector, feed, replay
from tests.test_timeorder import brute_excursions


@pytest.mark.parametrize("start_rows,end_rows", [(1, 1), (1, 3), (2, 2), (3, 4)])
@pytest.mark.parametrize("batches", [1, 3, 40])
def test_detector_state_equals_the_row_rule(start_rows, end_rows, batches):
    rng = np.random.default_rng(start_rows * 10 + end_rows)
    for _ in range(20):
        n = 120
        beyond = rng.random(n) < rng.choice([0.2, 0.5, 0.8])
        at = 1 + np.arange(n) * 1_000_000
        state = dict(active=False, start_us=0, beyond_rows=0, inside_rows=0, run_us=0, last_us=0)
        got = []
        for part in np.array_split(np.arange(n), batches):
            order = rng.permutation(part)
            for run in detector.runs_of(at[order], beyond[order]):
                closed = detector.advance(state, run, start_rows, end_rows)
                if closed:
                    got.append(closed)
        if state["active"]:
            got.append((state["start_us"], state["last_us"]))
        pdf = pd.DataFrame({"ts": pd.to_datetime(at, unit="us"), "value": np.where(beyond, 0.0, 1.0)})
        want = brute_excursions(pdf, 0.5, start_rows, end_rows, 0)
        assert [tuple(pd.to_datetime(list(g), unit="us")) for g in got] == want


def test_feed_is_complete_and_in_order(spark, many_slices):
    pdf = pd.DataFrame({"ts": pd.date_range("2024-01-30", periods=400, freq="h"), "v": range(400)})
    df = spark.createDataFrame(pdf)
    path = feed.write_feed(df, "ts", chunks=3)
    back = spark.read.parquet(path)
    assert back.count() == 401 and back.where("v is null").count() == 1
    stream = feed.read_feed(spark, path, df.schema, files_per_batch=2)
    found = feed.run_to_end(feed.seek(stream, "ts", "2024-02-10 00:00:00").drop("year", "month"), "seek-test")
    want = (pdf["ts"] >= pd.Timestamp("2024-02-10")).sum()
    assert found.where("v is not null").count() == want


def samples(n=240, seed=4):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({
        "ts": pd.Timestamp("2024-03-01") + pd.to_timedelta(np.sort(rng.integers(0, 4000, n)), unit="s"), "tie": np.arange(n),
        "site": rng.choice(["a", "b", "c"], n, p=[0.7, 0.2, 0.1]), "value": rng.choice([0.0, 0.1, 5.0, 9.0], n)})


SCHEMA = "ts timestamp, tie long, site string, value double"


def land(spark, part, folder):
    """One more file in a folder; the file source goes by modification time."""
    rows = [(r.ts.to_pydatetime(), int(r.tie), r.site, None if pd.isna(r.value) else float(r.value)) for r in part.itertuples()]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def brute_clusters(pdf, delta, gap_s):
    out = []
    for site, rows in pdf.sort_values(["ts", "tie"]).groupby("site"):
        rows = rows.dropna(subset=["value"])
        jump = rows["value"].diff().abs()
        hit = rows[jump > delta].assign(jump=jump[jump > delta])
        group = (hit["ts"].diff().dt.total_seconds() > gap_s).cumsum()
        out += [(site, g["ts"].min(), g["ts"].max(), len(g), g["jump"].max()) for _, g in hit.groupby(group)]
    return sorted(out)


def test_jump_clusters_in_any_order_of_arrival(spark, tmp_path):
    """Rows come out of order, within the watermark's delay; the clusters are those of the batch operator."""
    pdf = samples()
    pdf.loc[::17, "value"] = np.nan
    rng = np.random.default_rng(5)
    late = pdf["ts"] + pd.to_timedelta(rng.integers(0, 500, len(pdf)), unit="s")
    end = pd.DataFrame({"ts": [pdf["ts"].max() + pd.Timedelta(days=2)], "tie": [0], "site": [None], "value": [None]})
    parts = [pdf.loc[i] for i in np.array_split(late.sort_values().index.to_numpy(), 9)]
    for part in [*parts, end]:
        land(spark, part, tmp_path / "in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = detector.stream_jump_clusters(stream, "ts", "site", "value", 3.0, 60.0, "20 minutes", tie="tie")
    got = feed.run_to_end(found, "jumps").toPandas()
    want = brute_clusters(pdf, 3.0, 60.0)
    assert sorted(got.itertuples(index=False, name=None)) == want
    again = []
    for site, rows in pdf.dropna().groupby("site"):
        batch = rate_clusters(spark.createDataFrame(rows), "ts", "value", 3.0, 60.0, tie=["tie"])
        again += [(site, r["start"], r["end"], r["points"]) for r in batch.select("start", "end", "points").collect()]
    assert sorted(again) == [(s, a.to_pydatetime(), b.to_pydatetime(), n) for s, a, b, n, _ in want]


def test_streams_go_on_where_they_ended(spark, tmp_path):
    """Two runs over the same folders give what one run gives."""
    pdf = samples(120, 6).drop_duplicates("ts").reset_index(drop=True)
    table = spark.createDataFrame(pdf, SCHEMA)
    other = table.select(F.col("ts").alias("r_ts"), (F.col("value") + 1).alias("r_value")).where("value > 4")
    cut = len(pdf) // 3

    def source():
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withColumn(
            feed.FILE, F.col("_metadata.file_path"))

    runs = {
        "rocof": lambda s, **k: replay.stream_rocof(s, "ts", "value", **k),
        "enrich": lambda s, **k: replay.stream_enrich(s.drop(feed.FILE), "ts", [Source(other, "r_ts", ["r_value"], "m_", tolerance=900.0)], **k),
        "append": lambda s, **k: replay.stream_append(s, ["site", "value"], **k),
    }
    got = {}
    for lo, hi in ((0, cut), (cut, 2 * cut), (2 * cut, len(pdf))):
        land(spark, pdf.iloc[lo:hi], tmp_path / "in")
        if hi == cut:
            continue  # two files wait for the first run, one for the second
        for name, run in runs.items():
            got[name] = sorted(map(repr, run(source(), out=f"{tmp_path}/{name}", state=f"{tmp_path}/{name}-state").collect()))
    for name, run in runs.items():
        assert got[name] == sorted(map(repr, run(source()).collect())) and got[name]


def test_signatures_are_forgotten_behind_the_watermark(spark, tmp_path):
    schema = "ts timestamp, v long"
    for day in ("2024-01-01", "2024-01-01", "2024-01-05", "2024-01-09", "2024-01-09"):
        spark.createDataFrame([(pd.Timestamp(day).to_pydatetime(), 1)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withColumn(feed.FILE, F.lit("f"))
    assert replay.stream_append(stream, ["v"]).count() == 1
    # Spark forgets a batch later.
    assert 1 < replay.stream_append(stream, ["v"], within=("ts", "1 day")).count() < 5
