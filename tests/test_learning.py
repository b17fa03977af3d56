"""Fits against numpy, or against bounds that any right fit meets."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from gridloom.plans import learning

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    """A linear target with noise, one with a step, rows with gaps and values that aren't finite."""
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.normal(0, 1, (900, 3)), columns=FEATURES)
    pdf["ts"] = pd.date_range("2024-01-01", periods=900, freq="min")
    pdf["y"] = 3 + 2 * pdf["a"] - pdf["b"] + 0.5 * pdf["c"] + rng.normal(0, 0.3, 900)
    pdf["step"] = np.where(pdf["a"] > 0, 5.0, -5.0)
    pdf["event"] = (pdf["b"] + pdf["c"] > 0).astype(float)
    pdf.loc[::97, "a"] = np.inf
    pdf.loc[5::101, "b"] = np.nan
    return pdf, spark.createDataFrame(pdf).repartition(4)


def complete(pdf):
    return pdf[np.isfinite(pdf[FEATURES]).all(axis=1)]


def design(pdf):
    return np.column_stack([np.ones(len(pdf)), pdf[FEATURES]])


def parts(pdf, df, share=0.8):
    cut = pd.Timestamp(learning.time_cut(learning.clean_rows(df, FEATURES), "ts", share), unit="us")
    rows = complete(pdf)
    return rows[rows["ts"] < cut], rows[rows["ts"] >= cut]


def scores(y, guess):
    left = y - guess
    return np.sqrt((left**2).mean()), left.abs().mean(), 1 - (left**2).sum() / ((y - y.mean()) ** 2).sum()


def test_split_by_time_keeps_all_rows_in_order(table):
    pdf, df = table
    train, test = parts(pdf, df)
    assert len(train) + len(test) == len(complete(pdf)) and abs(len(train) / len(complete(pdf)) - 0.8) < 0.01
    assert train["ts"].max() < test["ts"].min()


def test_squared_loss_is_least_squares(table):
    pdf, df = table
    train, test = parts(pdf, df)
    want, *_ = np.linalg.lstsq(design(train), train["y"], rcond=None)
    model, metrics = learning.linear_expert(df, "ts", FEATURES, "y", "squaredError")
    fit = model.stages[-1]
    np.testing.assert_allclose([fit.intercept, *fit.coefficients], want, atol=1e-3)
    row = metrics.first()
    np.testing.assert_allclose([row["rmse"], row["mae"], row["r2"]], scores(test["y"], design(test) @ want), atol=1e-3)


def test_huber_shrugs_off_outliers(table):
    _, df = table
    wild = df.withColumn("y", F.when(F.minute("ts") % 20 == 0, F.col("y") + 200).otherwise(F.col("y")))
    fit = learning.linear_expert(wild, "ts", FEATURES, "y", "huber")[0].stages[-1]
    np.testing.assert_allclose([fit.intercept, *fit.coefficients], [3, 2, -1, 0.5], atol=0.2)


def test_sharded_predictions_are_weighted_means(table):
    pdf, df = table
    train, test = parts(pdf, df)
    row = learning.sharded_expert(df, "ts", FEATURES, "y", shards=3).first()
    assert row["shards"] == 3
    # Any cut into three near-equal shards gives nearly the same blend.
    fits = [np.linalg.lstsq(design(s), s["y"], rcond=None)[0] for s in (train.iloc[i] for i in np.array_split(np.arange(len(train)), 3))]
    np.testing.assert_allclose([row["rmse"], row["r2"]], np.take(scores(test["y"], design(test) @ np.mean(fits, axis=0)), [0, 2]), atol=5e-3)


def test_forest_finds_the_step_and_its_cause(table):
    _, df = table
    _, metrics = learning.forest_experts(df, "ts", FEATURES, ["step", "y"], trees=8, depth=5)
    r2 = {r["target"]: r["r2"] for r in metrics.collect()}
    assert r2["step"] > 0.95 and 0.6 < r2["y"] < 1
    ranked = learning.importance(df, FEATURES, "step", 3, trees=8, depth=4).collect()
    assert ranked[0]["feature"] == "a" and ranked[0]["importance"] > 0.7
    assert abs(sum(r["importance"] for r in ranked) - 1) < 1e-9


def test_more_rounds_are_ranked_by_score(table):
    _, df = table
    models, results = learning.training_rounds(df, "ts", FEATURES, "y", rounds=2, base_trees=2, depth=4)
    rows = results.collect()
    assert [r["trees"] for r in rows] == [2, 4] == [m.stages[-1].getNumTrees for m in models]
    kept = learning.manifest(results, 2).collect()
    assert kept[0]["r2"] == max(r["r2"] for r in rows) and abs(sum(r["weight"] for r in kept) - 1) < 1e-9


def test_clusters_are_settled(table):
    pdf, df = table
    rows = learning.clean_rows(df, FEATURES)
    found = learning.clusters(rows, FEATURES, k=4)
    got = found.select(*FEATURES, "cluster").toPandas()
    assert len(got) == len(complete(pdf)) and got["cluster"].nunique() == 4
    x = (got[FEATURES] - got[FEATURES].mean()) / got[FEATURES].std()
    centres = x.groupby(got["cluster"]).mean().sort_index()
    gaps = ((x.to_numpy()[:, None, :] - centres.to_numpy()[None]) ** 2).sum(axis=2)
    # At a fixed point every row is nearest to its own centre; the fit may stop a little before it.
    assert (gaps.argmin(axis=1) == got["cluster"]).mean() > 0.95
    assert gaps.min(axis=1).sum() < 0.7 * (x**2).to_numpy().sum()
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found)
    assert ClusteringEvaluator(predictionCol="cluster").evaluate(vectors) > 0.1


def test_classifier_beats_the_larger_class(table):
    pdf, df = table
    rows = learning.clean_rows(df, FEATURES)
    got = {r["part"]: r for r in learning.classify(rows, FEATURES, "event", ["ts"]).collect()}
    assert sum(r["rows"] for r in got.values()) == len(complete(pdf))
    assert 0.7 < got["train"]["rows"] / len(complete(pdf)) < 0.9
    common = max(pdf["event"].mean(), 1 - pdf["event"].mean())
    assert got["train"]["accuracy"] > 0.85 and got["test"]["accuracy"] > common + 0.2


def test_saved_model_predicts_as_before(table, tmp_path):
    pdf, df = table
    model, _ = learning.linear_expert(df, "ts", FEATURES, "y", "squaredError")
    fit = model.stages[-1]
    out = learning.save_and_predict(model, str(tmp_path / "m"), df.drop("c"), FEATURES).toPandas().set_index("ts")
    assert len(out) == len(pdf)
    # A missing column, a gap and a value that isn't finite count as 0.
    zeros = pdf.assign(c=0.0)[FEATURES].replace([np.inf, np.nan], 0.0).to_numpy()
    want = pd.Series(zeros @ fit.coefficients.toArray() + fit.intercept, index=pdf["ts"])
    np.testing.assert_allclose(out["pred_y"].reindex(want.index), want, atol=1e-9)
    stacked = learning.stack(learning.clean_rows(df, FEATURES), [("e", model, "pred_y")]).toPandas()
    np.testing.assert_allclose(stacked["e"], design(stacked) @ [fit.intercept, *fit.coefficients], atol=1e-9)
