"""Models on fused tables with Spark ML: forests, linear models, shards, blends, clusters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.clean import finite
from gridloom.operators.quantiles import impute_median
from gridloom.operators.stats import regression_metrics
from gridloom.operators.timeorder import micros

MIN_ROWS = 100
FEATURES = "_features"


def time_cut(df: DataFrame, ts: str, share: float = 0.8) -> int:
    """Instant (microseconds) before which about ``share`` of the rows lie."""
    cut = df.agg(F.expr(f"percentile_approx(unix_micros(cast(`{ts}` as timestamp)), {share}D, 10000)")).first()[0]
    if cut is None:
        raise ValueError("no rows")
    return cut


def split_by_time(df: DataFrame, ts: str, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Chronological train and test parts, cut at one instant: no row index, no shuffle."""
    cut = time_cut(df, ts, share)
    return df.where(micros(ts) < cut), df.where(micros(ts) >= cut)


def clean_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-finite values to null, then only complete rows; too few rows are an error."""
    rows = df.withColumns({c: finite(F.col(c).cast("double")) for c in columns}).na.drop(subset=list(columns))
    if rows.limit(MIN_ROWS).count() < MIN_ROWS:
        raise ValueError(f"fewer than {MIN_ROWS} complete rows")
    return rows


def forest(target: str, trees: int, depth: int = 10, leaf: int = 2, seed: int = 42) -> RandomForestRegressor:
    return RandomForestRegressor(
        featuresCol=FEATURES, labelCol=target, predictionCol=f"pred_{target}", numTrees=trees, maxDepth=depth,
        minInstancesPerNode=leaf, seed=seed,
    )


def linear(target: str, loss: str = "huber", l2: float = 1e-5) -> LinearRegression:
    """Linear model with huber or squared loss and L2; trained in parallel instead of chunk by chunk."""
    return LinearRegression(
        featuresCol=FEATURES, labelCol=target, predictionCol=f"pred_{target}", loss=loss, regParam=l2, elasticNetParam=0.0
    )


def assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=FEATURES, handleInvalid="skip")


def fit_targets(train: DataFrame, features: Sequence[str], stages: Sequence) -> PipelineModel:
    """One pipeline: features once, then one model per target."""
    return Pipeline(stages=[assembler(features), *stages]).fit(train)


def multi_metrics(predicted: DataFrame, targets: Sequence[str]) -> DataFrame:
    """rmse, mae, r2 per target from one pass over the predictions."""
    pairs = [F.struct(F.lit(c).alias("target"), F.col(c).alias("y"), F.col(f"pred_{c}").alias("p")) for c in targets]
    long = predicted.select(F.explode(F.array(*pairs)).alias("m")).select("m.*")
    return regression_metrics(long, "y", "p", ["target"])


def forest_experts(
    df: DataFrame, ts: str, features: Sequence[str], targets: Sequence[str], trees: int = 200, share: float = 0.8, depth: int = 10
) -> tuple[PipelineModel, DataFrame]:
    """A forest per target on the earlier part, scored on the later part."""
    rows = clean_rows(df, [*features, *targets])
    train, test = split_by_time(rows, ts, share)
    model = fit_targets(train, features, [forest(c, trees, depth) for c in targets])
    return model, multi_metrics(model.transform(test), targets)


def linear_expert(
    df: DataFrame, ts: str, features: Sequence[str], target: str, loss: str = "huber", share: float = 0.8
) -> tuple[PipelineModel, DataFrame]:
    rows = clean_rows(df, [*features, target])
    train, test = split_by_time(rows, ts, share)
    model = fit_targets(train, features, [linear(target, loss)])
    return model, multi_metrics(model.transform(test), [target])


def sharded_expert(
    df: DataFrame, ts: str, features: Sequence[str], target: str, shards: int = 4, share: float = 0.8
) -> DataFrame:
    """A linear model per time shard; predictions averaged with the shard sizes as weights."""
    rows = clean_rows(df, [*features, target])
    train, test = split_by_time(rows, ts, share)
    marks = [i / shards for i in range(1, shards)]
    cuts = train.agg(
        F.expr(f"percentile_approx(unix_micros(cast(`{ts}` as timestamp)), array({','.join(f'{m}D' for m in marks)}), 10000)")
    ).first()[0]
    edges = [None, *sorted(set(cuts)), None]
    scored, weights = test, []
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        shard = train
        if low is not None:
            shard = shard.where(micros(ts) >= low)
        if high is not None:
            shard = shard.where(micros(ts) < high)
        size = shard.count()
        if not size:
            continue
        model = fit_targets(shard, features, [linear(target, "squaredError").setPredictionCol(f"_p{i}")])
        scored = model.transform(scored).drop(FEATURES)
        weights.append((f"_p{i}", size))
    total = sum(w for _, w in weights)
    blended = reduce(lambda a, b: a + b, [F.col(c) * w for c, w in weights]) / total
    scored = scored.withColumn(f"pred_{target}", blended)
    return multi_metrics(scored, [target]).withColumn("shards", F.lit(len(weights)))


def importance(
    df: DataFrame, features: Sequence[str], target: str, n: int, trees: int = 350, leaf: int = 5, depth: int = 10
) -> DataFrame:
    """Forest importances, strongest first; gaps in the features are filled with the median."""
    rows = df.withColumns({c: finite(F.col(c).cast("double")) for c in [*features, target]})
    rows = impute_median(rows.where(F.col(target).isNotNull()), list(features))
    model = fit_targets(rows, features, [forest(target, trees, depth, leaf)])
    weights = model.stages[-1].featureImportances.toArray().tolist()
    table = df.sparkSession.createDataFrame(list(zip(features, weights)), "feature string, importance double")
    return table.orderBy(F.col("importance").desc(), "feature").limit(n)


def weight_summary(weights: DataFrame, k: int) -> DataFrame:
    """Top k features per target and over the mean of all targets (``overall``)."""
    overall = weights.groupBy("feature").agg(F.avg("weight").alias("weight")).withColumn("target", F.lit("overall"))
    every = weights.select("target", "feature", "weight").unionByName(overall.select("target", "feature", "weight"))
    ranked = Window.partitionBy("target").orderBy(F.col("weight").desc(), "feature")
    return every.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def manifest(results: DataFrame, top_k: int) -> DataFrame:
    """The best rounds by r2 with weights max(0, r2 + 1) that add up to 1."""
    best = results.orderBy(F.col("r2").desc(), "round").limit(top_k)
    raw = F.greatest(F.lit(0.0), F.col("r2") + 1.0)
    whole = F.sum(raw).over(Window.partitionBy(F.lit(0)))
    return best.withColumn("weight", F.when(whole > 0, raw / whole).otherwise(F.lit(0.0)))


def training_rounds(
    df: DataFrame, ts: str, features: Sequence[str], target: str, rounds: int, base_trees: int, share: float = 0.8, depth: int = 8
) -> tuple[list[PipelineModel], DataFrame]:
    """Round r trains ``base_trees * r`` trees; the driver only loops over rounds, Spark trains."""
    rows = clean_rows(df, [*features, target])
    train, test = split_by_time(rows, ts, share)
    train, test = train.persist(), test.persist()
    models, scores = [], []
    for r in range(1, rounds + 1):
        model = fit_targets(train, features, [forest(target, base_trees * r, depth, seed=42 + r)])
        models.append(model)
        row = multi_metrics(model.transform(test), [target]).first()
        scores.append((r, base_trees * r, row["r2"], row["rmse"], row["mae"]))
    train.unpersist()
    test.unpersist()
    schema = "round int, trees int, r2 double, rmse double, mae double"
    return models, df.sparkSession.createDataFrame(scores, schema)


def blend(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weighted mean and spread (population) of member predictions held as rows (weight, prediction).

    Members without a prediction are left out of both.
    """
    usable = members.where(F.col("prediction").isNotNull())
    weighted = F.sum(F.col("weight") * F.col("prediction"))
    whole = F.sum("weight")
    return usable.groupBy(*keys).agg(
        (weighted / F.when(whole > 0, whole).otherwise(1.0)).alias("blended"),
        F.stddev_pop("prediction").alias("uncertainty"),
        F.count(F.lit(1)).alias("members"),
    )


def stack(df: DataFrame, models: Sequence[tuple[str, PipelineModel, str]]) -> DataFrame:
    """Predictions of several models as extra columns: (name, model, prediction column)."""
    out = df
    for name, model, column in models:
        out = model.transform(out).withColumnRenamed(column, name).drop(FEATURES)
    return out


def clusters(df: DataFrame, features: Sequence[str], k: int = 4, seed: int = 0) -> DataFrame:
    """Standardise, then k-means; rows with nulls are left out."""
    rows = df.na.drop(subset=list(features))
    scaler = StandardScaler(inputCol=FEATURES, outputCol="_scaled", withMean=True, withStd=True)
    means = KMeans(featuresCol="_scaled", predictionCol="cluster", k=k, seed=seed)
    model = Pipeline(stages=[assembler(features), scaler, means]).fit(rows)
    return model.transform(rows).drop(FEATURES, "_scaled")


def classify(
    df: DataFrame, features: Sequence[str], label: str, key: Sequence[str], trees: int = 10, seed: int = 1
) -> DataFrame:
    """Forest classifier on an 80/20 split by a hash of the key; accuracy per part."""
    rows = df.na.drop(subset=[*features, label])
    bucket = F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in key]), F.lit(100))
    rows = rows.withColumn("_part", F.when(bucket < 80, "train").otherwise("test"))
    model = Pipeline(
        stages=[
            assembler(features),
            RandomForestClassifier(featuresCol=FEATURES, labelCol=label, numTrees=trees, seed=seed, predictionCol="_guess"),
        ]
    ).fit(rows.where("_part = 'train'"))
    scored = model.transform(rows)
    right = (F.col("_guess") == F.col(label)).cast("int")
    return scored.groupBy(F.col("_part").alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.avg(right).alias("accuracy"))


def save_and_predict(model: PipelineModel, path: str, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Write a model, load it and predict; a missing feature counts as 0."""
    model.write().overwrite().save(path)
    return predict_saved(path, df, features)


def predict_saved(path: str, df: DataFrame, features: Sequence[str]) -> DataFrame:
    aligned = df.withColumns(
        {c: F.coalesce(finite(F.col(c).cast("double")), F.lit(0.0)) if c in df.columns else F.lit(0.0) for c in features}
    )
    return PipelineModel.load(path).transform(aligned).drop(FEATURES)


