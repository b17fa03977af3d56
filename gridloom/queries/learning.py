"""Model pipelines on the fused events table. Tree counts are small: the queries check the plumbing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.asof import Source
from gridloom.plans import fusion, learning
from gridloom.queries.registry import Tables, query, rounded
from gridloom.session import scratch_path, settle

INPUTS = ["hour_sin", "hour_cos", "dow_sin", "roll5_mean", "roll5_std", "diff_1", "click_value", "view_value"]


def table(t: Tables) -> DataFrame:
    """Training table: written once, then read by every fit and every score."""
    sources = [
        Source(t.kind(k), "ts", ["value"], f"{k}_", tolerance=3600.0, seq="event_id") for k in ("click", "view", "error")
    ]
    fused = fusion.fused_table(t.signal(), "ts", "value", 600, sources, windows=(5, 30), diffs=(1, 5))
    return settle(fused)


@query("ml_forest")
def ml_forest(t: Tables) -> DataFrame:
    _, scores = learning.forest_experts(table(t), "bucket", INPUTS, ["value", "error_value"], trees=8, depth=5)
    return scores


@query("ml_linear")
def ml_linear(t: Tables) -> DataFrame:
    rows = table(t)
    _, huber = learning.linear_expert(rows, "bucket", INPUTS, "value", "huber")
    _, squared = learning.linear_expert(rows, "bucket", INPUTS, "value", "squaredError")
    return huber.withColumn("loss", F.lit("huber")).unionByName(squared.withColumn("loss", F.lit("squaredError")))


@query("ml_sharded")
def ml_sharded(t: Tables) -> DataFrame:
    return learning.sharded_expert(table(t), "bucket", INPUTS, "value", shards=3)


@query("ml_importance")
def ml_importance(t: Tables) -> DataFrame:
    return learning.importance(table(t), INPUTS, "value", 5, trees=10, depth=5)


@query(
    "ml_weights",
    """WITH w AS (SELECT l_returnflag AS target, p_brand AS feature, round(avg(l_quantity), 6) AS weight FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
       e AS (SELECT * FROM w UNION ALL SELECT 'overall', feature, avg(weight) FROM w GROUP BY feature)
       SELECT target, feature, round(weight, 6) AS weight, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY weight DESC, feature) AS rank FROM e)
       WHERE rank <= 5""",
)
def ml_weights(t: Tables) -> DataFrame:
    items = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    weights = items.groupBy(F.col("l_returnflag").alias("target"), F.col("p_brand").alias("feature")).agg(
        F.round(F.avg("l_quantity"), 6).alias("weight")
    )
    return rounded(learning.weight_summary(weights, 5))


@query(
    "ml_manifest",
    """WITH r AS (SELECT CAST(l_linenumber AS INTEGER) AS round, round(corr(l_quantity, l_extendedprice), 9) AS r2 FROM lineitem GROUP BY 1),
       b AS (SELECT * FROM r ORDER BY r2 DESC, round LIMIT 3)
       SELECT round, round(r2, 6) AS r2, round(greatest(0, r2 + 1) / sum(greatest(0, r2 + 1)) OVER (), 6) AS weight FROM b""",
)
def ml_manifest(t: Tables) -> DataFrame:
    results = t.lineitem.groupBy(F.col("l_linenumber").alias("round")).agg(
        F.round(F.corr("l_quantity", "l_extendedprice"), 9).alias("r2")
    )
    return rounded(learning.manifest(results, 3))


@query("ml_rounds")
def ml_rounds(t: Tables) -> DataFrame:
    _, scores = learning.training_rounds(table(t), "bucket", INPUTS, "value", rounds=3, base_trees=4, depth=5)
    return learning.manifest(scores, 2)


@query(
    "ml_blend",
    """SELECT l_orderkey, sum(l_quantity * cents) / sum(l_quantity) AS blended, round(stddev_pop(cents), 4) AS uncertainty,
         count(*) AS members FROM (SELECT *, round(l_extendedprice * 100) AS cents FROM lineitem) WHERE l_linenumber <> 3 GROUP BY 1""",
)
def ml_blend(t: Tables) -> DataFrame:
    # Whole cents: their weighted sums are exact in any order.
    prediction = F.when(F.col("l_linenumber") != 3, F.round(F.col("l_extendedprice") * 100))
    members = t.lineitem.select("l_orderkey", F.col("l_quantity").alias("weight"), prediction.alias("prediction"))
    out = learning.blend(members, ["l_orderkey"])
    return out.withColumn("uncertainty", F.round("uncertainty", 4))


@query("ml_stack")
def ml_stack(t: Tables) -> DataFrame:
    rows = table(t)
    first, _ = learning.linear_expert(rows, "bucket", INPUTS, "value", "squaredError")
    second, _ = learning.forest_experts(rows, "bucket", INPUTS, ["error_value"], trees=6, depth=4)
    complete = rows.na.drop(subset=INPUTS)
    stacked = learning.stack(
        complete, [("expert_value", first, "pred_value"), ("expert_error", second, "pred_error_value")]
    )
    return stacked.select("bucket", "value", "expert_value", "expert_error")


@query("ml_kmeans")
def ml_kmeans(t: Tables) -> DataFrame:
    found = learning.clusters(table(t), ["value", "click_value", "view_value"])
    return found.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"), F.avg("value").alias("mean_value"))


@query("ml_classify")
def ml_classify(t: Tables) -> DataFrame:
    labelled = table(t).withColumn("is_event", ((F.col("value") < 20) | (F.col("value") > 60)).cast("double"))
    return learning.classify(labelled, ["click_value", "view_value", "hour_sin", "dow_sin"], "is_event", ["bucket"])


@query("ml_predict")
def ml_predict(t: Tables) -> DataFrame:
    rows = table(t)
    model, _ = learning.linear_expert(rows, "bucket", INPUTS, "value", "squaredError")
    path = scratch_path(t.spark, "model")
    out = learning.save_and_predict(model, path, rows.drop("view_value"), INPUTS)
    return out.select("bucket", "value", "pred_value")
