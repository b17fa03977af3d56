"""Quality classifier: n-gram indicators scaled by class log-count ratios, a hinge-loss model by dual coordinate descent.

Features are hashed into a fixed number of buckets: single words, pairs of words, byte 4-grams, and pairs of word shapes
(length, kind of characters, whether the word stood among the few before), which say how a text is built whatever its
words are. The fit takes at most ``PER_CLASS`` labelled rows of each class, chosen by a hash of their id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from gridloom.llm.common import Rolling, Words, list_array, map_documents, mix, ready

BUCKETS = 1 << 17
#: Labelled rows of each class that the fit takes at most.
PER_CLASS = 2000
#: Indicators of the sample's rows of each class together, which bounds the memory of the driver.
PER_CLASS_INDICATORS = 1 << 24
ALPHA, COST, ROUNDS, BLEND = 1.0, 0.1, 8, 0.75
GRAM = 4
#: Bytes of text per step: a step holds a dozen numbers for each of them.
STEP = 1 << 18
#: How far back a word counts as a repetition.
REACH = 4


class Model:
    """Weights per bucket (log-count ratios times the learned weights), and the map from margins to probabilities."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def plain(self) -> tuple:
        """The model as arrays, for tasks that don't have this package."""
        return self.weights, self.bias, self.slope, self.shift

    def margins(self, owner: np.ndarray, buckets: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(owner, weights=self.weights[buckets], minlength=n)[:n] / scale(owner, n) + self.bias

    def scores(self, owner: np.ndarray, buckets: np.ndarray, n: int) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margins(owner, buckets, n) + self.shift, -30, 30)))


def scale(owner: np.ndarray, n: int) -> np.ndarray:
    """Root of the number of indicators: texts of all lengths get margins of one size."""
    return np.sqrt(np.maximum(1, np.bincount(owner, minlength=n)[:n]))


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the distinct indicators, sorted."""
    words = Words(texts, lower=True)
    n = len(texts)
    found = []
    if len(words.start):
        h = words.hashes()
        found.append((words.doc, h, 1))
        size = np.minimum(words.end - words.start, 24).astype(np.uint64)
        alpha = np.concatenate([[0], np.cumsum((words.data >= 97) & (words.data <= 122) | (words.data >= 128))])
        digit = np.concatenate([[0], np.cumsum((words.data >= 48) & (words.data <= 57))])
        letters, digits = (c[words.end] - c[words.start] for c in (alpha, digit))
        total = words.end - words.start
        kind = (letters == total) * 1 + (letters == 0) * 2 + (digits == total) * 4 + ((digits > 0) & (digits < total)) * 8
        again = np.zeros(len(h), np.uint64)
        for back in range(REACH, 0, -1):
            same = np.zeros(len(h), bool)
            same[back:] = (h[back:] == h[:-back]) & (words.doc[back:] == words.doc[:-back])
            again[same] = back
        coarse = kind.astype(np.uint64) * np.uint64(16) + again
        shape = coarse * np.uint64(32) + size
        found.append((words.doc, mix(shape + np.uint64(7)), 2))
        pair = words.doc[1:] == words.doc[:-1]
        found.append((words.doc[1:][pair], mix(h[:-1][pair] * np.uint64(3) + h[1:][pair]), 3))
        found.append((words.doc[1:][pair], mix(shape[:-1][pair] * np.uint64(1 << 20) + shape[1:][pair]), 4))
        run = coarse
        for k in range(2, 5):
            if len(run) > 1:
                run = run[:-1] * np.uint64(1 << 9) + coarse[k - 1 :]
                inside = words.doc[k - 1 :] == words.doc[: len(run)]
                found.append((words.doc[k - 1 :][inside], mix(run[inside]), 4 + k))
    if len(words.data) > GRAM:
        grams = Rolling(words.data).windows(GRAM)
        at = np.arange(len(grams))
        doc = np.repeat(np.arange(n), words.sizes + 1)[: len(grams)]
        inside = at + GRAM <= words.offsets[doc + 1]
        found.append((doc[inside], grams[inside], 12))
    keys = [np.zeros(0, np.uint64)]
    for doc, value, salt in found:
        keys.append(doc.astype(np.uint64) * np.uint64(BUCKETS) + mix(value + np.uint64(salt)) % np.uint64(BUCKETS))
    keys = np.unique(np.concatenate(keys))
    return (keys // np.uint64(BUCKETS)).astype(np.int64), (keys % np.uint64(BUCKETS)).astype(np.int64)


def fit(rows: list[np.ndarray], labels: np.ndarray, share: float) -> Model:
    """Fit on the bucket lists of the sample; ``share`` is the share of label 1 among all labelled rows."""
    n = len(rows)
    if n == 0 or labels.min() == labels.max():
        p = float(labels[0]) if n else 0.5
        return Model(np.zeros(BUCKETS), 0.0, 0.0, 30.0 * (2 * p - 1) if n else 0.0)
    positive, negative = np.full(BUCKETS, ALPHA), np.full(BUCKETS, ALPHA)
    for x, y in zip(rows, labels):
        (positive if y else negative)[x] += 1
    ratio = np.log(positive / positive.sum()) - np.log(negative / negative.sum())
    order = np.random.default_rng(17)
    train = np.arange(n) % 5 != 0
    sign = np.where(labels > 0, 1.0, -1.0)
    # Both classes weigh the same in the fit, whatever their numbers.
    cost = COST * n / (2 * np.where(labels > 0, (labels > 0).sum(), (labels == 0).sum()))

    def descend(use: np.ndarray) -> tuple[np.ndarray, float]:
        weights, bias, dual = np.zeros(BUCKETS), 0.0, np.zeros(n)
        values = [ratio[x] / np.sqrt(max(1, len(x))) for x in rows]
        norms = np.array([v @ v + 1.0 for v in values])
        for _ in range(ROUNDS):
            for i in order.permutation(use):
                x, v = rows[i], values[i]
                gradient = sign[i] * (weights[x] @ v + bias) - 1.0
                new = min(max(dual[i] - gradient / norms[i], 0.0), cost[i])
                if new != dual[i]:
                    step = (new - dual[i]) * sign[i]
                    weights[x] += step * v
                    bias += step
                    dual[i] = new
        mean = np.abs(weights).mean()
        return ratio * ((1 - BLEND) * mean + BLEND * weights), BLEND * bias

    weights, bias = descend(np.flatnonzero(train))
    model = Model(weights, bias, 1.0, 0.0)
    held = np.flatnonzero(~train)
    owner = np.repeat(np.arange(len(held)), [len(rows[i]) for i in held])
    flat = np.concatenate([rows[i] for i in held]) if len(held) else np.zeros(0, np.int64)
    margins, truth = model.margins(owner, flat, len(held)), labels[held] > 0
    # Margins of rows outside the fit become probabilities; the sample's classes are weighted back to their shares.
    weight = np.where(truth, share / max(1, truth.sum()), (1 - share) / max(1, (~truth).sum()))
    model.slope, model.shift = _logistic(margins, truth.astype(float), weight / max(weight.sum(), 1e-12))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a weighted logistic curve by Newton steps, with a small ridge so that it stays finite."""
    if not len(x) or y.min() == y.max():
        return 1.0, 0.0
    spread = x.std() or 1.0
    a, b = 1.0 / spread, -x.mean() / spread
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = weight * (p - y)
        h = np.maximum(weight * p * (1 - p), 1e-12)
        ridge = 1e-4 * spread**2
        grad = np.array([g @ x + ridge * a, g.sum()])
        hess = np.array([[h @ (x * x) + ridge, h @ x], [h @ x, h.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(hess, grad), -5, 5)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def bucket_lists(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the buckets of the text's indicators."""
    schema = StructType([docs.schema[id_col], StructField("buckets", ArrayType(IntegerType()))])

    def start():
        def work(cols):
            owner, found = features(cols[text_col])
            counts = np.bincount(owner, minlength=len(cols[text_col]))
            return {id_col: cols[id_col], "buckets": list_array(counts, found.astype(np.int32), pa.int32())}

        return work

    return map_documents(docs, [id_col, text_col], text_col, schema, start, limit=STEP)


def held_out(id_col: str):
    """Rows whose label is never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    per_class: int = PER_CLASS, indicators: int = PER_CLASS_INDICATORS,
) -> Model:
    """Fit on at most ``per_class`` labelled rows of each class that aren't held out, in order of a hash of their id.

    The rows of a class also end where they would have more than ``indicators`` indicators in all (a row has 2**17 at most,
    however long its text). Rows with a null id or label, or with labels that disagree, are not learned from; of rows that
    repeat an id the one with the least list of buckets is. Without any label every score is a half; with one class alone every
    score is sure of it. The driver gets the buckets of the sample only.
    """
    spark = ready(docs.sparkSession)
    known = labels.where(F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(
        F.min(F.col(label_col)).alias("label"), F.max(F.col(label_col)).alias("other")).where("label = other and label in (0, 1)")
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    sample = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(per_class).select("id", "label")
        sample = part if sample is None else sample.union(part)
    # Two bounded limits: the sample is small whatever the size of the tables.
    chosen = F.broadcast(spark.createDataFrame(sample.toPandas(), sample.schema))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    texts = texts.join(chosen.select("id"), "id", "left_semi")
    lists = bucket_lists(texts, "id", "text").groupBy("id").agg(F.min("buckets").alias("buckets")).join(chosen, "id")
    so_far = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lists = lists.withColumn("so_far", F.sum(F.size("buckets").cast("long")).over(so_far)).where(F.col("so_far") <= indicators)
    got = lists.select(F.xxhash64("id").alias("h"), "id", "label", "buckets").toArrow().sort_by([("h", "ascending"), ("id", "ascending")])
    flat = got.column("buckets").combine_chunks()
    rows = np.split(flat.flatten().to_numpy(), flat.offsets.to_numpy()[1:-1] - flat.offsets[0].as_py()) if len(flat) else []
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    return fit(rows, got.column("label").to_numpy(), share)


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score (probability of label 1 for the whole text).

    Null and empty texts get the score of a text without indicators. Null ids and repeated rows get a row each; other columns
    are left alone and never enter the score; an empty table gives an empty result.
    """
    schema = StructType([docs.schema[id_col], StructField("score", DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model.plain())

    def start():
        model = Model(*shared.value)

        def work(cols):
            owner, found = features(cols[text_col])
            return {id_col: cols[id_col], "score": model.scores(owner, found, len(cols[text_col]))}

        return work

    return map_documents(docs, [id_col, text_col], text_col, schema, start, limit=STEP)


def keep_good(docs: DataFrame, model: Model, at: float, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text scores ``at`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model.plain())
    names = docs.columns

    def start():
        model = Model(*shared.value)

        def work(cols):
            owner, found = features(cols[text_col])
            keep = np.flatnonzero(model.scores(owner, found, len(cols[text_col])) >= at)
            return {name: [values[i] for i in keep] for name, values in cols.items()}

        return work

    return map_documents(docs, names, text_col, docs.schema, start, limit=STEP)
