import random
import zlib

import numpy as np
import pytest

from gridloom.llm import quality
from gridloom.llm.queries import QUERIES
from tests.llm.helpers import awkward, documents, rows, write


def made(n, seed=1):
    """Prose with sentence ends is good; repetitions, tables and noise are bad."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["ba", "ke", "li", "mo", "tu", "sar"]) for _ in range(r.randrange(1, 4)))
    out = []
    for i in range(n):
        good = i % 3 > 0
        if good:
            text = " ".join(word() + ("." if k % 9 == 8 else "") for k in range(r.randrange(20, 200)))
        else:
            w = word()
            text = r.choice([" ".join([w] * 60), " | ".join(word() for _ in range(60)), " ".join(word() + "%%%" for _ in range(40))])
        out.append((i, text, int(good)))
    return out


def test_query_separates_held_out_rows(spark, tmp_path):
    docs = made(600)
    folder = write(documents(spark, [*[(i, t) for i, t, _ in docs], *[(10000 + (i or 0), t) for i, t in awkward()]]), tmp_path)
    spark.createDataFrame([(i, y, 0) for i, _, y in docs] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in QUERIES["op3_quality"](spark, folder).collect()}
    truth = {i: y for i, _, y in docs}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [i for i in truth if got[i].held_out]
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.97


def test_scores_depend_on_the_text_alone(spark):
    docs = made(120)
    labels = spark.createDataFrame([(i, y) for i, _, y in docs], "doc_id long, quality int")
    frame = documents(spark, [(i, t) for i, t, _ in docs])
    model = quality.fit_quality(frame, labels)
    texts = [t for _, t, _ in docs]
    together = dict(rows(quality.score_quality(documents(spark, [*texts, *texts]), model)))
    assert [together[i] for i in range(120)] == pytest.approx([together[i + 120] for i in range(120)])
    kept = quality.keep_good(frame, model, 0.3)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, s in rows(quality.score_quality(frame, model)) if s >= 0.3}


@pytest.mark.parametrize("labels", [[], [(0, 1)], [(0, 0), (1, 0)], [(0, 1), (0, 0)], [(1, 1), (2, 0), (3, None)]])
def test_few_labels(spark, labels):
    frame = documents(spark, ["some text here", "more of it", "and more", None])
    model = quality.fit_quality(frame, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert all(0 <= s <= 1 for _, s in rows(quality.score_quality(frame, model)))
    assert quality.score_quality(frame.limit(0), model).count() == 0


def test_descent_separates_a_small_problem():
    r = np.random.default_rng(1)
    x = [np.unique(r.integers(0, 40, 8) + 40 * (i % 2)) for i in range(60)]
    model = quality.fit(x, np.arange(60) % 2, 0.5)
    owner = np.repeat(np.arange(60), [len(v) for v in x])
    p = model.scores(owner, np.concatenate(x), 60)
    assert ((p > 0.5) == (np.arange(60) % 2 == 1)).all()
