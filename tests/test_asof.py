"""As-of joins against pandas: ties, equal keys, tolerance edges, groups, crowds."""

import numpy as np
import pandas as pd
import pytest

from gridloom.operators.asof import Source, asof_join, context_rows, fuse, nearest_row

BASE = pd.Timestamp("2024-01-01")


def at(*seconds):
    return [BASE + pd.Timedelta(seconds=s) for s in seconds]


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


def matched(df, key="id", value="m_r"):
    return {r[key]: r[value] for r in df.collect()}


@pytest.fixture
def tie_tables(spark):
    left = frame(spark, id=[1], ts=at(900))
    right = frame(spark, r=[10, 20], rts=at(0, 1800))
    return left, right


@pytest.mark.parametrize("tie,want", [("earlier", 10), ("later", 20)])
def test_tie(tie_tables, tie, want):
    left, right = tie_tables
    out = asof_join(left, right, "ts", "rts", ["r"], prefix="m_", tie=tie, tolerance=900.0)
    assert matched(out) == {1: want}


def test_tolerance_is_inclusive(tie_tables):
    left, right = tie_tables
    assert matched(asof_join(left, right, "ts", "rts", ["r"], prefix="m_", tolerance=899.999999)) == {1: None}


def test_equal_keys_last_behind_first_ahead(spark):
    left = frame(spark, id=[1, 2], ts=at(700, 1100))
    right = frame(spark, r=[1, 2, 3, 4], rts=at(600, 600, 1200, 1200), seq=[0, 1, 2, 3])
    assert matched(asof_join(left, right, "ts", "rts", ["r"], prefix="m_", seq="seq")) == {1: 2, 2: 3}


def test_null_left_time_and_empty_right(spark):
    left = spark.createDataFrame([(1, None), (2, BASE.to_pydatetime())], "id long, ts timestamp")
    right = spark.createDataFrame([(5, BASE.to_pydatetime())], "r long, rts timestamp")
    assert matched(asof_join(left, right, "ts", "rts", ["r"], prefix="m_")) == {1: None, 2: 5}
    assert matched(asof_join(left, right.limit(0), "ts", "rts", ["r"], prefix="m_")) == {1: None, 2: None}


@pytest.fixture(scope="module")
def crowd(spark):
    """A third of the left rows on one instant, a third of the right rows on another, one hot site."""
    rng = np.random.default_rng(3)
    n, m = 1200, 900
    lt, rt = rng.integers(0, 40_000, n), rng.integers(5_000, 36_000, m)
    lt[:400], rt[:300] = 20_000, 15_000
    left = pd.DataFrame({"id": np.arange(n), "ts": BASE + pd.to_timedelta(lt, unit="s"), "site": rng.integers(0, 6, n)})
    right = pd.DataFrame({"rts": BASE + pd.to_timedelta(rt, unit="s"), "r": np.arange(m), "site": rng.integers(0, 6, m)})
    left.loc[:500, "site"] = 0
    right.loc[:400, "site"] = 0
    left["ts"], right["rts"] = left["ts"].astype("datetime64[us]"), right["rts"].astype("datetime64[us]")
    return left, right, spark.createDataFrame(left).repartition(4), spark.createDataFrame(right).repartition(3)


@pytest.mark.parametrize("direction", ["nearest", "backward", "forward"])
@pytest.mark.parametrize("tolerance", [None, 30.0, 600.0])
@pytest.mark.parametrize("by", [(), ("site",)])
def test_against_pandas(crowd, many_slices, direction, tolerance, by):
    lp, rp, left, right = crowd
    want = pd.merge_asof(
        lp.sort_values("ts", kind="stable"),
        rp.sort_values(["rts", "r"], kind="stable"),
        left_on="ts", right_on="rts", by=list(by) or None, direction=direction,
        tolerance=None if tolerance is None else pd.Timedelta(seconds=tolerance),
        suffixes=("", "_right"),
    )
    out = asof_join(left, right, "ts", "rts", ["r"], by=by, prefix="m_", direction=direction, tolerance=tolerance, seq="r")
    got = matched(out)
    expected = {int(i): None if np.isnan(r) else int(r) for i, r in zip(want["id"], want["r"])}
    assert got == expected


def test_many_sources_at_once(crowd, many_slices):
    lp, rp, left, right = crowd
    sources = [
        Source(right, "rts", ["r"], "a_", tolerance=60.0, seq="r"),
        Source(right.where("site = 0"), "rts", ["r"], "b_", direction="backward", seq="r"),
    ]
    out = fuse(left, "ts", sources)
    assert out.count() == len(lp)
    alone = matched(asof_join(left, right.where("site = 0"), "ts", "rts", ["r"], prefix="m_", direction="backward", seq="r"))
    assert matched(out, value="b_r") == alone


def test_unique_left_gives_the_same(crowd, many_slices):
    _, _, left, right = crowd
    one = left.dropDuplicates(["ts"])
    how = dict(prefix="m_", tolerance=600.0, seq="r")
    a = asof_join(one, right, "ts", "rts", ["r"], unique_left=True, **how)
    rows = a.select("ts", "m_r").collect()
    b = asof_join(one, right, "ts", "rts", ["r"], **how)
    assert sorted((r["ts"], r["m_r"] or -1) for r in rows) == sorted((r["ts"], r["m_r"] or -1) for r in b.collect())


def test_nearest_row_and_context(spark):
    df = frame(spark, ts=at(*range(0, 3000, 100)), n=list(range(30)))
    assert nearest_row(df, "ts", "2024-01-01 00:00:50").first()["n"] == 1
    for second, first in ((0, 0), (1500, 11), (2900, 22), (99999, 22)):
        instant = str(BASE + pd.Timedelta(seconds=second))
        rows = context_rows(df, "ts", instant, 8).orderBy("rank").collect()
        assert [r["n"] for r in rows] == list(range(first, first + 8))
    few = context_rows(df.where("n < 5"), "ts", "2024-01-01 00:00:00", 8).collect()
    assert len(few) == 5
