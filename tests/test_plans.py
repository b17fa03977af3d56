"""Shape of the plans: pushdown, no nested loops, no data row in a single-partition window."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from gridloom.queries import QUERIES
from gridloom.queries.registry import Tables

FOLDER = "/root/testdata/sf0.01"


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize(
    "key",
    ["rocof", "lag_features", "rolling_stats", "rolling_quantile", "sample_dt", "label_changes", "breach_windows", "lfdd_events",
     "asof_nearest", "asof_by_site", "time_in_band", "bucket_targets"],
)
def test_no_nested_loop_and_no_single_task(spark, key):
    text = plan(QUERIES[key](spark, FOLDER))
    assert "NestedLoop" not in text and "CartesianProduct" not in text
    # Tables with one row per slice are the only ones a single task may order.
    for block in text.split("\n\n"):
        if "SinglePartition" in block:
            assert "value" not in block or "_slice" in block


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["scan_date_range"](spark, FOLDER))
    assert "GreaterThanOrEqual(ts" in text and "LessThanOrEqual(ts" in text and "props" not in text
    df = QUERIES["scan_year"](spark, FOLDER)
    assert "year" in plan(df).split("PartitionFilters: [")[1].split("]")[0]
    # Only the folders of the two years are read.
    names = "|".join(str(r[0]) for r in df.select(F.input_file_name()).distinct().collect())
    assert "year=1996" in names and "year=1998" in names and "year=1995" not in names


def test_top_rows_use_a_distributed_top_k(spark):
    assert "TakeOrderedAndProject" in plan(QUERIES["head_rows"](spark, FOLDER))
    assert "WindowGroupLimit" in plan(QUERIES["last_n"](spark, FOLDER))


def test_partition_filter_prunes_files(spark, tmp_path):
    from gridloom.sources import scan, sink

    path = str(tmp_path / "weeks")
    t = Tables(spark, FOLDER)
    sink.write_year_week(t.lineitem.select("l_orderkey", "l_shipdate"), path, "l_shipdate", "lines")
    text = plan(scan.scan_years(sink.read_year_week(spark, path).withColumn("y", F.col("year")), [1996], "year"))
    assert "PartitionFilters: [" in text and "year" in text.split("PartitionFilters: [")[1].split("]")[0]


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from gridloom.session import shared_folder

    def session(master, named=None):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda folder: None)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named), sparkContext=context)

    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(session(master))
        assert shared_folder(session(master, "file:///shared/")) == "file:///shared"
    assert shared_folder(session("local[4]"))


def test_sketches_are_merged_in_two_steps(spark):
    """No reducer merges the sketches of all tasks: shares of them first, then one sketch per share."""
    from gridloom.operators import timeorder

    t = Tables(spark, FOLDER)
    text = plan(timeorder._tree_marks(t.events, timeorder.micros("ts"), 64))
    assert text.count("Exchange") >= 2 and "kll_merge_agg" in text and "percentile_approx" not in text
    rows, marks = timeorder._sketch(t.events, timeorder.micros("ts"), 64)
    assert rows == t.events.count() and marks == sorted(marks) and len(marks) == 63
    assert timeorder._sketch(t.events.limit(0), timeorder.micros("ts"), 64) == (0, [])
    assert timeorder._SHARES <= 1000


def test_one_instant_reads_a_narrow_interval(spark):
    from gridloom.operators.asof import nearest_row

    t = Tables(spark, FOLDER)
    text = plan(nearest_row(t.signal(), "ts", "2024-01-15 12:00:00"))
    assert "GreaterThanOrEqual(ts" in text and "LessThanOrEqual(ts" in text
    # Nothing near: the whole table is looked at.
    far = nearest_row(t.signal(), "ts", "1950-01-01 00:00:00").first()
    assert far["ts"] == t.signal().agg(F.min("ts")).first()[0]


@pytest.mark.parametrize("key", ["asof_nearest", "asof_by_site", "fusion_chain"])
def test_context_rows_are_combined_without_a_sort(spark, key):
    """Rows of fixed size are aggregated by hash before they are shuffled."""
    assert "SortAggregate" not in plan(QUERIES[key](spark, FOLDER))
