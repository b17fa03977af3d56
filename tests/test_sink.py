"""The partitioned sink: generations, the ledger, lost files."""

import glob
import os

from pyspark.sql import functions as F

from gridloom.sources import sink


def table(spark, rows):
    return spark.createDataFrame(rows, "i int, d string").withColumn("d", F.col("d").cast("timestamp"))


def there(spark, path):
    return sorted((r.source, r.i, r.year, r.week) for r in sink.read_year_week(spark, path).collect())


def test_a_rerun_takes_the_place_of_its_source_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(1, "2024-01-03"), (2, "2024-02-07"), (3, None)]
    for source in ("a b", "a_b", "a/b"):
        sink.write_year_week(table(spark, rows), path, "d", source)
    assert len(there(spark, path)) == 9
    sink.write_year_week(table(spark, [(4, "2024-02-07")]), path, "d", "a b")
    assert [x for x in there(spark, path) if x[0] == "a b"] == [("a b", 4, "2024", "06")] and len(there(spark, path)) == 7
    sink.write_year_week(table(spark, [(5, "2024-02-08")]), path, "d", "a_b", whole=False)
    assert [x[1] for x in there(spark, path) if x[0] == "a_b"] == [1, 3, 5]
    sink.write_year_week(table(spark, []), path, "d", "a/b")
    assert {x[0] for x in there(spark, path)} == {"a b", "a_b"}
    before = there(spark, path)
    sink.compact_year_week(spark, path)
    assert there(spark, path) == before
    files = [r[0] for r in sink.read_year_week(spark, path).select(F.input_file_name()).distinct().collect()]
    assert len({f.split("generation=")[1].split("/")[0] for f in files}) == 1


def test_sources_from_a_column_and_broken_runs(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = table(spark, [(1, "2024-01-03"), (2, "2024-01-03"), (3, "2024-01-03")])
    sink.write_year_week(rows, path, "d", F.when(F.col("i") < 3, F.concat(F.lit("s"), F.col("i").cast("string"))))
    sink.write_year_week(rows.where("i = 2").withColumn("i", F.lit(20)), path, "d", F.lit("s2"))
    assert [x[:2] for x in there(spark, path)] == [("", 3), ("s1", 1), ("s2", 20)]
    # Files of a run that ended before its entry was made.
    rows.withColumn("source", F.lit("s1")).withColumns({"database": F.lit("unknown"), "year": F.lit("2024"), "week": F.lit("01")}).write.partitionBy(
        "database", "year", "week").parquet(f"{path}/data/generation=9999999999999999-broken")
    assert [x[:2] for x in there(spark, path)] == [("", 3), ("s1", 1), ("s2", 20)]


def test_lost_files_are_noticed(spark, tmp_path):
    path = str(tmp_path / "t")
    for source, day in (("x", "2024-01-03"), ("y", "2024-05-01")):
        sink.write_year_week(table(spark, [(1, day), (2, "2024-03-01")]), path, "d", source)
    assert sink.damaged_sources(spark, path).count() == 0
    for file in glob.glob(f"{path}/data/*/*/year=2024/week=18/*.parquet"):
        os.remove(file)
    assert [tuple(r) for r in sink.damaged_sources(spark, path).collect()] == [("unknown", "y", 1)]


def history(spark, path):
    found = sink.read_history(spark, path, ["a"])
    return sorted(tuple(sorted((k, v) for k, v in r.asDict().items() if v)) for r in found.collect())


def test_history_keeps_each_row_once_while_its_header_grows(spark, tmp_path):
    path = str(tmp_path / "h")
    assert sink.append_history(spark, path, spark.createDataFrame([], "a string, b string")).count() == 0
    first = spark.createDataFrame([("1", " x "), ("1", "x"), ("2", None), ("2", ""), (None, None)], "a string, b string")
    got = sink.append_history(spark, path, first)
    assert got.columns == ["a", "b"] and got.count() == 3
    assert sink.append_history(spark, path, first).count() == 3
    # A new column, blank or missing in the rows that are there; other order of columns.
    wider = spark.createDataFrame([("x", "1", None), ("x", "1", "new"), ("", "2", " ")], "b string, a string, c string")
    got = sink.append_history(spark, path, wider)
    assert set(got.columns) == {"a", "b", "c"} and got.count() == 4
    assert sink.append_history(spark, path, first.unionByName(wider, allowMissingColumns=True)).count() == 4
    assert history(spark, path)[-1] == (("a", "2"),) and (("a", "1"), ("b", "x"), ("c", "new")) in history(spark, path)
    # Values can't run over into each other.
    sly = spark.createDataFrame([("1\x1f1:b=1:x", None)], "a string, b string")
    assert sink.append_history(spark, path, sly).count() == 5


def test_a_batch_reads_only_signatures_of_folders_that_it_touches(spark, tmp_path):
    path = str(tmp_path / "h")
    sink.append_history(spark, path, spark.range(3000).select(F.col("id").cast("string").alias("a"), F.lit("v").alias("b")))
    stored = sink._read_history(spark, path)
    assert stored.select("_prefix").distinct().count() == 256
    seen = sink.known_signatures(stored, ["0a", "ff"])
    assert len(set(f.rsplit("/", 2)[1] for f in (r[0] for r in seen.select(F.input_file_name()).distinct().collect()))) == 2
    text = seen._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<_signature:string>" in text and "PartitionFilters: [" in text and "sha1" not in text
    again = spark.createDataFrame([("5", "v"), ("3000", "v")], "a string, b string")
    assert sink.append_history(spark, path, again).count() == 3001
