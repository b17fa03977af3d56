"""CSV files whose headers, encodings and line lengths differ."""

from pyspark.sql import functions as F

from gridloom.functions import parse
from gridloom.sources import convert, ingest, sink


def lay(tmp_path, files):
    for name, content in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(tmp_path)


MIXED = {
    "1.csv": "ts,a,b\n2024-01-01 00:00:00,1,2\n2024-01-01 00:00:01,3,4,5\n",
    "2.csv": "ts,b,a\n2024-01-01 00:00:02,2,1\n",
    "3.csv": "ts,a,b,c\n2024-01-01 00:00:03,1,2,3\n2024-01-01 00:00:04,1\n",
    "4.csv": "",
}


def test_each_file_by_its_own_header(spark, tmp_path):
    good, bad = ingest.csv_tables(spark, lay(tmp_path, MIXED), file_col="f")
    assert good.columns == ["ts", "a", "b", "c", "f"]
    rows = sorted((r.ts[-2:], r.a, r.b, r.c, r.f[-5:]) for r in good.collect())
    assert rows == [("00", "1", "2", None, "1.csv"), ("02", "1", "2", None, "2.csv"), ("03", "1", "2", "3", "3.csv"), ("04", "1", None, None, "3.csv")]
    assert [(r.line, r.fields, r.expected) for r in bad.collect()] == [("2024-01-01 00:00:01,3,4,5", 4, 3)]
    assert good.count() == 4 and good.select("b").count() == 4


def test_quotes_blanks_and_repeated_names(spark, tmp_path):
    files = {"a.csv": '﻿ "x, y" , ,n,N\n"1,2", 3,4,5\n', "b.csv": 'n0,"x, y"\n6,"say ""hi"", you"\n', "c.csv": "only a header\n"}
    got = {tuple(r) for r in ingest.read_text_csv(spark, lay(tmp_path, files)).collect()}
    names = ingest.read_text_csv(spark, str(tmp_path)).columns
    assert names == ["x, y", "_c1", "n2", "N3", "n0", "only a header"]
    assert got == {("1,2", "3", "4", "5", None, None), ('say "hi", you', None, None, None, "6", None)}


def test_longest_header_is_not_a_limit_for_the_others(spark, tmp_path):
    """A line with as many fields as the widest file has doesn't fit a narrow one."""
    good, bad = ingest.csv_tables(spark, lay(tmp_path, {"a.csv": "x\n1\n2,3\n", "b.csv": "x,y\n4,5\n6,7,8\n"}))
    assert sorted(map(tuple, good.collect())) == [("1", None), ("4", "5")]
    assert sorted((r.line, r.fields, r.expected) for r in bad.collect()) == [("2,3", 2, 1), ("6,7,8", 3, 2)]


def test_encoding_of_each_file(spark, tmp_path):
    files = {"u.csv": "naïve,x\né,1\n", "l.csv": "naïve,y\nÿ£,2\n".encode("latin-1"), "e.csv": "z\nplain\n"}
    good = ingest.read_text_csv(spark, lay(tmp_path, files), encoding=ingest.AUTO)
    assert set(good.columns) == {"naïve", "x", "y", "z"}
    got = {(r["naïve"], r["x"], r["y"], r["z"]) for r in good.collect()}
    assert got == {("é", "1", None, None), ("ÿ£", None, "2", None), (None, None, None, "plain")}


def test_first_lines_of_large_and_small_files(spark, tmp_path):
    files = {f"{i}.csv": f"h{i % 3}\n" + "v\n" * (i * 50) for i in range(12)}
    files["large.csv"] = "wide,h1\n" + "1,2\n" * 300_000
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        folder = lay(tmp_path, files)
        found = {r["file"].rpartition("/")[2]: r["first"] for r in ingest.first_lines(spark, folder).collect()}
        assert found == {name: text.split("\n")[0] for name, text in files.items()}
        got = ingest.read_text_csv(spark, folder).agg(*[F.count(c).alias(c) for c in ("h0", "h1", "h2", "wide")]).first()
        assert tuple(got) == (50 * (0 + 3 + 6 + 9), 50 * (1 + 4 + 7 + 10) + 300_000, 50 * (2 + 5 + 8 + 11), 300_000)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_no_files_with_lines(spark, tmp_path):
    good, bad = ingest.csv_tables(spark, lay(tmp_path, {"a.csv": "", "b.csv": ""}), file_col="f")
    assert good.count() == bad.count() == 0 and "f" in good.columns


def test_conversion_of_differing_files(spark, tmp_path):
    """Values keep their columns, lines that don't fit are kept apart, a second run finds nothing to do."""
    folder = lay(tmp_path / "in", MIXED)
    out, manifest, quarantine = (str(tmp_path / n) for n in ("out", "manifest", "quarantine"))

    def typed(raw):
        return raw.select(parse.timestamp_multi("ts").alias("ts"), *[parse.plain_number(c).alias(c) for c in ("a", "b")], convert.SOURCE)

    done = convert.convert_pending(spark, folder, out, manifest, typed, "ts", quarantine=quarantine)
    assert done.count() == 3  # the file listing has no empty files
    assert sorted((r.a, r.b) for r in sink.read_year_week(spark, out).na.fill(-1.0).collect()) == [(1.0, -1.0), (1.0, 2.0), (1.0, 2.0), (1.0, 2.0)]
    assert [r.line for r in spark.read.parquet(quarantine).collect()] == ["2024-01-01 00:00:01,3,4,5"]
    assert convert.convert_pending(spark, folder, out, manifest, typed, "ts", quarantine=quarantine).count() == 0
