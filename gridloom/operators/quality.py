"""Contract, header and freshness jobs over catalogues held as DataFrames.

A catalogue has one row per (dataset, column): ``dataset, position, name``. Contracts, header
mappings and listings are DataFrames too, so the jobs scale with the number of datasets.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.timeorder import position_in_group

PLACEHOLDER = "all raw columns"
# Punctuation and the words that replace it.
PUNCTUATION_WORDS = {"%": " percent ", "#": " number ", "&": " and "}
SPACED = r"[/\\()\[\]{}\-.:;,]"
# Words with a fixed replacement.
ID_WORDS = ("no", "num", "number")
TIME_WORDS = ("dt", "dttm", "datetime")


def _c(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, however often ``use`` names it (Spark repeats it at every place)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _whole_words(words: Sequence[str]) -> str:
    return rf"(?<!\S)(?:{'|'.join(words)})(?!\S)"


def snake(text: str | Column) -> Column:
    """Header text in snake case, adjacent equal words collapsed."""
    body = F.lower(F.trim(_c(text)))
    for mark, word in PUNCTUATION_WORDS.items():
        body = F.replace(body, F.lit(mark), F.lit(word))
    body = F.regexp_replace(body, SPACED, " ")
    body = F.regexp_replace(F.regexp_replace(body, _whole_words(ID_WORDS), "id"), _whole_words(TIME_WORDS), "timestamp")
    words = F.split(F.trim(F.regexp_replace(body, r"[^a-z0-9_\s]", "")), r"\s+")
    collapsed = _once(
        F.array_remove(words, ""), lambda kept: F.filter(kept, lambda w, i: (i == 0) | (w != F.get(kept, i - 1)))
    )
    return F.array_join(collapsed, "_")


def unique_headers(df: DataFrame, dataset: str, header: str, position: str, name: str = "unique_name") -> DataFrame:
    """``__k`` after the k-th use of a header in a dataset; blank headers are ``unnamed``."""
    base = F.coalesce(F.nullif(F.trim(F.col(header)), F.lit("")), F.lit("unnamed"))
    numbered = position_in_group(df.withColumn("_base", base), [dataset, "_base"], [position], "_at")
    nth = F.col("_at") + 1
    unique = F.when(nth == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("__"), nth.cast("string")))
    return numbered.withColumn(name, unique).drop("_base", "_at")


# Header tokens that hint at a type, tried in this order.
DTYPE_TOKENS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("timestamp", (" timestamp ", " datetime ", " utc ", "time_stamp")),
    ("date", (" date ", "_date", "date_", "trading_day", "settlement_date")),
    ("int64", ("year", "month", "day", "hour", "minute", "week", "period", "index")),
    ("bool", (" is_", " has_", " flag ", " enabled ", " active ", "boolean")),
    (
        "float64",
        (
            " mw", " mvar", "mwh", "kwh", " kw", " kv", "voltage", "current", "temperature", " temp ", "speed",
            "pressure", "load", "demand", "generation", "forecast", "price", "cost", "amount", "rate", "ratio",
            "percent", "power", "energy", "value", "latitude", "longitude", " lat", " lon",
        ),
    ),
)


def dtype_hint(source: str | Column, normal: str | Column) -> Column:
    """Type suggested by the words of a header; text when no word helps."""
    # Every test below names both texts.
    return _once(
        _c(normal),
        lambda n: _once(F.lower(F.concat(F.lit(" "), _c(source), F.lit(" "), n, F.lit(" "))), lambda t: _hint(n, t)),
    )


def _hint(normal: Column, text: Column) -> Column:
    hint = F.when(normal.isin("timestamp", "timestamp_utc") | normal.endswith("_timestamp"), "timestamp").when(
        normal.endswith("_mw") | normal.endswith("_mvar"), "float64"
    )
    for kind, tokens in DTYPE_TOKENS:
        hint = hint.when(reduce(lambda a, b: a | b, [text.contains(t) for t in tokens]), kind)
    return hint.otherwise("string")


def validate_contract(contract: DataFrame, catalogue: DataFrame, require: bool = False) -> DataFrame:
    """PASS/FAIL/SKIP/WARN per (dataset, target) with the missing and unexpected columns.

    Contract rows are (dataset, target, name), with a null name for a target that lists no
    columns; catalogue rows are (dataset, target, name). A target nothing was found for is skipped,
    or fails with ``require``.
    """
    expected = contract.where("name is not null").distinct().withColumn("_want", F.lit(1))
    actual = catalogue.distinct().withColumn("_have", F.lit(1))
    compared = (
        expected.join(actual, ["dataset", "target", "name"], "full")
        .groupBy("dataset", "target")
        .agg(
            F.count("_want").alias("expected"),
            F.count("_have").alias("actual"),
            F.count_if(F.lower("name").contains(PLACEHOLDER) & F.col("_want").isNotNull()).alias("loose"),
            F.array_sort(F.collect_list(F.when(F.col("_have").isNull(), F.col("name")))).alias("missing"),
            F.array_sort(F.collect_list(F.when(F.col("_want").isNull(), F.col("name")))).alias("unexpected"),
        )
    )
    # Names per dataset are header-sized; the lists cannot grow with the rows of the data.
    targets = contract.select("dataset", "target").distinct()
    known = targets.join(compared, ["dataset", "target"], "left")
    status = (
        F.when(F.coalesce("actual", F.lit(0)) == 0, "FAIL" if require else "SKIP")
        .when(F.coalesce("expected", F.lit(0)) == 0, "WARN")
        .when(F.col("loose") > 0, "SKIP")
        .when((F.size("missing") == 0) & (F.size("unexpected") == 0), "PASS")
        .otherwise("FAIL")
    )
    failed = F.col("status") == "FAIL"
    return known.withColumn("status", status).select(
        "dataset",
        "target",
        "status",
        F.when(failed, F.array_join("missing", ",")).otherwise("").alias("missing"),
        F.when(failed, F.array_join("unexpected", ",")).otherwise("").alias("unexpected"),
    )


def bump_patch(version: str, changed: bool) -> str:
    """Next patch version when something changed."""
    if not changed:
        return version
    head, _, patch = version.rpartition(".")
    return f"{head}.{int(patch) + 1}" if patch.isdigit() and head else f"{version}.1"


def normalise_contract(discovered: DataFrame, existing: DataFrame, stored: DataFrame) -> DataFrame:
    """One list of columns per dataset: the discovered one, else the existing, else the stored one.

    Each input has (dataset, position, name, type); a name typed in two ways becomes ``mixed``.
    """
    ranked = (
        discovered.withColumn("_level", F.lit(0))
        .unionByName(existing.withColumn("_level", F.lit(1)))
        .unionByName(stored.withColumn("_level", F.lit(2)))
    )
    best = ranked.groupBy("dataset").agg(F.min("_level").alias("_level"))
    chosen = ranked.join(best, ["dataset", "_level"])
    merged = chosen.groupBy("dataset", "name").agg(
        F.min("position").alias("position"), F.min("type").alias("_low"), F.max("type").alias("_high")
    )
    kind = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise("mixed")
    return merged.select("dataset", "position", "name", kind.alias("type"))


def header_template(catalogue: DataFrame) -> DataFrame:
    """Per dataset: number of files, number of distinct columns and their sorted names."""
    names = catalogue.groupBy("dataset", "name").agg(F.count(F.lit(1)).alias("uses"))
    columns = names.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("columns"), F.array_sort(F.collect_list("name")).alias("names")
    )
    files = catalogue.select("dataset", "file").distinct().groupBy("dataset").agg(F.count(F.lit(1)).alias("files"))
    return columns.join(files, "dataset")


def distinct_headers(catalogue: DataFrame) -> DataFrame:
    return catalogue.select("dataset", "name").distinct()


def _compare_headers(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per dataset: header cells before and after, and cells that do not agree.

    Two headers are equal when they have the same names at the same positions. Cells are counted
    with opposite signs and combined before the shuffle; no header is gathered in one place.
    """
    cells = before.select("dataset", "position", "name", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        after.select("dataset", "position", "name", F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    counted = cells.groupBy("dataset", "position", "name").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return counted.groupBy("dataset").agg(
        F.sum("a").alias("before"), F.sum("b").alias("after"), F.count_if(F.col("a") != F.col("b")).alias("unequal")
    )


def header_roundtrip(source: DataFrame, output: DataFrame) -> DataFrame:
    """Whether each source header came through unchanged and in order."""
    compared = _compare_headers(source, output).where("before > 0")
    return compared.select(
        "dataset", F.col("before").alias("columns"), (F.col("unequal") == 0).cast("int").alias("same")
    )


def header_drift(previous: DataFrame, current: DataFrame) -> DataFrame:
    """changed / removed / added / same per dataset."""
    state = (
        F.when(F.col("after") == 0, "removed")
        .when(F.col("before") == 0, "added")
        .when(F.col("unequal") > 0, "changed")
        .otherwise("same")
    )
    return _compare_headers(previous, current).select("dataset", state.alias("state"))


def merge_mapping(fresh: DataFrame, earlier: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Automatic mapping with every non-blank earlier value kept, matched on the k-th use of a header (few in a file)."""
    nth = F.row_number().over(Window.partitionBy("dataset", "header").orderBy("position")) - 1
    new = fresh.withColumn("nth", nth)
    old = earlier.withColumn("nth", nth).select(
        "dataset", "header", "nth", *[F.col(f).alias(f"_old_{f}") for f in fields]
    )
    joined = new.join(old, ["dataset", "header", "nth"], "left")
    kept = {f: F.coalesce(F.nullif(F.trim(f"_old_{f}"), F.lit("")), F.col(f)) for f in fields}
    return joined.withColumns(kept).withColumn("nth", F.col("nth") + 1).drop(*[f"_old_{f}" for f in fields])


def freshness(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """ok / missing / stale per input: newest output of the same (dataset, stem) against its time."""
    newest = outputs.groupBy("dataset", "stem").agg(F.max("mtime").alias("output_mtime"))
    joined = inputs.join(newest, ["dataset", "stem"], "left")
    state = (
        F.when(F.col("output_mtime").isNull(), "missing")
        .when(F.col("output_mtime") < F.col("mtime"), "stale")
        .otherwise("ok")
    )
    return joined.withColumn("state", state)


def dropped_rows(df: DataFrame, source: str, usable: Column) -> DataFrame:
    """Rows read, kept and dropped per source."""
    ok = F.coalesce(usable, F.lit(False))
    return df.groupBy(source).agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(ok).alias("rows_kept"),
        F.count_if(~ok).alias("rows_dropped"),
    )
