"""CSV to typed tables. Everything is read as text first, then converted with ``try_`` functions."""

from __future__ import annotations

import csv
import logging
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gridloom.functions import parse
from gridloom.operators.quality import snake
from gridloom.session import settle

logger = logging.getLogger(__name__)

# Shares a column must reach to count as dates or as numbers, and words of date columns.
DATE_SHARE = 0.5
NUMBER_SHARE = 0.8
DATE_WORDS = ("date", "time", "datetime", "settlement", "start", "end", "period")


CORRUPT = "_corrupt_line"
#: Reads UTF-8 where a whole file is valid UTF-8, else Latin-1.
AUTO = "auto"


def read_text_csv(
    spark: SparkSession, paths: str | Sequence[str], header: bool = True, columns: Sequence[str] | None = None,
    multi_line: bool = False, encoding: str = "UTF-8", file_col: str | None = None,
) -> DataFrame:
    """All columns as strings, each file by its own header line; see :func:`csv_tables`, whose first table this is."""
    return csv_tables(spark, paths, header, columns, multi_line, encoding, file_col)[0]


def csv_tables(
    spark: SparkSession, paths: str | Sequence[str], header: bool = True, columns: Sequence[str] | None = None,
    multi_line: bool = False, encoding: str = "UTF-8", file_col: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The rows of CSV files, all columns as strings, and the lines that don't fit (file, line, fields, expected).

    Names come from the header line of each file (blanks around them removed), or from ``columns`` for all files; columns are
    matched by name, in the order in which headers (by path) bring them in, and a file that lacks one has nulls there. Lines with
    too few fields get nulls at the end; lines with too many for their file are those that don't fit. Blanks before a field are
    dropped. The fields of a line are counted whatever columns are asked for, so a count and the rows always agree.
    ``multi_line`` reads line breaks inside quotes (not in headers); ``encoding`` may be ``auto``; ``file_col`` adds each line's file.

    The first lines are read in one job that stops after them; all files are then read once, whatever number of headers they
    have. The driver gets the distinct header lines. Empty files give nothing.
    """
    paths = paths if isinstance(paths, str) else list(paths)
    headers: list[list[str]] = [list(columns)] if columns is not None else []
    firsts = None
    if columns is None:
        firsts = first_lines(spark, paths, "ISO-8859-1" if encoding == AUTO else encoding)
        found = firsts.groupBy("first").agg(F.min("file").alias("file")).orderBy("file").collect()
        if encoding == AUTO:
            texts = [_utf8_if_valid(r["first"]) for r in found]
        else:
            texts = [r["first"] for r in found]
        headers = [header_names(t) if header else [f"_c{i}" for i in range(len(header_names(t)))] for t in texts]
    if not headers:
        return _no_lines(spark, [], file_col)
    width = max(map(len, headers))
    schema = StructType([StructField(c, StringType()) for c in [*[f"_{i}" for i in range(width)], CORRUPT]])
    lines = (
        spark.read.option("header", header).option("multiLine", multi_line).option("escape", '"')
        .option("encoding", "ISO-8859-1" if encoding == AUTO else encoding)
        .schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("columnPruning", False)
        .option("enforceSchema", True)
        .option("ignoreLeadingWhiteSpace", True)
        .csv(paths)
    )
    lines = lines.select("*", F.col("_metadata.file_path").alias("_file"))
    if encoding == AUTO:
        valid = spark.read.text(paths).groupBy(F.col("_metadata.file_path").alias("_file")).agg(F.min(F.is_valid_utf8("value")).alias("_utf8"))
        lines = lines.join(valid, "_file", "left")
        text = lambda c: F.when(F.col("_utf8"), F.decode(F.encode(c, "ISO-8859-1"), "UTF-8")).otherwise(F.col(c))
        lines = lines.withColumns({f.name: text(f.name) for f in schema})
    # Which of the headers a line stands under.
    if len(headers) == 1:
        lines = lines.withColumn("_head", F.lit(1))
    else:
        which = F.array_position(F.array(*[F.lit(r["first"]) for r in found]), F.col("first")).cast("int")
        lines = lines.join(firsts.select(F.col("file").alias("_file"), which.alias("_head")), "_file")
    # A quoted field counts as one, whatever it holds.
    bare = F.regexp_replace(CORRUPT, r'"([^"]|"")*"', "")
    # The first column is named so that the reader never has the damaged lines alone to deliver.
    fields = F.coalesce(F.length(F.regexp_replace(bare, "[^,]", "")) + 1, F.length("_0") * 0 + width, F.lit(width))
    expected = F.element_at(F.array(*[F.lit(len(h)) for h in headers]), F.col("_head"))
    counted = lines.withColumns({"_fields": fields, "_expected": expected})
    good = counted.where(F.col("_fields") <= F.col("_expected"))
    names = list(dict.fromkeys(c for h in headers for c in h))
    out = []
    for c in names:
        places: dict[int, list[int]] = {}
        for k, h in enumerate(headers, 1):
            if c in h:
                places.setdefault(h.index(c), []).append(k)
        whole = len(places) == 1 and len(next(iter(places.values()))) == len(headers)
        picks = [F.col(f"_{p}") if whole else F.when(F.col("_head").isin(ks), F.col(f"_{p}")) for p, ks in places.items()]
        out.append((picks[0] if len(picks) == 1 else F.coalesce(*picks)).alias(c))
    file = [] if file_col is None else [F.col("_file").alias(file_col)]
    bad = counted.where(F.col("_fields") > F.col("_expected"))
    line = F.coalesce(CORRUPT, F.concat_ws(",", *[f"_{i}" for i in range(width)]))
    return good.select(*out, *file), bad.select(
        F.col("_file").alias("file"), line.alias("line"), F.col("_fields").alias("fields"), F.col("_expected").alias("expected"))


def _no_lines(spark: SparkSession, names: Sequence[str], file_col: str | None) -> tuple[DataFrame, DataFrame]:
    columns = [*names, *([file_col] if file_col else [])] or ["_c0"]
    return (spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns)),
            spark.createDataFrame([], "file string, line string, fields int, expected int"))


def first_lines(spark: SparkSession, paths: str | Sequence[str], encoding: str = "UTF-8") -> DataFrame:
    """(file, first): the first line of each file that has one, written once.

    Every piece of a file is a task of its own here, which ends with its first line, so that files aren't read through.
    """
    cost, most = "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(cost)

    def first(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.slice(0, 1)
                return

    spark.conf.set(cost, spark.conf.get(most))
    try:
        lines = spark.read.schema("value string").option("header", False).option("sep", "\u0001").option("quote", "").option(
            "encoding", encoding).option("maxCharsPerColumn", -1).csv(paths)
        lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
        return settle(lines.mapInArrow(first, lines.schema).where("start = 0").select("file", F.col("value").alias("first")))
    finally:
        spark.conf.set(cost, before)


def header_names(line: str) -> list[str]:
    """The names in a header line; nameless columns and repeated names are told apart by their place."""
    cells = [c.strip() for c in next(csv.reader([line.removeprefix("\ufeff")], skipinitialspace=True), [])]
    names = [c or f"_c{i}" for i, c in enumerate(cells)]
    lowered = [n.lower() for n in names]
    return [n if lowered.count(n.lower()) == 1 else f"{n}{i}" for i, n in enumerate(names)]


def _utf8_if_valid(text: str) -> str:
    """A line read as Latin-1, as UTF-8 if it is."""
    try:
        return text.encode("latin-1").decode("utf-8")
    except UnicodeDecodeError:
        return text


def signal_csv(spark: SparkSession, path: str) -> DataFrame:
    """Two-column frequency files, with or without a header; a header row is a bad row and is dropped.

    Fields beyond the second are ignored.
    """
    raw = (
        spark.read.schema("Date string, Value string")
        .option("header", False)
        .option("mode", "PERMISSIVE")
        .csv(path)
    )
    return signal_rows(raw, "Date", "Value")


def signal_rows(raw: DataFrame, date: str, value: str) -> DataFrame:
    typed = raw.select(parse.timestamp_multi(date).alias("Date"), parse.plain_number(value).alias("Value"))
    return typed.na.drop()


def contract_rows(raw: DataFrame, contract: Mapping[str, str], ts: Column, ts_name: str = "DatetimeUTC") -> DataFrame:
    """Types from the contract (``integer`` as long, else double; ``string`` kept); unexpected
    columns are named in a warning and become doubles; rows without a time are dropped."""
    extra = unexpected_columns(raw, contract)
    if extra:
        logger.warning("columns outside the contract: %s", ", ".join(extra))
    typed = []
    for c in raw.columns:
        kind = contract.get(c)
        if kind == "string":
            typed.append(F.col(c))
        elif kind == "integer":
            typed.append(parse.plain_number(c).try_cast("bigint").alias(c))
        else:
            typed.append(parse.plain_number(c).alias(c))
    return raw.select(ts.alias(ts_name), *typed).na.drop(subset=[ts_name])


def unexpected_columns(raw: DataFrame, contract: Mapping[str, str]) -> list[str]:
    return [c for c in raw.columns if c not in contract]


def aliased_cost(raw: DataFrame, date: str, names: Sequence[str], name: str) -> DataFrame:
    """Cost under the first of several names that is there; rows without date or cost dropped, by date."""
    have = next((c for c in names if c in raw.columns), None)
    cost = F.lit(None).cast("double") if have is None else parse.number(have)
    typed = raw.select(parse.date_multi(date).alias("DatetimeUTC"), cost.alias(name))
    return typed.na.drop().sort("DatetimeUTC")


def chunk_paths(spark: SparkSession, folder: str, chunks: str, whole: str) -> str:
    """The chunk pattern when any chunk exists, else the single old file."""
    try:
        spark.read.text(f"{folder}/{chunks}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return f"{folder}/{whole}"
    return f"{folder}/{chunks}"


def all_double(raw: DataFrame, ts: str) -> DataFrame:
    """Time parsed, every other column as double; rows without a time dropped."""
    numbers = [parse.plain_number(c).alias(c) for c in raw.columns if c != ts]
    return raw.select(parse.timestamp_multi(ts).alias(ts), *numbers).na.drop(subset=[ts])


def weather_rows(raw: DataFrame, date: str, measures: Sequence[str]) -> DataFrame:
    """Float measures, minute-precision ISO dates; rows without a valid date dropped."""
    typed = [F.trim(c).try_cast("float").alias(c) for c in measures]
    day = F.try_to_timestamp(F.trim(date), F.lit("yyyy-MM-dd'T'HH:mm"))
    return raw.select(day.alias(date), *typed).na.drop(subset=[date])


def profile(raw: DataFrame) -> dict[str, str]:
    """``timestamp``, ``double`` or ``string`` per text column, from one pass over the table.

    Columns with nothing but plain numbers are numbers. Else shares count over all rows, so a
    column with many gaps stays text.
    """
    checks = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(raw.columns):
        text = F.nullif(F.trim(c), F.lit(""))
        checks.append(F.count(text).alias(f"n{i}"))
        checks.append(F.count(parse.plain_number(text)).alias(f"p{i}"))
        checks.append(F.count(parse.number(text)).alias(f"x{i}"))
        if any(w in c.lower() for w in DATE_WORDS):
            checks.append(F.count(parse.timestamp_multi(text)).alias(f"d{i}"))
    row = raw.agg(*checks).first().asDict()
    rows = row["rows"] or 1
    kinds = {}
    for i, c in enumerate(raw.columns):
        plain = row[f"n{i}"] > 0 and row[f"p{i}"] == row[f"n{i}"]
        if not plain and row.get(f"d{i}", 0) / rows >= DATE_SHARE:
            kinds[c] = "timestamp"
        elif plain or row[f"x{i}"] / rows >= NUMBER_SHARE:
            kinds[c] = "double"
        else:
            kinds[c] = "string"
    return kinds


def infer_rows(raw: DataFrame) -> DataFrame:
    """Profile, convert, and drop the rows that are null throughout."""
    kinds = profile(raw)
    how = {"timestamp": parse.timestamp_multi, "double": parse.number, "string": F.col}
    return raw.select(*[how[k](c).alias(c) for c, k in kinds.items()]).na.drop("all")


def slug_table(spark: SparkSession, folder: str, slugs: Sequence[str]) -> DataFrame:
    """Like-for-like read of many datasets in one job, each row marked with its slug.

    Every column is kept; a dataset lacking one has null there.
    """
    frames = []
    for slug in slugs:
        frames.append(read_text_csv(spark, f"{folder}/{slug}").withColumn("slug", F.lit(slug)))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def wide_load_rows(lines: DataFrame, delimiter: str = ",") -> DataFrame:
    """Load files with a unit row and a label row above the data, as (file, timestamp, name, value).

    ``lines`` has (file, line_no, line). The header rows are the two lines above the first line
    that starts with a timestamp; they hold one row per file and column, and are joined back.
    """
    cells = lines.withColumn("cells", F.split("line", delimiter))
    stamp = parse.timestamp_multi(F.get("cells", F.lit(0)))
    cells = cells.withColumn("ts", stamp)
    start = cells.where("ts is not null").groupBy("file").agg(F.min("line_no").alias("start"))
    placed = cells.join(start, "file")

    def header(offset: int, name: str) -> DataFrame:
        row = placed.where(F.col("line_no") == F.col("start") - offset)
        return row.select("file", F.posexplode("cells").alias("pos", name)).where("pos > 0")

    heads = header(1, "label").join(header(2, "unit"), ["file", "pos"], "full")
    unit, label = F.lower(F.coalesce("unit", F.lit(""))), snake(F.coalesce("label", F.lit("")))
    metric = (
        F.when(unit.contains("mvar"), "mvar")
        .when(unit.contains("mw"), "mw")
        .when(F.col("pos") % 2 == 1, "mw")
        .otherwise("mvar")
    )
    # Labels that name nothing.
    empty = label.isin("", "mw", "mvar", "power_units", "units", "timestamp", "date", "datetime", "time")
    node = F.concat(F.lit("node_"), F.lpad((F.floor((F.col("pos") - 1) / 2) + 1).cast("string"), 3, "0"))
    named = heads.select(
        "file", "pos", F.concat(F.when(empty, node).otherwise(label), F.lit("_"), metric).alias("name")
    )
    data = placed.where("line_no >= start and ts is not null").select(
        "file", "ts", F.posexplode("cells").alias("pos", "text")
    )
    return (
        data.where("pos > 0")
        .join(named, ["file", "pos"])
        .select("file", "ts", "name", parse.number("text").alias("value"))
    )
