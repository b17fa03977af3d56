"""Sinks: partitioned Parquet, results, replay frames, append-only history, incremental files."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gridloom.functions.clean import finite
from gridloom.functions.features import year_week
from gridloom.functions.parse import iso_z
from gridloom.session import settle

#: Columns of a history table: the signature, and its first digits, which name a folder.
_SIGNATURE, _PREFIX = "_signature", "_prefix"


def write_year_week(
    df: DataFrame, path: str, ts: str | None, source: str | Column, database: str = "unknown", fallback_year: str | int | None = None,
    whole: bool = True,
) -> None:
    """Snappy Parquet under generation=/database=/year=/week=, and a ledger of what each source has written where.

    ``source`` names the input (a file, say, or a column that tells it) by whatever text; inputs that meet in one week stand side by
    side in its files. A rerun writes new files, and then, by its entries in the ledger, takes the place of all that the source
    wrote before: weeks that it no longer has are gone (of an input without rows only if it is named by a text). With
    ``whole=False`` it replaces only the weeks that it holds. A run that breaks off leaves files that no entry names, which
    nobody reads. Rows without a time go to year ``unknown``, week ``00``; an input without any goes to ``fallback_year``.
    Rebalancing by the keys keeps the file count near the partition count, and lets the adaptive planner split a week that holds
    far more rows than the others. One writer per source at a time.
    """
    spark = df.sparkSession
    name = F.lit(source) if isinstance(source, str) else F.coalesce(source.cast("string"), F.lit(""))
    nowhere = {"year": F.lit("unknown"), "week": F.lit("00")}
    keys = {} if ts is None else {k: F.coalesce(column, nowhere[k]) for k, column in year_week(ts).items()}
    if ts is None or (fallback_year is not None and df.where(F.col(ts).isNotNull()).isEmpty()):
        keys = nowhere | ({} if fallback_year is None else {"year": F.lit(str(fallback_year))})
    # Sorts by time; unique, so that a run that breaks off can't be taken for another.
    generation = f"{time.time_ns() // 1000:016d}-{uuid.uuid4().hex[:12]}"
    folder = slug_text(database)
    (
        df.withColumns({"database": F.lit(folder), **keys, "source": name})
        .hint("rebalance", "year", "week")
        .write.option("compression", "snappy")
        # Tasks put their files in place themselves: nobody reads them before the ledger has its entries.
        .option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        .partitionBy("database", "year", "week")
        .parquet(f"{path}/data/generation={generation}")
    )
    written = _read_folders(spark, f"{path}/data/generation={generation}", KEYS)
    entries = written.groupBy("database", "source", "year", "week").agg(F.count("*").alias("rows"))
    if isinstance(source, str):
        # Stands for the source where it has no rows left.
        mark = spark.range(1).select(F.lit(folder).alias("database"), F.lit(source).alias("source"), *[F.lit(None).cast("string").alias(c) for c in ("year", "week")],
                                     F.lit(0).cast("long").alias("rows"))
        entries = entries.unionByName(mark)
    entries = entries.withColumns({"generation": F.lit(generation), "whole": F.lit(whole)})
    entries.select(*[f.split(" ")[0] for f in LEDGER.split(", ")]).coalesce(1).write.mode("append").parquet(f"{path}/ledger")


LEDGER = "database string, source string, year string, week string, rows bigint, generation string, whole boolean"
KEYS = "source string, database string, year string, week string"
PLACE = ["database", "source", "year", "week", "generation"]
UNSAFE = r"[^A-Za-z0-9._-]+"


def slug_text(name: str) -> str:
    """A name that is safe as a folder."""
    return re.sub(UNSAFE, "_", name.strip()) or "unknown"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The entries of the ledger with ``current``: per source and week the newest counts, if no later whole run has replaced it."""
    entries = spark.read.schema(LEDGER).parquet(f"{path}/ledger")
    source = Window.partitionBy("database", "source")
    week = Window.partitionBy("database", "source", "year", "week").orderBy(F.desc("generation"))
    since = F.coalesce(F.max(F.when(F.col("whole"), F.col("generation"))).over(source), F.lit(""))
    newest = (F.row_number().over(week) == 1) & (F.col("generation") >= F.col("since"))
    return entries.withColumn("since", since).withColumn("current", newest).where("year is not null").drop("since")


#: Tasks that list folders: one each would cost more than the listing.
_LISTING = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": "64", "spark.sql.sources.partitionColumnTypeInference.enabled": "false"}


def _read_folders(spark: SparkSession, path: str, schema: str | None = None, merge: bool = False) -> DataFrame:
    """A table of many folders, with the keys as text, so that ``01`` stays ``01``."""
    before = {name: spark.conf.get(name) for name in _LISTING}
    for name, value in _LISTING.items():
        spark.conf.set(name, value)
    try:
        return (spark.read.schema(schema) if schema else spark.read).option("mergeSchema", merge).parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def read_year_week(spark: SparkSession, path: str) -> DataFrame:
    """What the ledger says is there: folders of runs that nothing refers to are pruned, replaced weeks are left out.

    The driver gets the names of the runs.
    """
    entries = read_ledger(spark, path)
    runs = entries.groupBy("generation").agg(F.count_if("current").alias("live"), F.count_if(~F.col("current")).alias("dead")).where("live > 0").collect()
    names = [r["generation"] for r in runs]
    data = _read_folders(spark, f"{path}/data").where(F.col("generation").isin(names))
    if any(r["dead"] for r in runs):
        replaced = entries.where(~F.col("current") & F.col("generation").isin(names)).select(*PLACE)
        data = data.join(replaced, PLACE, "left_anti")
    return data.select(*[c for c in data.columns if c != "generation"])


def damaged_sources(spark: SparkSession, path: str) -> DataFrame:
    """(database, source, missing): sources of which fewer rows are there than the ledger says, and how many fewer."""
    current = read_ledger(spark, path).where("current")
    there = _read_folders(spark, f"{path}/data").groupBy(*PLACE).agg(F.count("*").alias("there"))
    lost = current.join(there, PLACE, "left").withColumn("missing", F.col("rows") - F.coalesce("there", F.lit(0)))
    return lost.where("missing <> 0").groupBy("database", "source").agg(F.sum("missing").alias("missing"))


def compact_year_week(spark: SparkSession, path: str) -> None:
    """Write all that counts anew as one run, a file or few per week, and enter it in the ledger for every source."""
    rows = read_year_week(spark, path)
    generation = f"{time.time_ns() // 1000:016d}-{uuid.uuid4().hex[:12]}"
    rows.hint("rebalance", "database", "year", "week").write.option("compression", "snappy").partitionBy("database", "year", "week").parquet(
        f"{path}/data/generation={generation}")
    written = _read_folders(spark, f"{path}/data/generation={generation}", KEYS)
    entries = written.groupBy("database", "source", "year", "week").agg(F.count("*").alias("rows"))
    entries = entries.withColumns({"generation": F.lit(generation), "whole": F.lit(True)})
    entries.select(*[f.split(" ")[0] for f in LEDGER.split(", ")]).coalesce(1).write.mode("append").parquet(f"{path}/ledger")


def write_results(df: DataFrame, folder: str, formats: Sequence[str] = ("csv", "json", "parquet")) -> None:
    for kind in formats:
        writer = df.write.mode("overwrite").format(kind)
        if kind == "csv":
            writer = writer.option("header", True)
        writer.save(f"{folder}/{kind}")


def replay_frames(df: DataFrame, order: str, times: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """One JSON frame per row: times as ISO-Z (blank when missing), non-finite numbers as null."""
    fields: list[Column] = [iso_z(c).alias(c) for c in times] + [finite(c).alias(c) for c in numbers]
    frame = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return df.select(F.col(order), frame.alias("frame"))


def row_signature(columns: Sequence[str]) -> Column:
    """SHA-1 over the trimmed values, joined by the unit separator; null counts as blank."""
    texts = [F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    return F.sha1(F.concat_ws("\x1f", *texts))


def merged_header(existing: Sequence[str], incoming: Sequence[str]) -> list[str]:
    return [*existing, *[c for c in incoming if c not in existing]]


def reconcile(df: DataFrame, header: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in header])


def new_rows(history: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Batch rows whose signature over the merged header is new, each once."""
    header = merged_header(history.columns if history is not None else [], batch.columns)
    signed = reconcile(batch, header).withColumn("signature", row_signature(header)).dropDuplicates(["signature"])
    if history is not None:
        seen = reconcile(history, header).select(row_signature(header).alias("signature"))
        signed = signed.join(seen, "signature", "left_anti")
    return signed.drop("signature").select(*header)


def lasting_signature(columns: Sequence[str]) -> Column:
    """SHA-1 over the names and trimmed values that aren't blank: a header that grows by a column leaves it as it is."""
    parts = []
    for c in sorted(columns):
        text = F.trim(F.col(f"`{c}`").cast("string"))
        # Lengths keep names and values apart whatever they hold; concat_ws leaves missing parts out.
        parts.append(F.when(text != "", F.concat(F.lit(f"{len(c)}:{c}="), F.length(text).cast("string"), F.lit(":"), text)))
    return F.sha1(F.concat_ws("\x1f", *parts))


def append_history(spark: SparkSession, path: str, batch: DataFrame, history: DataFrame | None = None, digits: int = 2) -> DataFrame:
    """Append the batch rows that the history at ``path`` lacks, each once; gives the history (see :func:`read_history`).

    Every row is stored with its signature, computed once, in folders by the signature's first ``digits`` hex digits. A
    batch meets only signatures, and only those in folders that it touches; the driver learns at most 16 ** digits names.
    A repeated or broken-off append can be run again: what is there already is not added twice. The header may grow. Callers may
    hand back the ``history`` that an earlier append gave; what counts is what is stored at ``path``.
    """
    signed = settle(
        batch.withColumn(_SIGNATURE, lasting_signature(batch.columns)).dropDuplicates([_SIGNATURE])
        .withColumn(_PREFIX, F.left(F.col(_SIGNATURE), F.lit(digits)))
    )
    stored = _read_history(spark, path)
    if stored is not None:
        touched = [r[0] for r in signed.select(_PREFIX).distinct().collect()]
        seen = known_signatures(stored, touched)
        signed = signed.join(seen, [_PREFIX, _SIGNATURE], "left_anti")
    placed = signed.repartition(F.col(_PREFIX)).sortWithinPartitions(_PREFIX, _SIGNATURE)
    placed.write.mode("append").partitionBy(_PREFIX).parquet(path)
    return read_history(spark, path, batch.columns)


def known_signatures(stored: DataFrame, touched: Sequence[str]) -> DataFrame:
    """Signatures of the stored rows in some of the folders; no other column and no other folder is read."""
    return stored.where(F.col(_PREFIX).isin(list(touched))).select(_PREFIX, _SIGNATURE)


def _read_history(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return _read_folders(spark, path, merge=True)
    except AnalysisException as error:
        # Never written, or nothing but empty batches so far.
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_history(spark: SparkSession, path: str, columns: Sequence[str] = ()) -> DataFrame:
    """All rows of a history under its merged header (``columns`` where nothing was ever stored)."""
    stored = _read_history(spark, path)
    if stored is None:
        return spark.createDataFrame([], StructType([StructField(c, StringType()) for c in columns]))
    return stored.drop(_PREFIX, _SIGNATURE)


def pending_files(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files never converted or newer than their last conversion (path, mtime)."""
    done = manifest.groupBy("path").agg(F.max("mtime").alias("_done"))
    joined = listing.join(done, "path", "left")
    return joined.where(F.col("_done").isNull() | (F.col("_done") < F.col("mtime"))).drop("_done")


def file_listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, size and modification time of files, listed by the executors' file source."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", F.col("modificationTime").alias("mtime"), "length")
    )
