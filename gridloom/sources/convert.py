"""Conversion job: files that are new or newer than their last conversion become partitioned Parquet, and are recorded."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import settle
from gridloom.sources.ingest import csv_tables
from gridloom.sources.sink import damaged_sources, file_listing, pending_files, write_year_week

SOURCE = "source_file"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The files converted so far (path, mtime); empty before the first run."""
    try:
        return spark.read.schema("path string, mtime timestamp").parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, mtime timestamp")


def convert_pending(
    spark: SparkSession, folder: str, out: str, manifest: str, typed: Callable[[DataFrame], DataFrame], ts: str,
    pattern: str = "*.csv", database: str = "unknown", fallback_year: str | int | None = None, quarantine: str | None = None,
    encoding: str = "UTF-8", verify: bool = False,
) -> DataFrame:
    """Convert the CSV files of a folder that wait for it, all in one job; returns them (path, mtime).

    ``typed`` turns text columns into typed ones and keeps ``source_file``; every file is read by its own header. Lines with more
    fields than their file's header go to the table at ``quarantine`` (file, line, fields, expected), where one is named. With ``verify`` files whose rows
    have since been lost from ``out`` wait as well. A file replaces only what it wrote before. It is
    recorded after its rows are written, so a run that breaks off is repeated; a second run finds nothing to do. The driver
    gets the names of the waiting files.
    """
    waiting = settle(pending_files(file_listing(spark, folder, pattern), read_manifest(spark, manifest)).select("path", "mtime"))
    if verify:
        lost = _lost(spark, out).select(F.col("source").alias("_source"))
        again = file_listing(spark, folder, pattern).join(lost, _source_name("path", folder) == F.col("_source"), "left_semi")
        waiting = settle(waiting.union(again.select("path", "mtime")).distinct())
    paths = [r["path"] for r in waiting.select("path").collect()]
    if paths:
        found, misfits = csv_tables(spark, paths, encoding=encoding, file_col=SOURCE)
        rows = typed(found)
        write_year_week(rows, out, ts, _source_name(SOURCE, folder), database, fallback_year)
        if quarantine is not None:
            misfits.write.mode("append").parquet(quarantine)
        waiting.write.mode("append").parquet(manifest)
    return waiting


def _source_name(path_col: str, folder: str) -> Column:
    """A file's place below the folder."""
    return F.regexp_replace(F.col(path_col), "^.*?/" + re.escape(folder.rstrip("/").rpartition("/")[2]) + "/", "")


def _lost(spark: SparkSession, out: str) -> DataFrame:
    """Damaged sources; none before the first run."""
    try:
        return damaged_sources(spark, out)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "database string, source string, missing bigint")
