"""File feeds: a folder of time-ordered Parquet files read as a stream, and how to run one to its end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from gridloom.operators.timeorder import micros, plan_slices
from gridloom.session import scratch_path

FILE = "source_file"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def write_feed(df: DataFrame, ts: str, chunks: int = 4, close: bool = True, close_after_s: int = 86_400) -> str:
    """Lay a table out as consecutive files sets, oldest first, partitioned by year and month.

    The file source reads in order of modification time, so each chunk is written by its own job.
    With ``close`` a last row far behind the end pushes the watermark past every open window; its
    own window stays open and is never emitted.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "feed")
    keyed = df.withColumns({"year": F.year(ts), "month": F.month(ts)})
    cuts = plan_slices(df, micros(ts))
    step = max(1, -(-cuts.n // chunks))
    limits = [None, *list(cuts.cuts)[step - 1 :: step], None]
    for low, high in zip(limits, limits[1:]):
        part = keyed
        if low is not None:
            part = part.where(micros(ts) >= low)
        if high is not None:
            part = part.where(micros(ts) < high)
        part.write.mode("append").partitionBy("year", "month").parquet(path)
    if close:
        last = df.agg(F.max(micros(ts)).alias("t")).first()["t"] or 0
        kind = dict(df.dtypes)[ts]
        at = F.timestamp_micros(F.lit(last + close_after_s * 1_000_000)).cast(kind)
        blanks = [at.alias(ts) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]
        mark = spark.range(1).select(*blanks).withColumns({"year": F.year(ts), "month": F.month(ts)})
        mark.coalesce(1).write.mode("append").partitionBy("year", "month").parquet(path)
    return path


def read_feed(
    spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 8, with_file: bool = False
) -> DataFrame:
    """The feed as a stream, on request with the file of each row; the schema is given, never guessed."""
    full = StructType([*schema.fields, StructField("year", IntegerType()), StructField("month", IntegerType())])
    stream = spark.readStream.schema(full).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return stream.withColumn(FILE, F.col("_metadata.file_path")) if with_file else stream


def seek(stream: DataFrame, ts: str, start: str) -> DataFrame:
    """Start at an instant: whole months before it are pruned, then rows are filtered."""
    at = F.lit(start).cast("timestamp")
    month = F.year(at) * 12 + F.month(at)
    return stream.where((F.col("year") * 12 + F.col("month") >= month) & (F.col(ts).cast("timestamp") >= at))


def run_to_end(
    stream: DataFrame, label: str, mode: str = "append", out: str | None = None, state: str | None = None,
    trigger: dict | None = None,
) -> DataFrame:
    """Run over everything there is into a Parquet table, and read that table.

    Give ``out`` and ``state`` (folders) to go on where an earlier run ended, ``trigger`` for another than ``availableNow``.
    """
    spark = stream.sparkSession
    out = out or scratch_path(spark, label)
    started = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", out)
        .option("checkpointLocation", state or scratch_path(spark, f"{label}-state"))
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(
    stream: DataFrame, label: str, each: Callable[[DataFrame, int, str], None], out: str | None = None,
    state: str | None = None, trigger: dict | None = None,
) -> str:
    """Run ``each(batch, batch_id, folder)`` over all micro-batches; returns the folder.

    A batch that is retried must write the same place again, see :func:`batch_path`. Folders and trigger as for
    :func:`run_to_end`.
    """
    spark = stream.sparkSession
    out = out or scratch_path(spark, label)
    started = (
        stream.writeStream.foreachBatch(lambda batch, batch_id: each(batch, batch_id, out))
        .option("checkpointLocation", state or scratch_path(spark, f"{label}-state"))
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
    started.awaitTermination()
    return out


def batch_path(folder: str, table: str, batch_id: int) -> str:
    return f"{folder}/{table}/batch={batch_id}"

