"""Replay, enrichment and append jobs run micro-batch by micro-batch with the batch operators.

A micro-batch is an ordinary DataFrame, so the batch operators keep their spread over slices even
when the whole stream is one signal. What a batch needs from its past is written as a small table
under the batch number; a retried batch reads the same past and overwrites its own output.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.asof import Source, fuse
from gridloom.operators.windows import rocof
from gridloom.session import settle
from gridloom.sources.sink import row_signature
from gridloom.streaming.feed import FILE, ROCKSDB, batch_path, run_batches, run_to_end


def stream_rocof(
    stream: DataFrame, ts: str, value: str, out: str | None = None, state: str | None = None, trigger: dict | None = None
) -> DataFrame:
    """Rate of change per sample; the last sample of the batches before is the only state.

    Batches have to come in order of time: a sample that is older than the newest of the batches before is paired with that one.
    Give ``out`` and ``state`` (folders) to go on where an earlier run ended; the result holds the rows of all runs.
    """
    spark = stream.sparkSession
    signal = stream.select(ts, value).where(F.col(value).isNotNull())

    def each(batch: DataFrame, batch_id: int, folder: str) -> None:
        if batch_id:
            # The batch before always wrote its newest sample, its own or one it took over.
            batch = batch.unionByName(spark.read.schema(signal.schema).parquet(batch_path(folder, "last", batch_id - 1)))
        rocof(batch, ts, value).write.mode("overwrite").parquet(batch_path(folder, "rows", batch_id))
        newest = batch.orderBy(F.col(ts).desc()).limit(1)
        newest.write.mode("overwrite").parquet(batch_path(folder, "last", batch_id))

    folder = run_batches(signal, "rocof", each, out, state, trigger)
    return spark.read.parquet(f"{folder}/rows").drop("batch")


def stream_enrich(
    stream: DataFrame, ts: str, sources: Sequence[Source], out: str | None = None, state: str | None = None, trigger: dict | None = None
) -> DataFrame:
    """Nearest row of each static table for every row of the stream.

    The needed columns of the static tables are written once and read by every micro-batch. Folders and trigger as for
    :func:`stream_rocof`.
    """
    spark = stream.sparkSession
    sources = [replace(s, df=settle(s.df.select(*dict.fromkeys([s.ts, *s.columns, *([s.seq] if s.seq else [])])))) for s in sources]

    def each(batch: DataFrame, batch_id: int, folder: str) -> None:
        fuse(batch, ts, sources).write.mode("overwrite").parquet(batch_path(folder, "rows", batch_id))

    folder = run_batches(stream, "enrich", each, out, state, trigger)
    return spark.read.parquet(f"{folder}/rows").drop("batch")


def stream_append(
    stream: DataFrame, columns: Sequence[str], spread: str = FILE, out: str | None = None, state: str | None = None, trigger: dict | None = None,
    within: tuple[str, str] | None = None,
) -> DataFrame:
    """Append each distinct row once, remembering the signatures seen so far as state.

    ``within`` (time column, delay) bounds the state: a signature is forgotten once the watermark has passed it by the delay, and a
    copy that comes later than that is appended again. Folders and trigger as for :func:`stream_rocof`.

    Copies are first reduced within 64 shares of their source file, so a row repeated without end
    reaches the task of its signature at most 64 times.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    share = F.pmod(F.xxhash64(spread), F.lit(64))
    signed = stream.select(*columns, row_signature(columns).alias("signature"), share.alias("share"))
    if within is None:
        once = signed.dropDuplicates(["signature", "share"]).dropDuplicates(["signature"])
    else:
        at = stream.select(*dict.fromkeys([*columns, within[0], spread])).withWatermark(*within)
        signed = at.select(*dict.fromkeys([*columns, within[0]]), row_signature(columns).alias("signature"), share.alias("share"))
        once = signed.dropDuplicatesWithinWatermark(["signature", "share"]).dropDuplicatesWithinWatermark(["signature"])
    return run_to_end(once.select(*columns), "append", "append", out, state, trigger)
