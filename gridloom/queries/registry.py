"""Registry of queries and helpers shared by them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The provided tables of one scale folder, opened on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare(spark)
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def signal(self) -> DataFrame:
        """The signal: one sample per event, its id as the tie-breaker."""
        return self.events.select("ts", "event_id", "value")

    def kind(self, event_type: str) -> DataFrame:
        return self.events.where(F.col("event_type") == event_type).select("ts", "event_id", "value")

    def mix(self) -> DataFrame:
        """Hourly wide table: one column per event type, like a fuel mix."""
        hour = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("hour")
        kinds = ("click", "error", "purchase", "signup", "view")
        cents = F.col("value").cast("decimal(18,2)")
        return self.events.groupBy(hour).agg(
            *[F.sum(F.when(F.col("event_type") == k, cents)).cast("double").alias(k) for k in kinds]
        )


MIX_SQL = """SELECT date_trunc('hour', ts) AS hour, {} FROM events GROUP BY 1""".format(
    ", ".join(
        f"CAST(sum(CAST(value AS DECIMAL(18,2))) FILTER (WHERE event_type = '{k}') AS DOUBLE) AS {k}"
        for k in ("click", "error", "purchase", "signup", "view")
    )
)


def query(key: str, sql: str | None = None):
    """Register a query taking the tables; ``sql`` is the statement it must agree with."""

    def register(fn: Callable[[Tables], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = lambda spark, folder: fn(Tables(spark, folder))
        QUERIES[key].__name__ = key
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Doubles rounded, since sums depend on the order of addition in the last bits."""
    names = {c: special.get(c, digits) for c, t in df.dtypes if t in ("double", "float")}
    return df.withColumns({c: F.round(c, d) for c, d in names.items()})

