"""Excursion detector with keyed state: one small record per site, an event-time timer for open tails."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gridloom.streaming.feed import ROCKSDB

OUTPUT = "site string, start_us bigint, end_us bigint, open_tail boolean, duration_s bigint"
STATE = "active boolean, start_us bigint, beyond_rows int, inside_rows int, run_us bigint, last_us bigint"


def runs_of(at: np.ndarray, beyond: np.ndarray) -> list[tuple[bool, int, int, int]]:
    """Runs of equal flags in time order: (flag, rows, first instant, last instant)."""
    order = np.argsort(at, kind="stable")
    at, beyond = at[order], beyond[order]
    edges = np.flatnonzero(np.diff(beyond)) + 1
    starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(at)]))
    return [(bool(beyond[a]), int(b - a), int(at[a]), int(at[b - 1])) for a, b in zip(starts, ends)]


def advance(state: dict, run: tuple[bool, int, int, int], start_rows: int, end_rows: int) -> tuple[int, int] | None:
    """Move the counters by one run of samples; returns (start, end) when an excursion closes."""
    beyond, rows, first, last = run
    count = "beyond_rows" if beyond else "inside_rows"
    if state["last_us"] == 0 or state[count] == 0:
        state["run_us"] = first
    state["beyond_rows"] = state["beyond_rows"] + rows if beyond else 0
    state["inside_rows"] = 0 if beyond else state["inside_rows"] + rows
    state["last_us"] = last
    if beyond and not state["active"] and state["beyond_rows"] >= start_rows:
        state["active"], state["start_us"] = True, state["run_us"]
    if not beyond and state["active"] and state["inside_rows"] >= end_rows:
        state["active"] = False
        return state["start_us"], state["run_us"]
    return None


class ExcursionProcessor(StatefulProcessor):
    """Samples of a site (an instant and a flag each) are sorted inside a micro-batch.

    The size of a micro-batch is set at the source (files per trigger), not by the stream's length.
    """

    def __init__(self, start_rows: int, end_rows: int, min_duration_s: int, idle_s: int):
        self.start_rows, self.end_rows = start_rows, end_rows
        self.min_duration_s, self.idle_us = min_duration_s, idle_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("counters", STATE)

    def _load(self) -> dict:
        names = ("active", "start_us", "beyond_rows", "inside_rows", "run_us", "last_us")
        found = self.state.get()
        return dict(zip(names, found if found else (False, 0, 0, 0, 0, 0)))

    def _frame(self, site: str, spans: list[tuple[int, int, bool]]) -> pd.DataFrame:
        rows = [(site, s, e, tail, (e - s) // 1_000_000) for s, e, tail in spans]
        kept = [r for r in rows if r[4] >= self.min_duration_s]
        return pd.DataFrame(kept, columns=["site", "start_us", "end_us", "open_tail", "duration_s"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [(f["at_us"].to_numpy(), f["beyond"].to_numpy(dtype=bool)) for f in rows]
        at, beyond = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        state, spans = self._load(), []
        for run in runs_of(at, beyond):
            closed = advance(state, run, self.start_rows, self.end_rows)
            if closed:
                spans.append((*closed, False))
        self.state.update(tuple(state.values()))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer((state["last_us"] + self.idle_us) // 1000)
        yield self._frame(key[0], spans)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self._load()
        spans = [(state["start_us"], state["last_us"], True)] if state["active"] else []
        self.state.clear()
        yield self._frame(key[0], spans)

    def close(self) -> None:
        pass


def stream_excursions(
    stream: DataFrame,
    ts: str,
    site: str,
    value: str,
    low: float,
    start_rows: int = 1,
    end_rows: int = 3,
    min_duration_s: int = 2,
    delay: str = "1 hour",
    idle_s: int = 86_400,
) -> DataFrame:
    """Excursions below ``low`` per site. A site silent for ``idle_s`` closes its open excursion."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = (
        stream.withWatermark(ts, delay)
        .withColumn("site", F.coalesce(F.col(site).cast("string"), F.lit("")))
        .withColumn("at_us", F.unix_micros(F.col(ts).cast("timestamp")))
        .withColumn("beyond", F.coalesce(F.col(value) < low, F.lit(False)))
        .select("site", ts, "at_us", "beyond")
    )
    found = rows.groupBy("site").transformWithStateInPandas(
        ExcursionProcessor(start_rows, end_rows, min_duration_s, idle_s), OUTPUT, "Append", "EventTime"
    )
    return found.select(
        "site",
        F.timestamp_micros("start_us").alias("start"),
        F.timestamp_micros("end_us").alias("end"),
        "open_tail",
        "duration_s",
    )


CLUSTERS = "site string, start_us bigint, end_us bigint, points bigint, peak double"
CLUSTER_STATE = "pending binary, last double, start_us bigint, end_us bigint, points bigint, peak double"


class JumpClusterProcessor(StatefulProcessor):
    """Clusters of jumps of one site. Samples wait until the watermark has passed them, and are then taken in order of time.

    Kept per site: the samples younger than the watermark (as bytes: instant, tie, value), the last value before them, and the
    open cluster. A timer comes back for what is left when a site falls silent.
    """

    SAMPLE = np.dtype([("at", "<i8"), ("tie", "<i8"), ("value", "<f8")])

    def __init__(self, delta: float, gap_us: int):
        self.delta, self.gap_us = delta, gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("cluster", CLUSTER_STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = []
        for frame in rows:
            part = np.zeros(len(frame), self.SAMPLE)
            for name in ("at", "tie", "value"):
                part[name] = frame[name].to_numpy()
            # Samples without a value have no part in jumps; they only move time.
            parts.append(part[~np.isnan(part["value"])])
        yield self._step(key[0], parts, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._step(key[0], [], timerValues.getCurrentWatermarkInMs() * 1000)

    def _step(self, site: str, parts: list[np.ndarray], passed_us: int) -> pd.DataFrame:
        found = self.state.get()
        pending, last, start, end, points, peak = found if found else (b"", None, None, None, 0, None)
        waiting = np.concatenate([np.frombuffer(bytes(pending), self.SAMPLE), *parts])
        waiting = waiting[np.lexsort((waiting["tie"], waiting["at"]))]
        ready = waiting[waiting["at"] < passed_us]
        waiting = waiting[len(ready):]
        closed, cluster = jump_clusters(ready["at"], ready["value"], last, (start, end, points, peak), self.delta, self.gap_us)
        last = float(ready["value"][-1]) if len(ready) else last
        if cluster[2] and passed_us > cluster[1] + self.gap_us:
            closed.append(cluster)
            cluster = (None, None, 0, None)
        self.state.update((waiting.tobytes(), last, *cluster))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        wake = [int(waiting["at"][-1])] if len(waiting) else [cluster[1] + self.gap_us] if cluster[2] else []
        for at in wake:
            self.handle.registerTimer(at // 1000 + 2)
        return pd.DataFrame([(site, *c) for c in closed], columns=["site", "start_us", "end_us", "points", "peak"])

    def close(self) -> None:
        pass


def jump_clusters(at: np.ndarray, value: np.ndarray, last: float | None, cluster: tuple, delta: float, gap_us: int) -> tuple[list[tuple], tuple]:
    """Clusters (start, end, points, peak) that end inside samples in order of time, and the one left open."""
    jump = np.abs(np.diff(value, prepend=np.nan if last is None else last))
    hits = np.flatnonzero(jump > delta)
    if not len(hits):
        return [], cluster
    times, size = at[hits], jump[hits]
    cuts = np.flatnonzero(np.diff(times) > gap_us) + 1
    groups = [(int(t[0]), int(t[-1]), len(t), float(s.max())) for t, s in zip(np.split(times, cuts), np.split(size, cuts))]
    closed = []
    if cluster[2]:
        if groups[0][0] - cluster[1] > gap_us:
            closed.append(cluster)
        else:
            first = groups[0]
            groups[0] = (cluster[0], first[1], cluster[2] + first[2], max(cluster[3], first[3]))
    return closed + groups[:-1], groups[-1]


def stream_jump_clusters(
    stream: DataFrame, ts: str, site: str, value: str, delta: float, gap_s: float = 10.0, delay: str = "1 hour", tie: str | None = None,
) -> DataFrame:
    """Clusters of samples whose difference to the site's sample before exceeds ``delta``; a pause longer than ``gap_s`` splits.

    The twin of ``rate_clusters`` per site: samples may arrive in any order within ``delay``; later ones are left out. Of equal
    times the one with the least ``tie`` comes first. Memory per site: its samples within the delay.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = (
        stream.withWatermark(ts, delay)
        .withColumn("site", F.coalesce(F.col(site).cast("string"), F.lit("")))
        .withColumn("at", F.unix_micros(F.col(ts).cast("timestamp")))
        .withColumn("tie", F.coalesce(F.col(tie).cast("long"), F.lit(0)) if tie else F.lit(0).cast("long"))
        .withColumn("value", F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))))
        .select("site", ts, "at", "tie", "value")
    )
    found = rows.groupBy("site").transformWithStateInPandas(JumpClusterProcessor(delta, int(gap_s * 1e6)), CLUSTERS, "Append", "EventTime")
    return found.select("site", F.timestamp_micros("start_us").alias("start"), F.timestamp_micros("end_us").alias("end"), "points", "peak")
