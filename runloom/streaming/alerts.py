"""Alerts while runs are going on: chains of failed calls and falls of the context window."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from runloom import vocab
from runloom.operators.slices import carry, islands, running, with_slice

#: What is watched: one row per call or step, in event order (at, step_idx, pos). ``failed`` is null for rows without a call, ``occupancy`` for rows without a prompt.
WATCHED = "traj_id long, at long, step_idx long, pos long, failed boolean, occupancy long"
ALERTS = "traj_id long, kind string, step_idx long, pos long, value long, before long"
#: Failed calls in a row that raise an alert.
LEAST = 3


def watched(steps: DataFrame, calls: DataFrame, failed) -> DataFrame:
    """The calls and prompts of runs as rows to watch; a step's prompt (pos -1) comes before its calls, at the step's time."""
    prompts = steps.filter("role = 'assistant' and time_created_ms is not null").select(
        "traj_id", F.col("time_created_ms").alias("at"), "step_idx", F.lit(-1).cast("bigint").alias("pos"), F.lit(None).cast("boolean").alias("failed"),
        F.when(F.col("tokens.total") > 0, F.col("tokens.total")).alias("occupancy"),
    )
    used = calls.join(prompts.select("traj_id", "step_idx", "at"), ["traj_id", "step_idx"]).select(
        "traj_id", "at", "step_idx", F.col("call_pos").cast("bigint").alias("pos"), failed.alias("failed"), F.lit(None).cast("bigint").alias("occupancy")
    )
    return prompts.unionByName(used)


def batch_alerts(rows: DataFrame, least: int = LEAST, ratio: float = vocab.DROP_RATIO) -> DataFrame:
    """The alerts of finished runs.

    ``failure_chain`` is raised once a chain, at its ``least``-th failed call (value: its number, before: the step where the
    chain began). ``occupancy_drop`` is raised where a prompt is smaller than ``ratio`` of the one before it.
    """
    order = ["step_idx", "pos"]
    called = with_slice(rows.filter("failed is not null"))
    called = running(called, {"_n": F.lit(1)}, order=order)
    chains = islands(called.select("traj_id", "slice", F.col("_n").alias("n"), "failed", "step_idx", "pos"), ["failed"], idx="n").filter("failed")
    nth = F.col("n") - F.col("island") + 1
    begun = chains.filter(nth == 1).select("traj_id", "island", F.col("step_idx").alias("before"))
    raised = chains.filter(nth == least).join(begun, ["traj_id", "island"]).select("traj_id", F.lit("failure_chain").alias("kind"), "step_idx", "pos", F.lit(least).cast("bigint").alias("value"), "before")
    prompts = carry(with_slice(rows.filter("occupancy is not null")), {"_last": F.col("occupancy")}, order=order)
    drops = prompts.filter(F.col("occupancy") < F.col("_last") * ratio).select("traj_id", F.lit("occupancy_drop").alias("kind"), "step_idx", "pos", F.col("occupancy").alias("value"), F.col("_last").alias("before"))
    return raised.unionByName(drops)


class Watcher(StatefulProcessor):
    """One run. Rows wait until the watermark has passed them, so they are read in event order whatever batch brings them."""

    def __init__(self, least: int, ratio: float, quiet_ms: int):
        self.least, self.ratio, self.quiet_ms = least, ratio, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, step_idx long, pos long, failed boolean, occupancy long")
        self.seen = handle.getValueState("seen", "chain long, first long, occupancy long, at long")

    def _wake(self, at: int) -> None:
        """One timer at a time: the earliest moment at which something is due."""
        timers = list(self.handle.listTimers())
        if any(t <= at for t in timers):
            return
        for t in timers:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            found = [(int(at), int(s), int(p), None if pd.isna(f) else bool(f), None if pd.isna(o) else int(o)) for at, s, p, f, o in zip(frame["at"], frame["step_idx"], frame["pos"], frame["failed"], frame["occupancy"])]
            self.waiting.appendList(found)
            low = min(r[0] for r in found)
            first = low if first is None else min(first, low)
        if first is not None:
            for t in list(self.handle.listTimers()):
                if t > first:
                    self.handle.deleteTimer(t)
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        chain, first, occupancy, last = self.seen.get() if self.seen.exists() else (0, None, None, None)
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((r for r in rows if r[0] <= now), key=lambda r: r[:3])
        later = [r for r in rows if r[0] > now]
        alerts = []
        for at, step, pos, failed, held in due:
            last = at if last is None else max(last, at)
            if failed is not None:
                if failed:
                    chain += 1
                    first = step if chain == 1 else first
                    if chain == self.least:
                        alerts.append((key[0], "failure_chain", step, pos, chain, first))
                else:
                    chain, first = 0, None
            if held is not None:
                if occupancy is not None and held < occupancy * self.ratio:
                    alerts.append((key[0], "occupancy_drop", step, pos, held, occupancy))
                occupancy = held
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(min(r[0] for r in later))
        elif self.waiting.exists():
            self.waiting.clear()
        if not later and last is not None and now >= last + self.quiet_ms:
            self.seen.clear()
        else:
            if last is not None:
                self.seen.update((chain, first, occupancy, last))
            if not later and last is not None:
                self.handle.registerTimer(last + self.quiet_ms)
        if alerts:
            yield pd.DataFrame(alerts, columns=["traj_id", "kind", "step_idx", "pos", "value", "before"])

    def close(self) -> None:
        pass


def live_alerts(rows: DataFrame, late: str = "10 minutes", quiet_ms: int = 24 * 3_600_000, least: int = LEAST, ratio: float = vocab.DROP_RATIO) -> DataFrame:
    """The same alerts of a stream of rows (:data:`WATCHED`), at most ``late`` after each other.

    A run of which nothing is heard for ``quiet_ms`` of event time is forgotten. State is one list of waiting rows and
    four numbers a run. Rows later than the watermark are dropped by Spark.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = rows.withColumn("ts", F.timestamp_millis("at")).withWatermark("ts", late)
    return timed.groupBy("traj_id").transformWithStateInPandas(Watcher(least, ratio, quiet_ms), ALERTS, "Append", "EventTime")
