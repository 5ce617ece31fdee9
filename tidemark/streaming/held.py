"""The dwell state machine over months that arrive in any order: lists, maps and timers of a stream's state.

A month waits in the state of its panel until event time has passed its finalisation; then a timer takes the waiting months
in order. So a stream gives what a batch gives, whatever the order of arrival within the watermark's delay. What has been
frozen before the stream began comes in as initial state.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidemark.streaming.dwell import OUTPUT, STATE, advance

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession):
    """The store that named states need, for streams that are started inside."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


class HeldDwell(StatefulProcessor):
    """State of a panel: the machine, the months that wait (a list), and what was heard of them (a map)."""

    def __init__(self, dwell: int) -> None:
        self.dwell = dwell

    def init(self, handle) -> None:
        self.handle = handle
        self.machine = handle.getValueState("machine", STATE)
        self.waiting = handle.getListState("waiting", "at long, month_idx int, raw_band string")
        self.heard = handle.getMapState("heard", "month_idx int", "raw_band string")

    def _now(self) -> tuple:
        return tuple(self.machine.get()) if self.machine.exists() else (-1, None, None, 0)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for last, confirmed, candidate, count in initialState[["last", "confirmed", "candidate", "count"]].itertuples(index=False):
            text = lambda x: x if isinstance(x, str) else None
            self.machine.update((int(last), text(confirmed), text(candidate), int(count)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, at = self._now()[0], set()
        for batch in rows:
            for month, raw, day in zip(batch["month_idx"], batch["raw_band"], batch["finalized_at"]):
                # What is frozen stays, and of a month that comes twice the first is taken.
                if pd.isna(month) or int(month) <= last or self.heard.containsKey((int(month),)):
                    continue
                month, raw, ms = int(month), raw if isinstance(raw, str) else None, day.value // 1_000_000
                self.heard.updateValue((month,), (raw,))
                self.waiting.appendValue((ms, month, raw))
                at.add(ms)
        for ms in at:
            self.handle.registerTimer(ms)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until, now, out = expiredTimerInfo.getExpiryTimeInMs(), self._now(), []
        rows = [tuple(r) for r in self.waiting.get()]
        for _, month, raw in sorted((r for r in rows if r[0] <= until), key=lambda r: r[1]):
            self.heard.removeKey((month,))
            if month > now[0]:
                now, seen = advance(now, month, raw, self.dwell)
                out.append((key[0], month, raw, *seen))
        left = [r for r in rows if r[0] > until]
        self.waiting.put(left) if left else self.waiting.clear()
        if out:
            self.machine.update(now)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def frozen_state(frozen: DataFrame) -> DataFrame:
    """(panel, last, confirmed, candidate, count) after the last frozen month of each panel."""
    newest = F.row_number().over(Window.partitionBy("panel").orderBy(F.desc("month_idx")))
    last = frozen.withColumn("newest", newest).where("newest = 1")
    return last.select(
        "panel", F.col("month_idx").alias("last"), F.col("confirmed_band").alias("confirmed"), F.col("candidate_band").alias("candidate"),
        F.coalesce("candidate_count", F.lit(0)).alias("count"),
    )


def held_dwell(months: DataFrame, dwell: int = 2, delay: str = "0 seconds", frozen: DataFrame | None = None) -> DataFrame:
    """Published bands of a stream of (panel, month_idx, raw_band, finalized_at), each once event time has passed it.

    Rows without a month only move event time on. A month that comes later than the watermark, or that isn't later than the
    last one published, is refused. ``frozen`` is a batch table of published months to go on from.
    """
    timed = months.select("panel", "month_idx", "raw_band", "finalized_at").withWatermark("finalized_at", delay)
    first = frozen_state(frozen).groupBy("panel") if frozen is not None else None
    return timed.groupBy("panel").transformWithStateInPandas(HeldDwell(dwell), OUTPUT, "Append", "EventTime", first)
