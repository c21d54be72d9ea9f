"""Streams that keep state: sessions grouped into treatments, and two streams joined by the minute.

Both give, once the watermark has passed, what the batch operators give of the same rows: rows that are late by less than
the watermark's delay are included, later ones are dropped, as the batch steps never revisit a unit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: transformWithState keeps its state in this store alone.
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_OPEN = "session_id string, start_us long, end_us long"


class _Grouping(StatefulProcessor):
    """Per patient: the sessions that the watermark has not reached, and the end and treatment of the last one that it has."""

    def __init__(self, gap_seconds: int):
        self.gap_us = gap_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", _OPEN)
        self.last = handle.getValueState("last", "end_us long, treatment_id string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for batch in rows:
            for session, start, end in zip(batch["session_id"], batch["start_us"], batch["end_us"], strict=True):
                self.open.appendValue((session, int(start), int(end)))
                self.handle.registerTimer(-(-int(start) // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        reached = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(((start, session, end) for session, start, end in self.open.get()), key=lambda x: x[:2])
        settled = [x for x in waiting if x[0] <= reached]
        if not settled:  # by an earlier timer
            return
        end_before, treatment = self.last.get() if self.last.exists() else (None, None)
        out = []
        for start, session, end in settled:
            if end_before is None or start - end_before >= self.gap_us:
                treatment = session
            end_before = end
            out.append((key[0], session, start, end, treatment))
        self.last.update((end_before, treatment))
        rest = [(session, start, end) for start, session, end in waiting[len(settled) :]]
        if rest:
            self.open.put(rest)
        else:
            self.open.clear()
        yield pd.DataFrame(out, columns=["patient_id", "session_id", "start_us", "end_us", "treatment_id"])

    def close(self) -> None:
        pass


def grouped_sessions(spans: DataFrame, late: str = "1 day", gap_seconds: int = 3600) -> DataFrame:
    """A stream of sessions (patient_id, session_id, session_start, session_end) with the treatment of each, as
    treatments.grouped_sessions; a session comes out once the watermark of its start has passed it. What is held is the
    sessions of the watermark's delay, one row each. Needs the session's state stores to be of RocksDB (ROCKS)."""
    rows = spans.withWatermark("session_start", late).withColumns({"start_us": F.unix_micros("session_start"), "end_us": F.unix_micros("session_end")})
    schema = "patient_id string, session_id string, start_us long, end_us long, treatment_id string"
    out = rows.select("patient_id", "session_id", "session_start", "start_us", "end_us").groupBy("patient_id").transformWithStateInPandas(_Grouping(gap_seconds), schema, "Append", "EventTime")
    start, end = F.timestamp_micros("start_us").alias("session_start"), F.timestamp_micros("end_us").alias("session_end")
    return out.select("patient_id", "session_id", start, end, F.to_date(F.timestamp_micros("start_us")).alias("date"), "treatment_id")


def combined_minutes(steps: DataFrame, heart: DataFrame, late: str = "1 day") -> DataFrame:
    """Two streams of samples (userid, time, value) as rows (userid, time, value_steps, value_hr) per minute, as
    daily.combine_minutes gives where neither side is empty. A minute comes out once the watermarks of both have passed it; then
    its state goes."""

    def distinct(samples: DataFrame) -> DataFrame:
        known = samples.withWatermark("time", late).groupBy("userid", F.window("time", "1 minute").alias("minute"), F.unix_micros("time").alias("at"), F.when(~F.isnan("value"), F.col("value").cast("double")).alias("value"))
        return known.agg(F.count(F.lit(1)).alias("n"))

    s = distinct(steps).select("userid", "minute", F.col("value").alias("value_steps"))
    h = distinct(heart).groupBy("userid", "minute").agg(F.avg("value").alias("value_hr"))
    joined = s.join(h, ["userid", "minute"], "full_outer")
    return joined.select("userid", F.col("minute.start").alias("time"), "value_steps", "value_hr")
