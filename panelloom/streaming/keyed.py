"""Flows with state per key: life cycles of limit breaches, and weekly bars of closed event-time windows."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.versioning import keep_latest

STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A limit with an open breach that gets no evaluation for so many days is reported once.
SILENT_DAYS = 45
#: How long after its last day a week waits for rows.
LATENESS_DAYS = 7
DAY_MS = 24 * 60 * 60 * 1000
EVENTS = "limit_id string, seq long, as_of date, event string, observed_value double, slack double"


def _event(breached: bool, before: bool) -> str | None:
    return ("update" if before else "open") if breached else "resolved" if before else None


class BreachLifecycle(StatefulProcessor):
    """Events of one limit from its evaluations, in whatever order they arrive.

    State: the newest evaluated date and whether it was breached, the evaluations by date, and a counter of events. A row newer
    than all others needs the newest date only; a late or corrected one looks its neighbours up in the limit's dates and
    re-issues what changes, under a higher ``seq``; an event that no longer holds is re-issued as null.
    """

    def __init__(self, silent_days: int = SILENT_DAYS):
        self.silent = silent_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "day int, breached boolean, seq long, timer long")
        self.dates = handle.getMapState("dates", "day int", "value double, slack double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        found = self.newest.get() if self.newest.exists() else None
        day, breached, seq, timer = found if found else (None, False, 0, None)
        out: dict[int, tuple] = {}
        arrived = 0
        for batch in rows:
            arrived = max(arrived, int(batch["arrived"].max().timestamp() * 1000))
            batch = batch.sort_values(["arrived", "as_of"], kind="stable")
            for as_of, value, slack in zip(pd.to_datetime(batch["as_of"]), batch["value"], batch["slack"]):
                d, bad = (as_of - pd.Timestamp(0)).days, bool(slack < 0)
                if day is None or d > day:
                    seq += 1
                    out[d] = (seq, _event(bad, breached), value, slack)
                    day, breached = d, bad
                else:
                    # rows of this call are in the state too, so one look at the limit's dates serves both neighbours
                    held = {k[0]: v for k, v in self.dates.iterator()}
                    held[d] = (value, slack)
                    order = sorted(held)
                    for at in order[order.index(d) : order.index(d) + 2]:
                        i = order.index(at)
                        before = i > 0 and held[order[i - 1]][1] < 0
                        seq += 1
                        out[at] = (seq, _event(held[at][1] < 0, before), *held[at])
                    breached = held[day][1] < 0
                self.dates.updateValue((d,), (None if pd.isna(value) else float(value), None if pd.isna(slack) else float(slack)))
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = arrived + self.silent * DAY_MS if breached else None
        if timer is not None:
            self.handle.registerTimer(timer)
        self.newest.update((day, breached, seq, timer))
        yield self._rows(key[0], [(d, *e) for d, e in out.items()])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        day, breached, seq, timer = self.newest.get()
        self.newest.update((day, breached, seq + 1, None))
        value, slack = self.dates.getValue((day,))
        # under a date of its own key: it stands beside the evaluation's event
        yield self._rows(key[0], [(day, seq + 1, "silent", value, slack)])

    def close(self) -> None:
        pass

    @staticmethod
    def _rows(limit: str, events: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({
            "limit_id": [limit] * len(events), "seq": [e[1] for e in events], "as_of": [(pd.Timestamp(0) + pd.Timedelta(days=e[0])).date() for e in events],
            "event": [e[2] for e in events], "observed_value": [e[3] for e in events], "slack": [e[4] for e in events],
        })


def breach_lifecycle(stream: DataFrame, sink: str, state: str, silent_days: int = SILENT_DAYS):
    """Events of ``stream(limit_id, as_of, value, slack, arrived)`` appended to ``sink``; :func:`lifecycle_table` reads their newest state.

    Event time is the arrival, so an evaluation of any old date counts, and a limit in breach that falls silent is reported
    when the watermark has passed its last arrival by ``silent_days``. Old evaluations are never read again from
    files: what a limit needs is in its state, one entry per evaluated date. State and file sink commit together, so a
    repeated batch writes nothing twice.
    """
    conf = stream.sparkSession.conf
    before = conf.get(STATE_PROVIDER, None)
    conf.set(STATE_PROVIDER, ROCKS)
    try:
        events = stream.withWatermark("arrived", "0 seconds").groupBy("limit_id").transformWithStateInPandas(
            BreachLifecycle(silent_days), outputStructType=EVENTS, outputMode="Append", timeMode="EventTime")
        return events.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    finally:
        conf.set(STATE_PROVIDER, before) if before else conf.unset(STATE_PROVIDER)


def lifecycle_table(spark: SparkSession, sink: str) -> DataFrame:
    """Newest event per limit, date and kind (an evaluation's own event, or its silence); retracted ones are left out.

    A silence counts only if it is the limit's last word.
    """
    events = spark.read.parquet(sink).withColumn("quiet", F.coalesce(F.col("event") == "silent", F.lit(False)))
    newest = events.groupBy("limit_id").agg(F.max("seq").alias("last"))
    kept = keep_latest(events, ["limit_id", "as_of", "quiet"], "seq").where("event is not null").join(newest, "limit_id")
    return kept.where("not quiet or seq = last").select("limit_id", "event", "as_of", "observed_value", "slack")


def week_window(ts: str = "ts"):
    """The seven days that end with a Friday."""
    return F.window(ts, "7 days", "7 days", "2 days")  # the first Saturday after the epoch's Thursday


def _is_late(ts: str, days: int):
    """Whether a row arrives after its week was closed; a property of the row, so both paths agree without talking to each other."""
    return week_window(ts)["end"] <= F.col("arrived") - F.expr(f"interval {days} days")


def closed_weeks(stream: DataFrame, sink: str, state: str, *, key: str = "ticker", ts: str = "ts", value: str = "ret", lateness_days: int = LATENESS_DAYS):
    """Weekly compounding of ``stream(key, ts, value, arrived)`` in event-time windows: two streams, which :func:`closed_week_table` joins.

    Rows in time go through a windowed aggregate; when the watermark, the newest ``ts`` less ``lateness_days``, passes a week's end, its
    growth is appended once and its state dropped. Rows that arrive later than that bypass the windows and are kept as
    corrections, so nothing is dropped. Rows must arrive in the order of ``arrived`` and not before their ``ts``; each (key, ts) counts once.
    """
    late = _is_late(ts, lateness_days)
    growth = 1 + F.col(value)
    in_time = stream.where(~late).withWatermark(ts, f"{lateness_days} days").groupBy(key, week_window(ts).alias("w"))
    bars = in_time.agg(F.product(growth).alias("growth"), F.count(value).alias("n")).select(key, F.date_sub(F.col("w.end").cast("date"), 1).alias("week"), "growth", "n")
    fixes = stream.where(late).select(key, F.date_sub(week_window(ts)["end"].cast("date"), 1).alias("week"), growth.alias("growth"), F.lit(1).cast("long").alias("n"))

    def run(frame: DataFrame, name: str):
        return frame.writeStream.format("parquet").option("path", f"{sink}/{name}").option("checkpointLocation", f"{state}/{name}").outputMode("append").trigger(availableNow=True).start()

    return run(bars, "closed"), run(fixes, "late")


def closed_week_table(spark: SparkSession, sink: str, key: str = "ticker", value: str = "ret") -> DataFrame:
    """(key, week, value, n): closed weeks, corrected by all late rows."""
    kind = spark.read.parquet(f"{sink}/closed").schema
    both = spark.read.parquet(f"{sink}/closed").unionByName(spark.read.schema(kind).parquet(f"{sink}/late"))
    return both.groupBy(key, "week").agg((F.product("growth") - 1).alias(value), F.sum("n").alias("n"))
