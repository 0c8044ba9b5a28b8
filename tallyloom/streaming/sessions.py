"""Sessions: a user's events with no gap over a limit. In batches by a window, in streams by state with event-time timers."""

from __future__ import annotations

from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.buckets import from_micros, instant, micros

BEGIN, END = "Session Begin", "Session End"


def sessions(events: DataFrame, gap: timedelta, group: str = "group_0") -> DataFrame:
    """(group, session_begin, session_end, n_events, length_ms); a gap of exactly the limit stays within the session."""
    w = F.session_window(F.timestamp_micros(micros(F.col("created_at"))), f"{int(gap.total_seconds())} seconds")
    s = events.where(F.col(group).isNotNull()).groupBy(group, w.alias("w")).agg(
        F.min("created_at").alias("session_begin"), F.max("created_at").alias("session_end"), F.count(F.lit(1)).alias("n_events")
    )
    took = s.withColumn("took", micros(F.col("session_end")) - micros(F.col("session_begin")))
    return took.select(group, "session_begin", "session_end", "n_events", F.expr("took DIV 1000").alias("length_ms"))


def with_session_events(events: DataFrame, gap: timedelta, now: datetime, group: str = "group_0") -> DataFrame:
    """(group, created_at, event, length_ms): a begin for each session, and an end for those idle for more than gap at now."""
    s = sessions(events, gap, group)
    begun = s.select(group, F.col("session_begin").alias("created_at"), F.lit(BEGIN).alias("event"), F.lit(None).cast("long").alias("length_ms"))
    idle = s.where(F.col("session_end") + F.make_dt_interval(secs=F.lit(gap.total_seconds())) < instant(now))
    return begun.unionByName(idle.select(group, F.col("session_end").alias("created_at"), F.lit(END).alias("event"), "length_ms"))


def session_ids(events: DataFrame, gap: timedelta, group: str = "group_0") -> DataFrame:
    """Adds session, counted from 0 for each group."""
    order = Window.partitionBy(group).orderBy("created_at", "event_id")
    at = micros(F.col("created_at"))
    new = F.coalesce((at - F.lag(at).over(order) > int(gap.total_seconds() * 1_000_000)).cast("int"), F.lit(0))
    return events.withColumn("_new", new).withColumn("session", F.sum("_new").over(order)).drop("_new")


def stream_sessions(events: DataFrame, gap: timedelta, late: timedelta = timedelta(0), group: str = "group_0") -> DataFrame:
    """The begins and ends as a stream: a session ends when the watermark has passed its last event by gap."""
    ms = int(gap.total_seconds() * 1000)
    out = T.StructType([T.StructField(group, T.LongType()), T.StructField("at_ms", T.LongType()), T.StructField("event", T.StringType()), T.StructField("length_ms", T.LongType())])

    def run(key, batches, state):
        rows = []
        if state.hasTimedOut:
            first, last = state.get
            rows.append((key[0], last, END, last - first))
            state.remove()
        else:
            first, last = state.get if state.exists else (None, None)
            for t in sorted(t for pdf in batches for t in pdf["at_ms"]):
                if last is not None and t - last > ms:
                    rows.append((key[0], last, END, last - first))
                    first = None
                if first is None:
                    first, last = t, t
                    rows.append((key[0], t, BEGIN, None))
                last = max(last, t)
            state.update((first, last))
            state.setTimeoutTimestamp(max(last + ms + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=[group, "at_ms", "event", "length_ms"]).astype({"length_ms": "Int64"})

    at = events.select(group, F.timestamp_micros(micros(F.col("created_at"))).alias("at"))
    timed = at.withWatermark("at", f"{int(late.total_seconds())} seconds").withColumn("at_ms", F.unix_millis("at"))
    grouped = timed.groupBy(group).applyInPandasWithState(run, out, "first long, last long", "append", "EventTimeTimeout")
    return grouped.select(group, from_micros(F.col("at_ms") * 1000).alias("created_at"), "event", "length_ms")
