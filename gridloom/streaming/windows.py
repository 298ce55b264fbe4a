"""Streaming forms of grid operators, on Structured Streaming."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gridloom.cube import finite
from gridloom.errors import require
from gridloom.operators.temporal import REDUCERS

PERIODS = ("day", "week", "month", "season", "year")
# The process that starts a state's Python on the driver may not find this package: its code goes along.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def period_start(time: Column, by: str) -> Column:
    """Start of the calendar period of a time: weeks begin on Monday, seasons in December, March, June and September."""
    if by == "season":
        return F.add_months(F.trunc(time, "month"), -(F.month(time) % 3)).cast("timestamp")
    return F.date_trunc(by, time)


def period_end(start: Column, by: str) -> Column:
    """Start of the next period."""
    if by in ("day", "week"):
        return (F.date_add(start.cast("date"), 1 if by == "day" else 7)).cast("timestamp")
    return F.add_months(start.cast("date"), {"month": 1, "season": 3, "year": 12}[by]).cast("timestamp")


class _Period(StatefulProcessor):
    """Count, sum, least and greatest value of one key's period. A timer at the end of the period, in event time,
    emits and forgets it: from then on the watermark keeps its rows out."""

    def __init__(self, method: str, keys: list[str]):
        self.method, self.keys = method, keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "n long, total double, least double, greatest double, ends long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.held.exists()
        n, total, least, greatest, ends = self.held.get() if known else (0, 0.0, math.inf, -math.inf, 0)
        for frame in rows:
            ends = int(frame["period_ends"].iloc[0])
            values = frame["period_value"].dropna()
            if len(values):
                n, total = n + len(values), total + float(values.sum())
                least, greatest = min(least, float(values.min())), max(greatest, float(values.max()))
        self.held.update((n, total, least, greatest, ends))
        if not known:
            self.handle.registerTimer(ends)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, total, least, greatest, _ = self.held.get()
        value = {"mean": total / n, "sum": total, "min": least, "max": greatest}[self.method] if n else None
        self.held.clear()
        yield pd.DataFrame([[*key, value, n]], columns=[*self.keys, "time", "value", "n_valid"])

    def close(self) -> None:
        pass


def stream_aggregate(events: DataFrame, by: str, keys: list[str], method: str = "mean", late: str = "1 day", time: str = "time", value: str = "value") -> DataFrame:
    """The streaming relative of ``aggregate_time``: a period is emitted once the watermark says that it can no
    longer change. Columns: the keys, time (start of the period), value, n_valid.

    Days are tumbling windows. Weeks from Monday, months, seasons and years follow the calendar, which windows
    of fixed length cannot: each key's period is a state of four numbers with a timer at its end. Values that
    are not finite do not count; rows later than ``late`` are left out."""
    require(by in PERIODS and method in ("mean", "sum", "min", "max"), "bad_argument", "streams are reduced by day, week, month, season or year with mean, sum, min or max")
    marked = events.withColumn("period_value", finite(F.col(value))).withWatermark(time, late)
    if by == "day":
        return (marked.groupBy(*keys, F.window(time, "1 day").alias("w"))
                .agg(REDUCERS[method]("period_value").alias("value"), F.count("period_value").alias("n_valid")).select(*keys, F.col("w.start").alias("time"), "value", "n_valid"))
    spark = events.sparkSession
    require(spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") == ROCKS, "stream_state", f"calendar periods need spark.sql.streaming.stateStore.providerClass = {ROCKS}")
    start = period_start(F.col(time), by)
    rows = marked.withColumn("period_start", start).withColumn("period_ends", F.unix_millis(period_end(F.col("period_start"), by)))
    kept = {f.name: f.dataType for f in events.schema}
    out = T.StructType([*[T.StructField(k, kept[k]) for k in keys], T.StructField("time", T.TimestampType()), T.StructField("value", T.DoubleType()), T.StructField("n_valid", T.LongType())])
    return rows.select(*keys, "period_start", "period_ends", "period_value", time).groupBy(*keys, "period_start").transformWithStateInPandas(
        _Period(method, keys), outputStructType=out, outputMode="Append", timeMode="EventTime")
