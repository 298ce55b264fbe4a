"""Time operators: period aggregation, recurring climatologies, anomalies, linear trends, annual indices.

The time axis is small and lives on the driver; what a time belongs to (period, replicate, recurring
group) is worked out there and joined to the data as a broadcast table of positions. Each operator is
then one or two hash aggregations with map-side combination on the cell keys.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import date, datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.cube import CELL, Cube, finite
from gridloom.errors import require
from gridloom.functions.calendars import CalendarTime
from gridloom.operators.provenance import recorded

PERIODS = ("day", "week", "month", "season", "year")
REDUCERS: dict[str, Callable[[str], Column]] = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "median": F.median}
SEASONS = ("DJF", "MAM", "JJA", "SON")
TREND_SECONDS = {"year": 31_556_952.0, "day": 86400.0, "hour": 3600.0, "second": 1.0}


def _ordinary(cube: Cube, operation: str) -> None:
    require(not isinstance(cube.time[0], CalendarTime), "cf_time_unsupported_operation", f"{operation} needs dates or UTC datetimes")
    require(cube.meta.get("chronology") != "climatological", "climatological_operation_error", f"{operation} needs an ordinary time axis")


def _day(t) -> date:
    return t.date() if isinstance(t, datetime) else t


def _after_values(cube: Cube) -> dict:
    """Metadata after values changed: depth descriptors of earlier results are dropped, and what values
    stand for in the vertical is open again."""
    meta = {k: v for k, v in cube.meta.items() if k not in ("reduction", "sampling", "gradient", "stratification", "climatology", "anomaly", "trend")}
    if "vertical" in meta:
        meta["vertical"] = meta["vertical"] | {"pending": True}
    return meta


# ---- periods -------------------------------------------------------------------------------------


def period_start(d: date, by: str) -> date:
    if by == "week":
        return d - timedelta(days=d.weekday())
    if by == "month":
        return d.replace(day=1)
    if by == "season":
        month = d.month % 12 // 3 * 3 or 12
        return date(d.year - (month == 12 and d.month < 12), month, 1)
    return d.replace(month=1, day=1) if by == "year" else d


def next_period(d: date, by: str) -> date:
    if by in ("day", "week"):
        return d + timedelta(days=7 if by == "week" else 1)
    months = {"month": 1, "season": 3, "year": 12}[by]
    at = d.month - 1 + months
    return date(d.year + at // 12, at % 12 + 1, 1)


def periods(times: tuple, by: str) -> tuple[list[date], list[int]]:
    """All periods from the first to the last, empty ones too, and the period of each time."""
    starts = [period_start(_day(t), by) for t in times]
    out = [starts[0]]
    while out[-1] < starts[-1]:
        out.append(next_period(out[-1], by))
    place = {p: i for i, p in enumerate(out)}
    return out, [place[s] for s in starts]


def aggregate_time(cube: Cube, by: str, method: str = "mean", na_rm: bool = True, min_n: int = 1) -> tuple[Cube, DataFrame]:
    """Reduce each cell's series to calendar periods: the cube, and diagnostics for cells with data.

    The new axis is every period from first to last. The reducer sees finite values; the result is
    missing with fewer than ``min_n`` of them or, without ``na_rm``, if any of the period's times has
    none. Diagnostics: n_valid, n_total (times in the period) and coverage_fraction.
    """
    _ordinary(cube, "aggregate_time")
    require(by in PERIODS, "bad_argument", f"by is one of {', '.join(PERIODS)}")
    require(method in REDUCERS, "bad_argument", f"method is one of {', '.join(REDUCERS)}")
    require(isinstance(min_n, int) and min_n >= 1, "bad_argument", "min_n is a positive whole number")
    starts, of_time = periods(cube.time, by)
    times_of = Counter(of_time)
    totals = [times_of[i] for i in range(len(starts))]
    table = F.broadcast(cube.spark.createDataFrame([(i, p, totals[p]) for i, p in enumerate(of_time)], "time_idx int, period int, n_total long"))
    rows = cube.df.where("value is not null").join(table, "time_idx")
    if max(totals) == 1 and method in ("mean", "median", "sum", "min", "max"):  # a period has one time at most: its value is the result
        got = rows.select(*CELL, "variable", "period", F.col("value").cast("double").alias("v"), F.lit(1).cast("long").alias("n_valid"), "n_total")
    else:
        got = rows.groupBy(*CELL, "variable", "period").agg(REDUCERS[method]("value").alias("v"), F.count("value").alias("n_valid"), F.first("n_total").alias("n_total"))
    enough = (F.col("n_valid") >= min_n) & (F.lit(na_rm) | (F.col("n_valid") == F.col("n_total")))
    got = got.select(*CELL, F.col("period").alias("time_idx"), "variable", F.when(enough, finite(F.col("v"))).alias("value"), "n_valid", "n_total",
                     (F.col("n_valid") / F.col("n_total")).alias("coverage_fraction"))
    out = cube.with_(df=got.select(*CELL, "time_idx", "variable", "value"), time=tuple(starts), meta=_after_values(cube) | {"aggregation": {"by": by, "method": method, "n_total": totals}})
    return recorded(out, "aggregate_time", {"by": by, "method": method, "na_rm": na_rm, "min_n": min_n}), got.drop("value")


# ---- climatology ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Climatology:
    """Mean and spread of each recurring group of each cell. ``df``: cell keys, variable, group_key, mean,
    sd, n_valid, coverage; groups without data have no row. ``groups`` is the whole cycle, ``totals`` the
    replicates the calendar offers each group in the reference period."""

    df: DataFrame
    cube: Cube
    by: str
    leap: str
    groups: tuple[int, ...]
    totals: tuple[int, ...]
    period: tuple[date, date]
    meta: dict = field(default_factory=dict)

    def stored(self, path: str) -> "Climatology":
        """The same climatology, written as Parquet and read from there."""
        self.df.write.mode("overwrite").parquet(path)
        return replace(self, df=self.df.sparkSession.read.schema(self.df.schema).parquet(path))

    def cycle(self) -> tuple[date, ...]:
        """Anchor dates of the groups."""
        if self.by == "month":
            return tuple(date(2001, m, 1) for m in self.groups)
        if self.by == "season":
            return (date(2000, 12, 1), date(2001, 3, 1), date(2001, 6, 1), date(2001, 9, 1))
        first = date(2000 if self.leap == "keep" else 2001, 1, 1)
        return tuple(first + timedelta(days=i) for i in range(len(self.groups)))

    def means(self) -> Cube:
        """The means as a cube on the cycle."""
        at = F.col("group_key") - 1
        return self.cube.with_(df=self.df.select(*CELL, at.cast("int").alias("time_idx"), "variable", F.col("mean").alias("value")), time=self.cycle(),
                               meta=self.meta | {"chronology": "climatological", "climatology": {"by": self.by, "leap": self.leap}})


def group_of(d: date, by: str, leap: str) -> int | None:
    """Number of the recurring group (from 1) of a date; None if the leap rule leaves the date out."""
    if by == "month":
        return d.month
    if by == "season":
        return d.month % 12 // 3 + 1
    leap_day = d.month == 2 and d.day == 29
    if leap == "keep":
        return (date(2000, d.month, d.day) - date(2000, 1, 1)).days + 1
    if leap_day:
        return None if leap == "drop" else 59
    return (date(2001, d.month, d.day) - date(2001, 1, 1)).days + 1


def _replicate(d: date, by: str) -> int:
    return d.year + (by == "season" and d.month == 12)


def climatology(cube: Cube, by: str = "month", period: tuple[date, date] | None = None, leap: str = "feb28", min_n: int = 1) -> Climatology:
    """Recurring mean and sample standard deviation, every year counting once.

    Observations are averaged within each year's component (day, month or season); under ``feb28`` the
    means of February 28 and 29 of a leap year are averaged; mean and spread then go over years. The mean
    needs ``min_n`` years, the spread two at least. Coverage is years with data against those that the
    calendar offers in the reference period.
    """
    _ordinary(cube, "climatology")
    require(by in ("day", "month", "season"), "bad_argument", "by is day, month or season")
    require(leap in ("feb28", "drop", "keep"), "bad_argument", "leap is feb28, drop or keep")
    require(isinstance(min_n, int) and min_n >= 1, "bad_argument", "min_n is a positive whole number")
    days = [_day(t) for t in cube.time]
    low, high = period or (days[0], days[-1])
    require(low <= high, "bad_argument", "the reference period is reversed")
    low, high = max(low, days[0]), min(high, days[-1])
    require(low <= high, "climatology_no_overlap", "the reference period does not meet the time axis")
    size = {"month": 12, "season": 4, "day": 366 if leap == "keep" else 365}[by]
    rows = [(i, g, _replicate(d, by), d.toordinal() if by == "day" else 0) for i, d in enumerate(days) if low <= d <= high and (g := group_of(d, by, leap)) is not None]
    offered: dict[int, set[int]] = {g: set() for g in range(1, size + 1)}
    d = low
    while d <= high:
        if (g := group_of(d, by, leap)) is not None:
            offered[g].add(_replicate(d, by))
        d += timedelta(days=1)
    totals = tuple(len(offered[g]) for g in range(1, size + 1))
    spark = cube.spark
    table = F.broadcast(spark.createDataFrame(rows, "time_idx int, group_key int, replicate int, component int"))
    values = cube.df.where("value is not null").join(table, "time_idx")
    keys = [*CELL, "variable", "group_key"]
    merged = by == "day" and leap == "feb28"
    # The axis tells where a mean would have one value: that aggregation is left out.
    alone = lambda at: max(Counter(at).values()) == 1
    stage, each_year = values, alone((g, y) for _, g, y, _ in rows)
    if not each_year and not (merged and alone((g, y, c) for _, g, y, c in rows)):
        stage = stage.groupBy(*keys, "replicate", *["component"] * merged).agg(F.avg("value").alias("value"))
    if merged and not each_year:
        stage = stage.groupBy(*keys, "replicate").agg(F.avg("value").alias("value"))
    got = stage.groupBy(*keys).agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.count("value").alias("n_valid"))
    offered_table = F.broadcast(spark.createDataFrame([(g, n) for g, n in zip(range(1, size + 1), totals)], "group_key int, n_total int"))
    got = got.join(offered_table, "group_key").select(
        *keys, F.when(F.col("n_valid") >= min_n, F.col("m")).alias("mean"), F.when(F.col("n_valid") >= max(2, min_n), F.col("s")).alias("sd"), "n_valid",
        F.when(F.col("n_total") > 0, F.col("n_valid") / F.col("n_total")).alias("coverage"))
    told = recorded(cube.with_(meta=_after_values(cube)), "climatology", {"by": by, "leap": leap, "min_n": min_n, "period": [low, high]}, kind="recurring_climatology")
    return Climatology(got, cube, by, leap, tuple(range(1, size + 1)), totals, (low, high), told.meta)


#: Rows of a climatology (about 50 bytes each) up to which it is broadcast.
_BROADCAST_GROUPS = 400_000


def anomaly(cube: Cube, clim: Climatology, kind: str = "difference") -> Cube:
    """Values less their recurring mean, or (``z``) that over the spread where it is above 0.

    Cube and climatology must have the same places, depths, variables and units. Times that the leap
    rule leaves out have no anomaly. A negative spread is an error.
    """
    _ordinary(cube, "anomaly")
    require(kind in ("difference", "z"), "bad_argument", "kind is difference or z")
    other = clim.cube
    for axis in ("longitude", "latitude", "depth", "variables"):
        require(getattr(cube, axis) == getattr(other, axis), "anomaly_error", f"cube and climatology differ in {axis}")
    require(type(cube.time[0]) is type(other.time[0]), "anomaly_error", "cube and climatology have different kinds of time")
    for v in cube.variables:
        require(cube.unit(v) == other.unit(v), "anomaly_error", f"cube and climatology differ in the unit of {v}")
    table = [(i, g) for i, t in enumerate(cube.time) if (g := group_of(_day(t), clim.by, clim.leap)) is not None]
    groups = F.broadcast(cube.spark.createDataFrame(table, "time_idx int, group_key int"))
    told = clim.df.select(*CELL, "variable", "group_key", "mean", "sd")
    # The axes bound the climatology; a small one is broadcast, so the cube is not shuffled again.
    if math.prod(other.shape[:3]) * len(clim.groups) * len(other.variables) <= _BROADCAST_GROUPS:
        told = F.broadcast(told)
    joined = cube.df.join(groups, "time_idx").join(told, [*CELL, "variable", "group_key"])
    spread = F.when(F.col("sd") < 0, F.raise_error("anomaly_negative_sd: a spread is negative").cast("double")).otherwise(F.col("sd"))
    value = F.col("value") - F.col("mean")
    value = value if kind == "difference" else F.when(spread > 0, value / spread)
    units = cube.meta.get("units", {}) if kind == "difference" else {v: "1" for v in cube.variables}
    out = cube.with_(df=joined.select(*CELL, "time_idx", "variable", finite(value).alias("value")), meta=_after_values(cube) | {"units": units, "anomaly": {"kind": kind}})
    return recorded(out, "anomaly", {"kind": kind}, other=clim.meta)


def anomaly_counts(cube: Cube, clim: Climatology, result: Cube) -> DataFrame:
    """One row of counters: source_values, finite_source, zero_sd, missing_mean, output_finite."""
    table = [(i, g) for i, t in enumerate(cube.time) if (g := group_of(_day(t), clim.by, clim.leap)) is not None]
    groups = F.broadcast(cube.spark.createDataFrame(table, "time_idx int, group_key int"))
    joined = cube.df.join(groups, "time_idx", "left").join(clim.df, [*CELL, "variable", "group_key"], "left")
    told = joined.agg(F.count("value").alias("finite_source"), F.count_if(F.col("value").isNotNull() & (F.col("sd") == 0)).alias("zero_sd"),
                      F.count_if(F.col("value").isNotNull() & F.col("mean").isNull()).alias("missing_mean"))
    final = result.df.agg(F.count("value").alias("output_finite"))
    return told.select(F.lit(math.prod(cube.shape)).alias("source_values"), "*").join(final)


def signal_noise(cube: Cube, clim: Climatology, signed: bool = False) -> Cube:
    """The size of the z anomaly, or with ``signed`` the z anomaly itself."""
    z = anomaly(cube, clim, "z")
    return z if signed else z.with_(df=z.df.withColumn("value", F.abs("value")))


# ---- trend ---------------------------------------------------------------------------------------


def _elapsed(t, anchor: float) -> float:
    base = datetime(1970, 1, 1)
    at = t if isinstance(t, datetime) else datetime(t.year, t.month, t.day)
    return (at - base).total_seconds() - anchor


def trend(cube: Cube, time_unit: str = "year", period: tuple[date, date] | None = None, min_n: int = 3) -> tuple[Cube, DataFrame]:
    """Least-squares slope of each cell over elapsed time: a cube of slopes, and diagnostics.

    Time is centred at the middle of the selected range (whole days for dates). A cell is fitted with
    ``min_n`` values or more that do not fall on one time. Diagnostics: n_valid, time_span, slope,
    intercept (at the anchor), r2 (only where values vary) and residual_sd (with more than two values).
    """
    _ordinary(cube, "trend")
    require("trend" not in cube.meta, "trend_nonhistorical_time", "a trend has no series")
    require(time_unit in TREND_SECONDS, "bad_argument", f"time_unit is one of {', '.join(TREND_SECONDS)}")
    require(isinstance(min_n, int) and min_n >= 2, "bad_argument", "min_n is 2 or more")
    picked = [i for i, t in enumerate(cube.time) if period is None or period[0] <= _day(t) <= period[1]]
    require(bool(picked), "trend_no_timestamps", "no time lies in the period")
    first, last = cube.time[picked[0]], cube.time[picked[-1]]
    middle = (_elapsed(first, 0) + _elapsed(last, 0)) / 2
    anchor = middle if isinstance(first, datetime) else math.floor(middle / 86400) * 86400.0
    table = F.broadcast(cube.spark.createDataFrame([(i, _elapsed(cube.time[i], anchor) / TREND_SECONDS[time_unit]) for i in picked], "time_idx int, x double"))
    rows = cube.df.where("value is not null").join(table, "time_idx")
    fit = rows.groupBy(*CELL, "variable").agg(
        F.count("value").alias("n_valid"), (F.max("x") - F.min("x")).alias("time_span"), F.regr_sxx("value", "x").alias("sxx"),
        F.regr_sxy("value", "x").alias("sxy"), F.regr_syy("value", "x").alias("syy"), F.avg("x").alias("mx"), F.avg("value").alias("my"))
    ok = (F.col("n_valid") >= min_n) & (F.col("sxx") > 0)
    fit = fit.withColumn("slope", F.when(ok, finite(F.col("sxy") / F.nullif(F.col("sxx"), F.lit(0.0)))))
    sse = F.greatest(F.lit(0.0), F.col("syy") - F.col("slope") * F.col("sxy"))
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - sse / F.nullif(F.col("syy"), F.lit(0.0))))
    told = fit.select(
        *CELL, "variable", "n_valid", "time_span", "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"),
        F.when(ok & (F.col("syy") > 0), share).alias("r2"), F.when(ok & (F.col("n_valid") > 2), F.sqrt(sse / F.nullif(F.col("n_valid") - 2, F.lit(0)))).alias("residual_sd"))
    at = datetime(1970, 1, 1) + timedelta(seconds=anchor)
    units = {v: f"{time_unit}-1" if u == "1" else f"{u} {time_unit}-1" for v, u in cube.meta.get("units", {}).items()}
    out = cube.with_(df=told.select(*CELL, F.lit(0).alias("time_idx"), "variable", F.col("slope").alias("value")), time=(at if isinstance(first, datetime) else at.date(),),
                     meta=_after_values(cube) | {"units": units, "trend": {"time_unit": time_unit}})
    return recorded(out, "trend", {"time_unit": time_unit, "min_n": min_n, "period": list(period) if period else None}, kind="trend_anchor"), told


# ---- pooled and older forms ----------------------------------------------------------------------


def annual_index(cube: Cube, threshold_pos: float = 0.0, threshold_neg: float = 0.0) -> DataFrame:
    """Statistics of all values of a year, for each variable and depth."""
    _ordinary(cube, "annual_index")
    table = F.broadcast(cube.spark.createDataFrame([(i, _day(t).year) for i, t in enumerate(cube.time)], "time_idx int, year int"))
    rows = cube.df.where("value is not null").join(table, "time_idx")
    v = F.col("value")
    out = rows.groupBy("year", "variable", "depth_idx").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean_value"), F.median("value").alias("median_value"), F.stddev_samp("value").alias("sd_value"),
        F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.percentile("value", 0.1).alias("p10"), F.percentile("value", 0.9).alias("p90"),
        F.avg((v > threshold_pos).cast("double")).alias("frac_positive"), F.avg((v < threshold_neg).cast("double")).alias("frac_negative"))
    out = cube.located(out, ("depth",)).withColumn("threshold_pos", F.lit(threshold_pos)).withColumn("threshold_neg", F.lit(threshold_neg))
    return out.withColumnRenamed("variable", "var")


def to_month(cube: Cube, fun: str | Callable) -> Cube:
    """Monthly values. A name takes the built-in reducer on every month; a function gets each cell-month's
    finite values as a numpy array and returns one number, for months that occur."""
    if isinstance(fun, str):
        return aggregate_time(cube, "month", fun)[0]
    _ordinary(cube, "to_month")
    months = sorted({_day(t).replace(day=1) for t in cube.time})
    place = {m: i for i, m in enumerate(months)}
    table = F.broadcast(cube.spark.createDataFrame([(i, place[_day(t).replace(day=1)]) for i, t in enumerate(cube.time)], "time_idx int, month_idx int"))
    rows = cube.df.where("value is not null").join(table, "time_idx")

    @F.pandas_udf("double")
    def reduced(values: pd.Series) -> float:
        return float(fun(values.to_numpy()))

    got = rows.groupBy(*CELL, "variable", "month_idx").agg(reduced("value").alias("v"))
    df = got.select(*CELL, F.col("month_idx").alias("time_idx"), "variable", finite(F.col("v")).alias("value"))
    return recorded(cube.with_(df=df, time=tuple(months), meta=_after_values(cube)), "to_month", {"fun": getattr(fun, "__name__", "function")})


def clim_day(cube: Cube, **options) -> Climatology:
    return climatology(cube, "day", **options)


def clim_month(cube: Cube, **options) -> Climatology:
    return climatology(cube, "month", **options)


def anom_diff(cube: Cube, clim: Climatology) -> Cube:
    return anomaly(cube, clim, "difference")


def anom_z(cube: Cube, clim: Climatology) -> Cube:
    return anomaly(cube, clim, "z")
