"""Lookups along paths and at events."""

from __future__ import annotations

import math
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.cube import CELL, Cube, axis_table
from gridloom.errors import require
from gridloom.functions.calendars import CalendarTime
from gridloom.operators.select import positions, taken

EARTH_KM = 6371.0088


def haversine_km(lon1: float, lat1: float, lon2: float, lat2: float) -> float:
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_KM * math.asin(math.sqrt(min(1.0, max(0.0, a))))


def transect(cube: Cube, path: list[dict], time=None, depth="all", variable=None, match: str = "nearest", tolerance: dict | None = None, form: str = "long", keep_index: bool = False,
             by: str = "value", mode: str = "auto") -> DataFrame:
    """Values at paired points of a path, in path order, with distances along it in km.

    ``path`` has dicts of longitude, latitude and, if wanted, id; with ``by`` index, these and the other
    selectors are 1-based positions. One time is selected (a cube's only time by default). ``mode`` is
    profile (one point), horizontal (several points, one depth), section (several of both) or auto, which
    takes the one that fits. Segments across the antimeridian are refused, and so is a path that writes
    longitudes otherwise than the cube does. ``keep_index`` adds 1-based positions on every axis.
    """
    require(len(path) > 0, "transect_point", "a path has points")
    require(by in ("value", "index") and match in ("nearest", "exact") and form in ("long", "wide"), "bad_argument", "by is value or index, match nearest or exact, form long or wide")
    require(by == "value" or tolerance is None, "bad_argument", "a tolerance does not go with positions")
    tolerance, how = tolerance or {}, match if by == "value" else "exact"
    at = lambda axis, v: positions(cube, axis, v, by, how, tolerance.get(axis))
    if by == "value":
        lon, lat = [float(p["longitude"]) for p in path], [float(p["latitude"]) for p in path]
        require(all(map(math.isfinite, lon + lat)), "transect_point", "path coordinates are finite")
        require(not (any(v < 0 for v in lon) and max(cube.longitude) > 180) and not (any(v > 180 for v in lon) and min(cube.longitude) < 0), "transect_crs_error", "path and cube write longitudes differently")
    at_lon, at_lat = ([at(axis, p[axis])[0] for p in path] for axis in ("longitude", "latitude"))
    got_lon, got_lat = [cube.longitude[i] for i in at_lon], [cube.latitude[i] for i in at_lat]
    if by == "index":
        lon, lat = got_lon, got_lat
    for xs in (lon, got_lon):
        require(all(abs(a - b) <= 180 for a, b in zip(xs, xs[1:])), "transect_antimeridian", "a segment crosses the antimeridian")
    require(time is not None or len(cube.time) == 1, "transect_selection_error", "a transect has one time")
    at_time = [0] if time is None else at("time", time)
    require(len(at_time) == 1, "transect_selection_error", "a transect has one time")
    depths = list(range(len(cube.depth))) if isinstance(depth, str) and depth == "all" else at("depth", depth)
    variables = list(cube.variables) if variable is None else [variable] if isinstance(variable, (str, int)) else list(variable)
    if by == "index" and variable is not None:
        require(all(isinstance(v, int) and 1 <= v <= len(cube.variables) for v in variables), "slice_variable", f"variable positions are 1 to {len(cube.variables)}")
        variables = [cube.variables[v - 1] for v in variables]
    require(all(v in cube.variables for v in variables), "slice_variable", "a variable is not in the cube")
    require(len(set(depths)) == len(depths) and len(set(variables)) == len(variables), "transect_selection_error", "a depth or variable is selected twice")
    fits = "profile" if len(path) == 1 else "horizontal" if len(depths) == 1 else "section"
    require(mode in ("auto", fits), "transect_mode", f"{mode} does not fit {len(path)} points and {len(depths)} depths; {fits} does")
    asked, found = [0.0], [0.0]
    for k in range(1, len(path)):
        asked.append(asked[-1] + haversine_km(lon[k - 1], lat[k - 1], lon[k], lat[k]))
        found.append(found[-1] + haversine_km(got_lon[k - 1], got_lat[k - 1], got_lon[k], got_lat[k]))
    # Points, levels and their coordinates are known here: one small table has every row of the answer but its value.
    levels = [(k, d, v) for k, d in enumerate(depths) for v in variables]
    rows = [(str(p.get("id", k + 1)), k + 1, lon[k], lat[k], got_lon[k], got_lat[k], haversine_km(lon[k], lat[k], got_lon[k], got_lat[k]), asked[k], found[k], at_lon[k], at_lat[k],
             level, None if cube.depth[d] is None else float(cube.depth[d]), v, cube.unit(v), at_lon[k] + 1, at_lat[k] + 1, d + 1, at_time[0] + 1, cube.variables.index(v) + 1)
            for k, p in enumerate(path) for level, d, v in levels]
    wanted = cube.spark.createDataFrame(rows, "point_id string, point_order int, longitude_requested double, latitude_requested double, longitude double, latitude double, match_distance_km double, "
                                        "requested_distance_km double, matched_distance_km double, lon_idx int, lat_idx int, depth_idx int, depth double, variable string, unit string, "
                                        "longitude_index int, latitude_index int, depth_index int, time_index int, variable_index int")
    levels_only = {"depth": depths, "time": at_time}
    if cube.source is not None:
        cells = cube.source.taken(levels_only, variables).pairs(list(zip(at_lon, at_lat)))
    else:
        box = F.col("lon_idx").between(min(at_lon), max(at_lon)) & F.col("lat_idx").between(min(at_lat), max(at_lat))
        cells = taken(cube.with_(meta={}), levels_only, variables).df.where(box)
        cells = cells.join(F.broadcast(wanted.select(*CELL, "variable").distinct()), [*CELL, "variable"])
    # At most a value for each row of the path's table.
    out = wanted.join(F.broadcast(cells.select(*CELL, "variable", "value")), [*CELL, "variable"], "left")
    time_table = axis_table(cube.spark, "time", (cube.time[at_time[0]],))
    out = out.withColumn("time", F.lit(cube.time[at_time[0]])) if not isinstance(cube.time[0], CalendarTime) else out.withColumn("time_idx", F.lit(0)).join(F.broadcast(time_table), "time_idx")
    extra = ["longitude_index", "latitude_index", "depth_index", "time_index", "variable_index"] * keep_index
    base = ["point_id", "point_order", "longitude_requested", "latitude_requested", "longitude", "latitude", "match_distance_km", "requested_distance_km", "matched_distance_km", "depth", "time"]
    if form == "wide":
        return out.groupBy(*base, *[e for e in extra if e != "variable_index"]).pivot("variable", variables).agg(F.first("value"))
    return out.select(*base, "variable", "unit", "value", *extra)


def along(points: DataFrame, longitude: str, latitude: str, order: str, group: list[str] | None = None) -> DataFrame:
    """``points`` with ``segment_km`` and ``distance_km``: distances to the point before and from the start,
    for tracks of any size, one window per group."""
    w = Window.partitionBy(*(group or [F.lit(1)])).orderBy(order)
    r = lambda c: F.radians(c)
    lon0, lat0 = F.lag(longitude).over(w), F.lag(latitude).over(w)
    a = F.pow(F.sin(r(F.col(latitude) - lat0) / 2), 2) + F.cos(r(lat0)) * F.cos(r(F.col(latitude))) * F.pow(F.sin(r(F.col(longitude) - lon0) / 2), 2)
    step = F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))
    return points.withColumn("segment_km", F.coalesce(step, F.lit(0.0))).withColumn("distance_km", F.sum("segment_km").over(w))


def _nearest(events: DataFrame, values: tuple[float, ...], x: str, index: str, matched: str) -> DataFrame:
    """``events`` with the position of the axis value nearest to ``x``, the first stored one on ties, and that
    value; both null where ``x`` is not finite. A binary search in a sorted axis, a batch of events at once."""
    axis = np.asarray(values, dtype=float)
    order = np.lexsort((np.arange(len(axis)), axis))
    sorted_ = axis[order]

    @F.pandas_udf(f"{index} int, {matched} double")
    def nearest(xs: pd.Series) -> pd.DataFrame:
        v = xs.to_numpy(float)
        known = np.isfinite(v)
        at = np.searchsorted(sorted_, np.where(known, v, sorted_[0]))
        low, high = np.clip(at - 1, 0, len(axis) - 1), np.clip(at, 0, len(axis) - 1)
        low = np.searchsorted(sorted_, sorted_[low])  # of equal values the first stored
        high = np.searchsorted(sorted_, sorted_[high])
        near, far = np.abs(sorted_[low] - v), np.abs(sorted_[high] - v)
        best = np.where((near < far) | (near == far) & (order[low] < order[high]), low, high)
        return pd.DataFrame({index: pd.Series(order[best]).astype("Int32").where(known), matched: pd.Series(sorted_[best]).where(known)})

    return events.withColumn("_near", nearest(F.col(x).cast("double"))).select("*", "_near.*").drop("_near")


def link_events(cube: Cube, events: DataFrame, longitude: str = "longitude", latitude: str = "latitude", day: str = "date", depth: str | None = None, variables: list[str] | None = None,
                prefix: str | None = None, day_tolerance: int = 0, keep_grid: bool = True) -> DataFrame:
    """``events`` with the value of the nearest cell in space, on the nearest day within the tolerance.

    There is no limit in space. An event without finite coordinates or a near day gets no value. With
    ``keep_grid`` the cell's coordinates and the day difference come too. Events stay as they are, repeats
    included. Nearest positions are found by binary search in the axes, a batch of events at once; one
    equi-join then fetches the values.
    """
    require(day_tolerance >= 0, "bad_argument", "the tolerance is not negative")
    names = list(cube.variables) if variables is None else variables
    days = [t.date() if hasattr(t, "date") else t for t in cube.time]
    first: dict = {}
    for i, d in enumerate(days):
        first.setdefault(d, i)
    # The nearest day, the earlier one on ties, of every day an event can have: a small table by date.
    best: dict = {}
    for shift in range(day_tolerance + 1):
        for d in sorted(first):
            for other in (d + timedelta(days=shift), d - timedelta(days=shift)):
                best.setdefault(other, (shift, first[d], d))
    spark = cube.spark
    table = F.broadcast(spark.createDataFrame([(d, i, x, gap) for d, (gap, i, x) in best.items()], "_day date, time_idx int, matched_date date, matched_dt_days int"))
    numbered = events.withColumn("_event", F.monotonically_increasing_id())
    found = _nearest(_nearest(numbered, cube.longitude, longitude, "lon_idx", "matched_longitude"), cube.latitude, latitude, "lat_idx", "matched_latitude")
    if depth is None or cube.depth == (None,):
        found = found.withColumn("depth_idx", F.lit(0)).withColumn("matched_depth", F.lit(cube.depth[0]).cast("double"))
    else:
        found = _nearest(found, cube.depth, depth, "depth_idx", "matched_depth")
    found = found.withColumn("_day", F.to_date(day)).join(table, "_day", "left").drop("_day")
    wide = cube.df.where(F.col("variable").isin(names)).groupBy(*CELL, "time_idx").agg(
        *[F.max(F.when(F.col("variable") == v, F.col("value"))).alias(f"{prefix}_{v}" if prefix else f"{v}_value") for v in names])
    out = found.join(wide, [*CELL, "time_idx"], "left")
    columns = [*events.columns, *[c for c in wide.columns if c not in (*CELL, "time_idx")]]
    if keep_grid:
        columns += ["matched_longitude", "matched_latitude", "matched_depth", "matched_date", "matched_dt_days"]
    return out.select(*columns)
