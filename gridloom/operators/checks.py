"""Contract validation and inspection: tables about a cube, from its axes and metadata."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom import cube as model
from gridloom.cube import AXES, KEY, Cube
from gridloom.errors import GridError, require
from gridloom.functions.calendars import CalendarTime
from gridloom.operators.provenance import history

REPORT = "check string, status string, severity string, component string, message string, repairable boolean, suggested_action string"


def validate(cube: Cube, strict: bool = False) -> DataFrame:
    """One row for each check of the contract: PASS, WARN or FAIL. Values are not read, except that rows
    of a cell found twice fail ``unique_cells``. ``strict`` raises once the whole report is made."""
    rows: list[tuple] = []

    def say(check: str, component: str, ok: bool, message: str, warn: bool = False, action: str = "", repairable: bool = False) -> None:
        status = "PASS" if ok else "WARN" if warn else "FAIL"
        rows.append((check, status, {"PASS": "info", "WARN": "warning", "FAIL": "error"}[status], component, "ok" if ok else message, repairable and not ok, "" if ok else action))

    def holds(test, *args) -> bool:
        try:
            test(*args)
        except GridError:
            return False
        return True

    say("class", "cube", isinstance(cube, Cube), "not a cube")
    say("required_components", "cube", set(KEY) | {"value"} <= set(cube.df.columns), "columns are missing from the rows")
    say("value_type", "data", dict(cube.df.dtypes).get("value") == "double", "values are not double")
    say("index_types", "data", all(dict(cube.df.dtypes).get(c) in ("int", "bigint") for c in KEY[:4]), "positions are not whole numbers")
    for axis in AXES:
        say(f"nonempty_{axis}", axis, len(getattr(cube, axis)) > 0, "the axis is empty")
    say("longitude_finite", "longitude", all(math.isfinite(v) for v in cube.longitude), "a longitude is not finite")
    say("longitude_bounds", "longitude", holds(model.check_longitude, cube.longitude), "longitudes are outside [-180, 180] and [0, 360]")
    say("latitude_finite", "latitude", all(math.isfinite(v) for v in cube.latitude), "a latitude is not finite")
    say("latitude_bounds", "latitude", holds(model.check_latitude, cube.latitude), "latitudes are outside [-90, 90]")
    say("depth", "depth", holds(model.check_depth, cube.depth), "depths are neither finite nor one missing value")
    say("time_class", "time", len({type(t) for t in cube.time}) == 1, "times are of several kinds")
    say("time_unique", "time", len(set(cube.time)) == len(cube.time), "a time occurs twice")
    say("time_strictly_increasing", "time", holds(model.check_time, cube.time), "times do not increase")
    say("time_timezone", "time", all(getattr(t, "tzinfo", None) is None for t in cube.time), "times carry a zone; they are UTC without one")
    say("time_calendar", "time", not isinstance(cube.time[0], CalendarTime) or len({t.calendar for t in cube.time}) == 1, "times are of several calendars")
    say("variables", "variables", holds(model.check_variables, cube.variables), "variable names are empty or repeated")
    say("logical_shape", "cube", all(n > 0 for n in cube.shape), "an axis has no length")
    say("units", "units", all(cube.unit(v) for v in cube.variables), "a variable has no unit", warn=True, action="add it to the metadata", repairable=True)
    v = cube.meta.get("vertical")
    say("vertical_metadata", "depth", v is None or {"kind", "unit", "positive"} <= set(v), "the vertical description is incomplete")
    say("vertical_bounds", "depth", not (v or {}).get("bounds") or len(v["bounds"]) == len(cube.depth), "bounds and depths differ in number")
    extents = (("spatial_extent", all(len(a) for a in (cube.longitude, cube.latitude))), ("temporal_extent", bool(cube.time)), ("depth_extent", bool(cube.depth)))
    for name, ok in extents:
        say(name, "extent", ok, "the extent is empty")
    say("provenance", "provenance", holds(lambda: history(cube.meta)), "the history cannot be read")
    say("provenance_present", "provenance", bool(cube.meta.get("provenance")), "no history", warn=True, action="run an operator that records one")

    def storable() -> None:
        try:
            json.dumps(cube.meta)
        except (TypeError, ValueError) as error:
            raise GridError("bad_cube", str(error)) from error

    say("optional_metadata", "metadata", holds(storable), "metadata cannot be written as JSON")
    say("unique_cells", "data", cube.df.groupBy(*KEY).count().where("count > 1").isEmpty(), "a cell has several rows")
    bad = [r[0] for r in rows if r[1] == "FAIL"]
    require(not (strict and bad), "validation_error", f"failed: {', '.join(bad)}")
    return cube.spark.createDataFrame(rows, REPORT)


def inspect(cube: Cube) -> DataFrame:
    """A row for each axis: size, range, least, middle and greatest spacing, and whether it is regular."""
    rows = []
    for axis in AXES:
        values = getattr(cube, axis)
        if axis == "time":
            from gridloom.operators.select import _seconds
            keys = [_seconds(v) for v in values]
            low, high = str(values[0]), str(values[-1])
        else:
            keys = [v for v in values if v is not None]
            low, high = (str(min(keys)), str(max(keys))) if keys else (None, None)
        steps = sorted(b - a for a, b in zip(keys, keys[1:]))
        regular = not steps or abs(steps[-1] - steps[0]) <= 1.4901161193847656e-08 * max(1.0, abs(steps[0]))
        middle = None if not steps else (steps[(len(steps) - 1) // 2] + steps[len(steps) // 2]) / 2
        rows.append((axis, len(values), low, high, steps[0] if steps else None, middle, steps[-1] if steps else None, regular))
    return cube.spark.createDataFrame(rows, "axis string, n int, low string, high string, min_spacing double, median_spacing double, max_spacing double, regular boolean")


def missing(cube: Cube) -> DataFrame:
    """variable, n_cells (from the axes), n_valid and n_missing."""
    per = math.prod(cube.shape[:4])
    names = cube.spark.createDataFrame([(v,) for v in cube.variables], "variable string")
    counts = cube.df.groupBy("variable").agg(F.count("value").alias("n_valid"))
    n = F.coalesce("n_valid", F.lit(0).cast("long"))
    return names.join(counts, "variable", "left").select("variable", F.lit(per).cast("long").alias("n_cells"), n.alias("n_valid"), (F.lit(per) - n).cast("long").alias("n_missing"))


def summary(cube: Cube) -> str:
    """A few lines of text; no job runs."""
    a, b, c, d, e = cube.shape
    return (f"cube {a} x {b} x {c} x {d} x {e} (longitude, latitude, depth, time, variable)\n"
            f"longitude {min(cube.longitude)} to {max(cube.longitude)}, latitude {min(cube.latitude)} to {max(cube.latitude)}\n"
            f"depth {'surface' if cube.depth == (None,) else f'{min(cube.depth)} to {max(cube.depth)}'}, time {cube.time[0]} to {cube.time[-1]}\n"
            f"variables {', '.join(f'{v} ({cube.unit(v)})' if cube.unit(v) else v for v in cube.variables)}; at most {math.prod(cube.shape) * 8} bytes")
