"""Coordinate selection: slices, crops and extraction to tables.

Selectors are resolved on the driver against the axes; the data then meets a small table of (position,
new position). A range test on positions goes with it, which Parquet statistics can use.
"""

from __future__ import annotations

import math
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.cube import AXES, AXIS_INDEX, Cube, utc
from gridloom.errors import GridError, require
from gridloom.functions.calendars import CalendarTime
from gridloom.operators.provenance import recorded


def _seconds(value) -> float:
    if isinstance(value, CalendarTime):
        return value.seconds
    if isinstance(value, datetime):
        return (value - datetime(1970, 1, 1)).total_seconds()
    return (value - date(1970, 1, 1)).days * 86400.0


def as_time(cube: Cube, value):
    """A selector value in the kind of the cube's time axis."""
    kind = type(cube.time[0])
    if isinstance(value, str):
        value = date.fromisoformat(value) if len(value) == 10 else datetime.fromisoformat(value.replace("Z", "+00:00"))
    value = utc(value)
    if kind is datetime and type(value) is date:
        value = datetime(value.year, value.month, value.day)
    if kind is date and isinstance(value, datetime):
        require(value == datetime(value.year, value.month, value.day), "slice_time", "a time of day on an axis of dates")
        value = value.date()
    require(isinstance(value, kind), "slice_time", f"the time axis has {kind.__name__} values")
    if kind is CalendarTime:
        require(value.calendar == cube.time[0].calendar, "slice_time", "the time axis has another calendar")
    return value


def _listed(values) -> list:
    return list(values) if isinstance(values, (list, tuple, range)) else [values]


def positions(cube: Cube, axis: str, values, by: str = "value", match: str = "exact", tolerance=None) -> list[int]:
    """Positions on an axis of the requested values, in the order asked for.

    Exact matches are equal values, the first stored one. Nearest takes the least distance inside the
    axis range, the first stored position (for times: the earlier one) on ties.
    """
    axis_values = getattr(cube, axis)
    asked = _listed(values)
    require(len(asked) > 0, "bad_argument", f"{axis}: nothing is selected")
    if by == "index":
        require(match == "exact" and tolerance is None, "bad_argument", "match and tolerance do not go with positions")
        for i in asked:
            require(isinstance(i, int) and 1 <= i <= len(axis_values), "slice_outside_domain", f"{axis}: position {i} is outside 1 to {len(axis_values)}")
        return [i - 1 for i in asked]
    if axis == "depth" and axis_values == (None,):
        require(asked == [None], "slice_outside_domain", "a surface cube has no depth to select but None")
        return [0]
    if axis == "time":
        asked = [as_time(cube, v) for v in asked]
        keys, wanted = [_seconds(v) for v in axis_values], [_seconds(v) for v in asked]
        limit = tolerance.total_seconds() if isinstance(tolerance, timedelta) else tolerance
    else:
        require(all(isinstance(v, (int, float)) and math.isfinite(v) for v in asked), "bad_argument", f"{axis}: selectors are finite numbers")
        keys, wanted, limit = list(axis_values), [float(v) for v in asked], tolerance
    require(limit is None or limit >= 0 and math.isfinite(limit), "bad_argument", "a tolerance is finite and not negative")
    out = []
    for shown, v in zip(asked, wanted):
        require(min(keys) <= v <= max(keys), "slice_outside_domain", f"{axis}: {shown} is outside the axis")
        if match == "exact":
            require(v in keys, "slice_not_found", f"{axis}: {shown} is not on the axis")
            out.append(keys.index(v))
        else:
            at = min(range(len(keys)), key=lambda i: (abs(keys[i] - v), keys[i] if axis == "time" else i, i))
            require(limit is None or abs(keys[at] - v) <= limit, "slice_tolerance", f"{axis}: {shown} is farther than the tolerance from the axis")
            out.append(at)
    return out


def _variables(cube: Cube, variable, repeats: bool = False) -> list[str]:
    asked = _listed(variable)
    require(repeats or len(set(asked)) == len(asked), "slice_variable", "a variable is asked for twice")
    for v in asked:
        require(v in cube.variables, "slice_variable", f"variable {v!r} is not in the cube")
    return asked


def taken(cube: Cube, picked: dict[str, list[int]], variables: list[str] | None = None) -> Cube:
    """The cube at given positions of some axes, in their order; repeats are kept (spatial axes only)."""
    df, changes = cube.df, {axis: tuple(getattr(cube, axis)[i] for i in at) for axis, at in picked.items()}
    if cube.source is not None:  # the file is read anew at these positions
        source = cube.source.taken(picked, variables)
        df, picked_here, changes["source"] = source.frame(), {}, source
    else:
        picked_here = picked
    for axis, at in picked_here.items():
        index, old = AXIS_INDEX[axis], getattr(cube, axis)
        if at == list(range(len(old))):
            continue
        df = df.where(F.col(index).between(min(at), max(at)))
        if at == list(range(at[0], at[0] + len(at))):
            df = df.withColumn(index, F.col(index) - at[0])
        else:
            table = cube.spark.createDataFrame(list(zip(at, range(len(at)))), f"{index} int, _new int")
            df = df.join(F.broadcast(table), index).drop(index).withColumnRenamed("_new", index)
    if variables is not None and tuple(variables) != cube.variables:
        df = df.where(F.col("variable").isin(variables))
        changes["variables"] = tuple(variables)
    meta = dict(cube.meta)
    if "depth" in picked and "vertical" in meta and meta["vertical"].get("bounds"):
        meta["vertical"] = meta["vertical"] | {"bounds": [meta["vertical"]["bounds"][i] for i in picked["depth"]]}
    # A selection of a climatology or anomaly is no longer one: what describes them is dropped, and listed.
    # The intervals of a climatological time axis go with their times.
    told = meta.get("climatology", {})
    if "start" in told and "time" in picked:
        meta["climatology"] = told = told | {k: [told[k][i] for i in picked["time"]] for k in ("start", "end", "raw")}
    gone = [k for k in ("climatology", "anomaly", "qa") if k in meta and not (k == "climatology" and "start" in told)]
    meta = {k: v for k, v in meta.items() if k not in gone}
    if gone:
        meta["discarded"] = sorted({*meta.get("discarded", []), *gone})
    return cube.with_(df=df.select(*cube.df.columns), meta=meta, **changes)


def slice_cube(cube: Cube, longitude=None, latitude=None, depth="all", time=None, variable=None, by: str = "value", match: str = "exact", tolerance: dict | None = None) -> Cube:
    """Select coordinates on any axes; an axis not mentioned stays whole.

    ``tolerance`` is by axis and inclusive, for nearest matches. Order and repeats of places are kept;
    the times selected must still increase.
    """
    require(by in ("value", "index") and match in ("exact", "nearest"), "bad_argument", "by is value or index, match exact or nearest")
    tolerance = tolerance or {}
    wanted = {"longitude": longitude, "latitude": latitude, "depth": depth, "time": time}
    for axis in tolerance:
        require(axis in wanted and wanted[axis] is not None and match == "nearest", "bad_argument", "a tolerance goes with a selected axis and nearest matches")
    picked = {axis: positions(cube, axis, v, by, match, tolerance.get(axis)) for axis, v in wanted.items() if not (v is None and axis != "depth" or axis == "depth" and v == "all")}
    if "time" in picked:
        require(all(a < b for a, b in zip(picked["time"], picked["time"][1:])), "slice_time", "selected times increase strictly")
    variables = None if variable is None else _variables(cube, variable)
    return recorded(taken(cube, picked, variables), "slice", {"by": by, "match": match, "axes": sorted(picked), "variables": variables})


def crop(cube: Cube, longitude=None, latitude=None, depth=None, time=None, variable=None, bbox: dict | None = None, outside: str = "error") -> Cube:
    """Keep closed coordinate ranges. ``outside`` is error (a range must lie inside the axis) or clip."""
    require(outside in ("error", "clip"), "bad_argument", "outside is error or clip")
    if bbox is not None:
        require(set(bbox) == {"xmin", "ymin", "xmax", "ymax"}, "bad_argument", "bbox names xmin, ymin, xmax and ymax")
        require(longitude is None and latitude is None, "bad_argument", "bbox excludes longitude and latitude")
        longitude, latitude = (bbox["xmin"], bbox["xmax"]), (bbox["ymin"], bbox["ymax"])
    picked = {}
    for axis, bounds in (("longitude", longitude), ("latitude", latitude), ("depth", depth), ("time", time)):
        if bounds is None:
            continue
        values = getattr(cube, axis)
        require(values != (None,), "crop_outside_domain", "a surface cube has no depth range")
        low, high = bounds
        if axis == "time":
            keys = [_seconds(v) for v in values]
            low, high = (min(keys) if low is None else _seconds(as_time(cube, low)), max(keys) if high is None else _seconds(as_time(cube, high)))
        else:
            keys = list(values)
        require(low <= high, "bad_argument", f"{axis}: the range is reversed")
        require(outside == "clip" or min(keys) <= low and high <= max(keys), "crop_outside_domain", f"{axis}: the range reaches beyond the axis")
        require(high >= min(keys) and low <= max(keys), "crop_no_overlap", f"{axis}: the range does not meet the axis")
        at = [i for i, k in enumerate(keys) if low <= k <= high]
        require(bool(at), "crop_no_coordinates", f"{axis}: no coordinate lies in the range")
        picked[axis] = at
    variables = None if variable is None else _variables(cube, variable)
    return recorded(taken(cube, picked, variables), "crop", {"axes": sorted(picked), "outside": outside})


def with_units(cube: Cube, frame: DataFrame) -> DataFrame:
    """Add ``unit`` by variable."""
    unit = F.lit(None).cast("string")
    for v in cube.variables:
        if cube.unit(v) is not None:
            unit = F.when(F.col("variable") == v, F.lit(cube.unit(v))).otherwise(unit)
    return frame.withColumn("unit", unit)


def _asked(cube: Cube, axis: str, values) -> list:
    """Requested coordinates in the order of the axis of the result."""
    if axis != "time":
        return [float(v) for v in _listed(values)]
    out: dict = {}
    for v in _listed(values):
        out.setdefault(positions(cube, "time", v, "value", "nearest")[0], as_time(cube, v))
    return [out[i] for i in sorted(out)]


def _stored(value):
    require(not isinstance(value, CalendarTime), "extract_size", "distances in time are not kept for calendar times")
    return value


def extract(cube: Cube, longitude=None, latitude=None, depth="all", time=None, variable=None, by: str = "value", match: str = "exact", tolerance: dict | None = None,
            mode: str = "table", form: str = "long", keep_index: bool = False, keep_distance: bool = False, max_rows: int | None = None) -> DataFrame:
    """A table of every selected cell, missing ones too.

    Long: longitude, latitude, depth, time, variable, unit, value. Wide: a column for each variable.
    ``point`` and ``profile`` want one longitude, latitude and time (a point also one depth), ``series``
    one longitude, latitude and depth. ``keep_index`` adds 1-based positions on the cube's axes,
    ``keep_distance`` (nearest only) the requested coordinates and distances (in time: seconds). A table of
    more than ``max_rows`` rows is refused before anything is read.
    """
    require(mode in ("table", "point", "profile", "series") and form in ("long", "wide"), "extract_mode", "mode is table, point, profile or series; form long or wide")
    require(not keep_distance or match == "nearest" and by == "value", "bad_argument", "distances go with nearest matches")
    wanted = {"longitude": longitude, "latitude": latitude, "depth": depth, "time": time}
    picked = {}
    for axis, v in wanted.items():
        whole = v is None and axis != "depth" or axis == "depth" and v == "all"
        picked[axis] = list(range(len(getattr(cube, axis)))) if whole else positions(cube, axis, v, by, match, (tolerance or {}).get(axis))
    one = {"point": AXES, "profile": ("longitude", "latitude", "time"), "series": ("longitude", "latitude", "depth"), "table": ()}[mode]
    for axis in one:
        require(len(picked[axis]) == 1, "extract_mode", f"{mode} wants one {axis}")
    require(form == "long" or all(len(set(at)) == len(at) for at in picked.values()), "extract_mode", "a wide table has no repeated coordinates")
    variables = list(cube.variables) if variable is None else _variables(cube, variable, form == "long")
    size = math.prod(map(len, picked.values())) * (len(variables) if form == "long" else 1)
    require(max_rows is None or size <= max_rows, "extract_size", f"the table has {size} rows; {max_rows} are allowed")
    small = taken(cube.with_(meta={}), picked | {"time": sorted(set(picked["time"]))}, list(dict.fromkeys(variables)))
    cells = small.located(small.dense().select(*AXIS_INDEX.values(), "variable", "value", *[F.col(i).alias(f"_{i}") for i in AXIS_INDEX.values()]))
    extra = []
    for axis in AXES:
        at = sorted(set(picked["time"])) if axis == "time" else picked[axis]
        index = AXIS_INDEX[axis]
        asked = wanted[axis]
        distant = keep_distance and asked is not None and asked != "all"
        if keep_index or distant:
            asked = [_stored(v) for v in _asked(cube, axis, asked)] if distant else [None] * len(at)
            kind = "double" if axis != "time" else "timestamp_ntz" if isinstance(cube.time[0], datetime) else "date"
            table = cube.spark.createDataFrame([(k, i + 1, asked[k]) for k, i in enumerate(at)], f"_{index} int, {axis}_index int, {axis}_requested {kind}")
            cells = cells.join(F.broadcast(table), f"_{index}")
            extra += [f"{axis}_index"] * keep_index
        if distant:
            apart = F.abs(F.col(axis) - F.col(f"{axis}_requested")) if axis != "time" else F.abs(F.unix_seconds(F.col(axis).cast("timestamp")) - F.unix_seconds(F.col(f"{axis}_requested").cast("timestamp"))).cast("double")
            cells = cells.withColumn(f"{axis}_distance", apart)
            extra += [f"{axis}_requested", f"{axis}_distance"]
    if form == "wide":
        keys = [*AXES, *extra]
        return cells.groupBy(*keys).pivot("variable", variables).agg(F.first("value"))
    if len(set(variables)) < len(variables):
        times = {v: variables.count(v) for v in variables}
        repeat = F.lit(1)
        for v, n in times.items():
            repeat = F.when(F.col("variable") == v, n).otherwise(repeat)
        cells = cells.withColumn("_r", F.explode(F.sequence(F.lit(1), repeat)))
    return with_units(cube, cells).select(*AXES, "variable", "unit", "value", *extra)


__all__ = ["slice_cube", "crop", "extract", "positions", "taken", "with_units", "GridError"]
