"""Plot-ready tables of seven kinds, with a JSON-able description. Values are only selected, never
aggregated, smoothed or filled."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.cube import Cube
from gridloom.errors import require
from gridloom.operators.path import transect
from gridloom.operators.select import extract


@dataclass(frozen=True)
class PlotData:
    kind: str
    data: DataFrame
    spec: dict


def _spec(cube: Cube, kind: str, variable: str, x: str, y: str, **more) -> dict:
    unit = cube.unit(variable)
    return {"kind": kind, "variable": variable, "unit": unit, "label": f"{variable} ({unit})" if unit else variable, "x": x, "y": y} | more


def _single(cube: Cube, variable: str | None) -> str:
    require(variable is not None or len(cube.variables) == 1, "viz_variable", "name one of several variables")
    return variable or cube.variables[0]


def plot_map(cube: Cube, variable: str | None = None, time=None, depth="all", style: str = "field", centre: float | None = None, limits: tuple[float, float] | None = None,
             match: str = "exact", levels: list[float] | None = None) -> PlotData:
    """One variable at one time and depth over the map."""
    require(style in ("field", "contour", "field_contour"), "viz_style", "style is field, contour or field_contour")
    require(centre is None or limits is None or limits[0] < centre < limits[1], "viz_centre", "the centre lies inside the limits")
    require(all(abs(b - a) <= 180 for a, b in zip(cube.longitude, cube.longitude[1:])), "viz_wrap", "longitudes are not continuous")
    name = _single(cube, variable)
    require(time is not None or len(cube.time) == 1, "viz_selection", "a map has one time")
    require(depth != "all" or len(cube.depth) == 1, "viz_selection", "a map has one depth")
    data = extract(cube, time=time, depth=depth, variable=name, match=match).select("longitude", "latitude", "value")
    return PlotData("MAP_LAYER", data, _spec(cube, "MAP_LAYER", name, "longitude", "latitude", style=style, centre=centre, limits=limits, levels=levels))


def contour_segments(plot: PlotData, level: float) -> list[tuple[tuple[float, float], tuple[float, float]]]:
    """Line segments of one level over a map (marching squares; squares with a missing corner have none)."""
    rows = {(r.longitude, r.latitude): r.value for r in plot.data.collect()}  # one map: places only
    xs, ys = sorted({k[0] for k in rows}), sorted({k[1] for k in rows})
    out = []
    for x0, x1 in zip(xs, xs[1:]):
        for y0, y1 in zip(ys, ys[1:]):
            corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
            v = [rows.get(c) for c in corners]
            if any(a is None for a in v):
                continue
            cuts = []
            for k in range(4):
                a, b, p, q = v[k], v[(k + 1) % 4], corners[k], corners[(k + 1) % 4]
                if (a >= level) != (b >= level):
                    w = (level - a) / (b - a)
                    cuts.append((p[0] + w * (q[0] - p[0]), p[1] + w * (q[1] - p[1])))
            out += [(cuts[0], cuts[1])] if len(cuts) == 2 else [(cuts[0], cuts[1]), (cuts[2], cuts[3])] if len(cuts) == 4 else []
    return out


def pretty(low: float, high: float, n: int = 7) -> list[float]:
    """Round levels strictly inside a range."""
    require(math.isfinite(low) and math.isfinite(high) and low < high, "viz_range", "the range is empty")
    raw = (high - low) / n
    base = 10 ** math.floor(math.log10(raw))
    step = min((base * k for k in (1, 2, 5, 10)), key=lambda s: abs(s - raw))
    first = math.floor(low / step) + 1
    return [k * step for k in range(first, math.ceil(high / step))]


def section(cube: Cube, variable: str | None = None, longitude=None, latitude=None, time=None, match: str = "exact") -> PlotData:
    """Depth against longitude (at one latitude) or latitude (at one longitude)."""
    name = _single(cube, variable)
    require((longitude is None) != (latitude is None), "viz_selection", "a section fixes either longitude or latitude")
    require(len(cube.depth) >= 2, "viz_selection", "a section has two depths or more")
    x = "longitude" if latitude is not None else "latitude"
    data = extract(cube, longitude=longitude, latitude=latitude, time=time, variable=name, match=match).select(x, "depth", "value")
    return PlotData("SECTION", data, _spec(cube, "SECTION", name, x, "depth", reverse_y=True))


def profile(cube: Cube, longitude, latitude, time, variables: list[str] | None = None, match: str = "exact") -> PlotData:
    """Values against depth at one place and time."""
    require(len(cube.depth) >= 2, "viz_selection", "a profile has two depths or more")
    data = extract(cube, longitude=longitude, latitude=latitude, time=time, variable=variables or list(cube.variables), match=match, mode="profile").select("variable", "depth", "value").orderBy("variable", "depth")
    return PlotData("PROFILE", data, _spec(cube, "PROFILE", (variables or list(cube.variables))[0], "value", "depth", reverse_y=True))


def plot_transect(cube: Cube, path: list[dict], time, variable: str | None = None, distance: str = "requested", depth="all", match: str = "nearest") -> PlotData:
    """Values against distance along a path (and depth, if there are several)."""
    require(len(path) >= 2 and distance in ("requested", "matched"), "viz_selection", "a transect has two points or more; distance is requested or matched")
    name = _single(cube, variable)
    rows = transect(cube, path, time, depth, name, match).select(F.col(f"{distance}_distance_km").alias("distance_km"), "depth", "value")
    kind = "TRANSECT_LINE" if len(cube.depth) == 1 or depth != "all" and not isinstance(depth, (list, tuple)) else "TRANSECT_SECTION"
    return PlotData(kind, rows, _spec(cube, kind, name, "distance_km", "depth" if kind == "TRANSECT_SECTION" else "value", reverse_y=kind == "TRANSECT_SECTION"))


def timeseries(cube: Cube, longitude, latitude, depth="all", variables: list[str] | None = None, start=None, stop=None, match: str = "exact") -> PlotData:
    """Values against time at one place, in an inclusive window."""
    from gridloom.operators.select import crop

    small = crop(cube, time=(start, stop)) if start is not None or stop is not None else cube
    data = extract(small, longitude=longitude, latitude=latitude, depth=depth, variable=variables or list(cube.variables), match=match, mode="series").select("variable", "time", "value").orderBy("variable", "time")
    return PlotData("TIMESERIES", data, _spec(cube, "TIMESERIES", (variables or list(cube.variables))[0], "time", "value"))


def hovmoller(cube: Cube, axis: str, variable: str | None = None, longitude=None, latitude=None, depth="all", match: str = "exact") -> PlotData:
    """Time against one axis, the others fixed."""
    require(axis in ("longitude", "latitude", "depth"), "viz_selection", "axis is longitude, latitude or depth")
    name = _single(cube, variable)
    fixed = {"longitude": longitude, "latitude": latitude, "depth": None if depth == "all" else depth}
    for other in ("longitude", "latitude", "depth"):
        require((other == axis) == (fixed[other] is None) or other == "depth" and len(cube.depth) == 1, "viz_selection", f"{other} is fixed unless it is the axis")
    require(len(cube.time) >= 2 and len(getattr(cube, axis)) >= 2, "viz_selection", "two times and positions at least")
    data = extract(cube, longitude=longitude, latitude=latitude, depth=depth, variable=name, match=match).select("time", axis, "value")
    steps = [abs(b - a) for a, b in zip(getattr(cube, axis), getattr(cube, axis)[1:])]
    return PlotData("HOVMOLLER", data, _spec(cube, "HOVMOLLER", name, axis, "time", footprint=min(s for s in steps if s > 0)))
