"""Climatological time axes: the intervals that their values stand for, and the methods that made them."""

from __future__ import annotations

import re
from datetime import date, datetime, timezone

import numpy as np

from gridloom.errors import require
from gridloom.functions.calendars import CalendarTime, decode
from gridloom.sources import netcdf3

_CODE = "climatology_semantics_error"
_STEP = re.compile(r"(\w+)\s*:\s*(\w+)(?:\s+(within|over)\s+(years|days))?", re.I)


def methods_of(text) -> list[tuple[str, str, str | None]]:
    """(dimension, statistic, "within years" and the like or None) of each step of a cell_methods."""
    return [(d, how.lower(), f"{word} {span}".lower() if word else None) for d, how, word, span in _STEP.findall(str(text or ""))]


def _seconds(t) -> float:
    if isinstance(t, CalendarTime):
        return t.seconds
    return (t - datetime(1970, 1, 1)).total_seconds() if isinstance(t, datetime) else (t - date(1970, 1, 1)).days * 86400.0


def _said(t) -> str:
    return str(t) if isinstance(t, CalendarTime) else t.isoformat()


def climatology_of(header: netcdf3.Header, dim: str, variables: list[str]) -> dict:
    """Metadata of a climatological time axis: ``chronology`` and ``climatology`` with the interval of each
    value and the variables' methods. Whatever leaves the intervals or methods open is refused."""
    v = header.variables[dim]
    target = v.attributes["climatology"]
    require(isinstance(target, str) and bool(target.strip()), _CODE, "climatology names one variable")
    require("bounds" not in v.attributes, _CODE, "a time axis has bounds or climatology, not both")
    require(target in header.variables, _CODE, f"there is no variable {target}")
    own = header.variables[target]
    require(not {"scale_factor", "add_offset"} & set(own.attributes), _CODE, f"{target} is packed")
    require(len(own.dims) == 2 and dim in own.dims and sorted(own.shape) == sorted((header.dims[dim], 2)), _CODE, f"{target} has no two bounds for each time")
    bounds = netcdf3.values(header, target).astype(float)
    bounds = bounds if own.dims[0] == dim else bounds.T
    require(bool(np.isfinite(bounds).all() and (bounds[:, 0] < bounds[:, 1]).all()), _CODE, "intervals are finite and begin before they end")
    when = lambda x: decode(x, v.attributes.get("units", ""), v.attributes.get("calendar"))
    starts, ends, centres = when(bounds[:, 0].tolist()), when(bounds[:, 1].tolist()), when(netcdf3.values(header, dim).astype(float).tolist())
    require(all(_seconds(a) <= _seconds(c) <= _seconds(b) for a, c, b in zip(starts, centres, ends)), _CODE, "each time lies in its interval")
    methods = {name: methods_of(header.variables[name].attributes.get("cell_methods")) for name in variables}
    for name, steps in methods.items():
        spans = {span for d, _, span in steps if d in (dim, "time")}
        require({"within years", "over years"} <= spans, _CODE, f"{name} does not say how it was made within years and over years")
    said = header.attributes.get("time_coverage_start")
    if isinstance(said, str) and re.match(r"\d{4}-\d{2}-\d{2}", said.strip()) and not isinstance(starts[0], CalendarTime):
        begin = datetime.fromisoformat(said.strip().replace("Z", "+00:00"))
        begin = begin.astimezone(timezone.utc).replace(tzinfo=None) if begin.tzinfo else begin
        first = min(starts, key=_seconds)
        require(abs(_seconds(first) - _seconds(begin)) <= 1, _CODE, f"the intervals begin at {_said(first)}, the file says {said}")
    return {"chronology": "climatological", "climatology": {"target": target, "start": list(map(_said, starts)), "end": list(map(_said, ends)),
                                                            "raw": bounds.tolist(), "methods": {n: header.variables[n].attributes["cell_methods"] for n in variables}}}
