"""What a vertical axis is: its kind, unit and direction, whether depths in it can be measured, and why not."""

from __future__ import annotations

import math
import re

import numpy as np

from gridloom.sources import netcdf3
from gridloom.sources.cf_links import Link, links

# Names of parametric coordinates and of units.
PARAMETRIC = ("atmosphere_ln_pressure_coordinate", "atmosphere_sigma_coordinate", "atmosphere_hybrid_sigma_pressure_coordinate", "atmosphere_hybrid_height_coordinate",
              "atmosphere_sleve_coordinate", "ocean_sigma_coordinate", "ocean_s_coordinate", "ocean_s_coordinate_g1", "ocean_s_coordinate_g2", "ocean_sigma_z_coordinate",
              "ocean_double_sigma_coordinate")
METRES = {"m": ("m", "meter", "meters", "metre", "metres"), "km": ("km", "kilometer", "kilometers", "kilometre", "kilometres")}
SCALE = {"m": 1.0, "km": 1000.0}
OTHER_LENGTHS = ("cm", "centimeter", "centimeters", "centimetre", "centimetres", "mm", "millimeter", "millimeters", "millimetre", "millimetres", "ft", "foot", "feet", "fathom", "fathoms")
PRESSURE = {"Pa": ("pa", "pascal", "pascals"), "hPa": ("hpa",), "kPa": ("kpa",), "bar": ("bar", "bars"), "mbar": ("mbar", "millibar", "millibars"),
            "dbar": ("dbar", "decibar", "decibars"), "atm": ("atm", "atmosphere", "atmospheres")}
LEVELS = ("1", "level", "sigma_level")
DOWN_NAMES, UP_NAMES = ("depth", "sea_floor_depth_below_geoid"), ("height", "altitude")


def unit_family(units) -> tuple[str, str | None]:
    """Family of a unit (LENGTH, PRESSURE, DIMENSIONLESS, MISSING, UNCLASSIFIED) and its short name, if it is supported."""
    key = str(units).strip().lower() if units is not None else ""
    for family, table in (("LENGTH", METRES), ("PRESSURE", PRESSURE)):
        for name, written in table.items():
            if key in written:
                return family, name
    if key in OTHER_LENGTHS:
        return "LENGTH", None
    return ("DIMENSIONLESS", "1") if key in LEVELS else ("UNCLASSIFIED" if key else "MISSING", None)


def kind_of(family: str, standard_name: str, positive: str | None) -> str:
    """The first row that fits."""
    table = (("PARAMETRIC", standard_name in PARAMETRIC),
             ("PRESSURE", family == "PRESSURE"),
             ("DIMENSIONLESS_GENERIC", family == "DIMENSIONLESS"),
             ("DEPTH_LENGTH", standard_name in DOWN_NAMES or family == "LENGTH" and positive == "down"),
             ("HEIGHT_LENGTH", standard_name in UP_NAMES or family == "LENGTH" and positive == "up"))
    return next((kind for kind, fits in table if fits), "UNKNOWN_VERTICAL")


def order_of(centres: np.ndarray) -> str:
    step = np.diff(centres)
    if not len(step):
        return "SINGLETON"
    return "INCREASING" if (step > 0).all() else "DECREASING" if (step < 0).all() else "DUPLICATE" if (step == 0).any() else "NONMONOTONIC"


def bounds_of(header: netcdf3.Header, dim: str, centres: np.ndarray, found: list[Link]) -> dict:
    """``status`` and, where they can be read, ``edges`` (in the bounds' unit) and whether they join."""
    link = next((x for x in found if x.source == dim and x.attribute == "bounds"), None)
    if link is None or not link.usable:
        return {"status": "BOUNDS_MISSING" if link is None else f"BOUNDS_{link.status}"}
    v = header.variables[link.target]
    family, unit = unit_family(header.variables[dim].attributes.get("units"))
    own_family, own_unit = unit_family(v.attributes.get("units"))
    if own_family == "MISSING":
        own_family, own_unit = family, unit
    out = {"target": link.target, "unit": own_unit}
    if sorted(v.shape) != sorted((len(centres), 2)) or dim not in v.dims or len(v.dims) != 2:
        return out | {"status": "BOUNDS_INVALID_SHAPE"}
    edges = netcdf3.values(header, link.target).astype(float)
    edges = edges if v.dims[0] == dim else edges.T
    out["edges"] = edges.tolist()
    if own_family != family or family == "LENGTH" and (unit is None or own_unit is None):
        return out | {"status": "BOUNDS_UNIT_INCOMPATIBLE"}
    inside = centres * SCALE[unit] / SCALE[own_unit] if family == "LENGTH" else centres
    if not np.isfinite(edges).all():
        return out | {"status": "BOUNDS_NONFINITE"}
    low, high = edges.min(axis=1), edges.max(axis=1)
    slack = 8 * math.sqrt(np.finfo(float).eps) * max(1.0, np.abs(edges).max(), np.abs(inside).max())
    at = np.lexsort((high, low))
    gap = low[at][1:] - high[at][:-1]
    checks = (("BOUNDS_NONPOSITIVE", (high <= low).any()), ("BOUNDS_CENTRE_OUTSIDE", ((inside < low - slack) | (inside > high + slack)).any()), ("BOUNDS_OVERLAP", (gap < -slack).any()))
    status = next((name for name, broken in checks if broken), "BOUNDS_VALID")
    return out | {"status": status} | ({"contiguous": bool((np.abs(gap) <= slack).all())} if status == "BOUNDS_VALID" else {})


def formula_of(header: netcdf3.Header, dim: str, standard_name: str, found: list[Link]) -> str:
    """How far the formula_terms of a parametric axis, and of its bounds, resolve."""
    attributes = header.variables[dim].attributes
    if "formula_terms" not in attributes:
        return "FORMULA_TERMS_ABSENT"
    if standard_name not in PARAMETRIC:
        return "FORMULA_TERMS_UNRECOGNIZED_STANDARD_NAME"
    terms = lambda name: [x for x in found if x.source == name and x.attribute == "formula_terms"]
    own = terms(dim)
    if not own or not all(x.usable for x in own):
        return "PARAMETRIC_REFERENCES_UNRESOLVED"
    bounds = next((x for x in found if x.source == dim and x.attribute == "bounds"), None)
    if bounds is None:
        return "PARAMETRIC_STRUCTURALLY_RECOGNIZED"
    if not bounds.usable:
        return "PARAMETRIC_BOUNDS_UNRESOLVED"
    theirs = terms(bounds.target)
    if not theirs:
        return "PARAMETRIC_BOUNDS_FORMULA_TERMS_MISSING"
    if {x.key for x in theirs} != {x.key for x in own}:
        return "PARAMETRIC_BOUNDS_FORMULA_TERMS_MISMATCH"
    return "PARAMETRIC_BOUNDS_STRUCTURALLY_RECOGNIZED" if all(x.usable for x in theirs) else "PARAMETRIC_BOUNDS_REFERENCES_UNRESOLVED"


def _semantics(attributes: dict, dim: str) -> str:
    own = [m for d, m in re.findall(r"(\w+):\s*(\w+)", str(attributes.get("cell_methods", ""))) if d == dim]
    if len(own) > 1:
        return "VERTICAL_CELL_METHOD_AMBIGUOUS"
    return {"point": "VERTICAL_POINT", "mean": "VERTICAL_CELL_MEAN", "sum": "VERTICAL_CELL_SUM"}.get(own[0], "VERTICAL_CELL_OTHER") if own else "VERTICAL_POINT"


def vertical_of(header: netcdf3.Header, dim: str, variables: list[str]) -> dict:
    """The vertical part of a cube's metadata. Only an axis whose ``runtime`` is VERTICAL_RUNTIME_SUPPORTED has
    the kind DEPTH_LENGTH that metric operators ask for; ``findings`` say what stands in the way."""
    v = header.variables.get(dim)
    attributes = v.attributes if v else {}
    centres = netcdf3.values(header, dim).astype(float) if v else np.arange(1, header.dims[dim] + 1, dtype=float)
    found = links(header)
    family, unit = unit_family(attributes.get("units"))
    name, said = str(attributes.get("standard_name", "")).lower(), attributes.get("positive")
    positive = str(said).strip().lower() if str(said).strip().lower() in ("up", "down") else None
    kind, order = kind_of(family, name, positive), order_of(centres)
    conflict = name in DOWN_NAMES and positive == "up" or name in UP_NAMES and positive == "down"
    monotonic = bool(np.isfinite(centres).all()) and order in ("INCREASING", "DECREASING", "SINGLETON")
    runtime = next(status for status, holds in (
        ("VERTICAL_CONFLICT", conflict), ("VERTICAL_PARAMETRIC_DEFERRED", kind == "PARAMETRIC"),
        ("VERTICAL_INTERPRETABLE_ONLY", kind in ("PRESSURE", "HEIGHT_LENGTH", "DIMENSIONLESS_GENERIC")), ("VERTICAL_UNRESOLVED", kind != "DEPTH_LENGTH"),
        ("VERTICAL_UNIT_UNSUPPORTED", family != "LENGTH" or unit is None), ("VERTICAL_CONFLICT", positive is None or not monotonic), ("VERTICAL_RUNTIME_SUPPORTED", True)) if holds)
    bounds = bounds_of(header, dim, centres, found) if v else {"status": "BOUNDS_MISSING"}
    status = bounds["status"]
    geometry = next(x for x, holds in (
        ("GEOMETRY_METRIC_BOUNDS_SUPPORTED", runtime == "VERTICAL_RUNTIME_SUPPORTED" and status == "BOUNDS_VALID"), ("GEOMETRY_PARAMETRIC_DEFERRED", kind == "PARAMETRIC"),
        ("GEOMETRY_NON_LENGTH_VERTICAL", kind != "DEPTH_LENGTH"), ("GEOMETRY_NO_BOUNDS", status == "BOUNDS_MISSING"),
        ("GEOMETRY_UNIT_UNSUPPORTED", runtime == "VERTICAL_UNIT_UNSUPPORTED" or status == "BOUNDS_UNIT_INCOMPATIBLE"), (f"GEOMETRY_{status.removeprefix('BOUNDS_')}", True)) if holds)
    told = [code for code, holds in (
        ("VERTICAL_UNITS_MISSING", family == "MISSING"), ("VERTICAL_POSITIVE_REQUIRED", positive is None and kind not in ("PRESSURE", "PARAMETRIC")),
        ("VERTICAL_POSITIVE_INVALID", said is not None and positive is None), ("VERTICAL_STANDARD_NAME_POSITIVE_CONFLICT", conflict), ("VERTICAL_SEMANTIC_CONFLICT", conflict),
        ("VERTICAL_COORDINATE_NOT_MONOTONIC", not monotonic), (f"VERTICAL_{status}", status not in ("BOUNDS_VALID", "BOUNDS_MISSING"))) if holds]
    direction = "down" if kind == "PRESSURE" and positive is None else positive
    out = {"kind": kind if kind != "DEPTH_LENGTH" or runtime == "VERTICAL_RUNTIME_SUPPORTED" else "DEPTH_UNKNOWN", "found": kind, "family": family, "unit": unit, "positive": direction, "order": order,
           "runtime": runtime, "geometry": geometry, "bounds_status": status, "formula": formula_of(header, dim, name, found) if v else "FORMULA_TERMS_ABSENT", "findings": told,
           "scale_to_m": SCALE.get(unit), "semantics": {x: _semantics(header.variables[x].attributes, dim) for x in variables}}
    if status == "BOUNDS_VALID":
        factor = SCALE[bounds["unit"]] / SCALE[unit] if family == "LENGTH" else 1.0  # edges in the axis' unit
        out |= {"bounds": [[a * factor, b * factor] for a, b in bounds["edges"]], "contiguous": bounds["contiguous"]}
    return out
