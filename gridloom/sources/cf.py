"""Cubes from NetCDF files by their CF metadata: axes, packed values, time, and what depths mean."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, replace
from datetime import date, datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.cube import Cube, finite
from gridloom.errors import require
from gridloom.functions.calendars import CalendarTime, decode
from gridloom.operators.provenance import recorded
from gridloom.sources import netcdf3
from gridloom.sources.cf_climatology import climatology_of
from gridloom.sources.cf_links import linked_variables
from gridloom.sources.cf_vertical import unit_family, vertical_of

# Names that tell an axis where attributes do not.
KNOWN = {
    "longitude": ("lon", "longitude", "x"),
    "latitude": ("lat", "latitude", "y"),
    "depth": ("depth", "deptht", "lev", "level", "z", "zlev"),
    "time": ("time", "date", "t"),
}
STANDARD = {"longitude": ("longitude",), "latitude": ("latitude",), "depth": ("depth", "height", "altitude"), "time": ("time",)}
AXIS_LETTER = {"X": "longitude", "Y": "latitude", "Z": "depth", "T": "time"}
ROLE = {"longitude": "lon_idx", "latitude": "lat_idx", "depth": "depth_idx", "time": "time_idx"}
_SINCE = re.compile(r"\bsince\b", re.I)


def evidence(name: str, attributes: dict) -> tuple[set[str], set[str]]:
    """Axes that attributes point to, and those that the name does."""
    strong = set()
    if (letter := str(attributes.get("axis", "")).upper()) in AXIS_LETTER:
        strong.add(AXIS_LETTER[letter])
    for axis, names in STANDARD.items():
        if attributes.get("standard_name") in names:
            strong.add(axis)
    unit = str(attributes.get("units", "")).lower()
    if re.fullmatch(r"degrees?_?(east|e)", unit):
        strong.add("longitude")
    if re.fullmatch(r"degrees?_?(north|n)", unit):
        strong.add("latitude")
    if _SINCE.search(unit):
        strong.add("time")
    if str(attributes.get("positive", "")).lower() in ("up", "down") or "formula_terms" in attributes or unit_family(attributes.get("units"))[0] == "PRESSURE":
        strong.add("depth")
    return strong, {axis for axis, names in KNOWN.items() if name.lower() in names}


def resolve_axes(header: netcdf3.Header, overrides: dict[str, str] | None = None) -> dict[str, str]:
    """The dimension of each axis. Attributes come before names; ambiguity and contradiction are errors."""
    out: dict[str, str] = {}
    found = {d: evidence(d, header.variables[d].attributes if d in header.variables else {}) for d in header.dims}
    for d, (strong, _) in found.items():
        require(len(strong) <= 1, "cf_axis_conflict", f"attributes of {d} point to {', '.join(sorted(strong))}")
    for axis in KNOWN:
        if overrides and axis in overrides:
            d = overrides[axis]
            require(d in header.dims, "cf_axis_conflict", f"there is no dimension {d}")
            require(not found[d][0] or axis in found[d][0], "cf_axis_conflict", f"attributes of {d} contradict {axis}")
            out[axis] = d
            continue
        fit = [d for d, (s, _) in found.items() if axis in s] or [d for d, (s, n) in found.items() if not s and axis in n]
        require(len(fit) <= 1, "cf_axis_conflict", f"{axis} may be {', '.join(fit)}")
        if fit:
            out[axis] = fit[0]
    return out


@dataclass(frozen=True)
class FileSource:
    """The rows of a file at chosen positions. ``base`` maps the positions of a cube's axes to those of the
    file; a selection narrows it, and ``frame`` reads that and nothing else of the file's values."""

    spark: SparkSession
    path: str
    roles: dict[str, str]
    value: Column
    names: tuple[str, ...]
    base: dict[str, tuple[int, ...]]

    def taken(self, picked: dict[str, list[int]], variables: list[str] | None = None) -> "FileSource":
        base = self.base | {axis: tuple(self.base[axis][i] for i in at) for axis, at in picked.items()}
        return replace(self, base=base, names=self.names if variables is None else tuple(n for n in self.names if n in variables))

    def _read(self, **options) -> DataFrame:
        """File rows with file positions."""
        self.spark.dataSource.register(netcdf3.NetCdfSource)
        raw = (self.spark.read.format("netcdf3").option("path", self.path).option("variables", ",".join(self.names)).option("roles", ",".join(self.roles[n] for n in self.names))
               .option("pushdown", self.spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")))
        for name, value in options.items():
            raw = raw.option(name, json.dumps(value))
        return raw.load().select("lon_idx", "lat_idx", "depth_idx", "time_idx", "variable", finite(self.value).alias("value"))

    def _wanted(self, axes) -> dict:
        return {ROLE[axis]: netcdf3.in_runs(sorted(set(self.base[axis]))) for axis in axes if axis in self.base}

    def _placed(self, df: DataFrame, axes) -> DataFrame:
        """File positions to positions of the cube's axes, which may repeat."""
        for axis in axes:
            index, at = ROLE[axis], self.base.get(axis, (0,))
            if at == tuple(range(at[0], at[0] + len(at))):
                df = df.withColumn(index, F.col(index) - at[0]) if at[0] else df
            else:
                table = self.spark.createDataFrame(list(zip(at, range(len(at)))), f"{index} int, _new int")
                df = df.join(F.broadcast(table), index).drop(index).withColumnRenamed("_new", index)
        return df.select("lon_idx", "lat_idx", "depth_idx", "time_idx", "variable", "value")

    def frame(self) -> DataFrame:
        return self._placed(self._read(wanted=self._wanted(ROLE)), ROLE)

    def pairs(self, points: list[tuple[int, int]]) -> DataFrame:
        """Rows of paired longitude and latitude positions (of the cube) at the depths and times of the source:
        each point's column, not the rectangle around them."""
        lon, lat = self.base["longitude"], self.base["latitude"]
        table = self.spark.createDataFrame([(lon[x], lat[y], x, y) for x, y in sorted(set(points))], "lon_idx int, lat_idx int, _x int, _y int")
        df = self._read(wanted=self._wanted(("depth", "time")), points=sorted({(lon[x], lat[y]) for x, y in points}))
        df = df.join(F.broadcast(table), ["lon_idx", "lat_idx"]).drop("lon_idx", "lat_idx").withColumnsRenamed({"_x": "lon_idx", "_y": "lat_idx"})
        return self._placed(df, ("depth", "time"))


def cube_open(spark: SparkSession, path: str, variables: list[str] | None = None, axes: dict[str, str] | None = None) -> Cube:
    """A lazy cube of a classic NetCDF file; only the header and the axes are read now.

    Selections (``slice_cube``, ``crop``, ``extract``, ``transect``) of the cube read the bytes of their
    positions. Where the session has ``spark.sql.python.filterPushdown.enabled`` set, so do filters on the
    positions of ``df``. Sentinels (``_FillValue``, ``missing_value``) are taken out before packed values are
    scaled. Variables with and without depth do not mix.
    """
    header = netcdf3.read_header(path)
    found = resolve_axes(header, axes)
    for axis in ("longitude", "latitude", "time"):
        require(axis in found, "netcdf_schema", f"no dimension is known to be {axis}")
    helpers = linked_variables(header)
    names = variables or [v for v in header.variables if v not in header.dims and v not in helpers and {found["longitude"], found["latitude"], found["time"]} <= set(header.variables[v].dims)]
    require(bool(names), "netcdf_missing_variable", "the file has no gridded variable")
    deep = []
    for name in names:
        require(name in header.variables, "netcdf_missing_variable", f"there is no variable {name}")
        dims = header.variables[name].dims
        require({found["longitude"], found["latitude"], found["time"]} <= set(dims) <= set(found.values()), "netcdf_schema", f"{name} does not lie on longitude, latitude, time and depth alone")
        require(len(set(dims)) == len(dims), "netcdf_permutation_error", f"{name} has a dimension twice")
        deep.append(found.get("depth") in dims)
    require(len(set(deep)) == 1, "netcdf_schema", "surface and depth variables do not mix")
    axis_of = {d: a for a, d in found.items()}

    def coordinates(axis: str) -> np.ndarray:
        dim = found[axis]
        return netcdf3.values(header, dim).astype(float) if dim in header.variables else np.arange(1, header.dims[dim] + 1, dtype=float)

    time_attributes = header.variables[found["time"]].attributes if found["time"] in header.variables else {}
    times = decode(coordinates("time").tolist(), time_attributes.get("units", ""), time_attributes.get("calendar"))
    value = F.lit(None).cast("double")
    for name in names:
        a = header.variables[name].attributes
        sentinels = [float(x) for key in ("_FillValue", "missing_value") if key in a for x in np.atleast_1d(a[key])]
        own = F.col("raw") * float(a.get("scale_factor", 1.0)) + float(a.get("add_offset", 0.0))
        if sentinels:
            own = F.when(~F.col("raw").isin(sentinels), own)
        value = F.when(F.col("variable") == name, own).otherwise(value)
    meta: dict = {"units": {n: header.variables[n].attributes["units"] for n in names if "units" in header.variables[n].attributes},
                  "standard_names": {n: header.variables[n].attributes["standard_name"] for n in names if "standard_name" in header.variables[n].attributes}}
    depth: tuple = (None,)
    if deep[0]:
        depth = tuple(coordinates("depth").tolist())
        meta["vertical"] = vertical_of(header, found["depth"], names)
    if "climatology" in time_attributes:
        meta |= climatology_of(header, found["time"], names)
    roles = {n: "/".join(ROLE[axis_of[d]] for d in header.variables[n].dims) for n in names}
    base = {a: tuple(range(header.dims[d])) for a, d in found.items() if a != "depth" or deep[0]}
    source = FileSource(spark, path, roles, value, tuple(names), base)
    cube = Cube(source.frame(), tuple(coordinates("longitude").tolist()), tuple(coordinates("latitude").tolist()), depth, tuple(times), tuple(names), meta, source)
    return recorded(cube, "open", {"variables": names})


def write_nc(cube: Cube, path: str, fill: float = 9.969209968386869e36, chunk: int = 1_000_000) -> None:
    """A cube as a classic file of (longitude, latitude, depth, time) variables.

    The header and axes are written first; they say where every value goes, so tasks write the values, a
    contiguous stretch of ``chunk`` cells each, into the file, which all executors must reach by one path.
    A stretch that is written again is the same. Missing cells hold ``fill``, the variables' _FillValue."""
    require(cube.source is None or netcdf3.local(cube.source.path) != netcdf3.local(path), "netcdf_read_only", "a cube is not written over the file that it is read from")
    lon, lat, depth, time, _ = cube.shape
    surface = cube.depth == (None,)
    require(not isinstance(cube.time[0], CalendarTime), "bad_storage", "calendar times are not written")
    dims = {"lon": lon, "lat": lat, **({} if surface else {"depth": depth}), "time": time}
    axes = {"lon": (("lon",), np.array(cube.longitude), {"units": "degrees_east"}), "lat": (("lat",), np.array(cube.latitude), {"units": "degrees_north"})}
    if not surface:
        vertical = cube.meta.get("vertical") or {}
        axes["depth"] = (("depth",), np.array(cube.depth, dtype=float), {"units": vertical.get("unit") or "m", "positive": vertical.get("positive", "down")})
    seconds = [(t - datetime(1970, 1, 1)).total_seconds() if isinstance(t, datetime) else (t - date(1970, 1, 1)).days * 86400.0 for t in cube.time]
    whole = all(s % 86400 == 0 for s in seconds)
    axes["time"] = (("time",), np.array(seconds) / (86400.0 if whole else 1.0), {"units": f"{'days' if whole else 'seconds'} since 1970-01-01"})
    told = lambda v: {"_FillValue": fill} | ({"units": cube.unit(v)} if cube.unit(v) else {})
    begins = netcdf3.write(path, dims, axes | {v: (tuple(dims), np.dtype(">f8"), told(v)) for v in cube.variables})
    cells, file = lon * lat * depth * time, netcdf3.local(path)
    cell = ((F.col("lon_idx").cast("long") * lat + F.col("lat_idx")) * depth + F.col("depth_idx")) * time + F.col("time_idx")
    values = cube.df.where("value is not null").select("variable", cell.alias("cell"), "value", F.floor(cell / chunk).alias("chunk"))
    chunks = cube.spark.range(-(-cells // chunk)).select(F.col("id").alias("chunk"), F.explode(F.array(*[F.lit(v) for v in cube.variables])).alias("variable"))

    def put(key: tuple, own: pd.DataFrame, _: pd.DataFrame) -> pd.DataFrame:
        variable, at = str(key[0]), int(key[1])
        block = np.full(min(chunk, cells - at * chunk), fill, dtype=">f8")
        block[own["cell"].to_numpy(np.int64) - at * chunk] = own["value"].to_numpy(float)
        with open(file, "r+b") as f:
            f.seek(begins[variable] + 8 * at * chunk)
            f.write(block.tobytes())
        return pd.DataFrame({"n": [len(block)]})

    done = values.groupBy("variable", "chunk").cogroup(chunks.groupBy("variable", "chunk")).applyInPandas(put, "n long").agg(F.sum("n")).first()[0]
    require(done == cells * len(cube.variables), "netcdf_file_error", f"{done} of {cells * len(cube.variables)} values were written")


def read_nc(spark: SparkSession, path: str, variables: list[str] | None = None) -> Cube:
    """``cube_open``, read at once and kept by the executors."""
    return cube_open(spark, path, variables).collect()
