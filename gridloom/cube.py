"""The cube: a long Spark DataFrame of cell values, small axes on the driver, and a metadata document.

``df`` has a row for each cell with a value: lon_idx, lat_idx, depth_idx, time_idx (0-based positions
on the axes), variable, value. A cell without a row is missing, and so is a value that is not finite;
values are normalised to NULL once, on entry. Counts that the grid defines come from the axes, never
from the rows. Operators check their contract on the driver, from axes and metadata, and return a new
lazy cube or frame. Joins use integer positions only; axis tables are as small as the grid's axes,
which live on the driver, so they are broadcast.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, replace
from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.errors import require
from gridloom.functions.calendars import CalendarTime

CELL = ("lon_idx", "lat_idx", "depth_idx")
KEY = (*CELL, "time_idx", "variable")
AXES = ("longitude", "latitude", "depth", "time")
AXIS_INDEX = {"longitude": "lon_idx", "latitude": "lat_idx", "depth": "depth_idx", "time": "time_idx"}


def finite(column: Column) -> Column:
    """The value where it is finite, else NULL."""
    x = column.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def check_longitude(values: tuple[float, ...]) -> None:
    require(len(values) > 0 and all(v is not None and math.isfinite(v) for v in values), "bad_argument", "longitudes are finite and at least one")
    require(all(-180 <= v <= 180 for v in values) or all(0 <= v <= 360 for v in values), "bad_argument", "longitudes lie in [-180, 180] or in [0, 360]")


def check_latitude(values: tuple[float, ...]) -> None:
    require(len(values) > 0 and all(v is not None and math.isfinite(v) and -90 <= v <= 90 for v in values), "bad_argument", "latitudes lie in [-90, 90]")


def check_depth(values: tuple[float | None, ...]) -> None:
    require(len(values) > 0 and (values == (None,) or all(v is not None and math.isfinite(v) for v in values)), "bad_argument", "depths are finite, or exactly one is missing (a surface cube)")


def check_time(values: tuple) -> None:
    require(len(values) > 0, "bad_argument", "a cube has at least one time")
    require(len({type(v) for v in values}) == 1 and isinstance(values[0], (date, CalendarTime)), "bad_argument", "times are dates, UTC datetimes or calendar times, not mixed")
    require(all(a < b for a, b in zip(values, values[1:])), "bad_argument", "times are unique and strictly increasing")


def check_variables(values: tuple[str, ...]) -> None:
    require(len(values) > 0 and all(values) and len(set(values)) == len(values), "bad_argument", "variable names are unique and not empty")


@dataclass(frozen=True)
class Cube:
    df: DataFrame
    longitude: tuple[float, ...]
    latitude: tuple[float, ...]
    depth: tuple[float | None, ...]
    time: tuple
    variables: tuple[str, ...]
    meta: dict = field(default_factory=dict)
    #: Where the rows come from, if they can be read by position (see ``sources.cf.FileSource``).
    source: object | None = field(default=None, compare=False, repr=False)

    def __post_init__(self) -> None:
        check_longitude(self.longitude)
        check_latitude(self.latitude)
        check_depth(self.depth)
        check_time(self.time)
        check_variables(self.variables)

    # ---- construction ------------------------------------------------------------------------

    @staticmethod
    def from_table(df: DataFrame, longitude: str = "longitude", latitude: str = "latitude", depth: str | None = "depth", time: str = "time",
                   variable: str = "variable", value: str = "value", axes: dict | None = None, meta: dict | None = None, unique: bool = True) -> "Cube":
        """A cube of a long table. Axes not given in ``axes`` are the sorted distinct coordinates.

        Coordinates are matched by equality with the axis tables, which are broadcast. ``unique``
        checks that no cell has two rows (one aggregation).
        """
        given = dict(axes or {})
        names = {"longitude": longitude, "latitude": latitude, "depth": depth, "time": time, "variable": variable}
        for axis, name in names.items():
            if axis not in given:
                if name is None:
                    given[axis] = (None,)
                else:
                    found = [r[0] for r in df.select(name).distinct().collect()]  # as many rows as the axis has
                    given[axis] = tuple(sorted(found, key=lambda v: (v is not None, v)))
        out = df
        spark = df.sparkSession
        for axis, index in AXIS_INDEX.items():
            name = names[axis]
            if name is None or given[axis] == (None,):
                out = out.withColumn(index, F.lit(0))
                continue
            table = axis_table(spark, axis, given[axis]).select(F.col(index), F.col(axis).alias(f"_{axis}"))
            out = out.join(F.broadcast(table), F.col(name) == F.col(f"_{axis}")).drop(f"_{axis}")
        out = out.select(*CELL, "time_idx", F.col(variable).alias("variable"), finite(F.col(value)).alias("value"))
        if unique:
            twice = out.groupBy(*KEY).count().where("count > 1")
            require(twice.isEmpty(), "bad_cube", "a cell has more than one row")
        return Cube(out, tuple(map(float, given["longitude"])), tuple(map(float, given["latitude"])), given["depth"], given["time"], tuple(given["variable"]), dict(meta or {}))

    @staticmethod
    def from_arrays(spark: SparkSession, longitude, latitude, depth, time, variables, data, units: dict | None = None, meta: dict | None = None) -> "Cube":
        """A cube of a dense array [longitude, latitude, (depth,) time, variable]; four dimensions get one depth."""
        import numpy as np

        array = np.asarray(data, dtype=float)
        if array.ndim == 4:
            array = array[:, :, None]
        require(array.ndim == 5, "bad_argument", "data has four or five dimensions")
        depth = tuple(depth) if depth is not None else (None,) if array.shape[2] == 1 else tuple(float(i + 1) for i in range(array.shape[2]))
        variables = tuple(variables) if variables is not None else tuple(f"var{i + 1}" for i in range(array.shape[4]))
        lengths = (len(longitude), len(latitude), len(depth), len(time), len(variables))
        require(array.shape == lengths, "bad_argument", f"data has shape {array.shape}, the axes {lengths}")
        import pyarrow as pa

        where = np.nonzero(np.isfinite(array))
        columns = [pa.array(w.astype(np.int32)) for w in where[:4]] + [pa.array(np.array(variables, dtype=object)[where[4]], pa.string()), pa.array(array[where])]
        df = spark.createDataFrame(pa.table(columns, names=["lon_idx", "lat_idx", "depth_idx", "time_idx", "variable", "value"]))
        return Cube(df, tuple(map(float, longitude)), tuple(map(float, latitude)), depth, tuple(time), variables, {"units": dict(units or {})} | dict(meta or {}))

    # ---- views -------------------------------------------------------------------------------

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def shape(self) -> tuple[int, int, int, int, int]:
        return len(self.longitude), len(self.latitude), len(self.depth), len(self.time), len(self.variables)

    def axis(self, name: str) -> DataFrame:
        """The axis as a table of position and coordinate, marked for broadcast."""
        return F.broadcast(axis_table(self.spark, name, getattr(self, name)))

    def unit(self, variable: str) -> str | None:
        return self.meta.get("units", {}).get(variable)

    def cells(self) -> DataFrame:
        """Every cell of the grid, with or without a value; longitude runs fastest. Built by position
        arithmetic on a range, so it is distributed and joins nothing."""
        a, b, c, d, e = self.shape
        require(math.prod(self.shape) < 2**63, "size_overflow", "the grid has more cells than a 64-bit number tells apart")
        i = F.col("id")
        names = F.array(*[F.lit(v) for v in self.variables])
        step = lambda size, over: F.pmod(F.floor(i / F.lit(over)), F.lit(size)).cast("int")
        return self.spark.range(a * b * c * d * e).select(
            step(a, 1).alias("lon_idx"), step(b, a).alias("lat_idx"), step(c, a * b).alias("depth_idx"), step(d, a * b * c).alias("time_idx"),
            F.get(names, step(e, a * b * c * d)).alias("variable"))

    def dense(self) -> DataFrame:
        """A row for every cell, NULL where there is no value."""
        return self.cells().join(self.df, list(KEY), "left")

    def located(self, frame: DataFrame | None = None, axes: tuple[str, ...] = AXES) -> DataFrame:
        """``frame`` (the cube's rows by default) with coordinates instead of positions."""
        out = self.df if frame is None else frame
        for name in axes:
            out = out.join(self.axis(name), AXIS_INDEX[name])
        rest = [c for c in out.columns if c not in AXIS_INDEX.values() and c not in axes]
        return out.select(*axes, *rest)

    def table(self, dense: bool = False) -> DataFrame:
        """longitude, latitude, depth, time, variable, value."""
        return self.located(self.dense() if dense else self.df)

    def with_(self, **changes) -> "Cube":
        """A changed copy. Other rows have another origin, so ``source`` goes with ``df`` unless it is given."""
        return replace(self, **({"source": None} if "df" in changes else {}) | changes)

    def collect(self) -> "Cube":
        """The same cube, computed once and kept by the executors (spilling to disk)."""
        return self.with_(df=self.df.persist())

    def to_numpy(self):
        """A dense array; for small cubes only (refused beyond ten million cells)."""
        import numpy as np

        require(math.prod(self.shape) <= 10_000_000, "collect_error", "the cube is too large for one array")
        out = np.full(self.shape, np.nan)
        names = F.array_position(F.array(*[F.lit(v) for v in self.variables]), F.col("variable")).cast("int") - 1
        rows = self.df.where("value is not null").select(*CELL, "time_idx", names.alias("variable"), "value").toArrow()
        out[tuple(rows.column(k).to_numpy() for k in range(5))] = rows.column(5).to_numpy()
        return out

    # ---- storage -----------------------------------------------------------------------------

    def write(self, path: str) -> None:
        """Parquet, partitioned by variable and sorted by place (for row-group pruning), with the axes and
        metadata as a one-row JSON table beside it."""
        kind = {date: "date", datetime: "datetime", CalendarTime: "calendar"}[type(self.time[0])]
        times = [[t.seconds, t.calendar] if kind == "calendar" else t.isoformat() for t in self.time]
        document = json.dumps({"longitude": self.longitude, "latitude": self.latitude, "depth": self.depth, "time_kind": kind, "time": times, "variables": self.variables, "meta": self.meta})
        (self.df.repartition("variable", "lat_idx", "lon_idx").sortWithinPartitions("variable", "lat_idx", "lon_idx", "depth_idx", "time_idx")
         .write.mode("overwrite").partitionBy("variable").parquet(f"{path}/cells"))
        self.spark.createDataFrame([(document,)], "document string").coalesce(1).write.mode("overwrite").parquet(f"{path}/document")

    @staticmethod
    def read(spark: SparkSession, path: str) -> "Cube":
        d = json.loads(spark.read.parquet(f"{path}/document").first()[0])
        make = {"date": date.fromisoformat, "datetime": datetime.fromisoformat, "calendar": lambda t: CalendarTime(*t)}[d["time_kind"]]
        schema = "lon_idx int, lat_idx int, depth_idx int, time_idx int, value double, variable string"
        df = spark.read.schema(schema).parquet(f"{path}/cells").select(*KEY, "value")
        return Cube(df, tuple(d["longitude"]), tuple(d["latitude"]), tuple(d["depth"]), tuple(map(make, d["time"])), tuple(d["variables"]), d["meta"])


def utc(value):
    """A time for an axis: aware datetimes become naive UTC, dates and calendar times stay."""
    return value.astimezone(timezone.utc).replace(tzinfo=None) if isinstance(value, datetime) and value.tzinfo else value


def axis_table(spark: SparkSession, name: str, values: tuple) -> DataFrame:
    """Position and coordinate of every axis value."""
    if name == "time":
        kind = "date" if type(values[0]) is date else "timestamp_ntz" if isinstance(values[0], datetime) else "struct<seconds:double,calendar:string>"
        rows = [(i, (v.seconds, v.calendar) if isinstance(v, CalendarTime) else v) for i, v in enumerate(values)]
    else:
        kind, rows = "double", list(enumerate(values))
    schema = T.StructType.fromDDL(f"{AXIS_INDEX[name]} int, {name} {kind}")
    return spark.createDataFrame(rows, schema)
