"""Registered queries of the grid library over the test tables, and the SQL each is checked against."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from datetime import date

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.cube import Cube
from gridloom.errors import require
from gridloom.functions import seawater
from gridloom.operators import checks, diagnostics, geometry, path, physics, select, temporal, vertical
from gridloom.plans import plotdata
from gridloom.plans.driver_cubes import daily_price, order_surface, point_profiles
from gridloom.sources import cf, netcdf3
from gridloom.streaming.windows import ROCKS, stream_aggregate

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TEMPERATURE = {"extendedprice": {"standard_name": "sea_water_temperature", "unit": "degC"}}
OXYGEN = {"extendedprice": {"standard_name": "moles_of_oxygen_per_unit_mass_in_sea_water", "unit": "umol kg-1"}}
DENSITY = {"extendedprice": {"standard_name": "sea_water_potential_density", "unit": "kg m-3"}}
SALINITY = {"extendedprice": {"standard_name": "sea_water_practical_salinity", "unit": "1"}}
DAYS, LOW, HIGH = ("1996-03-01", "1997-08-15"), date(1996, 1, 1), date(1999, 12, 31)
SQUARE = [{"id": "a", "rings": [[(-79.6, -11.6), (-77.2, -11.6), (-77.2, -10.9), (-79.6, -10.9)]]}, {"id": "b", "rings": [[(-80.2, -12.3), (-78.4, -12.3), (-78.4, -11.7), (-80.2, -11.7)]]}]
COAST = [{"id": "c", "rings": [[(-82.0, -14.0), (-81.0, -14.0), (-81.0, -9.0), (-82.0, -9.0)]]}]
ROUTE = [{"longitude": -79.8, "latitude": -11.9}, {"longitude": -79.1, "latitude": -11.4}, {"longitude": -77.6, "latitude": -11.8}, {"longitude": -76.2, "latitude": -11.1}]

# Rows of a view as SQL: lines averaged by cell, the whole grid, and depth levels.
RAW = """WITH raw AS (SELECT CAST(l_suppkey % 5 AS INTEGER) x, CAST(CAST(floor(l_suppkey / 5.0) AS BIGINT) % 2 AS INTEGER) y, CAST(l_linenumber - 1 AS INTEGER) d,
    CAST(l_shipdate AS DATE) t, l_quantity q, l_extendedprice p, l_discount r, l_tax a FROM lineitem),
c AS (SELECT x, y, d, t, avg(p) v FROM raw GROUP BY 1, 2, 3, 4),
days AS (SELECT DISTINCT t FROM raw),
mc AS (SELECT x, y, d, CAST(date_trunc('month', t) AS DATE) t, avg(p) v FROM raw GROUP BY 1, 2, 3, 4),
months AS (SELECT DISTINCT CAST(date_trunc('month', t) AS DATE) t FROM raw),
place AS (SELECT x.range x, y.range y FROM range(5) x, range(2) y),
grid AS (SELECT x, y, d.range d FROM place, range(7) d)"""
AT = "CAST(-80 + {0}x AS DOUBLE) longitude, CAST(-12 + {0}y AS DOUBLE) latitude, CAST(10 * {0}d + 5 AS DOUBLE) depth"
XY = "CAST(-80 + {0}x AS DOUBLE) longitude, CAST(-12 + {0}y AS DOUBLE) latitude"


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def rounded(frame: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    for c in columns:
        frame = frame.withColumn(c, F.round(c, digits))
    return frame


def _daily(spark: SparkSession, sf: str) -> Cube:
    return daily_price(spark, sf)


# ---- construction, inspection --------------------------------------------------------------------


@query("inspect_missing", RAW + """
SELECT 'extendedprice' AS variable, CAST(70 * (SELECT count(*) FROM days) AS BIGINT) n_cells, count(v) n_valid, CAST(70 * (SELECT count(*) FROM days) - count(v) AS BIGINT) n_missing FROM c""")
def _missing(spark, sf):
    return checks.missing(_daily(spark, sf))


@query("inspect_axes", RAW + """
SELECT 'longitude' axis, 5 n, 1.0::DOUBLE min_spacing, 1.0::DOUBLE max_spacing UNION ALL SELECT 'latitude', 2, 1.0::DOUBLE, 1.0::DOUBLE UNION ALL SELECT 'depth', 7, 10.0::DOUBLE, 10.0::DOUBLE
UNION ALL SELECT 'time', CAST((SELECT count(*) FROM days) AS INTEGER), min(s), max(s) FROM (SELECT CAST(date_diff('second', lag(t) OVER (ORDER BY t), t) AS DOUBLE) s FROM days)""")
def _axes(spark, sf):
    return checks.inspect(_daily(spark, sf)).select("axis", "n", "min_spacing", "max_spacing")


@query("validate", RAW + """
SELECT CAST(count(*) AS BIGINT) n_failed FROM (SELECT x, y, d, t FROM c GROUP BY 1, 2, 3, 4 HAVING count(*) > 1)""")
def _validate(spark, sf):
    return checks.validate(_daily(spark, sf), strict=True).agg(F.count_if(F.col("status") == "FAIL").alias("n_failed"))


@query("from_table", RAW + ", s AS (SELECT x, y, d, t, avg(q) v FROM raw WHERE t < DATE '1996-01-01' GROUP BY 1, 2, 3, 4) SELECT " + AT.format("") + ", t AS time, v AS value FROM s")
def _from_table(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").where(F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz"))
    long = lines.select((F.col("l_suppkey") % 5 - 80).cast("double").alias("longitude"), (F.pmod(F.floor(F.col("l_suppkey") / 5), F.lit(2)) - 12).cast("double").alias("latitude"),
                        (F.col("l_linenumber") * 10 - 5).cast("double").alias("depth"), F.to_date("l_shipdate").alias("time"), "l_quantity")
    long = long.groupBy("longitude", "latitude", "depth", "time").agg(F.avg("l_quantity").alias("value")).withColumn("variable", F.lit("quantity"))
    return Cube.from_table(long, axes={"variable": ("quantity",)}).table().drop("variable")


# ---- storage, files, provenance ------------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors see: below ``spark.checkpoint.dir``, or local where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        require(spark.sparkContext.master.startswith("local["), "bad_storage", "set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}"
    return f"{root.rstrip('/')}/gridloom-grid-{uuid.uuid4().hex}"


_ALL = RAW + " SELECT " + AT.format("c.") + ", c.t AS time, round(v, 6) AS value FROM c"


@query("write_read", _ALL)
def _stored(spark, sf):
    path = _folder(spark)
    _daily(spark, sf).write(path)
    return rounded(Cube.read(spark, path).table().drop("variable"), "value")


@query("write_read_crop", _ALL + " WHERE x BETWEEN 1 AND 3 AND y = 1 AND d BETWEEN 1 AND 4")
def _stored_crop(spark, sf):
    path = _folder(spark)
    _daily(spark, sf).write(path)
    return rounded(select.crop(Cube.read(spark, path), longitude=(-79.2, -76.9), latitude=(-11.4, -10.8), depth=(10, 50), outside="clip").table().drop("variable"), "value")


_FILE = RAW + " SELECT " + AT.format("mc.") + ", mc.t AS time, round(v, 6) AS value FROM mc WHERE v IS NOT NULL"


def _file(spark: SparkSession, sf: str) -> str:
    """The monthly cube as a classic NetCDF file in a folder that executors see, written by tasks."""
    path = f"{netcdf3.local(_folder(spark))}.nc"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    cf.write_nc(daily_price(spark, sf, monthly=True), path)
    return path


@query("cube_open", _FILE)
def _opened(spark, sf):
    return rounded(cf.cube_open(spark, _file(spark, sf)).table().drop("variable").where("value is not null"), "value")


@query("cube_open_crop", _FILE + " AND x BETWEEN 1 AND 3 AND y = 1 AND d = 2")
def _opened_crop(spark, sf):
    crop = select.crop(cf.cube_open(spark, _file(spark, sf)), longitude=(-79.2, -76.9), latitude=(-11.4, -10.8), depth=(20, 30), outside="clip")
    return rounded(crop.table().drop("variable").where("value is not null"), "value")


@query("netcdf_filter", RAW + " SELECT CAST(x AS INTEGER) lon_idx, CAST(y AS INTEGER) lat_idx, CAST(d AS INTEGER) depth_idx, dense_rank() OVER (ORDER BY t) - 1 AS time_idx, round(v, 6) AS value FROM mc QUALIFY x IN (0, 3) AND y = 1 AND d < 2 AND v IS NOT NULL")
def _filtered(spark, sf):
    """Filters on positions of a file's rows, pushed to the read by Spark."""
    own = spark.newSession()
    own.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = cf.cube_open(own, _file(spark, sf)).df.where("lon_idx in (0, 3) and lat_idx = 1 and depth_idx < 2 and value is not null")
    return rounded(rows.select("lon_idx", "lat_idx", "depth_idx", F.col("time_idx").cast("long").alias("time_idx"), "value"), "value")


@query("netcdf_points", RAW + """, p(k, x, y) AS (VALUES (1, 0, 0), (2, 1, 1), (3, 2, 0), (4, 4, 1))
SELECT k AS point_order, CAST(10 * mc.d + 5 AS DOUBLE) depth, round(mc.v, 6) AS value FROM p LEFT JOIN mc ON mc.x = p.x AND mc.y = p.y AND mc.t = (SELECT min(t) FROM months) AND mc.d IN (1, 3) WHERE mc.v IS NOT NULL""")
def _points(spark, sf):
    """A transect of a file: the columns of its points are read, not the rectangle around them."""
    cube = cf.cube_open(spark, _file(spark, sf))
    out = path.transect(cube, ROUTE, cube.time[0], depth=[15.0, 35.0])
    return rounded(out.where("value is not null").select("point_order", "depth", "value"), "value")


@query("read_nc", _FILE)
def _read_nc(spark, sf):
    return rounded(cf.read_nc(spark, _file(spark, sf), ["extendedprice"]).table().drop("variable").where("value is not null"), "value")


@query("cube_collect", _ALL)
def _collected(spark, sf):
    return rounded(_daily(spark, sf).collect().table().drop("variable"), "value")


@query("provenance", RAW + """, s AS (SELECT x, y, d, CAST(date_trunc('month', t) AS DATE) t, avg(v) v FROM c WHERE x IN (1, 2, 3) GROUP BY 1, 2, 3, 4)
SELECT 1::BIGINT AS step, 'crop' AS operation, (SELECT count(v) FROM c WHERE x IN (1, 2, 3)) AS n_values UNION ALL SELECT 2, 'aggregate_time', (SELECT count(v) FROM s)
UNION ALL SELECT 3, 'mask', (SELECT count(v) FROM s WHERE x IN (1, 2) AND y = 1 OR x = 1 AND y = 0)""")
def _provenance(spark, sf):
    """What was done to the values, and how many were left after each step."""
    crop = select.crop(_daily(spark, sf), longitude=(-79.2, -76.9))
    month = temporal.aggregate_time(crop, "month")[0]
    steps = [crop, month, geometry.mask(month, SQUARE)]
    told = steps[-1].meta["provenance"]["operations"]
    counts = [c.df.agg(F.lit(k).cast("long").alias("step"), F.lit(o["operation"]).alias("operation"), F.count("value").alias("n_values")) for k, (o, c) in enumerate(zip(told, steps), 1)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


# ---- streams -------------------------------------------------------------------------------------

_STREAM = """SELECT l_returnflag AS flag, CAST(date_trunc('{0}', l_shipdate) AS DATE) AS time, round(avg(l_quantity), 6) AS value, count(l_quantity) AS n_valid FROM lineitem
GROUP BY 1, 2 HAVING date_trunc('{0}', min(l_shipdate)) + INTERVAL 1 {0} <= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 1 DAY"""


def _streamed(spark: SparkSession, sf: str, by: str) -> DataFrame:
    """The lines as a stream, reduced by period, once all that there is has come: periods that the watermark
    (a day behind the latest line) has closed."""
    own, folder = spark.newSession(), _folder(spark)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    lines = own.readStream.schema(spark.read.parquet(f"{sf}/lineitem.parquet").schema).parquet(f"{sf}/lineitem*.parquet")
    lines = lines.select(F.col("l_returnflag").alias("flag"), F.col("l_shipdate").cast("timestamp").alias("time"), F.col("l_quantity").cast("double").alias("value"))
    out = stream_aggregate(lines, by, ["flag"], "mean")
    query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = own.read.schema(out.schema).parquet(f"{folder}/out")
    return rounded(rows.withColumn("time", F.to_date("time")), "value")


@query("stream_day", _STREAM.format("day"))
def _stream_day(spark, sf):
    return _streamed(spark, sf, "day")


@query("stream_month", _STREAM.format("month"))
def _stream_month(spark, sf):
    return _streamed(spark, sf, "month")


# ---- selection -----------------------------------------------------------------------------------

_SEL = RAW + " SELECT " + AT.format("c.") + ", c.t AS time, round(v, 6) AS value FROM c WHERE "


@query("slice_exact", _SEL + "x IN (1, 3) AND y = 1 AND d IN (0, 4)")
def _slice(spark, sf):
    return rounded(select.slice_cube(_daily(spark, sf), longitude=[-79.0, -77.0], latitude=-11.0, depth=[5.0, 45.0]).table().drop("variable"), "value")


@query("slice_nearest", _SEL + "x = 2 AND y = 0 AND d = 1")
def _nearest(spark, sf):
    return rounded(select.slice_cube(_daily(spark, sf), longitude=-77.7, latitude=-11.5, depth=18.0, match="nearest", tolerance={"depth": 3.0}).table().drop("variable"), "value")


@query("slice_index", _SEL + "x = 0 AND d = 6")
def _index(spark, sf):
    return rounded(select.slice_cube(_daily(spark, sf), longitude=1, depth=7, by="index").table().drop("variable"), "value")


@query("crop", _SEL + "x BETWEEN 1 AND 3 AND y = 1 AND d BETWEEN 1 AND 4 AND c.t BETWEEN DATE '1996-03-01' AND DATE '1997-08-15'")
def _crop(spark, sf):
    return rounded(select.crop(_daily(spark, sf), longitude=(-79.2, -76.9), latitude=(-11.4, -10.8), depth=(10, 50), time=DAYS, outside="clip").table().drop("variable"), "value")


@query("crop_bbox", _SEL + "x IN (1, 2) AND y = 0")
def _bbox(spark, sf):
    return rounded(select.crop(_daily(spark, sf), bbox={"xmin": -79, "xmax": -78, "ymin": -12, "ymax": -11.5}).table().drop("variable"), "value")


@query("extract_long", RAW + " SELECT " + AT.format("g.") + """, days.t AS time, 'extendedprice' AS variable, 'usd' AS unit, round(c.v, 6) AS value, CAST(g.x + 1 AS INTEGER) longitude_index
FROM (SELECT * FROM grid WHERE y = 1 AND d IN (0, 2)) g CROSS JOIN days LEFT JOIN c ON c.x = g.x AND c.y = g.y AND c.d = g.d AND c.t = days.t""")
def _long(spark, sf):
    out = select.extract(_daily(spark, sf), latitude=-11.0, depth=[5.0, 25.0], keep_index=True)
    return rounded(out, "value").drop("latitude_index", "depth_index", "time_index")


@query("extract_wide", RAW + ", w AS (SELECT x, y, d, t, round(avg(q), 6) quantity, round(avg(p), 6) extendedprice FROM raw GROUP BY 1, 2, 3, 4) SELECT " + AT.format("g.") + """, days.t AS time, w.quantity, w.extendedprice
FROM (SELECT * FROM grid WHERE x = 2 AND y = 0) g CROSS JOIN days LEFT JOIN w ON w.x = g.x AND w.y = g.y AND w.d = g.d AND w.t = days.t""")
def _wide(spark, sf):
    return rounded(select.extract(daily_price(spark, sf, ("quantity", "extendedprice")), longitude=-78.0, latitude=-12.0, form="wide"), "quantity", "extendedprice")


@query("extract_series", RAW + " SELECT days.t AS time, round(c.v, 6) AS value FROM days LEFT JOIN c ON c.t = days.t AND x = 3 AND y = 1 AND d = 5")
def _series(spark, sf):
    return rounded(select.extract(_daily(spark, sf), longitude=-77.0, latitude=-11.0, depth=55.0, mode="series").select("time", "value"), "value")


# ---- time ----------------------------------------------------------------------------------------

_START = {"day": "t", "week": "CAST(date_trunc('week', t) AS DATE)", "month": "CAST(date_trunc('month', t) AS DATE)", "year": "CAST(date_trunc('year', t) AS DATE)",
          "season": "CAST(date_trunc('month', t) - to_months(CAST(month(t) % 3 AS INTEGER)) AS DATE)"}
_STEP = {"day": "1 DAY", "week": "7 DAY", "month": "1 MONTH", "season": "3 MONTH", "year": "1 YEAR"}


def _aggregated(by: str, method: str):
    sql = RAW + f""", a AS (SELECT x, y, d, {_START[by]} p, {'avg' if method == 'mean' else method}(v) v, count(v) n FROM c GROUP BY 1, 2, 3, 4),
e AS (SELECT min({_START[by]}) lo, max({_START[by]}) hi FROM days),
ps AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL {_STEP[by]})) AS DATE) p FROM e),
tot AS (SELECT {_START[by]} p, count(*) n_total FROM days GROUP BY 1)
SELECT {AT.format('g.')}, ps.p AS time, round(a.v, 6) AS value, a.n AS n_valid, round(a.n / tot.n_total, 6) AS coverage_fraction
FROM grid g CROSS JOIN ps LEFT JOIN a ON a.x = g.x AND a.y = g.y AND a.d = g.d AND a.p = ps.p LEFT JOIN tot ON tot.p = ps.p"""

    def run(spark, sf):
        cube, told = temporal.aggregate_time(_daily(spark, sf), by, method)
        keys = ["lon_idx", "lat_idx", "depth_idx", "time_idx", "variable"]
        full = cube.dense().join(told.select(*keys, "n_valid", "coverage_fraction"), keys, "left").drop("variable")
        return rounded(cube.located(full), "value", "coverage_fraction")

    query(f"agg_{by}_{method}", sql)(run)


for _by, _method in (("day", "mean"), ("week", "mean"), ("week", "max"), ("month", "mean"), ("month", "sum"), ("month", "median"), ("season", "mean"), ("season", "min"), ("year", "mean"), ("year", "median")):
    _aggregated(_by, _method)


@query("agg_min_n", RAW + ", a AS (SELECT x, y, d, CAST(date_trunc('month', t) AS DATE) p, avg(v) v, count(v) n FROM c GROUP BY 1, 2, 3, 4) SELECT " + AT.format("") + ", p AS time, round(v, 6) AS value FROM a WHERE n >= 8")
def _min_n(spark, sf):
    cube, _ = temporal.aggregate_time(_daily(spark, sf), "month", "mean", min_n=8)
    return rounded(cube.table().where("value is not null").drop("variable"), "value")


def _climatology_sql(by: str, leap: str = "feb28", low: str = "(SELECT min(t) FROM days)", high: str = "(SELECT max(t) FROM days)") -> str:
    leap_day = "(month(t) = 2 AND day(t) = 29)"
    doy = f"CAST(dayofyear(make_date({2000 if leap == 'keep' else 2001}, month(t), {'day(t)' if leap == 'keep' else f'CASE WHEN {leap_day} THEN 28 ELSE day(t) END'})) AS INTEGER)"
    group = {"month": "CAST(month(t) AS INTEGER)", "season": "CAST(floor(month(t) % 12 / 3) AS INTEGER) + 1", "day": doy}[by]
    replicate = "year(t) + CASE WHEN month(t) = 12 THEN 1 ELSE 0 END" if by == "season" else "year(t)"
    component = "t" if by == "day" else "0"
    size = {"month": 12, "season": 4, "day": 366 if leap == "keep" else 365}[by]
    where = f"t BETWEEN {low} AND {high}" + (f" AND NOT {leap_day}" if by == "day" and leap == "drop" else "")
    return f""", k AS (SELECT x, y, d, {group} g, {replicate} r, {component} m, v FROM c WHERE {where}),
k1 AS (SELECT x, y, d, g, r, m, avg(v) v FROM k GROUP BY ALL), k2 AS (SELECT x, y, d, g, r, avg(v) v FROM k1 GROUP BY ALL),
cl AS (SELECT x, y, d, g, avg(v) mean, stddev_samp(v) sd, count(v) n FROM k2 GROUP BY ALL),
cal AS (SELECT CAST(unnest(generate_series(greatest({low}, (SELECT min(t) FROM days)), least({high}, (SELECT max(t) FROM days)), INTERVAL 1 DAY)) AS DATE) t),
off AS (SELECT {group} g, count(DISTINCT {replicate}) n FROM cal WHERE {where} GROUP BY 1), cyc AS (SELECT CAST(range AS INTEGER) g FROM range(1, {size + 1}))"""


def _climatology(name: str, by: str, leap: str = "feb28", period=None, make=None):
    bounds = {} if period is None else {"low": f"DATE '{period[0]}'", "high": f"DATE '{period[1]}'"}
    sql = RAW + _climatology_sql(by, leap, **bounds) + f"""
SELECT {AT.format('p.')}, cyc.g AS group_key, round(cl.mean, 6) AS mean, round(cl.sd, 6) AS sd, coalesce(cl.n, 0) AS n_valid, round(coalesce(cl.n, 0) / off.n, 6) AS coverage
FROM grid p CROSS JOIN cyc LEFT JOIN cl ON cl.x = p.x AND cl.y = p.y AND cl.d = p.d AND cl.g = cyc.g LEFT JOIN off ON off.g = cyc.g"""

    def run(spark, sf):
        clim = make(_daily(spark, sf)) if make else temporal.climatology(_daily(spark, sf), by, period, leap)
        cube = clim.means()
        rows = clim.df.select("lon_idx", "lat_idx", "depth_idx", (F.col("group_key") - 1).cast("int").alias("time_idx"), "variable", "mean", "sd", "n_valid")
        full = cube.cells().join(rows, ["lon_idx", "lat_idx", "depth_idx", "time_idx", "variable"], "left")
        total = F.get(F.array(*[F.lit(n) for n in clim.totals]), F.col("time_idx"))
        full = full.withColumn("group_key", F.col("time_idx") + 1).withColumn("n_valid", F.coalesce("n_valid", F.lit(0).cast("long"))).withColumn("coverage", F.when(total > 0, F.col("n_valid") / total))
        return rounded(cube.located(full.drop("time_idx", "variable"), ("longitude", "latitude", "depth")), "mean", "sd", "coverage")

    query(name, sql)(run)


_climatology("climatology_month", "month")
_climatology("climatology_season", "season")
_climatology("climatology_day_feb28", "day", "feb28")
_climatology("climatology_day_drop", "day", "drop")
_climatology("climatology_day_keep", "day", "keep")
_climatology("climatology_period", "month", period=(LOW, HIGH))
_climatology("clim_day", "day", make=temporal.clim_day)
_climatology("clim_month", "month", make=temporal.clim_month)


def _anomaly(name: str, kind: str, by: str = "month", leap: str = "feb28", expression: str | None = None, absolute: bool = False, make=None):
    group = {"month": "month(c.t)", "season": "CAST(floor(month(c.t) % 12 / 3) AS INTEGER) + 1", "day": f"dayofyear(make_date(2001, month(c.t), CASE WHEN month(c.t) = 2 AND day(c.t) = 29 THEN 28 ELSE day(c.t) END))"}[by]
    value = expression or ("c.v - cl.mean" if kind == "difference" else "CASE WHEN cl.sd > 0 THEN (c.v - cl.mean) / cl.sd END")
    sql = RAW + _climatology_sql(by, leap) + f" SELECT {AT.format('c.')}, c.t AS time, round({value}, 6) AS value FROM c JOIN cl ON cl.x = c.x AND cl.y = c.y AND cl.d = c.d AND cl.g = {group}"

    def run(spark, sf):
        cube = _daily(spark, sf)
        clim = temporal.climatology(cube, by, leap=leap)
        out = make(cube, clim) if make else temporal.signal_noise(cube, clim) if absolute else temporal.anomaly(cube, clim, kind)
        return rounded(out.table().drop("variable"), "value")

    query(name, sql)(run)


_anomaly("anomaly_diff", "difference")
_anomaly("anomaly_z", "z")
_anomaly("anomaly_season_z", "z", "season")
_anomaly("anom_diff", "difference", make=temporal.anom_diff)
_anomaly("anom_z", "z", make=temporal.anom_z)
_anomaly("anomaly_day_diff", "difference", "day")
_anomaly("signal_noise", "z", expression="CASE WHEN cl.sd > 0 THEN abs((c.v - cl.mean) / cl.sd) END", absolute=True)


@query("anomaly_counts", RAW + _climatology_sql("month") + """
SELECT CAST(70 * (SELECT count(*) FROM days) AS BIGINT) source_values, count(c.v) finite_source, count(*) FILTER (WHERE cl.sd = 0) zero_sd, CAST(0 AS BIGINT) missing_mean,
count(*) FILTER (WHERE cl.sd > 0) output_finite FROM c JOIN cl ON cl.x = c.x AND cl.y = c.y AND cl.d = c.d AND cl.g = month(c.t)""")
def _counts(spark, sf):
    cube = _daily(spark, sf)
    clim = temporal.climatology(cube, "month")
    return temporal.anomaly_counts(cube, clim, temporal.anomaly(cube, clim, "z")).withColumn("source_values", F.col("source_values").cast("long"))


@query("trend", RAW + """, m AS (SELECT CAST(floor((epoch(min(t)) + epoch(max(t))) / 2 / 86400) * 86400 AS DOUBLE) a FROM days),
e AS (SELECT x, y, d, v, (epoch(t) - m.a) / 31556952.0 s FROM c, m),
f AS (SELECT x, y, d, count(v) n, max(s) - min(s) span, regr_sxx(v, s) sxx, regr_sxy(v, s) sxy, regr_syy(v, s) syy, avg(s) ms, avg(v) mv FROM e GROUP BY 1, 2, 3)
SELECT """ + AT.format("") + """, n AS n_valid, round(span, 6) AS time_span, round(CASE WHEN n >= 3 AND sxx > 0 THEN sxy / sxx END, 4) AS slope, round(CASE WHEN n >= 3 AND sxx > 0 THEN mv - sxy / sxx * ms END, 4) AS intercept,
round(CASE WHEN n >= 3 AND sxx > 0 AND syy > 0 THEN least(1.0, greatest(0.0, sxy * sxy / sxx / syy)) END, 6) AS r2,
round(CASE WHEN n >= 3 AND sxx > 0 THEN sqrt(greatest(0.0, syy - sxy * sxy / sxx) / (n - 2)) END, 4) AS residual_sd FROM f""")
def _trend(spark, sf):
    cube, told = temporal.trend(_daily(spark, sf))
    out = rounded(cube.located(told.drop("variable"), ("longitude", "latitude", "depth")), "time_span", "r2")
    return rounded(out, "slope", "intercept", "residual_sd", digits=4)


@query("annual_index", RAW + """ SELECT CAST(year(t) AS INTEGER) AS year, 'extendedprice' AS var, CAST(10 * d + 5 AS DOUBLE) depth, count(v) n, round(avg(v), 6) mean_value, round(median(v), 6) median_value, round(stddev_samp(v), 6) sd_value,
round(min(v), 6) min_value, round(max(v), 6) max_value, round(quantile_cont(v, 0.1), 6) p10, round(quantile_cont(v, 0.9), 6) p90, round(avg(CASE WHEN v > 30000 THEN 1.0 ELSE 0.0 END), 6) frac_positive,
round(avg(CASE WHEN v < 20000 THEN 1.0 ELSE 0.0 END), 6) frac_negative FROM c GROUP BY 1, 2, 3""")
def _annual(spark, sf):
    out = temporal.annual_index(_daily(spark, sf), 30000.0, 20000.0).drop("threshold_pos", "threshold_neg")
    return rounded(out, *[c for c in out.columns if c not in ("year", "var", "depth", "n")])


@query("to_month_custom", RAW + ", a AS (SELECT x, y, d, CAST(date_trunc('month', t) AS DATE) p, max(v) - min(v) v FROM c GROUP BY 1, 2, 3, 4) SELECT " + AT.format("") + ", p AS time, round(v, 6) AS value FROM a")
def _custom(spark, sf):
    return rounded(temporal.to_month(_daily(spark, sf), lambda v: v.max() - v.min()).table().drop("variable"), "value")


@query("surface_anomaly", """WITH raw AS (SELECT CAST(c_nationkey % 5 AS INTEGER) x, CAST(floor(c_nationkey / 5.0) AS INTEGER) y, CAST(o_orderdate AS DATE) t, o_totalprice p FROM orders JOIN customer ON c_custkey = o_custkey),
c AS (SELECT x, y, t, avg(p) v FROM raw GROUP BY 1, 2, 3), m AS (SELECT x, y, month(t) g, year(t) r, avg(v) v FROM c GROUP BY 1, 2, 3, 4), k AS (SELECT x, y, g, avg(v) mean FROM m GROUP BY 1, 2, 3)
SELECT CAST(c.x AS DOUBLE) longitude, CAST(c.y AS DOUBLE) latitude, c.t AS time, round(c.v - k.mean, 6) AS value FROM c JOIN k ON k.x = c.x AND k.y = c.y AND k.g = month(c.t)""")
def _surface(spark, sf):
    cube = order_surface(spark, sf)
    return rounded(temporal.anomaly(cube, temporal.clim_month(cube)).table().select("longitude", "latitude", "time", "value"), "value")


# ---- depth ---------------------------------------------------------------------------------------

_LAYERS = "(VALUES (0, 0, 10.0), (0, 1, 10.0), (0, 2, 10.0), (1, 3, 10.0), (1, 4, 10.0), (1, 5, 10.0), (1, 6, 10.0)) w(k, d, w)"
_MID = "CASE k WHEN 0 THEN 15.0::DOUBLE ELSE 50.0::DOUBLE END"


@query("layer_mean", RAW + f" SELECT {XY.format('mc.')}, {_MID} depth, mc.t AS time, round(sum(v * w) / sum(w), 6) AS value FROM mc JOIN {_LAYERS} ON w.d = mc.d GROUP BY 1, 2, 3, 4")
def _layer(spark, sf):
    return rounded(vertical.layer_mean(daily_price(spark, sf, monthly=True), [0, 30, 70]).table().drop("variable"), "value")


@query("layer_integral", RAW + f" SELECT {XY.format('mc.')}, {_MID} depth, mc.t AS time, round(CASE WHEN count(v) = CASE k WHEN 0 THEN 3 ELSE 4 END THEN sum(v * w) END, 4) AS value FROM mc JOIN {_LAYERS} ON w.d = mc.d GROUP BY 1, 2, 3, 4, k")
def _integral(spark, sf):
    return rounded(vertical.layer_integral(daily_price(spark, sf, monthly=True), [0, 30, 70]).table().drop("variable"), "value", digits=4)


@query("depth_sample_linear", RAW + " SELECT " + XY.format("a.") + """, CAST(tg.z AS DOUBLE) depth, a.t AS time, round(a.v + tg.w * (b.v - a.v), 6) AS value
FROM (VALUES (12.0, 0, 0.7::DOUBLE), (40.0, 3, 0.5::DOUBLE), (61.0, 5, 0.6::DOUBLE)) tg(z, d, w) JOIN mc a ON a.d = tg.d JOIN mc b ON b.x = a.x AND b.y = a.y AND b.t = a.t AND b.d = a.d + 1""")
def _linear(spark, sf):
    return rounded(vertical.depth_sample(point_profiles(spark, sf), [12.0, 40.0, 61.0]).table().drop("variable"), "value")


@query("depth_sample_cell", RAW + " SELECT " + XY.format("a.") + ", CAST(tg.z AS DOUBLE) depth, a.t AS time, round(a.v, 6) AS value FROM (VALUES (12.0, 1), (38.0, 3), (61.0, 6)) tg(z, d) JOIN mc a ON a.d = tg.d")
def _cell(spark, sf):
    return rounded(vertical.depth_sample(daily_price(spark, sf, monthly=True), [12.0, 38.0, 61.0]).table().drop("variable"), "value")


GRAD = RAW + ", gr AS (SELECT a.x, a.y, a.d, a.t, (b.v - a.v) / 10 g FROM mc a JOIN mc b ON b.x = a.x AND b.y = a.y AND b.t = a.t AND b.d = a.d + 1)"


@query("depth_gradient", GRAD + " SELECT " + XY.format("") + ", CAST(10 * d + 10 AS DOUBLE) depth, t AS time, round(g, 6) AS value FROM gr")
def _gradient(spark, sf):
    return rounded(vertical.depth_gradient(daily_price(spark, sf, monthly=True)).table().drop("variable"), "value")


def _feature_sql(score: str, flat: str, extra: str = "", status: str | None = None) -> str:
    return GRAD + f""", pr AS (SELECT p.x, p.y, m.t FROM place p CROSS JOIN months m),
s AS (SELECT pr.x, pr.y, pr.t, count(g) n, 8 * sqrt(2.220446049250313e-16::DOUBLE) * greatest(1.0, max(abs(g))) tol FROM pr LEFT JOIN gr ON gr.x = pr.x AND gr.y = pr.y AND gr.t = pr.t GROUP BY 1, 2, 3),
cand AS (SELECT gr.*, {score} sc, s.tol FROM gr JOIN s ON s.x = gr.x AND s.y = gr.y AND s.t = gr.t WHERE {score} > s.tol),
best AS (SELECT x, y, t, max(sc) b, count(*) nc FROM cand GROUP BY 1, 2, 3),
tie AS (SELECT c.x, c.y, c.t, count(*) nt, min(c.d) d, min(c.g) g FROM cand c JOIN best b ON b.x = c.x AND b.y = c.y AND b.t = c.t WHERE c.sc >= b.b - c.tol GROUP BY 1, 2, 3)
SELECT {XY.format('s.')}, s.t AS time, CASE WHEN nt = 1 THEN CAST(10 * tie.d + 10 AS DOUBLE) END feature_depth, round(CASE WHEN nt = 1 THEN tie.g END, 6) gradient, CAST(s.n AS INTEGER) n_finite_gradient,
CAST(coalesce(b.nc, 0) AS INTEGER) n_matching_candidates, CAST(coalesce(nt, 0) AS INTEGER) n_tied,
CASE WHEN s.n = 0 THEN 'NO_FINITE_GRADIENT' WHEN b.nc IS NULL THEN '{flat}' WHEN nt > 1 THEN 'AMBIGUOUS_TIE' {status or "ELSE 'LOCAL_CONTIGUOUS_CANDIDATE'"} END status
FROM s LEFT JOIN best b ON b.x = s.x AND b.y = s.y AND b.t = s.t LEFT JOIN tie ON tie.x = s.x AND tie.y = s.y AND tie.t = s.t"""


_FEATURE = ("longitude", "latitude", "time", "feature_depth", "gradient", "n_finite_gradient", "n_matching_candidates", "n_tied", "status")
for _polarity, _score, _flat in (("absolute", "abs(g)", "FLAT_PROFILE"), ("positive", "g", "NO_MATCHING_POLARITY"), ("negative", "-g", "NO_MATCHING_POLARITY")):
    @query(f"depth_feature_{_polarity}", _feature_sql("abs(gr.g)" if _polarity == "absolute" else "gr.g" if _polarity == "positive" else "-gr.g", _flat))
    def _depth_feature(spark, sf, polarity=_polarity):
        return rounded(vertical.depth_feature(vertical.depth_gradient(daily_price(spark, sf, monthly=True)), polarity).select(*_FEATURE), "gradient")


def _transition(name: str, diagnostic: str, names: dict, score: str, flat: str):
    word = diagnostic.upper()
    sql = _feature_sql(score, flat, status=f"WHEN s.n = 6 THEN '{word}_GRADIENT_CANDIDATE' ELSE 'OBSERVED_{word}_INCOMPLETE_PROFILE'")

    def run(spark, sf):
        out = diagnostics.transition_layer(point_profiles(spark, sf, names=names), diagnostic)
        return rounded(out.withColumnRenamed("diagnostic_status", "status").select(*_FEATURE), "gradient")

    query(name, sql)(run)


_transition("thermocline", "thermocline", TEMPERATURE, "-gr.g", "NO_MATCHING_POLARITY")
_transition("halocline", "halocline", SALINITY, "abs(gr.g)", "FLAT_PROFILE")
_transition("pycnocline", "pycnocline", DENSITY, "gr.g", "NO_MATCHING_POLARITY")

_PROFILE = GRAD + """, pr AS (SELECT p.x, p.y, m.t FROM place p CROSS JOIN months m),
full_ AS (SELECT pr.x, pr.y, pr.t, count(mc.v) n, min(mc.v) lo, max(mc.v) hi, 8 * sqrt(2.220446049250313e-16::DOUBLE) * greatest(1.0, max(abs(mc.v))) tol FROM pr LEFT JOIN mc ON mc.x = pr.x AND mc.y = pr.y AND mc.t = pr.t GROUP BY 1, 2, 3),
mem AS (SELECT mc.x, mc.y, mc.t, min(mc.d) f, max(mc.d) l, count(*) k FROM mc JOIN full_ f ON f.x = mc.x AND f.y = mc.y AND f.t = mc.t WHERE f.n = 7 AND mc.v - f.lo <= f.tol GROUP BY 1, 2, 3),
core AS (SELECT f.*, m.f, m.l, CASE WHEN n < 7 THEN 'INCOMPLETE_OXYGEN_PROFILE' WHEN hi - lo <= tol THEN 'FLAT_OXYGEN_PROFILE' WHEN m.l - m.f + 1 > m.k THEN 'AMBIGUOUS_DISJOINT_MINIMA' WHEN m.f = m.l THEN 'UNIQUE_MINIMUM' ELSE 'CONTIGUOUS_MINIMUM_PLATEAU' END core_type
  FROM full_ f LEFT JOIN mem m ON m.x = f.x AND m.y = f.y AND m.t = f.t)"""


def _oxycline(side: str):
    score, allowed = ("-gr.g", "gr.d + 1 <= core.f") if side == "upper" else ("gr.g", "gr.d >= core.l")
    sql = _PROFILE + f""", el AS (SELECT gr.*, {score} sc, core.tol ct FROM gr JOIN core ON core.x = gr.x AND core.y = gr.y AND core.t = gr.t WHERE core.core_type IN ('UNIQUE_MINIMUM', 'CONTIGUOUS_MINIMUM_PLATEAU') AND {allowed}),
st AS (SELECT x, y, t, count(*) n, 8 * sqrt(2.220446049250313e-16::DOUBLE) * greatest(1.0, max(abs(g))) tol FROM el GROUP BY 1, 2, 3),
cand AS (SELECT el.*, st.tol tol FROM el JOIN st ON st.x = el.x AND st.y = el.y AND st.t = el.t WHERE el.sc > st.tol), best AS (SELECT x, y, t, max(sc) b FROM cand GROUP BY 1, 2, 3),
tie AS (SELECT c.x, c.y, c.t, count(*) nt, min(c.d) d, min(c.g) g FROM cand c JOIN best b ON b.x = c.x AND b.y = c.y AND b.t = c.t WHERE c.sc >= b.b - c.tol GROUP BY 1, 2, 3)
SELECT {XY.format('core.')}, core.t AS time, core_type, CASE WHEN core_type IN ('UNIQUE_MINIMUM', 'CONTIGUOUS_MINIMUM_PLATEAU') THEN CAST(5 * core.f + 5 * core.l + 5 AS DOUBLE) END core_depth_m,
CASE WHEN nt = 1 THEN CAST(10 * tie.d + 10 AS DOUBLE) END feature_depth_m, round(CASE WHEN nt = 1 THEN tie.g END, 6) gradient FROM core LEFT JOIN tie ON tie.x = core.x AND tie.y = core.y AND tie.t = core.t"""

    def run(spark, sf):
        out = diagnostics.transition_layer(point_profiles(spark, sf, names=OXYGEN), f"{side}_oxycline")
        return rounded(out.select("longitude", "latitude", "time", "core_type", "core_depth_m", "feature_depth_m", "gradient"), "gradient")

    query(f"{side}_oxycline", sql)(run)


_oxycline("upper")
_oxycline("lower")


@query("oxygen_zone", _PROFILE + """, z AS (SELECT core.*, CAST(25000 AS DOUBLE) thr, 8 * sqrt(2.220446049250313e-16::DOUBLE) * greatest(1.0, 25000.0, hi) zt FROM core),
wall AS (SELECT z.x, z.y, z.t, max(CASE WHEN mc.d < z.f THEN mc.d + 1 END) s, min(CASE WHEN mc.d > z.l THEN mc.d - 1 END) e FROM z JOIN mc ON mc.x = z.x AND mc.y = z.y AND mc.t = z.t
  WHERE z.core_type IN ('UNIQUE_MINIMUM', 'CONTIGUOUS_MINIMUM_PLATEAU') AND mc.v > z.thr + z.zt GROUP BY 1, 2, 3),
r AS (SELECT z.*, coalesce(w.s, 0) s, coalesce(w.e, 6) e, CASE WHEN core_type NOT IN ('UNIQUE_MINIMUM', 'CONTIGUOUS_MINIMUM_PLATEAU') THEN core_type WHEN thr < lo - zt THEN 'THRESHOLD_ZONE_ABSENT'
  WHEN coalesce(w.s, 0) = 0 AND coalesce(w.e, 6) = 6 THEN 'THRESHOLD_ZONE_SPANS_PROFILE' ELSE 'THRESHOLD_ZONE_PRESENT' END zone_status FROM z LEFT JOIN wall w ON w.x = z.x AND w.y = z.y AND w.t = z.t),
b AS (SELECT r.*, u0.v u0, u1.v u1, l0.v l0, l1.v l1 FROM r LEFT JOIN mc u0 ON u0.x = r.x AND u0.y = r.y AND u0.t = r.t AND u0.d = r.s LEFT JOIN mc u1 ON u1.x = r.x AND u1.y = r.y AND u1.t = r.t AND u1.d = r.s - 1
  LEFT JOIN mc l0 ON l0.x = r.x AND l0.y = r.y AND l0.t = r.t AND l0.d = r.e LEFT JOIN mc l1 ON l1.x = r.x AND l1.y = r.y AND l1.t = r.t AND l1.d = r.e + 1)
SELECT """ + XY.format("") + """, t AS time, zone_status, CASE WHEN zone_status IN ('THRESHOLD_ZONE_PRESENT', 'THRESHOLD_ZONE_SPANS_PROFILE') THEN CAST(10 * s + 5 AS DOUBLE) END zone_observed_top_m,
CASE WHEN zone_status IN ('THRESHOLD_ZONE_PRESENT', 'THRESHOLD_ZONE_SPANS_PROFILE') THEN CAST(10 * e + 5 AS DOUBLE) END zone_observed_bottom_m,
round(CASE WHEN zone_status = 'THRESHOLD_ZONE_PRESENT' AND s > 0 THEN 10 * s + 5 + (thr - u0) / (u1 - u0) * -10 END, 6) upper_boundary_depth_m,
round(CASE WHEN zone_status = 'THRESHOLD_ZONE_PRESENT' AND e < 6 THEN 10 * e + 5 + (thr - l0) / (l1 - l0) * 10 END, 6) lower_boundary_depth_m FROM b""")
def _zone(spark, sf):
    out = diagnostics.oxygen_boundary(point_profiles(spark, sf, names=OXYGEN), 25000.0, "umol kg-1")
    return rounded(out.select("longitude", "latitude", "time", "zone_status", "zone_observed_top_m", "zone_observed_bottom_m", "upper_boundary_depth_m", "lower_boundary_depth_m"), "upper_boundary_depth_m", "lower_boundary_depth_m")


def _mixed(name: str, names: dict, method: str, threshold: float, departure: str, turned: str):
    sql = RAW + f""", pr AS (SELECT p.x, p.y, m.t FROM place p CROSS JOIN months m),
ref AS (SELECT pr.*, a.v + 0.5 * (b.v - a.v) rv FROM pr LEFT JOIN mc a ON a.x = pr.x AND a.y = pr.y AND a.t = pr.t AND a.d = 0 LEFT JOIN mc b ON b.x = pr.x AND b.y = pr.y AND b.t = pr.t AND b.d = 1),
lv AS (SELECT ref.x, ref.y, ref.t, rv, CAST(0 AS BIGINT) i, 10.0::DOUBLE z, rv v FROM ref WHERE rv IS NOT NULL UNION ALL
  SELECT ref.x, ref.y, ref.t, rv, g.range, CAST(10 * g.range + 5 AS DOUBLE), mc.v FROM ref CROSS JOIN range(1, 7) g LEFT JOIN mc ON mc.x = ref.x AND mc.y = ref.y AND mc.t = ref.t AND mc.d = g.range WHERE rv IS NOT NULL),
st AS (SELECT *, lag(v) OVER w pv, lag(z) OVER w pz FROM lv WINDOW w AS (PARTITION BY x, y, t ORDER BY i)),
dp AS (SELECT *, {departure.format('v')} dv, {departure.format('pv')} d0, 8 * sqrt(2.220446049250313e-16::DOUBLE) * greatest(1.0, abs(rv), abs(pv), abs(v), {threshold}) tol FROM st WHERE i > 0),
en AS (SELECT *, CASE WHEN v IS NULL THEN 'MLD_UNRESOLVED_INCOMPLETE_PATH' WHEN dv >= {threshold} - tol THEN CASE WHEN abs(dv - {threshold}) <= tol THEN 'MLD_EXACT_THRESHOLD_POINT' WHEN {turned} THEN 'MLD_UNRESOLVED_NONMONOTONIC_BRACKET' ELSE 'MLD_INTERPOLATED_THRESHOLD_CROSSING' END END s FROM dp),
fi AS (SELECT *, row_number() OVER (PARTITION BY x, y, t ORDER BY i) k FROM en WHERE s IS NOT NULL)
SELECT {XY.format('ref.')}, ref.t AS time, round(CASE s WHEN 'MLD_EXACT_THRESHOLD_POINT' THEN z WHEN 'MLD_INTERPOLATED_THRESHOLD_CROSSING' THEN pz + ({threshold} - d0) / (dv - d0) * (z - pz) END, 6) mld_depth_m,
CASE WHEN ref.rv IS NULL THEN 'REFERENCE_{'DENSITY' if method.startswith('density') else 'TEMPERATURE'}_UNRESOLVED' ELSE coalesce(s, 'MLD_OPEN_AT_PROFILE_BOTTOM') END status, CAST(CASE WHEN ref.rv IS NULL THEN 0 ELSE coalesce(fi.i, 6) END AS INTEGER) n_path_points
FROM ref LEFT JOIN fi ON fi.x = ref.x AND fi.y = ref.y AND fi.t = ref.t AND fi.k = 1"""

    def run(spark, sf):
        out = diagnostics.mixed_layer_depth(point_profiles(spark, sf, names=names), method, threshold=threshold)
        return rounded(out.select("longitude", "latitude", "time", "mld_depth_m", "status", F.col("n_path_points").cast("int").alias("n_path_points")), "mld_depth_m")

    query(name, sql)(run)


_mixed("mld_temperature", TEMPERATURE, "temperature_threshold", 3000.0, "abs({0} - rv)", "(abs(pv - rv) > tol AND sign(pv - rv) <> sign(v - rv)) OR dv - d0 <= tol")
_mixed("mld_density", DENSITY, "density_threshold", 3000.0, "({0} - rv)", "false")


def _state(spark, sf):
    """Quantities mapped onto plausible sea water: salinity 30 to 38 g/kg, temperature 0 to 25 degrees."""
    cube = point_profiles(spark, sf, ("quantity", "discount"), {"quantity": {"standard_name": "sea_water_absolute_salinity", "unit": "g kg-1"}, "discount": {"standard_name": "sea_water_conservative_temperature", "unit": "degC"}})
    value = F.when(F.col("variable") == "quantity", 30 + F.col("value") * 0.16).otherwise(F.col("value") * 250)
    return cube.with_(df=cube.df.withColumn("value", value))


def _volume_sql(sa: str, ct: str, p: str) -> str:
    """The polynomial as SQL, from the same published coefficients."""
    return "(" + " + ".join(f"{c!r}::DOUBLE * pow(sqrt(0.0248826675584615::DOUBLE * {sa} + 0.5971840214030754::DOUBLE), {i}) * pow(0.025::DOUBLE * {ct}, {j}) * pow(0.0001::DOUBLE * {p}, {k})" for (i, j, k), c in seawater._V.items()) + ")"


@query("potential_density", RAW + ", s AS (SELECT x, y, d, CAST(date_trunc('month', t) AS DATE) t, 30 + avg(q) * 0.16 sa, avg(r) * 250 ct FROM raw GROUP BY 1, 2, 3, 4) SELECT " + AT.format("") + f", t AS time, round(1 / {_volume_sql('sa', 'ct', '0')}, 5) AS value FROM s")
def _density(spark, sf):
    out = physics.thermodynamic_state(_state(spark, sf)).table().where("variable = 'potential_density'")
    return rounded(out.drop("variable"), "value", digits=5)


def _slope_sql(along: int) -> str:
    """The polynomial's derivative along salinity (0) or temperature (1), in the variables' own units."""
    terms = []
    for (i, j, k), c in seawater._V.items():
        n = i if along == 0 else j
        if n:
            i2, j2 = (i - 2, j) if along == 0 else (i, j - 1)
            factor = n * (0.5 * 0.0248826675584615 if along == 0 else 0.025)
            terms.append(f"{c!r}::DOUBLE * {factor!r}::DOUBLE * pow(sqrt(0.0248826675584615::DOUBLE * sa + 0.5971840214030754::DOUBLE), {i2}) * pow(0.025::DOUBLE * ct, {j2}) * pow(0.0001::DOUBLE * p, {k})")
    return "(" + " + ".join(terms) + ")"


def _levels_sql() -> str:
    """Sea pressure and gravity of the grid's latitudes and depths, as the two helper tables of the state."""
    levels = [(y, d, seawater.pressure(10.0 * d + 5, -12.0 + y), seawater.gravity(-12.0 + y, seawater.pressure(10.0 * d + 10, -12.0 + y))) for y in range(2) for d in range(7)]
    return "(VALUES " + ", ".join(f"({y}, {d}, {p!r}::DOUBLE, {g!r}::DOUBLE)" for y, d, p, g in levels) + ") l(y, d, p, g)"


_N2 = RAW + f""", s AS (SELECT x, y, d, CAST(date_trunc('month', t) AS DATE) t, 30 + avg(q) * 0.16 sa, avg(r) * 250 ct FROM raw GROUP BY 1, 2, 3, 4),
lv AS (SELECT * FROM {_levels_sql()}),
st AS (SELECT s.*, lv.p, lv.g FROM s JOIN lv USING (y, d)),
pr AS (SELECT a.x, a.y, a.d, a.t, a.g, (a.sa + b.sa) / 2 sa, (a.ct + b.ct) / 2 ct, (a.p + b.p) / 2 p, b.sa - a.sa dsa, b.ct - a.ct dct, b.p - a.p dp
  FROM st a JOIN st b ON b.x = a.x AND b.y = a.y AND b.t = a.t AND b.d = a.d + 1),
o AS (SELECT *, {_volume_sql('sa', 'ct', 'p')} v, {_slope_sql(0)} vs, {_slope_sql(1)} vt FROM pr)
SELECT CAST(-80 + x AS DOUBLE) longitude, CAST(-12 + y AS DOUBLE) latitude, CAST(10 * d + 10 AS DOUBLE) depth, t AS time, 'n2' AS variable,
  round(g * g * (-vs / v * dsa - vt / v * dct) / (v * dp * 10000), 9) AS value FROM o
UNION ALL SELECT CAST(-80 + x AS DOUBLE), CAST(-12 + y AS DOUBLE), CAST(10 * d + 10 AS DOUBLE), t, 'pressure_mid', round(p, 9) FROM o"""


@query("stratification", _N2)
def _n2(spark, sf):
    return rounded(physics.stratification(physics.thermodynamic_state(_state(spark, sf))).table(), "value", digits=9)


_IN_PLACE = {"quantity": {"standard_name": "sea_water_absolute_salinity", "unit": "g kg-1"}, "discount": {"standard_name": "sea_water_temperature", "unit": "degC"}}


def _entropy_sql(t: str, p: str, slope: bool = False) -> str:
    x = "sqrt(0.0248826675584615::DOUBLE * sa)"
    terms = [f"{c * (j if slope else 1)!r}::DOUBLE * pow({x}, {i}) * pow(0.025::DOUBLE * {t}, {j - slope}) * pow(0.0001::DOUBLE * {p}, {k})"
             for (i, j, k), c in seawater._ENTROPY.items() if (k == 0 or p != "0") and (j or not slope)]
    return f"({'-0.000625' if slope else '-0.025'}::DOUBLE * (" + " + ".join(terms) + "))"


def _newton_sql(source: str, target: str, old: str, new: str) -> str:
    return f"{target} AS (SELECT *, {old} - ({_entropy_sql(old, '0')} - e) / {_entropy_sql(old, '0', True)} AS {new} FROM {source})"


_CT_SQL = "((" + " + ".join(f"{c!r}::DOUBLE * pow(sqrt(0.0248826675584615::DOUBLE * sa), {i}) * pow(0.025::DOUBLE * pt3, {j})" for i, row in enumerate(seawater._ENTHALPY) for j, c in enumerate(row)) + f") / {seawater._HEAT_CAPACITY!r}::DOUBLE)"
_IN_SITU_SQL = RAW + f""", s AS (SELECT x, y, d, CAST(date_trunc('month', t) AS DATE) t, 30 + avg(q) * 0.16 sa, avg(r) * 250 pt0 FROM raw GROUP BY 1, 2, 3, 4),
lv AS (SELECT * FROM {_levels_sql()}),
n0 AS (SELECT s.*, lv.p, {_entropy_sql('pt0', 'lv.p')} AS e FROM s JOIN lv USING (y, d)),
{_newton_sql('n0', 'n1', 'pt0', 'pt1')}, {_newton_sql('n1', 'n2', 'pt1', 'pt2')}, {_newton_sql('n2', 'n3', 'pt2', 'pt3')},
ct AS (SELECT *, {_CT_SQL} AS ct FROM n3)
SELECT {AT.format('')}, t AS time, 'conservative_temperature' AS variable, round(ct, 6) AS value FROM ct
UNION ALL SELECT {AT.format('')}, t, 'potential_density', round(1 / {_volume_sql('sa', 'ct', '0')}, 6) FROM ct"""


@query("in_situ_state", _IN_SITU_SQL)
def _in_situ(spark, sf):
    cube = point_profiles(spark, sf, ("quantity", "discount"), _IN_PLACE)
    value = F.when(F.col("variable") == "quantity", 30 + F.col("value") * 0.16).otherwise(F.col("value") * 250)
    out = physics.thermodynamic_state(cube.with_(df=cube.df.withColumn("value", value))).table()
    return rounded(out.where("variable in ('conservative_temperature', 'potential_density')"), "value", digits=6)


# ---- paths, events -------------------------------------------------------------------------------


def _hav(a: str, b: str, c: str, d: str) -> str:
    return f"2 * 6371.0088 * asin(sqrt(pow(sin(radians({d} - {b}) / 2), 2) + cos(radians({b})) * cos(radians({d})) * pow(sin(radians({c} - {a}) / 2), 2)))"


@query("transect", RAW + f""", pt(o, lo, la, x, y) AS (VALUES (1, -79.8::DOUBLE, -11.9::DOUBLE, 0, 0), (2, -79.1::DOUBLE, -11.4::DOUBLE, 1, 1), (3, -77.6::DOUBLE, -11.8::DOUBLE, 2, 0), (4, -76.2::DOUBLE, -11.1::DOUBLE, 4, 1)),
sg AS (SELECT *, coalesce({_hav('lag(lo) OVER w', 'lag(la) OVER w', 'lo', 'la')}, 0) s, coalesce({_hav('(-80.0 + lag(x) OVER w)', '(-12.0 + lag(y) OVER w)', '(-80.0 + x)', '(-12.0 + y)')}, 0) m FROM pt WINDOW w AS (ORDER BY o)),
di AS (SELECT *, sum(s) OVER (ORDER BY o) rd, sum(m) OVER (ORDER BY o) md FROM sg)
SELECT di.o point_order, round({_hav('lo', 'la', '(-80.0 + di.x)', '(-12.0 + di.y)')}, 6) match_distance_km, round(rd, 6) requested_distance_km, round(md, 6) matched_distance_km, CAST(10 * dd.range + 5 AS DOUBLE) depth, round(mc.v, 6) AS value
FROM di CROSS JOIN range(7) dd LEFT JOIN mc ON mc.x = di.x AND mc.y = di.y AND mc.d = dd.range AND mc.t = DATE '1997-05-01'""")
def _transect(spark, sf):
    out = path.transect(daily_price(spark, sf, monthly=True), ROUTE, date(1997, 5, 1))
    return rounded(out.select("point_order", "match_distance_km", "requested_distance_km", "matched_distance_km", "depth", "value"), "match_distance_km", "requested_distance_km", "matched_distance_km", "value")


@query("track_distance", f"""WITH p AS (SELECT s_suppkey id, s_nationkey g, CAST(-80 + s_suppkey % 7 AS DOUBLE) lo, CAST(-12 + s_suppkey % 11 AS DOUBLE) la FROM supplier),
s AS (SELECT *, coalesce({_hav('lag(lo) OVER w', 'lag(la) OVER w', 'lo', 'la')}, 0) d FROM p WINDOW w AS (PARTITION BY g ORDER BY id))
SELECT id, round(d, 6) segment_km, round(sum(d) OVER (PARTITION BY g ORDER BY id), 6) distance_km FROM s""")
def _track(spark, sf):
    points = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("g"), (F.col("s_suppkey") % 7 - 80).cast("double").alias("lo"), (F.col("s_suppkey") % 11 - 12).cast("double").alias("la"))
    return rounded(path.along(points, "lo", "la", "id", ["g"]).select("id", "segment_km", "distance_km"), "segment_km", "distance_km")


@query("link_events", RAW + """, ev AS (SELECT s_suppkey id, -80.3 + (s_suppkey % 50) * 0.1 lo, -12.2 + (s_suppkey % 14) * 0.1 la, DATE '1996-01-01' + CAST(s_suppkey * 7 AS INTEGER) t FROM supplier),
nx AS (SELECT ev.*, (SELECT CAST(range AS INTEGER) FROM range(5) ORDER BY abs(-80.0 + range - lo), range LIMIT 1) x, (SELECT CAST(range AS INTEGER) FROM range(2) ORDER BY abs(-12.0 + range - la), range LIMIT 1) y FROM ev),
nt AS (SELECT nx.*, days.t m, row_number() OVER (PARTITION BY id ORDER BY abs(date_diff('day', nx.t, days.t)), days.t) k FROM nx LEFT JOIN days ON abs(date_diff('day', nx.t, days.t)) <= 2)
SELECT nt.id, CAST(-80 + nt.x AS DOUBLE) matched_longitude, CAST(-12 + nt.y AS DOUBLE) matched_latitude, nt.m matched_date, round(c.v, 6) extendedprice_value FROM nt LEFT JOIN c ON c.x = nt.x AND c.y = nt.y AND c.d = 0 AND c.t = nt.m WHERE k = 1""")
def _link(spark, sf):
    s = F.col("s_suppkey")
    events = spark.read.parquet(f"{sf}/supplier.parquet").select(s.alias("id"), (F.lit(-80.3) + (s % 50) * 0.1).alias("longitude"), (F.lit(-12.2) + (s % 14) * 0.1).alias("latitude"), F.date_add(F.lit(date(1996, 1, 1)), (s * 7).cast("int")).alias("date"))
    out = path.link_events(_daily(spark, sf), events, day_tolerance=2)
    return rounded(out.select("id", "matched_longitude", "matched_latitude", "matched_date", "extendedprice_value"), "extendedprice_value")


# ---- geometry ------------------------------------------------------------------------------------

_BOX = [{"rings": [[(-79.0, -12.5), (-77.0, -12.5), (-77.0, -11.0), (-79.0, -11.0)]]}]


@query("mask_include", _SEL + "x BETWEEN 1 AND 3")
def _mask_in(spark, sf):
    return rounded(geometry.mask(_daily(spark, sf), _BOX).table().drop("variable"), "value")


@query("mask_exclude", _SEL + "x = 2 AND y = 0")
def _mask_ex(spark, sf):
    return rounded(geometry.mask(_daily(spark, sf), _BOX, boundary="exclude").table().drop("variable"), "value")


@query("mask_outside", _SEL + "x NOT BETWEEN 1 AND 3")
def _mask_out(spark, sf):
    return rounded(geometry.mask(_daily(spark, sf), _BOX, keep="outside").table().drop("variable"), "value")


@query("stock_mask", _SEL + "y = 1 AND d <= 2")
def _stock(spark, sf):
    cube = _daily(spark, sf)
    return rounded(geometry.crop_stock(cube, geometry.stock_mask(cube, latitude=(-11.5, -10), depth=(0, 25))).table().drop("variable"), "value")


_AREA = "2 * (atan(tan(radians(1.0) / 2) * sin(radians({0} + 0.5))) - atan(tan(radians(1.0) / 2) * sin(radians({0} - 0.5)))) * 6371010.0 * 6371010.0"


def _weighted(cube: Cube, weights: DataFrame, weight: str, by: list[str]) -> DataFrame:
    """Mean of a cube's values by ``by``, weighted by a table of the grid, and the weights' sum."""
    on = [c for c in ("longitude", "latitude", "depth") if c in weights.columns]
    rows = cube.table().where("value is not null").join(F.broadcast(weights), on)  # as many rows as the grid has cells
    return rows.groupBy(*by).agg(F.round(F.sum(F.col("value") * F.col(weight)) / F.sum(weight), 6).alias("value"), F.round(F.sum(weight), 3).alias("weight"))


def _monthly(spark, sf):
    return daily_price(spark, sf, monthly=True)


_MEAN = RAW + ", w AS (SELECT mc.*, {0} AS w FROM mc WHERE v IS NOT NULL) SELECT {1}, round(sum(v * w) / sum(w), 6) AS value, round(sum(w), 3) AS weight FROM w GROUP BY ALL"


@query("cell_area", _MEAN.format(_AREA.format("(-12.0 + y)") + " / 1e6", "t AS time"))
def _areas(spark, sf):
    cube = _monthly(spark, sf)
    return _weighted(cube, geometry.cell_area(cube, "km2"), "area", ["time"])


@query("layer_thickness", _MEAN.format("10.0::DOUBLE", "CAST(-80 + x AS DOUBLE) longitude, t AS time"))
def _layers(spark, sf):
    cube = _monthly(spark, sf)
    return _weighted(cube, geometry.layer_thickness(cube, unit="m"), "thickness", ["longitude", "time"])


@query("cell_volume", _MEAN.format(_AREA.format("(-12.0 + y)") + " * 10 / 1e9", "t AS time"))
def _volumes(spark, sf):
    cube = _monthly(spark, sf)
    return _weighted(cube, geometry.cell_volume(cube, unit="km3"), "volume", ["time"])


def _share_sql() -> str:
    """Share of each grid cell that each polygon of ``SQUARE`` covers, by integration over longitude: at a
    longitude, a figure reaches from the great circle of its lower edge to that of its upper edge, and
    the area of a sliver is its width times the difference of the sines of latitude."""
    edge = lambda y, x0, x1: f"tan(radians({y})) * cos(radians(m - ({x0} + {x1}) / 2)) / cos(radians(({x1} - {x0}) / 2))"
    sine = lambda tangent: f"(({tangent}) / sqrt(1 + ({tangent}) * ({tangent})))"
    boxes = []
    for p in SQUARE:
        xs, ys = [x for x, _ in p["rings"][0]], [y for _, y in p["rings"][0]]
        boxes.append(f"('{p['id']}', {min(xs)}::DOUBLE, {max(xs)}::DOUBLE, {min(ys)}::DOUBLE, {max(ys)}::DOUBLE)")
    n = 4000
    return f"""bx AS (SELECT * FROM (VALUES {', '.join(boxes)}) b(id, x0, x1, y0, y1)),
ce AS (SELECT x, y, -80.5::DOUBLE + x AS c0, -79.5::DOUBLE + x AS c1, -12.5::DOUBLE + y AS d0, -11.5::DOUBLE + y AS d1 FROM place),
sl AS (SELECT id, x, y, c0, c1, d0, d1, x0, x1, y0, y1, greatest(c0, x0) AS a, (least(c1, x1) - greatest(c0, x0)) / {n} AS h, greatest(c0, x0) + (k.range + 0.5) * (least(c1, x1) - greatest(c0, x0)) / {n} AS m
  FROM ce, bx, range({n}) k WHERE least(c1, x1) > greatest(c0, x0)),
sh AS (SELECT id, x, y, sum(greatest(0, {sine("least(" + edge('d1', 'c0', 'c1') + ", " + edge('y1', 'x0', 'x1') + ")")} - {sine("greatest(" + edge('d0', 'c0', 'c1') + ", " + edge('y0', 'x0', 'x1') + ")")}) * radians(h)) * 6371010.0 * 6371010.0 AS o
  FROM sl GROUP BY 1, 2, 3)"""


_SHARES = RAW + ", " + _share_sql() + """, w AS (SELECT id, mc.*, o * {0} AS w FROM mc JOIN sh ON sh.x = mc.x AND sh.y = mc.y WHERE v IS NOT NULL AND o > 1e-6)
SELECT id AS feature_id, t AS time, round(sum(v * w) / sum(w), 3) AS value, round(sum(w) / 1e12, 4) AS weight FROM w GROUP BY 1, 2"""


def _by_polygon(cube: Cube, weights: DataFrame, weight: str) -> DataFrame:
    on = [c for c in ("longitude", "latitude", "depth") if c in weights.columns]
    rows = cube.table().where("value is not null").join(F.broadcast(weights), on)  # as many rows as polygons have candidate cells
    return rows.groupBy("feature_id", "time").agg(F.round(F.sum(F.col("value") * F.col(weight)) / F.sum(weight), 3).alias("value"), F.round(F.sum(weight) / 1e12, 4).alias("weight"))


@query("polygon_weights", _SHARES.format("1"))
def _weights(spark, sf):
    cube = _monthly(spark, sf)
    return _by_polygon(cube, geometry.polygon_weights(cube, SQUARE).select("feature_id", "longitude", "latitude", "effective_area_m2"), "effective_area_m2")


@query("polygon_weights_3d", _SHARES.format("10"))
def _weights3(spark, sf):
    cube = _monthly(spark, sf)
    return _by_polygon(cube, geometry.polygon_weights(cube, SQUARE, "3d").select("feature_id", "longitude", "latitude", "depth", "effective_volume_m3"), "effective_volume_m3")


@query("coast_dist", RAW + """, w AS (SELECT mc.*, round(asin(cos(radians(-12.0 + y)) * sin(radians(1.0 + x))) * 6371010.0 * 0.000539957, 4) nm FROM mc WHERE v IS NOT NULL)
SELECT nm AS distance_nm, count(*) AS n, round(avg(v), 6) AS value FROM w GROUP BY 1""")
def _coast(spark, sf):
    cube = _monthly(spark, sf)
    rows = cube.table().where("value is not null").join(F.broadcast(rounded(geometry.coast_dist(cube, COAST), "distance_nm", digits=4)), ["longitude", "latitude"])
    return rows.groupBy("distance_nm").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("value"))


# ---- plot tables ---------------------------------------------------------------------------------


@query("plot_map", RAW + " SELECT " + XY.format("p.") + ", round(mc.v, 6) AS value FROM place p LEFT JOIN mc ON mc.x = p.x AND mc.y = p.y AND mc.d = 1 AND mc.t = DATE '1997-05-01'")
def _map(spark, sf):
    return rounded(plotdata.plot_map(daily_price(spark, sf, monthly=True), time=date(1997, 5, 1), depth=15.0).data, "value")


@query("plot_section", RAW + " SELECT CAST(-80 + g.x AS DOUBLE) longitude, CAST(10 * g.d + 5 AS DOUBLE) depth, round(mc.v, 6) AS value FROM (SELECT * FROM grid WHERE y = 0) g LEFT JOIN mc ON mc.x = g.x AND mc.y = g.y AND mc.d = g.d AND mc.t = DATE '1997-05-01'")
def _section(spark, sf):
    return rounded(plotdata.section(daily_price(spark, sf, monthly=True), latitude=-12.0, time=date(1997, 5, 1)).data, "value")


@query("plot_profile", RAW + " SELECT 'extendedprice' AS variable, CAST(10 * g.d + 5 AS DOUBLE) depth, round(mc.v, 6) AS value FROM (SELECT * FROM grid WHERE x = 2 AND y = 0) g LEFT JOIN mc ON mc.x = g.x AND mc.y = g.y AND mc.d = g.d AND mc.t = DATE '1997-05-01'")
def _profile(spark, sf):
    return rounded(plotdata.profile(daily_price(spark, sf, monthly=True), -78.0, -12.0, date(1997, 5, 1)).data, "value")


@query("plot_timeseries", RAW + " SELECT 'extendedprice' AS variable, days.t AS time, round(c.v, 6) AS value FROM days LEFT JOIN c ON c.t = days.t AND x = 0 AND y = 0 AND d = 0 WHERE days.t BETWEEN DATE '1996-03-01' AND DATE '1997-08-15'")
def _timeseries(spark, sf):
    return rounded(plotdata.timeseries(_daily(spark, sf), -80.0, -12.0, 5.0, start=DAYS[0], stop=DAYS[1]).data, "value")


@query("plot_hovmoller", RAW + " SELECT days.t AS time, CAST(-80 + g.range AS DOUBLE) longitude, round(c.v, 6) AS value FROM days CROSS JOIN range(5) g LEFT JOIN c ON c.t = days.t AND c.x = g.range AND c.y = 1 AND c.d = 2")
def _hovmoller(spark, sf):
    return rounded(plotdata.hovmoller(_daily(spark, sf), "longitude", latitude=-11.0, depth=25.0).data, "value")


@query("plot_transect", RAW + " SELECT CAST(10 * d.range + 5 AS DOUBLE) depth, p.o AS n, round(mc.v, 6) AS value FROM (VALUES (1, 0, 0), (2, 1, 1), (3, 2, 0), (4, 4, 1)) p(o, x, y) CROSS JOIN range(7) d LEFT JOIN mc ON mc.x = p.x AND mc.y = p.y AND mc.d = d.range AND mc.t = DATE '1997-05-01'")
def _plot_transect(spark, sf):
    rows = plotdata.plot_transect(daily_price(spark, sf, monthly=True), ROUTE, date(1997, 5, 1)).data
    return rounded(rows.select("depth", F.dense_rank().over(Window.orderBy("distance_km")).alias("n"), "value"), "value")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
