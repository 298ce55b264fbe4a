"""Cubes over the relational test tables: the views that the registered queries run on."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.cube import CELL, Cube, finite

PRICE_VARIABLES = {"quantity": "l_quantity", "extendedprice": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}
_VERTICAL = {"kind": "DEPTH_LENGTH", "unit": "m", "positive": "down", "bounds": [[10.0 * k, 10.0 * (k + 1)] for k in range(7)]}


def _days(frame: DataFrame, column: str) -> tuple[date, ...]:
    """The distinct days of a column, in order: the time axis."""
    return tuple(sorted(r[0] for r in frame.select(F.to_date(column).alias("d")).distinct().where("d is not null").collect()))


def daily_price(spark: SparkSession, sf_dir: str, variables: tuple[str, ...] = ("extendedprice",), monthly: bool = False) -> Cube:
    """Line items as a cube: 5 x 2 places by supplier, 7 depth cells of 10 m by line number, days (or
    months) of shipping; rows of one cell are averaged."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    days = _days(lines, "l_shipdate")
    day = F.to_date("l_shipdate")
    if monthly:
        days = tuple(sorted({d.replace(day=1) for d in days}))
        day = F.trunc(day, "month")
    axis = F.broadcast(spark.createDataFrame(list(enumerate(days)), "time_idx int, day date"))
    pairs = ", ".join(f"'{v}', {PRICE_VARIABLES[v]}" for v in variables)
    rows = lines.select(
        (F.col("l_suppkey") % 5).cast("int").alias("lon_idx"), F.pmod(F.floor(F.col("l_suppkey") / 5), F.lit(2)).cast("int").alias("lat_idx"),
        (F.col("l_linenumber") - 1).cast("int").alias("depth_idx"), day.alias("day"), F.expr(f"stack({len(variables)}, {pairs}) as (variable, raw)"))
    df = (rows.groupBy(*CELL, "day", "variable").agg(F.avg(finite(F.col("raw"))).alias("value")).join(axis, "day")
          .select(*CELL, "time_idx", "variable", "value"))
    return Cube(df, tuple(-80.0 + k for k in range(5)), (-12.0, -11.0), tuple(10.0 * k + 5 for k in range(7)), days, tuple(variables),
                {"units": {v: u for v, u in {"quantity": "1", "extendedprice": "usd", "discount": "1", "tax": "1"}.items() if v in variables},
                 "vertical": _VERTICAL | {"semantics": {v: "VERTICAL_CELL_MEAN" for v in variables}}})


def point_profiles(spark: SparkSession, sf_dir: str, variables: tuple[str, ...] = ("extendedprice",), names: dict[str, dict] | None = None, bounds: bool = True) -> Cube:
    """Monthly profiles whose values stand for points in depth; ``names`` gives standard names and units."""
    cube = daily_price(spark, sf_dir, variables, monthly=True)
    vertical = cube.meta["vertical"] | {"semantics": {v: "VERTICAL_POINT" for v in variables}}
    if not bounds:
        vertical = {k: v for k, v in vertical.items() if k != "bounds"}
    meta = cube.meta | {"vertical": vertical}
    if names:
        meta["standard_names"] = {v: n["standard_name"] for v, n in names.items()}
        meta["units"] = {v: n["unit"] for v, n in names.items()}
    return cube.with_(meta=meta)


def order_surface(spark: SparkSession, sf_dir: str) -> Cube:
    """Order totals as a surface cube: places by the customer's nation (5 x 5), days of ordering."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    nations = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    days = _days(orders, "o_orderdate")
    axis = F.broadcast(spark.createDataFrame(list(enumerate(days)), "time_idx int, day date"))
    rows = orders.join(nations, "o_custkey").select(
        (F.col("c_nationkey") % 5).cast("int").alias("lon_idx"), F.floor(F.col("c_nationkey") / 5).cast("int").alias("lat_idx"), F.lit(0).alias("depth_idx"),
        F.to_date("o_orderdate").alias("day"), finite(F.col("o_totalprice")).alias("raw"))
    df = rows.groupBy(*CELL, "day").agg(F.avg("raw").alias("value")).join(axis, "day").select(*CELL, "time_idx", F.lit("totalprice").alias("variable"), "value")
    return Cube(df, tuple(float(k) for k in range(5)), tuple(float(k) for k in range(5)), (None,), days, ("totalprice",), {"units": {"totalprice": "usd"}})
