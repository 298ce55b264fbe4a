"""Sea-water physics: thermodynamic state and stratification, as column expressions on paired variables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.cube import CELL, Cube, finite
from gridloom.errors import GridError, require
from gridloom.functions import seawater
from gridloom.operators.diagnostics import unit_key, variable_named
from gridloom.operators.provenance import recorded
from gridloom.operators.vertical import POINT, depth_axis, semantics

STATE_UNITS = {"absolute_salinity": "g kg-1", "conservative_temperature": "degC", "pressure": "dbar", "density": "kg m-3", "potential_density": "kg m-3"}
STATE_NAMES = {"absolute_salinity": "sea_water_absolute_salinity", "conservative_temperature": "sea_water_conservative_temperature", "pressure": "sea_water_pressure",
               "density": "sea_water_density", "potential_density": "sea_water_potential_density"}


def _pressures(cube: Cube, centres: tuple[float, ...]) -> DataFrame:
    """Sea pressure and gravity of each latitude and depth: an axis-sized table."""
    rows = []
    for j, lat in enumerate(cube.latitude):
        for k, d in enumerate(centres):
            p = seawater.pressure(d, lat)
            rows.append((j, k, p, seawater.gravity(lat, p)))
    return F.broadcast(cube.spark.createDataFrame(rows, "lat_idx int, depth_idx int, p double, g double"))


def thermodynamic_state(cube: Cube, salinity: str | None = None, temperature: str | None = None, pressure: str | None = None, reference_pressure_dbar: float = 0.0) -> Cube:
    """Absolute Salinity, Conservative Temperature, pressure, density and potential density of each cell
    that has salinity and temperature.

    Salinity is Absolute Salinity (converting practical salinity needs a lookup table that is not part of
    this library); temperature is Conservative, potential or in-situ. Pressure comes from depth and latitude
    unless a variable holds it. Salinities outside 0 to 42 g/kg, and states outside the oceanographic range
    (the funnel) of the polynomials, are an error when the result is computed.
    """
    axis = depth_axis(cube, "teos10", 1)
    require(reference_pressure_dbar >= 0, "teos10_reference_pressure", "the reference pressure is not negative")
    told = cube.meta.get("standard_names", {})
    practical = [v for v in cube.variables if told.get(v) == "sea_water_practical_salinity" and (salinity is None or v == salinity)]
    if practical and not any(told.get(v) == "sea_water_absolute_salinity" for v in cube.variables):
        raise GridError("teos10_dependency_missing", "practical salinity needs a lookup table; give Absolute Salinity")
    sa = variable_named(cube, ("sea_water_absolute_salinity",), salinity, "teos10")
    te = variable_named(cube, ("sea_water_conservative_temperature", "sea_water_potential_temperature", "sea_water_temperature"), temperature, "teos10")
    for v in (sa, te, *[pressure] * (pressure is not None)):
        require(semantics(cube, v) == POINT, "teos10_semantics", f"{v} does not hold point values")
    scale = {"g kg-1": 1.0, "kg kg-1": 1000.0}.get(unit_key(cube.unit(sa)))
    shift = {"degc": 0.0, "degree_celsius": 0.0, "celsius": 0.0, "k": -273.15, "kelvin": -273.15}.get(unit_key(cube.unit(te)))
    require(scale is not None and shift is not None, "teos10_unit", "units of salinity or temperature are not known")
    keys = [*CELL, "time_idx"]
    names = [sa, te, *[pressure] * (pressure is not None)]
    wide = (cube.df.where(F.col("variable").isin(names)).groupBy(*keys)
            .agg(*[F.max(F.when(F.col("variable") == v, F.col("value"))).alias(f"_{i}") for i, v in enumerate(names)]))
    wide = wide.where(F.col("_0").isNotNull() & F.col("_1").isNotNull()).withColumn("sa", F.col("_0") * scale)
    outside = (F.col("sa") < 0) | (F.col("sa") > 42)
    wide = wide.withColumn("sa", F.when(outside, F.raise_error("teos10_range: a salinity lies outside 0 to 42 g/kg").cast("double")).otherwise(F.col("sa")))
    given = F.col("_1") + F.lit(shift)
    if pressure is None:
        wide = wide.join(_pressures(cube, axis.centres), ["lat_idx", "depth_idx"])
    else:
        factor = {"dbar": 1.0, "pa": 1e-4}.get(unit_key(cube.unit(pressure)))
        require(factor is not None, "teos10_unit", "the unit of pressure is not known")
        wide = wide.withColumn("p", F.col("_2") * factor).where("p is not null")
    wide = wide.withColumn("pt", given)
    if told[te] == "sea_water_temperature":  # each step a column of its own, so that its expression stays small
        wide = wide.withColumn("entropy", seawater.entropy(F.col("sa"), F.col("pt"), F.col("p")))
        for _ in range(3):
            wide = wide.withColumn("pt", seawater.newton_potential(F.col("sa"), F.col("pt"), F.col("entropy")))
    wide = wide.withColumn("ct", F.col("pt") if told[te] == "sea_water_conservative_temperature" else seawater.conservative_from_potential(F.col("sa"), F.col("pt")))
    odd = seawater.outside_funnel(F.col("sa"), F.col("ct"), F.col("p"))
    wide = wide.withColumn("ct", F.when(odd, F.raise_error("teos10_outside_funnel: a state lies outside the oceanographic range").cast("double")).otherwise(F.col("ct")))
    values = {"absolute_salinity": F.col("sa"), "conservative_temperature": F.col("ct"), "pressure": F.col("p"), "density": seawater.density(F.col("sa"), F.col("ct"), F.col("p")),
              "potential_density": seawater.density(F.col("sa"), F.col("ct"), F.lit(float(reference_pressure_dbar)))}
    cells = F.explode(F.array(*[F.struct(F.lit(name).alias("variable"), value.alias("value")) for name, value in values.items()]))
    df = wide.select(*keys, cells.alias("c")).select(*keys, F.col("c.variable").alias("variable"), finite(F.col("c.value")).alias("value"))
    vertical = cube.meta["vertical"] | {"semantics": {v: POINT for v in values}}
    out = cube.with_(df=df, variables=tuple(values), meta=cube.meta | {"units": STATE_UNITS, "standard_names": STATE_NAMES, "vertical": vertical, "thermodynamic_state": {"reference_pressure_dbar": reference_pressure_dbar}})
    return recorded(out, "thermodynamic_state", {"salinity": sa, "temperature": te, "reference_pressure_dbar": reference_pressure_dbar})


def stratification(cube: Cube, support: str = "local") -> Cube:
    """Squared buoyancy frequency (N2) and mid pressure of adjacent levels of a thermodynamic state.

    Pairs with a missing level, or for ``support`` local across a gap, have none.
    """
    require("thermodynamic_state" in cube.meta, "stratification_input", "the cube holds no thermodynamic state")
    require(support in ("local", "all"), "bad_argument", "support is local or all")
    axis = depth_axis(cube, "stratification")
    pairs = axis.pairs
    keys = ["lon_idx", "lat_idx", "time_idx"]
    names = {"absolute_salinity": "sa", "conservative_temperature": "ct", "pressure": "p"}
    wide = (cube.df.where(F.col("variable").isin(list(names))).groupBy(*keys, "depth_idx")
            .agg(*[F.max(F.when(F.col("variable") == v, F.col("value"))).alias(c) for v, c in names.items()])).where("sa is not null and ct is not null and p is not null")
    level = F.struct("sa", "ct", "p")
    sides = F.array(F.struct(F.col("depth_idx").alias("pair"), level.alias("one"), F.lit(None).cast("struct<sa:double,ct:double,p:double>").alias("two")),
                    F.struct((F.col("depth_idx") - 1).alias("pair"), F.lit(None).cast("struct<sa:double,ct:double,p:double>").alias("one"), level.alias("two")))
    allowed = [p["index"] for p in pairs if support == "all" or p["relation"] != "GAPPED_SUPPORT"]
    both = wide.select(*keys, F.explode(sides).alias("s")).select(*keys, "s.*").where(F.col("pair").isin(allowed) if allowed else F.lit(False))
    got = both.groupBy(*keys, "pair").agg(F.max("one").alias("one"), F.max("two").alias("two")).where("one is not null and two is not null")
    # The deeper level is the second one when depth grows along the axis.
    up, down = ("one", "two") if axis.centres[0] < axis.centres[-1] else ("two", "one")
    mid = lambda c: (F.col(f"one.{c}") + F.col(f"two.{c}")) / 2
    step = lambda c: F.col(f"{down}.{c}") - F.col(f"{up}.{c}")
    got = got.select(*keys, "pair", mid("sa").alias("sa"), mid("ct").alias("ct"), mid("p").alias("p"), step("sa").alias("dsa"), step("ct").alias("dct"), step("p").alias("dp"))
    got = got.withColumn("dp", F.when(F.col("dp") <= 0, F.raise_error("stratification_pressure_geometry: pressure does not grow with depth").cast("double")).otherwise(F.col("dp")))
    g = F.broadcast(cube.spark.createDataFrame([(j, k, seawater.gravity(lat, seawater.pressure((axis.centres[k] + axis.centres[k + 1]) / 2, lat))) for j, lat in enumerate(cube.latitude) for k in range(len(pairs))],
                                               "lat_idx int, pair int, g double"))
    sa, ct, p = F.col("sa"), F.col("ct"), F.col("p")
    n2 = F.col("g") * F.col("g") * (seawater.contraction(sa, ct, p) * F.col("dsa") - seawater.expansion(sa, ct, p) * F.col("dct")) / (seawater.specific_volume(sa, ct, p) * F.col("dp") * F.lit(1e4))
    cells = F.explode(F.array(F.struct(F.lit("n2").alias("variable"), n2.alias("value")), F.struct(F.lit("pressure_mid").alias("variable"), p.alias("value"))))
    df = got.join(g, ["lat_idx", "pair"]).select(*keys, "pair", cells.alias("c")).select(
        "lon_idx", "lat_idx", F.col("pair").cast("int").alias("depth_idx"), "time_idx", F.col("c.variable").alias("variable"), finite(F.col("c.value")).alias("value"))
    depth = tuple((a + b) / 2 for a, b in zip(cube.depth, cube.depth[1:]))
    vertical = {k: v for k, v in cube.meta["vertical"].items() if k != "bounds"} | {"pending": True}
    out = cube.with_(df=df, depth=depth, variables=("n2", "pressure_mid"), meta=cube.meta | {"units": {"n2": "s-2", "pressure_mid": "dbar"}, "vertical": vertical, "stratification": {"support": support}})
    return recorded(out, "stratification", {"support": support})
