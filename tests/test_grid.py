"""Hand-computed results of the grid operators, refusals, and storage."""

import math
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.cube import Cube
from gridloom.errors import GridError
from gridloom.functions import calendars, seawater
from gridloom.operators import checks, diagnostics, geometry, path, physics, provenance, select, temporal, vertical
from gridloom.plans import plotdata
from gridloom.sources import cf, netcdf3
from gridloom.streaming import windows

TIMES = (date(2020, 1, 1), date(2020, 2, 1), date(2021, 1, 1), date(2021, 2, 1))


@pytest.fixture(scope="module")
def base(spark):
    """Every value tells its place: 10000 variable + 1000 time + 100 depth + 10 latitude + longitude."""
    data = np.fromfunction(lambda x, y, d, t, v: 10000 * (v + 1) + 1000 * (t + 1) + 100 * (d + 1) + 10 * (y + 1) + x + 1, (3, 2, 2, 4, 2))
    return Cube.from_arrays(spark, (-80, -79, -78), (-12, -11), (0.0, 50.0), TIMES, ("temperature", "oxygen"), data, {"temperature": "degC", "oxygen": "mmol m-3"})


def profile(spark, depths, values, name="sea_water_temperature", unit="degC", bounds=None, semantics="VERTICAL_POINT", positive="down"):
    cube = Cube.from_arrays(spark, (-80.0,), (-12.0,), tuple(depths), (date(2020, 1, 1),), ("v",), np.array([np.nan if x is None else x for x in values], float).reshape(1, 1, -1, 1, 1), {"v": unit})
    told = {"kind": "DEPTH_LENGTH", "unit": "m", "positive": positive, "semantics": {"v": semantics}} | ({"bounds": bounds} if bounds else {})
    return cube.with_(meta=cube.meta | {"vertical": told, "standard_names": {"v": name}})


def one(frame):
    return frame.collect()[0]


def code(call, *args, **kwargs):
    with pytest.raises(GridError) as error:
        call(*args, **kwargs)
    return error.value.code


# ---- time ----------------------------------------------------------------------------------------


def test_climatology_and_anomaly_goldens(base):
    clim = temporal.climatology(base, "month")
    row = one(clim.df.where("lon_idx = 0 and lat_idx = 0 and depth_idx = 0 and variable = 'temperature' and group_key = 1"))
    assert row["mean"] == 12111 and abs(row.sd - math.sqrt(2e6)) < 1e-9 and row.n_valid == 2 and row.coverage == 1
    first = "lon_idx = 0 and lat_idx = 0 and depth_idx = 0 and time_idx = 0 and variable = 'temperature'"
    assert one(temporal.anom_diff(base, clim).df.where(first)).value == -1000
    assert abs(one(temporal.anom_z(base, clim).df.where(first)).value + 1 / math.sqrt(2)) < 1e-12
    assert abs(one(temporal.signal_noise(base, clim).df.where(first)).value - 1 / math.sqrt(2)) < 1e-12
    annual = {r.year: r for r in temporal.annual_index(base).where("var = 'temperature' and depth = 0").collect()}
    assert annual[2020].n == 12 and {y: round(r.mean_value) for y, r in annual.items()} == {2020: 11617, 2021: 13617}


@pytest.mark.parametrize("leap,mean,n", [("feb28", 25, 3), ("drop", 70 / 3, 3), ("keep", 70 / 3, 3)])
def test_leap_days(spark, leap, mean, n):
    times = (date(2019, 2, 28), date(2020, 2, 28), date(2020, 2, 29), date(2021, 2, 28))
    cube = Cube.from_arrays(spark, (0.0,), (0.0,), None, times, ("v",), np.array([10.0, 20, 30, 40]).reshape(1, 1, 4, 1))
    clim = temporal.climatology(cube, "day", leap=leap)
    row = one(clim.df.where("group_key = 59"))
    assert abs(row["mean"] - mean) < 1e-12 and row.n_valid == n
    leap_day = temporal.anomaly(cube, clim).df.where("time_idx = 2").collect()
    assert leap_day == [] if leap == "drop" else len(leap_day) == 1
    if leap == "keep":
        assert one(clim.df.where("group_key = 60"))["mean"] == 30


def test_aggregation_counts_from_the_axis(spark):
    times = (date(2020, 1, 1), date(2020, 1, 15), date(2020, 3, 1))
    cube = Cube.from_arrays(spark, (0.0,), (0.0,), None, times, ("v",), np.array([1.0, np.nan, 10.0]).reshape(1, 1, 3, 1))
    out, told = temporal.aggregate_time(cube, "month")
    assert out.time == (date(2020, 1, 1), date(2020, 2, 1), date(2020, 3, 1))
    assert [r.value for r in out.dense().orderBy("time_idx").collect()] == [1.0, None, 10.0]
    assert {r.time_idx: (r.n_valid, r.n_total, r.coverage_fraction) for r in told.collect()} == {0: (1, 2, 0.5), 2: (1, 1, 1.0)}
    strict, _ = temporal.aggregate_time(cube, "month", na_rm=False)
    assert [r.value for r in strict.dense().orderBy("time_idx").collect()] == [None, None, 10.0]
    assert temporal.period_start(date(2021, 1, 3), "week") == date(2020, 12, 28) and temporal.period_start(date(2021, 1, 3), "season") == date(2020, 12, 1)


def test_trend_goldens(spark):
    times = tuple(date(2000 + k, 1, 1) for k in range(5))
    cube = Cube.from_arrays(spark, (0.0, 1.0), (0.0,), None, times, ("v",), np.array([[1.0, 2, 3, 4, 5], [7.0] * 5]).reshape(2, 1, 5, 1), {"v": "1"})
    out, told = temporal.trend(cube, "day")
    rows = {r.lon_idx: r for r in told.collect()}
    assert abs(rows[0].slope - 1 / 365.25) < 1e-5 and rows[0].r2 > 0.999 and rows[1].slope == 0 and rows[1].r2 is None and rows[1].residual_sd == 0
    assert out.unit("v") == "day-1" and code(temporal.trend, out) == "trend_nonhistorical_time"


def test_custom_months_and_refusals(base, spark):
    got = temporal.to_month(base, lambda v: v.max() - v.min())
    assert got.df.count() == 96 and one(got.df).value == 0
    clim = temporal.climatology(base)
    assert code(temporal.anomaly, select.slice_cube(base, longitude=-80.0), clim) == "anomaly_error"
    assert code(temporal.climatology, clim.means()) == "climatological_operation_error"
    assert code(temporal.climatology, base, period=(date(1990, 1, 1), date(1991, 1, 1))) == "climatology_no_overlap"
    noleap = calendars.decode([0, 31], "days since 2000-01-01", "noleap")
    cube = Cube.from_arrays(spark, (0.0,), (0.0,), None, noleap, ("v",), np.zeros((1, 1, 2, 1)))
    assert code(temporal.aggregate_time, cube, "month") == "cf_time_unsupported_operation"
    assert select.slice_cube(cube, time=noleap[1]).time == (noleap[1],)


def test_stream_of_days(spark, tmp_path):
    spark.createDataFrame([(1, datetime(2024, 1, 1, 5), 2.0), (1, datetime(2024, 1, 1, 9), 4.0), (1, datetime(2024, 1, 2, 1), float("nan"))], "k int, time timestamp, value double").write.parquet(f"{tmp_path}/in")
    stream = windows.stream_aggregate(spark.readStream.schema("k int, time timestamp, value double").parquet(f"{tmp_path}/in"), "day", ["k"])
    run = stream.writeStream.format("memory").queryName("days").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    assert sorted((r.value, r.n_valid) for r in spark.table("days").collect() if r.value is not None) == [(3.0, 2)]


# ---- selection and paths -------------------------------------------------------------------------


def test_slices(base):
    got = select.slice_cube(base, longitude=[-78.0, -80.0], latitude=-11.0, time="2021-01-01", variable="oxygen")
    assert got.longitude == (-78.0, -80.0) and got.shape == (2, 1, 2, 1, 1)
    assert sorted(r.value for r in got.df.collect()) == [23121, 23123, 23221, 23223]
    assert select.slice_cube(base, longitude=-79.5, match="nearest").longitude == (-80.0,)
    assert select.slice_cube(base, longitude=[-80.0, -80.0]).df.count() == 64
    assert code(select.slice_cube, base, longitude=-79.5) == "slice_not_found"
    assert code(select.slice_cube, base, longitude=-90.0, match="nearest") == "slice_outside_domain"
    assert code(select.slice_cube, base, longitude=-79.4, match="nearest", tolerance={"longitude": 0.1}) == "slice_tolerance"
    assert code(select.slice_cube, base, time=["2021-01-01", "2020-01-01"]) == "slice_time"
    assert code(select.slice_cube, base, variable="salt") == "slice_variable"


def test_crops_and_tables(base):
    got = select.crop(base, longitude=(-79.5, -78), time=("2020-02-01", "2021-01-01"))
    assert got.shape == (2, 2, 2, 2, 2)
    assert code(select.crop, base, longitude=(-90, -79)) == "crop_outside_domain"
    assert code(select.crop, base, longitude=(-90, -85), outside="clip") == "crop_no_overlap"
    assert code(select.crop, base, longitude=(-79.8, -79.2)) == "crop_no_coordinates"
    row = one(select.extract(base, longitude=-80.0, latitude=-12.0, depth=0.0, time="2020-01-01", variable="temperature", mode="point", keep_index=True))
    assert (row.value, row.unit, row.time_index) == (11111, "degC", 1)
    wide = select.extract(base, longitude=-80.0, latitude=-12.0, time="2020-01-01", mode="profile", form="wide").orderBy("depth").collect()
    assert [(r.temperature, r.oxygen) for r in wide] == [(11111, 21111), (11211, 21211)]
    assert code(select.extract, base, mode="point") == "extract_mode"


def test_events_take_the_nearest_cell(base, spark):
    events = spark.createDataFrame([(1, -80.0, -12.0, date(2020, 1, 1)), (2, -78.0, -11.0, date(2021, 2, 1)), (3, -70.0, 0.0, date(2020, 1, 1)), (4, None, 0.0, date(2020, 1, 1)), (5, -80.0, -12.0, date(2020, 1, 3))],
                                   "id int, longitude double, latitude double, date date")
    got = {r.id: r.temperature_value for r in path.link_events(base, events, variables=["temperature"]).collect()}
    assert got == {1: 11111, 2: 14123, 3: 11123, 4: None, 5: None}
    near = {r.id: (r.temperature_value, r.matched_dt_days) for r in path.link_events(base, events, variables=["temperature"], day_tolerance=2).collect()}
    assert near[5] == (11111, 2)


def test_transect_distances(base):
    rows = path.transect(base, [{"longitude": -80, "latitude": -12}, {"longitude": -79, "latitude": -12}], "2020-01-01", 0.0, "temperature").orderBy("point_order").collect()
    assert [r.value for r in rows] == [11111, 11112]
    assert abs(rows[1].requested_distance_km - path.haversine_km(-80, -12, -79, -12)) < 1e-9 and abs(path.haversine_km(0, 0, 1, 0) - 111.195) < 1e-2
    assert code(path.transect, base, [{"longitude": 280, "latitude": -12}], "2020-01-01") == "transect_crs_error"


# ---- depth ---------------------------------------------------------------------------------------


def test_layers(base, spark):
    got = vertical.layer_mean(base, [0, 50])
    assert one(got.df.where("lon_idx = 0 and lat_idx = 0 and time_idx = 0 and variable = 'temperature'")).value == 11161
    cells = profile(spark, (5, 15, 25), (11, 31, 51), bounds=[[0, 10], [10, 20], [20, 30]], semantics="VERTICAL_CELL_MEAN")
    assert one(vertical.layer_integral(cells, [0, 30]).df).value == 930
    assert one(vertical.layer_mean(cells, [5, 15]).df).value == 21
    assert code(vertical.layer_mean, cells, [20, 40]) == "vertical_partial_coverage"
    holed = profile(spark, (5, 15), (11, None), bounds=[[0, 10], [10, 20]], semantics="VERTICAL_CELL_MEAN")
    assert one(vertical.layer_integral(holed, [0, 20]).df).value is None and one(vertical.layer_mean(holed, [0, 20]).df).value == 11
    assert code(vertical.depth_gradient, vertical.layer_integral(cells, [0, 20, 30])) in ("vertical_gradient_semantics", "vertical_gradient_chain")


def test_samples_and_gradients(spark):
    points = profile(spark, (0, 10, 20), (1, 21, 41))
    assert [r.value for r in vertical.depth_sample(points, [5, 10]).df.orderBy("depth_idx").collect()] == [11, 21]
    slope = vertical.depth_gradient(points)
    assert [r.value for r in slope.df.collect()] == [2, 2] and slope.depth == (5, 15) and slope.unit("v") == "degC m-1"
    row = one(vertical.depth_feature(slope))
    assert row.status == "AMBIGUOUS_TIE" and row.n_tied == 2 and row.gradient is None
    cells = profile(spark, (5, 15, 25), (11, 31, 51), bounds=[[0, 10], [10, 20], [20, 30]], semantics="VERTICAL_CELL_MEAN")
    assert one(vertical.depth_sample(cells, [12]).df).value == 31
    assert code(vertical.depth_sample, cells, [10]) == "vertical_boundary_ambiguous" and code(vertical.depth_sample, points, [30]) == "vertical_sampling_outside"
    assert code(vertical.depth_gradient, slope) == "vertical_gradient_chain"
    gapped = profile(spark, (5, 25), (11, 31), bounds=[[0, 10], [20, 30]], semantics="VERTICAL_CELL_MEAN")
    assert code(vertical.depth_sample, gapped, [15]) == "vertical_sampling_gap"
    assert one(vertical.depth_feature(vertical.depth_gradient(gapped))).status == "NO_LOCAL_SUPPORT"
    assert one(vertical.depth_feature(vertical.depth_gradient(gapped), support="all")).status == "GAPPED_SECANT_CANDIDATE"


def test_transition_layers(spark):
    row = one(diagnostics.transition_layer(profile(spark, (0, 10, 12, 20), (25, 24, 19, 18)), "thermocline"))
    assert row.gradient == -2.5 and row.diagnostic_status == "THERMOCLINE_GRADIENT_CANDIDATE" and row.feature_depth_m == 11
    assert code(diagnostics.transition_layer, profile(spark, (0, 10), (1, 2)), "halocline") == "transition_variable"


@pytest.mark.parametrize("values,depth,status", [
    ((25.1, 25.0, 24.95, 24.6, 23.5), 20 + 10 * 0.15 / 0.35, "MLD_INTERPOLATED_THRESHOLD_CROSSING"), ((25.1, 25, 24.9, 24.8, 24.5), 30, "MLD_EXACT_THRESHOLD_POINT"),
    ((24.9, 25, 25.1, 25.4, 25.7), 70 / 3, "MLD_INTERPOLATED_THRESHOLD_CROSSING"), ((25.1, 25, 24.7, 24.9, 24.5), 10 + 20 / 3, "MLD_INTERPOLATED_THRESHOLD_CROSSING"),
    ((25, 25, 25, 25, 25), None, "MLD_OPEN_AT_PROFILE_BOTTOM"), ((25, 25, None, 20, 20), None, "MLD_UNRESOLVED_INCOMPLETE_PATH"), ((25, None, 25, 20, 20), None, "REFERENCE_TEMPERATURE_UNRESOLVED"),
    ((25, 25, 25.15, 24.7, 20), None, "MLD_UNRESOLVED_NONMONOTONIC_BRACKET")])
def test_mixed_layers(spark, values, depth, status):
    for positive, order in (("down", 1), ("down", -1)):
        row = one(diagnostics.mixed_layer_depth(profile(spark, (0, 10, 20, 30, 40)[::order], values[::order], positive=positive)))
        assert row.status == status and (row.mld_depth_m is None if depth is None else abs(row.mld_depth_m - depth) < 1e-9)


OXYGEN = ("moles_of_oxygen_per_unit_mass_in_sea_water", "umol kg-1")


@pytest.mark.parametrize("values,kind,core,upper,lower", [
    ((220, 180, 80, 10, 5, 20, 80), "UNIQUE_MINIMUM", 80, (-5, 30), (1.2, 125)), ((220, 100, 5, 5, 5, 30, 100), "CONTIGUOUS_MINIMUM_PLATEAU", 60, (-6, 10), (1.4, 125)),
    ((220, 5, 60, 5, 100, 120, 130), "AMBIGUOUS_DISJOINT_MINIMA", None, None, None)])
def test_oxygen_cores(spark, values, kind, core, upper, lower):
    cube = profile(spark, (0, 20, 40, 60, 80, 100, 150), values, *OXYGEN)
    for side, want in (("upper", upper), ("lower", lower)):
        row = one(diagnostics.transition_layer(cube, f"{side}_oxycline"))
        assert row.core_type == kind and row.core_depth_m == core
        if want and not (side == "upper" and kind != "UNIQUE_MINIMUM"):
            assert abs(row.gradient - want[0]) < 1e-9 and row.feature_depth_m == want[1]


def test_oxygen_zone(spark):
    cube = profile(spark, (0, 20, 40, 60, 80, 100, 150), (220, 180, 80, 10, 5, 20, 80), *OXYGEN)
    row = one(diagnostics.oxygen_boundary(cube, 20, "umol kg-1"))
    assert row.zone_status == "THRESHOLD_ZONE_PRESENT" and abs(row.upper_boundary_depth_m - (60 - 20 / 7)) < 1e-9 and row.lower_boundary_status == "EXACT_THRESHOLD_POINT"
    assert abs(row.zone_observed_thickness_m - (100 - row.upper_boundary_depth_m)) < 1e-9
    assert abs(one(diagnostics.oxygen_boundary(cube, 0.02, "mmol kg-1")).upper_boundary_depth_m - row.upper_boundary_depth_m) < 1e-9
    assert one(diagnostics.oxygen_boundary(cube, 1, "umol kg-1")).zone_status == "THRESHOLD_ZONE_ABSENT"
    assert code(diagnostics.oxygen_boundary, cube, 1, "mg m-3") == "oxygen_unit"


# ---- sea water and geometry ----------------------------------------------------------------------

SA, CT, P = (34.7118, 34.8915, 35.0256, 34.8472, 34.7366, 34.7324), (28.8099, 28.4392, 22.7862, 10.2262, 6.8272, 4.3236), (10, 50, 125, 250, 600, 1000)
RHO = (1021.839935738108, 1022.262457966867, 1024.427195413316, 1027.790152759127, 1029.837779000189, 1032.002453224572)


def test_published_sea_water_vectors(spark):
    assert all(abs(seawater.density(*x) - r) < 1e-8 for x, r in zip(zip(SA, CT, P), RHO))
    assert abs(seawater.pressure(1000, 4) - 1007.990337692001) < 1e-8
    data = np.array([SA, CT]).T.reshape(1, 1, 6, 1, 2)
    cube = Cube.from_arrays(spark, (188.0,), (4.0,), P, (date(2020, 1, 1),), ("s", "t"), data, {"s": "g kg-1", "t": "degC"})
    cube = cube.with_(meta=cube.meta | {"vertical": {"kind": "DEPTH_LENGTH", "unit": "m", "positive": "down", "semantics": {"s": "VERTICAL_POINT", "t": "VERTICAL_POINT"}},
                                        "standard_names": {"s": "sea_water_absolute_salinity", "t": "sea_water_conservative_temperature"}})
    state = physics.thermodynamic_state(cube)
    sigma = {r.depth_idx: r.value - 1000 for r in state.df.where("variable = 'potential_density'").collect()}
    assert abs(sigma[0] - 21.797900819337656) < 1e-8 and abs(sigma[5] - 27.409748977090885) < 1e-8
    n2 = [r.value for r in physics.stratification(state).df.where("variable = 'n2'").collect()]
    assert len(n2) == 5 and all(1e-6 < v < 1e-3 for v in n2)
    # The published N2 of these casts at latitude 4 lies within the rounding of pressures taken from depth.
    row = one(diagnostics.mixed_layer_depth(state, "density_threshold"))
    assert row.status == "MLD_INTERPOLATED_THRESHOLD_CROSSING" and 10 < row.mld_depth_m < 50
    practical = cube.with_(meta=cube.meta | {"standard_names": {"s": "sea_water_practical_salinity", "t": "sea_water_conservative_temperature"}})
    assert code(physics.thermodynamic_state, practical) == "teos10_dependency_missing"


@pytest.fixture(scope="module")
def square(spark):
    cube = Cube.from_arrays(spark, (0.0, 1.0), (0.0, 1.0), (5.0, 15.0), (date(2020, 1, 1),), ("v",), np.arange(1.0, 9).reshape(2, 2, 2, 1, 1))
    return cube.with_(meta=cube.meta | {"vertical": {"kind": "DEPTH_LENGTH", "unit": "m", "positive": "down", "bounds": [[0, 10], [10, 20]]}})


def box(x0, x1, y0, y1, name="a"):
    return {"id": name, "rings": [[(x0, y0), (x1, y0), (x1, y1), (x0, y1)]]}


def test_areas_volumes_and_weights(square):
    areas = {(r.longitude, r.latitude): r.area for r in geometry.cell_area(square).collect()}
    flat = 6371010.0**2 * math.radians(1) * (math.sin(math.radians(0.5)) - math.sin(math.radians(-0.5)))
    assert abs(areas[0, 0] / flat - 1) < 5e-4
    volume = {(r.longitude, r.latitude, r.depth): r.volume for r in geometry.cell_volume(square).collect()}
    assert abs(volume[1, 1, 15.0] - areas[1, 1] * 10) < 1
    full = geometry.polygon_weights(square, [box(-0.5, 0.5, -0.5, 0.5)]).collect()
    assert len(full) == 1 and abs(full[0].fraction_cell_covered - 1) < 1e-9
    half = one(geometry.polygon_weights(square, [box(-0.5, 0.0, -0.5, 0.5)]))
    assert abs(half.fraction_cell_covered - 0.5) < 5e-5
    tiling = geometry.polygon_weights(square, [box(-0.5, 0.3, -0.5, 1.5, "l"), box(0.3, 1.5, -0.5, 1.5, "r")], "3d").collect()
    total = {}
    for r in tiling:
        total[r.cell_index, r.depth_index] = total.get((r.cell_index, r.depth_index), 0) + r.fraction_cell_covered
    assert len(total) == 8 and all(abs(v - 1) < 1e-4 for v in total.values())
    assert geometry.polygon_weights(square, [box(-0.5, 0.5, -0.5, 0.5)], include_zero=True).count() == 4


def test_masks(square):
    assert geometry.mask(square, [box(-0.5, 0.5, -0.5, 0.5)]).df.count() == 2
    assert geometry.mask(square, [box(0, 1, 0, 1)], boundary="exclude", keep="outside").df.count() == 8
    assert geometry.mask(square, [box(0, 1, 0, 1)]).df.count() == 8
    ring = {"rings": [[(-2, -2), (3, -2), (3, 3), (-2, 3)], [(-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5)]]}
    assert geometry.mask(square, [ring]).df.count() == 6
    assert code(geometry.mask, square, [box(5, 6, 5, 6)]) == "mask_no_centers"
    twice = geometry.mask(geometry.mask(square, [box(0, 1, 0, 1)]), [box(1, 2, 0, 2)], boundary="include")
    assert geometry.mask_coverage(twice) == {"n_cells": 4, "n_kept": 2, "n_removed": 2, "fraction_kept": 0.5, "fraction_removed": 0.5} and twice.df.count() == 4
    assert geometry.mask_coverage(square)["n_removed"] == 0
    assert geometry.crop_stock(square, geometry.stock_mask(square, latitude=(0.5, 2), depth=(0, 10))).df.count() == 2
    coast = {(r.longitude, r.latitude): r.distance_nm for r in geometry.coast_dist(square, [box(-1, 0, -1, 2)]).collect()}
    assert coast[0, 0] == 0 and abs(coast[1, 0] - 60.04) < 0.05


# ---- metadata, storage, plots --------------------------------------------------------------------


def test_validation_and_inspection(base):
    report = {r.check: r.status for r in checks.validate(base).collect()}
    assert len(report) >= 25 and "FAIL" not in report.values() and report["provenance_present"] == "WARN"
    twice = base.with_(df=base.df.unionByName(base.df))
    assert {r.check for r in checks.validate(twice).where("status = 'FAIL'").collect()} == {"unique_cells"}
    assert code(checks.validate, twice, strict=True) == "validation_error"
    assert {r.variable: r.n_missing for r in checks.missing(base.with_(df=base.df.where("time_idx > 0"))).collect()} == {"temperature": 12, "oxygen": 12}
    assert "3 x 2 x 2 x 4 x 2" in checks.summary(base)
    with pytest.raises(GridError):
        Cube.from_table(base.table().unionByName(base.table()))


def test_histories(base):
    a = select.crop(base, longitude=(-80, -79))
    b = select.slice_cube(a, latitude=-12.0)
    ops = b.meta["provenance"]["operations"]
    assert [o["operation"] for o in ops] == ["crop", "slice"] and [o["id"] for o in ops] == ["op_001", "op_002"]
    assert provenance.same(a.meta["provenance"], select.crop(base, longitude=(-80, -79)).meta["provenance"])
    anomaly = temporal.anomaly(base, temporal.climatology(base))
    assert list(anomaly.meta["provenance"]["lineages"]) == ["lineage_001"]
    for bad in ({"password": "x"}, {"a": float("nan")}, {"u": "https://me:pw@host/x"}, {"o": object()}):
        with pytest.raises(GridError):
            provenance.clean(bad)
    assert code(provenance.history, {"provenance": {"schema": 9}}) == "provenance_future_schema"


def test_cubes_survive_storage(base, spark, tmp_path):
    base.write(f"{tmp_path}/cube")
    back = Cube.read(spark, f"{tmp_path}/cube")
    assert (back.longitude, back.time, back.variables, back.shape) == (base.longitude, base.time, base.variables, base.shape)
    assert (back.to_numpy() == base.to_numpy()).all()


def test_calendars():
    assert calendars.ordinal(2000, 3, 1, "standard") - calendars.ordinal(2000, 2, 28, "standard") == 2
    for name in ("standard", "proleptic_gregorian", "julian", "365_day", "366_day", "360_day"):
        for y, m, d in ((1, 1, 1), (1582, 10, 15), (1900, 3, 1), (2024, 12, 30)):
            assert calendars.components(calendars.ordinal(y, m, d, name), name) == (y, m, d)
    assert code(calendars.ordinal, 1582, 10, 10, "standard") == "cf_time_reform_gap"
    assert calendars.decode([1.5], "days since 2000-01-01") == [datetime(2000, 1, 2, 12)]
    assert calendars.decode([0], "hours since 2000-01-01 00:00:00 +02:00") == [datetime(1999, 12, 31, 22)]
    x, y = calendars.decode([59, 60], "days since 2001-01-01", "360_day")
    assert str(x) == "2001-02-30" and x < y
    assert code(lambda: x + 1) == "cf_time_unsupported_operation"
    assert code(lambda: x < calendars.CalendarTime(0.0, "julian")) == "cf_time_mismatch"


@pytest.fixture()
def nc(tmp_path):
    packed = np.arange(48, dtype=np.int16).reshape(3, 2, 2, 4)
    packed[0, 0, 0, 0], packed[1, 0, 0, 0] = -32767, -32766
    oxygen = np.transpose(np.arange(48.0).reshape(3, 2, 2, 4), (3, 2, 1, 0)).copy()
    oxygen[0, 0, 0, 0] = -9999
    file = f"{tmp_path}/a.nc"
    netcdf3.write(file, {"lon": 3, "lat": 2, "depth": 2, "time": 4, "edge": 2}, {
        "lon": (("lon",), np.array([-80.0, -79, -78]), {"units": "degrees_east"}), "lat": (("lat",), np.array([-12.0, -11]), {"units": "degrees_north"}),
        "depth": (("depth",), np.array([5.0, 15]), {"units": "m", "positive": "down", "bounds": "depth_bnds"}), "time": (("time",), np.arange(4.0), {"units": "days since 2000-01-01"}),
        "depth_bnds": (("depth", "edge"), np.array([[0.0, 10], [10, 20]]), {}),
        "temperature": (("lon", "lat", "depth", "time"), packed, {"units": "degC", "_FillValue": np.int16(-32767), "missing_value": np.int16(-32766), "scale_factor": 0.5, "add_offset": 11000.0, "cell_methods": "depth: mean"}),
        "oxygen": (("time", "depth", "lat", "lon"), oxygen, {"units": "mmol m-3", "_FillValue": -9999.0}), "sst": (("lon", "lat", "time"), np.zeros((3, 2, 4), np.float32), {})}, {"Conventions": "CF-1.8"})
    return file


def test_netcdf_scan(nc, spark):
    cube = cf.cube_open(spark, nc, ["temperature", "oxygen"])
    assert cube.longitude == (-80, -79, -78) and cube.time[1] == date(2000, 1, 2) and cube.meta["vertical"]["bounds"] == [[0, 10], [10, 20]]
    got = cube.to_numpy()
    assert np.isnan(got[0, 0, 0, 0, 0]) and np.isnan(got[1, 0, 0, 0, 0]) and got[2, 1, 1, 3, 0] == 11000 + 0.5 * 47 and got[2, 1, 1, 3, 1] == 47 and np.isnan(got[0, 0, 0, 0, 1])
    assert cube.meta["vertical"]["semantics"] == {"temperature": "VERTICAL_CELL_MEAN", "oxygen": "VERTICAL_POINT"}
    assert cf.cube_open(spark, nc, ["sst"]).depth == (None,)
    assert code(cf.cube_open, spark, nc, ["sst", "oxygen"]) == "netcdf_schema" and code(cf.cube_open, spark, nc, ["salt"]) == "netcdf_missing_variable"
    assert code(cf.cube_open, spark, nc + "x") == "netcdf_file_error" and code(netcdf3.read_header, "https://host/a.nc") == "netcdf_file_error"
    header = netcdf3.read_header(nc)
    with open(nc, "ab") as f:
        f.write(b"\0")
    assert code(netcdf3.values, header, "lon") == "netcdf_changed_file"


def test_netcdf_reads_only_the_box_that_filters_leave(nc, spark):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

    reader = netcdf3._PushedReader({"path": nc, "variables": "temperature,oxygen", "roles": "lon_idx/lat_idx/depth_idx/time_idx,time_idx/depth_idx/lat_idx/lon_idx"})
    filters = [GreaterThanOrEqual(("lon_idx",), 1), LessThan(("time_idx",), 3), EqualTo(("lat_idx",), 1), In(("depth_idx",), (0, 1))]
    assert list(reader.pushFilters(filters)) == filters
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert sum(b.num_rows for b in batches) == 2 * (2 * 1 * 2 * 3)
    rows = {tuple(r.values()) for b in batches for r in b.to_pylist()}
    whole = netcdf3._Reader(dict(path=nc, variables="temperature,oxygen", roles="lon_idx/lat_idx/depth_idx/time_idx,time_idx/depth_idx/lat_idx/lon_idx"))
    every = [tuple(r.values()) for p in whole.partitions() for b in whole.read(p) for r in b.to_pylist()]
    assert rows == {r for r in every if r[0] >= 1 and r[1] == 1 and r[3] < 3}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        cube = select.crop(cf.cube_open(spark, nc, ["oxygen"]), longitude=(-79.5, -78.5))
        assert {r.value for r in cube.df.collect()} == {r[5] for r in every if r[4] == "oxygen" and r[0] == 1}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_plot_tables(base):
    flat = select.slice_cube(base, depth=0.0, time="2020-01-01", variable="temperature")
    plot = plotdata.plot_map(flat)
    assert plot.kind == "MAP_LAYER" and plot.spec["label"] == "temperature (degC)" and plot.data.count() == 6
    points = {p for s in plotdata.contour_segments(plot, 11116) for p in s}
    assert {p[0] for p in points} == {-80, -79, -78} and all(abs(y - (-12 + (5 - (x + 80)) / 10)) < 1e-9 for x, y in points)
    assert plotdata.pretty(0, 10, 5) == [2, 4, 6, 8]
    assert plotdata.hovmoller(base, "longitude", "oxygen", latitude=-12.0, depth=0.0).data.count() == 12
    assert plotdata.section(base, "oxygen", latitude=-12.0, time="2020-01-01").data.count() == 6
    assert [r.value for r in plotdata.timeseries(base, -80.0, -12.0, 0.0, ["oxygen"]).data.collect()] == [21111, 22111, 23111, 24111]
    assert code(plotdata.plot_map, base, "oxygen") == "viz_selection"


def test_entry_and_guard(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(3).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_oxygen_units_in_many_spellings():
    assert diagnostics.oxygen_family("µmol/kg") == ("amount_per_mass", 1e-6) and diagnostics.oxygen_family(" mol  L^-1 ") == ("amount_per_volume", 1e3)
    assert diagnostics.oxygen_family("mg m**-3") == ("mass_per_volume", 1e-6) and code(diagnostics.oxygen_family, "ml l-1") == "oxygen_unit"


def test_track(spark):
    frame = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 1.0, 1.0)], "o int, x double, y double")
    rows = path.along(frame, "x", "y", "o").orderBy("o").collect()
    assert rows[0].distance_km == 0 and abs(rows[2].distance_km - 2 * 111.195) < 0.05
    assert frame.select(F.count("*")).first()[0] == 3


# ---- sea water of in-situ temperature, polygons ---------------------------------------------------

T_IN_SITU = (28.7856, 28.4329, 22.8103, 10.2600, 6.8863, 4.4036)
CT_PUBLISHED = (28.809919826700281, 28.439227816091140, 22.786176893078498, 10.226189266620782, 6.827213633479988, 4.323575748610455)


def state_cube(spark, salinity, temperature, name="sea_water_temperature", unit="degC", pressures=P):
    data = np.array([salinity, temperature, pressures]).T.reshape(1, 1, len(salinity), 1, 3)
    cube = Cube.from_arrays(spark, (188.0,), (4.0,), tuple(float(p) for p in P[:len(salinity)]), (date(2020, 1, 1),), ("s", "t", "p"), data, {"s": "g kg-1", "t": unit, "p": "dbar"})
    return cube.with_(meta=cube.meta | {"vertical": {"kind": "DEPTH_LENGTH", "unit": "m", "positive": "down", "semantics": dict.fromkeys("stp", "VERTICAL_POINT")},
                                        "standard_names": {"s": "sea_water_absolute_salinity", "t": name, "p": "sea_water_pressure"}})


@pytest.mark.parametrize("unit,shift", [("degC", 0.0), ("K", 273.15)])
def test_in_situ_temperature_becomes_conservative(spark, unit, shift):
    cube = state_cube(spark, SA, [t + shift for t in T_IN_SITU], unit=unit)
    got = {r.depth_idx: r.value for r in physics.thermodynamic_state(cube, pressure="p").df.where("variable = 'conservative_temperature'").collect()}
    assert all(abs(got[k] - want) < 1e-8 for k, want in enumerate(CT_PUBLISHED))
    assert all(abs(seawater.conservative_from_potential(s, seawater.potential_from_in_situ(s, t, p)) - c) < 1e-8 for s, t, p, c in zip(SA, T_IN_SITU, P, CT_PUBLISHED))


def test_newton_steps_reach_the_limit_of_doubles():
    for s in (0.0, 5.0, 35.0, 42.0):
        for t in (-2.0, 0.0, 10.0, 30.0):
            for p in (0.0, 500.0, 4000.0, 10000.0):
                pt = seawater.potential_from_in_situ(s, t, p)
                assert abs(seawater.entropy(s, pt, 0.0) - seawater.entropy(s, t, p)) < 1e-10 and (p > 0 or abs(pt - t) < 1e-12)


@pytest.mark.parametrize("salinity,temperature,pressure,inside", [
    (35.0, -4.0, 10.0, False), (35.0, -1.8, 10.0, True), (35.0, -2.2, 600.0, True), (35.0, 30.0, 600.0, False), (35.0, 29.0, 600.0, True), (10.0, 20.0, 3000.0, False), (13.0, 20.0, 3000.0, True),
    (29.0, 5.0, 7000.0, False), (35.0, 11.0, 7000.0, False), (35.0, 5.0, 7000.0, True), (35.0, 5.0, 8001.0, False)])
def test_states_outside_the_funnel_are_refused(spark, salinity, temperature, pressure, inside):
    cube = state_cube(spark, [salinity], [temperature], "sea_water_conservative_temperature", pressures=[pressure])
    state = physics.thermodynamic_state(cube, pressure="p")
    if inside:
        assert state.df.count() == 5
    else:
        with pytest.raises(Exception, match="teos10_outside_funnel"):
            state.df.collect()


def grid_of(spark, lon, lat):
    return Cube.from_arrays(spark, lon, lat, (5.0,), (date(2020, 1, 1),), ("v",), np.ones((len(lon), len(lat), 1, 1, 1)))


def test_candidates_of_polygons_are_the_cells_of_their_boxes():
    up = [(k - 0.5, k + 0.5) for k in range(10)]
    for low, high, want in ((2.2, 4.1, (2, 5)), (2.5, 3.5, (3, 4)), (-5, -1, (0, 0)), (20, 30, (10, 10)), (-5, 30, (0, 10)), (4.4, 4.4, (4, 5))):
        assert geometry.candidate_ranges(up, low, high) == want
        assert geometry.candidate_ranges(up[::-1], low, high) == (10 - want[1], 10 - want[0])


def test_polygon_weights_make_one_row_for_each_candidate(spark):
    cube = grid_of(spark, [float(x) for x in range(40)], [float(y) for y in range(-20, 20)])
    triangle = {"id": "t", "rings": [[(10.2, 3.1), (14.9, 3.4), (12.0, 6.6)]]}
    rows = geometry.polygon_weights(cube, [triangle]).collect()
    assert abs(sum(r.overlap_area_m2 for r in rows) / geometry.polygon_area(triangle) - 1) < 1e-9 and len(rows) < 25
    every = geometry.polygon_weights(cube, [triangle], include_zero=True)
    assert every.count() == 1600 and every.where("overlap_area_m2 > 1e-6").count() == len(rows)
    lon, lat = geometry.cell_edges(cube)
    i0, i1 = geometry.candidate_ranges(lon, 10.2, 14.9)
    assert (i0, i1) == (10, 16)  # of 40 columns


@pytest.mark.parametrize("seed", range(4))
def test_overlaps_of_any_polygon_add_up(spark, seed):
    """A star with a hole, over a grid that covers it: cells add up to its area, whatever the grid."""
    r = np.random.default_rng(seed)
    angle = np.sort(r.uniform(0, 2 * np.pi, 24))
    far = r.uniform(2, 6, 24)
    outline = [(float(3 + a * np.cos(t)), float(40 + a * np.sin(t))) for a, t in zip(far, angle)]
    hole = [(float(3 + 0.7 * np.cos(t)), float(40 + 0.7 * np.sin(t))) for t in np.linspace(0, 2 * np.pi, 9)[:-1]]
    star = {"id": "s", "rings": [outline, hole]}
    for step in (1.0, 2.5):
        n = int(20 / step)
        cube = grid_of(spark, [-8 + step * k for k in range(n + 2)], [30 + step * k for k in range(n + 1)][::-1])
        rows = geometry.polygon_weights(cube, [star]).collect()
        assert abs(sum(x.overlap_area_m2 for x in rows) / geometry.polygon_area(star) - 1) < 1e-9
        assert all(abs(x.fraction_polygon_covered_by_grid - 1) < 1e-9 for x in rows)
