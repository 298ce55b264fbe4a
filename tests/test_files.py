"""Files: byte runs of selections, paired points, the writer, CF links, vertical and climatological axes."""

import builtins
import itertools
import os
from datetime import date, timedelta

import numpy as np
import pytest

from gridloom.cube import Cube
from gridloom.errors import GridError
from gridloom.operators import geometry, path, select, temporal
from gridloom.sources import cf, cf_links, cf_vertical, hyperslab, netcdf3
from gridloom.sources.cf_climatology import methods_of


def fails(code, f, *args, **kwargs):
    with pytest.raises(GridError) as e:
        f(*args, **kwargs)
    assert e.value.code == code, e.value


def axes(lon=12, lat=9, time=20, depth=None):
    out = {"lon": (("lon",), np.arange(float(lon)), {"units": "degrees_east"}), "lat": (("lat",), np.arange(float(lat)), {"units": "degrees_north"}),
           "time": (("time",), np.arange(float(time)), {"units": "days since 2000-01-01"})}
    if depth is not None:
        out["depth"] = (("depth",), 5.0 + 10 * np.arange(float(depth)), {"units": "m", "positive": "down"})
    return out


def big_file(path, dims=("time", "lat", "lon"), seed=0, **sizes):
    own = {"lon": 60, "lat": 40, "time": 50} | sizes
    data = np.random.default_rng(seed).normal(size=tuple(own[d] for d in dims))
    netcdf3.write(path, own, axes(**own) | {"v": (dims, data, {})})
    return data


class Counted:
    """Bytes that a reader fetches on the driver."""

    def __init__(self, monkeypatch):
        self.bytes, fetch = 0, hyperslab.fetch

        def counted(file, start, size):
            self.bytes += size
            return fetch(file, start, size)

        monkeypatch.setattr(hyperslab, "fetch", counted)


def run_reader(file, roles, names="v", **options):
    reader = netcdf3._Reader({"path": file, "variables": names, "roles": roles} | options)
    parts = reader.partitions()
    return parts, [r for p in parts for b in reader.read(p) for r in b.to_pylist()]


# ---- byte runs -----------------------------------------------------------------------------------


def test_inner_dimensions_are_not_read_whole(tmp_path, monkeypatch):
    file = str(tmp_path / "big.nc")
    data = big_file(file)
    counted = Counted(monkeypatch)
    _, rows = run_reader(file, "time_idx/lat_idx/lon_idx", wanted='{"lat_idx": [[3, 3, 1]], "lon_idx": [[5, 5, 1]]}')
    assert [r["raw"] for r in sorted(rows, key=lambda r: r["time_idx"])] == data[:, 3, 5].tolist()
    assert counted.bytes == 50 * 8  # of 960,000: the gap between two values is too large to be read over


def test_small_gaps_are_read_over(tmp_path, monkeypatch):
    file = str(tmp_path / "big.nc")
    data = big_file(file)
    counted = Counted(monkeypatch)
    _, rows = run_reader(file, "time_idx/lat_idx/lon_idx", wanted='{"time_idx": [[7, 7, 1]], "lon_idx": [[0, 58, 2]]}')
    assert {(r["lat_idx"], r["lon_idx"]): r["raw"] for r in rows} == {(a, b): data[7, a, b] for a in range(40) for b in range(0, 60, 2)}
    assert counted.bytes == (40 * 60 - 1) * 8


def test_blocks_are_bounded_and_whole(tmp_path, monkeypatch):
    monkeypatch.setattr(netcdf3, "BLOCK", 700)
    monkeypatch.setattr(netcdf3, "BATCH", 90)
    file = str(tmp_path / "big.nc")
    data = big_file(file, ("lon", "time", "lat"))
    parts, rows = run_reader(file, "lon_idx/time_idx/lat_idx")
    assert all(p.slab.n_values <= 700 for p in parts) and len(rows) == data.size
    assert all(data[r["lon_idx"], r["time_idx"], r["lat_idx"]] == r["raw"] for r in rows[::97])


def test_an_inner_dimension_larger_than_a_block_is_split():
    slab = hyperslab.slab(0, 8, (8_000_000, 8), [np.arange(3), np.arange(1_000_000)])
    parts = list(slab.blocks(262_144))
    assert max(p.n_values for p in parts) <= 262_144 and sum(p.n_values for p in parts) == 3_000_000


def test_paired_points_read_their_columns(tmp_path, monkeypatch):
    file = str(tmp_path / "big.nc")
    data = big_file(file, ("depth", "lat", "lon", "time"), depth=6, time=10)
    counted = Counted(monkeypatch)
    points = [[k, k] for k in range(16)]
    _, rows = run_reader(file, "depth_idx/lat_idx/lon_idx/time_idx", points=str(points), wanted='{"time_idx": [[4, 4, 1]]}')
    assert {(r["lon_idx"], r["lat_idx"], r["depth_idx"]): r["raw"] for r in rows} == {(k, k, d): data[d, k, k, 4] for k in range(16) for d in range(6)}
    assert counted.bytes == 16 * 6 * 8  # the rectangle around them has 16 times as many


def test_record_variables_interleave(tmp_path):
    """A file whose records hold two variables, written by hand: positions and values still fit."""
    file = str(tmp_path / "r.nc")
    netcdf3.write(file, {"lon": 3, "lat": 2, "time": 4}, axes(3, 2, 4) | {"v": (("time", "lat", "lon"), np.arange(24, dtype="f4").reshape(4, 2, 3), {})})
    header = netcdf3.read_header(file)
    v = header.variables["v"]
    record = netcdf3.Variable(v.name, v.dims, v.shape, {}, v.dtype, 100, True)
    spaced = netcdf3.Header(**{**header.__dict__, "record_bytes": 30})
    slab = netcdf3.slab_of(spaced, record)
    raw = np.zeros(100 + 4 * 30, dtype=np.uint8)
    for t in range(4):
        raw[100 + 30 * t:124 + 30 * t] = np.frombuffer(np.arange(6 * t, 6 * t + 6, dtype=">f4").tobytes(), np.uint8)
    other = tmp_path / "raw"
    other.write_bytes(raw.tobytes())
    with builtins.open(other, "rb") as f:
        assert hyperslab.read(f, slab, ">f4").tolist() == list(range(24))


@pytest.mark.parametrize("seed", range(6))
def test_any_selection_equals_the_array(tmp_path, seed):
    r = np.random.default_rng(seed)
    dims = [("time", "lat", "lon"), ("lon", "lat", "time"), ("lat", "time", "lon")][seed % 3]
    file = str(tmp_path / "v.nc")
    data = big_file(file, dims, seed, lon=13, lat=7, time=11)
    size = dict(zip(dims, data.shape))
    wanted = {f"{d}_idx": sorted(r.choice(size[d], r.integers(1, size[d] + 1), replace=False).tolist()) for d in dims}
    told = "{" + ", ".join(f'"{k}": {netcdf3.in_runs(v)}' for k, v in wanted.items()) + "}"
    _, rows = run_reader(file, "/".join(f"{d}_idx" for d in dims), wanted=told, gap=str(8 * int(r.integers(0, 9))))
    got = {tuple(row[f"{d}_idx"] for d in dims): row["raw"] for row in rows}
    assert got == {at: data[at] for at in itertools.product(*(wanted[f"{d}_idx"] for d in dims))}


def test_plans_tell_amplification(tmp_path):
    file = str(tmp_path / "v.nc")
    big_file(file)
    header = netcdf3.read_header(file)
    wanted = [np.arange(50), np.array([3]), np.array([5])]
    assert hyperslab.plan(netcdf3.slab_of(header, header.variables["v"], wanted)) == {"values": 50, "runs": 50, "bytes": 400, "amplification": 1.0}
    assert hyperslab.plan(netcdf3.slab_of(header, header.variables["v"], wanted), gap=10**6)["runs"] == 1
    fails("bad_block", netcdf3.slab_of, header, header.variables["v"], [np.arange(51), np.array([3]), np.array([5])])


# ---- cubes of files ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def cube_file(spark, tmp_path_factory):
    file = str(tmp_path_factory.mktemp("nc") / "cube.nc")
    r = np.random.default_rng(5)
    data = r.normal(size=(12, 9, 4, 20, 2))
    data[r.random(data.shape) < 0.1] = np.nan
    cube = Cube.from_arrays(spark, range(12), range(9), (5.0, 15.0, 25.0, 35.0), [date(2001, 1, 1) + timedelta(days=3 * k) for k in range(20)], ("a", "b"), data, {"a": "m"})
    cf.write_nc(cube, file, chunk=700)
    return file, cube, data


def test_what_is_written_is_read(spark, cube_file):
    file, cube, data = cube_file
    back = cf.cube_open(spark, file)
    assert (back.longitude, back.latitude, back.depth, back.time, back.variables, back.unit("a")) == (cube.longitude, cube.latitude, cube.depth, cube.time, cube.variables, "m")
    assert np.array_equal(back.to_numpy(), data, equal_nan=True)
    assert os.path.getsize(file) == netcdf3.read_header(file).size


def test_selections_of_selections_read_their_positions(spark, cube_file):
    file, cube, data = cube_file
    opened = select.slice_cube(cf.cube_open(spark, file), longitude=[7, 3, 5, 3], depth=[35.0, 15.0], variable="b")
    again = select.crop(select.slice_cube(opened, longitude=[4, 1, 2], by="index"), latitude=(2, 6), time=(date(2001, 1, 10), date(2001, 2, 10)))
    times = [k for k, t in enumerate(cube.time) if date(2001, 1, 10) <= t <= date(2001, 2, 10)]
    assert again.source.base["longitude"] == (3, 7, 3)  # places may repeat
    assert np.array_equal(again.to_numpy(), data[np.ix_([3, 7, 3], range(2, 7), [3, 1], times, [1])], equal_nan=True)
    assert again.with_(df=again.df).source is None


def test_pushed_filters_bound_the_read(spark, cube_file):
    file, cube, data = cube_file
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = cf.cube_open(spark, file).df.where("lon_idx in (2, 9) and lat_idx > 5 and time_idx = 7 and variable = 'a'").collect()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    got = {(r.lon_idx, r.lat_idx, r.depth_idx): r.value for r in rows if r.value is not None}
    assert got == {(a, b, c): data[a, b, c, 7, 0] for a in (2, 9) for b in (6, 7, 8) for c in range(4) if np.isfinite(data[a, b, c, 7, 0])}


@pytest.mark.parametrize("from_file", [True, False])
def test_transects_of_files_and_tables_agree(spark, cube_file, from_file):
    file, cube, data = cube_file
    own = cf.cube_open(spark, file) if from_file else cube
    places = [{"longitude": k + 0.2, "latitude": k * 0.7, "id": f"p{k}"} for k in (1, 4, 6, 4)]
    out = path.transect(own, places, cube.time[3], depth=[25.0, 5.0], keep_index=True, mode="section").collect()
    assert len(out) == 4 * 2 * 2
    for r in out:
        want = data[r.longitude_index - 1, r.latitude_index - 1, r.depth_index - 1, r.time_index - 1, r.variable_index - 1]
        assert r.value == want if np.isfinite(want) else r.value is None
        assert (r.depth, r.time, r.unit) == (cube.depth[r.depth_index - 1], cube.time[3], "m" if r.variable == "a" else None)
    by_index = path.transect(own, [{"longitude": 2, "latitude": 2}, {"longitude": 5, "latitude": 4}], 4, depth=1, variable=2, by="index", mode="horizontal").collect()
    assert [(r.longitude, r.latitude, r.match_distance_km, r.depth, r.variable) for r in by_index] == [(1.0, 1.0, 0.0, 5.0, "b"), (4.0, 3.0, 0.0, 5.0, "b")]


def test_transect_modes(cube_file):
    _, cube, _ = cube_file
    one, two = [{"longitude": 1, "latitude": 1}], [{"longitude": 1, "latitude": 1}, {"longitude": 2, "latitude": 2}]
    for places, depth, fits in ((one, "all", "profile"), (two, 5.0, "horizontal"), (two, "all", "section")):
        for mode in ("profile", "horizontal", "section"):
            if mode == fits:
                path.transect(cube, places, cube.time[0], depth=depth, mode=mode)
            else:
                fails("transect_mode", path.transect, cube, places, cube.time[0], depth=depth, mode=mode)
    fails("bad_argument", path.transect, cube, one, 1, by="index", tolerance={"depth": 1.0})
    fails("slice_outside_domain", path.transect, cube, [{"longitude": 13, "latitude": 1}], 1, by="index")


def test_a_changed_file_is_refused(spark, tmp_path):
    file = str(tmp_path / "v.nc")
    big_file(file, lon=5, lat=4, time=3)
    reader = netcdf3._Reader({"path": file, "variables": "v", "roles": "time_idx/lat_idx/lon_idx"})
    with open(file, "ab") as f:
        f.write(b"more")
    fails("netcdf_changed_file", lambda: list(reader.read(reader.partitions()[0])))
    big_file(file, lon=5, lat=4, time=4)
    fails("netcdf_schema_changed", lambda: list(reader.read(reader.partitions()[0])))
    os.remove(file)
    fails("netcdf_read_error", lambda: list(reader.read(reader.partitions()[0])))


# ---- CF links and the report ---------------------------------------------------------------------


def header_of(tmp_path, dims, variables, attributes=None):
    file = str(tmp_path / "h.nc")
    netcdf3.write(file, dims, variables, attributes)
    return netcdf3.read_header(file)


def rich(**changes):
    """dims and variables of a file with every kind of link; ``changes`` replace or add attributes by variable."""
    dims = {"lon": 3, "lat": 2, "time": 2, "nv": 2}
    area, lat_bounds = np.ones((2, 3)), np.array([[-0.5, 0.5], [0.5, 1.5]])
    variables = axes(3, 2, 2) | {"v": (("time", "lat", "lon"), np.zeros((2, 2, 3)), {"units": "K", "coordinates": "place", "cell_measures": "area: cell", "grid_mapping": "crs", "ancillary_variables": "flag", "cell_methods": "time: mean"}),
                                 "place": (("lat", "lon"), area, {}), "cell": (("lat", "lon"), area, {"units": "m2"}), "crs": ((), np.array(0.0), {"grid_mapping_name": "latitude_longitude"}),
                                 "flag": (("time", "lat", "lon"), np.zeros((2, 2, 3), dtype="i4"), {"flag_values": [0.0, 1.0], "flag_meanings": "good bad"}), "lat_bnds": (("lat", "nv"), lat_bounds, {})}
    variables["lat"][2]["bounds"] = "lat_bnds"
    for name, own in changes.items():
        d, data, a = variables[name]
        variables[name] = (d, data, {k: x for k, x in (a | own).items() if x is not None})
    return dims, variables


def test_links_resolve_and_give_roles(tmp_path):
    header = header_of(tmp_path, *rich(), {"Conventions": "CF-1.8"})
    assert {(x.source, x.attribute, x.key, x.target, x.status) for x in cf_links.links(header)} == {
        ("lat", "bounds", None, "lat_bnds", "RESOLVED"), ("v", "coordinates", None, "place", "RESOLVED"), ("v", "cell_measures", "area", "cell", "RESOLVED"),
        ("v", "grid_mapping", None, "crs", "RESOLVED"), ("v", "ancillary_variables", None, "flag", "RESOLVED")}
    own = cf_links.roles(header)
    assert own["v"] == ("data",) and own["flag"] == ("ancillary", "quality_flag") and own["lat_bnds"] == ("bounds",) and own["lat"] == ("dimension_coordinate",)
    assert cf_links.linked_variables(header) == {"place", "cell", "crs", "flag", "lat_bnds"}
    assert cf_links.summary(header).get("FAIL", 0) == 0
    assert [f.message for f in cf_links.findings(header) if f.rule == "declaration"] == ["declares CF 1.8"]


@pytest.mark.parametrize("changes,rule,severity", [
    ({"v": {"coordinates": "nowhere"}}, "coordinates_resolution", "ERROR"),
    ({"v": {"coordinates": "place place"}}, "coordinates_resolution", "ERROR"),
    ({"v": {"coordinates": "v"}}, "coordinates_resolution", "ERROR"),
    ({"v": {"cell_measures": "cell"}}, "cell_measures_resolution", "ERROR"),
    ({"v": {"cell_measures": "length: cell"}}, "cell_measures_key", "ERROR"),
    ({"cell": {"units": None}}, "cell_measures_units", "ERROR"),
    ({"crs": {"grid_mapping_name": None}}, "grid_mapping_name", "ERROR"),
    ({"place": {"coordinates": "flag"}}, "coordinates_dimensions", "ERROR"),
    ({"place": {"coordinates": "cell"}, "cell": {"coordinates": "place"}}, "link_cycle", "ERROR"),
    ({"lat": {"bounds": "place"}}, "bounds_dimensions", "ERROR"),
    ({"lat_bnds": {"units": "m"}}, "bounds_units", "ERROR"),
    ({"flag": {"flag_meanings": "good"}}, "flags_structure", "ERROR"),
    ({"lon": {"axis": "T"}}, "axis_evidence", "ERROR"),
    ({"v": {"_FillValue": "none"}}, "missing_type", "ERROR"),
    ({"v": {"valid_range": [0.0, 1.0], "valid_min": 0.0}}, "valid_range_exclusive", "ERROR"),
    ({"time": {"units": "months since 2000-01-01"}}, "time_unit_length", "WARNING"),
])
def test_each_broken_rule_is_found(tmp_path, changes, rule, severity):
    header = header_of(tmp_path, *rich(**changes))
    assert [(f.rule, f.severity) for f in cf_links.findings(header) if f.status == "FAIL"] == [(rule, severity)]


def test_forms_that_are_kept_for_later(spark, tmp_path):
    header = header_of(tmp_path, *rich(v={"grid_mapping": "crs: lat lon", "cell_methods": "time: mean (interval: 1 hr)", "actual_range": [0.0, 1.0]}))
    rows = cf_links.report(spark, header.path).where("status = 'DEFERRED'").collect()
    assert {"grid_mapping_resolution", "cell_methods_simple", "actual_range_values", "units_conform", "bounds_values"} <= {r.rule for r in rows}


# ---- vertical axes -------------------------------------------------------------------------------


def vertical(tmp_path, attributes, centres=(5.0, 15.0), bounds=((0.0, 10.0), (10.0, 20.0)), bound_attributes=None, more=None):
    dims = {"lon": 3, "lat": 2, "time": 2, "depth": len(centres), "nv": 2 if bounds is None or np.ndim(bounds) != 2 else np.shape(bounds)[1]}
    variables = axes(3, 2, 2) | {"depth": (("depth",), np.array(centres), dict(attributes) | ({"bounds": "edges"} if bounds is not None else {})),
                                 "v": (("time", "depth", "lat", "lon"), np.zeros((2, len(centres), 2, 3)), {})} | (more or {})
    if bounds is not None:
        variables["edges"] = (("depth", "nv"), np.array(bounds, dtype=float), dict(bound_attributes or {}))
    return cf_vertical.vertical_of(header_of(tmp_path, dims, variables), "depth", ["v"])


DOWN = {"units": "m", "positive": "down"}


@pytest.mark.parametrize("attributes,kind,runtime,geometry,findings", [
    (DOWN, "DEPTH_LENGTH", "VERTICAL_RUNTIME_SUPPORTED", "GEOMETRY_METRIC_BOUNDS_SUPPORTED", []),
    ({"units": "km", "positive": "down"}, "DEPTH_LENGTH", "VERTICAL_RUNTIME_SUPPORTED", "GEOMETRY_METRIC_BOUNDS_SUPPORTED", []),
    ({"units": "ft", "positive": "down"}, "DEPTH_LENGTH", "VERTICAL_UNIT_UNSUPPORTED", "GEOMETRY_UNIT_UNSUPPORTED", ["VERTICAL_BOUNDS_UNIT_INCOMPATIBLE"]),
    ({"units": "m", "positive": "up"}, "HEIGHT_LENGTH", "VERTICAL_INTERPRETABLE_ONLY", "GEOMETRY_NON_LENGTH_VERTICAL", []),
    ({"units": "m"}, "UNKNOWN_VERTICAL", "VERTICAL_UNRESOLVED", "GEOMETRY_NON_LENGTH_VERTICAL", ["VERTICAL_POSITIVE_REQUIRED"]),
    ({"units": "m", "positive": "sideways"}, "UNKNOWN_VERTICAL", "VERTICAL_UNRESOLVED", "GEOMETRY_NON_LENGTH_VERTICAL", ["VERTICAL_POSITIVE_REQUIRED", "VERTICAL_POSITIVE_INVALID"]),
    ({"units": "m", "standard_name": "depth"}, "DEPTH_LENGTH", "VERTICAL_CONFLICT", "GEOMETRY_VALID", ["VERTICAL_POSITIVE_REQUIRED"]),
    ({"units": "m", "standard_name": "depth", "positive": "up"}, "DEPTH_LENGTH", "VERTICAL_CONFLICT", "GEOMETRY_VALID", ["VERTICAL_STANDARD_NAME_POSITIVE_CONFLICT", "VERTICAL_SEMANTIC_CONFLICT"]),
    ({"units": "m", "standard_name": "height", "positive": "down"}, "DEPTH_LENGTH", "VERTICAL_CONFLICT", "GEOMETRY_VALID", ["VERTICAL_STANDARD_NAME_POSITIVE_CONFLICT", "VERTICAL_SEMANTIC_CONFLICT"]),
    ({"units": "dbar"}, "PRESSURE", "VERTICAL_INTERPRETABLE_ONLY", "GEOMETRY_NON_LENGTH_VERTICAL", []),
    ({"units": "hPa", "positive": "up"}, "PRESSURE", "VERTICAL_INTERPRETABLE_ONLY", "GEOMETRY_NON_LENGTH_VERTICAL", []),
    ({"units": "level", "positive": "up"}, "DIMENSIONLESS_GENERIC", "VERTICAL_INTERPRETABLE_ONLY", "GEOMETRY_NON_LENGTH_VERTICAL", []),
    ({"units": "1", "standard_name": "ocean_sigma_coordinate"}, "PARAMETRIC", "VERTICAL_PARAMETRIC_DEFERRED", "GEOMETRY_PARAMETRIC_DEFERRED", []),
    ({"positive": "down"}, "UNKNOWN_VERTICAL", "VERTICAL_UNRESOLVED", "GEOMETRY_NON_LENGTH_VERTICAL", ["VERTICAL_UNITS_MISSING"]),
    ({"positive": "down", "standard_name": "depth"}, "DEPTH_LENGTH", "VERTICAL_UNIT_UNSUPPORTED", "GEOMETRY_UNIT_UNSUPPORTED", ["VERTICAL_UNITS_MISSING"]),
    ({"units": "furlong", "positive": "down"}, "UNKNOWN_VERTICAL", "VERTICAL_UNRESOLVED", "GEOMETRY_NON_LENGTH_VERTICAL", []),
])
def test_kinds_of_vertical_axes(tmp_path, attributes, kind, runtime, geometry, findings):
    got = vertical(tmp_path, attributes)
    assert (got["found"], got["runtime"], got["geometry"], got["findings"]) == (kind, runtime, geometry, findings)
    assert (got["kind"] == "DEPTH_LENGTH") == (runtime == "VERTICAL_RUNTIME_SUPPORTED")


@pytest.mark.parametrize("bounds,attributes,status,geometry", [
    (None, {}, "BOUNDS_MISSING", "GEOMETRY_NO_BOUNDS"),
    ([[0, 10, 20], [10, 20, 30]], {}, "BOUNDS_INVALID_SHAPE", "GEOMETRY_INVALID_SHAPE"),
    ([[0, 10], [10, np.nan]], {}, "BOUNDS_NONFINITE", "GEOMETRY_NONFINITE"),
    ([[0, 10], [15, 15]], {}, "BOUNDS_NONPOSITIVE", "GEOMETRY_NONPOSITIVE"),
    ([[0, 4], [10, 20]], {}, "BOUNDS_CENTRE_OUTSIDE", "GEOMETRY_CENTRE_OUTSIDE"),
    ([[0, 11], [10, 20]], {}, "BOUNDS_OVERLAP", "GEOMETRY_OVERLAP"),
    ([[0, 10], [10, 20]], {"units": "dbar"}, "BOUNDS_UNIT_INCOMPATIBLE", "GEOMETRY_UNIT_UNSUPPORTED"),
    ([[0, 10], [10, 20]], {"units": "m"}, "BOUNDS_VALID", "GEOMETRY_METRIC_BOUNDS_SUPPORTED"),
    ([[10, 0], [20, 10]], {}, "BOUNDS_VALID", "GEOMETRY_METRIC_BOUNDS_SUPPORTED"),
])
def test_bounds_of_vertical_axes(tmp_path, bounds, attributes, status, geometry):
    got = vertical(tmp_path, DOWN, bounds=bounds, bound_attributes=attributes)
    assert (got["bounds_status"], got["geometry"]) == (status, geometry) and (status == "BOUNDS_VALID") == ("bounds" in got)


def test_order_and_units_of_bounds(tmp_path):
    assert [vertical(tmp_path, DOWN, c, None)["order"] for c in ((5.0,), (1.0, 2.0), (2.0, 1.0), (1.0, 1.0), (1.0, 3.0, 2.0))] == ["SINGLETON", "INCREASING", "DECREASING", "DUPLICATE", "NONMONOTONIC"]
    assert vertical(tmp_path, DOWN, (1.0, 3.0, 2.0), None)["findings"] == ["VERTICAL_COORDINATE_NOT_MONOTONIC"]
    got = vertical(tmp_path, {"units": "km", "positive": "down"}, (0.005, 0.015), ((0.0, 10.0), (10.0, 30.0)), {"units": "m"})
    assert np.allclose(got["bounds"], [[0, 0.01], [0.01, 0.03]]) and got["contiguous"]
    assert not vertical(tmp_path, DOWN, bounds=((0.0, 10.0), (12.0, 20.0)))["contiguous"]
    assert vertical(tmp_path, {"units": "dbar"})["positive"] == "down"


def test_formula_terms(tmp_path):
    sigma = {"units": "1", "standard_name": "ocean_sigma_coordinate"}
    more = {"eta": (("lat", "lon"), np.zeros((2, 3)), {}), "bottom": (("lat", "lon"), np.zeros((2, 3)), {})}
    terms = "sigma: depth eta: eta depth: bottom"
    got = lambda own, bounds=None, theirs=None: vertical(tmp_path, own, bounds=bounds, bound_attributes=theirs, more=more)["formula"]
    edges = ((0.0, 10.0), (10.0, 20.0))
    assert got(sigma) == "FORMULA_TERMS_ABSENT"
    assert got(DOWN | {"formula_terms": terms}) == "FORMULA_TERMS_UNRECOGNIZED_STANDARD_NAME"
    assert got(sigma | {"formula_terms": "sigma: depth eta: nowhere"}) == "PARAMETRIC_REFERENCES_UNRESOLVED"
    assert got(sigma | {"formula_terms": terms}) == "PARAMETRIC_STRUCTURALLY_RECOGNIZED"
    assert got(sigma | {"formula_terms": terms}, edges) == "PARAMETRIC_BOUNDS_FORMULA_TERMS_MISSING"
    assert got(sigma | {"formula_terms": terms}, edges, {"formula_terms": "sigma: edges eta: eta"}) == "PARAMETRIC_BOUNDS_FORMULA_TERMS_MISMATCH"
    assert got(sigma | {"formula_terms": terms}, edges, {"formula_terms": "sigma: edges eta: eta depth: nowhere"}) == "PARAMETRIC_BOUNDS_REFERENCES_UNRESOLVED"
    assert got(sigma | {"formula_terms": terms}, edges, {"formula_terms": "sigma: edges eta: eta depth: bottom"}) == "PARAMETRIC_BOUNDS_STRUCTURALLY_RECOGNIZED"


# ---- climatological time -------------------------------------------------------------------------

OVER_YEARS = "time: mean within years time: mean over years"


def climatology(tmp_path, spark, bounds=((0.0, 3650.0), (31.0, 3681.0)), time=None, methods=OVER_YEARS, bound_attributes=None, attributes=None, centres=(1800.0, 1840.0), calendar=None):
    dims = {"lon": 3, "lat": 2, "time": 2, "nv": np.shape(bounds)[1]}
    own = {"units": "days since 1990-01-01", "climatology": "span"} | (time or {}) | ({"calendar": calendar} if calendar else {})
    variables = axes(3, 2, 2) | {"time": (("time",), np.array(centres), own), "v": (("time", "lat", "lon"), np.ones((2, 2, 3)), {"cell_methods": methods} if methods else {}),
                                 "span": (("time", "nv"), np.array(bounds), dict(bound_attributes or {}))}
    return cf.cube_open(spark, header_of(tmp_path, dims, variables, attributes).path)


def test_climatological_files_carry_their_intervals(tmp_path, spark):
    cube = climatology(tmp_path, spark, attributes={"time_coverage_start": "1990-01-01"})
    told = cube.meta["climatology"]
    assert cube.variables == ("v",) and cube.meta["chronology"] == "climatological"
    assert told["start"] == ["1990-01-01", "1990-02-01"] and told["end"][0] == "1999-12-30" and told["methods"] == {"v": OVER_YEARS}
    later = select.slice_cube(cube, time=cube.time[1])
    assert later.meta["climatology"]["start"] == ["1990-02-01"] and later.meta["climatology"]["raw"] == [[31.0, 3681.0]] and later.df.where("value = 1").count() == 6
    for f, args in ((temporal.aggregate_time, ("month",)), (temporal.climatology, ("month",)), (temporal.trend, ())):
        fails("climatological_operation_error", f, later, *args)
    fails("climatological_operation_error", temporal.aggregate_time, cube, "month")
    assert climatology(tmp_path, spark, calendar="noleap").meta["climatology"]["start"][1].startswith("1990-02-01")


@pytest.mark.parametrize("changes", [
    {"time": {"bounds": "span"}}, {"time": {"climatology": "nowhere"}}, {"time": {"climatology": ""}}, {"bound_attributes": {"scale_factor": 2.0}},
    {"bounds": ((0.0, 1.0, 2.0), (1.0, 2.0, 3.0))}, {"bounds": ((10.0, 3650.0), (31.0, 31.0))}, {"bounds": ((0.0, np.inf), (31.0, 3681.0))}, {"centres": (1800.0, 9000.0)},
    {"methods": None}, {"methods": "time: mean"}, {"methods": "time: mean within years"}, {"methods": "time: mean within days time: mean over days"}, {"attributes": {"time_coverage_start": "1955-01-01"}}])
def test_open_climatologies_are_refused(tmp_path, spark, changes):
    fails("climatology_semantics_error", climatology, tmp_path, spark, **changes)


def test_steps_of_cell_methods():
    assert methods_of("area: mean time: Maximum within days time: mean over days") == [("area", "mean", None), ("time", "maximum", "within days"), ("time", "mean", "over days")]
    assert methods_of(None) == []


def test_small_helpers():
    assert netcdf3.in_runs([0, 1, 2, 5, 8, 11, 20]) == [[0, 2, 1], [5, 11, 3], [20, 20, 1]]
    assert hyperslab.byte_runs(np.zeros(0, dtype=np.int64), 8)[0].tolist() == []


def test_what_is_refused_before_anything_is_read(spark, cube_file, tmp_path):
    file, cube, _ = cube_file
    opened = cf.cube_open(spark, file)
    fails("netcdf_read_only", cf.write_nc, opened, file)
    fails("extract_size", select.extract, opened, max_rows=10_000)
    assert select.extract(opened, longitude=1.0, latitude=2.0, time=cube.time[0], max_rows=8).count() == 8
    fails("bad_storage", cf.write_nc, climatology(tmp_path, spark, calendar="360_day"), str(tmp_path / "out.nc"))
    twice = header_of(tmp_path, {"lon": 3, "lat": 2, "time": 2}, axes(3, 2, 2) | {"v": (("time", "lat", "lon", "lon"), np.zeros((2, 2, 3, 3)), {})})
    fails("netcdf_permutation_error", cf.cube_open, spark, twice.path)
    fails("mask_existing", geometry.mask, cube.with_(meta=cube.meta | {"mask": {"masks": [{"keep": "perhaps"}]}}), [{"id": "p", "rings": [[(0, 0), (5, 0), (5, 5)]]}])


def test_a_grid_too_large_to_number(cube_file):
    class Huge(Cube):
        @property
        def shape(self):
            return 2**16, 2**16, 2**16, 2**16, 1

    _, cube, _ = cube_file
    fails("size_overflow", Huge(cube.df, cube.longitude, cube.latitude, cube.depth, cube.time, cube.variables).cells)
