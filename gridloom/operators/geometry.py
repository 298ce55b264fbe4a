"""Grid geometry: cell areas and volumes, masks, polygon weights and distances to a coast.

Polygons are dicts {"id": ..., "rings": [[(lon, lat), ...], ...]}: the first ring of a polygon is its
outline, others are holes; a multipolygon is {"id": ..., "polygons": [rings, ...]}. Edges of cells and
polygons are great circles for areas, and straight in longitude and latitude for masks.

All of it depends on the longitude and latitude axes alone. Tables of cells are made as distributed
frames (a range of positions); exact clipping runs in tasks over the columns of cells that a polygon's box
covers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.cube import Cube
from gridloom.errors import require
from gridloom.operators.provenance import recorded

RADIUS_M = 6_371_010.0
NAUTICAL_MILES = 0.000539957


def parts(polygon: dict) -> list[list[list[tuple[float, float]]]]:
    """Rings of each part of a polygon, closed points dropped; malformed ones are refused."""
    found = polygon.get("polygons") or [polygon["rings"]]
    out = []
    for rings in found:
        clean = []
        for ring in rings:
            points = [(float(x), float(y)) for x, y in ring]
            if len(points) > 1 and points[0] == points[-1]:
                points = points[:-1]
            require(len(points) >= 3, "mask_type", "a ring has three points at least")
            require(all(math.isfinite(x) and math.isfinite(y) and -90 <= y <= 90 for x, y in points), "mask_type", "ring coordinates are finite degrees")
            require(all(abs(a[0] - b[0]) <= 180 for a, b in zip(points, points[1:] + points[:1])), "mask_type", "an edge spans more than 180 degrees")
            clean.append(points)
        out.append(clean)
    return out


# ---- masks ---------------------------------------------------------------------------------------


def _ring_tests(x: np.ndarray, y: np.ndarray, ring: list[tuple[float, float]]) -> np.ndarray:
    """For each point 1 inside, 0 on the boundary, -1 outside; even-odd rule in the plane."""
    inside, edge = np.zeros(len(x), dtype=bool), np.zeros(len(x), dtype=bool)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        cross = (x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)
        within = (min(x1, x2) <= x) & (x <= max(x1, x2)) & (min(y1, y2) <= y) & (y <= max(y1, y2))
        edge |= within & (np.abs(cross) <= 1e-12 * max(1.0, abs(x2 - x1), abs(y2 - y1)))
        if y1 != y2:
            inside ^= ((y1 > y) != (y2 > y)) & (x < x1 + (y - y1) * (x2 - x1) / (y2 - y1))
    return np.where(edge, 0, np.where(inside, 1, -1))


def covers(polygon: dict, x: np.ndarray, y: np.ndarray, boundary: str) -> np.ndarray:
    """Whether points lie in a polygon; points on an outline or a hole's edge count if ``boundary`` is include."""
    found = np.zeros(len(x), dtype=bool)
    for outline, *holes in parts(polygon):
        own = _ring_tests(x, y, outline)
        here = own > 0
        for hole in holes:
            test = _ring_tests(x, y, hole)
            here &= (test < 0) | (test == 0) & (boundary == "include")
        found |= here | (own == 0) & (boundary == "include")
    return found


#: Kept positions up to this number (8 bytes each) are broadcast; more are joined by a shuffle.
_BROADCAST_PLACES = 1_000_000


def _kept_places(cube: Cube, masks: list[dict]) -> DataFrame:
    """lon_idx and lat_idx of the places that all masks keep, tested in Arrow batches over the places."""
    longitude, latitude = np.array(cube.longitude), np.array(cube.latitude)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy()
            i, j = at % len(longitude), at // len(longitude)
            kept = np.ones(len(at), dtype=bool)
            for m in masks:
                inside = np.zeros(len(at), dtype=bool)
                for polygon in m["polygons"]:
                    inside |= covers(polygon, longitude[i], latitude[j], m["boundary"])
                kept &= inside == (m["keep"] == "inside")
            yield pa.RecordBatch.from_pydict({"lon_idx": pa.array(i[kept], pa.int32()), "lat_idx": pa.array(j[kept], pa.int32())})

    return cube.spark.range(len(longitude) * len(latitude)).mapInArrow(run, "lon_idx int, lat_idx int")


def mask(cube: Cube, polygons: list[dict], keep: str = "inside", boundary: str = "include") -> Cube:
    """Keep cells whose centre lies inside (or outside) the union of polygons; others become missing.

    Meets an earlier mask by AND. It is an error if nothing lies inside where inside is kept. The
    metadata holds the masks themselves and how many places they keep, not the places.
    """
    require(keep in ("inside", "outside") and boundary in ("include", "exclude"), "bad_argument", "keep is inside or outside, boundary include or exclude")
    new = {"keep": keep, "boundary": boundary, "polygons": [{"polygons": parts(p)} for p in polygons]}
    if keep == "inside":
        require(not _kept_places(cube, [new]).isEmpty(), "mask_no_centers", "no cell centre lies inside")
    earlier = cube.meta.get("mask")
    sound = earlier is None or isinstance(earlier, dict) and isinstance(earlier.get("masks"), (list, tuple)) and all(
        isinstance(m, dict) and m.get("keep") in ("inside", "outside") and m.get("boundary") in ("include", "exclude") and m.get("polygons") for m in earlier["masks"])
    require(sound, "mask_existing", "the cube's earlier mask is not one that this function made")
    masks = [*(earlier["masks"] if earlier else ()), new]
    places = _kept_places(cube, masks)
    n = places.count()
    meta = {k: v for k, v in cube.meta.items() if k not in ("climatology", "anomaly")} | {"mask": {"masks": masks, "n_kept": n}}
    if "vertical" in meta:
        meta["vertical"] = meta["vertical"] | {"pending": True}
    df = cube.df.join(F.broadcast(places) if n <= _BROADCAST_PLACES else places, ["lon_idx", "lat_idx"], "left_semi").select(*cube.df.columns)
    return recorded(cube.with_(df=df, meta=meta), "mask", {"keep": keep, "boundary": boundary, "polygons": len(polygons)})


def mask_coverage(cube: Cube) -> dict:
    """Counts and fractions of a masked cube's places."""
    n = len(cube.longitude) * len(cube.latitude)
    kept = cube.meta["mask"]["n_kept"] if "mask" in cube.meta else n
    return {"n_cells": n, "n_kept": kept, "n_removed": n - kept, "fraction_kept": kept / n, "fraction_removed": 1 - kept / n}


def stock_mask(cube: Cube, latitude: tuple[float, float] | None = None, distance: tuple[float, float] | None = None, depth: tuple[float, float] | None = None,
               distances: DataFrame | None = None) -> DataFrame:
    """lon_idx, lat_idx and depth_idx of positions inside closed ranges of latitude, distance to the coast
    (``distances``: lon_idx, lat_idx, distance_nm) and depth."""
    require(distance is None or distances is not None, "bad_argument", "a distance range needs the distances")
    nx, ny = len(cube.longitude), len(cube.latitude)
    at = F.col("id")
    kept = cube.spark.range(nx * ny * len(cube.depth)).select(
        F.pmod(at, F.lit(nx)).cast("int").alias("lon_idx"), F.pmod(F.floor(at / nx), F.lit(ny)).cast("int").alias("lat_idx"), F.floor(at / (nx * ny)).cast("int").alias("depth_idx"))
    for name, index, limits in (("latitude", "lat_idx", latitude), ("depth", "depth_idx", depth)):
        if limits is not None:
            kept = kept.join(F.broadcast(cube.axis(name).where(F.col(name).between(*limits)).select(index)), index, "left_semi")
    if distance is not None:
        kept = kept.join(distances.where(F.col("distance_nm").between(*distance)), ["lon_idx", "lat_idx"], "left_semi")
    return kept.select("lon_idx", "lat_idx", "depth_idx")


def crop_stock(cube: Cube, kept: DataFrame) -> Cube:
    """Apply a stock mask: values only at kept positions, the shape and all metadata stay."""
    n = kept.count()
    table = F.broadcast(kept) if n <= _BROADCAST_PLACES else kept
    return recorded(cube.with_(df=cube.df.join(table, ["lon_idx", "lat_idx", "depth_idx"], "left_semi").select(*cube.df.columns)), "crop_stock", {"cells": n})


# ---- cells ---------------------------------------------------------------------------------------


def interfaces(centres: tuple[float, ...], bounds: list | None, axis: str) -> list[tuple[float, float]]:
    """Lower and upper edge of each cell: given, or half way between centres."""
    if bounds is not None:
        return [tuple(sorted(map(float, b))) for b in bounds]
    require(len(centres) > 1, "geometry_bounds", f"one {axis} needs explicit bounds")
    steps = [b - a for a, b in zip(centres, centres[1:])]
    require(all(s > 0 for s in steps) or all(s < 0 for s in steps), "geometry_bounds", f"{axis} is not strictly monotonic")
    mids = [(a + b) / 2 for a, b in zip(centres, centres[1:])]
    edges = [centres[0] - (mids[0] - centres[0]), *mids, centres[-1] + (centres[-1] - mids[-1])]
    return [tuple(sorted(e)) for e in zip(edges, edges[1:])]


def cell_edges(cube: Cube, lon_bounds: list | None = None, lat_bounds: list | None = None) -> tuple[list, list]:
    lon, lat = interfaces(cube.longitude, lon_bounds, "longitude"), interfaces(cube.latitude, lat_bounds, "latitude")
    lat = [(max(-90.0, a), min(90.0, b)) for a, b in lat]
    require(all(b - a < 180 for a, b in lon), "geometry_bounds", "a cell is 180 degrees wide or wider")
    return lon, lat


def _places(cube: Cube) -> DataFrame:
    n = len(cube.longitude)
    return cube.spark.range(n * len(cube.latitude)).select((F.col("id") % n).cast("int").alias("lon_idx"), F.floor(F.col("id") / n).cast("int").alias("lat_idx"))


def _with_edges(cube: Cube, places: DataFrame, lon: list, lat: list) -> DataFrame:
    """``places`` with the edges of their cells, from tables as long as the axes."""
    for name, index, edges in (("lon", "lon_idx", lon), ("lat", "lat_idx", lat)):
        table = cube.spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(edges)], f"{index} int, {name}_min double, {name}_max double")
        places = places.join(F.broadcast(table), index)
    return places


def _excess(lon_min: Column, lon_max: Column, lat_min: Column, lat_max: Column) -> Column:
    """Spherical excess of a quadrilateral whose four edges are great circles: the excess of the figure
    between the equator and an edge is 2 atan(tan(dlon/2) * sin((a+b)/2) / cos((a-b)/2))."""
    half = F.tan(F.radians(lon_max - lon_min) / 2)
    band = lambda y: 2 * F.atan(half * F.sin(F.radians(y)))
    return band(lat_max) - band(lat_min)


def cell_area(cube: Cube, unit: str = "m2", lon_bounds: list | None = None, lat_bounds: list | None = None) -> DataFrame:
    """longitude, latitude and area of every grid cell; cell edges are great circles."""
    require(unit in ("m2", "km2"), "bad_argument", "unit is m2 or km2")
    lon, lat = cell_edges(cube, lon_bounds, lat_bounds)
    rows = _with_edges(cube, _places(cube), lon, lat)
    area = F.abs(_excess(*[F.col(c) for c in ("lon_min", "lon_max", "lat_min", "lat_max")])) * F.lit(RADIUS_M**2 * (1e-6 if unit == "km2" else 1.0))
    return cube.located(rows.select("lon_idx", "lat_idx", area.alias("area")), ("longitude", "latitude"))


def _thickness(cube: Cube, depth_bounds: list | None, unit: str) -> list[float]:
    require(unit in ("native", "m", "km"), "bad_argument", "unit is native, m or km")
    v = cube.meta.get("vertical") or {}
    require(not v.get("pending") or depth_bounds is not None, "geometry_bounds", "the depth bounds are no longer certain")
    bounds = depth_bounds if depth_bounds is not None else v.get("bounds")
    require(bounds is not None and len(bounds) == len(cube.depth), "geometry_bounds", "thickness needs explicit depth bounds")
    cells = sorted(tuple(sorted(map(float, b))) for b in bounds)
    require(all(a[1] <= b[0] + 1e-9 for a, b in zip(cells, cells[1:])) and all(b > a for a, b in cells), "geometry_bounds", "depth cells overlap or are empty")
    factor = 1.0
    if unit != "native":
        require(v.get("unit") in ("m", "km"), "geometry_unit", "the depth unit is not known")
        factor = (1000.0 if v["unit"] == "km" else 1.0) * (0.001 if unit == "km" else 1.0)
    return [abs(b[1] - b[0]) * factor for b in bounds]


def layer_thickness(cube: Cube, depth_bounds: list | None = None, unit: str = "native") -> DataFrame:
    """depth and thickness of every layer; bounds are never inferred from centres."""
    sizes = _thickness(cube, depth_bounds, unit)
    return cube.spark.createDataFrame(list(zip(cube.depth, sizes)), "depth double, thickness double")


def cell_volume(cube: Cube, depth_bounds: list | None = None, unit: str = "m3", lon_bounds: list | None = None, lat_bounds: list | None = None) -> DataFrame:
    """longitude, latitude, depth and volume of every cell: area times thickness."""
    require(unit in ("m3", "km3"), "bad_argument", "unit is m3 or km3")
    sizes = _thickness(cube, depth_bounds, "m")
    lon, lat = cell_edges(cube, lon_bounds, lat_bounds)
    rows = _with_edges(cube, _places(cube), lon, lat)
    area = F.abs(_excess(*[F.col(c) for c in ("lon_min", "lon_max", "lat_min", "lat_max")])) * F.lit(RADIUS_M**2 * (1e-9 if unit == "km3" else 1.0))
    layer = F.posexplode(F.array(*[F.lit(s) for s in sizes]))
    out = rows.select("lon_idx", "lat_idx", area.alias("area"), layer.alias("depth_idx", "thickness"))
    return cube.located(out.select("lon_idx", "lat_idx", "depth_idx", (F.col("area") * F.col("thickness")).alias("volume")), ("longitude", "latitude", "depth"))


# ---- polygon weights -----------------------------------------------------------------------------


def _unit(lon: float, lat: float) -> tuple[float, float, float]:
    a, b = math.radians(lon), math.radians(lat)
    return math.cos(b) * math.cos(a), math.cos(b) * math.sin(a), math.sin(b)


def _cross(a, b):
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def cut(points: np.ndarray, normal: np.ndarray) -> np.ndarray:
    """The part of a figure (unit vectors) on the positive side of a great circle: all its edges at once."""
    if not len(points):
        return points
    side = points @ normal
    after, inside = np.roll(side, -1), side >= 0
    crosses = inside != (after >= 0)
    if inside.all():
        return points
    weight = np.where(crosses, side / np.where(crosses, side - after, 1.0), 0.0)
    met = points + weight[:, None] * (np.roll(points, -1, axis=0) - points)
    met /= np.maximum(np.linalg.norm(met, axis=1), 1e-300)[:, None]
    # Each point is followed by where its edge meets the circle.
    both, kept = np.stack([points, met], axis=1).reshape(-1, 3), np.stack([inside, crosses], axis=1).ravel()
    out = both[kept]
    return out if len(out) > 2 else out[:0]


def figure_area(points: np.ndarray) -> float:
    """Area of a figure of great circles on the unit sphere: the sum of its fan of triangles."""
    if len(points) < 3:
        return 0.0
    a, b, c = points[0], points[1:-1], points[2:]
    return abs(float(2 * np.arctan2(np.cross(b, c) @ a, 1 + b @ a + (b * c).sum(axis=1) + c @ a).sum()))


def _ring(points: list) -> np.ndarray:
    return np.array([_unit(*p) for p in points])


def strip_overlaps(rings: list[tuple[np.ndarray, int]], x0: float, x1: float, rows: list[tuple[float, float]]) -> np.ndarray:
    """Overlap (on the unit sphere) of a polygon with each cell of one column of cells: the polygon's rings
    (with the sign of their area) are cut by the column's two meridians once, and that by each cell's ends."""
    west, east = np.array(_unit(x0 + 90, 0.0)), np.array(_unit(x1 - 90, 0.0))
    strips = [(piece, sign) for ring, sign in rings if len(piece := cut(cut(ring, west), east))]
    out = np.zeros(len(rows))
    if strips:
        for k, (y0, y1) in enumerate(rows):
            south = np.array(_cross(_unit(x0, y0), _unit(x1, y0)))
            north = np.array(_cross(_unit(x1, y1), _unit(x0, y1)))
            out[k] = sum(sign * figure_area(cut(cut(piece, south), north)) for piece, sign in strips)
    return out


def polygon_area(polygon: dict) -> float:
    """Area in m2, great-circle edges, holes taken off."""
    total = 0.0
    for rings in parts(polygon):
        sizes = [figure_area(_ring(ring)) for ring in rings]
        total += sizes[0] - sum(sizes[1:])
    return total * RADIUS_M**2


def candidate_ranges(edges: list[tuple[float, float]], low: float, high: float) -> tuple[int, int]:
    """First position, and the one after the last, of the cells of an axis that overlap a range: a binary search
    in the axis' edges, whichever way it runs."""
    starts, ends = np.array([a for a, _ in edges]), np.array([b for _, b in edges])
    if len(edges) > 1 and starts[0] > starts[-1]:
        first, last = candidate_ranges(edges[::-1], low, high)
        return len(edges) - last, len(edges) - first
    return int(np.searchsorted(ends, low, side="right")), int(np.searchsorted(starts, high, side="left"))


def polygon_weights(cube: Cube, polygons: list[dict], dimension: str = "2d", depth_bounds: list | None = None, include_zero: bool = False,
                    lon_bounds: list | None = None, lat_bounds: list | None = None) -> DataFrame:
    """Overlap of each polygon with each cell: areas, the share of the cell covered, and how much of the
    polygon the grid covers. ``3d`` adds layers and volumes. ``include_zero`` keeps pairs without overlap.

    A polygon's candidates are the cells in the range of positions that its box covers, found by binary
    search; no other pair is made. Each column of candidates is one task's row: the polygon is cut to the
    column once, then to its cells.
    """
    require(dimension in ("2d", "3d"), "bad_argument", "dimension is 2d or 3d")
    require(bool(polygons), "bad_argument", "there are no polygons")
    lon, lat = cell_edges(cube, lon_bounds, lat_bounds)
    shapes = [parts(p) for p in polygons]
    rings = [[(_ring(ring), 1 if k == 0 else -1) for part in s for k, ring in enumerate(part)] for s in shapes]
    rows, columns = [], []
    for i, (p, s) in enumerate(zip(polygons, shapes)):
        rows.append((i, str(p.get("id", i + 1)), polygon_area(p)))
        if include_zero:
            columns.append((i, 0, len(lon), 0, len(lat)))
            continue
        x, y = [x for part in s for x, _ in part[0]], [y for part in s for _, y in part[0]]
        # Great-circle edges bulge beyond the box of their ends, by less than 2 degrees for edges up to 40 degrees.
        margin = 0.0 if max(x) == min(x) else max(0.1, (max(x) - min(x)) ** 2 / 400)
        columns.append((i, *candidate_ranges(lon, min(x), max(x)), *candidate_ranges(lat, max(-90.0, min(y) - margin), min(90.0, max(y) + margin))))
    spark = cube.spark
    features = F.broadcast(spark.createDataFrame(rows, "feature int, feature_id string, polygon_area_m2 double"))
    wanted = spark.createDataFrame([c for c in columns if c[1] < c[2] and c[3] < c[4]], "feature int, i0 int, i1 int, j0 int, j1 int")
    wanted = wanted.select("feature", "j0", "j1", F.explode(F.sequence("i0", F.col("i1") - 1)).alias("lon_idx")).repartition("feature", "lon_idx")

    def overlaps(batches: Iterator) -> Iterator:
        for frame in batches:
            for feature, j0, j1, i in frame.itertuples(index=False):
                found = strip_overlaps(rings[feature], *lon[i], lat[j0:j1]) * RADIUS_M**2
                yield pd.DataFrame({"feature": np.int32(feature), "lon_idx": np.int32(i), "lat_idx": np.arange(j0, j1, dtype=np.int32), "overlap_area_m2": found})

    area = F.abs(_excess(*[F.col(c) for c in ("lon_min", "lon_max", "lat_min", "lat_max")])) * F.lit(RADIUS_M**2)
    pairs = _with_edges(cube, wanted.mapInPandas(overlaps, "feature int, lon_idx int, lat_idx int, overlap_area_m2 double"), lon, lat)
    got = pairs.withColumn("cell_area_m2", area).join(features, "feature")
    share = F.col("overlap_area_m2") / F.col("cell_area_m2")
    sound = F.when((share > 1 + 1e-10 * 1e4) | (share < -1e-6), F.raise_error("geometry_precision: an overlap exceeds its cell").cast("double")).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)))
    got = got.withColumn("fraction_cell_covered", sound)
    # Doubles hold areas on the unit sphere to about 1e-16: less than 1e-11 of a cell is rounding.
    got = got if include_zero else got.where("overlap_area_m2 > 1e-11 * cell_area_m2")
    sums = F.broadcast(got.groupBy("feature").agg(F.sum("overlap_area_m2").alias("intersected_grid_area_m2")))  # a row for each polygon of the call
    got = got.join(sums, "feature")
    n = len(cube.longitude)
    got = (got.withColumn("feature_order", F.col("feature") + 1).withColumn("longitude_index", F.col("lon_idx") + 1).withColumn("latitude_index", F.col("lat_idx") + 1)
           .withColumn("cell_index", F.col("lat_idx") * n + F.col("lon_idx") + 1).withColumn("effective_area_m2", F.col("fraction_cell_covered") * F.col("cell_area_m2"))
           .withColumn("fraction_polygon_covered_by_grid", F.least(F.lit(1.0), F.col("intersected_grid_area_m2") / F.col("polygon_area_m2"))))
    base = ["feature_id", "feature_order", "longitude_index", "latitude_index", "cell_index", "longitude", "latitude", "lon_min", "lon_max", "lat_min", "lat_max", "cell_area_m2", "overlap_area_m2",
            "fraction_cell_covered", "effective_area_m2", "polygon_area_m2", "intersected_grid_area_m2", "fraction_polygon_covered_by_grid"]
    out = cube.located(got, ("longitude", "latitude"))
    if dimension == "2d":
        return out.select(*base)
    sizes = _thickness(cube, depth_bounds, "m")
    bounds = [tuple(sorted(map(float, b))) for b in (depth_bounds or cube.meta["vertical"]["bounds"])]
    layers = F.explode(F.array(*[F.struct(F.lit(k + 1).alias("depth_index"), F.lit(d).alias("depth"), F.lit(b[0]).alias("depth_min"), F.lit(b[1]).alias("depth_max"), F.lit(s).alias("layer_thickness_m"))
                                 for k, (d, b, s) in enumerate(zip(cube.depth, bounds, sizes))]))
    out = out.withColumn("l", layers).select(*base, "l.*")
    return out.withColumn("cell_volume_m3", F.col("cell_area_m2") * F.col("layer_thickness_m")).withColumn("effective_volume_m3", F.col("effective_area_m2") * F.col("layer_thickness_m"))


# ---- coast ---------------------------------------------------------------------------------------


def _nearest_angle(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angle between each unit vector and the nearest of the great-circle segments from ``a`` to ``b``."""
    normal = np.cross(a, b)
    size = np.linalg.norm(normal, axis=1)
    n = normal / np.maximum(size, 1e-300)[:, None]
    after, before = np.cross(n, a), np.cross(b, n)
    out = np.empty(len(points))
    step = max(1, 2_000_000 // max(1, len(a)))
    for lo in range(0, len(points), step):  # a bounded number of pairs at once
        p = points[lo:lo + step]
        angle = np.arccos(np.clip(np.maximum(p @ a.T, p @ b.T), -1, 1))
        beside = (p @ after.T >= 0) & (p @ before.T >= 0) & (size >= 1e-15)
        angle = np.where(beside, np.abs(np.arcsin(np.clip(p @ n.T, -1, 1))), angle)
        out[lo:lo + step] = angle.min(axis=1)
    return out


def coast_dist(cube: Cube, coast: list[dict]) -> DataFrame:
    """longitude, latitude and distance_nm of every place to the nearest coast polygon, 0 inside.

    Distances are spherical, in nautical miles, worked out in Arrow batches over the grid's places only.
    """
    require(bool(coast), "bad_argument", "there is no coast")
    shapes = [parts(p) for p in coast]
    edges = [(_unit(*a), _unit(*b)) for s in shapes for rings in s for ring in rings for a, b in zip(ring, ring[1:] + ring[:1])]
    first, last = np.array([a for a, _ in edges]), np.array([b for _, b in edges])
    rows = cube.located(_places(cube).select("lon_idx", "lat_idx"), ("longitude", "latitude"))

    def run(batches: Iterator) -> Iterator:
        for frame in batches:
            x, y = frame["longitude"].to_numpy(), frame["latitude"].to_numpy()
            inside = np.zeros(len(x), dtype=bool)
            for s in shapes:
                inside |= covers({"polygons": s}, x, y, "include")
            lon, lat = np.radians(x), np.radians(y)
            points = np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1)
            yield frame.assign(distance_nm=np.where(inside, 0.0, _nearest_angle(points, first, last) * RADIUS_M * NAUTICAL_MILES))

    return rows.select("longitude", "latitude").mapInPandas(run, "longitude double, latitude double, distance_nm double")
