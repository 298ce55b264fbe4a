"""Depth operators: layer means and integrals, sampling, gradients and the strongest-gradient feature.

All geometry (metres, bounds, supports of adjacent pairs, overlap weights) depends on the depth axis
alone. It is worked out on the driver and reaches the data as literals or a broadcast table. Profiles
are bounded by the axis, so rules over a whole profile run on an array of its levels.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.cube import CELL, Cube, finite
from gridloom.errors import GridError, require
from gridloom.operators.provenance import recorded

EPS = math.sqrt(2.220446049250313e-16)
POINT, CELL_MEAN = "VERTICAL_POINT", "VERTICAL_CELL_MEAN"
PROFILE = ("lon_idx", "lat_idx", "time_idx", "variable")


def tolerance(*values: float) -> float:
    return 8 * EPS * max([1.0, *map(abs, values)])


@dataclass(frozen=True)
class DepthAxis:
    """The depth axis in metres, positive down."""

    scale: float
    sign: int
    centres: tuple[float, ...]
    bounds: tuple[tuple[float, float], ...] | None

    @property
    def pairs(self) -> list[dict]:
        """Adjacent levels: spacing, middle, and how their supports meet."""
        out = []
        for i, (a, b) in enumerate(zip(self.centres, self.centres[1:])):
            relation, gap = "POINT_SUPPORT_UNBOUNDED", 0.0
            if self.bounds:
                upper, lower = sorted((self.bounds[i], self.bounds[i + 1]))
                gap = lower[0] - upper[1]
                tol = tolerance(*upper, *lower)
                require(gap >= -tol, "vertical_gradient_bounds", "depth cells overlap")
                relation, gap = ("GAPPED_SUPPORT", gap) if gap > tol else ("CONTIGUOUS_SUPPORT", 0.0)
            out.append({"index": i, "step": b - a, "spacing": abs(b - a), "middle": (a + b) / 2, "relation": relation, "gap": gap})
        return out


def depth_axis(cube: Cube, code: str, levels: int = 2) -> DepthAxis:
    """The axis, if the cube says what its depths are; otherwise an error of the operator's code."""
    v = cube.meta.get("vertical") or {}
    require(bool(v), f"{code}_metadata", "the cube has no vertical description")
    require(v.get("kind") == "DEPTH_LENGTH", f"{code}_axis", "the vertical axis is not a depth in length units")
    require(not v.get("pending"), f"{code}_semantics", "values changed since the vertical description was made")
    scale = {"m": 1.0, "metre": 1.0, "meter": 1.0, "km": 1000.0}.get(v.get("unit"))
    require(scale is not None and v.get("positive") in ("up", "down"), f"{code}_axis", "depth is in m or km, positive up or down")
    require(len(cube.depth) >= levels and cube.depth != (None,), f"{code}_axis", f"at least {levels} depths are needed")
    sign = 1 if v["positive"] == "down" else -1
    centres = tuple(sign * scale * d for d in cube.depth)
    steps = [b - a for a, b in zip(centres, centres[1:])]
    require(all(s > 0 for s in steps) or all(s < 0 for s in steps), f"{code}_axis", "depths are strictly monotonic")
    bounds = None
    if v.get("bounds"):
        bounds = tuple(tuple(sorted(sign * scale * x for x in b)) for b in v["bounds"])
        for c, (lo, hi) in zip(centres, bounds):
            require(lo - tolerance(lo, hi) <= c <= hi + tolerance(lo, hi) and hi > lo, f"{code}_bounds", "a depth lies outside its cell")
    return DepthAxis(scale, sign, centres, bounds)


def semantics(cube: Cube, variable: str) -> str:
    return ((cube.meta.get("vertical") or {}).get("semantics") or {}).get(variable, "VERTICAL_SEMANTICS_UNRESOLVED")


def _refuse(cube: Cube, code: str, *states: str) -> None:
    for s in states:
        require(s not in cube.meta, f"{code}_chain", f"not after {s}")


def _literal(values: list, kind: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def profiles(cube: Cube, variables: list[str] | None = None) -> DataFrame:
    """A row for each place, time and variable of the grid, with ``v``: values by depth position."""
    n = len(cube.depth)
    names = list(cube.variables) if variables is None else variables
    rows = cube.df.where(F.col("variable").isin(names) & F.col("value").isNotNull())
    packed = rows.groupBy(*PROFILE).agg(F.map_from_entries(F.collect_list(F.struct("depth_idx", "value"))).alias("_m"))
    grid = cube.with_(df=cube.df, depth=(None,), variables=tuple(names)).cells().drop("depth_idx")
    empty = F.create_map().cast("map<int,double>")
    return (grid.join(packed, list(PROFILE), "left").withColumn("_m", F.coalesce("_m", empty))
            .select(*PROFILE, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.try_element_at(F.col("_m"), i)).alias("v")))


# ---- layers --------------------------------------------------------------------------------------


def _edges(depth: tuple[float, ...]) -> list[tuple[float, float]]:
    """Cells inferred from centres: midpoints; the first edge is not above the surface."""
    if len(depth) == 1:
        return [(0.0, 2 * depth[0])]
    order = sorted(range(len(depth)), key=lambda i: depth[i])
    d = [depth[i] for i in order]
    mids = [(a + b) / 2 for a, b in zip(d, d[1:])]
    edges = [max(0.0, d[0] - (mids[0] - d[0])), *mids, d[-1] + (d[-1] - mids[-1])]
    out = [(0.0, 0.0)] * len(depth)
    for k, i in enumerate(order):
        out[i] = (edges[k], edges[k + 1])
    return out


def layer_weights(cube: Cube, breaks: list[float], certified: bool) -> list[tuple[int, int, float]]:
    """(layer, depth position, overlap in axis units). A layer that cells cover in part is an error."""
    require(len(breaks) >= 2 and all(math.isfinite(b) for b in breaks) and all(a < b for a, b in zip(breaks, breaks[1:])), "bad_argument", "breaks are finite and increase")
    v = cube.meta.get("vertical") or {}
    cells = [tuple(sorted(b)) for b in v["bounds"]] if certified else _edges(cube.depth)
    out = []
    for k, (lo, hi) in enumerate(zip(breaks, breaks[1:])):
        own = [(k, i, min(hi, b) - max(lo, a)) for i, (a, b) in enumerate(cells) if min(hi, b) - max(lo, a) > tolerance(lo, hi)]
        covered = sum(w for _, _, w in own)
        require(not certified or not own or abs(covered - (hi - lo)) <= tolerance(lo, hi), "vertical_partial_coverage", f"cells cover {covered} of the layer from {lo} to {hi}")
        out += own
    return out


def _layered(cube: Cube, breaks: list[float], weights: list[tuple[int, int, float]], whole: bool, factor: float) -> DataFrame:
    table = F.broadcast(cube.spark.createDataFrame([(k, i, w * factor) for k, i, w in weights] or [(-1, -1, 0.0)], "layer int, depth_idx int, w double"))
    need = [sum(1 for k, _, _ in weights if k == j) for j in range(len(breaks) - 1)]
    rows = cube.df.where("value is not null").join(table, "depth_idx")
    got = rows.groupBy("lon_idx", "lat_idx", "layer", "time_idx", "variable").agg(F.sum(F.col("value") * F.col("w")).alias("vw"), F.sum("w").alias("w"), F.count("*").alias("n"))
    value = F.when(F.col("n") == F.get(_literal(need, "int"), F.col("layer")), F.col("vw")) if whole else F.col("vw") / F.nullif(F.col("w"), F.lit(0.0))
    return got.select("lon_idx", "lat_idx", F.col("layer").alias("depth_idx"), "time_idx", "variable", finite(value).alias("value"))


def layer_mean(cube: Cube, breaks: list[float]) -> Cube:
    """Mean over depth layers, weighted by the overlap of layer and cell; missing cells are left out.

    With cell bounds and known vertical semantics the result is certified: each layer is covered fully or
    not at all. Without, cells are inferred from centres and the result is not certified.
    """
    require(cube.depth != (None,), "bad_argument", "a surface cube has no layers")
    _refuse(cube, "layer", "gradient")
    v = cube.meta.get("vertical") or {}
    certified = bool(v.get("bounds")) and not v.get("pending") and all(semantics(cube, x) in (CELL_MEAN, POINT) for x in cube.variables)
    df = _layered(cube, breaks, layer_weights(cube, breaks, certified), False, 1.0)
    vertical = v | {"bounds": [[a, b] for a, b in zip(breaks, breaks[1:])], "semantics": {x: CELL_MEAN for x in cube.variables}} if certified else v | {"pending": True}
    out = cube.with_(df=df, depth=tuple((a + b) / 2 for a, b in zip(breaks, breaks[1:])), meta=cube.meta | {"vertical": vertical, "reduction": {"kind": "mean", "certified": certified}})
    return recorded(out, "layer_mean", {"breaks": list(map(float, breaks)), "certified": certified})


def layer_integral(cube: Cube, breaks: list[float]) -> Cube:
    """Integral over depth layers of certified cell means, in unit times metre. A layer with any missing
    cell is missing."""
    axis = depth_axis(cube, "layer", 1)
    _refuse(cube, "layer", "gradient", "reduction")
    require(axis.bounds is not None, "layer_bounds", "an integral needs cell bounds")
    for x in cube.variables:
        require(semantics(cube, x) == CELL_MEAN, "layer_semantics", f"{x} does not hold cell means")
        require(bool(cube.unit(x)), "layer_unit", f"{x} has no unit")
    df = _layered(cube, breaks, layer_weights(cube, breaks, True), True, axis.scale)
    units = {x: "m" if cube.unit(x) == "1" else f"{cube.unit(x)} m" for x in cube.variables}
    vertical = cube.meta["vertical"] | {"bounds": [[a, b] for a, b in zip(breaks, breaks[1:])], "pending": True}
    out = cube.with_(df=df, depth=tuple((a + b) / 2 for a, b in zip(breaks, breaks[1:])), meta=cube.meta | {"units": units, "vertical": vertical, "reduction": {"kind": "integral", "certified": True}})
    return recorded(out, "layer_integral", {"breaks": list(map(float, breaks))})


# ---- sampling and gradients ----------------------------------------------------------------------


def _sample_plan(cube: Cube, axis: DepthAxis, target: float, method: str) -> tuple[int, int, float]:
    """(first level, second level, weight of the second) for one target in axis units."""
    t, tol = axis.sign * axis.scale * target, tolerance(target * axis.scale, *axis.centres)
    if method == "cell":
        inside = [i for i, (a, b) in enumerate(axis.bounds) if a - tol <= t <= b + tol]
        lo, hi = min(b[0] for b in axis.bounds), max(b[1] for b in axis.bounds)
        require(lo - tol <= t <= hi + tol, "vertical_sampling_outside", f"{target} is outside the cells")
        require(bool(inside), "vertical_sampling_gap", f"{target} lies between cells")
        require(len(inside) == 1, "vertical_boundary_ambiguous", f"{target} is a boundary of two cells")
        return inside[0], inside[0], 0.0
    for i, c in enumerate(axis.centres):
        if abs(c - t) <= tol:
            return i, i, 0.0
    require(min(axis.centres) < t < max(axis.centres), "vertical_sampling_outside", f"{target} is outside the levels")
    for i, (a, b) in enumerate(zip(axis.centres, axis.centres[1:])):
        if min(a, b) < t < max(a, b):
            require(axis.pairs[i]["relation"] != "GAPPED_SUPPORT", "vertical_sampling_gap", f"{target} lies in a gap")
            return i, i + 1, (t - a) / (b - a)
    raise GridError("vertical_sampling_outside", f"{target} is outside the levels")


def depth_sample(cube: Cube, depths: list[float], method: str = "auto") -> Cube:
    """Values at target depths: of the cell that holds the target, or linear between two levels; never
    across a gap, never beyond the axis. A missing level gives a missing value."""
    require(method in ("auto", "cell", "linear"), "bad_argument", "method is auto, cell or linear")
    require(bool(depths) and all(math.isfinite(d) for d in depths) and all(a < b for a, b in zip(depths, depths[1:])), "bad_argument", "target depths are finite and increase")
    axis = depth_axis(cube, "vertical_sampling", 1)
    _refuse(cube, "vertical_sampling", "gradient", "sampling")
    plan, kinds = [], {}
    for x in cube.variables:
        own = method if method != "auto" else {CELL_MEAN: "cell", POINT: "linear"}.get(semantics(cube, x))
        require(own is not None, "vertical_sampling_semantics", f"it is not known what values of {x} stand for")
        require(own != "cell" or axis.bounds is not None, "vertical_sampling_bounds", "cells have no bounds")
        kinds[x] = own
        for k, d in enumerate(depths):
            lo, hi, w = _sample_plan(cube, axis, d, own)
            plan.append((x, k, lo, 1 - w, 2 if hi != lo else 1))
            if hi != lo:
                plan.append((x, k, hi, w, 2))
    table = F.broadcast(cube.spark.createDataFrame(plan, "variable string, target int, depth_idx int, w double, need int"))
    rows = cube.df.where("value is not null").join(table, ["variable", "depth_idx"])
    got = rows.groupBy("lon_idx", "lat_idx", "target", "time_idx", "variable").agg(F.sum(F.col("value") * F.col("w")).alias("s"), F.count("*").alias("n"), F.first("need").alias("need"))
    df = got.where("n = need").select("lon_idx", "lat_idx", F.col("target").alias("depth_idx"), "time_idx", "variable", finite(F.col("s")).alias("value"))
    vertical = {k: v for k, v in cube.meta["vertical"].items() if k != "bounds"} | {"semantics": {x: POINT if k == "linear" else "VERTICAL_CELL_RECONSTRUCTION" for x, k in kinds.items()}}
    out = cube.with_(df=df, depth=tuple(map(float, depths)), meta=cube.meta | {"vertical": vertical, "sampling": kinds})
    return recorded(out, "depth_sample", {"depths": list(map(float, depths)), "method": method})


def depth_gradient(cube: Cube, method: str = "auto") -> Cube:
    """Differences of adjacent levels over their distance in metres (positive down), one level fewer.

    A pair with a missing level has no gradient. Depths of the result are the middles of the pairs.
    """
    require(method in ("auto", "point", "cell"), "bad_argument", "method is auto, point or cell")
    axis = depth_axis(cube, "vertical_gradient")
    _refuse(cube, "vertical_gradient", "gradient")
    require(cube.meta.get("reduction", {}).get("kind") != "integral" and cube.meta.get("reduction", {"certified": True})["certified"], "vertical_gradient_chain", "not after an integral or an uncertified layer mean")
    kinds = {}
    for x in cube.variables:
        own = semantics(cube, x)
        require(own in (POINT, CELL_MEAN), "vertical_gradient_semantics", f"values of {x} are neither points nor cell means")
        require(method == "auto" or (method == "point") == (own == POINT), "vertical_gradient_semantics", f"{x} does not suit method {method}")
        require(own == POINT or axis.bounds is not None, "vertical_gradient_bounds", "cell means need bounds")
        require(bool(cube.unit(x)), "vertical_gradient_unit", f"{x} has no unit")
        kinds[x] = "point" if own == POINT else "cell"
    pairs = axis.pairs
    key = ("lon_idx", "lat_idx", "time_idx", "variable")
    rows = cube.df.where("value is not null")
    # Each level meets the next one in one aggregation: as the first of its pair and as the second of the pair above.
    sides = F.array(F.struct(F.col("depth_idx").alias("pair"), (-F.col("value")).alias("x")), F.struct((F.col("depth_idx") - 1).alias("pair"), F.col("value").alias("x")))
    both = rows.select(*key, F.explode(sides).alias("s")).select(*key, F.col("s.pair").alias("pair"), F.col("s.x").alias("x")).where(F.col("pair").between(0, len(pairs) - 1))
    got = both.groupBy(*key, "pair").agg(F.sum("x").alias("d"), F.count("*").alias("n")).where("n = 2")
    step = F.get(_literal([p["step"] for p in pairs], "double"), F.col("pair"))
    df = got.select("lon_idx", "lat_idx", F.col("pair").cast("int").alias("depth_idx"), "time_idx", "variable", finite(F.col("d") / step).alias("value"))
    units = {x: "m-1" if cube.unit(x) == "1" else f"{cube.unit(x)} m-1" for x in cube.variables}
    gradient = {"pairs": pairs, "kinds": kinds, "source_depth": list(cube.depth), "source_depth_m": list(axis.centres), "source_units": {x: cube.unit(x) for x in cube.variables},
                "depth_unit": cube.meta["vertical"]["unit"]}
    vertical = {k: v for k, v in cube.meta["vertical"].items() if k != "bounds"}
    out = cube.with_(df=df, depth=tuple((a + b) / 2 for a, b in zip(cube.depth, cube.depth[1:])), meta=cube.meta | {"units": units, "vertical": vertical, "gradient": gradient})
    return recorded(out, "depth_gradient", {"method": method})


# ---- feature -------------------------------------------------------------------------------------


def _feature(values: Column, eligible: list[bool], pairs: list[dict], polarity: str, support: str, allowed: Column | None = None) -> Column:
    """The feature of one profile of gradients as a struct. ``allowed`` (array of boolean) narrows eligibility."""
    n = len(pairs)
    index = F.sequence(F.lit(0), F.lit(n - 1))
    able = _literal(eligible, "boolean")
    if allowed is not None:
        able = F.zip_with(able, allowed, lambda a, b: a & b)
    score = {"absolute": F.abs, "positive": lambda g: g, "negative": lambda g: -g}[polarity]
    rows = F.filter(F.transform(index, lambda i: F.struct(i.alias("i"), F.get(values, i).alias("g"), F.get(able, i).alias("able"))), lambda r: r["able"])
    return F.struct(rows.alias("rows"), F.filter(rows, lambda r: r["g"].isNotNull()).alias("known")), score


def feature_columns(frame: DataFrame, values: str, pairs: list[dict], polarity: str, support: str, allowed: str | None = None) -> DataFrame:
    """Add to profile rows the feature of their gradients ``values``; see ``depth_feature``."""
    eligible = [support == "all" or p["relation"] != "GAPPED_SUPPORT" for p in pairs]
    packed, score = _feature(F.col(values), eligible, pairs, polarity, support, F.col(allowed) if allowed else None)
    out = frame.withColumn("_p", packed)
    out = out.withColumn("n_support_eligible", F.size("_p.rows")).withColumn("n_finite_gradient", F.size("_p.known"))
    out = out.withColumn("feature_tolerance", F.when(F.col("n_finite_gradient") > 0, F.lit(8 * EPS) * F.greatest(F.lit(1.0), F.array_max(F.transform("_p.known", lambda r: F.abs(r["g"]))))))
    out = out.withColumn("_c", F.filter("_p.known", lambda r: score(r["g"]) > F.col("feature_tolerance")))
    out = out.withColumn("_best", F.array_max(F.transform("_c", lambda r: score(r["g"]))))
    out = out.withColumn("_t", F.filter("_c", lambda r: score(r["g"]) >= F.col("_best") - F.col("feature_tolerance")))
    out = out.withColumn("n_matching_candidates", F.size("_c")).withColumn("n_tied", F.size("_t"))
    won = F.when(F.size("_t") == 1, F.get("_t", F.lit(0))["i"])
    out = out.withColumn("_i", won).withColumn("gradient", F.when(F.size("_t") == 1, F.get("_t", F.lit(0))["g"]))
    pick = lambda name, kind: F.get(_literal([p[name] for p in pairs], kind), F.col("_i"))
    relation = pick("relation", "string")
    out = out.withColumn("gradient_index", F.col("_i") + 1).withColumn("gradient_magnitude", F.abs("gradient"))
    out = out.withColumn("spacing_m", pick("spacing", "double")).withColumn("feature_depth_m", pick("middle", "double"))
    out = out.withColumn("support_relation", relation).withColumn("support_gap_m", pick("gap", "double")).withColumn("localization_half_span_m", F.col("spacing_m") / 2)
    out = out.withColumn("gradient_completeness", F.col("n_finite_gradient") / F.nullif(F.col("n_support_eligible"), F.lit(0)))
    status = (F.when(F.col("n_support_eligible") == 0, "NO_LOCAL_SUPPORT" if support == "local" else "NO_ELIGIBLE_SUPPORT")
              .when(F.col("n_finite_gradient") == 0, "NO_FINITE_GRADIENT")
              .when(F.col("n_matching_candidates") == 0, "FLAT_PROFILE" if polarity == "absolute" else "NO_MATCHING_POLARITY")
              .when(F.col("n_tied") > 1, "AMBIGUOUS_TIE")
              .when(relation == "GAPPED_SUPPORT", "GAPPED_SECANT_CANDIDATE")
              .when(relation == "CONTIGUOUS_SUPPORT", "LOCAL_CONTIGUOUS_CANDIDATE").otherwise("LOCAL_POINT_BRACKET_CANDIDATE"))
    out = out.withColumn("status", status)
    partial = F.col("gradient_completeness") < 1
    certified = (F.when(F.col("n_finite_gradient") == 0, "NO_CANDIDATE")
                 .when(F.col("n_matching_candidates") == 0, F.when(partial, "INCOMPLETE_PROFILE_NO_RESOLVED_CANDIDATE").otherwise("NO_CANDIDATE"))
                 .when(F.col("n_tied") > 1, F.when(partial, "AMBIGUOUS_TIE_INCOMPLETE_PROFILE").otherwise("AMBIGUOUS_TIE"))
                 .when(partial, "OBSERVED_CANDIDATE_INCOMPLETE_PROFILE").otherwise(F.concat(F.lit("CERTIFIED_"), "status")))
    return out.withColumn("certification_status", certified).drop("_p", "_c", "_best", "_t")


def depth_feature(cube: Cube, polarity: str = "absolute", support: str = "local") -> DataFrame:
    """For each profile of a gradient cube, the pair of levels with the strongest gradient.

    ``polarity`` is absolute, positive or negative; ``support`` local leaves out pairs across a gap. The
    tolerance is 8 * sqrt(eps) * max(1, largest |g|); several pairs within it of the strongest are a tie
    without a feature.
    """
    require("gradient" in cube.meta, "vertical_feature_input", "the cube holds no depth gradients")
    require(polarity in ("absolute", "positive", "negative") and support in ("local", "all"), "bad_argument", "polarity or support is not known")
    told = cube.meta["gradient"]
    pairs = told["pairs"]
    out = feature_columns(profiles(cube), "v", pairs, polarity, support)
    pick = lambda values, shift=0: F.get(_literal(values, "double"), F.col("_i") + shift)
    middles = [(a + b) / 2 for a, b in zip(told["source_depth"], told["source_depth"][1:])]
    by_variable = lambda values: F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("variable"))
    out = (out.withColumn("feature_depth", pick(middles)).withColumn("source_depth_1", pick(told["source_depth"])).withColumn("source_depth_2", pick(told["source_depth"], 1))
           .withColumn("source_depth_1_m", pick(told["source_depth_m"])).withColumn("source_depth_2_m", pick(told["source_depth_m"], 1))
           .withColumn("polarity", F.lit(polarity)).withColumn("support_policy", F.lit(support)).withColumn("depth_unit", F.lit(told["depth_unit"]))
           .withColumn("variable_unit", by_variable(told["source_units"])).withColumn("gradient_unit", by_variable(cube.meta["units"])))
    out = cube.located(out, ("longitude", "latitude", "time"))
    return out.select("longitude", "latitude", "time", "variable", "variable_unit", "polarity", "support_policy", "feature_depth", "depth_unit", "feature_depth_m", "source_depth_1", "source_depth_2",
                      "source_depth_1_m", "source_depth_2_m", "gradient", "gradient_magnitude", "gradient_unit", "gradient_index", "spacing_m", "support_relation", "support_gap_m",
                      "localization_half_span_m", "n_support_eligible", "n_finite_gradient", "gradient_completeness", "n_matching_candidates", "n_tied", "feature_tolerance", "status", "certification_status")


__all__ = ["CELL", "layer_mean", "layer_integral", "depth_sample", "depth_gradient", "depth_feature", "profiles", "depth_axis", "feature_columns", "semantics"]
