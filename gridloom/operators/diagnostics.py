"""Profile diagnostics: transition layers, oxygen cores and boundaries, mixed layer depth.

Each rule runs on an array of a profile's levels, in physical order. What every level would mean as the
end of a search is computed for all levels at once; the answer is the first level that ends it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.cube import Cube
from gridloom.errors import GridError, require
from gridloom.operators.vertical import CELL_MEAN, EPS, POINT, DepthAxis, _literal, depth_axis, depth_feature, depth_gradient, feature_columns, profiles, semantics, tolerance
from gridloom.operators.select import taken

# Which standard names a diagnostic reads, and its direction.
TEMPERATURES = ("sea_water_temperature", "sea_water_potential_temperature", "sea_water_conservative_temperature")
SALINITIES = ("sea_water_practical_salinity", "sea_water_absolute_salinity", "sea_water_salinity")
DENSITIES = ("sea_water_potential_density", "sea_water_sigma_theta")
OXYGENS = ("moles_of_oxygen_per_unit_mass_in_sea_water", "mole_concentration_of_dissolved_molecular_oxygen_in_sea_water", "mass_concentration_of_oxygen_in_sea_water")
DIAGNOSTICS = {"thermocline": ("negative", TEMPERATURES), "halocline": ("absolute", SALINITIES), "pycnocline": ("positive", DENSITIES),
               "upper_oxycline": ("negative", OXYGENS), "lower_oxycline": ("positive", OXYGENS)}
# Spellings of oxygen units by family, with factors to mol kg-1, mol m-3 and kg m-3.
OXYGEN_UNITS = {
    "amount_per_mass": {
        "mol kg-1": 1.0, "mol kg^-1": 1.0, "mol kg**-1": 1.0, "mol/kg": 1.0,
        "mmol kg-1": 1e-3, "mmol kg^-1": 1e-3, "mmol kg**-1": 1e-3, "mmol/kg": 1e-3,
        "umol kg-1": 1e-6, "umol kg^-1": 1e-6, "umol kg**-1": 1e-6, "umol/kg": 1e-6,
        "micromoles_per_kilogram": 1e-6,
    },
    "amount_per_volume": {
        "mol m-3": 1.0, "mol m^-3": 1.0, "mol m**-3": 1.0, "mol/m3": 1.0,
        "mmol m-3": 1e-3, "mmol m^-3": 1e-3, "mmol m**-3": 1e-3, "mmol/m3": 1e-3,
        "umol m-3": 1e-6, "umol m^-3": 1e-6, "umol m**-3": 1e-6, "umol/m3": 1e-6,
        "mol l-1": 1e3, "mol l^-1": 1e3, "mol/l": 1e3,
        "mmol l-1": 1.0, "mmol l^-1": 1.0, "mmol/l": 1.0,
        "umol l-1": 1e-3, "umol l^-1": 1e-3, "umol/l": 1e-3,
    },
    "mass_per_volume": {
        "kg m-3": 1.0, "kg m^-3": 1.0, "kg m**-3": 1.0, "kg/m3": 1.0,
        "g m-3": 1e-3, "g m^-3": 1e-3, "g m**-3": 1e-3, "g/m3": 1e-3,
        "mg m-3": 1e-6, "mg m^-3": 1e-6, "mg m**-3": 1e-6, "mg/m3": 1e-6,
        "mg l-1": 1e-3, "mg l^-1": 1e-3, "mg/l": 1e-3,
    },
}


def unit_key(unit: str | None) -> str:
    """A unit in one spelling: lower case, single spaces, plain minus signs, u for micro."""
    return " ".join((unit or "").replace("µ", "u").replace("μ", "u").replace("−", "-").lower().split())


def oxygen_family(unit: str | None) -> tuple[str, float]:
    for family, units in OXYGEN_UNITS.items():
        if unit_key(unit) in units:
            return family, units[unit_key(unit)]
    raise GridError("oxygen_unit", f"{unit!r} is no oxygen unit that is known")


def variable_named(cube: Cube, names: tuple[str, ...], variable: str | None, code: str) -> str:
    """The one variable whose standard name is among ``names``."""
    told = cube.meta.get("standard_names", {})
    fit = [v for v in cube.variables if told.get(v) in names and (variable is None or v == variable)]
    require(len(fit) == 1, f"{code}_variable", f"{len(fit)} variables have a standard name of {', '.join(names)}")
    return fit[0]


def _one(cube: Cube, variable: str) -> Cube:
    return taken(cube, {}, [variable])


def transition_layer(cube: Cube, diagnostic: str, variable: str | None = None, support: str = "local") -> DataFrame:
    """The strongest gradient of a diagnostic's variable and direction, for each profile; no threshold.

    Oxyclines look only at the gradients above (upper) or below (lower) the oxygen core.
    """
    require(diagnostic in DIAGNOSTICS, "transition_diagnostic", f"diagnostic is one of {', '.join(DIAGNOSTICS)}")
    polarity, names = DIAGNOSTICS[diagnostic]
    chosen = variable_named(cube, names, variable, "transition")
    single = _one(cube, chosen)
    if names is OXYGENS:
        return _oxycline(single, diagnostic, polarity, support)
    out = depth_feature(depth_gradient(single), polarity, support)
    return _labelled(out, cube, chosen, diagnostic)


def _labelled(out: DataFrame, cube: Cube, variable: str, diagnostic: str) -> DataFrame:
    name = diagnostic.upper()
    gapped = F.col("support_relation") == "GAPPED_SUPPORT"
    whole = F.col("gradient_completeness") == 1
    status = (F.when(F.col("gradient").isNull(), F.col("status"))
              .when(whole, F.when(gapped, f"GAPPED_{name}_GRADIENT_CANDIDATE").otherwise(f"{name}_GRADIENT_CANDIDATE"))
              .otherwise(F.when(gapped, f"OBSERVED_GAPPED_{name}_INCOMPLETE_PROFILE").otherwise(f"OBSERVED_{name}_INCOMPLETE_PROFILE")))
    found = F.col("gradient").isNotNull()
    return (out.withColumn("diagnostic_status", status)
            .withColumnRenamed("status", "feature_status").withColumnRenamed("certification_status", "feature_certification_status")
            .withColumn("diagnostic", F.lit(diagnostic)).withColumn("variable_standard_name", F.lit(cube.meta["standard_names"][variable]))
            .withColumn("gradient_direction", F.when(F.col("gradient") > 0, "INCREASING_WITH_DEPTH").when(F.col("gradient") < 0, "DECREASING_WITH_DEPTH"))
            .withColumn("diagnostic_strength", F.when(found, F.col("gradient_magnitude"))).withColumn("diagnostic_strength_unit", F.when(found, F.col("gradient_unit")))
            .withColumn("threshold_applied", F.lit(False))
            .withColumn("diagnostic_certification_status", F.when(found & whole, "CERTIFIED_GRADIENT_DIAGNOSTIC").when(found, "OBSERVED_GRADIENT_DIAGNOSTIC").otherwise("NO_DIAGNOSTIC")))


# ---- oxygen --------------------------------------------------------------------------------------


def _physical(axis: DepthAxis) -> list[int]:
    return sorted(range(len(axis.centres)), key=lambda i: axis.centres[i])


def _relations(axis: DepthAxis) -> tuple[list[str], list[float]]:
    """Relation and gap of neighbours in physical order (shallow to deep)."""
    pairs = axis.pairs if axis.centres[0] < axis.centres[-1] else axis.pairs[::-1]
    return [p["relation"] for p in pairs], [p["gap"] for p in pairs]


def _levels(cube: Cube, axis: DepthAxis, factor: float = 1.0) -> DataFrame:
    """Profiles with ``v`` in physical order."""
    rows = profiles(cube)
    if axis.centres[0] > axis.centres[-1]:
        rows = rows.withColumn("v", F.reverse("v"))
    return rows if factor == 1.0 else rows.withColumn("v", F.transform("v", lambda x: x * factor))


def _with_core(rows: DataFrame, depths: list[float]) -> DataFrame:
    """Add the oxygen core of complete profiles: the level, or run of neighbours, of the least value."""
    z = _literal(depths, "double")
    known = F.filter("v", lambda x: x.isNotNull())
    rows = rows.withColumn("oxygen_profile_completeness", F.size(known) / F.size("v"))
    rows = rows.withColumn("core_tolerance", F.when(F.size(known) > 0, F.lit(8 * EPS) * F.greatest(F.lit(1.0), F.array_max(F.transform(known, F.abs)))))
    rows = rows.withColumn("core_minimum_value", F.when(F.size(known) == F.size("v"), F.array_min("v")))
    members = F.filter(F.transform("v", lambda x, i: F.when(x - F.col("core_minimum_value") <= F.col("core_tolerance"), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("_members", F.when(F.col("core_minimum_value").isNotNull(), members))
    rows = rows.withColumn("_first", F.array_min("_members")).withColumn("_last", F.array_max("_members"))
    kind = (F.when(F.col("oxygen_profile_completeness") < 1, "INCOMPLETE_OXYGEN_PROFILE")
            .when(F.array_max("v") - F.col("core_minimum_value") <= F.col("core_tolerance"), "FLAT_OXYGEN_PROFILE")
            .when(F.col("_last") - F.col("_first") + 1 > F.size("_members"), "AMBIGUOUS_DISJOINT_MINIMA")
            .when(F.col("_first") == F.col("_last"), "UNIQUE_MINIMUM").otherwise("CONTIGUOUS_MINIMUM_PLATEAU"))
    rows = rows.withColumn("core_type", kind)
    sure = F.col("core_type").isin("UNIQUE_MINIMUM", "CONTIGUOUS_MINIMUM_PLATEAU")
    rows = rows.withColumn("core_shallow_depth_m", F.when(sure, F.get(z, F.col("_first")))).withColumn("core_deep_depth_m", F.when(sure, F.get(z, F.col("_last"))))
    return rows.withColumn("core_depth_m", (F.col("core_shallow_depth_m") + F.col("core_deep_depth_m")) / 2)


def _oxycline(cube: Cube, diagnostic: str, polarity: str, support: str) -> DataFrame:
    variable = cube.variables[0]
    family, factor = oxygen_family(cube.unit(variable))
    axis = depth_axis(cube, "oxygen")
    gradient = depth_gradient(cube)
    order = _physical(axis)
    depths = [axis.centres[i] for i in order]
    core = _with_core(_levels(cube, axis), depths)
    pairs = gradient.meta["gradient"]["pairs"]
    flipped = axis.centres[0] > axis.centres[-1]
    # Position of each stored pair in physical order; a pair counts if it lies wholly on one side of the core.
    place = [len(pairs) - 1 - p["index"] if flipped else p["index"] for p in pairs]
    top = _literal(place, "int")
    wholly = F.transform(top, lambda k: k + 1 <= F.col("_first")) if diagnostic == "upper_oxycline" else F.transform(top, lambda k: k >= F.col("_last"))
    sure = F.col("core_type").isin("UNIQUE_MINIMUM", "CONTIGUOUS_MINIMUM_PLATEAU")
    core = core.withColumn("_allowed", F.when(sure, wholly).otherwise(F.transform(top, lambda k: F.lit(False))))
    slopes = profiles(gradient).select("lon_idx", "lat_idx", "time_idx", "variable", F.col("v").alias("_g"))
    rows = core.join(slopes, ["lon_idx", "lat_idx", "time_idx", "variable"])
    rows = feature_columns(rows, "_g", pairs, polarity, support, "_allowed").withColumn("branch_gradient_count", F.size(F.filter("_allowed", lambda a: a)))
    rows = rows.withColumn("status", F.when(sure, F.col("status")).otherwise(F.col("core_type")))
    scale = F.lit(axis.sign * axis.scale)
    rows = rows.withColumn("feature_depth", F.col("feature_depth_m") / scale).withColumn("gradient_unit", F.lit(gradient.unit(variable)))
    out = _labelled(cube.located(rows, ("longitude", "latitude", "time")), cube, variable, diagnostic)
    return out.select(
        "longitude", "latitude", "time", "variable", "diagnostic", F.lit(family).alias("oxygen_quantity_family"), F.lit(cube.unit(variable)).alias("oxygen_source_unit"),
        "core_type", "core_minimum_value", "core_depth_m", "core_shallow_depth_m", "core_deep_depth_m", F.lit("UPPER" if diagnostic.startswith("upper") else "LOWER").alias("branch"),
        "branch_gradient_count", "oxygen_profile_completeness", "feature_depth", "feature_depth_m", "gradient", "gradient_magnitude", "gradient_unit", "gradient_index", "spacing_m", "support_relation",
        "n_support_eligible", "n_finite_gradient", "gradient_completeness", "n_matching_candidates", "n_tied", "feature_status", "feature_certification_status", "gradient_direction",
        "diagnostic_strength", "diagnostic_strength_unit", "threshold_applied", "diagnostic_status", "diagnostic_certification_status", "variable_standard_name")


def oxygen_boundary(cube: Cube, threshold: float, threshold_unit: str, variable: str | None = None, support: str = "local") -> DataFrame:
    """The zone around the oxygen core where values do not exceed a threshold, and its two boundaries.

    The zone grows from the core over neighbouring low levels; ``support`` local stops it at gaps. A
    boundary is exact at a level, interpolated between point values, or only bracketed (cell means, gaps).
    Thickness is given when both sides are exact or interpolated.
    """
    require(threshold >= 0 and threshold < float("inf"), "oxygen_threshold", "the threshold is finite and not negative")
    require(support in ("local", "all"), "bad_argument", "support is local or all")
    chosen = variable_named(cube, OXYGENS, variable, "oxygen")
    single = _one(cube, chosen)
    family, factor = oxygen_family(single.unit(chosen))
    asked, asked_factor = oxygen_family(threshold_unit)
    require(family == asked, "oxygen_unit", "threshold and variable are of different families")
    axis = depth_axis(single, "oxygen")
    depths = [axis.centres[i] for i in _physical(axis)]
    relation, gaps = _relations(axis)
    limit = threshold * asked_factor / factor
    rows = _with_core(_levels(single, axis), depths)
    n, z = len(depths), _literal(depths, "double")
    tol = F.lit(8 * EPS) * F.greatest(F.lit(1.0), F.lit(abs(limit)), F.array_max(F.transform("v", F.abs)))
    rows = rows.withColumn("_tol", tol).withColumn("_low", F.transform("v", lambda x: x <= F.lit(limit) + F.col("_tol")))
    passable = _literal([support == "all" or r != "GAPPED_SUPPORT" for r in relation], "boolean")
    rows = rows.withColumn("_walls", F.transform(passable, lambda p, i: ~(p & F.get("_low", i) & F.get("_low", i + 1))))
    above = F.filter(F.sequence(F.lit(0), F.lit(n - 2)), lambda i: (i < F.col("_first")) & F.get("_walls", i))
    below = F.filter(F.sequence(F.lit(0), F.lit(n - 2)), lambda i: (i >= F.col("_last")) & F.get("_walls", i))
    rows = rows.withColumn("_start", F.coalesce(F.array_max(above) + 1, F.lit(0))).withColumn("_end", F.coalesce(F.array_min(below), F.lit(n - 1)))
    split = F.exists(F.transform(passable, lambda p, i: ~p & (i >= F.col("_first")) & (i < F.col("_last"))), lambda x: x)
    zone = (F.when(F.col("core_type").isin("INCOMPLETE_OXYGEN_PROFILE", "AMBIGUOUS_DISJOINT_MINIMA", "FLAT_OXYGEN_PROFILE"), F.col("core_type"))
            .when(F.lit(limit) < F.col("core_minimum_value") - F.col("_tol"), "THRESHOLD_ZONE_ABSENT").when(split, "CORE_SPLIT_BY_SUPPORT_GAP")
            .when((F.col("_start") == 0) & (F.col("_end") == n - 1), "THRESHOLD_ZONE_SPANS_PROFILE").otherwise("THRESHOLD_ZONE_PRESENT"))
    rows = rows.withColumn("zone_status", zone)
    there = F.col("zone_status").startswith("THRESHOLD_ZONE_") & (F.col("zone_status") != "THRESHOLD_ZONE_ABSENT")
    mean = semantics(single, chosen) == CELL_MEAN
    for side, edge, pair, inside, outside in (("UPPER", F.col("_start") == 0, F.col("_start") - 1, F.col("_start"), F.col("_start") - 1),
                                              ("LOWER", F.col("_end") == n - 1, F.col("_end"), F.col("_end"), F.col("_end") + 1)):
        own = lambda values, kind: F.get(_literal(values, kind), pair)  # noqa: E731,B023
        a, b = F.try_element_at("v", inside + 1), F.get("v", F.when(outside >= 0, outside))
        gapped = own(relation, "string") == "GAPPED_SUPPORT"
        bracket = (F.abs(b - a) > F.col("_tol")) & (F.get("_low", inside) != F.get("_low", F.when(outside >= 0, outside)))
        status = (F.when(edge, f"{side}_BOUNDARY_OPEN_AT_PROFILE_EDGE")
                  .when(gapped, "LOCAL_SUPPORT_GAP_COMPONENT_EDGE" if support == "local" else "GAPPED_CELL_MEAN_THRESHOLD_BRACKET_ONLY" if mean else "GAPPED_THRESHOLD_BRACKET_ONLY")
                  .when(F.lit(mean), "CELL_MEAN_THRESHOLD_BRACKET_ONLY").when(F.abs(a - F.lit(limit)) <= F.col("_tol"), "EXACT_THRESHOLD_POINT")
                  .when(bracket, "INTERPOLATED_THRESHOLD_CROSSING").otherwise("NO_LOCAL_THRESHOLD_BRACKET"))
        low = side.lower()
        rows = rows.withColumn(f"{low}_boundary_status", F.when(there, status).otherwise(F.col("zone_status")))
        za, zb = F.get(z, inside), F.get(z, F.when(outside >= 0, outside))
        crossing = za + (F.lit(limit) - a) / F.nullif(b - a, F.lit(0.0)) * (zb - za)
        rows = rows.withColumn(f"{low}_boundary_depth_m", F.when(F.col(f"{low}_boundary_status") == "EXACT_THRESHOLD_POINT", za).when(F.col(f"{low}_boundary_status") == "INTERPOLATED_THRESHOLD_CROSSING", crossing))
        rows = rows.withColumn(f"{low}_boundary_depth", F.col(f"{low}_boundary_depth_m") / F.lit(axis.sign * axis.scale))
        rows = rows.withColumn(f"{low}_support_gap_m", F.when(there & ~edge, own(gaps, "double")))
    rows = rows.withColumn("zone_observed_top_m", F.when(there, F.get(z, F.col("_start")))).withColumn("zone_observed_bottom_m", F.when(there, F.get(z, F.col("_end"))))
    rows = rows.withColumn("zone_observed_thickness_m", F.col("lower_boundary_depth_m") - F.col("upper_boundary_depth_m"))
    told = (F.when(F.col("zone_status") == "THRESHOLD_ZONE_ABSENT", "CERTIFIED_THRESHOLD_ZONE_ABSENT").when(~there, "NO_CERTIFIED_THRESHOLD_ZONE")
            .when(F.col("zone_observed_thickness_m").isNotNull(), "CERTIFIED_EXACT_POINT_THRESHOLD_ZONE")
            .when(F.col("zone_status") == "THRESHOLD_ZONE_SPANS_PROFILE", "OBSERVED_THRESHOLD_ZONE_OPEN_EDGES").otherwise("OBSERVED_THRESHOLD_ZONE_BOUNDARIES_INEXACT"))
    out = single.located(rows.withColumn("certification_status", told), ("longitude", "latitude", "time"))
    return out.select("longitude", "latitude", "time", "variable", F.lit(float(threshold)).alias("threshold"), F.lit(threshold_unit).alias("threshold_unit"), "core_type", "core_minimum_value", "core_depth_m",
                      "core_shallow_depth_m", "core_deep_depth_m", "zone_status", "upper_boundary_depth", "upper_boundary_depth_m", "upper_boundary_status", "lower_boundary_depth", "lower_boundary_depth_m",
                      "lower_boundary_status", "zone_observed_top_m", "zone_observed_bottom_m", "zone_observed_thickness_m", "certification_status")


# ---- mixed layer ---------------------------------------------------------------------------------

_CERTIFIED = {"MLD_EXACT_THRESHOLD_POINT": "CERTIFIED_EXACT_POINT_MLD", "MLD_INTERPOLATED_THRESHOLD_CROSSING": "CERTIFIED_INTERPOLATED_LOCAL_MLD", "MLD_OPEN_AT_PROFILE_BOTTOM": "CERTIFIED_OPEN_BOTTOM",
              "MLD_UNRESOLVED_INCOMPLETE_PATH": "UNRESOLVED_MISSING_PATH", "MLD_UNRESOLVED_BEFORE_SUPPORT_GAP": "UNRESOLVED_LOCAL_SUPPORT_GAP", "GAPPED_MLD_THRESHOLD_BRACKET": "UNRESOLVED_GAPPED_THRESHOLD_PATH",
              "MLD_UNRESOLVED_NONMONOTONIC_BRACKET": "UNRESOLVED_NONMONOTONIC_DEPARTURE", "MLD_UNRESOLVED_INVALID_INTERPOLATION": "UNRESOLVED_NUMERICAL_BRACKET"}


def mixed_layer_depth(cube: Cube, method: str = "temperature_threshold", variable: str | None = None, reference_depth: float = 10.0, threshold: float | None = None, support: str = "local") -> DataFrame:
    """The first depth below the reference where the value has departed from the reference value by the
    threshold: in either direction for temperature (0.2), upward for potential density (0.03).

    The reference value is a level's or interpolated in a bracket without gap. A missing level, or for
    ``support`` local a gap, ends the search. Only point values are admitted. Temperature remembers any
    gap on the path; density minds only one in the crossing bracket.
    """
    require(method in ("temperature_threshold", "density_threshold"), "mld_method", "method is temperature_threshold or density_threshold")
    require(support in ("local", "all"), "bad_argument", "support is local or all")
    dense = method == "density_threshold"
    threshold = (0.03 if dense else 0.2) if threshold is None else threshold
    require(threshold > 0 and reference_depth >= 0, "mld_argument", "threshold is positive, the reference depth not negative")
    chosen = variable_named(cube, DENSITIES if dense else TEMPERATURES, variable, "mld")
    single = _one(cube, chosen)
    require(semantics(single, chosen) == POINT, "mld_semantics", "mixed layer depth needs point values")
    axis = depth_axis(single, "mld")
    depths = [axis.centres[i] for i in _physical(axis)]
    relation, _ = _relations(axis)
    n, ztol = len(depths), tolerance(reference_depth, *depths)
    rows = _levels(single, axis)
    # The reference: everything but its value is known from the axis.
    exact = [i for i, d in enumerate(depths) if abs(d - reference_depth) <= ztol]
    inside = depths[0] - ztol <= reference_depth <= depths[-1] + ztol
    first = next((i for i, d in enumerate(depths) if d > reference_depth + ztol), n)
    if not inside:
        value, failed, shown = F.lit(None).cast("double"), "REFERENCE_DEPTH_OUTSIDE_PROFILE", None
    elif exact:
        value, failed, shown = F.get("v", F.lit(exact[0])), "REFERENCE_TEMPERATURE_UNRESOLVED", "REFERENCE_EXACT_POINT"
    elif relation[first - 1] == "GAPPED_SUPPORT":
        value, failed, shown = F.lit(None).cast("double"), "REFERENCE_GAPPED_BRACKET", None
    else:
        w = (reference_depth - depths[first - 1]) / (depths[first] - depths[first - 1])
        a, b = F.get("v", F.lit(first - 1)), F.get("v", F.lit(first))
        value, failed, shown = a + w * (b - a), "REFERENCE_TEMPERATURE_UNRESOLVED", "REFERENCE_INTERPOLATED_POINT"
    if dense:
        failed = failed.replace("TEMPERATURE", "DENSITY")
    rows = rows.withColumn("_ref", value)
    ref_z = depths[exact[0]] if exact else float(reference_depth)
    z = [ref_z, *depths[first:]]
    gap = [False, *[relation[i - 1] == "GAPPED_SUPPORT" for i in range(first, n)]]
    # The path: the reference, then every deeper level.
    rows = rows.withColumn("_path", F.concat(F.array("_ref"), F.slice("v", first + 1, max(0, n - first)) if first < n else F.array().cast("array<double>")))
    zs, gaps = _literal(z, "double"), _literal(gap, "boolean")
    seen = _literal([any(gap[:i + 1]) for i in range(len(gap))], "boolean")
    departure = (lambda x: x - F.col("_ref")) if dense else (lambda x: F.abs(x - F.col("_ref")))

    def ends(i: Column) -> Column:
        """How the search ends at path position i, or null if it goes on."""
        now, before = F.get("_path", i), F.get("_path", i - 1)
        tol = F.lit(8 * EPS) * F.greatest(F.lit(1.0), F.abs("_ref"), F.abs(before), F.abs(now), F.lit(threshold))
        d, d0 = departure(now), departure(before)
        reached = d >= F.lit(threshold) - tol
        blocked = F.get(gaps, i) if dense else F.get(seen, i)
        out = F.when(now.isNull(), "MLD_UNRESOLVED_INCOMPLETE_PATH")
        if support == "local":
            out = out.when(F.get(gaps, i), "MLD_UNRESOLVED_BEFORE_SUPPORT_GAP")
        out = out.when(reached & blocked, "GAPPED_MLD_THRESHOLD_BRACKET").when(reached & (F.abs(d - threshold) <= tol), "MLD_EXACT_THRESHOLD_POINT")
        if not dense:
            turned = (F.abs(before - F.col("_ref")) > tol) & (F.signum(before - F.col("_ref")) != F.signum(now - F.col("_ref")))
            out = out.when(reached & (turned | (d - d0 <= tol)), "MLD_UNRESOLVED_NONMONOTONIC_BRACKET")
        part = (F.lit(threshold) - d0) / F.nullif(d - d0, F.lit(0.0))
        slack = F.lit(0.0) if dense else tol
        sound = F.coalesce(part.between(-slack, 1 + slack), F.lit(False))
        return out.when(reached & ~sound, "MLD_UNRESOLVED_INVALID_INTERPOLATION").when(reached, "MLD_INTERPOLATED_THRESHOLD_CROSSING")

    steps = F.transform(F.sequence(F.lit(1), F.lit(max(1, len(z) - 1))), lambda i: F.struct(i.alias("i"), (ends(i) if len(z) > 1 else F.lit(None).cast("string")).alias("s")))
    rows = rows.withColumn("_end", F.get(F.filter(steps, lambda s: s["s"].isNotNull()), F.lit(0)))
    open_ = "MLD_UNRESOLVED_BEFORE_SUPPORT_GAP" if not dense and any(gap) else "MLD_OPEN_AT_PROFILE_BOTTOM"
    rows = rows.withColumn("status", F.when(F.col("_ref").isNull(), failed).otherwise(F.coalesce(F.col("_end.s"), F.lit(open_))))
    at = F.col("_end.i")
    d, d0 = departure(F.get("_path", at)), departure(F.get("_path", at - 1))
    part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.lit(threshold) - d0) / F.nullif(d - d0, F.lit(0.0))))
    z1, z0 = F.get(zs, at), F.get(zs, at - 1)
    depth_m = F.when(F.col("status") == "MLD_EXACT_THRESHOLD_POINT", z1).when(F.col("status") == "MLD_INTERPOLATED_THRESHOLD_CROSSING", z0 + part * (z1 - z0))
    rows = rows.withColumn("mld_depth_m", depth_m).withColumn("mld_depth", F.col("mld_depth_m") / F.lit(axis.sign * axis.scale))
    certified = F.when(F.col("_ref").isNull(), "UNRESOLVED_REFERENCE")
    for status, word in _CERTIFIED.items():
        certified = certified.when(F.col("status") == status, word)
    if not dense:
        certified = F.when(F.col("_ref").isNotNull() & F.col("_end").isNull() & F.lit(any(gap)), "UNRESOLVED_GAPPED_PATH").otherwise(certified)
    start = 1 if exact and not dense else 0
    path = F.coalesce(at, F.lit(len(z) - 1)) + start
    rows = rows.withColumn("n_path_points", F.when(F.col("_ref").isNotNull(), path).otherwise(0))
    rows = rows.withColumn("n_path_finite", F.col("n_path_points") - F.when(F.col("status") == "MLD_UNRESOLVED_INCOMPLETE_PATH", 1).otherwise(0))
    bracket = F.col("_end").isNotNull() & F.col("_ref").isNotNull()
    rows = rows.withColumn("bracket_shallow_depth_m", F.when(bracket, z0)).withColumn("bracket_deep_depth_m", F.when(bracket, z1))
    moved = F.get("_path", at) - F.col("_ref")
    direction = F.when(F.col("mld_depth_m").isNotNull(), F.when(moved >= 0, "DENSER_WITH_DEPTH" if dense else "WARMER_WITH_DEPTH").otherwise("COOLER_WITH_DEPTH"))
    reached_levels = F.slice("_path", F.lit(1), F.coalesce(at, F.lit(len(z) - 1)) + 1)
    rows = rows.withColumn("density_inversion_encountered", F.exists(reached_levels, lambda x: F.coalesce(x < F.col("_ref"), F.lit(False))))
    told = F.when(F.col("_ref").isNotNull(), F.lit(shown)).otherwise(F.lit(failed))
    name = "density" if dense else "temperature"
    out = single.located(rows.withColumn("certification_status", certified).withColumn("crossing_direction", direction).withColumn("reference_status", told), ("longitude", "latitude", "time"))
    return out.select("longitude", "latitude", "time", "variable", F.lit(method).alias("method"), F.lit(float(reference_depth)).alias("reference_depth_requested_m"),
                      F.when(F.col("_ref").isNotNull(), F.lit(ref_z)).alias("reference_depth_resolved_m"), F.col("_ref").alias(f"reference_{name}"), "reference_status", F.lit(float(threshold)).alias("threshold"),
                      "mld_depth", "mld_depth_m", "crossing_direction", "bracket_shallow_depth_m", "bracket_deep_depth_m", "n_path_points", "n_path_finite",
                      *["density_inversion_encountered"] * dense, "status", "certification_status")
