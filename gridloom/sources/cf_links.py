"""Links between a file's variables, and a report on the subset of CF that this library reads.

Attributes such as ``bounds`` or ``coordinates`` name other variables. They make a graph whose edges are
parsed by the attribute's form and resolved against the file. The report is a table of findings by rule;
it reads the header only, so rules about values are marked as deferred.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from gridloom.sources.netcdf3 import Header, Variable, read_header

#: Attributes that link, and what their targets are (fixed values).
TARGET_ROLE = {"coordinates": "auxiliary_coordinate", "bounds": "bounds", "climatology": "climatology_bounds", "ancillary_variables": "ancillary",
               "cell_measures": "cell_measure", "grid_mapping": "grid_mapping", "formula_terms": "formula_term"}
#: Statistics of a cell_methods that is one plain entry (fixed values).
METHODS = ("point", "sum", "maximum", "median", "mid_range", "minimum", "mean", "mode", "standard_deviation", "variance")
_PAIR = re.compile(r"(\w+)\s*:\s*(\S+)")


@dataclass(frozen=True)
class Link:
    """``status``: RESOLVED, SELF_REFERENCE, MISSING_TARGET, DUPLICATE_REFERENCE, UNKNOWN_FORM or DEFERRED_EXTENDED."""

    source: str
    attribute: str
    key: str | None
    target: str | None
    status: str

    @property
    def usable(self) -> bool:
        return self.status == "RESOLVED" or self.status == "SELF_REFERENCE" and self.attribute == "formula_terms"


def _entries(attribute: str, value) -> list[tuple[str | None, str]] | str:
    """(key, target) pairs of an attribute's value, or why there are none."""
    if not isinstance(value, str) or not value.strip():
        return "UNKNOWN_FORM"
    if attribute in ("cell_measures", "formula_terms"):
        found = _PAIR.findall(value)
        return found if found and not _PAIR.sub("", value).strip() else "UNKNOWN_FORM"
    names = value.split()
    if attribute == "grid_mapping" and (len(names) > 1 or ":" in value):
        return "DEFERRED_EXTENDED"
    if attribute in ("bounds", "climatology") and len(names) > 1:
        return "UNKNOWN_FORM"
    return [(None, n) for n in names]


def links(header: Header) -> list[Link]:
    """All links of a file, in the order of its variables."""
    out = []
    for name, v in header.variables.items():
        for attribute in TARGET_ROLE:
            if attribute not in v.attributes:
                continue
            found = _entries(attribute, v.attributes[attribute])
            if isinstance(found, str):
                out.append(Link(name, attribute, None, None, found))
                continue
            seen: set[str] = set()
            for key, target in found:
                status = ("DUPLICATE_REFERENCE" if target in seen else "MISSING_TARGET" if target not in header.variables
                          else "SELF_REFERENCE" if target == name else "RESOLVED")
                seen.add(target)
                out.append(Link(name, attribute, key, target, status))
    return out


def cycles(found: list[Link]) -> list[tuple[str, ...]]:
    """Circles of resolved links of more than one variable, each once, from its first name."""
    ahead: dict[str, list[str]] = {}
    for link in found:
        if link.status == "RESOLVED":
            ahead.setdefault(link.source, []).append(link.target)
    out: set[tuple[str, ...]] = set()

    def walk(path: list[str]) -> None:
        for target in ahead.get(path[-1], []):
            if target == path[0]:
                out.add(tuple(path))
            elif target not in path and target > path[0]:
                walk([*path, target])

    for start in sorted(ahead):
        walk([start])
    return sorted(out)


def roles(header: Header, found: list[Link] | None = None) -> dict[str, tuple[str, ...]]:
    """What each variable is: data, or what dimensions and links make of it."""
    out: dict[str, list[str]] = {name: ["dimension_coordinate"] if name in header.dims else [] for name in header.variables}
    for link in links(header) if found is None else found:
        if link.usable and TARGET_ROLE[link.attribute] not in out[link.target]:
            out[link.target].append(TARGET_ROLE[link.attribute])
    for name, v in header.variables.items():
        for role, attributes in (("quality_flag", ("flag_values", "flag_masks")), ("geometry", ("geometry_type", "cf_role"))):
            if any(a in v.attributes for a in attributes):
                out[name].append(role)
    return {name: tuple(own) or ("data",) for name, own in out.items()}


def linked_variables(header: Header) -> set[str]:
    """Variables that serve others."""
    return {name for name, own in roles(header).items() if set(own) & set(TARGET_ROLE.values())}


@dataclass(frozen=True)
class Finding:
    """``status`` is PASS, FAIL or DEFERRED; a failed requirement is an ERROR, a failed recommendation a WARNING."""

    rule: str
    variable: str
    attribute: str
    status: str
    severity: str
    message: str


def _finding(rule: str, variable: str, attribute: str, ok: bool | None, message: str, recommended: bool = False) -> Finding:
    status = "DEFERRED" if ok is None else "PASS" if ok else "FAIL"
    return Finding(rule, variable, attribute, status, "INFO" if ok else "DEFERRED" if ok is None else "WARNING" if recommended else "ERROR", message)


def _count(value) -> int:
    return len(value) if isinstance(value, list) else 1


def _variable_rules(header: Header, name: str, v: Variable) -> Iterator[Finding]:
    a, numeric = v.attributes, v.dtype != "S1"
    yield _finding("dimensions_unique", name, "", len(set(v.dims)) == len(v.dims), "a variable has each dimension once")
    if name in header.dims:
        from gridloom.sources.cf import evidence

        strong = evidence(name, a)[0]
        yield _finding("axis_evidence", name, "axis", len(strong) <= 1, f"attributes point to {', '.join(sorted(strong)) or 'no axis'}")
    if "cell_methods" in a:
        simple = re.fullmatch(rf"\w+:\s+({'|'.join(METHODS)})", str(a["cell_methods"]).strip())
        yield _finding("cell_methods_simple", name, "cell_methods", True if simple else None, "one plain method is interpreted, anything else is kept as it is")
    if "standard_name" in a:
        yield _finding("standard_name_table", name, "standard_name", None, "kept; no table of legal names is at hand")
    if "units" in a:
        yield _finding("units_conform", name, "units", None, "kept; units are interpreted on axes only")
        if name in header.dims and re.match(r"\s*(months?|years?)\s+since\s", str(a["units"]), re.I):
            yield _finding("time_unit_length", name, "units", False, "months and years are elapsed durations here; time axes should use shorter units", recommended=True)
    for key in ("_FillValue", "missing_value"):
        if key in a:
            yield _finding("missing_type", name, key, _count(a[key]) == 1 and isinstance(a[key], str) != numeric, "a sentinel is one value of the variable's kind")
    if any(k in a for k in ("valid_range", "valid_min", "valid_max")):
        yield _finding("valid_range_exclusive", name, "valid_range", not ("valid_range" in a and ("valid_min" in a or "valid_max" in a)), "valid_range excludes valid_min and valid_max")
    if "actual_range" in a:
        yield _finding("actual_range_values", name, "actual_range", None, "needs the values")
    if any(k in a for k in ("flag_values", "flag_masks", "flag_meanings")):
        own = [a[k] for k in ("flag_values", "flag_masks") if k in a]
        n = {_count(x) for x in own} | {len(str(a.get("flag_meanings", "")).split())}
        yield _finding("flags_structure", name, "flag_meanings", bool(own) and len(n) == 1 and n != {0} and not any(isinstance(x, str) for x in own), "as many meanings as values or masks, which are numbers")


def _link_rules(header: Header, link: Link) -> Iterator[Finding]:
    say = lambda rule, ok, message: _finding(f"{link.attribute}_{rule}", link.source, link.attribute, ok, message)
    yield say("resolution", None if link.status == "DEFERRED_EXTENDED" else link.usable, f"{link.target or header.variables[link.source].attributes[link.attribute]!r}: {link.status}")
    if not link.usable:
        return
    v, target = header.variables[link.source], header.variables[link.target]
    numeric, extra = target.dtype != "S1", target.dims[len(v.dims):]
    if link.attribute in ("coordinates", "ancillary_variables", "cell_measures"):
        inside = set(target.dims) <= set(v.dims)
        ragged = not numeric or any(k in x.attributes for x in (v, target) for k in ("compress", "sample_dimension", "instance_dimension", "cf_role")) or "featureType" in header.attributes
        yield say("dimensions", True if inside else None if ragged else False, "its dimensions are among the variable's")
    if link.attribute == "cell_measures":
        yield say("key", link.key in ("area", "volume"), f"the measure is area or volume, not {link.key}")
        yield say("units", "units" in target.attributes, "a measure has units")
    if link.attribute in ("bounds", "climatology"):
        yield say("numeric", numeric, "bounds are numbers")
        two = len(v.dims) != 1 or len(extra) == 1 and header.dims[extra[0]] == 2
        yield say("dimensions", target.dims[:len(v.dims)] == v.dims and len(extra) == 1 and two, "bounds have the variable's dimensions and one of vertices more, of two on an axis")
        yield say("values", None, "containment and order need the values")
    if link.attribute == "bounds" and "units" in v.attributes and "units" in target.attributes:
        yield say("units", v.attributes["units"] == target.attributes["units"], "bounds with units have the variable's")
    if link.attribute == "climatology":
        yield say("alone", "bounds" not in v.attributes, "a time axis has bounds or climatology, not both")
    if link.attribute == "grid_mapping":
        yield say("name", "grid_mapping_name" in target.attributes, "a grid mapping has a grid_mapping_name")


def findings(header: Header) -> list[Finding]:
    """All findings of a file, by variable and link."""
    found = links(header)
    declared = re.search(r"CF-(\d+\.\d+)", str(header.attributes.get("Conventions", "")))
    out = [_finding("declaration", "", "Conventions", True, f"declares CF {declared[1]}" if declared else "declares no version of CF; what it has is read all the same")]
    for name, v in header.variables.items():
        out += _variable_rules(header, name, v)
    for link in found:
        out += _link_rules(header, link)
    for path in cycles(found):
        out.append(_finding("link_cycle", path[0], "", False, f"links lead back: {' > '.join([*path, path[0]])}"))
    return out


def report(spark: SparkSession, path: str) -> DataFrame:
    """rule, variable, attribute, status, severity, message: what the header of a file says about its CF subset."""
    rows = [(f.rule, f.variable, f.attribute, f.status, f.severity, f.message) for f in findings(read_header(path))]
    return spark.createDataFrame(rows, "rule string, variable string, attribute string, status string, severity string, message string")


def summary(header: Header) -> dict[str, int]:
    """Number of findings by status."""
    return dict(Counter(f.status for f in findings(header)))
