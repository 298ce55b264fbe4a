"""Append-only provenance: a JSON-able history of operations in a cube's metadata, with secondary lineages.

Two histories are the same if their operations are: storage, places and run times do not count.
"""

from __future__ import annotations

import copy
import hashlib
import json
import math
import re
from datetime import date, datetime

from gridloom.errors import GridError, require

SCHEMA = 1
_SECRET = re.compile(r"(password|passwd|secret|token|api[_-]?key|credential)", re.I)
_LOGIN = re.compile(r"^[a-z][a-z0-9+.-]*://[^/@\s]+@", re.I)


def clean(value, where: str = "parameters"):
    """A JSON-able copy. Secrets, addresses with a login, non-finite numbers and other objects are refused."""
    if isinstance(value, dict):
        for k in value:
            require(not _SECRET.search(str(k)), "provenance_secret", f"{where}.{k} looks like a secret")
        return {str(k): clean(v, f"{where}.{k}") for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [clean(v, where) for v in value]
    if isinstance(value, datetime):
        require(value.tzinfo is None or value.utcoffset().total_seconds() == 0, "provenance_time", f"{where} is not in UTC")
        return value.replace(tzinfo=None).isoformat() + "Z"
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, float):
        require(math.isfinite(value), "provenance_number", f"{where} is not finite")
        return value
    if isinstance(value, str):
        require(not _LOGIN.match(value), "provenance_secret", f"{where} is an address with a login")
        return value
    if value is None or isinstance(value, (bool, int)):
        return value
    raise GridError("provenance_value", f"{where} has a {type(value).__name__}")


def history(meta: dict) -> dict:
    """The provenance document of a metadata document; an empty one if there is none."""
    found = meta.get("provenance") or {"schema": SCHEMA, "operations": [], "lineages": {}}
    require(found.get("schema", 0) <= SCHEMA, "provenance_future_schema", "the history was written by a later version")
    return copy.deepcopy(found)


def references(operations: list[dict]) -> list[str]:
    """Names of the lineages that operations take as inputs, in order, each once."""
    return list(dict.fromkeys(i["lineage"] for o in operations for i in o["inputs"] if "lineage" in i))


def graph(document: dict) -> str:
    """A digest of what was done, whatever it was done on and however lineages are numbered: a reference to a
    lineage counts as the digest of what it leads to."""
    known: dict[str, str] = {}

    def digest(operations: list[dict], path: tuple[str, ...]) -> str:
        told = []
        for o in operations:
            inputs = []
            for i in o["inputs"]:
                if "lineage" in i:
                    name = i["lineage"]
                    require(name in document["lineages"], "provenance_reference", f"there is no lineage {name}")
                    require(name not in path, "provenance_reference", f"lineage {name} leads back to itself")
                    if name not in known:
                        known[name] = digest(document["lineages"][name]["operations"], (*path, name))
                    i = i | {"lineage": known[name]}
                inputs.append(i)
            told.append({k: o[k] for k in ("operation", "parameters", "method")} | {"inputs": inputs})
        return hashlib.sha256(json.dumps(told, sort_keys=True).encode()).hexdigest()

    return digest(document["operations"], ())


def checked(document: dict) -> dict:
    """The document, if it holds together: a known schema, operations numbered from one, every reference to a
    lineage that is there, none that leads back to itself, and no lineage that nothing refers to."""
    require(document.get("schema") == SCHEMA, "provenance_future_schema" if document.get("schema", 0) > SCHEMA else "provenance_schema", f"schema {document.get('schema')} is not {SCHEMA}")
    own = {"": document["operations"]} | {name: v["operations"] for name, v in document["lineages"].items()}
    for name, operations in own.items():
        require([o["id"] for o in operations] == [f"op_{k:03d}" for k in range(1, len(operations) + 1)], "provenance_reference", f"operations of {name or 'the history'} are not numbered from one")
    graph(document)
    for name, v in document["lineages"].items():
        require(v["graph"] == graph(document | {"operations": v["operations"]}), "provenance_reference", f"lineage {name} is not what its digest says")
    reached, ahead = set(), references(document["operations"])
    while ahead:
        name = ahead.pop()
        if name not in reached:
            reached.add(name)
            ahead += references(own[name])
    require(reached == set(document["lineages"]), "provenance_reference", "a lineage is not referred to")
    return document


def same(a: dict, b: dict) -> bool:
    return graph(a) == graph(b)


def appended(document: dict, operation: str, parameters: dict, inputs: list[dict] | None = None, kind: str = "historical") -> dict:
    require(kind in ("historical", "recurring_climatology", "trend_anchor", "static"), "provenance_time", f"{kind} is no kind of time")
    out = copy.deepcopy(document)
    out["operations"].append({"id": f"op_{len(out['operations']) + 1:03d}", "operation": operation, "parameters": clean(parameters), "inputs": clean(inputs or [{"role": "source"}], "inputs"),
                              "method": {"id": operation, "version": 1}, "time_kind": kind})
    return out


def joined(document: dict, other: dict) -> tuple[dict, str]:
    """``document`` with ``other`` as a secondary lineage, and its name.

    The lineages that ``other`` refers to, at any depth, come along under new names, and its references
    follow them; a lineage that is there already, under whatever name, is not added again."""
    out, names = copy.deepcopy(document), {}
    known = {v["graph"]: name for name, v in out["lineages"].items()}

    def added(operations: list[dict]) -> str:
        for name in references(operations):
            require(name in other["lineages"], "provenance_reference", f"there is no lineage {name}")
            if name not in names:
                names[name] = added(other["lineages"][name]["operations"])
        mark = graph(other | {"operations": operations})
        if mark not in known:
            known[mark] = f"lineage_{len(out['lineages']) + 1:03d}"
            renamed = [o | {"inputs": [i | {"lineage": names[i["lineage"]]} if "lineage" in i else i for i in o["inputs"]]} for o in copy.deepcopy(operations)]
            out["lineages"][known[mark]] = {"graph": mark, "operations": renamed}
        return known[mark]

    graph(other)  # refuses references that lead nowhere or back
    return out, added(other["operations"])


def recorded(cube, operation: str, parameters: dict, other=None, kind: str = "historical"):
    """The cube with one more operation in its history; ``other`` is the metadata of a second input."""
    document, inputs = history(cube.meta), [{"role": "source"}]
    if other is not None:
        document, name = joined(document, history(other))
        inputs.append({"role": "second", "lineage": name})
    return cube.with_(meta=cube.meta | {"provenance": appended(document, operation, {k: v for k, v in parameters.items() if v is not None}, inputs, kind)})
