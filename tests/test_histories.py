"""Provenance graphs of merged histories, and vectors of calendar times."""

import copy
import json
import random

import pytest

from gridloom.errors import GridError
from gridloom.functions.calendars import CalendarTime, CalendarTimes, parsed
from gridloom.operators import provenance as pv


def fails(code, f, *args, **kwargs):
    with pytest.raises(GridError) as e:
        f(*args, **kwargs)
    assert e.value.code == code, e.value


def made(*names):
    out = pv.history({})
    for name in names:
        out = pv.appended(out, name, {"of": name})
    return out


def merged(a, b, name="merge"):
    out, lineage = pv.joined(a, b)
    return pv.appended(out, name, {}, [{"role": "source"}, {"role": "second", "lineage": lineage}])


def leads_to(document, operations=None):
    """What a history was made of, written out without names."""
    return tuple((o["operation"], tuple(leads_to(document, document["lineages"][i["lineage"]]["operations"]) for i in o["inputs"] if "lineage" in i))
                 for o in (document["operations"] if operations is None else operations))


def test_a_merge_of_a_merge_keeps_every_lineage():
    inner = merged(made("open", "crop"), made("open", "mask"))
    outer = pv.checked(merged(made("open", "trend"), inner, "difference"))
    assert leads_to(outer) == (("open", ()), ("trend", ()), ("difference", ((("open", ()), ("crop", ()), ("merge", ((("open", ()), ("mask", ())),))),)))
    assert len(outer["lineages"]) == 2
    last = outer["operations"][-1]["inputs"][1]["lineage"]
    assert last not in pv.references(outer["lineages"][last]["operations"])  # never itself
    assert json.loads(json.dumps(outer)) == outer


def test_names_do_not_matter():
    a, b, c = made("open", "a"), made("open", "b"), made("open", "c")
    one = merged(merged(made("open"), merged(a, b)), merged(c, b))
    other = merged(merged(made("open"), merged(a, b)), merged(c, b))
    swapped = copy.deepcopy(other)
    names = {n: f"lineage_{len(swapped['lineages']) - k:03d}" for k, n in enumerate(swapped["lineages"])}
    text = json.dumps(swapped)
    for n in names:
        text = text.replace(n, f"?{n}")
    for n, m in names.items():
        text = text.replace(f"?{n}", m)
    swapped = json.loads(text)
    assert pv.same(one, other) and pv.same(one, pv.checked(swapped)) and not pv.same(one, merged(merged(made("open"), merged(a, c)), merged(c, b)))


def test_shared_lineages_are_kept_once():
    shared = made("open", "shared")
    left, right = merged(made("open", "left"), shared), merged(made("open", "right"), shared)
    both = pv.checked(merged(merged(made("open"), left), right))
    assert len(both["lineages"]) == 3 and sum(v["operations"][-1]["operation"] == "shared" for v in both["lineages"].values()) == 1
    again = pv.checked(merged(both, left))
    assert len(again["lineages"]) == 3


@pytest.mark.parametrize("seed", range(5))
def test_any_merges_hold_together(seed):
    r = random.Random(seed)
    pool = [made("open", f"s{k}") for k in range(4)]
    for _ in range(14):
        a, b = r.choice(pool), r.choice(pool)
        out = pv.checked(merged(a, b))
        assert leads_to(out)[:-1] == leads_to(a) and leads_to(out)[-1][1][-1] == leads_to(b)
        pool.append(out)


def test_broken_histories_are_refused():
    good = merged(made("open"), made("open", "mask"))
    name, = good["lineages"]
    gone = copy.deepcopy(good)
    del gone["lineages"][name]
    fails("provenance_reference", pv.checked, gone)
    fails("provenance_reference", pv.joined, made("open"), gone)
    circle = copy.deepcopy(good)
    circle["lineages"][name]["operations"][1]["inputs"] = [{"role": "second", "lineage": name}]
    fails("provenance_reference", pv.graph, circle)
    fails("provenance_reference", pv.joined, made("open"), circle)
    unused = copy.deepcopy(good)
    unused["lineages"]["lineage_009"] = {"graph": pv.graph(made("x")), "operations": made("x")["operations"]}
    fails("provenance_reference", pv.checked, unused)
    renumbered = copy.deepcopy(good)
    renumbered["operations"][0]["id"] = "op_007"
    fails("provenance_reference", pv.checked, renumbered)
    changed = copy.deepcopy(good)
    changed["lineages"][name]["operations"][0]["parameters"] = {"of": "other"}
    fails("provenance_reference", pv.checked, changed)
    fails("provenance_future_schema", pv.checked, good | {"schema": 2})


# ---- vectors of calendar times -------------------------------------------------------------------


def vector(calendar="noleap", chronology="historical"):
    return CalendarTimes.of([(t, calendar) for t in ("2000-03-01", "2000-02-28 12:00", "2001-01-01")], chronology)


def test_subsets_and_repeats_keep_the_calendar():
    v = vector()
    assert isinstance(v[1], CalendarTime) and str(v[1]) == "2000-02-28 12:00:00.000" and v[1].calendar == "365_day"
    assert v[:2].seconds == v.seconds[:2] and v[[2, 0]].seconds == (v.seconds[2], v.seconds[0]) and v[[True, False, True]].seconds == (v.seconds[0], v.seconds[2])
    assert v.repeated(2).seconds == v.seconds * 2 and v[:1].repeated(each=3).seconds == v.seconds[:1] * 3
    assert v.concatenated(v[:1], v[2]).seconds == (*v.seconds, v.seconds[0], v.seconds[2])
    assert v.replaced([0], v[2]).seconds == (v.seconds[2], *v.seconds[1:])
    assert all(x.calendar == "365_day" and x.chronology == "historical" for x in (v[:2], v.repeated(2), v.concatenated(v), v.replaced([0], v[1])))
    assert v.texts()[0] == "2000-03-01 [365_day]"
    fails("bad_argument", v.__getitem__, [True])


def test_order_and_range():
    v = vector()
    assert v.order() == [1, 0, 2] and not v.increasing() and v[v.order()].increasing()
    assert v.range().seconds == (v.min().seconds, v.max().seconds) and str(v.min()).startswith("2000-02-28") and str(v.max()) == "2001-01-01"
    assert v.compared("<", v[2]) == [True, True, False] and v.compared("==", v) == [True] * 3 and v.compared(">=", v[0]) == [True, False, True]
    fails("cf_time_values", v[:0].range)


def test_other_calendars_and_chronologies_do_not_combine():
    v = vector()
    for other in (vector("360_day"), vector(chronology="climatological"), vector("julian")[0], 5.0, "2000-01-01"):
        for f in (v.concatenated, lambda x: v.compared("<", x), lambda x: v.replaced([0], x)):
            fails("cf_time_mismatch", f, other)
    fails("cf_time_mismatch", CalendarTimes.of, [("2000-01-01", "noleap"), ("2000-01-01", "360_day")])
    fails("cf_time_mismatch", CalendarTimes.of, [])
    fails("cf_time_mismatch", vector, chronology="prehistoric")


def test_arithmetic_is_refused():
    v = vector()
    for f in (lambda: v + 1, lambda: v - v, lambda: 2 + v, lambda: v * 2, lambda: v / 2):
        fails("cf_time_unsupported_operation", f)
    fails("cf_time_unsupported_operation", v.compared, "in", v)


def test_vectors_go_to_documents_and_back():
    for v in (vector(), vector("360_day", "climatological")):
        assert CalendarTimes.from_document(json.loads(json.dumps(v.document()))) == v
    fails("cf_time_mismatch", CalendarTimes.from_document, vector().document() | {"schema": 2})


def test_written_dates_follow_the_calendar():
    assert parsed("2001-02-30", "360_day").civil()[:3] == (2001, 2, 30)
    assert parsed("1900-02-29", "julian").civil()[:3] == (1900, 2, 29)
    for text, calendar, code in (("2001-02-29", "noleap", "cf_time_date"), ("2001-02-30", "julian", "cf_time_date"), ("1582-10-10", "standard", "cf_time_reform_gap"), ("soon", "noleap", "cf_time_date"),
                                 ("2001-01-01 24:00", "noleap", "cf_time_date"), ("0000-01-01", "noleap", "cf_time_range")):
        fails(code, parsed, text, calendar)
