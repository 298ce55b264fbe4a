"""Civil and climate-model calendars, on the driver: time axes are small.

Days count from 1970-01-01 of each calendar. Real-world calendars go through the Julian day number;
idealised ones have years of fixed length.
"""

from __future__ import annotations

import math
import operator
import re
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from functools import total_ordering

from gridloom.errors import GridError, require

# Calendar names and their synonyms, days of the months, seconds of the units.
CALENDARS = {"standard": "standard", "gregorian": "standard", "proleptic_gregorian": "proleptic_gregorian", "julian": "julian", "365_day": "365_day",
             "noleap": "365_day", "366_day": "366_day", "all_leap": "366_day", "360_day": "360_day"}
MONTH_DAYS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
YEAR_SECONDS = 365.242198781 * 86400
UNIT_SECONDS = {"second": 1.0, "minute": 60.0, "hour": 3600.0, "day": 86400.0, "month": YEAR_SECONDS / 12, "year": YEAR_SECONDS}
UNIT_NAMES = {"s": "second", "sec": "second", "secs": "second", "min": "minute", "mins": "minute", "h": "hour", "hr": "hour", "hrs": "hour", "d": "day"}
FIRST_YEAR, LAST_YEAR = 1, 9999


def calendar_name(name: str | None) -> str:
    key = (name or "standard").strip().lower()
    require(key in CALENDARS, "cf_time_unsupported_calendar", f"calendar {name!r} is not known")
    return CALENDARS[key]


def is_leap(year: int, calendar: str) -> bool:
    if calendar == "366_day":
        return True
    if calendar in ("365_day", "360_day"):
        return False
    if calendar == "julian" or calendar == "standard" and year <= 1582:
        return year % 4 == 0
    return year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)


def days_in_month(year: int, month: int, calendar: str) -> int:
    if calendar == "360_day":
        return 30
    return MONTH_DAYS[month - 1] + (month == 2 and is_leap(year, calendar))


def _julian_day(year: int, month: int, day: int, gregorian: bool) -> int:
    a = (14 - month) // 12
    y, m = year + 4800 - a, month + 12 * a - 3
    common = day + (153 * m + 2) // 5 + 365 * y + y // 4
    return common - y // 100 + y // 400 - 32045 if gregorian else common - 32083


def _from_julian_day(number: int, gregorian: bool) -> tuple[int, int, int]:
    if gregorian:
        a = number + 32044
        b = (4 * a + 3) // 146097
        c = a - 146097 * b // 4
    else:
        b, c = 0, number + 32082
    d = (4 * c + 3) // 1461
    e = c - 1461 * d // 4
    m = (5 * e + 2) // 153
    return 100 * b + d - 4800 + m // 10, m + 3 - 12 * (m // 10), e - (153 * m + 2) // 5 + 1


_EPOCH = _julian_day(1970, 1, 1, True)
_REFORM = _julian_day(1582, 10, 15, True)


def ordinal(year: int, month: int, day: int, calendar: str) -> int:
    """Days since 1970-01-01 of a civil date."""
    require(FIRST_YEAR <= year <= LAST_YEAR, "cf_time_range", f"year {year} is outside 1 to 9999")
    require(1 <= month <= 12 and 1 <= day <= days_in_month(year, month, calendar), "cf_time_date", f"{year}-{month}-{day} is no date of {calendar}")
    if calendar == "standard":
        require(not (1582, 10, 5) <= (year, month, day) <= (1582, 10, 14), "cf_time_reform_gap", "1582-10-05 to 1582-10-14 do not exist in the standard calendar")
        return _julian_day(year, month, day, (year, month, day) >= (1582, 10, 15)) - _EPOCH
    if calendar == "proleptic_gregorian":
        return _julian_day(year, month, day, True) - _EPOCH
    if calendar == "julian":
        return _julian_day(year, month, day, False) - _julian_day(1970, 1, 1, False)
    per_year = {"365_day": 365, "366_day": 366, "360_day": 360}[calendar]
    return (year - 1970) * per_year + sum(days_in_month(year, m, calendar) for m in range(1, month)) + day - 1


def components(days: int, calendar: str) -> tuple[int, int, int]:
    """Civil date of a day count."""
    if calendar in ("standard", "proleptic_gregorian", "julian"):
        if calendar == "julian":
            return _from_julian_day(days + _julian_day(1970, 1, 1, False), False)
        number = days + _EPOCH
        return _from_julian_day(number, calendar == "proleptic_gregorian" or number >= _REFORM)
    per_year = {"365_day": 365, "366_day": 366, "360_day": 360}[calendar]
    year, rest = 1970 + days // per_year, days % per_year
    month = 1
    while rest >= days_in_month(year, month, calendar):
        rest -= days_in_month(year, month, calendar)
        month += 1
    return year, month, rest + 1


@total_ordering
@dataclass(frozen=True)
class CalendarTime:
    """A time of a calendar: seconds since its 1970-01-01. Compares only within its calendar."""

    seconds: float
    calendar: str

    def _same(self, other: object) -> None:
        require(isinstance(other, CalendarTime) and other.calendar == self.calendar, "cf_time_mismatch", "times of different calendars do not compare")

    def __eq__(self, other: object) -> bool:
        self._same(other)
        return self.seconds == other.seconds

    def __lt__(self, other: object) -> bool:
        self._same(other)
        return self.seconds < other.seconds

    def __hash__(self) -> int:
        return hash((self.seconds, self.calendar))

    def civil(self) -> tuple[int, int, int, int, int, float]:
        days, rest = divmod(self.seconds, 86400.0)
        if rest > 86400 - 1e-4:  # rounding of decoded fractions
            days, rest = days + 1, 0.0
        return *components(int(days), self.calendar), int(rest // 3600), int(rest % 3600 // 60), rest % 60

    def __str__(self) -> str:
        y, m, d, hh, mm, ss = self.civil()
        return f"{y:04d}-{m:02d}-{d:02d}" + (f" {hh:02d}:{mm:02d}:{ss:06.3f}" if hh or mm or ss else "")

    def __add__(self, other: object):
        raise GridError("cf_time_unsupported_operation", "calendar times compare, and nothing else")

    __sub__ = __mul__ = __radd__ = __rsub__ = __add__


@dataclass(frozen=True)
class CalendarTimes:
    """Times of one calendar, in any order. ``chronology`` tells historical times from climatological ones;
    only vectors that agree in both combine or compare."""

    seconds: tuple[float, ...]
    calendar: str
    chronology: str = "historical"

    def __post_init__(self) -> None:
        require(self.chronology in ("historical", "climatological"), "cf_time_mismatch", f"{self.chronology} is no chronology")
        calendar_name(self.calendar)
        require(all(math.isfinite(s) for s in self.seconds), "cf_time_values", "time values are finite")

    @staticmethod
    def of(times, chronology: str = "historical") -> "CalendarTimes":
        """A vector of calendar times, or of written ones: pairs of a text YYYY-MM-DD[ hh:mm:ss] and a calendar."""
        own = [t if isinstance(t, CalendarTime) else parsed(*t) for t in times]
        require(bool(own), "cf_time_mismatch", "a vector of no times has no calendar")
        require(len({t.calendar for t in own}) == 1, "cf_time_mismatch", "times of different calendars do not combine")
        return CalendarTimes(tuple(t.seconds for t in own), own[0].calendar, chronology)

    def _same(self, other: object) -> "CalendarTimes":
        other = CalendarTimes((other.seconds,), other.calendar, self.chronology) if isinstance(other, CalendarTime) else other
        require(isinstance(other, CalendarTimes) and (other.calendar, other.chronology) == (self.calendar, self.chronology), "cf_time_mismatch", "times of different calendars or chronologies do not combine")
        return other

    def _with(self, seconds) -> "CalendarTimes":
        return CalendarTimes(tuple(seconds), self.calendar, self.chronology)

    def __len__(self) -> int:
        return len(self.seconds)

    def __iter__(self):
        return (CalendarTime(s, self.calendar) for s in self.seconds)

    def __getitem__(self, at):
        """One time for a position; a vector for a slice, a list of positions or a list of truths."""
        if isinstance(at, int):
            return CalendarTime(self.seconds[at], self.calendar)
        if isinstance(at, slice):
            return self._with(self.seconds[at])
        at = list(at)
        if at and all(isinstance(k, bool) for k in at):
            require(len(at) == len(self), "bad_argument", "as many truths as times")
            return self._with(s for s, k in zip(self.seconds, at) if k)
        return self._with(self.seconds[k] for k in at)

    def replaced(self, at: list[int], values) -> "CalendarTimes":
        values, out = self._same(values), list(self.seconds)
        require(len(values) in (1, len(at)), "bad_argument", "one value, or one for each position")
        for k, position in enumerate(at):
            out[position] = values.seconds[k if len(values) > 1 else 0]
        return self._with(out)

    def concatenated(self, *others) -> "CalendarTimes":
        return self._with(s for v in (self, *map(self._same, others)) for s in v.seconds)

    def repeated(self, times: int = 1, each: int = 1) -> "CalendarTimes":
        return self._with([s for s in self.seconds for _ in range(each)] * times)

    def min(self) -> CalendarTime:
        return self.range()[0]

    def max(self) -> CalendarTime:
        return self.range()[1]

    def range(self) -> "CalendarTimes":
        require(len(self) > 0, "cf_time_values", "no times have no range")
        return self._with((min(self.seconds), max(self.seconds)))

    def order(self) -> list[int]:
        """Positions in ascending order of time."""
        return sorted(range(len(self)), key=self.seconds.__getitem__)

    def increasing(self) -> bool:
        return all(a < b for a, b in zip(self.seconds, self.seconds[1:]))

    def compared(self, how: str, other) -> list[bool]:
        """Elementwise ==, !=, <, <=, > or >= with a vector of the same length, or one time."""
        tests = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
        require(how in tests, "cf_time_unsupported_operation", f"{how} is not defined on calendar times")
        values = self._same(other).seconds
        require(len(values) in (1, len(self)), "bad_argument", "one value, or one for each time")
        values = values * len(self) if len(values) == 1 else values
        return [tests[how](a, b) for a, b in zip(self.seconds, values)]

    def texts(self) -> list[str]:
        return [f"{t} [{self.calendar}]" for t in self]

    def document(self) -> dict:
        """A JSON-able form; ``from_document`` reads it back."""
        return {"schema": 1, "seconds": list(self.seconds), "calendar": self.calendar, "chronology": self.chronology}

    @staticmethod
    def from_document(d: dict) -> "CalendarTimes":
        require(d.get("schema") == 1, "cf_time_mismatch", "another schema")
        return CalendarTimes(tuple(map(float, d["seconds"])), d["calendar"], d["chronology"])

    def __add__(self, other: object):
        raise GridError("cf_time_unsupported_operation", "calendar times compare, and nothing else")

    __sub__ = __mul__ = __radd__ = __rsub__ = __truediv__ = __add__


_WRITTEN = re.compile(r"^\s*(\d{1,4})-(\d{1,2})-(\d{1,2})(?:[T\s]+(\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d*)?))?)?\s*Z?\s*$")


def parsed(text: str, calendar: str) -> CalendarTime:
    """A time written as YYYY-MM-DD[ hh:mm[:ss]] in a calendar."""
    m = _WRITTEN.match(text)
    require(m is not None, "cf_time_date", f"{text!r} is no date")
    name = calendar_name(calendar)
    hour, minute, second = int(m[4] or 0), int(m[5] or 0), float(m[6] or 0)
    require(hour < 24 and minute < 60 and second < 60, "cf_time_date", f"{text!r} is no time of day")
    return CalendarTime(ordinal(int(m[1]), int(m[2]), int(m[3]), name) * 86400.0 + hour * 3600 + minute * 60 + second, name)


_UNITS = re.compile(r"^\s*([A-Za-z]+)\s+since\s+(-?\d{1,4})-(\d{1,2})-(\d{1,2})(?:[T\s]+(\d{1,2}):(\d{1,2})(?::(\d{1,2}(?:\.\d*)?))?)?\s*(?:Z|UTC|[+-]\d{1,2}(?::?\d{2})?)?\s*$")


def decode(values: list[float], units: str, calendar: str | None = None) -> list:
    """``<unit> since <date>`` values as dates, UTC datetimes or (outside the Gregorian calendar) CalendarTime."""
    m = _UNITS.match(units)
    require(m is not None, "cf_time_units", f"time units {units!r} are not understood")
    name = m[1].lower()
    unit = UNIT_NAMES.get(name, name.rstrip("s") if name != "s" else "second")
    require(unit in UNIT_SECONDS, "cf_time_units", f"time unit {m[1]!r} is not supported")
    zone = re.search(r"([+-])(\d{1,2}):?(\d{2})?\s*$", units[m.end(4):]) if m[5] else None
    shift = (1 if zone[1] == "+" else -1) * (int(zone[2]) * 3600 + int(zone[3] or 0) * 60) if zone else 0
    cal = calendar_name(calendar)
    origin = ordinal(int(m[2]), int(m[3]), int(m[4]), cal) * 86400 + int(m[5] or 0) * 3600 + int(m[6] or 0) * 60 + float(m[7] or 0) - shift
    require(all(math.isfinite(v) for v in values), "cf_time_values", "time values are finite")
    seconds = [origin + v * UNIT_SECONDS[unit] for v in values]
    seconds = [round(s * 1e4) / 1e4 for s in seconds]
    if cal not in ("standard", "proleptic_gregorian") or cal == "standard" and any(s < (_REFORM - _EPOCH) * 86400 for s in seconds):
        return [CalendarTime(s, cal) for s in seconds]
    if all(s % 86400 == 0 for s in seconds):
        return [date(1970, 1, 1) + timedelta(days=int(s // 86400)) for s in seconds]
    return [datetime(1970, 1, 1) + timedelta(seconds=s) for s in seconds]
