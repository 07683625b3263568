"""Time scopes: parsing, and predicates that reach the scan as ranges of the raw timestamp."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.errors import MalformedTimeFilter

GRAINS = ("year", "quarter", "month", "week", "day")


def label(date: Column, grain: str) -> Column:
    """The label of the period that a date lies in; weeks are named by their Monday."""
    return {
        "year": F.year(date).cast("string"),
        "quarter": F.concat(F.year(date).cast("string"), F.lit("-Q"), F.quarter(date).cast("string")),
        "month": F.date_format(date, "yyyy-MM"),
        "week": F.date_format(F.date_trunc("week", date), "yyyy-MM-dd"),
        "day": F.date_format(date, "yyyy-MM-dd"),
    }[grain]


def ordinal(date: Column, grain: str) -> Column:
    """A whole number that grows by one from a period to the calendar's next."""
    year = F.year(date)
    return {
        "year": year,
        "quarter": year * 4 + F.quarter(date),
        "month": year * 12 + F.month(date),
        "week": F.floor((F.datediff(date, F.lit("1970-01-01").cast("date")) + 3) / 7),
        "day": F.datediff(date, F.lit("1970-01-01").cast("date")),
    }[grain].cast("long")


def ordinal_label(number: int, grain: str) -> str:
    if grain == "year":
        return str(number)
    if grain == "quarter":
        return f"{(number - 1) // 4}-Q{(number - 1) % 4 + 1}"
    if grain == "month":
        return f"{(number - 1) // 12}-{(number - 1) % 12 + 1:02d}"
    return str(dt.date(1970, 1, 1) + dt.timedelta(days=number * 7 - 3 if grain == "week" else number))


def ordinal_name(number: Column, grain: str) -> Column:
    """``ordinal_label`` as a column."""
    if grain == "year":
        return number.cast("string")
    if grain == "quarter":
        return F.concat(F.floor((number - 1) / 4).cast("string"), F.lit("-Q"), (F.pmod(number - 1, F.lit(4)) + 1).cast("string"))
    if grain == "month":
        return F.concat(F.floor((number - 1) / 12).cast("string"), F.lit("-"), F.lpad((F.pmod(number - 1, F.lit(12)) + 1).cast("string"), 2, "0"))
    days = number * 7 - 3 if grain == "week" else number
    return F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")).cast("string")


def _month_after(year: int, month: int, months: int) -> dt.date:
    at = year * 12 + month - 1 + months
    return dt.date(at // 12, at % 12 + 1, 1)


@dataclass(frozen=True)
class TimeFilter:
    """One or more half-open date ranges, or the latest n held periods of a grain."""

    kind: str
    name: str
    ranges: tuple[tuple[dt.datetime | dt.date | None, dt.datetime | dt.date | None], ...] = ((None, None),)
    grain: str = "quarter"
    n: int = 0
    wanted: tuple[str, ...] = ()

    def predicate(self, date: Column) -> Column:
        def inside(low, high) -> Column:
            tests = ([date >= F.lit(str(low)).cast("timestamp_ntz")] if low else []) + ([date < F.lit(str(high)).cast("timestamp_ntz")] if high else [])
            return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)

        return reduce(lambda a, b: a | b, [inside(*r) for r in self.ranges])

    def bind(self, facts: DataFrame, date: str = "date") -> TimeFilter:
        """The filter with its dates known: 'latest' looks up the labels held, a handful of rows."""
        if self.kind != "latest":
            return self
        held = [r["o"] for r in facts.select(ordinal(F.col(date), self.grain).alias("o")).distinct().orderBy(F.desc("o")).limit(self.n).collect()]
        if not held:
            return self
        return TimeFilter("bound", self.name, tuple(_span(o, self.grain) for o in sorted(held)), self.grain, self.n, tuple(ordinal_label(o, self.grain) for o in sorted(held)))


def _span(number: int, grain: str) -> tuple[dt.date, dt.date]:
    if grain == "year":
        return dt.date(number, 1, 1), dt.date(number + 1, 1, 1)
    if grain == "quarter":
        return _month_after((number - 1) // 4, 1, (number - 1) % 4 * 3), _month_after((number - 1) // 4, 1, (number - 1) % 4 * 3 + 3)
    if grain == "month":
        return _month_after((number - 1) // 12, 1, (number - 1) % 12), _month_after((number - 1) // 12, 1, (number - 1) % 12 + 1)
    first = dt.date(1970, 1, 1) + dt.timedelta(days=number * 7 - 3 if grain == "week" else number)
    return first, first + dt.timedelta(days=7 if grain == "week" else 1)


def quarter(year: int, number: int) -> TimeFilter:
    return TimeFilter("quarter", f"{year}-Q{number}", (_span(year * 4 + number, "quarter"),), "quarter", wanted=(f"{year}-Q{number}",))


def year(value: int) -> TimeFilter:
    return TimeFilter("year", str(value), (_span(value, "year"),), "year", wanted=(str(value),))


def _date(text: object, what: str) -> dt.datetime | dt.date:
    try:
        return dt.date.fromisoformat(str(text)) if len(str(text)) == 10 else dt.datetime.fromisoformat(str(text))
    except ValueError:
        raise MalformedTimeFilter(f"{what} {text!r} is not an ISO date") from None


def parse(spec: object) -> TimeFilter:
    """A filter from a dictionary with a type, or from a label such as 2001-Q2, 2001 or 2001-05."""
    if isinstance(spec, TimeFilter):
        return spec
    if isinstance(spec, str):
        if m := re.fullmatch(r"(\d{4})-?Q([1-4])", spec):
            return quarter(int(m[1]), int(m[2]))
        if re.fullmatch(r"\d{4}", spec):
            return year(int(spec))
        if re.fullmatch(r"\d{4}-\d{2}", spec):
            return parse({"type": "months", "start": spec, "end": spec})
        if spec == "all":
            return TimeFilter("all", "all")
    if not isinstance(spec, dict) or "type" not in spec:
        raise MalformedTimeFilter(f"{spec!r} is no time filter")
    kind = spec["type"]
    try:
        if kind == "quarter":
            if int(spec["quarter"]) not in (1, 2, 3, 4):
                raise MalformedTimeFilter("a quarter is 1 to 4")
            return quarter(int(spec["year"]), int(spec["quarter"]))
        if kind == "year":
            return year(int(spec["year"]))
        if kind == "years":
            own = sorted({int(y) for y in spec["values"]})
            return TimeFilter("years", ",".join(map(str, own)), tuple(_span(y, "year") for y in own), "year", wanted=tuple(map(str, own)))
        if kind == "quarters":
            own = sorted({(int(v["year"]), int(v["quarter"])) if isinstance(v, dict) else (int(v[0]), int(v[1])) for v in spec["values"]})
            return TimeFilter("quarters", ",".join(f"{y}-Q{q}" for y, q in own), tuple(_span(y * 4 + q, "quarter") for y, q in own), "quarter", wanted=tuple(f"{y}-Q{q}" for y, q in own))
        if kind == "range":
            low, high = _date(spec["start"], "start"), _date(spec["end"], "end")
            past = high + dt.timedelta(days=1) if not isinstance(high, dt.datetime) else high + dt.timedelta(microseconds=1)
            return TimeFilter("range", f"{spec['start']}..{spec['end']}", ((low, past),), "day")
        if kind == "months":
            (a, b), (c, d) = (map(int, str(spec[k]).split("-")) for k in ("start", "end"))
            return TimeFilter("months", f"{spec['start']}..{spec['end']}", ((_month_after(a, b, 0), _month_after(c, d, 1)),), "month")
        if kind == "latest":
            if spec["grain"] not in GRAINS or int(spec["n"]) < 1:
                raise MalformedTimeFilter("latest takes a grain and n of 1 or more")
            return TimeFilter("latest", f"latest {spec['n']} {spec['grain']}", grain=spec["grain"], n=int(spec["n"]))
        if kind == "all":
            return TimeFilter("all", "all")
    except (KeyError, TypeError, ValueError) as e:
        raise MalformedTimeFilter(f"{spec!r}: {e}") from None
    raise MalformedTimeFilter(f"no time filter of type {kind!r}")


def previous(scope: TimeFilter) -> TimeFilter | None:
    """The calendar period before a single quarter or year."""
    if scope.kind == "quarter":
        y, q = map(int, scope.name.split("-Q"))
        return quarter(y - (q == 1), (q - 2) % 4 + 1)
    return year(int(scope.name) - 1) if scope.kind == "year" else None
