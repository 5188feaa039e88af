"""Query parameters of the cube, compiled to column predicates."""

from __future__ import annotations

import calendar
import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, functions as F

from thermalcube.functions.time import day_name_id, week_of_month
from thermalcube.operators.filters import day, same_text
from thermalcube.schemas import MONTH_NAMES, PLACE_LEVELS, TIME_LEVELS

# Parameters that steer the app, not the rows.
IGNORED = ("lat", "lng", "dimension", "tipe", "point", "filterMode")
PERIOD_FIELDS = (*TIME_LEVELS, "hari")
_NEVER = "never"


@dataclass(frozen=True)
class CubeQuery:
    """Optional values, joined by AND; a date and a period exclude each other."""

    pulau: str | None = None
    provinsi: str | None = None
    kota: str | None = None
    kecamatan: str | None = None
    desa: str | None = None
    tahun: str | int | None = None
    semester: str | int | None = None
    kuartal: str | int | None = None
    bulan: str | int | None = None
    minggu: str | int | None = None
    hari: str | None = None
    confidence: str | None = None
    satelite: str | None = None
    date: str | None = None

    def __post_init__(self):
        if self.date is not None and any(getattr(self, f) is not None for f in PERIOD_FIELDS):
            raise ValueError("a date and a period exclude each other")

    @classmethod
    def from_params(cls, params: Mapping[str, object] | None) -> "CubeQuery":
        """Skip null and empty values and steering parameters; refuse unknown names."""
        given = {k: v for k, v in (params or {}).items() if v is not None and v != ""}
        mode = given.get("filterMode")
        chosen = {k: v for k, v in given.items() if k not in IGNORED}
        if "selectedDate" in chosen:
            chosen["date"] = chosen.pop("selectedDate")
        if mode == "date":
            chosen = {k: v for k, v in chosen.items() if k not in PERIOD_FIELDS}
        elif mode == "period":
            chosen.pop("date", None)
        unknown = set(chosen) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown query parameters: {sorted(unknown)}")
        return cls(**chosen)

    def place_tests(self) -> list[Column]:
        return [F.col(f) == getattr(self, f) for f in PLACE_LEVELS if getattr(self, f) is not None]

    def fact_columns(self) -> list[str]:
        """Detection attributes the tests read."""
        timed = self.date is not None or any(getattr(self, f) is not None for f in PERIOD_FIELDS)
        given = {"confidence": self.confidence, "satelit": self.satelite, "tanggal": timed or None}
        return [name for name, value in given.items() if value is not None]

    def fact_tests(self) -> list[Column]:
        tests = []
        if self.confidence is not None:
            tests.append(same_text(F.col("confidence"), self.confidence))
        if self.satelite is not None:
            tests.append(same_text(F.col("satelit"), self.satelite))
        if self.date is not None:
            tests.append(F.col("tanggal") == day(self.date))
        return tests + self.period_tests()

    def period_tests(self) -> list[Column]:
        """With a year the period is a date range, which prunes partitions and row groups."""
        year = _number(self.tahun)
        months = _months(self)
        week = _number(self.minggu)
        tests = []
        if _NEVER in (year, week) or months is None:
            return [F.lit(False)]
        tanggal = F.col("tanggal")
        first, last = months
        if year is not None and not dt.MINYEAR <= year <= dt.MAXYEAR:
            return [F.lit(False)]
        if year is not None:
            start = dt.date(year, first, 1)
            end = dt.date(year, last, calendar.monthrange(year, last)[1])
            if week is not None and first == last:
                low, high = (week - 1) * 7 + 1, min(week * 7, end.day)
                if not 1 <= low <= high:
                    return [F.lit(False)]
                start, end, week = start.replace(day=low), end.replace(day=high), None
            tests += [tanggal >= day(start), tanggal <= day(end)]
        elif (first, last) != (1, 12):
            tests.append(F.month(tanggal).between(first, last))
        if week is not None:
            tests.append(week_of_month(tanggal) == week)
        if self.hari is not None:
            tests.append(same_text(day_name_id(tanggal), self.hari))
        return tests

    def predicate(self) -> Column:
        """All tests as one condition on flat feature rows."""
        return conjunction(self.place_tests() + self.fact_tests())


def conjunction(tests: list[Column]) -> Column:
    return reduce(and_, tests, F.lit(True)) if tests else F.lit(True)


def predicate_from_params(params: Mapping[str, object] | None) -> Column:
    return CubeQuery.from_params(params).predicate()


def filter_period(df, *, tahun=None, semester=None, kuartal=None, bulan=None, minggu=None):
    query = CubeQuery(tahun=tahun, semester=semester, kuartal=kuartal, bulan=bulan, minggu=minggu)
    return df.filter(conjunction(query.period_tests()))


def dice(df, **values):
    """Rows that meet every given place, time, confidence and satellite value."""
    return df.filter(CubeQuery(**values).predicate())


def _number(value):
    if value is None:
        return None
    try:
        return int(str(value))
    except ValueError:
        return _NEVER


def _month(value) -> int | None:
    """Month number of a name or number; an unknown name does not filter."""
    if str(value).isdigit():
        return int(value)
    return MONTH_NAMES.index(value) + 1 if value in MONTH_NAMES else None


def _months(query: CubeQuery) -> tuple[int, int] | None:
    """First and last month that semester, quarter and month leave; None if nothing is left."""
    first, last = 1, 12
    spans = []
    if query.semester is not None:
        spans.append((_number(query.semester), 6))
    if query.kuartal is not None:
        text = str(query.kuartal).upper()
        spans.append((_number(text.removeprefix("Q")), 3))
    if query.bulan is not None and (month := _month(query.bulan)) is not None:
        spans.append((month, 1))
    for number, width in spans:
        if number == _NEVER or not 1 <= number <= 12 // width:
            return None
        first, last = max(first, (number - 1) * width + 1), min(last, number * width)
    return (first, last) if first <= last else None
