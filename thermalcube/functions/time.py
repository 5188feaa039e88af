"""Date and time expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from thermalcube.schemas import DAY_NAMES, MONTH_NAMES

# Text shown for a missing and for an unreadable date.
NOT_AVAILABLE = "N/A"
INVALID_DATE = "Invalid Date"


def _names(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def pad_hhmm(text: Column) -> Column:
    """Zero-pad to four digits; a longer text stays whole (``lpad`` alone would cut it)."""
    text = text.cast("string")
    return F.when(F.length(text) < 4, F.lpad(text, 4, "0")).otherwise(text)


def clock_text(hhmm: Column) -> Column:
    padded = pad_hhmm(hhmm)
    return F.concat(F.substring(padded, 1, 2), F.lit(":"), F.substring(padded, 3, 2), F.lit(":00"))


def acquired_at(date: Column, hhmm: Column) -> Column:
    """Instant of a detection in UTC; null where the parts are no date and time."""
    text = F.concat(date.cast("string"), F.lit(" "), clock_text(hhmm))
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))


def iso_datetime(date: Column, hhmm: Column) -> Column:
    """Lookup text, date and time joined by T."""
    return F.concat(date.cast("string"), F.lit("T"), clock_text(hhmm))


def weather_datetime(date: Column, hhmm: Column) -> Column:
    return F.concat(date.cast("string"), F.lit(" "), clock_text(hhmm))


def semester(date: Column) -> Column:
    return F.when(F.month(date) <= 6, F.lit(1)).otherwise(F.lit(2))


def calendar(date: Column) -> dict[str, Column]:
    """Calendar attributes of the period dimension."""
    return {
        "year_value": F.year(date),
        "semester_value": semester(date),
        "quarter_value": F.quarter(date),
        "month_value": F.month(date),
        "month_name": F.date_format(date, "MMMM"),
        "week_value": F.weekofyear(date),
    }


def week_of_month(date: Column) -> Column:
    return F.ceil(F.dayofmonth(date) / 7).cast("int")


def day_name_id(date: Column) -> Column:
    return F.get(_names(DAY_NAMES), F.dayofweek(date) - 1)


def month_name_id(month: Column) -> Column:
    return F.get(_names(MONTH_NAMES), month - 1)


def month_index(name: Column) -> Column:
    """1 to 12, null for an unknown name."""
    return F.nullif(F.array_position(_names(MONTH_NAMES), name).cast("int"), F.lit(0))


def time_attributes(date: Column) -> dict[str, Column]:
    """Attributes of the app's time hierarchy."""
    return {
        "tahun": F.year(date),
        "semester": semester(date),
        "kuartal": F.concat(F.lit("Q"), F.quarter(date).cast("string")),
        "bulan": month_name_id(F.month(date)),
        "minggu": week_of_month(date),
        "hari": day_name_id(date),
    }


def extract_time(text: Column) -> Column:
    """HH:mm:ss of a date-time text; loose clock texts are padded, anything else is N/A."""
    parsed = F.date_format(text.try_cast("timestamp"), "HH:mm:ss")
    words = F.split(text, " ")
    clock = F.when(F.size(words) > 1, words[1]).when(text.contains("T"), F.substring(text, 12, 8))
    pieces = F.split(F.split(clock, r"\.")[0], ":")
    loose = F.when(
        F.size(pieces) == 3,
        F.concat_ws(
            ":",
            F.transform(
                pieces, lambda p: F.when(F.length(p) < 2, F.lpad(p, 2, "0")).otherwise(p)
            ),
        ),
    )
    return F.coalesce(parsed, loose, F.lit(NOT_AVAILABLE))


def format_date_id(text: Column) -> Column:
    """1 Januari 2015; N/A for no date."""
    text = text.cast("string")
    day = text.try_cast("date")
    long_text = F.concat_ws(
        " ",
        F.dayofmonth(day).cast("string"),
        month_name_id(F.month(day)),
        F.year(day).cast("string"),
    )
    return (
        F.when(F.coalesce(text, F.lit("")) == "", F.lit(NOT_AVAILABLE))
        .when(day.isNull(), F.lit(INVALID_DATE))
        .otherwise(long_text)
    )
