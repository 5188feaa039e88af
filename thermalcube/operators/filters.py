"""Row filters on staged detections and on feature rows.

Feature rows are flat: tanggal (date), detected_at (timestamp), satelit, confidence, the five
place levels, detections, lat, lon.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Observation, functions as F

from thermalcube.functions import geo
from thermalcube.functions.text import contains_ignoring_case, upper_trimmed
from thermalcube.schemas import PLACE_LEVELS, UNDEFINED_PLACE


def day(value: str | dt.date) -> Column:
    return F.lit(str(value)).cast("date")


def same_text(column: Column, value: str) -> Column:
    return F.lower(column) == value.lower()


def for_date(df: DataFrame, date: str, column: str = "acq_date") -> DataFrame:
    """Rows of one date; dates kept as text are compared as text."""
    text = dict(df.dtypes)[column] == "string"
    return df.filter(F.col(column) == (F.lit(str(date)) if text else day(date)))


def for_batch(df: DataFrame, batch_id: str) -> DataFrame:
    return df.filter(F.col("batch_id") == batch_id)


def latest_batch(df: DataFrame, tie_break: str = "batch_id") -> DataFrame:
    """Rows of the batch that holds the newest ingested_at.

    The batch id is a scalar subquery over two columns, so the rows are filtered in the scan
    and no join is needed.
    """
    newest = df.agg(F.max_by("batch_id", F.struct("ingested_at", tie_break))).scalar()
    return df.filter(F.col("batch_id") == newest)


def valid_location(df: DataFrame, district="district_name", subdistrict="subdistrict_name"):
    """Accepted places: the district is known and the subdistrict is named."""
    name = F.coalesce(F.col(subdistrict), F.lit(""))
    return df.filter(F.col(district).isNotNull() & (name != "") & (name != UNDEFINED_PLACE))


def require_fk(df: DataFrame, column: str, name: str) -> tuple[DataFrame, Observation]:
    """Rows with a key, and an observation that counts kept and rejected rows on the way."""
    has_key = F.coalesce(F.col(column), F.lit("")) != ""
    watch = Observation(name)
    observed = df.observe(
        watch,
        F.count(F.lit(1)).alias("original"),
        F.count_if(has_key).alias("kept"),
        F.count_if(~has_key).alias("rejected"),
    )
    return observed.filter(has_key), watch


def slice_by(df: DataFrame, *, confidence: str | None = None, satelite: str | None = None):
    """One dimension fixed to one value, ignoring case."""
    if (confidence is None) == (satelite is None):
        raise ValueError("give either confidence or satelite")
    if confidence is not None:
        return df.filter(same_text(F.col("confidence"), confidence))
    return df.filter(same_text(F.col("satelit"), satelite))


def filter_date(df: DataFrame, date: str) -> DataFrame:
    return df.filter(F.col("tanggal") == day(date))


def on_day(df: DataFrame, as_of: str) -> DataFrame:
    return df.filter(F.col("tanggal") == day(as_of))


def between_dates(df: DataFrame, first: str, as_of: str) -> DataFrame:
    return df.filter(F.col("tanggal").between(day(first), day(as_of)))


def within_parent(df: DataFrame, level: str, parent: str | None) -> DataFrame:
    """Rows under the chosen ancestor of ``level``; all rows at the top or without a choice."""
    position = PLACE_LEVELS.index(level)
    if position == 0 or not parent:
        return df
    return df.filter(F.col(PLACE_LEVELS[position - 1]) == parent)


def search_location(df: DataFrame, text: str) -> DataFrame:
    """Substring search over the five place levels; an empty text keeps every row."""
    if not text:
        return df
    hits = [contains_ignoring_case(F.col(level), text) for level in PLACE_LEVELS]
    return df.filter(reduce(or_, hits))


def in_dates(df: DataFrame, dates: Sequence[str]) -> DataFrame:
    return df.filter(F.col("tanggal").isin([dt.date.fromisoformat(str(d)) for d in dates])) if dates else df


def in_values(df: DataFrame, confidence: Sequence[str] = (), satellite: Sequence[str] = ()):
    """Rows whose confidence and satellite are among the chosen ones; nothing chosen keeps all."""
    chosen = {"confidence": confidence, "satelit": satellite}
    tests = [F.col(column).isin(list(values)) for column, values in chosen.items() if values]
    return df.filter(reduce(and_, tests)) if tests else df


def points_on_date(df: DataFrame, date: str, coordinates: str = "coordinates") -> DataFrame:
    """Features that have a coordinate pair and fall on the date."""
    return df.filter((F.size(coordinates) == 2) & (F.col("tanggal") == day(date)))


def boundaries_of_parent(df: DataFrame, level: str, parent: str | None) -> DataFrame:
    """Boundary rows whose parent name equals the chosen one, ignoring case and outer space."""
    if level == PLACE_LEVELS[0] or not parent:
        return df
    return df.filter(upper_trimmed(F.col("parent_name")) == parent.upper().strip())


def in_bbox(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.filter(geo.in_bbox(F.col(lat), F.col(lon)))


def match_any_level(df: DataFrame, name: str) -> DataFrame:
    """Places whose name at any of the five levels is exactly ``name``."""
    return df.filter(reduce(or_, [F.col(c) == name for c in PLACE_LEVELS]))
