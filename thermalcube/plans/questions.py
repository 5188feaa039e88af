"""The app's requests as one call each: a dimension with parameters, detections, places."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from thermalcube.functions.time import week_of_month
from thermalcube.plans import cube
from thermalcube.plans.query import CubeQuery
from thermalcube.plans.star import Star
from thermalcube.schemas import PLACE_LEVELS, TIME_LEVELS

Params = Mapping[str, object] | None


def ask(star: Star, dimension: str, params: Params = None) -> DataFrame:
    """Answer for ``location``, ``confidence``, ``satelite`` or ``time``.

    A location question names its level as ``tipe`` and counts islands without one. A time question
    lists the members of the level below the deepest time value given.
    """
    given = dict(params or {})
    if dimension == "location":
        return cube.count_by_level(star, given.get("tipe") or PLACE_LEVELS[0], given)
    if dimension == "confidence":
        return cube.count_by_confidence(star, given)
    if dimension == "satelite":
        return cube.count_by_satellite(star, given)
    if dimension == "time":
        return cube.time_members(star, next_time_level(given), given)
    raise ValueError(f"no dimension {dimension!r}")


def next_time_level(params: Mapping[str, object]) -> str:
    """The level below the deepest time value given, the year without any."""
    given = [i for i, level in enumerate(TIME_LEVELS) if params.get(level)]
    return TIME_LEVELS[min(given[-1] + 1, len(TIME_LEVELS) - 1)] if given else TIME_LEVELS[0]


def detections(star: Star, params: Params = None) -> DataFrame:
    """Flat detections that meet the parameters."""
    query = CubeQuery.from_params(params)
    columns = (
        "id", "tanggal", "detected_at", "satelit", "confidence", *PLACE_LEVELS,
        "detections", "lat", "lon",
    )
    rows = star.flat(*columns).filter(query.predicate())
    return rows.withColumn("minggu", week_of_month(F.col("tanggal")).cast("string"))


def places(star: Star) -> DataFrame:
    """All places with their names on the five levels."""
    return star.places
