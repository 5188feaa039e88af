"""Cube questions: counts by level, drill-down, roll-up, time members, map classes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from thermalcube.functions.text import is_special_region, normalize_region
from thermalcube.functions.time import time_attributes
from thermalcube.operators.filters import boundaries_of_parent, match_any_level
from thermalcube.operators.ranking import time_member_order
from thermalcube.plans.query import CubeQuery
from thermalcube.plans.star import Star
from thermalcube.schemas import MAP_CLASSES, PLACE_LEVELS, TIME_LEVELS

Params = Mapping[str, object] | None


def count_by_level(star: Star, level: str, params: Params = None) -> DataFrame:
    """The cube cell question: (label, total) of one place level."""
    _check_level(level)
    query = CubeQuery.from_params(params)
    return star.totals([F.col(level).alias("label")], query=query)


def drill_down(star: Star, ancestors: Mapping[str, str], params: Params = None) -> DataFrame:
    """Counts one level below the deepest chosen ancestor, under all chosen ancestors."""
    chosen = [level for level in PLACE_LEVELS if ancestors.get(level)]
    depth = PLACE_LEVELS.index(chosen[-1]) + 1 if chosen else 0
    if depth == len(PLACE_LEVELS):
        raise ValueError("the lowest level has no children")
    return count_by_level(star, PLACE_LEVELS[depth], {**(params or {}), **ancestors})


def roll_up(star: Star, params: Params = None) -> DataFrame:
    """Totals of every level at once, up to the grand total.

    Detections are counted per lowest place first; the six grouping levels multiply only those
    counts, not the detections.
    """
    cells = star.totals(PLACE_LEVELS, query=CubeQuery.from_params(params))
    return cells.rollup(*PLACE_LEVELS).agg(
        F.sum("total").alias("total"),
        F.grouping_id().cast("int").alias("grouping_level"),
    )


def parent_result(star: Star, ancestors: Mapping[str, str], params: Params = None) -> DataFrame:
    """Roll up one step: the counts among which the deepest chosen ancestor stands."""
    chosen = [level for level in PLACE_LEVELS if ancestors.get(level)]
    return drill_down(star, {level: ancestors[level] for level in chosen[:-1]}, params)


def count_by_confidence(rows: Star | DataFrame, params: Params = None) -> DataFrame:
    return _count_by(rows, "confidence", params)


def count_by_satellite(rows: Star | DataFrame, params: Params = None) -> DataFrame:
    return _count_by(rows, "satelit", params)


def _count_by(rows: Star | DataFrame, column: str, params: Params) -> DataFrame:
    """Of a star, or of flat feature rows."""
    query = CubeQuery.from_params(params)
    if isinstance(rows, Star):
        return rows.totals_by(column, query)
    kept = rows.filter(query.predicate())
    return kept.groupBy(F.col(column).alias("label")).agg(F.sum("detections").alias("total"))


def time_members(star: Star, level: str, params: Params = None) -> DataFrame:
    """Members of a time level under the chosen parents and place, in calendar order.

    Days are few next to detections, so rows are reduced to days before members are derived.
    """
    if level not in TIME_LEVELS:
        raise ValueError(f"no time level {level!r}")
    days = star.days(CubeQuery.from_params(params))
    member = F.trim(time_attributes(F.col("tanggal"))[level].cast("string"))
    members = days.select(member.alias("value")).filter(F.coalesce("value", F.lit("")) != "")
    valid = {"semester": ["1", "2"], "kuartal": ["Q1", "Q2", "Q3", "Q4"]}.get(level)
    if valid:
        members = members.filter(F.upper("value").isin(valid))
    return time_member_order(members.distinct(), level)


def choropleth_counts(star: Star, level: str, params: Params = None) -> DataFrame:
    """Counts by map name. Names are normalised after counting, once per distinct label."""
    cells = count_by_level(star, level, params)
    return merge_counts(cells)


def merge_counts(cells: DataFrame) -> DataFrame:
    """Given (label, total) pairs by normalised name, as the boundaries have it; equal names add up."""
    region = normalize_region(F.col("label")).alias("region")
    named = cells.select(region, "total").filter(F.col("region") != "")
    return named.groupBy("region").agg(F.sum("total").alias("total"))


def attach_counts_to_boundaries(
    boundaries: DataFrame, counts: DataFrame, level: str, parent: str | None = None
) -> DataFrame:
    """Boundaries under the parent that have detections, with their count.

    The special province is shown even without detections, and under Java even where its
    boundary names another island.
    """
    at_level = boundaries.filter(F.col("level") == level)
    shown = boundaries_of_parent(at_level, level, parent)
    if level == "provinsi" and parent and "JAWA" in parent.upper():
        inside = F.upper(F.trim(F.col("parent_name"))) == parent.upper().strip()
        special = at_level.filter(is_special_region(F.col("name")))
        first = special.orderBy(F.coalesce(inside, F.lit(False)).desc(), "name").limit(1)
        shown = shown.unionByName(first.filter(~F.coalesce(inside, F.lit(False))))
    keyed = shown.withColumn("region", normalize_region(F.col("name")))
    joined = keyed.join(counts, "region", "left").withColumn(
        "total", F.coalesce("total", F.lit(0).cast("bigint"))
    )
    always = F.upper(F.col("name")).contains("YOGYAKARTA")
    return joined.filter((F.col("total") > 0) | always)


def threshold_breaks(counts: DataFrame, value: str = "total") -> DataFrame:
    """One row: smallest and largest positive value, and the two class breaks."""
    positive = F.when(F.col(value) > 0, F.col(value).cast("double"))
    limits = counts.agg(
        F.coalesce(F.min(positive), F.lit(0.0)).alias("min_value"),
        F.coalesce(F.max(positive), F.lit(1.0)).alias("max_value"),
    )
    low, spread = F.col("min_value"), F.col("max_value") - F.col("min_value")
    whole_step = F.greatest(F.ceil(spread / 3).cast("double"), F.lit(1.0))
    close = spread < 3
    return limits.select(
        "min_value",
        "max_value",
        F.when(close, low + whole_step).otherwise(low + spread / 3).alias("threshold1"),
        F.when(close, low + whole_step * 2).otherwise(low + spread * 2 / 3).alias("threshold2"),
    )


def classify_counts(counts: DataFrame, value: str = "total") -> DataFrame:
    """Each count with its map class and colour; the breaks are a one-row subquery."""
    breaks = threshold_breaks(counts, value)
    pair = breaks.select(F.struct("threshold1", "threshold2")).scalar()
    low, middle, high = range(3)

    def pick(position: int) -> Column:
        number = F.col(value).cast("double")
        return (
            F.when(number < F.col("breaks.threshold1"), F.lit(MAP_CLASSES[low][position]))
            .when(number < F.col("breaks.threshold2"), F.lit(MAP_CLASSES[middle][position]))
            .otherwise(F.lit(MAP_CLASSES[high][position]))
        )

    classed = counts.withColumn("breaks", pair).withColumns(
        {"map_class": pick(0), "colour": pick(1)}
    )
    return classed.drop("breaks")


def centroid(
    places: DataFrame, name: str, fallback: tuple[float, float] | None = None
) -> DataFrame:
    """One row: mean coordinate of the places called ``name``, else the fallback."""
    lat, lng = fallback or (None, None)
    return match_any_level(places, name).agg(
        F.coalesce(F.avg("lat"), F.lit(lat).cast("double")).alias("lat"),
        F.coalesce(F.avg("lng"), F.lit(lng).cast("double")).alias("lng"),
        F.count(F.lit(1)).alias("matches"),
    )


def _check_level(level: str) -> None:
    if level not in PLACE_LEVELS:
        raise ValueError(f"no place level {level!r}")
