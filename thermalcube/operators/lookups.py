"""Joins and key lookups.

Almost no broadcast hints: the optimizer broadcasts a side whose estimated size is within
``autoBroadcastJoinThreshold``; beyond it the join is shuffled and AQE splits hot keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from thermalcube.functions.text import surrogate_id
from thermalcube.functions.time import weather_datetime
from thermalcube.schemas import COORDINATE, DAY


def keep_located(df: DataFrame, places: DataFrame) -> DataFrame:
    """Rows whose coordinate has an accepted place; several place rows never multiply a row.

    Place rows are reduced to distinct coordinates first, so a coordinate that holds many place
    rows is one row in the join.
    """
    return df.join(places.select(*COORDINATE).distinct(), list(COORDINATE), "left_semi")


def reject_metrics(df: DataFrame, places: DataFrame) -> DataFrame:
    """One row: rows in, rows with a place, rows without.

    Rows are counted per coordinate first, so the join sees each coordinate once.
    """
    per_place = df.groupBy(*COORDINATE).agg(F.count(F.lit(1)).alias("n"))
    known = places.select(*COORDINATE).distinct().withColumn("known", F.lit(True))
    flagged = per_place.join(known, list(COORDINATE), "left")
    total = F.coalesce(F.sum("n"), F.lit(0))
    kept = F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0))
    return flagged.agg(
        total.alias("original"), kept.alias("kept"), (total - kept).alias("rejected")
    )


def location_mapping(places: DataFrame, coordinates: DataFrame | None = None) -> DataFrame:
    """One location id per coordinate (the smallest), for the asked coordinates only."""
    if coordinates is not None:
        # Spark splits hot keys of a semi-join's left side only, so the right side has each key once.
        places = places.join(coordinates.select(*COORDINATE).distinct(), list(COORDINATE), "left_semi")
    return places.groupBy(*COORDINATE).agg(F.min("id").alias("location_id"))


def attach_location(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Location id of each row's coordinate, empty where there is none."""
    found = df.join(mapping, list(COORDINATE), "left")
    return found.withColumn("location_id", F.coalesce("location_id", F.lit("")))


def new_rows(df: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not stored yet."""
    return df.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def new_rows_by_id(df: DataFrame, existing: DataFrame, key: str = "id") -> DataFrame:
    """Rows with a new, non-null id."""
    return new_rows(df.filter(F.col(key).isNotNull()), existing, [key])


def assign_key(
    df: DataFrame,
    existing: DataFrame | None,
    natural_key: Sequence[str],
    output: str = "id",
    existing_key: Sequence[str] | None = None,
) -> DataFrame:
    """Id of a natural key: the stored one if known, else a hash of the key.

    New ids follow from the key alone, so dimension and fact rows agree without a join between
    them; only a stored dimension is looked up.
    """
    fresh = surrogate_id(*[F.col(c) for c in natural_key])
    if existing is None:
        return df.withColumn(output, fresh)
    names = list(existing_key or natural_key)
    # Texts are compared with null as empty, like the hashed key.
    stored = existing.groupBy(
        *[_key_text(F.col(c)).alias(f"__key{i}") for i, c in enumerate(names)]
    ).agg(F.min("id").alias("__stored_id"))
    match = reduce(
        and_, [_key_text(F.col(c)) == F.col(f"__key{i}") for i, c in enumerate(natural_key)]
    )
    joined = df.join(stored, match, "left")
    return joined.withColumn(output, F.coalesce("__stored_id", fresh)).drop(
        "__stored_id", *[f"__key{i}" for i in range(len(names))]
    )


def _key_text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def first_period_id(periods: DataFrame) -> DataFrame:
    """One id per stored date, the smallest."""
    return periods.groupBy("date_value").agg(F.min("id").alias("id"))


def facts_for_date(facts: DataFrame, periods: DataFrame, date: str) -> DataFrame:
    """Fact rows that belong to a calendar date; the stored day column prunes the other folders."""
    day = F.lit(str(date)).cast("date")
    facts = facts.filter(F.col(DAY) == day)
    ids = periods.filter(F.col("date_value") == day)
    # The period table has one row per calendar day, so one day's ids are a row or two.
    wanted = F.broadcast(ids.select(F.col("id").alias("period_id")).distinct())
    return facts.join(wanted, "period_id", "left_semi")


def attach_label_coordinates(cells: DataFrame, places: DataFrame, level: str) -> DataFrame:
    """A coordinate for each label: the one of the place with the smallest id at that level."""
    first = (
        places.filter(F.col(level).isNotNull())
        .groupBy(F.col(level).alias("label"))
        .agg(F.min_by(F.struct("lat", "lng"), F.col("id")).alias("at"))
    )
    return cells.join(first, "label", "left").select(
        *cells.columns, F.col("at.lat").alias("lat"), F.col("at.lng").alias("lng")
    )


def cache_split(
    keys: DataFrame, cache: DataFrame, on: Sequence[str], ttl_seconds: int, as_of: str
) -> DataFrame:
    """Each key with ``is_hit``: whether the cache holds an entry that has not expired.

    Newest entry per key decides; misses are what has to be fetched.
    """
    newest = cache.groupBy(*on).agg(F.max("cached_at").alias("cached_at"))
    now = F.lit(as_of).cast("timestamp")
    alive = F.col("cached_at").cast("timestamp") + F.expr(f"interval {int(ttl_seconds)} seconds") > now
    return keys.join(newest, list(on), "left").withColumn("is_hit", F.coalesce(alive, F.lit(False)))


def lookups_to_fetch(
    detections: DataFrame,
    place_cache: DataFrame,
    stored_places: DataFrame,
    weather_cache: DataFrame,
    stored_weather: DataFrame,
    as_of: str,
    place_seconds: int | None = None,
    weather_seconds: int | None = None,
) -> DataFrame:
    """What has to be asked for detections: places and weather moments neither cached nor stored.

    One row per kind, coordinate and, for weather, moment. Caches hold their key and ``cached_at``.
    """
    moment = weather_datetime(F.col("acq_date"), F.col("acq_time")).alias("datetime")
    asked = (
        ("place", detections.select(*COORDINATE), place_cache, stored_places, place_seconds or location_ttl()),
        ("weather", detections.select(*COORDINATE, moment), weather_cache, stored_weather, weather_seconds or weather_ttl()),
    )
    found = []
    for kind, rows, cache, stored, seconds in asked:
        split = cache_split(rows.distinct(), cache, rows.columns, seconds, as_of)
        missing = new_rows(split.filter(~F.col("is_hit")), stored, rows.columns)
        at = F.col("datetime") if "datetime" in rows.columns else F.lit(None).cast("string")
        found.append(missing.select(F.lit(kind).alias("kind"), *COORDINATE, at.alias("datetime")))
    return found[0].unionByName(found[1])


def location_ttl(hours: int = 6) -> int:
    """Lifetime of a cached place in seconds; the setting counts days of 24 hours."""
    return hours * 24 * 3600


def weather_ttl(hours: int = 24) -> int:
    """Lifetime of cached weather in seconds."""
    return hours * 3600
