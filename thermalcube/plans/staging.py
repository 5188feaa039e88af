"""Staging: from landed detections, places and weather to staged batches."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from thermalcube.operators.dedup import dedup_detections, dedup_weather
from thermalcube.operators.filters import for_date
from thermalcube.operators.lookups import keep_located
from thermalcube.operators.shaping import (
    align_detections,
    align_weather,
    all_to_string,
    narrow_weather_types,
    tag_batch,
    tag_source,
    union_diagonal,
)
from thermalcube.schemas import DAILY_SOURCES, WEATHER_KEYS

SOURCE_RANK = "__source_rank"


def combine_sources(sources: Mapping[str, DataFrame]) -> DataFrame:
    """All sources as text, tagged; the rank says which source's copy is kept first."""
    order = {name: i for i, name in enumerate(DAILY_SOURCES)}
    frames = [
        tag_source(all_to_string(df), name).withColumn(
            SOURCE_RANK, F.lit(order.get(name, len(order) + i))
        )
        for i, (name, df) in enumerate(sources.items())
    ]
    return union_diagonal(*frames)


def detections_of_day(
    sources: Mapping[str, DataFrame], date: str, tie_break: list[str]
) -> DataFrame:
    """One day's detections of all sources, repeated ones kept once.

    Each source is filtered on its own column type, before everything becomes text, so the filter
    reaches the source's scan.
    """
    rows = combine_sources({name: for_date(df, date) for name, df in sources.items()})
    order = [F.col(SOURCE_RANK), *[F.col(c) for c in tie_break]]
    return dedup_detections(rows, order).drop(SOURCE_RANK)


def extract_day(
    sources: Mapping[str, DataFrame],
    places: DataFrame,
    date: str,
    batch_id: str,
    ingested_at: str,
    tie_break: list[str],
    weather: DataFrame | None = None,
    weather_tie_break: list[str] | None = None,
) -> dict[str, DataFrame]:
    """Staged detections, and staged weather where given, of one day's accepted places."""
    located = keep_located(detections_of_day(sources, date, tie_break), places)
    staged = {
        "staging_detection": align_detections(tag_batch(located, batch_id, ingested_at)),
    }
    if weather is not None:
        staged["staging_weather"] = stage_weather(
            keep_located(weather, places), batch_id, ingested_at, weather_tie_break or []
        )
    return staged


def stage_weather(
    weather: DataFrame, batch_id: str, ingested_at: str, tie_break: list[str]
) -> DataFrame:
    # Rows that tie on everything are equal, so the kept row never depends on task order.
    rest = tie_break or [c for c in weather.columns if c not in WEATHER_KEYS]
    once = dedup_weather(weather, [F.col(c) for c in rest or WEATHER_KEYS])
    return align_weather(tag_batch(narrow_weather_types(once), batch_id, ingested_at))
