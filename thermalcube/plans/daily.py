"""Loading the warehouse: one day's feeds, or whichever days a batch touches.

Tables are folders under one root. Every step overwrites what a previous try of it wrote, so a run
can be repeated after a failure and repeating a finished run changes nothing.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from thermalcube.operators.shaping import apply_defaults, union_vertical
from thermalcube.plans import dims, staging
from thermalcube.plans.follow import follow_staging
from thermalcube.plans.quality import quality_scorecard
from thermalcube.schemas import DAY, DETECTION_KEYS, WAREHOUSE_TABLES, WEATHER_KEYS
from thermalcube.session import scratch
from thermalcube.sources.responses import parse_locations
from thermalcube.sources.tables import append_and_compact, insert_new_dims, stored_tables

STAGING = {
    "staging_detection": ("acq_date", DETECTION_KEYS),
    "staging_weather": ("datetime", WEATHER_KEYS),
}


def load_places(spark: SparkSession, root: str, answers: DataFrame) -> DataFrame:
    """Store new accepted places of geocoder answers; returns all stored places."""
    known, parsed = stored_tables(spark, root, "dim_location").get("dim_location"), parse_locations(answers)
    with scratch(spark, "answered") as path:
        if known is not None:
            # Compared with the stored places and then inserted: parsed once, one row per coordinate kept.
            dims.first_places(parsed).write.parquet(path)
            parsed = spark.read.schema(parsed.schema).parquet(path)
        insert_new_dims(spark, {"dim_location": dims.dim_location(parsed, known)}, root)
    return stored_tables(spark, root, "dim_location")["dim_location"]


def load_staging(spark: SparkSession, root: str, staged: Mapping[str, DataFrame]) -> None:
    """Add staged rows to the staging tables, newest per key kept."""
    for name, rows in staged.items():
        date, keys = STAGING[name]
        rows = apply_defaults(rows)
        # Rows that tie on everything are equal, so the kept row never depends on task order.
        rest = [c for c in rows.columns if c not in keys and c != "ingested_at"]
        append_and_compact(spark, rows, f"{root}/{name}", date, keys, rest)


def load_day(
    spark: SparkSession,
    root: str,
    sources: Mapping[str, DataFrame],
    answers: DataFrame,
    date: str,
    batch_id: str,
    ingested_at: str,
    tie_break: list[str],
    weather: DataFrame | None = None,
    weather_tie_break: list[str] | None = None,
) -> DataFrame:
    """One day's feeds into staging, dimensions and facts; returns the quality verdict.

    Weather may fall on any day. Every day that the feeds touch is brought up to all that is staged for
    it, so a feed that holds less of a day than is staged takes nothing away.
    """
    places = load_places(spark, root, answers)
    staged = staging.extract_day(
        sources, places, date, batch_id, ingested_at, tie_break, weather, weather_tie_break
    )
    days = [spark.createDataFrame([(dt.date.fromisoformat(date),)], f"{DAY} date")]
    if weather is not None:
        days.append(staged["staging_weather"].select(F.col("datetime").try_cast("date").alias(DAY)))
    with scratch(spark, "touched-days") as path:
        union_vertical(*days).distinct().write.parquet(path)
        load_staging(spark, root, staged)
        follow_staging(spark, root, spark.read.parquet(path), places, batch_id)
    return quality_scorecard(stored_tables(spark, root, *WAREHOUSE_TABLES))
