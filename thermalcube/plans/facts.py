"""Fact builders.

Ids of new dimension rows are hashes of their natural keys, so facts get them by an expression;
only stored dimensions and the place mapping are joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from thermalcube.functions.detection import satellite_id
from thermalcube.functions.text import detection_key, surrogate_id, weather_key
from thermalcube.functions.time import acquired_at
from thermalcube.operators.filters import for_batch, latest_batch, require_fk
from thermalcube.operators.lookups import assign_key, attach_location, location_mapping
from thermalcube.operators.shaping import apply_defaults, measure_casts
from thermalcube.plans.dims import (
    CONFIDENCE_KEY,
    STORED_CONFIDENCE_KEY,
    dim_confidence,
    dim_period,
    dim_satellite,
    dim_weather_condition,
)
from thermalcube.schemas import (
    DAY,
    DETECTION_KEYS,
    FACT_DETECTION_COLUMNS,
    FACT_MEASURES,
    FACT_WEATHER_COLUMNS,
    WEATHER_KEYS,
)

Stored = dict[str, DataFrame]


def attach_dim_keys(staged: DataFrame, stored: Stored | None = None) -> DataFrame:
    """Satellite, confidence and period ids of staged detections."""
    stored = stored or {}
    rows = staged.withColumn("satellite_id", satellite_id(F.col("satellite"), F.col("instrument")))
    rows = assign_key(
        rows, stored.get("dim_confidence"), CONFIDENCE_KEY, "confidence_id", STORED_CONFIDENCE_KEY
    )
    rows = rows.withColumn(DAY, F.col("acq_date").try_cast("date"))
    return assign_key(rows, stored.get("dim_period"), [DAY], "period_id")


def detection_values(staged: DataFrame, stored: Stored | None = None) -> DataFrame:
    """Staged detections with every column of a fact but the place."""
    rows = attach_dim_keys(staged, stored).withColumns(
        {
            "id": surrogate_id(detection_key(*[F.col(c) for c in DETECTION_KEYS])),
            "acquired_at": acquired_at(F.col("acq_date"), F.col("acq_time")),
            **{m: F.lit(None).cast("float") for m in FACT_MEASURES if m not in staged.columns},
        }
    )
    return measure_casts(rows)


def weather_values(staged: DataFrame, stored: Stored | None = None) -> DataFrame:
    """Staged weather with every column of a fact but the place."""
    stored = stored or {}
    instant = F.col("datetime").try_cast("timestamp")
    rows = staged.withColumns({"acquired_at": instant, DAY: instant.cast("date")})
    rows = assign_key(rows, stored.get("dim_period"), [DAY], "period_id")
    rows = assign_key(
        rows, stored.get("dim_weather_condition"), ["conditions"], "weather_condition_id"
    )
    return rows.withColumn("id", surrogate_id(weather_key(*[F.col(c) for c in WEATHER_KEYS])))


def fact_detection(
    staged: DataFrame, locations: DataFrame, stored: Stored | None = None, watch: str = "fact_detection"
):
    """Detection facts of accepted places, and the observation that counts rejected rows."""
    located = attach_location(staged, location_mapping(locations))
    kept, observation = require_fk(located, "location_id", watch)
    rows = detection_values(kept, stored).select(*FACT_DETECTION_COLUMNS)
    return apply_defaults(rows), observation


def fact_weather(
    staged: DataFrame, locations: DataFrame, stored: Stored | None = None, watch: str = "fact_weather"
):
    """Weather facts of accepted places, and the observation that counts rejected rows."""
    located = attach_location(staged, location_mapping(locations))
    kept, observation = require_fk(located, "location_id", watch)
    return apply_defaults(weather_values(kept, stored).select(*FACT_WEATHER_COLUMNS)), observation


def transform_batch(
    staging_detection: DataFrame,
    staging_weather: DataFrame | None,
    locations: DataFrame,
    batch_id: str | None = None,
    stored: Stored | None = None,
) -> dict[str, DataFrame]:
    """All dimensions and facts of one batch (the newest if none is named).

    Lazy as a whole. Facts are those of the batch; ``follow_staging`` stores a day's facts from all that
    is staged for it.
    """
    stored = stored or {}

    def pick(df: DataFrame) -> DataFrame:
        return for_batch(df, batch_id) if batch_id else latest_batch(df)

    detections = pick(staging_detection)
    # A few attribute rows feed three dimensions; plans that use several of them share one exchange.
    attributes = detections.groupBy("satellite", "instrument", "confidence", "acq_date").agg(F.max("version").alias("version"))
    tables = {
        "dim_satellite": dim_satellite(attributes),
        "dim_confidence": dim_confidence(attributes, stored.get("dim_confidence")),
        "fact_detection": fact_detection(detections, locations, stored)[0],
    }
    dates = [attributes.select("acq_date")]
    if staging_weather is not None:
        weather = pick(staging_weather)
        dates.append(weather.select(F.col("datetime").try_cast("date")))
        tables["dim_weather_condition"] = dim_weather_condition(
            weather, stored.get("dim_weather_condition")
        )
        tables["fact_weather"] = fact_weather(weather, locations, stored)[0]
    tables["dim_period"] = dim_period(*dates, existing=stored.get("dim_period"))
    return tables
