"""Place and weather responses (JSON text) to typed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from thermalcube.functions.time import weather_datetime
from thermalcube.operators.filters import valid_location
from thermalcube.schemas import COORDINATE, PLACE_FIELDS, WEATHER_FIELDS

_TEXT_FIELDS = ("conditions", "icon")


def flatten_weather(df: DataFrame, column: str = "response") -> DataFrame:
    """Current conditions as columns; absent numbers are 0 and absent texts empty."""
    ddl = ", ".join(f"{f} {'string' if f in _TEXT_FIELDS else 'double'}" for f in WEATHER_FIELDS)
    parsed = F.from_json(column, f"currentConditions struct<{ddl.replace(' ', ':')}>".replace(",:", ","))
    now = F.col("__response.currentConditions")
    values = {
        name: F.coalesce(now.getField(f), F.lit("") if f in _TEXT_FIELDS else F.lit(0.0))
        for f, name in WEATHER_FIELDS.items()
    }
    rows = df.withColumn("__response", parsed)
    return rows.withColumns(
        {"datetime": weather_datetime(F.col("acq_date"), F.col("acq_time")), **values}
    ).drop("__response")


def parse_locations(df: DataFrame, column: str = "response") -> DataFrame:
    """Place response fields as columns, null where absent."""
    ddl = ", ".join(f"{f} string" for f in PLACE_FIELDS)
    place = F.from_json(column, ddl)
    # Out of a generator, so that a later filter on several fields does not parse the text for each of them.
    rows = df.withColumn("__place", F.explode(F.array(place)))
    return rows.withColumns(
        {name: F.col(f"__place.{f}") for f, name in PLACE_FIELDS.items()}
    ).drop("__place")


def flatten_locations(df: DataFrame, column: str = "response", *keep: str) -> DataFrame:
    """Coordinate and eight place columns; absent fields are empty."""
    names = list(PLACE_FIELDS.values())
    rows = parse_locations(df, column)
    return rows.select(
        *keep, *COORDINATE, *[F.coalesce(c, F.lit("")).alias(c) for c in names]
    )


def accepted_locations(df: DataFrame, column: str = "response", *keep: str) -> DataFrame:
    """Flattened places after the acceptance rule on the raw fields."""
    names = list(PLACE_FIELDS.values())
    rows = valid_location(parse_locations(df, column))
    return rows.select(
        *keep, *COORDINATE, *[F.coalesce(c, F.lit("")).alias(c) for c in names]
    )
