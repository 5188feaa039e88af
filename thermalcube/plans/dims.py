"""Dimension builders: one row per id, repeatable ids, stored ids reused."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from thermalcube.functions import detection as det
from thermalcube.functions.time import calendar
from thermalcube.operators.dedup import first_per_key
from thermalcube.operators.filters import valid_location
from thermalcube.operators.lookups import assign_key, new_rows
from thermalcube.operators.shaping import apply_defaults
from thermalcube.schemas import COORDINATE, DIM_LOCATION_COLUMNS

CONFIDENCE_KEY = ["confidence", "instrument"]
STORED_CONFIDENCE_KEY = ["confidence_raw", "source_instrument"]


def dim_period(*dates: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Calendar rows of every date that detections or weather fall on.

    Each frame holds one date column; they are reduced to distinct days before the union.
    """
    days = None
    for frame in dates:
        one = frame.select(F.col(frame.columns[0]).try_cast("date").alias("date_value"))
        one = one.filter(F.col("date_value").isNotNull()).distinct()
        days = one if days is None else days.unionByName(one).distinct()
    attributes = calendar(F.col("date_value"))
    keyed = assign_key(days, existing, ["date_value"])
    return keyed.select("id", "date_value", *[c.alias(n) for n, c in attributes.items()])


def dim_satellite(staged: DataFrame) -> DataFrame:
    """One row per satellite and instrument, with the greatest version."""
    pairs = staged.groupBy("satellite", "instrument").agg(F.max("version").alias("version"))
    info = det.instrument_info(F.col("instrument"))
    return pairs.select(
        det.satellite_id(F.col("satellite"), F.col("instrument")).alias("id"),
        F.col("satellite").alias("satellite_name"),
        "instrument",
        "version",
        *[c.alias(n) for n, c in info.items()],
    )


def dim_confidence(staged: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    # Null and empty have one id, so they are one row.
    pairs = staged.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in CONFIDENCE_KEY]).distinct()
    keyed = assign_key(pairs, existing, CONFIDENCE_KEY, existing_key=STORED_CONFIDENCE_KEY)
    raw, instrument = F.col("confidence"), F.col("instrument")
    return keyed.select(
        "id",
        raw.alias("confidence_raw"),
        instrument.alias("source_instrument"),
        det.confidence_class(raw, instrument).alias("confidence_class"),
        det.confidence_numeric(raw, instrument).alias("confidence_numeric"),
        det.confidence_score(raw, instrument).alias("confidence_score"),
        det.confidence_text(instrument).alias("description"),
    )


def dim_weather_condition(staged: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One row per condition text, with the smallest icon name."""
    text = F.coalesce("conditions", F.lit("")).alias("conditions")
    conditions = staged.groupBy(text).agg(F.min("icon").alias("icon"))
    return assign_key(conditions, existing, ["conditions"]).select("id", "conditions", "icon")


def first_places(places: DataFrame, tie_break: str = "subdistrict_code") -> DataFrame:
    """Accepted places, one per coordinate."""
    return first_per_key(valid_location(places), COORDINATE, [F.col(tie_break)])


def dim_location(
    places: DataFrame, existing: DataFrame | None = None, tie_break: str = "subdistrict_code"
) -> DataFrame:
    """New accepted places, one per coordinate; stored coordinates are left out.

    ``places`` are parsed answers with null where a field is absent.
    """
    once = first_places(places, tie_break)
    if existing is not None:
        # Stored places grow with the record, an answer file does not: stored rows are first cut
        # down to the answered coordinates, a side small enough to be broadcast.
        known = existing.select(*COORDINATE).join(once.select(*COORDINATE), list(COORDINATE), "left_semi")
        once = new_rows(once, known, COORDINATE)
    return apply_defaults(assign_key(once, None, COORDINATE).select(*DIM_LOCATION_COLUMNS))
