"""Expressions on detection attributes: confidence, instrument, satellite id.

Fixed values: instrument names, confidence codes, scores and texts below.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HIGH_FROM = 80
NOMINAL_FROM = 30
HIGH_CODES = ("h", "high")
NOMINAL_CODES = ("n", "nominal")
# Numeric value and score of a category code.
CODE_VALUES = {"HIGH": (85, 0.85), "NOMINAL": (50, 0.50), "LOW": (15, 0.15)}
CONFIDENCE_TEXT = {
    "MODIS": "MODIS confidence percentage (0-100)",
    "VIIRS": "VIIRS confidence category (low/nominal/high)",
}
UNKNOWN_CONFIDENCE_TEXT = "Unknown confidence format"
# Spatial resolution in metres, revisit time in hours, description.
INSTRUMENTS = {
    "MODIS": (1000, 12, "Moderate Resolution Imaging Spectroradiometer"),
    "VIIRS": (375, 6, "Visible Infrared Imaging Radiometer Suite"),
}
UNKNOWN_INSTRUMENT = (1000, 12, "Unknown instrument")


def _by_instrument(instrument: Column, modis: Column, viirs: Column, other: Column) -> Column:
    return F.when(instrument == "MODIS", modis).when(instrument == "VIIRS", viirs).otherwise(other)


def _code_class(raw: Column) -> Column:
    return (
        F.when(raw.isin(*HIGH_CODES), F.lit("HIGH"))
        .when(raw.isin(*NOMINAL_CODES), F.lit("NOMINAL"))
        .otherwise(F.lit("LOW"))
    )


def _code_value(raw: Column, position: int) -> Column:
    label = _code_class(raw)
    return (
        F.when(label == "HIGH", F.lit(CODE_VALUES["HIGH"][position]))
        .when(label == "NOMINAL", F.lit(CODE_VALUES["NOMINAL"][position]))
        .otherwise(F.lit(CODE_VALUES["LOW"][position]))
    )


def confidence_class(raw: Column, instrument: Column) -> Column:
    """HIGH, NOMINAL, LOW or UNKNOWN; an unreadable percentage is LOW."""
    percent = raw.try_cast("int")
    percent_class = (
        F.when(percent >= HIGH_FROM, F.lit("HIGH"))
        .when(percent >= NOMINAL_FROM, F.lit("NOMINAL"))
        .otherwise(F.lit("LOW"))
    )
    return _by_instrument(instrument, percent_class, _code_class(raw), F.lit("UNKNOWN"))


def confidence_numeric(raw: Column, instrument: Column) -> Column:
    return _by_instrument(instrument, raw.try_cast("int"), _code_value(raw, 0), F.lit(0))


def confidence_score(raw: Column, instrument: Column) -> Column:
    share = F.round(raw.try_cast("double") / F.lit(100.0), 4)
    return _by_instrument(instrument, share, _code_value(raw, 1), F.lit(0.0))


def confidence_text(instrument: Column) -> Column:
    return _by_instrument(
        instrument,
        F.lit(CONFIDENCE_TEXT["MODIS"]),
        F.lit(CONFIDENCE_TEXT["VIIRS"]),
        F.lit(UNKNOWN_CONFIDENCE_TEXT),
    )


def app_confidence(label: Column) -> Column:
    """The app's wording of a warehouse class: low, medium, high."""
    return F.when(label == "NOMINAL", F.lit("medium")).otherwise(F.lower(label))


def instrument_info(instrument: Column) -> dict[str, Column]:
    names = ("spatial_resolution_m", "temporal_resolution_hours", "description")
    return {
        name: _by_instrument(
            instrument,
            F.lit(INSTRUMENTS["MODIS"][i]),
            F.lit(INSTRUMENTS["VIIRS"][i]),
            F.lit(UNKNOWN_INSTRUMENT[i]),
        )
        for i, name in enumerate(names)
    }


def satellite_id(satellite: Column, instrument: Column) -> Column:
    """Null when either part is null."""
    return F.concat(satellite, F.lit("_"), instrument)
