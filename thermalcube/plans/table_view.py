"""Data table: filters, accumulated rows, exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from thermalcube.functions.time import extract_time
from thermalcube.operators.filters import in_dates, in_values, search_location
from thermalcube.plans.star import Star

DEFAULT_SORT = ("tanggal", "desc")
ACCUMULATED_KEYS = ("tanggal", "satelit", "confidence", "provinsi", "kota")


def filter_table(
    rows: DataFrame,
    search: str = "",
    dates: Sequence[str] = (),
    confidence: Sequence[str] = (),
    satellite: Sequence[str] = (),
) -> DataFrame:
    """All table filters together."""
    return search_location(in_values(in_dates(rows, dates), confidence, satellite), search)


def accumulate(rows: DataFrame) -> DataFrame:
    """Detections by date, satellite, confidence, province and city."""
    return rows.groupBy(*ACCUMULATED_KEYS).agg(F.sum("detections").alias("jumlah"))


def accumulate_star(star: Star) -> DataFrame:
    """The same from a star.

    These keys leave nearly as many rows as there are detections, so where places are broadcast they
    are joined first and rows are summed in one shuffle; a large place table is joined to sums.
    """
    if star.small_places:
        return accumulate(star.flat(*ACCUMULATED_KEYS, "detections"))
    return star.totals(
        ACCUMULATED_KEYS,
        {"jumlah": F.col("detections")},
        fact_keys=("tanggal", "satelit", "confidence"),
        keep_unplaced=True,
    )


def export_detail(rows: DataFrame) -> DataFrame:
    """Twelve-column export of single detections."""
    return rows.select(
        F.col("tanggal").alias("Tanggal"),
        extract_time(F.col("detected_at").cast("string")).alias("Waktu"),
        F.col("pulau").alias("Pulau"),
        F.col("provinsi").alias("Provinsi"),
        F.col("kota").alias("Kota"),
        F.col("kecamatan").alias("Kecamatan"),
        F.col("desa").alias("Desa"),
        F.col("satelit").alias("Satelit"),
        F.col("confidence").alias("Confidence"),
        F.col("detections").alias("Jumlah"),
        F.col("lat").alias("Latitude"),
        F.col("lon").alias("Longitude"),
    )


def export_accumulated(accumulated: DataFrame) -> DataFrame:
    """Six-column export of accumulated rows."""
    return accumulated.select(
        F.col("tanggal").alias("Tanggal"),
        F.col("satelit").alias("Satelit"),
        F.col("confidence").alias("Confidence"),
        F.col("provinsi").alias("Provinsi"),
        F.col("kota").alias("Kota"),
        F.col("jumlah").alias("Jumlah"),
    )


def export_label(dates: DataFrame, as_of: str, column: str = "tanggal") -> DataFrame:
    """One row: the date in an export's file name, or first_to_last, or today for no date."""
    first, last = F.min(column).cast("string"), F.max(column).cast("string")
    label = (
        F.when(first.isNull(), F.lit(as_of))
        .when(first == last, first)
        .otherwise(F.concat(first, F.lit("_to_"), last))
    )
    return dates.agg(label.alias("label"))
