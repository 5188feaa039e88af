"""Landing-page figures: KPIs, trend, top island, date counts, point clusters."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F

from thermalcube.functions.geo import pixel_x, pixel_y
from thermalcube.functions.time import month_name_id
from thermalcube.operators.filters import between_dates, on_day
from thermalcube.operators.ranking import latest_n
from thermalcube.plans.star import PLACE_KEY, Star

UNKNOWN = "Unknown"
# Cluster sizes: more than 100 points is large, more than 20 medium.
CLUSTER_PIXELS = 50
LARGE_CLUSTER = 100
MEDIUM_CLUSTER = 20
NO_CLUSTERS_FROM_ZOOM = 13


def _is_high() -> Column:
    return F.col("confidence") == "high"



def count_by_date(rows: DataFrame) -> DataFrame:
    """Rows per date; rows without a date are counted as Unknown."""
    label = F.coalesce(F.col("tanggal").cast("string"), F.lit(UNKNOWN))
    return rows.groupBy("tanggal").agg(F.count(F.lit(1)).alias("total")).select(
        label.alias("tanggal"), "total"
    )


def monthly_trend(rows: DataFrame) -> DataFrame:
    """Detections and high-confidence detections per month, oldest first."""
    return (
        rows.filter(F.col("tanggal").isNotNull())
        .groupBy(F.year("tanggal").alias("tahun"), F.month("tanggal").alias("bulan"))
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(_is_high()).alias("high_confidence"),
        )
        .withColumn(
            "label",
            F.concat_ws(" ", month_name_id(F.col("bulan")), F.col("tahun").cast("string")),
        )
        .orderBy("tahun", "bulan")
    )


def kpis(star: Star) -> DataFrame:
    """One row: detections, high-confidence detections, provinces with detections."""
    by_province = star.totals(
        ["provinsi"],
        {"n": F.lit(1), "high": _is_high().cast("int")},
        used=["confidence"],
        keep_unplaced=True,
    )
    named = F.coalesce(F.col("provinsi"), F.lit("")) != ""
    zero = F.lit(0).cast("bigint")
    return by_province.agg(
        F.coalesce(F.sum("n"), zero).alias("total"),
        F.coalesce(F.sum("high"), zero).alias("high_confidence"),
        F.count_if(named).alias("provinces"),
    )


def kpis_on(star: Star, as_of: str) -> DataFrame:
    return kpis(replace(star, facts=on_day(star.facts, as_of), kept=None))


def recent_total(rows: DataFrame, as_of: str, first: str = "2015-01-01") -> DataFrame:
    """Detections from the first day of the record to ``as_of``."""
    return between_dates(rows, first, as_of).agg(F.count(F.lit(1)).alias("total"))


def top_island(star: Star) -> DataFrame:
    """The island with most detections; equal counts are ordered by name."""
    island = F.when(F.col("pulau") != "", F.col("pulau")).otherwise(F.lit(UNKNOWN))
    return (
        star.totals([island.alias("pulau")], {"total": F.lit(1)}, keep_unplaced=True)
        .orderBy(F.desc("total"), "pulau")
        .limit(1)
    )


def latest_detections(star: Star, n: int = 5, *columns: str) -> DataFrame:
    """Newest detections with their places.

    The rows are chosen among the detections alone. A large place table is not shuffled for them: it is
    filtered by their broadcast keys.
    """
    newest = latest_n(star.facts, n)
    places = star.places
    if not star.small_places:
        # At most n keys; choosing them again costs a scan of two narrow columns.
        keys = F.broadcast(newest.select(PLACE_KEY).distinct())
        places = places.join(keys, PLACE_KEY, "left_semi")
    return replace(star, facts=newest, places=places, kept=None).flat(*columns)


def _size_class(total: Column) -> Column:
    return (
        F.when(total > LARGE_CLUSTER, F.lit("large"))
        .when(total > MEDIUM_CLUSTER, F.lit("medium"))
        .otherwise(F.lit("small"))
    )


def cluster_pyramid(rows: DataFrame, deepest: int = NO_CLUSTERS_FROM_ZOOM - 1) -> DataFrame:
    """The clusters of all zooms from 0 to ``deepest`` from one scan: (zoom, cell_x, cell_y, total, lat, lon, size_class).

    The world doubles with a zoom while a cell stays 50 pixels wide, so a cell holds exactly four of the
    next zoom. Points are summed once, by their cell at the deepest zoom; a coarser zoom's cell is that
    cell's numbers without their last bits, and its sums are those of the cells it holds.
    """
    finest = rows.groupBy(*_cell(deepest)).agg(
        F.count(F.lit(1)).alias("total"), F.sum("lat").alias("lat"), F.sum("lon").alias("lon"),
        F.count("lat").alias("lats"), F.count("lon").alias("lons"),
    )
    # Every cell once per zoom: what is multiplied is cells, not points.
    each = finest.withColumn("zoom", F.explode(F.sequence(F.lit(0), F.lit(deepest))))
    coarser = {c: F.expr(f"shiftright({c}, {deepest} - zoom)") for c in ("cell_x", "cell_y")}
    summed = each.withColumns(coarser).groupBy("zoom", "cell_x", "cell_y").agg(
        *[F.sum(c).alias(c) for c in ("total", "lat", "lon", "lats", "lons")]
    )
    return summed.select(
        "zoom",
        "cell_x",
        "cell_y",
        "total",
        F.try_divide("lat", "lats").alias("lat"),
        F.try_divide("lon", "lons").alias("lon"),
        _size_class(F.col("total")).alias("size_class"),
    )


def _cell(zoom: int) -> list[Column]:
    return [
        F.floor(pixel_x(F.col("lon"), zoom) / CLUSTER_PIXELS).alias("cell_x"),
        F.floor(pixel_y(F.col("lat"), zoom) / CLUSTER_PIXELS).alias("cell_y"),
    ]


def cluster_points(rows: DataFrame, zoom: int) -> DataFrame:
    """Points grouped by 50-pixel map cells with their mean coordinate and a size class; single points
    from zoom 13."""
    if zoom >= NO_CLUSTERS_FROM_ZOOM:
        return rows.select("id", "lat", "lon", F.lit(1).cast("bigint").alias("total"))
    return (
        rows.groupBy(*_cell(zoom))
        .agg(F.count(F.lit(1)).alias("total"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
        .withColumn("size_class", _size_class(F.col("total")))
    )
