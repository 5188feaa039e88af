"""The star: detections, and the places they point to.

Every place-level question joins two tables of very different size. ``Star`` keeps them apart, so
that detections are first summed per place, map-side, by one narrow key: each place is then joined
once, a hot place is one row, and texts are only grouped over places. Row-level questions join
places to detections, broadcast where their checked size allows it.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from thermalcube.functions.detection import app_confidence
from thermalcube.functions.time import time_attributes
from thermalcube.plans.query import CubeQuery, conjunction
from thermalcube.plans.kept_counts import AREAS, COUNTS
from thermalcube.schemas import AREA_NAMES, DAY, PLACE_LEVELS
from thermalcube.session import fits_broadcast

PLACE_KEY = "place_key"


@dataclass(frozen=True)
class Star:
    """``facts`` has one row per detection with ``place_key``; ``places`` one row per key.

    ``lookups`` are further dimensions: the fact column that is their key, and a table of that key
    and its attributes, one row per key. A lookup is joined only where an attribute is used.

    ``kept`` is a star over stored counts of the same detections, by fewer columns. Sums of detections
    and lists of days are answered from it where it holds all columns that a question uses.
    """

    facts: DataFrame
    places: DataFrame
    small_places: bool = False
    lookups: tuple[tuple[str, DataFrame], ...] = ()
    kept: Star | None = None

    def smallest(self, used: Iterable[str]) -> Star:
        """The star with fewest rows that holds the used columns: the kept counts, or this one."""
        if self.kept is None:
            return self
        held = set(self.kept.facts.columns) | set(self.kept.places.columns)
        held |= {c for key, table in self.kept.lookups for c in table.columns}
        return self.kept if set(used) <= held else self

    def joined_places(self) -> DataFrame:
        """Places, marked for broadcast only where their checked size allows it."""
        return F.broadcast(self.places) if self.small_places else self.places

    def detections(self, used: Iterable[str]) -> DataFrame:
        """Fact rows with the attributes that are used.

        Left joins on unique keys keep every detection and add none, so leaving one out changes
        no result.
        """
        used = set(used)
        rows = self.facts
        for key, table in self.lookups:
            if used & (set(table.columns) - {key}):
                rows = rows.join(table, key, "left")
        return rows

    def flat(self, *columns: str) -> DataFrame:
        """Flat feature rows of the asked columns."""
        rows = self.detections(columns)
        if any(c in self.places.columns and c not in rows.columns for c in columns):
            rows = rows.join(self.joined_places(), PLACE_KEY, "left")
        return rows.select(*columns)

    def totals(
        self,
        by: Sequence[str | Column],
        measures: Mapping[str, Column] | None = None,
        query: CubeQuery = CubeQuery(),
        fact_keys: Sequence[str] = (),
        used: Sequence[str] = (),
        keep_unplaced: bool = False,
    ) -> DataFrame:
        """Sums of additive ``measures`` by place columns and ``fact_keys`` under a query.

        Detections are summed per place (and fact key) before the places are joined. ``used``
        names fact attributes that the measures read besides the stored ones.
        """
        if measures is None and (small := self.smallest({*query.fact_columns(), *fact_keys, *used})) is not self:
            return small.totals(by, None, query, fact_keys, used, keep_unplaced)
        measures = dict(measures or {"total": F.col("detections")})
        facts = self.detections({*query.fact_columns(), *fact_keys, *used})
        facts = facts.filter(conjunction(query.fact_tests()))
        places = self.joined_places().filter(conjunction(query.place_tests()))
        per_place = facts.groupBy(PLACE_KEY, *fact_keys).agg(
            *[F.sum(value).alias(name) for name, value in measures.items()]
        )
        joined = per_place.join(places, PLACE_KEY, "left" if keep_unplaced else "inner")
        return joined.groupBy(*by).agg(*[F.sum(name).alias(name) for name in measures])

    def totals_by(self, attribute: str, query: CubeQuery = CubeQuery()) -> DataFrame:
        """Detections by one fact attribute, as (label, total); places are joined only if tested."""
        if query.place_tests():
            return self.totals([F.col(attribute).alias("label")], query=query, fact_keys=[attribute])
        used = {attribute, *query.fact_columns()}
        rows = self.smallest(used).detections(used).filter(conjunction(query.fact_tests()))
        return rows.groupBy(F.col(attribute).alias("label")).agg(F.sum("detections").alias("total"))

    def days(self, query: CubeQuery = CubeQuery()) -> DataFrame:
        """Distinct dates with detections under a query."""
        if (small := self.smallest(query.fact_columns())) is not self:
            return small.days(query)
        facts = self.detections(query.fact_columns()).filter(conjunction(query.fact_tests()))
        if query.place_tests():
            places = self.joined_places().filter(conjunction(query.place_tests()))
            if not self.small_places:
                facts = facts.select(PLACE_KEY, "tanggal").distinct()
            facts = facts.join(places.select(PLACE_KEY), PLACE_KEY, "left_semi")
        return facts.select("tanggal").distinct()


def warehouse_star(tables: dict[str, DataFrame], islands: DataFrame) -> Star:
    """The star over the stored tables; an island table names each province's island.

    With the tables ``day_counts`` and ``dim_area`` among them, cube questions are answered from those.
    """
    location = tables["dim_location"].select("id", *AREA_NAMES)
    places = _named_places(location, islands)
    # The day column is the partition of the stored facts, so date filters prune folders.
    facts = tables["fact_detection"].select(
        "id",
        "period_id",
        "satellite_id",
        "confidence_id",
        F.col("location_id").alias(PLACE_KEY),
        F.col(DAY).alias("tanggal"),
        F.col("acquired_at").alias("detected_at"),
        F.lit(1).cast("bigint").alias("detections"),
        F.col("latitude").try_cast("double").alias("lat"),
        F.col("longitude").try_cast("double").alias("lon"),
    )
    lookups = (
        (
            "period_id",
            tables["dim_period"].select(F.col("id").alias("period_id"), "week_value", "month_name"),
        ),
        (
            "satellite_id",
            tables["dim_satellite"].select(
                F.col("id").alias("satellite_id"), F.col("satellite_name").alias("satelit")
            ),
        ),
        (
            "confidence_id",
            tables["dim_confidence"].select(
                F.col("id").alias("confidence_id"),
                app_confidence(F.col("confidence_class")).alias("confidence"),
            ),
        ),
    )
    return Star(facts, places, fits_broadcast(location), lookups, _kept_star(tables, islands, lookups))


def _named_places(location: DataFrame, islands: DataFrame) -> DataFrame:
    """Place names by level; one island per province, so a province listed twice doubles no place."""
    island = islands.groupBy("province_name").agg(F.min("pulau").alias("pulau"))
    return location.join(island, "province_name", "left").select(
        F.col("id").alias(PLACE_KEY),
        F.col("pulau"),
        F.col("province_name").alias("provinsi"),
        F.col("city_name").alias("kota"),
        F.col("district_name").alias("kecamatan"),
        F.col("subdistrict_name").alias("desa"),
    )


def _kept_star(tables: dict[str, DataFrame], islands: DataFrame, lookups: tuple) -> Star | None:
    """The star over the kept day counts, where they are stored."""
    if COUNTS not in tables or AREAS not in tables:
        return None
    counts = tables[COUNTS].select(
        F.col("area_id").alias(PLACE_KEY), "satellite_id", "confidence_id", F.col(DAY).alias("tanggal"), "detections"
    )
    areas = tables[AREAS]
    held = tuple((key, table) for key, table in lookups if key in counts.columns)
    return Star(counts, _named_places(areas, islands), fits_broadcast(areas), held)


def star_join(tables: dict[str, DataFrame], islands: DataFrame) -> DataFrame:
    """Flat feature rows: detection, place, date, satellite and confidence."""
    return warehouse_star(tables, islands).flat(
        "id", "tanggal", "detected_at", "satelit", "confidence", *PLACE_LEVELS,
        "week_value", "detections", "lat", "lon",
    )


def with_time_members(df: DataFrame) -> DataFrame:
    return df.withColumns(time_attributes(F.col("tanggal")))
