"""Day counts kept beside the facts, and the star that answers cube questions from them.

A row counts the detections of a day, an area (the names of the five levels' lower four, not a
coordinate, of which nearly every detection has its own), a satellite and a confidence. Days are
recounted as their facts change: each day's rows carry the digest of the facts they were counted from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from thermalcube.functions.text import surrogate_id
from thermalcube.operators.digests import DIGEST, compare_days, day_digests
from thermalcube.operators.shaping import apply_defaults
from thermalcube.schemas import AREA_NAMES, DAY
from thermalcube.session import scratch
from thermalcube.sources.tables import exists, insert_new_dims, of_days, replace_days

COUNTS = "day_counts"
AREAS = "dim_area"
COUNTED = ("id", "location_id", "satellite_id", "confidence_id")


def area_counts(facts: DataFrame, places: DataFrame) -> DataFrame:
    """Detections by day, area names, satellite and confidence.

    Facts are counted per coordinate before places are joined, and the counts per area after, so a hot
    place is a few rows in the join. Facts without a stored place count under null names, as do those of
    a place table that lacks a name's column.
    """
    keys = ["satellite_id", "confidence_id", DAY]
    per_place = facts.groupBy("location_id", *keys).agg(F.count(F.lit(1)).alias("detections"))
    names = [F.col(c) if c in places.columns else F.lit(None).cast("string").alias(c) for c in AREA_NAMES]
    named = per_place.join(places.select(F.col("id").alias("location_id"), *names), "location_id", "left")
    return named.groupBy(*AREA_NAMES, *keys).agg(F.sum("detections").alias("detections"))


def with_area_id(named: DataFrame) -> DataFrame:
    """The hashed id of the names; rows without a place have none."""
    placed = F.coalesce(*[F.col(c) for c in AREA_NAMES]).isNotNull()
    return named.withColumn("area_id", F.when(placed, surrogate_id(*[F.col(c) for c in AREA_NAMES])))


def follow_facts(spark: SparkSession, root: str, days: DataFrame) -> None:
    """Recount the days whose facts differ from those that were counted; other days are not touched."""
    if not exists(spark, f"{root}/fact_detection") or not exists(spark, f"{root}/dim_location"):
        return
    facts = of_days(spark.read.parquet(f"{root}/fact_detection"), DAY, days)
    counts, present = f"{root}/{COUNTS}", None
    if exists(spark, counts):
        stored = of_days(spark.read.parquet(counts), DAY, days)
        present = stored.groupBy(DAY).agg(*[F.max(c).alias(c) for c in DIGEST])
    digests = day_digests(facts, DAY, COUNTED)
    with scratch(spark, "stamps") as stamped, scratch(spark, "counts") as counted:
        compared = compare_days(digests, present).filter("rebuilt").select(DAY)
        digests.join(compared, DAY, "left_semi").write.parquet(stamped)
        stamps = spark.read.parquet(stamped)
        if stamps.isEmpty():
            return
        fresh = of_days(spark.read.parquet(f"{root}/fact_detection"), DAY, stamps.select(DAY))
        with_area_id(area_counts(fresh, spark.read.parquet(f"{root}/dim_location"))).write.parquet(counted)
        rows = spark.read.parquet(counted)
        areas = rows.filter(F.col("area_id").isNotNull()).select(F.col("area_id").alias("id"), *AREA_NAMES).distinct()
        insert_new_dims(spark, {AREAS: apply_defaults(areas)}, root)
        # One row per day: a calendar's worth at most.
        marked = rows.join(F.broadcast(stamps), DAY).select("area_id", "satellite_id", "confidence_id", "detections", *DIGEST, DAY)
        replace_days(marked, counts, DAY, ["area_id", "satellite_id"])
