"""Facts that follow staging: a day whose facts differ from what is staged is rebuilt as a whole.

Both sides are reduced to one digest per day that no order of rows changes: count, sum and exclusive
or of a hash of every row. A day is rebuilt from all rows staged for it, whatever batch they came
with, and a day that agrees is neither rebuilt nor rewritten.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from thermalcube.operators.digests import compare_days, day_digests
from thermalcube.operators.lookups import keep_located, new_rows
from thermalcube.operators.shaping import apply_defaults, union_vertical
from thermalcube.plans import dims, facts
from thermalcube.plans.kept_counts import follow_facts
from thermalcube.schemas import (
    COORDINATE,
    DAY,
    FACT_DETECTION_COLUMNS,
    FACT_WEATHER_COLUMNS,
    WAREHOUSE_TABLES,
)
from thermalcube.session import scratch
from thermalcube.sources.tables import STAGED_DAY, exists, insert_new_dims, of_days, recover, replace_days, stored_tables

FOLLOWED = "followed_days"
FACTS: dict[str, tuple[str, Callable, Callable, Sequence[str], Sequence[str]]] = {
    "fact_detection": (
        "staging_detection", facts.detection_values, facts.fact_detection, FACT_DETECTION_COLUMNS,
        ("period_id", "location_id", "satellite_id"),
    ),
    "fact_weather": (
        "staging_weather", facts.weather_values, facts.fact_weather, FACT_WEATHER_COLUMNS,
        ("period_id", "location_id", "weather_condition_id"),
    ),
}


def known_places(stored: DataFrame | None, given: DataFrame) -> DataFrame:
    """Id and coordinate of the stored places and of given ones at other coordinates."""
    given = given.select("id", *COORDINATE)
    if stored is None:
        return given
    stored = stored.select("id", *COORDINATE)
    return stored.unionByName(new_rows(given, stored, COORDINATE))


def _places_of(spark: SparkSession, path: str, places: DataFrame, staged: Sequence[DataFrame]) -> DataFrame:
    """Places of the staged coordinates only.

    The coordinates are stored first, so their true size decides: those of a daily batch are broadcast
    and the place table, which grows with the record, is filtered without a shuffle.
    """
    union_vertical(*[df.select(*COORDINATE) for df in staged]).distinct().write.parquet(path)
    asked = spark.read.schema("latitude string, longitude string").parquet(path)
    return places.join(asked, list(COORDINATE), "left_semi")


def _dimensions(hot: DataFrame | None, wet: DataFrame | None, stored: facts.Stored) -> dict[str, DataFrame]:
    """The dimension rows that the staged rows need."""
    built, dates = {}, []
    if hot is not None:
        attributes = hot.groupBy("satellite", "instrument", "confidence", "acq_date").agg(F.max("version").alias("version"))
        built["dim_satellite"] = dims.dim_satellite(attributes)
        built["dim_confidence"] = dims.dim_confidence(attributes, stored.get("dim_confidence"))
        dates.append(attributes.select("acq_date"))
    if wet is not None:
        built["dim_weather_condition"] = dims.dim_weather_condition(wet, stored.get("dim_weather_condition"))
        dates.append(wet.select(F.col("datetime").try_cast("date")))
    return {"dim_period": dims.dim_period(*dates, existing=stored.get("dim_period")), **built}


def follow_staging(spark: SparkSession, root: str, days: DataFrame, places: DataFrame, run: str) -> DataFrame:
    """Bring the facts of ``days`` (first column) up to what is staged; returns the verdict per day.

    The verdict (table_name, date_value, staged_rows, fact_rows before, rebuilt) is kept in the table
    ``followed_days`` under ``run``; a run repeated replaces its own. Only days with staged rows are
    looked at, so facts whose staging has been cleared stay. Kept day counts follow the facts. Places are the stored ones and the given
    ones at coordinates without a stored place.
    """
    for name in ("staging_detection", "staging_weather"):
        recover(spark, f"{root}/{name}")
    stored = stored_tables(spark, root, *WAREHOUSE_TABLES)
    log = f"{root}/{FOLLOWED}"
    chosen = {f: of_days(stored[s], STAGED_DAY, days) for f, (s, *_) in FACTS.items() if s in stored}
    with scratch(spark, "coordinates") as path:
        near = _places_of(spark, path, known_places(stored.get("dim_location"), places), list(chosen.values()))
        verdicts = []
        for name, staged in chosen.items():
            _, values, _, columns, _ = FACTS[name]
            hashed = [c for c in columns if c not in ("location_id", DAY)]
            expected = apply_defaults(values(keep_located(staged, near), stored).select(*hashed, DAY))
            present = of_days(stored[name], DAY, days) if name in stored else None
            compared = compare_days(
                day_digests(expected, DAY, hashed), None if present is None else day_digests(present, DAY, hashed)
            )
            verdicts.append(compared.filter(F.col(DAY).isNotNull()).select(F.lit(run).alias("run"), F.lit(name).alias("table_name"), "*"))
        union_vertical(*verdicts).coalesce(1).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("run").parquet(log)
        verdict = spark.read.schema(verdicts[0].schema).parquet(log).filter(F.col("run") == run)
        changed = {
            name: verdict.filter(F.col("rebuilt") & (F.col("table_name") == name)).select(DAY) for name in chosen
        }
        changed = {name: days_of for name, days_of in changed.items() if not days_of.isEmpty()}
        rows = {name: of_days(stored[FACTS[name][0]], STAGED_DAY, days_of) for name, days_of in changed.items()}
        if rows:
            insert_new_dims(spark, _dimensions(rows.get("fact_detection"), rows.get("fact_weather"), stored), root)
        for name, staged in rows.items():
            _, _, build, _, order = FACTS[name]
            replace_days(build(staged, near, stored)[0], f"{root}/{name}", DAY, order)
    follow_facts(spark, root, days)
    return verdict.drop("run")


def days_to_follow(spark: SparkSession, root: str) -> DataFrame:
    """All days that anything is staged for."""
    found = [
        spark.read.parquet(f"{root}/{name}").select(F.col(STAGED_DAY).alias(DAY)).distinct()
        for name in ("staging_detection", "staging_weather") if exists(spark, f"{root}/{name}")
    ]
    return union_vertical(*found).distinct()
