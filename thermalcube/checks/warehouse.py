"""Queries of dimensions, facts, stored tables and their quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from thermalcube.checks.registry import query
from thermalcube.checks.staging import accepted, by_source, weather
from thermalcube.checks.views import detections, locations, place_responses, weather_responses
from thermalcube.functions.time import weather_datetime
from thermalcube.operators import dedup, lookups, shaping
from thermalcube.plans import backfill, cube, daily, dims, facts, follow, quality, questions
from thermalcube.plans.kept_counts import AREAS, COUNTS
from thermalcube.plans.star import star_join as join_star, warehouse_star
from thermalcube.schemas import DETECTION_KEYS, WEATHER_KEYS, WAREHOUSE_TABLES
from thermalcube.session import scratch_path
from thermalcube.sources import tables
from thermalcube.sources.responses import flatten_weather, parse_locations


def staged(spark, sf) -> DataFrame:
    return dedup.latest_by_key(detections(spark, sf), tie_break=[F.col("event_id")])


def staged_weather(spark, sf) -> DataFrame:
    """The newest answer of each key; only answers that are kept are parsed."""
    asked = weather_responses(spark, sf).withColumn("datetime", weather_datetime(F.col("acq_date"), F.col("acq_time")))
    return shaping.narrow_weather_types(flatten_weather(dedup.latest_by_key(asked, WEATHER_KEYS, [F.col("event_id")])))


def stored_staging(spark, sf, root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Both staging tables as stored by month, so that each consumer only scans what it needs.

    They lie in the warehouse ``root``, if there is one, under their names.
    """
    frames = []
    for rows, date, name in (
        (staged(spark, sf), "acq_date", "detection"),
        (staged_weather(spark, sf), "acq_date", "weather"),
    ):
        path = f"{root}/staging_{name}" if root else scratch_path(spark, f"staging-{name}")
        tables.write_partitioned(rows, path, date, ("latitude", "longitude"))
        frames.append(spark.read.schema(rows.schema).parquet(path))
    return frames[0], frames[1]


def warehouse_tables(spark, sf, root: str | None = None) -> dict[str, DataFrame]:
    """All nine tables built from every staged row; the staging tables are stored, in ``root`` if given."""
    (hot, wet), places = stored_staging(spark, sf, root), accepted(spark, sf)
    built = {
        "staging_detection": hot,
        "staging_weather": wet,
        "dim_period": dims.dim_period(hot.select("acq_date"), wet.select("acq_date")),
        "dim_location": places,
        "dim_satellite": dims.dim_satellite(hot),
        "dim_confidence": dims.dim_confidence(hot),
        "dim_weather_condition": dims.dim_weather_condition(wet),
        "fact_detection": facts.fact_detection(hot, places)[0],
        "fact_weather": facts.fact_weather(wet, places)[0],
    }
    return {name: built[name] for name in WAREHOUSE_TABLES}


# ---------------------------------------------------------------- dimensions


@query(
    """SELECT DISTINCT sha256(cast(acq_date AS varchar)) AS id, acq_date AS date_value,
  cast(year(acq_date) AS integer) AS year_value, CASE WHEN month(acq_date) <= 6 THEN 1 ELSE 2 END AS semester_value,
  cast(quarter(acq_date) AS integer) AS quarter_value, cast(month(acq_date) AS integer) AS month_value,
  monthname(acq_date) AS month_name, cast(weekofyear(acq_date) AS integer) AS week_value
FROM (SELECT acq_date FROM det UNION ALL SELECT cast(acq_date + INTERVAL 7 DAY AS date) FROM wflat)"""
)
def dim_period(spark, sf):
    """Dates of detections and of weather alike, the weather moved by a week."""
    wet = weather(spark, sf).selectExpr("cast(datetime AS timestamp) + INTERVAL 7 DAYS AS datetime")
    return dims.dim_period(detections(spark, sf).select("acq_date"), wet)


@query(
    """SELECT DISTINCT CASE WHEN day(acq_date) <= 10 THEN concat('P', cast(acq_date AS varchar))
  ELSE sha256(cast(acq_date AS varchar)) END AS id, acq_date AS date_value FROM det"""
)
def dim_period_reuses_ids(spark, sf):
    days = detections(spark, sf).select("acq_date")
    stored = (
        days.distinct()
        .filter(F.dayofmonth("acq_date") <= 10)
        .select(F.concat(F.lit("P"), F.col("acq_date").cast("string")).alias("id"),
                F.col("acq_date").alias("date_value"))
    )
    return dims.dim_period(days, existing=stored).select("id", "date_value")


@query(
    """SELECT concat(satellite, '_', instrument) AS id, satellite AS satellite_name, instrument, max(version) AS version,
  CASE instrument WHEN 'VIIRS' THEN 375 ELSE 1000 END AS spatial_resolution_m,
  CASE instrument WHEN 'VIIRS' THEN 6 ELSE 12 END AS temporal_resolution_hours,
  CASE instrument WHEN 'MODIS' THEN 'Moderate Resolution Imaging Spectroradiometer'
    WHEN 'VIIRS' THEN 'Visible Infrared Imaging Radiometer Suite' ELSE 'Unknown instrument' END AS description
FROM det GROUP BY satellite, instrument"""
)
def dim_satellite(spark, sf):
    return dims.dim_satellite(detections(spark, sf))


@query(
    """SELECT DISTINCT CASE WHEN instrument = 'MODIS' AND length(confidence) = 1 THEN concat('C', confidence)
    ELSE sha256(concat(confidence, chr(31), instrument)) END AS id,
  confidence AS confidence_raw, instrument AS source_instrument,
  CASE instrument WHEN 'MODIS' THEN CASE WHEN try_cast(confidence AS integer) >= 80 THEN 'HIGH'
      WHEN try_cast(confidence AS integer) >= 30 THEN 'NOMINAL' ELSE 'LOW' END
    WHEN 'VIIRS' THEN CASE confidence WHEN 'h' THEN 'HIGH' WHEN 'n' THEN 'NOMINAL' ELSE 'LOW' END
    ELSE 'UNKNOWN' END AS confidence_class,
  CASE instrument WHEN 'MODIS' THEN try_cast(confidence AS integer)
    WHEN 'VIIRS' THEN CASE confidence WHEN 'h' THEN 85 WHEN 'n' THEN 50 ELSE 15 END ELSE 0 END AS confidence_numeric,
  CASE instrument WHEN 'MODIS' THEN round(try_cast(confidence AS double) / 100, 4)
    WHEN 'VIIRS' THEN CASE confidence WHEN 'h' THEN 0.85::double WHEN 'n' THEN 0.5::double ELSE 0.15::double END
    ELSE 0::double END AS confidence_score,
  CASE instrument WHEN 'MODIS' THEN 'MODIS confidence percentage (0-100)'
    WHEN 'VIIRS' THEN 'VIIRS confidence category (low/nominal/high)' ELSE 'Unknown confidence format' END AS description
FROM det"""
)
def dim_confidence(spark, sf):
    rows = detections(spark, sf)
    stored = (
        rows.filter("instrument = 'MODIS' AND length(confidence) = 1")
        .select(
            F.concat(F.lit("C"), "confidence").alias("id"),
            F.col("confidence").alias("confidence_raw"),
            F.col("instrument").alias("source_instrument"),
        )
        .distinct()
    )
    return dims.dim_confidence(rows, stored)


@query("SELECT sha256(conditions) AS id, conditions, min(icon) AS icon FROM wflat GROUP BY conditions")
def dim_weather_condition(spark, sf):
    return dims.dim_weather_condition(weather(spark, sf))


@query(
    """SELECT sha256(concat(latitude, chr(31), longitude)) AS id, latitude, longitude, province_code, province_name,
  city_code, city_name, CASE WHEN id = 'LOC7' THEN '' ELSE district_code END AS district_code, district_name,
  subdistrict_code, subdistrict_name FROM acc
WHERE (latitude, longitude) NOT IN (SELECT (latitude, longitude) FROM loc WHERE c_custkey % 10 = 0)
QUALIFY row_number() OVER (PARTITION BY latitude, longitude ORDER BY subdistrict_code) = 1"""
)
def dim_location(spark, sf):
    stored = locations(spark, sf).filter(F.substring("id", -1, 1) == "0")
    return dims.dim_location(parse_locations(place_responses(spark, sf)), stored)


# ---------------------------------------------------------------- facts


@query(
    """SELECT id, satellite_id, confidence_id, period_id, location_id, acquired_at, frp,
  cast(CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 700 END AS double) AS brightness,
  0::double AS bright_t31, 0::double AS bright_ti4, cast(event_id % 300 AS double) AS bright_ti5, latitude, longitude,
  cast(CASE WHEN event_id % 4 = 0 THEN 0.5 ELSE 0 END AS double) AS scan, 0::double AS track, acq_date AS date_value
FROM placed"""
)
def fact_detection(spark, sf):
    """All columns; measures that are null or absent are stored as 0."""
    rows = staged(spark, sf).withColumns(
        {
            "brightness": F.expr("CASE WHEN event_id % 5 <> 0 THEN cast(event_id % 700 AS float) END"),
            "bright_t31": F.lit(None).cast("float"),
            "bright_ti5": F.expr("cast(event_id % 300 AS float)"),
            "scan": F.expr("CASE WHEN event_id % 4 = 0 THEN 0.5 END"),
        }
    )
    built = facts.fact_detection(rows, accepted(spark, sf))[0]
    floats = {f.name for f in built.schema if f.dataType.simpleString() == "float"}
    return built.select(*[F.col(c).cast("double") if c in floats else F.col(c) for c in built.columns])


WEATHER_FACT_SQL = """SELECT sha256(concat(latitude, ':', longitude, ':', datetime)) AS id,
  sha256(cast(acq_date AS varchar)) AS period_id, location_id, sha256(conditions) AS weather_condition_id,
  cast(datetime AS timestamp) AS acquired_at, cast(temperature AS bigint) AS temperature,
  cast(coalesce(k % 90, 0) AS double) AS humidity, wind_speed, 0::double AS wind_degree, 0::bigint AS visibility,
  CASE WHEN k % 3 = 0 THEN 0 ELSE k % 100 END::bigint AS cloud_coverage, latitude, longitude,
  CASE WHEN k % 5 = 0 THEN 0 ELSE cast(pressure AS bigint) END AS pressure, 0::bigint AS uv_index,
  0::double AS precipitation, 0::double AS solar_radiation, acq_date AS date_value
FROM wstaged JOIN mapping USING (latitude, longitude)"""


@query(WEATHER_FACT_SQL)
def fact_weather(spark, sf):
    """All columns; measures that are absent or out of the stored range are stored as 0."""
    rows = dedup.latest_by_key(weather(spark, sf), WEATHER_KEYS, [F.col("event_id")]).withColumns(
        {
            "humidity": F.expr("cast(k % 90 AS double)"),
            "cloud_coverage": F.expr("CASE WHEN k % 3 <> 0 THEN cast(k % 100 AS double) END"),
            "pressure": F.expr("CASE WHEN k % 5 = 0 THEN 70000D ELSE pressure END"),
            "visibility": F.lit(-1.0),
        }
    )
    built = facts.fact_weather(shaping.narrow_weather_types(rows), accepted(spark, sf))[0]
    kinds = {"float": "double", "smallint": "bigint", "int": "bigint"}
    return built.select(
        *[F.col(f.name).cast(kinds.get(f.dataType.simpleString(), f.dataType.simpleString())) for f in built.schema]
    )


@query(
    """SELECT event_id, concat(satellite, '_', instrument) AS satellite_id,
  CASE WHEN instrument = 'VIIRS' THEN concat('V', confidence) ELSE sha256(concat(confidence, chr(31), instrument)) END AS confidence_id,
  CASE WHEN day(acq_date) = 3 THEN 'DAY-3' ELSE sha256(cast(acq_date AS varchar)) END AS period_id FROM det"""
)
def attach_dim_keys(spark, sf):
    """Stored ids where the dimension has them, hashed ids elsewhere."""
    rows = detections(spark, sf)
    stored = {
        "dim_confidence": rows.filter("instrument = 'VIIRS'")
        .select(
            F.concat(F.lit("V"), "confidence").alias("id"),
            F.col("confidence").alias("confidence_raw"),
            F.col("instrument").alias("source_instrument"),
        )
        .distinct(),
        "dim_period": rows.filter(F.dayofmonth("acq_date") == 3)
        .select(F.lit("DAY-3").alias("id"), F.col("acq_date").alias("date_value"))
        .distinct(),
    }
    return facts.attach_dim_keys(rows, stored).select(
        "event_id", "satellite_id", "confidence_id", "period_id"
    )


@query("SELECT id, acquired_at FROM placed WHERE acq_date = date '2024-01-20'")
def facts_for_date(spark, sf):
    hot = staged(spark, sf)
    rows = facts.fact_detection(hot, accepted(spark, sf))[0]
    periods = dims.dim_period(hot.select("acq_date"))
    return lookups.facts_for_date(rows, periods, "2024-01-20").select("id", "acquired_at")


@query(
    """SELECT h.id, acq_date AS tanggal, acquired_at AS detected_at, satellite AS satelit,
  CASE instrument WHEN 'MODIS' THEN CASE WHEN try_cast(confidence AS integer) >= 80 THEN 'high'
      WHEN try_cast(confidence AS integer) >= 30 THEN 'medium' ELSE 'low' END
    WHEN 'VIIRS' THEN CASE confidence WHEN 'h' THEN 'high' WHEN 'n' THEN 'medium' ELSE 'low' END
    ELSE 'unknown' END AS confidence,
  pulau, province_name AS provinsi, city_name AS kota, district_name AS kecamatan, subdistrict_name AS desa,
  cast(weekofyear(acq_date) AS integer) AS week_value, cast(1 AS bigint) AS detections,
  cast(h.latitude AS double) AS lat, cast(h.longitude AS double) AS lon
FROM placed h JOIN loc ON loc.id = location_id"""
)
def star_join(spark, sf):
    hot, places = staged(spark, sf), accepted(spark, sf)
    raw, root = detections(spark, sf), scratch_path(spark, "star")
    # Dimensions are stored tables, whose true size decides how they are joined.
    batch = {
        "dim_period": dims.dim_period(raw.select("acq_date")),
        "dim_satellite": dims.dim_satellite(raw),
        "dim_confidence": dims.dim_confidence(raw),
    }
    tables.insert_new_dims(spark, batch, root)
    stored = {n: spark.read.schema(df.schema).parquet(f"{root}/{n}") for n, df in batch.items()}
    stored |= {"dim_location": places, "fact_detection": facts.fact_detection(hot, places)[0]}
    islands = locations(spark, sf).select("province_name", "pulau").distinct()
    return join_star(stored, islands)


@query(
    """SELECT CASE WHEN event_id % 3 = 0 THEN 'unknown' ELSE confidence_class END AS label, count(*) AS total FROM (
  SELECT event_id, CASE instrument WHEN 'MODIS' THEN CASE WHEN try_cast(confidence AS integer) >= 80 THEN 'high'
      WHEN try_cast(confidence AS integer) >= 30 THEN 'medium' ELSE 'low' END
    WHEN 'VIIRS' THEN CASE confidence WHEN 'h' THEN 'high' WHEN 'n' THEN 'medium' ELSE 'low' END
    ELSE 'unknown' END AS confidence_class FROM placed) GROUP BY 1"""
)
def ask_confidence_mixed_nulls(spark, sf):
    """Null, empty and filled confidences: every detection counts once."""
    rows = staged(spark, sf).withColumns(
        {
            "confidence": F.expr("CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 6 = 3 THEN '' ELSE confidence END"),
            "instrument": F.expr("CASE WHEN event_id % 3 = 0 THEN 'OTHER' ELSE instrument END"),
        }
    )
    places, root = accepted(spark, sf), scratch_path(spark, "star")
    batch = {"dim_satellite": dims.dim_satellite(rows), "dim_confidence": dims.dim_confidence(rows),
             "dim_period": dims.dim_period(rows.select("acq_date"))}
    tables.insert_new_dims(spark, batch, root)
    stored = {n: spark.read.schema(df.schema).parquet(f"{root}/{n}") for n, df in batch.items()}
    stored |= {"dim_location": places, "fact_detection": facts.fact_detection(rows, places)[0]}
    # A province listed twice must not double its places.
    islands = locations(spark, sf).select("province_name", "pulau").distinct()
    star = warehouse_star(stored, islands.union(islands.withColumn("pulau", F.lit("~"))))
    return questions.ask(star, "confidence")


BATCH_COUNTS_SQL = """
WITH h AS (SELECT * FROM staged WHERE batch_id = 'B2'), w AS (SELECT * FROM wstaged WHERE batch_id = 'B2')
SELECT 'dim_period' AS table_name, count(DISTINCT acq_date) AS row_count
  FROM (SELECT acq_date FROM h UNION ALL SELECT acq_date FROM w)
UNION ALL SELECT 'dim_satellite', count(DISTINCT (satellite, instrument)) FROM h
UNION ALL SELECT 'dim_confidence', count(DISTINCT (confidence, instrument)) FROM h
UNION ALL SELECT 'dim_weather_condition', count(DISTINCT conditions) FROM w
UNION ALL SELECT 'fact_detection', count(*) FROM placed WHERE batch_id = 'B2'
UNION ALL SELECT 'fact_weather', count(*) FROM w JOIN mapping USING (latitude, longitude)"""


@query(BATCH_COUNTS_SQL)
def transform_batch(spark, sf):
    hot, wet = stored_staging(spark, sf)
    built = facts.transform_batch(hot, wet, accepted(spark, sf), "B2")
    return quality.table_counts(built)


@query(
    """WITH h AS (SELECT * FROM staged WHERE batch_id = 'B2'), w AS (SELECT * FROM wstaged WHERE batch_id = 'B2')
SELECT DISTINCT 'dim_period' AS table_name, sha256(cast(acq_date AS varchar)) AS id
  FROM (SELECT acq_date FROM h UNION ALL SELECT acq_date FROM w)
UNION ALL SELECT DISTINCT 'dim_satellite', concat(satellite, '_', instrument) FROM h
UNION ALL SELECT DISTINCT 'dim_confidence', sha256(concat(confidence, chr(31), instrument)) FROM h
UNION ALL SELECT DISTINCT 'dim_weather_condition', sha256(conditions) FROM w
UNION ALL SELECT 'fact_detection', id FROM placed WHERE batch_id = 'B2'
UNION ALL SELECT 'fact_weather', sha256(concat(latitude, ':', longitude, ':', datetime)) FROM w JOIN mapping USING (latitude, longitude)"""
)
def transform_batch_rows(spark, sf):
    """The ids of every row of every table of a batch."""
    hot, wet = stored_staging(spark, sf)
    built = facts.transform_batch(hot, wet, accepted(spark, sf), "B2")
    return shaping.union_vertical(*[df.select(F.lit(name).alias("table_name"), "id") for name, df in built.items()])


# ---------------------------------------------------------------- quality


@query(
    """SELECT 'staging_detection' AS table_name, count(*) AS row_count FROM staged
UNION ALL SELECT 'staging_weather', count(*) FROM wstaged
UNION ALL SELECT 'dim_period', count(DISTINCT acq_date) FROM det
UNION ALL SELECT 'dim_location', count(*) FROM acc
UNION ALL SELECT 'dim_satellite', count(DISTINCT (satellite, instrument)) FROM staged
UNION ALL SELECT 'dim_confidence', count(DISTINCT (confidence, instrument)) FROM staged
UNION ALL SELECT 'dim_weather_condition', count(DISTINCT conditions) FROM wstaged
UNION ALL SELECT 'fact_detection', count(*) FROM placed
UNION ALL SELECT 'fact_weather', count(*) FROM wstaged JOIN mapping USING (latitude, longitude)"""
)
def table_counts(spark, sf):
    return quality.table_counts(warehouse_tables(spark, sf))


@query(
    """SELECT count(*) FILTER (WHERE n > 0) AS checks_passed, count(*) AS total_checks,
  round(count(*) FILTER (WHERE n > 0) * 100.0::double / count(*), 1) AS success_rate,
  CASE WHEN count(*) FILTER (WHERE n > 0) >= 8 THEN 'SUCCESS' WHEN count(*) FILTER (WHERE n > 0) >= 5 THEN 'PARTIAL'
    ELSE 'FAILED' END AS status
FROM (SELECT count(*) AS n FROM staged UNION ALL SELECT count(*) FROM wstaged
  UNION ALL SELECT count(*) FROM det UNION ALL SELECT count(*) FROM acc UNION ALL SELECT count(*) FROM staged
  UNION ALL SELECT count(*) FROM staged UNION ALL SELECT count(*) FROM wstaged WHERE conditions = 'none'
  UNION ALL SELECT count(*) FROM placed UNION ALL SELECT count(*) FROM placed WHERE frp < 0)"""
)
def quality_scorecard(spark, sf):
    """Two of the nine tables are empty."""
    built = warehouse_tables(spark, sf)
    built["dim_weather_condition"] = built["dim_weather_condition"].filter("conditions = 'none'")
    built["fact_weather"] = built["fact_weather"].filter("wind_speed < 0")
    return quality.quality_scorecard(built)


# ---------------------------------------------------------------- stored tables


FACT_COLUMNS = ("event_id", "latitude", "longitude", "acq_date", "confidence", "batch_id")


@query("SELECT event_id, latitude, longitude, acq_date, confidence, batch_id FROM det")
def append_table(spark, sf):
    """Two appends whose columns come in different order."""
    rows, path = detections(spark, sf), scratch_path(spark, "append")
    tables.append_table(rows.filter("event_id % 2 = 0"), path, FACT_COLUMNS)
    odd = rows.filter("event_id % 2 = 1")
    tables.append_table(odd.select(*reversed(odd.columns)), path, FACT_COLUMNS)
    return spark.read.parquet(path)


@query(
    """SELECT event_id, latitude, longitude, acq_date, confidence, batch_id,
  strftime(acq_date, '%Y%m') AS ym FROM det"""
)
def write_partitioned(spark, sf):
    path = scratch_path(spark, "months")
    rows = detections(spark, sf).select(*FACT_COLUMNS)
    tables.write_partitioned(rows, path, "acq_date", DETECTION_KEYS[:2])
    return spark.read.parquet(path).withColumn("ym", F.col("ym").cast("string"))


REPLACED_SQL = """SELECT event_id, latitude, longitude, acq_date, confidence, batch_id FROM det
WHERE CASE WHEN day(acq_date) IN (5, 6, 21) THEN batch_id = 'B3' ELSE batch_id <> 'B3' END"""


@query(REPLACED_SQL)
def replace_days(spark, sf):
    """A stored batch takes the place of its days; storing it again changes nothing."""
    path, rows = scratch_path(spark, "facts"), detections(spark, sf).select(*FACT_COLUMNS)
    tables.replace_days(rows.filter("batch_id <> 'B3'"), path, "acq_date", ["latitude", "longitude"])
    batch = rows.filter((F.col("batch_id") == "B3") & F.dayofmonth("acq_date").isin(5, 6, 21))
    for _ in range(2):
        tables.replace_days(batch, path, "acq_date", ["latitude", "longitude"])
    return spark.read.parquet(path)


@query(REPLACED_SQL)
def replace_days_frame(spark, sf):
    rows = detections(spark, sf).select(*FACT_COLUMNS)
    batch = rows.filter((F.col("batch_id") == "B3") & F.dayofmonth("acq_date").isin(5, 6, 21))
    return tables.replace_days_frame(rows.filter("batch_id <> 'B3'"), batch, "acq_date")


@query(
    """SELECT DISTINCT 'dim_period' AS table_name, sha256(cast(acq_date AS varchar)) AS id FROM det
UNION ALL SELECT DISTINCT 'dim_location', sha256(concat(latitude, chr(31), longitude)) FROM acc
UNION ALL SELECT DISTINCT 'dim_satellite', concat(satellite, '_', instrument) FROM det
UNION ALL SELECT DISTINCT 'dim_confidence', sha256(concat(confidence, chr(31), instrument)) FROM det
UNION ALL SELECT DISTINCT 'dim_weather_condition', sha256(conditions) FROM wflat"""
)
def insert_new_dims(spark, sf):
    """Two loads that overlap; no id is stored twice."""
    root = scratch_path(spark, "dims")
    hot, wet, places = detections(spark, sf), weather(spark, sf), locations(spark, sf)
    loads = (
        (hot.filter("batch_id = 'B0'"), wet.filter("batch_id = 'B1'"),
         places.filter("province_name < 'NATION_2'")),
        (hot, wet, places),
    )
    for detected, measured, answered in loads:
        batch = {
            "dim_period": dims.dim_period(detected.select("acq_date")),
            "dim_location": dims.dim_location(answered),
            "dim_satellite": dims.dim_satellite(detected),
            "dim_confidence": dims.dim_confidence(detected),
            "dim_weather_condition": dims.dim_weather_condition(measured),
        }
        tables.insert_new_dims(spark, batch, root)
    # Only what the loads brought is stored: areas come with the day counts.
    stored = tables.stored_tables(spark, root, *[name for name, _ in tables.DIMENSION_ORDER])
    return shaping.union_vertical(*[df.select(F.lit(name).alias("table_name"), "id") for name, df in stored.items()])


@query("SELECT event_id, confidence, strftime(acq_date, '%Y%m') AS ym, acq_date AS staged_day FROM staged")
def append_and_compact(spark, sf):
    """Three loads; a key that comes again keeps its newest row."""
    path, rows = scratch_path(spark, "staging"), detections(spark, sf)
    for part in ("event_id % 3 = 1", "event_id % 3 = 0", "event_id % 3 = 2"):
        tables.append_and_compact(
            spark, rows.filter(part), path, "acq_date", DETECTION_KEYS, ["event_id"]
        )
    stored = spark.read.parquet(path)
    return stored.select("event_id", "confidence", F.col("ym").cast("string"), "staged_day")


@query(
    """WITH firsts AS (SELECT * FROM det WHERE acq_date IN (date '2024-01-12', date '2024-01-13')
  QUALIFY row_number() OVER (PARTITION BY latitude, longitude, acq_date, acq_time, satellite, instrument
    ORDER BY event_id) = 1)
SELECT sha256(concat(latitude, ':', longitude, ':', cast(acq_date AS varchar), ':', acq_time, ':',
    satellite, ':', instrument, ':', version)) AS id, acq_date AS date_value,
  sha256(concat(latitude, chr(31), longitude)) AS location_id, satellite AS satellite_name,
  confidence AS confidence_raw, monthname(acq_date) AS month_name
FROM firsts SEMI JOIN acc USING (latitude, longitude)"""
)
def load_day(spark, sf):
    """Two days loaded one after the other; facts with their dimensions."""
    root = scratch_path(spark, "warehouse")
    _load_days(spark, sf, root, "2024-01-12", "2024-01-13")
    stored = tables.stored_tables(spark, root, *WAREHOUSE_TABLES)
    period = stored["dim_period"].selectExpr("id AS period_id", "month_name")
    satellite = stored["dim_satellite"].selectExpr("id AS satellite_id", "satellite_name")
    confidence = stored["dim_confidence"].selectExpr("id AS confidence_id", "confidence_raw")
    return (
        stored["fact_detection"]
        .join(period, "period_id")
        .join(satellite, "satellite_id")
        .join(confidence, "confidence_id")
        .select("id", "date_value", "location_id", "satellite_name", "confidence_raw", "month_name")
    )


@query(
    """WITH w AS (SELECT * FROM wflat SEMI JOIN acc USING (latitude, longitude)
  WHERE acq_date IN (date '2024-01-13', date '2024-01-14') QUALIFY row_number() OVER (
    PARTITION BY latitude, longitude, datetime ORDER BY event_id) = 1)
SELECT sha256(concat(latitude, ':', longitude, ':', datetime)) AS id, acq_date AS date_value,
  cast(datetime AS timestamp) AS acquired_at, sha256(conditions) AS weather_condition_id FROM w"""
)
def load_day_weather(spark, sf):
    """Weather on the day of the detections and on the next: all of it becomes facts."""
    root, measured = scratch_path(spark, "warehouse"), weather(spark, sf)
    two_days = measured.filter("acq_date IN (date '2024-01-13', date '2024-01-14')")
    daily.load_day(
        spark, root, by_source(spark, sf), place_responses(spark, sf), "2024-01-13", "LOAD-0",
        "2024-02-01 00:00:00", ["event_order"], two_days, ["event_id"],
    )
    return spark.read.parquet(f"{root}/fact_weather").select("id", "date_value", "acquired_at", "weather_condition_id")


@query(
    """WITH firsts AS (SELECT * FROM det WHERE acq_date BETWEEN date '2024-01-01' AND date '2024-01-31'
  QUALIFY row_number() OVER (PARTITION BY latitude, longitude, acq_date, acq_time, satellite, instrument
    ORDER BY event_id) = 1)
SELECT sha256(concat(latitude, ':', longitude, ':', cast(acq_date AS varchar), ':', acq_time, ':',
    satellite, ':', instrument, ':', version)) AS id, acq_date AS date_value, concat(satellite, '_', instrument) AS satellite_id,
  location_id, cast(CASE WHEN instrument = 'MODIS' THEN cast(frp + 300 AS float) ELSE 0 END AS double) AS brightness
FROM firsts JOIN mapping USING (latitude, longitude)"""
)
def load_backfill(spark, sf):
    """A month of landed detections loaded in one go."""
    root = scratch_path(spark, "warehouse")
    requests = spark.createDataFrame([(2024, 1, 1)], "year int, start_month int, end_month int")
    backfill.load_backfill(
        spark, root, requests, by_source(spark, sf), accepted(spark, sf), "BACK-1", "2024-02-01 00:00:00", ["event_order"]
    )
    rows = spark.read.parquet(f"{root}/fact_detection")
    return rows.select("id", "date_value", "satellite_id", "location_id", F.col("brightness").cast("double"))


def _load_days(spark, sf, root, *days):
    measured = weather(spark, sf)
    for number, day in enumerate(days):
        daily.load_day(
            spark, root, by_source(spark, sf), place_responses(spark, sf), day, f"LOAD-{number}",
            f"2024-02-01 00:0{number}:00", ["event_order"],
            measured.filter(F.col("acq_date") == F.lit(day).cast("date")), ["event_id"],
        )


@query(
    """WITH h AS (SELECT * FROM det SEMI JOIN acc USING (latitude, longitude)
  WHERE acq_date = date '2024-01-13' QUALIFY row_number() OVER (
    PARTITION BY latitude, longitude, acq_date, acq_time, satellite, instrument ORDER BY event_id) = 1),
w AS (SELECT * FROM wflat SEMI JOIN acc USING (latitude, longitude)
  WHERE acq_date = date '2024-01-13' QUALIFY row_number() OVER (
    PARTITION BY latitude, longitude, datetime ORDER BY event_id) = 1)
SELECT 'staging_detection' AS table_name, count(*) AS row_count FROM h
UNION ALL SELECT 'staging_weather', count(*) FROM w
UNION ALL SELECT 'dim_period', count(DISTINCT acq_date) FROM (SELECT acq_date FROM h UNION ALL SELECT acq_date FROM w)
UNION ALL SELECT 'dim_location', count(DISTINCT (latitude, longitude)) FROM acc
UNION ALL SELECT 'dim_satellite', count(DISTINCT (satellite, instrument)) FROM h
UNION ALL SELECT 'dim_confidence', count(DISTINCT (confidence, instrument)) FROM h
UNION ALL SELECT 'dim_weather_condition', count(DISTINCT conditions) FROM w
UNION ALL SELECT 'fact_detection', count(*) FROM h
UNION ALL SELECT 'fact_weather', count(*) FROM w"""
)
def load_day_table_counts(spark, sf):
    """Row counts of all nine stored tables after loading a day twice."""
    root = scratch_path(spark, "warehouse")
    _load_days(spark, sf, root, "2024-01-13", "2024-01-13")
    return quality.table_counts(tables.stored_tables(spark, root, *WAREHOUSE_TABLES))


FOLLOWED_SQL = """WITH wanted AS (SELECT * FROM det SEMI JOIN acc USING (latitude, longitude)
  WHERE acq_date BETWEEN date '2024-01-11' AND date '2024-01-13'),
loads AS (
  SELECT 0 AS load, * FROM wanted WHERE acq_date = date '2024-01-12'
  UNION ALL SELECT 1, * FROM wanted WHERE instrument = 'VIIRS'
  UNION ALL SELECT 2, * FROM wanted),
once AS (SELECT * FROM loads QUALIFY row_number() OVER (
    PARTITION BY load, latitude, longitude, acq_date, acq_time, satellite, instrument ORDER BY event_id) = 1),
kept AS (SELECT * FROM once QUALIFY row_number() OVER (
    PARTITION BY latitude, longitude, acq_date, acq_time, satellite, instrument, version ORDER BY load = 1 DESC, load) = 1)
"""


def _three_feeds_then_one(spark, sf) -> str:
    """A warehouse after a daily load of all feeds, a backfill of one of them, and an older backfill of all."""
    root, feeds = scratch_path(spark, "warehouse"), by_source(spark, sf)
    daily.load_day(
        spark, root, feeds, place_responses(spark, sf), "2024-01-12", "DAY-1", "2024-02-01 00:00:00", ["event_order"]
    )
    requests = spark.createDataFrame([(2024, 1, 1)], "year int, start_month int, end_month int")
    some = "acq_date BETWEEN date '2024-01-11' AND date '2024-01-13'"
    one = {name: df.filter(some).filter("instrument = 'VIIRS'") for name, df in feeds.items()}
    places = accepted(spark, sf)
    backfill.load_backfill(spark, root, requests, one, places, "BACK-1", "2024-02-02 00:00:00", ["event_order"])
    every = {name: df.filter(some) for name, df in feeds.items()}
    backfill.load_backfill(spark, root, requests, every, places, "BACK-2", "2024-01-31 00:00:00", ["event_order"])
    return root


@query(
    FOLLOWED_SQL
    + """SELECT sha256(concat(latitude, ':', longitude, ':', cast(acq_date AS varchar), ':', acq_time, ':',
    satellite, ':', instrument, ':', version)) AS id, acq_date AS date_value, concat(satellite, '_', instrument) AS satellite_id
FROM kept"""
)
def backfill_over_loaded_days(spark, sf):
    """A backfill of one feed over days loaded from three, and an older one of all: every staged row is a fact."""
    root = _three_feeds_then_one(spark, sf)
    return spark.read.parquet(f"{root}/fact_detection").select("id", "date_value", "satellite_id")


@query(
    FOLLOWED_SQL
    + """SELECT table_name, date_value, staged_rows, fact_rows, staged_rows <> fact_rows AS rebuilt FROM (
  SELECT 'fact_detection' AS table_name, acq_date AS date_value, count(*) AS staged_rows, count(*) AS fact_rows
  FROM kept GROUP BY acq_date)"""
)
def followed_days(spark, sf):
    """After all loads nothing is left to rebuild: another look finds every day's facts as staged."""
    root = _three_feeds_then_one(spark, sf)
    return follow.follow_staging(spark, root, follow.days_to_follow(spark, root), accepted(spark, sf), "CHECK")


@query(
    FOLLOWED_SQL
    + """, place AS (SELECT * FROM acc QUALIFY row_number() OVER (PARTITION BY latitude, longitude ORDER BY subdistrict_code) = 1),
island AS (SELECT province_name, min(pulau) AS island FROM loc GROUP BY province_name),
named AS (SELECT * FROM kept JOIN place USING (latitude, longitude) JOIN island USING (province_name)),
classed AS (SELECT *, CASE instrument WHEN 'MODIS' THEN CASE WHEN try_cast(confidence AS integer) >= 80 THEN 'high'
      WHEN try_cast(confidence AS integer) >= 30 THEN 'medium' ELSE 'low' END
    WHEN 'VIIRS' THEN CASE confidence WHEN 'h' THEN 'high' WHEN 'n' THEN 'medium' ELSE 'low' END
    ELSE 'unknown' END AS class FROM named)
SELECT 'pulau' AS question, island AS label, count(*) AS total FROM classed GROUP BY island
UNION ALL SELECT 'kota', city_name, count(*) FROM classed WHERE class = 'high' GROUP BY city_name
UNION ALL SELECT 'confidence', class, count(*) FROM classed GROUP BY class
UNION ALL SELECT 'satelit', satellite, count(*) FROM classed WHERE island = 'ASIA' GROUP BY satellite
UNION ALL SELECT DISTINCT 'hari', cast(acq_date AS varchar), 0 FROM classed
UNION ALL SELECT 'level 31', NULL, count(*) FROM classed"""
)
def kept_counts_after_replace(spark, sf):
    """Cube questions answered from the kept day counts after days have been replaced."""
    root = _three_feeds_then_one(spark, sf)
    stored = tables.stored_tables(spark, root, *WAREHOUSE_TABLES, AREAS, COUNTS)
    star = warehouse_star(stored, locations(spark, sf).select("province_name", "pulau").distinct())
    days = star.days().select(F.col("tanggal").cast("string").alias("label"), F.lit(0).cast("long").alias("total"))
    whole = cube.roll_up(star).filter("grouping_level = 31").select(F.lit(None).cast("string").alias("label"), "total")
    answers = {
        "pulau": cube.count_by_level(star, "pulau"),
        "kota": cube.count_by_level(star, "kota", {"confidence": "high", "tahun": "2024"}),
        "confidence": cube.count_by_confidence(star),
        "satelit": cube.count_by_satellite(star, {"pulau": "ASIA"}),
        "hari": days,
        "level 31": whole,
    }
    named = [df.select(F.lit(name).alias("question"), "label", "total") for name, df in answers.items()]
    return shaping.union_vertical(*named)


@query(
    """SELECT 'staging_detection' AS table_name, count(*) AS row_count FROM staged
UNION ALL SELECT 'staging_weather', count(*) FROM wstaged
UNION ALL SELECT 'dim_location', count(*) FROM acc
UNION ALL SELECT 'fact_detection', count(*) FROM placed
UNION ALL SELECT 'fact_weather', count(*) FROM wstaged JOIN mapping USING (latitude, longitude)"""
)
def counts_from_footers(spark, sf):
    """Row counts of stored tables, in month or day folders and in none, without reading a row."""
    root = scratch_path(spark, "warehouse")
    built = warehouse_tables(spark, sf, root)
    built["dim_location"].write.parquet(f"{root}/dim_location")
    for name in ("fact_detection", "fact_weather"):
        tables.replace_days(built[name], f"{root}/{name}", "date_value", ["id"])
    return quality.table_counts(tables.counted_tables(spark, root, *WAREHOUSE_TABLES))
