"""Queries of the staging operators over raw detections, places and weather."""

from __future__ import annotations

from pyspark.sql import functions as F

from thermalcube.checks.registry import query
from thermalcube.checks.views import detections, locations, weather_responses
from thermalcube.functions.text import weather_key as weather_key_of
from thermalcube.functions.time import weather_datetime
from thermalcube.operators import dedup, filters, lookups, shaping
from thermalcube.plans import backfill, quality, staging
from thermalcube.session import scratch_path
from thermalcube.sources import answer_cache
from thermalcube.sources.responses import flatten_weather

INSTRUMENTS = ("MODIS", "VIIRS", "OTHER")
AS_OF = "2024-01-31 00:00:00"


def by_source(spark, sf):
    """Detections split into three feeds with different columns; one feed lacks brightness."""
    rows = detections(spark, sf).withColumn(
        "event_order", F.lpad(F.col("event_id").cast("string"), 19, "0")
    )
    modis = rows.filter("instrument = 'MODIS'").withColumn("brightness", F.col("frp") + 300)
    viirs = rows.filter("instrument = 'VIIRS'").withColumn("bright_ti4", F.col("frp") + 200)
    return {"MODIS_NRT": modis, "VIIRS_SNPP_NRT": viirs, "OTHER_FEED": rows.filter("instrument = 'OTHER'")}


def accepted(spark, sf):
    return filters.valid_location(locations(spark, sf))


def weather(spark, sf):
    return flatten_weather(weather_responses(spark, sf))


# ---------------------------------------------------------------- shaping


@query(
    """SELECT event_id, CASE instrument WHEN 'MODIS' THEN 'MODIS_NRT' WHEN 'VIIRS' THEN 'VIIRS_SNPP_NRT'
  ELSE 'OTHER_FEED' END AS source_api FROM det"""
)
def tag_source(spark, sf):
    frames = [shaping.tag_source(df, name) for name, df in by_source(spark, sf).items()]
    return shaping.union_diagonal(*frames).select("event_id", "source_api")


@query(
    "SELECT event_id, 'LOAD-1' AS batch_id, timestamp '2024-02-01 03:04:05.678' AS ingested_at FROM det"
)
def tag_batch(spark, sf):
    tagged = shaping.tag_batch(detections(spark, sf), "LOAD-1", "2024-02-01 03:04:05.678912")
    return tagged.select("event_id", "batch_id", "ingested_at")


@query(
    """SELECT cast(event_id AS varchar) AS event_id, cast(frp AS varchar) AS frp,
  cast(acq_date AS varchar) AS acq_date, confidence FROM det"""
)
def all_to_string(spark, sf):
    return shaping.all_to_string(
        detections(spark, sf).select("event_id", "frp", "acq_date", "confidence")
    )


@query(
    """SELECT event_id, instrument, CASE WHEN instrument = 'MODIS' THEN frp + 300 END AS brightness,
  CASE WHEN instrument = 'VIIRS' THEN frp + 200 END AS bright_ti4 FROM det"""
)
def union_diagonal(spark, sf):
    rows = shaping.union_diagonal(*by_source(spark, sf).values())
    return rows.select("event_id", "instrument", "brightness", "bright_ti4")


@query("SELECT event_id, batch_id, confidence FROM det")
def union_vertical(spark, sf):
    rows = detections(spark, sf).select("event_id", "batch_id", "confidence")
    odd, even = rows.filter("event_id % 2 = 1"), rows.filter("event_id % 2 = 0")
    return shaping.union_vertical(even, odd.select("confidence", "event_id", "batch_id"))


@query(
    """SELECT batch_id, ingested_at, latitude, longitude, acq_date, acq_time, satellite, instrument, confidence,
  version, cast(cast(frp AS float) AS double) AS frp,
  CASE WHEN instrument = 'MODIS' THEN cast(cast(frp + 300 AS float) AS double) END AS brightness,
  CASE WHEN instrument = 'VIIRS' THEN cast(cast(frp + 200 AS float) AS double) END AS bright_ti4,
  cast(NULL AS double) AS scan FROM det"""
)
def align_detections(spark, sf):
    rows = shaping.align_detections(shaping.union_diagonal(*by_source(spark, sf).values()))
    floats = [F.col(c).cast("double") for c in ("frp", "brightness", "bright_ti4", "scan")]
    return rows.select(
        "batch_id", "ingested_at", "latitude", "longitude", "acq_date", "acq_time", "satellite",
        "instrument", "confidence", "version", *floats,
    )


@query(
    """SELECT batch_id, ingested_at, latitude, longitude, datetime, temperature, 0::double AS humidity,
  wind_speed, pressure, conditions, icon FROM wflat"""
)
def align_weather(spark, sf):
    rows = shaping.align_weather(weather(spark, sf))
    return rows.select(
        "batch_id", "ingested_at", "latitude", "longitude", "datetime", "temperature", "humidity",
        "wind_speed", "pressure", "conditions", "icon",
    )


@query(
    """SELECT event_id,
  CASE WHEN (k - 50) * 1000 BETWEEN -32768 AND 32767 THEN (k - 50) * 1000 END AS temperature,
  CASE WHEN k * 1000 <= 65535 THEN k * 1000 END AS pressure,
  CASE WHEN k * 5 <= 255 THEN k * 5 END AS cloud_coverage,
  CASE WHEN event_id % 7 <> 0 AND k % 2 = 0 THEN k END AS uv_index,
  cast(cast(cast(k AS double) / 8 AS float) AS double) AS humidity FROM wx"""
)
def narrow_weather_types(spark, sf):
    """Numbers and texts, inside and outside the stored ranges."""
    k = F.col("k")
    raw = weather_responses(spark, sf).select(
        "event_id",
        ((k - 50) * 1000.75).alias("fraction"),
        ((k - 50) * 1000).cast("string").alias("temperature"),
        (k * 1000 + 0.5).alias("pressure"),
        (k * 5).alias("cloud_coverage"),
        F.when(F.col("event_id") % 7 == 0, F.lit("n/a"))
        .when(k % 2 == 0, k.cast("string"))
        .otherwise(F.lit("-1"))
        .alias("uv_index"),
        (k / 8).alias("humidity"),
    )
    out = shaping.narrow_weather_types(raw.drop("fraction"))
    whole = [F.col(c).cast("int") for c in ("temperature", "pressure", "cloud_coverage", "uv_index")]
    return out.select("event_id", *whole, F.col("humidity").cast("double"))


@query(
    """SELECT event_id, cast(cast(frp AS float) AS double) AS frp,
  CASE WHEN event_id % 3 <> 0 THEN cast(cast(loc_key AS float) AS double) END AS scan FROM det"""
)
def measure_casts(spark, sf):
    scan = F.when(F.col("event_id") % 3 == 0, F.lit("?")).otherwise(F.col("loc_key").cast("string"))
    rows = shaping.measure_casts(detections(spark, sf).withColumn("scan", scan))
    return rows.select("event_id", F.col("frp").cast("double"), F.col("scan").cast("double"))


@query("SELECT event_id, concat(latitude, ':', longitude, ':', datetime) AS weather_key FROM wflat")
def weather_key(spark, sf):
    at = weather_datetime(F.col("acq_date"), F.col("acq_time"))
    return detections(spark, sf).select(
        "event_id", weather_key_of(F.col("latitude"), F.col("longitude"), at).alias("weather_key")
    )


@query(
    """SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN frp ELSE 0 END AS frp,
  CASE WHEN event_id % 9 <> 0 THEN satellite ELSE '' END AS satellite FROM det"""
)
def apply_defaults(spark, sf):
    event = F.col("event_id")
    rows = detections(spark, sf).select(
        "event_id",
        F.when(event % 4 != 0, F.col("frp")).alias("frp"),
        F.when(event % 9 != 0, F.col("satellite")).alias("satellite"),
    )
    return shaping.apply_defaults(rows)


# ---------------------------------------------------------------- filters


@query("SELECT event_id, acq_date FROM det WHERE acq_date = date '2024-01-10'")
def for_date(spark, sf):
    return filters.for_date(detections(spark, sf).select("event_id", "acq_date"), "2024-01-10")


@query("SELECT event_id, batch_id FROM det WHERE batch_id = 'B1'")
def for_batch(spark, sf):
    return filters.for_batch(detections(spark, sf).select("event_id", "batch_id"), "B1")


@query(
    """SELECT event_id, batch_id FROM det
WHERE batch_id = (SELECT batch_id FROM det ORDER BY ingested_at DESC, batch_id DESC LIMIT 1)"""
)
def latest_batch(spark, sf):
    return filters.latest_batch(detections(spark, sf)).select("event_id", "batch_id")


# ---------------------------------------------------------------- deduplication


@query(
    """SELECT event_id, batch_id FROM det QUALIFY row_number() OVER (
  PARTITION BY latitude, longitude, acq_date, acq_time, satellite, instrument ORDER BY batch_id, event_id) = 1"""
)
def dedup_detections(spark, sf):
    rows = dedup.dedup_detections(detections(spark, sf), [F.col("batch_id"), F.col("event_id")])
    return rows.select("event_id", "batch_id")


@query(
    """SELECT event_id, datetime FROM wflat QUALIFY row_number() OVER (
  PARTITION BY latitude, longitude, datetime ORDER BY event_id) = 1"""
)
def dedup_weather(spark, sf):
    return dedup.dedup_weather(weather(spark, sf), [F.col("event_id")]).select("event_id", "datetime")


@query("SELECT event_id, ingested_at FROM staged")
def latest_by_key(spark, sf):
    rows = dedup.latest_by_key(detections(spark, sf), tie_break=[F.col("event_id")])
    return rows.select("event_id", "ingested_at")


@query("SELECT DISTINCT latitude, longitude, acq_date, acq_time FROM det")
def distinct_coordinates(spark, sf):
    return dedup.distinct_coordinates(detections(spark, sf), "acq_date", "acq_time")


# ---------------------------------------------------------------- lookups


@query("SELECT event_id, latitude, longitude FROM det SEMI JOIN acc USING (latitude, longitude)")
def keep_located(spark, sf):
    return lookups.keep_located(detections(spark, sf), accepted(spark, sf)).select(
        "event_id", "latitude", "longitude"
    )


@query(
    """SELECT count(*) AS original, count(*) FILTER (WHERE location_id IS NOT NULL) AS kept,
  count(*) FILTER (WHERE location_id IS NULL) AS rejected
FROM det LEFT JOIN mapping USING (latitude, longitude)"""
)
def reject_metrics(spark, sf):
    return lookups.reject_metrics(detections(spark, sf), accepted(spark, sf))


@query("SELECT event_id, coalesce(location_id, '') AS location_id FROM det LEFT JOIN mapping USING (latitude, longitude)")
def attach_location(spark, sf):
    mapping = lookups.location_mapping(accepted(spark, sf))
    return lookups.attach_location(detections(spark, sf), mapping).select("event_id", "location_id")


@query(
    "SELECT latitude, longitude, location_id FROM mapping WHERE (latitude, longitude) IN (SELECT (latitude, longitude) FROM det)"
)
def location_mapping(spark, sf):
    return lookups.location_mapping(accepted(spark, sf), detections(spark, sf))


@query("SELECT event_id, location_id FROM det JOIN mapping USING (latitude, longitude)")
def require_fk(spark, sf):
    mapping = lookups.location_mapping(accepted(spark, sf))
    rows = lookups.attach_location(detections(spark, sf), mapping)
    return filters.require_fk(rows, "location_id", "rejects")[0].select("event_id", "location_id")


@query(
    """SELECT DISTINCT latitude, longitude, acq_date FROM det a WHERE NOT EXISTS (
  SELECT 1 FROM det b WHERE b.batch_id = 'B0' AND b.latitude = a.latitude AND b.longitude = a.longitude
    AND b.acq_date = a.acq_date)"""
)
def new_rows(spark, sf):
    rows = detections(spark, sf).select("batch_id", "latitude", "longitude", "acq_date")
    keys = ["latitude", "longitude", "acq_date"]
    return lookups.new_rows(rows.select(*keys).distinct(), rows.filter("batch_id = 'B0'"), keys)


@query("SELECT event_id, satellite FROM det WHERE event_id % 6 <> 0 AND event_id % 4 <> 1")
def new_rows_by_id(spark, sf):
    """Rows without an id and rows of a stored batch are left out."""
    rows = detections(spark, sf).select(
        F.when(F.col("event_id") % 6 != 0, F.col("event_id")).alias("event_id"), "satellite", "batch_id"
    )
    stored = detections(spark, sf).filter("batch_id = 'B1'")
    return lookups.new_rows_by_id(rows, stored, "event_id").drop("batch_id")


@query(
    """SELECT DISTINCT confidence, instrument, CASE WHEN instrument = 'VIIRS' THEN concat('OLD-', confidence)
  ELSE sha256(concat(confidence, chr(31), instrument)) END AS id FROM det"""
)
def assign_key(spark, sf):
    pairs = detections(spark, sf).select("confidence", "instrument").distinct()
    stored = pairs.filter("instrument = 'VIIRS'").withColumn("id", F.concat(F.lit("OLD-"), "confidence"))
    return lookups.assign_key(pairs, stored, ["confidence", "instrument"])


@query("SELECT acq_date AS date_value, min(concat('P', cast(event_id AS varchar))) AS id FROM det GROUP BY 1")
def first_period_id(spark, sf):
    periods = detections(spark, sf).select(
        F.col("acq_date").alias("date_value"),
        F.concat(F.lit("P"), F.col("event_id").cast("string")).alias("id"),
    )
    return lookups.first_period_id(periods)


@query(
    """SELECT loc_key, acq_date, max(cached_at) AS cached_at,
  coalesce(max(cached_at) + INTERVAL 24 HOUR > timestamp '2024-01-31 00:00:00', false) AS is_hit
FROM (SELECT DISTINCT loc_key, acq_date FROM det) keys
LEFT JOIN (SELECT loc_key, acq_date, ingested_at AS cached_at FROM det WHERE batch_id <> 'B3') cache
USING (loc_key, acq_date) GROUP BY loc_key, acq_date"""
)
def cache_split(spark, sf):
    rows = detections(spark, sf)
    # What earlier batches asked for is cached.
    cache = rows.filter("batch_id <> 'B3'").withColumnRenamed("ingested_at", "cached_at")
    keys = ["loc_key", "acq_date"]
    return lookups.cache_split(
        rows.select(*keys).distinct(), cache, keys, lookups.weather_ttl(24), AS_OF
    )


@query(
    """WITH asked AS (SELECT *, concat(cast(acq_date AS varchar), ' ', lpad(acq_time, 4, '0')[1:2], ':', lpad(acq_time, 4, '0')[3:4], ':00')
    AS datetime FROM det),
places AS (SELECT latitude, longitude FROM det WHERE batch_id = 'B0' GROUP BY 1, 2
  HAVING max(ingested_at) + INTERVAL 24 HOUR > timestamp '2024-01-31 00:00:00'),
moments AS (SELECT latitude, longitude, datetime FROM wflat WHERE batch_id = 'B1' GROUP BY 1, 2, 3
  HAVING max(ingested_at) + INTERVAL 72 HOUR > timestamp '2024-01-31 00:00:00')
SELECT DISTINCT 'place' AS kind, latitude, longitude, cast(NULL AS varchar) AS datetime FROM asked
ANTI JOIN places USING (latitude, longitude) ANTI JOIN acc USING (latitude, longitude)
UNION ALL SELECT DISTINCT 'weather', latitude, longitude, datetime FROM asked
ANTI JOIN moments USING (latitude, longitude, datetime)
ANTI JOIN (SELECT * FROM wflat WHERE batch_id = 'B2') stored USING (latitude, longitude, datetime)"""
)
def lookups_to_fetch(spark, sf):
    """Of all detections: what neither a cache, its batch and age given, nor the stored tables hold."""
    rows, measured = detections(spark, sf), weather(spark, sf)
    places = rows.filter("batch_id = 'B0'").withColumnRenamed("ingested_at", "cached_at")
    moments = measured.filter("batch_id = 'B1'").withColumnRenamed("ingested_at", "cached_at")
    return lookups.lookups_to_fetch(
        rows, places, accepted(spark, sf), moments, measured.filter("batch_id = 'B2'"), AS_OF,
        lookups.location_ttl(1), lookups.weather_ttl(72),
    )


@query(
    """WITH cache AS (SELECT loc_key, acq_date, ingested_at AS cached_at, max(event_id) AS answer FROM det
  WHERE batch_id <> 'B3' GROUP BY 1, 2, 3),
alive AS (SELECT * FROM cache WHERE cached_at + INTERVAL 24 HOUR > timestamp '2024-01-31 00:00:00'
  QUALIFY row_number() OVER (PARTITION BY loc_key, acq_date ORDER BY cached_at DESC) = 1)
SELECT loc_key, acq_date, answer, cached_at, cached_at IS NOT NULL AS is_hit
FROM (SELECT DISTINCT loc_key, acq_date FROM det) keys LEFT JOIN alive USING (loc_key, acq_date)"""
)
def ask_cache(spark, sf):
    """Answers of three batches stored, one of them twice, expired, and asked for all keys."""
    rows, on, path = detections(spark, sf), ["loc_key", "acq_date"], scratch_path(spark, "answers")
    answers = rows.groupBy("batch_id", *on, F.col("ingested_at").alias("cached_at")).agg(F.max("event_id").alias("answer"))
    for batch in ("B0", "B1", "B2", "B0"):
        answer_cache.store_answers(answers.filter(F.col("batch_id") == batch).drop("batch_id"), path, on)
    answer_cache.expire(spark, path, lookups.weather_ttl(24), AS_OF)
    ddl = ", ".join(f"{n} {t}" for n, t in answers.drop("batch_id").dtypes)
    return answer_cache.ask_cache(rows.select(*on).distinct(), path, ddl, on, lookups.weather_ttl(24), AS_OF)


# ---------------------------------------------------------------- composites


EXTRACT_SQL = """SELECT * FROM det WHERE acq_date = date '2024-01-12'
QUALIFY row_number() OVER (PARTITION BY latitude, longitude, acq_date, acq_time, satellite, instrument
  ORDER BY event_id) = 1"""


@query(
    f"""SELECT 'LOAD-7' AS batch_id, timestamp '2024-02-01 00:00:00' AS ingested_at, latitude, longitude,
  acq_date, acq_time, satellite, instrument, confidence, version, cast(cast(frp AS float) AS double) AS frp,
  CASE WHEN instrument = 'MODIS' THEN cast(cast(frp + 300 AS float) AS double) END AS brightness
FROM ({EXTRACT_SQL}) SEMI JOIN acc USING (latitude, longitude)"""
)
def extract_day(spark, sf):
    staged = staging.extract_day(
        by_source(spark, sf), accepted(spark, sf), "2024-01-12", "LOAD-7", "2024-02-01 00:00:00",
        tie_break=["event_order"],
    )["staging_detection"]
    floats = [F.col(c).cast("double") for c in ("frp", "brightness")]
    return staged.select(
        "batch_id", "ingested_at", "latitude", "longitude", "acq_date", "acq_time", "satellite",
        "instrument", "confidence", "version", *floats,
    )


@query(
    """SELECT 'LOAD-8' AS batch_id, latitude, longitude, datetime, cast(temperature AS integer) AS temperature,
  cast(pressure AS integer) AS pressure, conditions, icon FROM (
  SELECT * FROM wflat QUALIFY row_number() OVER (PARTITION BY latitude, longitude, datetime ORDER BY event_id) = 1)
SEMI JOIN acc USING (latitude, longitude)"""
)
def stage_weather(spark, sf):
    located = lookups.keep_located(weather(spark, sf), accepted(spark, sf))
    rows = staging.stage_weather(located, "LOAD-8", "2024-02-01 00:00:00", ["event_id"])
    return rows.select(
        "batch_id", "latitude", "longitude", "datetime", F.col("temperature").cast("int"),
        "pressure", "conditions", "icon",
    )


@query(
    """SELECT event_id, cast(acq_date AS timestamp) + to_hours(cast(lpad(acq_time, 4, '0')[1:2] AS integer))
  + to_minutes(cast(lpad(acq_time, 4, '0')[3:4] AS integer)) AS acq_datetime, 'IDN' AS country_code,
  timestamp '2024-02-01 00:00:00' AS backfill_timestamp, cast(year(acq_date) AS integer) AS backfill_year, cast(month(acq_date) AS integer) AS backfill_month FROM det"""
)
def backfill_prepare(spark, sf):
    rows = backfill.backfill_prepare(detections(spark, sf), "2024-02-01 00:00:00")
    return rows.select(
        "event_id", "acq_datetime", "country_code", "backfill_timestamp", "backfill_year", "backfill_month"
    )


@query(
    """SELECT 'B2' AS batch_id, count(*) FILTER (WHERE kind = 'd') AS staging_detection_count,
  count(*) FILTER (WHERE kind = 'w') AS staging_weather_count, count(*) AS total_staging_records
FROM (SELECT 'd' AS kind, batch_id FROM det UNION ALL SELECT 'w', batch_id FROM wstaged) WHERE batch_id = 'B2'"""
)
def batch_status(spark, sf):
    tables = {
        "staging_detection": detections(spark, sf),
        "staging_weather": dedup.latest_by_key(
            weather(spark, sf), ("latitude", "longitude", "datetime"), [F.col("event_id")]
        ),
    }
    return quality.batch_status(tables, "B2")
