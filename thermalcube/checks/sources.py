"""Queries of readers, writers and the stream; files are first derived from the given tables."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from thermalcube.checks.registry import query
from thermalcube.checks.staging import accepted, by_source, weather
from thermalcube.checks.views import (
    TABLE_SCHEMAS,
    as_detections,
    detections,
    feature_star,
    features,
    place_responses,
    table,
)
from thermalcube.functions.time import week_of_month
from thermalcube.plans import backfill, questions, table_view
from thermalcube.schemas import BOUNDARY_NAME_FIELDS, PLACE_LEVELS
from thermalcube.session import scratch_path
from thermalcube.sources import detections as feeds, geojson, landing, tables
from thermalcube.sources.responses import accepted_locations, flatten_locations
from thermalcube.streaming.ingest import incremental_ingest, ingest_into_warehouse, staged_rows

# ---------------------------------------------------------------- detection files


def land_feeds(spark: SparkSession, sf_dir: str) -> str:
    """CSV folders as feeds land them: two good layouts, and files that must be refused."""
    root = scratch_path(spark, "landed")
    feeds_by_name = by_source(spark, sf_dir)
    common = ["latitude", "longitude", "acq_date", "acq_time", "satellite", "instrument"]
    modis = feeds_by_name["MODIS_NRT"].select(*common, "brightness", "confidence", "version", "frp")
    viirs = feeds_by_name["VIIRS_SNPP_NRT"].select(
        "frp", "version", "bright_ti4", "confidence", *reversed(common)
    )
    # Lacks a required column.
    other = feeds_by_name["OTHER_FEED"].select("latitude", "longitude", "acq_date", "frp")
    # An error text in the middle of a file spoils that file.
    broken = modis.filter("acq_time < 5").withColumn("version", F.lit("Internal Error"))
    for name, frame in {"modis": modis, "viirs": viirs, "other": other, "broken": broken}.items():
        frame.write.option("header", True).csv(f"{root}/{name}")
    modis.filter(F.lit(False)).coalesce(1).write.option("header", True).csv(f"{root}/empty")
    spark.range(1).select(F.lit("Invalid MAP_KEY.").alias("value")).write.text(f"{root}/refused")
    return root


@query(
    """SELECT latitude, longitude, acq_date, acq_time, satellite, instrument, confidence, version, frp,
  CASE WHEN instrument = 'MODIS' THEN frp + 300 END AS brightness,
  CASE WHEN instrument = 'VIIRS' THEN frp + 200 END AS bright_ti4
FROM det WHERE instrument IN ('MODIS', 'VIIRS')"""
)
def read_detections(spark, sf):
    rows = feeds.read_detections(spark, f"{land_feeds(spark, sf)}/*")
    return rows.select(
        "latitude", "longitude", F.col("acq_date").cast("date"), "acq_time", "satellite", "instrument",
        "confidence", "version", *[F.col(c).cast("double") for c in ("frp", "brightness", "bright_ti4")],
    )


@query(
    """SELECT 'other' AS feed, 'required column missing' AS reason UNION ALL SELECT 'broken', 'error mark' FROM det
WHERE instrument = 'MODIS' AND try_cast(acq_time AS integer) < 5 HAVING count(*) > 0
UNION ALL SELECT 'refused', 'error mark'"""
)
def refused_detections(spark, sf):
    """The feeds with refused files, and why."""
    refused = feeds.refused_detections(spark, f"{land_feeds(spark, sf)}/*")
    feed = F.element_at(F.split("source_file", "/"), -2).alias("feed")
    return refused.select(feed, "reason").distinct()


@query(
    """SELECT latitude, longitude, acq_date, acq_time, satellite, instrument, confidence, version, frp,
  CASE WHEN instrument = 'MODIS' THEN frp + 300 END AS brightness,
  CASE WHEN instrument = 'VIIRS' THEN frp + 200 END AS bright_ti4
FROM det WHERE instrument IN ('MODIS', 'VIIRS')"""
)
def take_landed(spark, sf):
    """One feed first, then all landed files, of which the first feed's are known, then nothing new."""
    landed, root = land_feeds(spark, sf), scratch_path(spark, "intakes")
    for path in (f"{landed}/modis", f"{landed}/*", f"{landed}/*"):
        landing.take_landed(spark, path, root)
    rows = landing.landed_detections(spark, root)
    return rows.select(
        "latitude", "longitude", F.col("acq_date").cast("date"), "acq_time", "satellite", "instrument",
        "confidence", "version", *[F.col(c).cast("double") for c in ("frp", "brightness", "bright_ti4")],
    )


STAGED_SQL = """SELECT event_id, batch_id, ingested_at, latitude, acq_date, acq_time,
  CASE WHEN event_id % 5 <> 0 THEN confidence END AS confidence, cast(cast(frp AS float) AS double) AS frp FROM det"""


def _spooled(spark, sf) -> str:
    path = scratch_path(spark, "spool")
    rows = detections(spark, sf).select(
        "event_id", "batch_id", "ingested_at", "latitude", "acq_date", "acq_time",
        F.when(F.col("event_id") % 5 != 0, F.col("confidence")).alias("confidence"), "frp",
    )
    tables.spool_csv(rows, path)
    return path


@query(STAGED_SQL)
def spool_csv(spark, sf):
    """Written with quotes and a null token, read back untyped."""
    rows = spark.read.option("header", True).option("nullValue", feeds.NULL_TOKEN).csv(_spooled(spark, sf))
    return rows.select(
        F.col("event_id").cast("bigint"), "batch_id", F.col("ingested_at").cast("timestamp"), "latitude",
        F.col("acq_date").cast("date"), "acq_time", "confidence", F.col("frp").cast("float").cast("double"),
    )


@query(f"SELECT * FROM ({STAGED_SQL}) WHERE batch_id = 'B3'")
def read_staging(spark, sf):
    ddl = (
        "event_id bigint, batch_id string, ingested_at timestamp, latitude string, acq_date date, "
        "acq_time string, confidence string, frp float"
    )
    rows = feeds.read_staging(spark, _spooled(spark, sf), ddl, "B3")
    return rows.withColumn("frp", F.col("frp").cast("double"))


# ---------------------------------------------------------------- responses


@query(
    """SELECT event_id, latitude, longitude, datetime, conditions, icon, temperature, wind_speed, pressure,
  0::double AS feels_like, 0::double AS humidity, 0::double AS precipitation, 0::double AS precip_prob,
  0::double AS wind_degree, 0::double AS wind_gust, 0::double AS visibility, 0::double AS cloud_coverage,
  0::double AS solar_radiation, 0::double AS solar_energy, 0::double AS uv_index, 0::double AS severe_risk
FROM wflat"""
)
def flatten_weather(spark, sf):
    return weather(spark, sf).drop("acq_date", "acq_time", "batch_id", "ingested_at", "k", "response")


PLACE_SQL = """SELECT id, latitude, longitude, province_code, city_code,
  CASE WHEN id = 'LOC7' THEN '' ELSE district_code END AS district_code, subdistrict_code, province_name, city_name,
  coalesce(district_name, '') AS district_name, subdistrict_name FROM """


@query(PLACE_SQL + "loc")
def flatten_place_responses(spark, sf):
    return flatten_locations(place_responses(spark, sf), "response", "id")


@query(PLACE_SQL + "acc")
def accepted_place_responses(spark, sf):
    return accepted_locations(place_responses(spark, sf), "response", "id")


# ---------------------------------------------------------------- GeoJSON and points


@query(
    """SELECT cast(id AS varchar) AS id, tanggal, detected_at, satelit, confidence, cast(cast(ceil(day(tanggal) / 7.0) AS integer) AS varchar) AS minggu,
  pulau, provinsi, kota, kecamatan, desa, detections, lat, lon FROM feat"""
)
def read_features(spark, sf):
    """FeatureCollections of at most a thousand features and single features per line."""
    rows = features(spark, sf).withColumn("minggu", week_of_month(F.col("tanggal")).cast("string"))
    nested = geojson.nest_features(rows)
    path = scratch_path(spark, "features")
    number = F.col("properties.id").cast("bigint")
    singles = number % 2 == 0
    nested.filter(singles).write.json(f"{path}/lines")
    bundles = nested.filter(~singles).groupBy(F.floor(number / 1000).alias("bundle"))
    bundles.agg(
        F.lit("FeatureCollection").alias("type"),
        F.collect_list(F.struct("type", "geometry", "properties")).alias("features"),
    ).drop("bundle").write.json(f"{path}/collections")
    return geojson.flatten_features(geojson.read_features(spark, f"{path}/*"))


@query(
    """SELECT cast(id AS varchar) AS id, tanggal, detected_at, satelit, confidence,
  cast(cast(ceil(day(tanggal) / 7.0) AS integer) AS varchar) AS minggu,
  pulau, provinsi, kota, kecamatan, desa, detections, lat, lon FROM feat"""
)
def feature_round_trip(spark, sf):
    """Detections written as features under property names of the caller's, and read back."""
    path = scratch_path(spark, "features")
    fields = {"detected_at": "seen", "detections": "count"}
    geojson.write_features(questions.detections(feature_star(spark, sf)), path, fields)
    return geojson.flatten_features(geojson.read_features(spark, path, fields=fields))


@query(
    """SELECT DISTINCT 'pulau' AS level, pulau AS name, cast(NULL AS varchar) AS parent_name, '{"type":"Point"}' AS geometry FROM pl
UNION SELECT 'provinsi', provinsi, pulau, '{"type":"Point"}' FROM pl UNION SELECT 'kota', kota, provinsi, '{"type":"Point"}' FROM pl
UNION SELECT 'kecamatan', kecamatan, kota, '{"type":"Point"}' FROM pl UNION SELECT 'desa', desa, kecamatan, '{"type":"Point"}' FROM pl"""
)
def read_boundaries(spark, sf):
    """Five level files, each naming its regions and their parents by other attributes."""
    places = feature_star(spark, sf).places
    paths = {}
    for position, level in enumerate(PLACE_LEVELS):
        shown = PLACE_LEVELS[: position + 1][-2:]
        names = [F.col(c).alias(BOUNDARY_NAME_FIELDS[c]) for c in shown]
        regions = places.select(*shown).distinct().select(
            F.lit("Feature").alias("type"),
            F.struct(F.lit("Point").alias("type")).alias("geometry"),
            F.struct(*names).alias("properties"),
        )
        paths[level] = scratch_path(spark, f"boundaries-{level}")
        regions.write.json(paths[level])
    return geojson.read_boundaries(spark, paths)


@F.pandas_udf(T.StringType())
def hex_geometry(kind: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
    """Binary geometries as hex: points in both byte orders and dialects, and unusable ones."""
    layouts = {
        0: lambda a, b: struct.pack("<BIdd", 1, 1, a, b),
        1: lambda a, b: struct.pack(">BIdd", 0, 1, a, b),
        2: lambda a, b: struct.pack("<BIIdd", 1, 0x20000001, 4326, a, b),
        3: lambda a, b: struct.pack("<BIddd", 1, 1001, a, b, 5.0),
        4: lambda a, b: struct.pack("<BIdd", 1, 1, a, b)[:-3],
        5: lambda a, b: struct.pack("<BIIdd", 1, 2, 1, a, b),
    }
    return pd.Series([layouts[k](a, b).hex() if k in layouts else "zz" for k, a, b in zip(kind, x, y)])


@query(
    """SELECT id, value_lat AS lat, value_lng AS lng FROM (
  SELECT c_custkey AS id, c_acctbal / 100 AS value_lat, -c_acctbal * 3 AS value_lng FROM customer)
WHERE id % 8 < 4"""
)
def decode_points(spark, sf):
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 100).alias("y"), (-F.col("c_acctbal") * 3).alias("x")
    )
    coded = rows.withColumn("geom", hex_geometry(F.col("id") % 8, "x", "y"))
    # One kind of row has no geometry at all.
    coded = coded.withColumn("geom", F.when(F.col("id") % 8 != 7, F.col("geom")))
    return geojson.decode_points(coded, "geom").select("id", "lat", "lng")


# ---------------------------------------------------------------- exports


@query(
    """SELECT tanggal AS "Tanggal", coalesce(strftime(detected_at, '%H:%M:%S'), 'N/A') AS "Waktu", pulau AS "Pulau",
  provinsi AS "Provinsi", kota AS "Kota", kecamatan AS "Kecamatan", desa AS "Desa", satelit AS "Satelit",
  confidence AS "Confidence", detections AS "Jumlah", lat AS "Latitude", lon AS "Longitude"
FROM feat WHERE confidence = 'high'"""
)
def export_detail(spark, sf):
    """Filtered rows written as CSV and read back."""
    path = scratch_path(spark, "export")
    rows = table_view.export_detail(table_view.filter_table(features(spark, sf), confidence=["high"]))
    tables.export_csv(rows, path)
    return spark.read.option("header", True).schema(rows.schema).csv(path)


@query(
    """SELECT tanggal AS "Tanggal", satelit AS "Satelit", confidence AS "Confidence", provinsi AS "Provinsi",
  kota AS "Kota", cast(sum(detections) AS bigint) AS "Jumlah" FROM feat GROUP BY ALL"""
)
def export_accumulated(spark, sf):
    path = scratch_path(spark, "export")
    rows = table_view.export_accumulated(table_view.accumulate_star(feature_star(spark, sf)))
    tables.export_csv(rows, path)
    return spark.read.option("header", True).schema(rows.schema).csv(path)


# ---------------------------------------------------------------- backfill plan and stream


@query(
    """WITH requests AS (SELECT cast(2016 + (year(tanggal) - 1995) * 3 // 2 AS integer) AS year,
    cast(min(month(tanggal)) AS integer) AS m1, cast(max(month(tanggal)) AS integer) AS m2 FROM feat GROUP BY year(tanggal)),
days AS (SELECT year, cast(unnest(generate_series(make_date(year, m1, 1),
    last_day(make_date(year, m2, 1)), INTERVAL 1 DAY)) AS date) AS date FROM requests),
feeds AS (SELECT * FROM (VALUES ('MODIS_NRT', 0, 9999), ('VIIRS_SNPP_NRT', 0, 9999), ('VIIRS_NOAA20_NRT', 2018, 9999),
    ('VIIRS_NOAA21_NRT', 2024, 9999)) f(source, since, until))
SELECT year, date, source FROM days JOIN feeds ON year BETWEEN since AND until"""
)
def backfill_plan(spark, sf):
    """One request per year with detections, moved to the years of the feeds."""
    year = (F.lit(2016) + F.floor((F.year("tanggal") - 1995) * 3 / 2)).cast("int")
    requests = (
        features(spark, sf, "tanggal")
        .groupBy(year.alias("year"))
        .agg(F.min(F.month("tanggal")).alias("start_month"), F.max(F.month("tanggal")).alias("end_month"))
    )
    return backfill.backfill_plan(requests)


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    reader = spark.readStream.schema(TABLE_SCHEMAS["events"])
    return reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query("SELECT event_id, ingested_at, confidence FROM staged")
def incremental_staging(spark, sf):
    """The event file as a stream; a second run finds nothing new and changes nothing."""
    path, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")
    for _ in range(2):
        incremental_ingest(_event_stream(spark, sf), path, checkpoint, as_detections)
    rows = staged_rows(spark, path, tie_break=[F.col("event_id")])
    return rows.select("event_id", "ingested_at", "confidence")


@query(
    """SELECT id, acq_date AS date_value, satellite_id, mapping_id AS location_id FROM placed
JOIN (SELECT latitude, longitude, min(id) AS mapping_id FROM acc GROUP BY 1, 2) USING (latitude, longitude)"""
)
def incremental_facts(spark, sf):
    """The event file streamed into staging, dimensions and facts, twice."""
    root, state = scratch_path(spark, "stream-warehouse"), scratch_path(spark, "stream-state")
    for _ in range(2):
        ingest_into_warehouse(
            _event_stream(spark, sf), root, state, accepted(spark, sf),
            lambda batch, number: as_detections(batch).withColumn("batch_id", F.lit(f"S{number}")),
        )
    return spark.read.parquet(f"{root}/fact_detection").select(
        "id", "date_value", "satellite_id", "location_id"
    )
