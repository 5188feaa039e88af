"""Queries of the column functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from thermalcube.checks.registry import query
from thermalcube.checks.views import detections, features, locations, table
from thermalcube.functions import detection as det, geo, text, time
from thermalcube.operators import filters
from thermalcube.plans.star import with_time_members

MONTHS = (
    "['Januari','Februari','Maret','April','Mei','Juni','Juli','Agustus','September','Oktober',"
    "'November','Desember']"
)


@query("SELECT event_id, lpad(acq_time, 4, '0') AS hhmm FROM det")
def pad_hhmm(spark, sf):
    return detections(spark, sf).select("event_id", time.pad_hhmm(F.col("acq_time")).alias("hhmm"))


@query(
    """SELECT event_id, cast(acq_date AS timestamp) + to_hours(cast(lpad(acq_time, 4, '0')[1:2] AS integer))
  + to_minutes(cast(lpad(acq_time, 4, '0')[3:4] AS integer)) AS acquired_at FROM det"""
)
def acquired_at(spark, sf):
    return detections(spark, sf).select(
        "event_id", time.acquired_at(F.col("acq_date"), F.col("acq_time")).alias("acquired_at")
    )


@query(
    """SELECT event_id, concat(cast(acq_date AS varchar), 'T', hhmm[1:2], ':', hhmm[3:4], ':00') AS lookup,
  concat(cast(acq_date AS varchar), ' ', hhmm[1:2], ':', hhmm[3:4], ':00') AS weather FROM wx"""
)
def iso_datetime(spark, sf):
    date, hhmm = F.col("acq_date"), F.col("acq_time")
    return detections(spark, sf).select(
        "event_id",
        time.iso_datetime(date, hhmm).alias("lookup"),
        time.weather_datetime(date, hhmm).alias("weather"),
    )


@query(
    """SELECT DISTINCT tanggal, cast(year(tanggal) AS integer) AS year_value,
  CASE WHEN month(tanggal) <= 6 THEN 1 ELSE 2 END AS semester_value,
  cast(quarter(tanggal) AS integer) AS quarter_value, cast(month(tanggal) AS integer) AS month_value,
  monthname(tanggal) AS month_name, cast(weekofyear(tanggal) AS integer) AS week_value FROM feat"""
)
def calendar(spark, sf):
    days = features(spark, sf, "tanggal").distinct()
    return days.select("tanggal", *[c.alias(n) for n, c in time.calendar(F.col("tanggal")).items()])


@query(
    f"""SELECT id, cast(year(tanggal) AS integer) AS tahun, CASE WHEN month(tanggal) <= 6 THEN 1 ELSE 2 END AS semester,
  concat('Q', cast(quarter(tanggal) AS varchar)) AS kuartal, {MONTHS}[month(tanggal)] AS bulan,
  cast(ceil(day(tanggal) / 7.0) AS integer) AS minggu,
  ['Minggu','Senin','Selasa','Rabu','Kamis','Jumat','Sabtu'][dayofweek(tanggal) + 1] AS hari FROM feat"""
)
def time_attributes(spark, sf):
    return with_time_members(features(spark, sf, "id", "tanggal")).drop("tanggal")


@query(
    f"SELECT DISTINCT {MONTHS}[month(tanggal)] AS month_name, cast(month(tanggal) AS integer) AS month_index FROM feat"
)
def month_names(spark, sf):
    months = features(spark, sf, "tanggal").select(F.month("tanggal").alias("m")).distinct()
    name = time.month_name_id(F.col("m"))
    return months.select(name.alias("month_name"), time.month_index(name).alias("month_index"))


@query(
    """SELECT event_id,
  CASE instrument WHEN 'MODIS' THEN CASE WHEN try_cast(confidence AS integer) >= 80 THEN 'HIGH'
      WHEN try_cast(confidence AS integer) >= 30 THEN 'NOMINAL' ELSE 'LOW' END
    WHEN 'VIIRS' THEN CASE WHEN confidence IN ('h', 'high') THEN 'HIGH' WHEN confidence IN ('n', 'nominal') THEN 'NOMINAL' ELSE 'LOW' END
    ELSE 'UNKNOWN' END AS confidence_class,
  CASE instrument WHEN 'MODIS' THEN try_cast(confidence AS integer)
    WHEN 'VIIRS' THEN CASE WHEN confidence IN ('h', 'high') THEN 85 WHEN confidence IN ('n', 'nominal') THEN 50 ELSE 15 END
    ELSE 0 END AS confidence_numeric,
  CASE instrument WHEN 'MODIS' THEN round(try_cast(confidence AS double) / 100, 4)
    WHEN 'VIIRS' THEN CASE WHEN confidence IN ('h', 'high') THEN 0.85::double WHEN confidence IN ('n', 'nominal') THEN 0.5::double ELSE 0.15::double END
    ELSE 0::double END AS confidence_score FROM det"""
)
def confidence_attributes(spark, sf):
    raw, instrument = F.col("confidence"), F.col("instrument")
    return detections(spark, sf).select(
        "event_id",
        det.confidence_class(raw, instrument).alias("confidence_class"),
        det.confidence_numeric(raw, instrument).alias("confidence_numeric"),
        det.confidence_score(raw, instrument).alias("confidence_score"),
    )


@query(
    """SELECT event_id, CASE instrument WHEN 'VIIRS' THEN 375 ELSE 1000 END AS spatial_resolution_m,
  CASE instrument WHEN 'VIIRS' THEN 6 ELSE 12 END AS temporal_resolution_hours,
  CASE instrument WHEN 'MODIS' THEN 'Moderate Resolution Imaging Spectroradiometer'
    WHEN 'VIIRS' THEN 'Visible Infrared Imaging Radiometer Suite' ELSE 'Unknown instrument' END AS description FROM det"""
)
def instrument_info(spark, sf):
    info = det.instrument_info(F.col("instrument"))
    return detections(spark, sf).select("event_id", *[c.alias(n) for n, c in info.items()])


@query(
    """SELECT event_id, CASE WHEN event_id % 50 <> 0 THEN concat(satellite, '_', instrument) END AS satellite_id FROM det"""
)
def satellite_id(spark, sf):
    satellite = F.when(F.col("event_id") % 50 != 0, F.col("satellite"))
    return detections(spark, sf).select(
        "event_id", det.satellite_id(satellite, F.col("instrument")).alias("satellite_id")
    )


@query(
    """SELECT c_custkey, CASE c_custkey % 7
    WHEN 4 THEN 'DAERAH ISTIMEWA YOGYAKARTA'
    WHEN 5 THEN concat('KABUPATEN ', upper(c_name)) WHEN 3 THEN concat('KOTA ', upper(c_name))
    WHEN 6 THEN '' ELSE upper(c_name) END AS region FROM customer"""
)
def normalize_region(spark, sf):
    """Names with every kind of prefix; a leading space keeps a prefix."""
    name, kind = F.col("c_name"), F.col("c_custkey") % 7
    raw = (
        F.when(kind == 0, F.concat(F.lit("Kabupaten  "), name))
        .when(kind == 1, F.concat(F.lit("desa "), name, F.lit(" ")))
        .when(kind == 2, F.concat(F.lit("KELURAHAN "), name))
        .when(kind == 3, F.concat(F.lit("Kota "), name))
        .when(kind == 4, F.concat(F.lit("Kabupaten Sleman, jogjakarta "), name))
        .when(kind == 5, F.concat(F.lit(" KABUPATEN "), name))
    )
    return table(spark, sf, "customer").select("c_custkey", text.normalize_region(raw).alias("region"))


@query(
    """SELECT id, regexp_replace(reverse(regexp_replace(reverse(cast(id * 7919 AS varchar)), '(\\d{3})', '\\1.', 'g')), '^\\.', '') AS shown FROM feat"""
)
def format_thousands(spark, sf):
    return features(spark, sf, "id").select(
        "id", text.format_thousands(F.col("id") * 7919).alias("shown")
    )


@query(
    """SELECT event_id, CASE WHEN event_id % 7 IN (5, 6) THEN 'N/A'
    WHEN event_id % 7 = 4 THEN concat(lpad(cast(extract(hour FROM ts) AS varchar), 2, '0'), ':07:05')
    WHEN event_id % 7 = 3 THEN '00:00:00'
    ELSE strftime(ts, '%H:%M:%S') END AS clock FROM events"""
)
def extract_time(spark, sf):
    """Date-time texts in several spellings, some unusable."""
    ts, kind = F.col("ts"), F.col("event_id") % 7
    written = (
        F.when(kind == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(kind == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS"))
        .when(kind == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(kind == 3, F.date_format(ts, "yyyy-MM-dd"))
        .when(kind == 4, F.concat(F.lit("on "), F.hour(ts).cast("string"), F.lit(":7:5.25")))
        .when(kind == 5, F.lit("no time"))
    )
    return table(spark, sf, "events").select("event_id", time.extract_time(written).alias("clock"))


@query(
    f"""SELECT id, CASE WHEN id % 11 = 0 THEN 'N/A' WHEN id % 11 = 1 THEN 'Invalid Date' ELSE
  concat(cast(day(tanggal) AS varchar), ' ', {MONTHS}[month(tanggal)], ' ', cast(year(tanggal) AS varchar)) END AS shown FROM feat"""
)
def format_date_id(spark, sf):
    written = F.when(F.col("id") % 11 == 1, "soon").when(
        F.col("id") % 11 > 1, F.col("tanggal").cast("string")
    )
    return features(spark, sf, "id", "tanggal").select(
        "id", time.format_date_id(F.coalesce(written, F.lit(""))).alias("shown")
    )


@query("SELECT id, cast(tanggal AS varchar) AS day FROM feat")
def date_part(spark, sf):
    written = F.when(F.col("id") % 3 == 0, F.col("tanggal").cast("string")).otherwise(
        F.concat(F.col("tanggal").cast("string"), F.lit("T10:30:00Z"))
    )
    return features(spark, sf, "id", "tanggal").select("id", text.date_part(written).alias("day"))


@query(
    "SELECT id, CASE WHEN id % 4 <> 0 THEN lat END AS lat, CASE WHEN id % 4 <> 0 THEN lon END AS lon FROM feat"
)
def coordinate_parts(spark, sf):
    pair = F.when(F.col("id") % 4 != 0, F.array("lon", "lat")).otherwise(
        F.array().cast("array<double>")
    )
    return features(spark, sf, "id", "lat", "lon").select(
        "id", geo.lat_of(pair).alias("lat"), geo.lon_of(pair).alias("lon")
    )


@query(
    """SELECT event_id, concat(latitude, ':', longitude, ':', cast(acq_date AS varchar), ':', acq_time, ':',
  satellite, ':', CASE WHEN event_id % 5 <> 0 THEN instrument ELSE '' END, ':', version) AS detection_key FROM det"""
)
def detection_key(spark, sf):
    """A missing part stays as an empty one."""
    instrument = F.when(F.col("event_id") % 5 != 0, F.col("instrument"))
    parts = [F.col(c) for c in ("latitude", "longitude", "acq_date", "acq_time", "satellite")]
    return detections(spark, sf).select(
        "event_id", text.detection_key(*parts, instrument, F.col("version")).alias("detection_key")
    )


@query("SELECT id, latitude, longitude, district_name, subdistrict_name FROM acc")
def valid_location(spark, sf):
    return filters.valid_location(locations(spark, sf)).select(
        "id", "latitude", "longitude", "district_name", "subdistrict_name"
    )
