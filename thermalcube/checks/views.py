"""Views that give the driver's tables the shape of detections, places, weather and features.

Each view exists twice: as DataFrames for the operators, and as SQL for the comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from thermalcube.plans.star import PLACE_KEY, Star
from thermalcube.session import fits_broadcast


# Known schemas of the given tables; naming them saves a schema-reading job per read.
TABLE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
        "props string"
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _grid(key: str) -> tuple[str, str]:
    """Latitude and longitude expressions that spread keys over quarter-degree points."""
    lat = f"cast(-11 + {key} % 18 AS double) + cast({key} % 4 AS double) * 0.25D"
    lon = f"cast(95 + {key} % 46 AS double) + cast({key} % 8 AS double) * 0.125D"
    return lat, lon


def _with_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with nation and region, two tables of fixed small size."""
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = table(spark, sf_dir, "customer").join(nations, F.expr("c_nationkey = n_nationkey"))
    return joined.join(regions, F.expr("n_regionkey = r_regionkey"))


def feature_star(spark: SparkSession, sf_dir: str, java: bool = False) -> Star:
    """Orders as detections, customers with nation and region as their places.

    ``java`` renames one region and two nations, so that the rules for the special province and
    for name prefixes have something to work on.
    """
    lat, lon = _grid("o_custkey")
    facts = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id",
        f"o_custkey AS {PLACE_KEY}",
        "cast(o_orderdate AS date) AS tanggal",
        """CASE WHEN o_orderkey % 1009 <> 0 THEN timestamp_seconds(
             unix_timestamp(cast(cast(o_orderdate AS date) AS timestamp)) + (o_orderkey * 37) % 86400)
           END AS detected_at""",
        "CASE o_orderstatus WHEN 'F' THEN 'Terra' WHEN 'O' THEN 'Aqua' ELSE 'SNPP' END AS satelit",
        """CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high'
           WHEN o_orderpriority = '3-MEDIUM' THEN 'medium' ELSE 'low' END AS confidence""",
        "cast(1 AS bigint) AS detections",
        f"{lat} AS lat",
        f"{lon} AS lon",
    )
    island, province, city = "r_name", "n_name", "concat_ws(' ', n_name, c_mktsegment)"
    district = f"concat({city}, ' ', cast(c_custkey % 3 AS string))"
    if java:
        island = "CASE WHEN n_regionkey = 2 THEN 'Jawa' ELSE r_name END"
        province = "CASE WHEN n_nationkey % 12 = 2 THEN concat('DI Yogyakarta ', n_name) ELSE n_name END"
        city = f"""CASE c_nationkey % 4 WHEN 0 THEN concat('Kabupaten ', {city}) WHEN 1 THEN concat('KOTA ', {city})
            WHEN 2 THEN concat(' kabupaten ', {city}) ELSE concat({city}, '  ') END"""
    places = _with_nation(spark, sf_dir).selectExpr(
        f"c_custkey AS {PLACE_KEY}",
        f"{island} AS pulau",
        f"{province} AS provinsi",
        f"{city} AS kota",
        f"{district} AS kecamatan",
        "c_name AS desa",
    )
    # One place row per customer, a few short texts wide: the customer table's size decides.
    return Star(facts, places, fits_broadcast(table(spark, sf_dir, "customer")))


FEATURE_COLUMNS = (
    "id", "tanggal", "detected_at", "satelit", "confidence", "pulau", "provinsi", "kota",
    "kecamatan", "desa", "detections", "lat", "lon",
)


def features(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Flat feature rows; only the tables that the asked columns need are joined."""
    return feature_star(spark, sf_dir).flat(*(columns or FEATURE_COLUMNS))


def detections(spark: SparkSession, sf_dir: str, *also: str) -> DataFrame:
    """Events as raw detections, with further event columns as they are."""
    return as_detections(table(spark, sf_dir, "events"), *also)


def as_detections(events: DataFrame, *also: str) -> DataFrame:
    return events.selectExpr(
        "event_id",
        "value AS frp",
        "user_id AS loc_key",
        "concat('B', cast(event_id % 4 AS string)) AS batch_id",
        "cast(ts AS timestamp) AS ingested_at",
        "cast(-11 + user_id % 18 AS string) AS latitude",
        "cast(95 + user_id % 47 AS string) AS longitude",
        "cast(ts AS date) AS acq_date",
        "cast(hour(ts) * 100 + (event_id % 2) * 30 AS string) AS acq_time",
        """CASE event_type WHEN 'view' THEN 'Terra' WHEN 'click' THEN 'Aqua' WHEN 'purchase' THEN 'N20'
           WHEN 'signup' THEN 'N' ELSE 'X' END AS satellite""",
        """CASE WHEN event_type IN ('view', 'click') THEN 'MODIS'
           WHEN event_type IN ('purchase', 'signup') THEN 'VIIRS' ELSE 'OTHER' END AS instrument""",
        """CASE WHEN event_id % 97 = 0 THEN 'bad'
           WHEN event_type IN ('view', 'click') THEN cast(event_id % 101 AS string)
           WHEN event_id % 3 = 0 THEN 'h' WHEN event_id % 3 = 1 THEN 'n' ELSE 'l' END AS confidence""",
        "concat('v', cast(event_id % 2 AS string)) AS version",
        *also,
    )


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as answered places, some of them to be refused."""
    city = "concat_ws(' ', n_name, c_mktsegment)"
    return _with_nation(spark, sf_dir).selectExpr(
        "concat('LOC', cast(c_custkey AS string)) AS id",
        "cast(-11 + c_custkey % 18 AS string) AS latitude",
        "cast(95 + c_custkey % 47 AS string) AS longitude",
        "r_name AS pulau",
        "cast(n_nationkey AS string) AS province_code",
        "n_name AS province_name",
        "concat(cast(n_nationkey AS string), '.', c_mktsegment) AS city_code",
        f"{city} AS city_name",
        "cast(c_custkey % 3 AS string) AS district_code",
        f"CASE WHEN c_custkey % 13 <> 0 THEN concat({city}, ' ', cast(c_custkey % 3 AS string)) END AS district_name",
        "concat('S', cast(c_custkey AS string)) AS subdistrict_code",
        """CASE WHEN c_custkey % 17 = 0 THEN 'Area Tidak Terdefinisi' WHEN c_custkey % 19 = 0 THEN ''
           ELSE c_name END AS subdistrict_name""",
    )


def place_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as the app's list of places with coordinates."""
    lat, lng = _grid(PLACE_KEY)
    return feature_star(spark, sf_dir).places.selectExpr(
        f"{PLACE_KEY} AS id", "pulau", "provinsi", "kota", "kecamatan", "desa",
        f"{lat} AS lat", f"{lng} AS lng",
    )


def place_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places as the JSON a geocoder answers; fields without a value are absent."""
    return locations(spark, sf_dir).selectExpr(
        "id", "latitude", "longitude",
        """to_json(named_struct('adm1', province_code, 'adm2', city_code,
             'adm3', CASE WHEN id <> 'LOC7' THEN district_code END, 'adm4', subdistrict_code,
             'provinsi', province_name, 'kotkab', city_name, 'kecamatan', district_name,
             'desa', subdistrict_name)) AS response""",
    )


def weather_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as weather answers; every tenth has no current conditions."""
    rows = detections(spark, sf_dir, "cast(get_json_object(props, '$.k') AS int) AS k")
    return rows.selectExpr(
        "event_id", "latitude", "longitude", "acq_date", "acq_time", "batch_id", "ingested_at", "k",
        """CASE WHEN event_id % 10 <> 0 THEN to_json(named_struct('currentConditions', named_struct(
             'temp', k, 'windspeed', k * 0.5D, 'pressure', k * 10,
             'conditions', concat('cond-', cast(k % 4 AS string)),
             'icon', concat('icon-', cast(k % 8 AS string))))) ELSE '{}' END AS response""",
    )


SQL_VIEWS = {
    "feat": """
SELECT o_orderkey AS id, cast(o_orderdate AS date) AS tanggal,
  CASE WHEN o_orderkey % 1009 <> 0
       THEN cast(cast(o_orderdate AS date) AS timestamp) + to_seconds(cast((o_orderkey * 37) % 86400 AS integer))
  END AS detected_at,
  CASE o_orderstatus WHEN 'F' THEN 'Terra' WHEN 'O' THEN 'Aqua' ELSE 'SNPP' END AS satelit,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high'
       WHEN o_orderpriority = '3-MEDIUM' THEN 'medium' ELSE 'low' END AS confidence,
  r_name AS pulau, n_name AS provinsi, concat(n_name, ' ', c_mktsegment) AS kota,
  concat(n_name, ' ', c_mktsegment, ' ', cast(c_custkey % 3 AS varchar)) AS kecamatan,
  c_name AS desa, cast(1 AS bigint) AS detections,
  cast(-11 + (c_custkey % 18) AS double) + cast(c_custkey % 4 AS double) * 0.25::double AS lat,
  cast(95 + (c_custkey % 46) AS double) + cast(c_custkey % 8 AS double) * 0.125::double AS lon,
  c_custkey, n_nationkey, n_regionkey
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
""",
    "det": """
SELECT event_id, value AS frp, user_id AS loc_key,
  concat('B', cast(event_id % 4 AS varchar)) AS batch_id, ts AS ingested_at,
  cast(-11 + (user_id % 18) AS varchar) AS latitude, cast(95 + (user_id % 47) AS varchar) AS longitude,
  cast(ts AS date) AS acq_date,
  cast(extract(hour FROM ts) * 100 + (event_id % 2) * 30 AS varchar) AS acq_time,
  CASE event_type WHEN 'view' THEN 'Terra' WHEN 'click' THEN 'Aqua' WHEN 'purchase' THEN 'N20'
       WHEN 'signup' THEN 'N' ELSE 'X' END AS satellite,
  CASE WHEN event_type IN ('view', 'click') THEN 'MODIS'
       WHEN event_type IN ('purchase', 'signup') THEN 'VIIRS' ELSE 'OTHER' END AS instrument,
  CASE WHEN event_id % 97 = 0 THEN 'bad'
       WHEN event_type IN ('view', 'click') THEN cast(event_id % 101 AS varchar)
       WHEN event_id % 3 = 0 THEN 'h' WHEN event_id % 3 = 1 THEN 'n' ELSE 'l' END AS confidence,
  concat('v', cast(event_id % 2 AS varchar)) AS version
FROM events
""",
    "loc": """
SELECT concat('LOC', cast(c_custkey AS varchar)) AS id, c_custkey,
  cast(-11 + (c_custkey % 18) AS varchar) AS latitude, cast(95 + (c_custkey % 47) AS varchar) AS longitude,
  r_name AS pulau, cast(n_nationkey AS varchar) AS province_code, n_name AS province_name,
  concat(cast(n_nationkey AS varchar), '.', c_mktsegment) AS city_code,
  concat(n_name, ' ', c_mktsegment) AS city_name, cast(c_custkey % 3 AS varchar) AS district_code,
  CASE WHEN c_custkey % 13 <> 0
       THEN concat(n_name, ' ', c_mktsegment, ' ', cast(c_custkey % 3 AS varchar)) END AS district_name,
  concat('S', cast(c_custkey AS varchar)) AS subdistrict_code,
  CASE WHEN c_custkey % 17 = 0 THEN 'Area Tidak Terdefinisi' WHEN c_custkey % 19 = 0 THEN ''
       ELSE c_name END AS subdistrict_name
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""",
    "wx": """
SELECT event_id, cast(-11 + (user_id % 18) AS varchar) AS latitude,
  cast(95 + (user_id % 47) AS varchar) AS longitude, cast(ts AS date) AS acq_date,
  lpad(cast(extract(hour FROM ts) * 100 + (event_id % 2) * 30 AS varchar), 4, '0') AS hhmm,
  concat('B', cast(event_id % 4 AS varchar)) AS batch_id, ts AS ingested_at,
  cast(json_extract_string(props, '$.k') AS integer) AS k, event_id % 10 <> 0 AS answered
FROM events
""",
    "pl": """
SELECT r_name AS pulau, n_name AS provinsi, concat(n_name, ' ', c_mktsegment) AS kota,
  concat(n_name, ' ', c_mktsegment, ' ', cast(c_custkey % 3 AS varchar)) AS kecamatan, c_name AS desa
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""",
    # Weather after flattening.
    "wflat": """
SELECT event_id, latitude, longitude, acq_date, batch_id, ingested_at, k,
  concat(cast(acq_date AS varchar), ' ', substr(hhmm, 1, 2), ':', substr(hhmm, 3, 2), ':00') AS datetime,
  CASE WHEN answered THEN concat('cond-', cast(k % 4 AS varchar)) ELSE '' END AS conditions,
  CASE WHEN answered THEN concat('icon-', cast(k % 8 AS varchar)) ELSE '' END AS icon,
  CASE WHEN answered THEN cast(k AS double) ELSE 0::double END AS temperature,
  CASE WHEN answered THEN cast(k AS double) * 0.5::double ELSE 0::double END AS wind_speed,
  CASE WHEN answered THEN cast(k * 10 AS double) ELSE 0::double END AS pressure
FROM wx
""",
    # Accepted places, and one of them per coordinate.
    "acc": """
SELECT * FROM loc WHERE district_name IS NOT NULL AND coalesce(subdistrict_name, '') <> ''
  AND subdistrict_name <> 'Area Tidak Terdefinisi'
""",
    "mapping": """
SELECT latitude, longitude, min(id) AS location_id FROM acc GROUP BY latitude, longitude
""",
    # Staged detections and weather, newest per key.
    "staged": """
SELECT * FROM det QUALIFY row_number() OVER (
  PARTITION BY latitude, longitude, acq_date, acq_time, satellite, instrument, version
  ORDER BY ingested_at DESC, event_id) = 1
""",
    "wstaged": """
SELECT * FROM wflat QUALIFY row_number() OVER (
  PARTITION BY latitude, longitude, datetime ORDER BY ingested_at DESC, event_id) = 1
""",
    "placed": """
SELECT sha256(concat(latitude, ':', longitude, ':', cast(acq_date AS varchar), ':', acq_time, ':',
    satellite, ':', instrument, ':', version)) AS id,
  concat(satellite, '_', instrument) AS satellite_id,
  sha256(concat(confidence, chr(31), instrument)) AS confidence_id,
  sha256(cast(acq_date AS varchar)) AS period_id, location_id,
  cast(acq_date AS timestamp) + to_hours(cast(lpad(acq_time, 4, '0')[1:2] AS integer))
    + to_minutes(cast(lpad(acq_time, 4, '0')[3:4] AS integer)) AS acquired_at,
  cast(cast(frp AS float) AS double) AS frp, latitude, longitude, batch_id, acq_date, event_id,
  satellite, instrument, confidence
FROM staged JOIN mapping USING (latitude, longitude)
""",
}
