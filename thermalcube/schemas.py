"""Table columns, types and defaults of the warehouse.

Fixed values: columns of feeds and answers, attributes of boundaries, and the limits of stored types.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Raw detections, in the order of the stored staging table.
DETECTION_COLUMNS = {
    "country_id": "string",
    "latitude": "string",
    "longitude": "string",
    "acq_date": "date",
    "acq_time": "string",
    "satellite": "string",
    "instrument": "string",
    "confidence": "string",
    "version": "string",
    "frp": "float",
    "daynight": "string",
    "brightness": "float",
    "bright_t31": "float",
    "scan": "float",
    "track": "float",
    "bright_ti4": "float",
    "bright_ti5": "float",
}
# Measures that are added as null where a source lacks them.
OPTIONAL_MEASURES = ("brightness", "bright_t31", "scan", "track", "bright_ti4", "bright_ti5")
REQUIRED_DETECTION_COLUMNS = ("latitude", "longitude", "acq_date", "acq_time")
BATCH_COLUMNS = {"batch_id": "string", "ingested_at": "timestamp"}

# Detections repeated by two sources agree on these.
DETECTION_DEDUP_KEYS = ("latitude", "longitude", "acq_date", "acq_time", "satellite", "instrument")
# Key of the staging table: one row per key, newest ingested_at wins.
DETECTION_KEYS = (*DETECTION_DEDUP_KEYS, "version")
WEATHER_KEYS = ("latitude", "longitude", "datetime")
COORDINATE = ("latitude", "longitude")

# Staged weather: column, type, value range of the stored integer type (None = float or text).
WEATHER_COLUMNS = {
    "batch_id": ("string", None),
    "ingested_at": ("timestamp", None),
    "latitude": ("string", None),
    "longitude": ("string", None),
    "datetime": ("string", None),
    "temperature": ("smallint", (-32768, 32767)),
    "feels_like": ("float", None),
    "humidity": ("float", None),
    "precipitation": ("float", None),
    "precip_prob": ("smallint", (0, 255)),
    "wind_speed": ("float", None),
    "wind_degree": ("float", None),
    "wind_gust": ("float", None),
    "pressure": ("int", (0, 65535)),
    "visibility": ("int", (0, 65535)),
    "cloud_coverage": ("smallint", (0, 255)),
    "solar_radiation": ("float", None),
    "solar_energy": ("float", None),
    "uv_index": ("smallint", (0, 255)),
    "severe_risk": ("smallint", (0, 255)),
    "conditions": ("string", None),
    "icon": ("string", None),
}
# Field of the weather response's "currentConditions" object -> staged column.
WEATHER_FIELDS = {
    "conditions": "conditions",
    "icon": "icon",
    "temp": "temperature",
    "feelslike": "feels_like",
    "humidity": "humidity",
    "precip": "precipitation",
    "precipprob": "precip_prob",
    "windspeed": "wind_speed",
    "winddir": "wind_degree",
    "windgust": "wind_gust",
    "pressure": "pressure",
    "visibility": "visibility",
    "cloudcover": "cloud_coverage",
    "solarradiation": "solar_radiation",
    "solarenergy": "solar_energy",
    "uvindex": "uv_index",
    "severerisk": "severe_risk",
}
# Field of the place response -> location column.
PLACE_FIELDS = {
    "adm1": "province_code",
    "adm2": "city_code",
    "adm3": "district_code",
    "adm4": "subdistrict_code",
    "provinsi": "province_name",
    "kotkab": "city_name",
    "kecamatan": "district_name",
    "desa": "subdistrict_name",
}
UNDEFINED_PLACE = "Area Tidak Terdefinisi"

DIM_LOCATION_COLUMNS = (
    "id", "latitude", "longitude", "province_code", "province_name", "city_code", "city_name",
    "district_code", "district_name", "subdistrict_code", "subdistrict_name",
)
# Names that make an area, from the second level down.
AREA_NAMES = ("province_name", "city_name", "district_name", "subdistrict_name")
# Day of a fact row, the folder partition of the stored fact tables.
DAY = "date_value"
FACT_MEASURES = ("frp", "brightness", "bright_t31", "bright_ti4", "bright_ti5", "scan", "track")
FACT_DETECTION_COLUMNS = (
    "id", "satellite_id", "confidence_id", "period_id", "location_id", "acquired_at",
    "frp", "brightness", "bright_t31", "bright_ti4", "bright_ti5", "latitude", "longitude",
    "scan", "track", DAY,
)
FACT_WEATHER_COLUMNS = (
    "id", "period_id", "location_id", "weather_condition_id", "acquired_at", "temperature",
    "humidity", "wind_speed", "wind_degree", "visibility", "cloud_coverage", "latitude",
    "longitude", "pressure", "uv_index", "precipitation", "solar_radiation", DAY,
)
WAREHOUSE_TABLES = (
    "staging_detection", "staging_weather",
    "dim_period", "dim_location", "dim_satellite", "dim_confidence", "dim_weather_condition",
    "fact_detection", "fact_weather",
)

# Detection feeds asked for every day, in the order that decides which copy is kept.
DAILY_SOURCES = (
    "MODIS_NRT", "MODIS_SP", "VIIRS_NOAA20_NRT", "VIIRS_NOAA20_SP", "VIIRS_NOAA21_NRT",
    "VIIRS_SNPP_NRT", "VIIRS_SNPP_SP",
)
# Historical feeds: (source, first year, last year); None is open-ended.
BACKFILL_SOURCES = (
    ("MODIS_NRT", None, None),
    ("VIIRS_SNPP_NRT", None, None),
    ("VIIRS_NOAA20_NRT", 2018, None),
    ("VIIRS_NOAA21_NRT", 2024, None),
)
# Bounding box of the country: longitude and latitude limits.
BBOX = {"lon": (95.0, 141.0), "lat": (-11.0, 6.0)}
COUNTRY_CODE = "IDN"

PLACE_LEVELS = ("pulau", "provinsi", "kota", "kecamatan", "desa")
TIME_LEVELS = ("tahun", "semester", "kuartal", "bulan", "minggu")
# Boundary files: attribute that names a region of each level.
BOUNDARY_NAME_FIELDS = {
    "pulau": "PULAU",
    "provinsi": "WADMPR",
    "kota": "WADMKK",
    "kecamatan": "WADMKC",
    "desa": "NAMOBJ",
}
MONTH_NAMES = (
    "Januari", "Februari", "Maret", "April", "Mei", "Juni",
    "Juli", "Agustus", "September", "Oktober", "November", "Desember",
)
DAY_NAMES = ("Minggu", "Senin", "Selasa", "Rabu", "Kamis", "Jumat", "Sabtu")
# Map classes: name and colour, from few to many detections.
MAP_CLASSES = (("rendah", "#FFCDD2"), ("sedang", "#EF5350"), ("tinggi", "#B71C1C"))

POINT_TYPE = T.StructType(
    [T.StructField("type", T.StringType()), T.StructField("coordinates", T.ArrayType(T.DoubleType()))]
)
FEATURE_TYPE = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("geometry", POINT_TYPE),
        T.StructField(
            "properties",
            T.StructType(
                [
                    # Warehouse ids are texts; a number is read as its digits.
                    T.StructField("id", T.StringType()),
                    T.StructField("minggu", T.StringType()),
                    T.StructField("confidence", T.StringType()),
                    T.StructField("satellite", T.StringType()),
                    T.StructField("time", T.StringType()),
                    T.StructField("detected_at", T.StringType()),
                    T.StructField("detections", T.LongType()),
                    T.StructField(
                        "location",
                        T.StructType(
                            [
                                T.StructField(name, T.StringType())
                                for name in ("pulau", "provinsi", "kab_kota", "kecamatan", "desa")
                            ]
                        ),
                    ),
                ]
            ),
        ),
    ]
)
