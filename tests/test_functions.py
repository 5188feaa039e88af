"""Column functions on chosen values."""

import struct

import pytest
from pyspark.sql import functions as F

from thermalcube.functions import detection as det, geo, text, time


def values(spark, column, rows, ddl="x string"):
    df = spark.createDataFrame([(r,) for r in rows], ddl)
    return [r[0] for r in df.select(column).collect()]


def test_pad_keeps_long_texts(spark):
    got = values(spark, time.pad_hhmm(F.col("x")), ["5", "30", "930", "1230", "12345", None])
    assert got == ["0005", "0030", "0930", "1230", "12345", None]


def test_acquired_at_is_null_for_no_time(spark):
    at = time.acquired_at(F.lit("2024-01-31"), F.col("x"))
    got = values(spark, at.cast("string"), ["5", "2359", "2460", "ab", None])
    assert got == ["2024-01-31 00:05:00", "2024-01-31 23:59:00", None, None, None]


def test_iso_week_and_week_of_month(spark):
    date = F.col("x").cast("date")
    rows = ["2024-12-30", "2021-01-01", "2024-01-07", "2024-01-08", "2024-01-29"]
    assert values(spark, time.calendar(date)["week_value"], rows) == [1, 53, 1, 2, 5]
    assert values(spark, time.week_of_month(date), rows) == [5, 1, 1, 2, 5]
    assert values(spark, time.day_name_id(date), rows[:3]) == ["Senin", "Jumat", "Minggu"]


def test_month_names(spark):
    assert values(spark, time.month_name_id(F.col("x").cast("int")), ["1", "12", "13", "0"]) == [
        "Januari", "Desember", None, None,
    ]
    assert values(spark, time.month_index(F.col("x")), ["Mei", "May"]) == [5, None]


@pytest.mark.parametrize(
    "raw, instrument, label, number, score",
    [
        ("80", "MODIS", "HIGH", 80, 0.8),
        ("79", "MODIS", "NOMINAL", 79, 0.79),
        ("30", "MODIS", "NOMINAL", 30, 0.3),
        ("29", "MODIS", "LOW", 29, 0.29),
        ("bad", "MODIS", "LOW", None, None),
        (None, "MODIS", "LOW", None, None),
        ("h", "VIIRS", "HIGH", 85, 0.85),
        ("nominal", "VIIRS", "NOMINAL", 50, 0.5),
        ("H", "VIIRS", "LOW", 15, 0.15),
        (None, "VIIRS", "LOW", 15, 0.15),
        ("99", "OTHER", "UNKNOWN", 0, 0.0),
        ("99", None, "UNKNOWN", 0, 0.0),
    ],
)
def test_confidence(spark, raw, instrument, label, number, score):
    df = spark.createDataFrame([(raw, instrument)], "c string, i string")
    c, i = F.col("c"), F.col("i")
    row = df.select(
        det.confidence_class(c, i), det.confidence_numeric(c, i), det.confidence_score(c, i)
    ).first()
    assert tuple(row) == (label, number, score)


def test_normalize_region(spark):
    rows = [
        "Kabupaten  Bogor", "KOTA Bandung ", " kabupaten Bogor", "desa Kelurahan Kabupaten x",
        "DI Yogyakarta", "kab. jogjakarta", "Desain", "", None,
    ]
    special = "DAERAH ISTIMEWA YOGYAKARTA"
    assert values(spark, text.normalize_region(F.col("x")), rows) == [
        "BOGOR", "KOTA BANDUNG", "KABUPATEN BOGOR", "X", special, special, "DESAIN", "", "",
    ]


def test_format_thousands(spark):
    got = values(spark, text.format_thousands(F.col("x").cast("bigint")), ["0", "999", "1000", "1234567"])
    assert got == ["0", "999", "1.000", "1.234.567"]


def test_extract_time(spark):
    rows = {
        "2025-01-15T08:30:00": "08:30:00",
        "2025-01-15 08:30:00.75": "08:30:00",
        "2025-01-15T08:30:00Z": "08:30:00",
        "2025-01-15": "00:00:00",
        "15/01/2025 8:5:3": "08:05:03",
        "xx 8:5": "N/A",
        "soon": "N/A",
        "": "N/A",
        None: "N/A",
    }
    assert values(spark, time.extract_time(F.col("x")), list(rows)) == list(rows.values())


def test_format_date(spark):
    rows = {"2015-01-01": "1 Januari 2015", "2025-08-17T10:00:00": "17 Agustus 2025", "": "N/A",
            None: "N/A", "later": "Invalid Date"}
    assert values(spark, time.format_date_id(F.col("x")), list(rows)) == list(rows.values())


def test_keys_keep_empty_parts(spark):
    df = spark.createDataFrame([("a", None, "c")], "x string, y string, z string")
    key = text.joined_key(F.col("x"), F.col("y"), F.col("z"))
    assert df.select(key).first()[0] == "a::c"
    ids = df.select(
        text.surrogate_id(F.lit("ab"), F.lit("c")), text.surrogate_id(F.lit("a"), F.lit("bc"))
    ).first()
    assert ids[0] != ids[1]


def test_satellite_id_is_null_when_a_part_is(spark):
    assert values(spark, det.satellite_id(F.col("x"), F.lit("MODIS")), ["Aqua", None]) == ["Aqua_MODIS", None]


NUMBERS = [0.0, -0.0, 1.0, -1.5, 106.8456, -6.2088, 1e-310, 5e-324, 1.7976931348623157e308, 2.0**-1022]


@pytest.mark.parametrize("layout, header", [("<", (1, 1)), (">", (0, 1))])
def test_points_are_exact(spark, layout, header):
    coded = [struct.pack(f"{layout}BIdd", *header, n, -n).hex() for n in NUMBERS]
    got = values(spark, geo.wkb_point(F.col("x")), coded)
    assert [(struct.pack("d", p.lng), struct.pack("d", p.lat)) for p in got] == [
        (struct.pack("d", n), struct.pack("d", -n)) for n in NUMBERS
    ]


def test_point_dialects_and_unusable_texts(spark):
    good = struct.pack("<BIdd", 1, 1, 1.25, 2.5).hex()
    rows = [
        good.upper(),
        good + "00ff",
        struct.pack("<BIIdd", 1, 0x20000001, 4326, 1.25, 2.5).hex(),
        struct.pack("<BIddd", 1, 0x80000001, 1.25, 2.5, 9.0).hex(),
        struct.pack(">BIdddd", 0, 3001, 1.25, 2.5, 9.0, 9.0).hex(),
    ]
    bad = [
        good[:-1],
        good[:20],
        struct.pack("<BIdd", 1, 2, 1.25, 2.5).hex(),
        struct.pack("<BIdd", 1, 1001, 1.25, 2.5).hex(),
        "zz" + good,
        good[:10] + "x" + good[11:],
        "",
        None,
    ]
    got = values(spark, geo.wkb_point(F.col("x")), rows + bad)
    assert [(p.lng, p.lat) for p in got[: len(rows)]] == [(1.25, 2.5)] * len(rows)
    assert got[len(rows):] == [None] * len(bad)


def test_a_point_is_decoded_once_and_a_long_text_harms_nothing(spark):
    """Not once more for the filter and for each column; a geometry may be megabytes long."""
    from thermalcube.sources.geojson import decode_points

    point = struct.pack("<BIdd", 1, 1, 1.25, 2.5).hex()
    found = decode_points(spark.createDataFrame([(1, point + "00" * 10**6), (2, None), (3, "zz")], "id int, geom string"), "geom")
    assert [tuple(r) for r in found.select("id", "lat", "lng").collect()] == [(1, 2.5, 1.25)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("wkb_point(") == 1


def test_bbox_edges(spark):
    df = spark.createDataFrame([(-11.0, 95.0), (6.0, 141.0), (6.01, 100.0), (None, 100.0)], "a double, o double")
    a, o = F.col("a"), F.col("o")
    assert [r[0] for r in df.select(geo.in_bbox(a, o)).collect()] == [True, True, False, None]
    assert [r[0] for r in df.select(geo.outside_bbox(a, o)).collect()] == [False, False, True, False]
