"""Cube questions from kept day counts, and the clusters of all zooms."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from test_follow import follow_all, stage
from test_warehouse import detection, places
from thermalcube.plans import cube, dashboard, follow, questions, table_view
from thermalcube.plans.kept_counts import AREAS, COUNTS
from thermalcube.plans.star import warehouse_star
from thermalcube.schemas import DIM_LOCATION_COLUMNS, WAREHOUSE_TABLES
from thermalcube.sources import tables

QUESTIONS = {
    "islands": lambda s: cube.count_by_level(s, "pulau"),
    "villages": lambda s: cube.count_by_level(s, "desa", {"provinsi": "Riau", "confidence": "high", "tahun": "2024"}),
    "drill": lambda s: cube.drill_down(s, {"pulau": "Sumatera"}, {"satelite": "aqua"}),
    "roll up": lambda s: cube.roll_up(s),
    "rolled month": lambda s: cube.roll_up(s, {"tahun": "2024", "bulan": "Januari", "minggu": "1"}),
    "confidence": lambda s: cube.count_by_confidence(s),
    "satellites": lambda s: cube.count_by_satellite(s, {"provinsi": "Riau"}),
    "months": lambda s: cube.time_members(s, "bulan", {"tahun": "2024"}),
    "days of a place": lambda s: cube.time_members(s, "minggu", {"pulau": "Sumatera", "confidence": "high"}),
    "map": lambda s: cube.choropleth_counts(s, "provinsi"),
    "asked": lambda s: questions.ask(s, "location", {"tipe": "kota", "date": "2024-01-05"}),
}


def star_of(spark, root):
    islands = spark.createDataFrame([("Riau", "Sumatera"), ("Aceh", "Sumatera")], "province_name string, pulau string")
    return warehouse_star(tables.stored_tables(spark, root, *WAREHOUSE_TABLES, COUNTS, AREAS), islands)


def answers(star):
    return {name: sorted(map(str, ask(star).collect())) for name, ask in QUESTIONS.items()}


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("w"))
    names = [("L0", "1.0", "100.0", "Riau", "Siak", "Tualang", "Perawang"), ("L1", "2.0", "100.0", "Riau", "Siak", "Tualang", "Perawang"),
             ("L2", "3.0", "101.0", "Aceh", "Pidie", "Sigli", ""), ("L3", "4.0", "101.0", "Banten", "Lebak", "Bayah", "Sawarna")]
    known = spark.createDataFrame(names, "id string, latitude string, longitude string, province_name string, city_name string, "
                                  "district_name string, subdistrict_name string")
    known = known.withColumns({c: F.lit("") for c in DIM_LOCATION_COLUMNS if c not in known.columns})
    tables.append_table(known, f"{root}/dim_location", DIM_LOCATION_COLUMNS)
    rows = [
        detection(lat=lat, lon=lon, date=date, time=time, satellite=sat, confidence=conf)
        for lat, lon in (("1.0", "100.0"), ("2.0", "100.0"), ("3.0", "101.0"), ("4.0", "101.0"), ("9.0", "99.0"))
        for date in ("2024-01-05", "2024-01-16", "2024-02-01") for time, sat, conf in (("930", "Aqua", "85"), ("1000", "Terra", "40"), ("1100", "Aqua", "9"))
    ]
    stage(spark, root, *rows)
    # The place at (9, 99) is given, not stored: its facts have no names.
    follow_all(spark, root, "a", ("9.0", "99.0"))
    return root


def test_answers_agree_before_and_after_a_replaced_day(spark, loaded):
    for run in range(3):
        if run:
            stage(spark, loaded, detection(minute=run, time="2000", confidence="95"), detection(minute=run, satellite="Terra", time=f"21{run}0"))
            follow_all(spark, loaded, f"b{run}", ("9.0", "99.0"))
        star = star_of(spark, loaded)
        assert star.kept is not None
        assert answers(star) == answers(replace(star, kept=None))
        counted = spark.read.parquet(f"{loaded}/{COUNTS}")
        assert counted.agg(F.sum("detections")).first()[0] == spark.read.parquet(f"{loaded}/fact_detection").count()
        # Two coordinates of one village are one area.
        assert spark.read.parquet(f"{loaded}/{AREAS}").count() == 3


def test_no_fact_file_is_read(spark, loaded):
    star = star_of(spark, loaded)
    for name, ask in QUESTIONS.items():
        read = ask(star).inputFiles()
        assert any(COUNTS in f for f in read) and not any("fact_detection" in f for f in read), name
    # Columns that the counts don't hold, and rows: answered from the facts.
    for frame in (questions.detections(star), dashboard.kpis(star), star.totals(["provinsi"], {"frp": F.col("lat")}),
                  dashboard.latest_detections(star, 3, "id", "provinsi"), table_view.accumulate_star(star)):
        assert any("fact_detection" in f for f in frame.inputFiles())


def test_counts_lost_or_out_of_date_are_counted_again(spark, loaded):
    facts = spark.read.parquet(f"{loaded}/fact_detection")
    fewer = facts.filter("date_value = '2024-02-01'").limit(4).collect()
    tables.replace_days(spark.createDataFrame(fewer, facts.schema), f"{loaded}/fact_detection", "date_value", ["id"])
    # As after a driver lost between facts and counts: the next look at the day mends both.
    assert [v for v in follow_all(spark, loaded, "c", ("9.0", "99.0")) if v[3]] == [("2024-02-01", 15, 4, True)]
    star = star_of(spark, loaded)
    assert answers(star) == answers(replace(star, kept=None))
    tables.remove(spark, f"{loaded}/{COUNTS}")
    follow.follow_staging(spark, loaded, follow.days_to_follow(spark, loaded), places(spark, ("9.0", "99.0")), "d")
    star = star_of(spark, loaded)
    assert answers(star) == answers(replace(star, kept=None))


def test_the_pyramid_equals_the_clusters_of_each_zoom(spark):
    rows = spark.range(4000).selectExpr(
        "id", "cast(-11 + (id * 37) % 1700 / 100.0 AS double) AS lat", "cast(95 + (id * id) % 4600 / 100.0 AS double) AS lon"
    )
    odd = spark.createDataFrame([(1, None, 100.0), (2, 1.0, None), (3, 89.99, -180.0), (4, -89.99, 180.0), (5, 1.0, 400.0), (6, None, 100.0)],
                                "id long, lat double, lon double")
    rows = rows.union(odd)
    pyramid = dashboard.cluster_pyramid(rows)
    assert str(pyramid._jdf.queryExecution().executedPlan().toString()).count("Range (0, 4000") == 1
    got = pyramid.collect()
    for zoom in range(13):
        want = {(r.cell_x, r.cell_y): r for r in dashboard.cluster_points(rows, zoom).collect()}
        own = {(r.cell_x, r.cell_y): r for r in got if r.zoom == zoom}
        assert want.keys() == own.keys()
        for cell, r in want.items():
            assert (r.total, r.size_class) == (own[cell].total, own[cell].size_class)
            assert (r.lat, r.lon) == pytest.approx((own[cell].lat, own[cell].lon), nan_ok=True)
