"""Staging, dimensions, facts, stored tables and the stream."""

import datetime as dt
import pathlib

import pytest
from pyspark.sql import Row, functions as F

from thermalcube.operators import dedup, filters, lookups, ranking, shaping
from thermalcube.plans import backfill, daily, dims, facts, quality, questions, staging
from thermalcube.plans.star import warehouse_star
from thermalcube.schemas import DETECTION_KEYS, DIM_LOCATION_COLUMNS, WAREHOUSE_TABLES
from thermalcube.sources import detections as feeds, tables
from thermalcube.sources.responses import parse_locations
from thermalcube.streaming.ingest import incremental_ingest, ingest_into_warehouse, staged_rows

DDL = (
    "batch_id string, ingested_at timestamp, latitude string, longitude string, acq_date date, "
    "acq_time string, satellite string, instrument string, confidence string, version string, frp double"
)


def detection(batch="b1", minute=0, lat="1.0", lon="100.0", date="2024-01-05", time="930",
              satellite="Aqua", instrument="MODIS", confidence="85", version="v1", frp=1.0):
    at = dt.datetime(2024, 2, 1, 0, minute)
    return (batch, at, lat, lon, dt.date.fromisoformat(date), time, satellite, instrument, confidence, version, frp)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), DDL)


def places(spark, *coordinates):
    return spark.createDataFrame(
        [(f"L{i}", a, o) for i, (a, o) in enumerate(coordinates)], "id string, latitude string, longitude string"
    )


def test_rows_are_reduced_before_the_shuffle(spark):
    """A hot key must not be gathered in one task: the group limit runs on both sides."""
    df = dedup.latest_by_key(frame(spark, detection()), DETECTION_KEYS, [F.col("frp")])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_first_per_key_treats_nulls_and_signed_zeros_as_equal(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, n int")
    assert sorted(r.n for r in dedup.first_per_key(df, ["k"], [F.col("n")]).collect()) == [1, 3]
    df = spark.createDataFrame([(0.0, 1), (-0.0, 2)], "k double, n int")
    assert [r.n for r in dedup.first_per_key(df, ["k"], [F.col("n").desc()]).collect()] == [2]


def test_hot_key_join_is_split(spark):
    """One coordinate holds most rows; the join splits it once it passes the thresholds."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        rows = spark.range(0, 40000, 1, 8).selectExpr(
            "id", "if(id % 10 < 9, '0', cast(id % 50 AS string)) AS latitude", "'1' AS longitude"
        )
        stored = spark.range(50).selectExpr("concat('L', id) AS id", "cast(id AS string) AS latitude", "'1' AS longitude")
        joined = lookups.attach_location(rows, lookups.location_mapping(stored))
        df = joined.select("id", "location_id")
        got = df.collect()
        assert len(got) == 40000 and sum(r.location_id == "L0" for r in got) == 36000
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_first_source_wins(spark):
    late, early = frame(spark, detection(frp=1.0)), frame(spark, detection(frp=2.0))
    both = staging.detections_of_day({"VIIRS_SNPP_NRT": late, "MODIS_NRT": early}, "2024-01-05", ["frp"])
    assert [(r.source_api, r.frp) for r in both.collect()] == [("MODIS_NRT", "2.0")]


def test_dedup_needs_four_keys(spark):
    df = spark.createDataFrame([("1", "2", "x"), ("1", "2", "y")], "latitude string, longitude string, note string")
    assert dedup.dedup_detections(df, [F.col("note")]).count() == 2
    assert dedup.dedup_weather(df, [F.col("note")]).count() == 1


def test_extract_day_rejects_and_stages(spark):
    feed = frame(
        spark, detection(), detection(lat="9.9"), detection(date="2024-01-06"), detection(time="931")
    ).drop("batch_id", "ingested_at")
    weather = spark.createDataFrame(
        [("1.0", "100.0", "2024-01-05 09:30:00", 70000.0), ("1.0", "100.0", "2024-01-05 09:30:00", 80000.0),
         ("9.9", "100.0", "2024-01-05 09:30:00", 1.0)],
        "latitude string, longitude string, datetime string, pressure double",
    )
    out = staging.extract_day(
        {"MODIS_NRT": feed}, places(spark, ("1.0", "100.0")), "2024-01-05", "b9", "2024-02-01 10:00:00.123456",
        ["frp"], weather, ["datetime"],
    )
    staged = out["staging_detection"].collect()
    assert sorted(r.acq_time for r in staged) == ["930", "931"]
    assert {(r.batch_id, r.ingested_at.microsecond, r.brightness) for r in staged} == {("b9", 123000, None)}
    # Out of the stored range.
    assert [r.pressure for r in out["staging_weather"].collect()] == [None]


def test_malformed_dates_do_not_stop_a_load(spark):
    df = spark.createDataFrame([("2024-01-05",), ("nonsense",)], "acq_date string")
    assert filters.for_date(df, "2024-01-05").count() == 1
    assert dims.dim_period(df).count() == 1


def test_facts_and_rejects_make_up_the_input(spark):
    staged = frame(spark, detection(), detection(lat="5.5"), detection(lat="6.6"), detection(time="5"))
    rows, watch = facts.fact_detection(staged, places(spark, ("1.0", "100.0"), ("1.0", "100.0")))
    kept = rows.collect()
    assert watch.get == {"original": 4, "kept": 2, "rejected": 2}
    assert len(kept) == 2 and len({r.id for r in kept}) == 2
    assert {r.location_id for r in kept} == {"L0"}
    metrics = lookups.reject_metrics(staged, places(spark, ("1.0", "100.0"))).first()
    assert tuple(metrics) == (4, 2, 2)


def test_facts_point_to_dimension_rows(spark):
    staged = frame(
        spark, detection(), detection(time="1000", confidence="bad"), detection(satellite="N", instrument="VIIRS", confidence="h")
    )
    stored = {
        "dim_period": spark.createDataFrame([("P-old", dt.date(2024, 1, 5))], "id string, date_value date"),
        "dim_confidence": spark.createDataFrame([("C-old", "85", "MODIS")], "id string, confidence_raw string, source_instrument string"),
    }
    built = facts.transform_batch(staged, None, places(spark, ("1.0", "100.0")), stored=stored)
    fact = built["fact_detection"]
    for key, name in (("period_id", "dim_period"), ("satellite_id", "dim_satellite"), ("confidence_id", "dim_confidence")):
        known = built[name].select(F.col("id").alias(key))
        assert fact.join(known, key, "left_anti").count() == 0
    assert {r.period_id for r in fact.collect()} == {"P-old"}
    assert "C-old" in {r.confidence_id for r in fact.collect()}


def test_newest_batch(spark):
    df = frame(spark, detection("b1", 5), detection("b2", 9), detection("b2", 1), detection("b3", 7))
    assert {r.batch_id for r in filters.latest_batch(df).collect()} == {"b2"}


def test_weather_dates_have_a_period(spark):
    hot = spark.createDataFrame([("2024-01-05",)], "d string")
    wet = spark.createDataFrame([("2024-01-06 10:00:00",), (None,)], "d string")
    assert sorted(str(r.date_value) for r in dims.dim_period(hot, wet).collect()) == ["2024-01-05", "2024-01-06"]


def test_places_that_are_refused(spark):
    rows = [("a", "x", "y"), ("b", None, "y"), ("c", "x", ""), ("d", "x", None), ("e", "x", "Area Tidak Terdefinisi")]
    df = spark.createDataFrame(rows, "id string, district_name string, subdistrict_name string")
    assert [r.id for r in filters.valid_location(df).collect()] == ["a"]


def test_cache_entries_expire(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    cache = spark.createDataFrame(
        [("a", dt.datetime(2024, 1, 1, 1)), ("a", dt.datetime(2024, 1, 2, 1)), ("b", dt.datetime(2024, 1, 1, 0))],
        "k string, cached_at timestamp",
    )
    split = lookups.cache_split(keys, cache, ["k"], lookups.weather_ttl(24), "2024-01-02 00:00:00")
    assert {r.k: r.is_hit for r in split.collect()} == {"a": True, "b": False, "c": False}
    assert lookups.location_ttl(6) == 518400 and lookups.weather_ttl(24) == 86400


def test_stored_days_are_replaced_once(spark, tmp_path):
    path = str(tmp_path / "facts")
    first = frame(spark, detection(), detection(date="2024-01-06"), detection(date="2024-01-07"))
    second = frame(spark, detection(date="2024-01-06", frp=5.0), detection(date="2024-01-06", frp=6.0))
    tables.replace_days(first, path, "acq_date", ["latitude"])
    for _ in range(2):
        tables.replace_days(second, path, "acq_date", ["latitude"])
        got = spark.read.parquet(path).groupBy("acq_date").count().collect()
        assert {str(r.acq_date): r["count"] for r in got} == {"2024-01-05": 1, "2024-01-06": 2, "2024-01-07": 1}
    kept = tables.replace_days_frame(first, second, "acq_date")
    assert kept.count() == 4


def test_compaction_rewrites_touched_days_only(spark, tmp_path):
    path = tmp_path / "staging"
    tables.append_and_compact(
        spark, frame(spark, detection(), detection(date="2024-01-06")), str(path), "acq_date", DETECTION_KEYS
    )
    other = path / "ym=202401" / "staged_day=2024-01-06"
    untouched = {f.name for f in other.iterdir()}
    again = frame(spark, detection(minute=9, frp=7.0), detection(minute=1, time="1100"))
    count = tables.append_and_compact(spark, again, str(path), "acq_date", DETECTION_KEYS)
    assert count.first()[0] == 3
    assert {f.name for f in other.iterdir()} == untouched
    stored = spark.read.parquet(str(path)).filter("staged_day = '2024-01-05' AND acq_time = '930'").collect()
    assert [r.frp for r in stored] == [7.0]


def test_undated_rows_stay_in_staging(spark, tmp_path):
    path = str(tmp_path / "staging")
    for minute, time in ((0, "1"), (1, "2"), (2, "2")):
        undated = frame(spark, detection(minute=minute, time=time)).withColumn("acq_date", F.lit(None).cast("date"))
        both = undated.unionByName(frame(spark, detection(minute=minute)))
        count = tables.append_and_compact(spark, both, path, "acq_date", DETECTION_KEYS)
    assert count.first()[0] == 3


def test_a_hot_month_is_written_by_several_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64KB")
    try:
        rows = spark.range(0, 60000, 1, 8).selectExpr(
            "id", "sha2(cast(id AS string), 256) AS text", "date_add(DATE'2024-01-01', cast(id % 31 AS int)) AS acq_date"
        )
        tables.write_partitioned(rows, str(tmp_path / "months"), "acq_date", ["id"])
        assert len(list((tmp_path / "months" / "ym=202401").glob("*.parquet"))) > 3
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_dimensions_are_loaded_once(spark, tmp_path):
    root = str(tmp_path)
    staged = frame(spark, detection(), detection(confidence=None), detection(satellite=None))
    batch = {"dim_satellite": dims.dim_satellite(staged), "dim_confidence": dims.dim_confidence(staged)}
    for _ in range(2):
        tables.insert_new_dims(spark, batch, root)
    assert spark.read.parquet(f"{root}/dim_confidence").count() == 2
    # Rows without an id are refused on the first load as on later ones.
    stored = spark.read.parquet(f"{root}/dim_satellite").collect()
    assert [r.id for r in stored] == ["Aqua_MODIS"]


def test_loads_without_areas_leave_no_area_table(spark):
    """Areas are a dimension that a load of the other five does not bring; its folder is never made."""
    from thermalcube.checks.warehouse import insert_new_dims

    rows = insert_new_dims(spark, "/root/testdata/sf0.001").collect()
    assert {r.table_name for r in rows} == {n for n, _ in tables.DIMENSION_ORDER} - {"dim_area"}
    assert len(rows) == len(set(rows))


def test_an_answer_is_parsed_once(spark):
    """Not once more for each field that the rule of accepted places looks at."""
    answers = spark.createDataFrame(
        [("1.0", "100.0", '{"kecamatan": "K", "desa": "D", "adm4": "S2"}'), ("1.0", "100.0", '{"kecamatan": "K", "desa": "E", "adm4": "S1"}'),
         ("2.0", "100.0", '{"desa": "D"}'), ("3.0", "100.0", None)], "latitude string, longitude string, response string"
    )
    found = dims.dim_location(parse_locations(answers))
    assert [(r.latitude, r.subdistrict_name, r.province_name) for r in found.collect()] == [("1.0", "E", "")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1


def test_staging_holds_defaults_for_nulls(spark, tmp_path):
    root = str(tmp_path)
    feed = frame(spark, detection(confidence=None)).drop("batch_id", "ingested_at")
    weather = spark.createDataFrame([("1.0", "100.0", "2024-01-05 09:30:00", 70000.0, None)],
                                    "latitude string, longitude string, datetime string, pressure double, conditions string")
    staged = staging.extract_day(
        {"MODIS_NRT": feed}, places(spark, ("1.0", "100.0")), "2024-01-05", "b9", "2024-02-01 10:00:00", ["frp"], weather
    )
    daily.load_staging(spark, root, staged)
    hot = spark.read.parquet(f"{root}/staging_detection").first()
    assert (hot.confidence, hot.brightness, hot.scan) == ("", 0.0, 0.0)
    wet = spark.read.parquet(f"{root}/staging_weather").first()
    assert (wet.pressure, wet.conditions) == (0, "")


def test_kept_weather_does_not_depend_on_task_order(spark):
    rows = [("1.0", "100.0", "2024-01-05 09:30:00", float(i), f"c{i % 7}") for i in range(40)]
    frame_ = spark.createDataFrame(rows, "latitude string, longitude string, datetime string, pressure double, conditions string")
    kept = {
        tuple(staging.stage_weather(frame_.repartition(n), "b", "2024-02-01 10:00:00", []).drop("ingested_at").first())
        for n in (1, 3, 8)
    }
    assert len(kept) == 1


def test_fact_days_are_pruned_and_right_sides_distinct(spark, tmp_path):
    path = str(tmp_path / "facts")
    rows = [("a", "p1", dt.date(2024, 1, 5)), ("b", "p2", dt.date(2024, 1, 6))]
    tables.replace_days(spark.createDataFrame(rows, "id string, period_id string, date_value date"), path, "date_value", ["id"])
    periods = spark.createDataFrame([("p1", rows[0][2]), ("p2", rows[1][2])], "id string, date_value date")
    found = lookups.facts_for_date(spark.read.parquet(path), periods, "2024-01-05")
    assert [r.id for r in found.collect()] == ["a"]
    assert "PartitionFilters: [isnotnull(date_value" in found._jdf.queryExecution().executedPlan().toString()
    hot = spark.createDataFrame([("1.0", "100.0")] * 90 + [(str(i), "1") for i in range(10)], "latitude string, longitude string")
    for df in (lookups.location_mapping(places(spark, ("1.0", "100.0")), hot), lookups.new_rows(hot, hot, ["latitude", "longitude"])):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate [latitude" in plan.split("Join Left", 1)[1]


def test_backfill_equals_its_days_one_by_one(spark, tmp_path):
    feed = frame(
        spark, detection(), detection(time="1000"), detection(date="2024-01-06"), detection(date="2024-03-01"), detection(lat="5.9")
    ).drop("batch_id", "ingested_at")
    known, answers = places(spark, ("1.0", "100.0")), spark.createDataFrame([], "latitude string, longitude string, response string")
    requests = spark.createDataFrame([(2024, 1, 2)], "year int, start_month int, end_month int")
    roots = [str(tmp_path / n) for n in ("whole", "days")]
    verdict = backfill.load_backfill(spark, roots[0], requests, {"MODIS_NRT": feed}, known, "b", "2024-02-01 00:00:00", ["frp"])
    assert verdict.first().valid
    tables.append_table(known.withColumns({c: F.lit("") for c in DIM_LOCATION_COLUMNS if c not in known.columns}), f"{roots[1]}/dim_location", DIM_LOCATION_COLUMNS)
    for n, day in enumerate(("2024-01-05", "2024-01-06")):
        daily.load_day(spark, roots[1], {"MODIS_NRT": feed}, answers, day, f"b{n}", "2024-02-01 00:00:00", ["frp"])
    loaded = [sorted(map(str, spark.read.parquet(f"{r}/fact_detection").collect())) for r in roots]
    assert loaded[0] == loaded[1] and len(loaded[0]) == 3
    bad = feed.withColumn("latitude", F.lit("NaN"))
    refused = backfill.load_backfill(spark, str(tmp_path / "bad"), requests, {"MODIS_NRT": bad}, known, "b", "2024-02-01 00:00:00", ["frp"])
    assert not refused.first().valid and not (tmp_path / "bad").exists()


def test_pages_count_from_one(spark):
    with pytest.raises(ValueError):
        ranking.page(spark.range(5), "id", "asc", [], 0)


def test_defaults_replace_nulls(spark):
    df = spark.createDataFrame([(None, None, 1)], "brightness float, icon string, n int")
    assert shaping.apply_defaults(df).first() == Row(brightness=0.0, icon="", n=1)


HEADER = "latitude,longitude,acq_date,acq_time,confidence"


@pytest.mark.parametrize(
    "name, content, rows",
    [
        ("good", f"{HEADER}\n1.5,100.25,2024-01-05,930,85\n-2,101,2024-01-05,5,\n", 2),
        ("quoted", '"latitude","longitude","acq_date","acq_time","version"\n"1.50","1","2024-01-05","5","a,b"\n', 1),
        ("error", "Invalid MAP_KEY.\n", 0),
        ("error_inside", f"{HEADER}\n1,2,2024-01-05,5,Error\n3,4,2024-01-05,5,h\n", 0),
        ("header_only", f"{HEADER}\n", 0),
        ("missing_column", "latitude,longitude,acq_date\n1,2,2024-01-05\n", 0),
        ("empty", "", 0),
    ],
)
def test_landed_files(spark, tmp_path, name, content, rows):
    (tmp_path / f"{name}.csv").write_text(content)
    got = feeds.read_detections(spark, str(tmp_path)).collect()
    assert len(got) == rows
    if name == "good":
        assert {(r.latitude, r.acq_time, r.confidence, r.frp) for r in got} == {("1.5", "930", "85", None), ("-2", "5", None, None)}
    if name == "quoted":
        assert (got[0].latitude, got[0].version) == ("1.50", "a,b")


def test_files_of_different_layout_together(spark, tmp_path):
    (tmp_path / "a.csv").write_text(f"{HEADER}\n1,2,2024-01-05,5,h\n")
    (tmp_path / "b.csv").write_text("frp,acq_time,acq_date,longitude,latitude\n9.5,7,2024-01-06,4,3\n")
    (tmp_path / "c.csv").write_text("Error: quota\n")
    got = {(r.latitude, r.longitude, r.acq_time, r.frp) for r in feeds.read_detections(spark, str(tmp_path)).collect()}
    assert got == {("1", "2", "5", None), ("3", "4", "7", "9.5")}


def test_stream_takes_new_files_and_resolves_late_rows(spark, tmp_path):
    landed, table, state = (str(tmp_path / n) for n in ("landed", "table", "state"))
    stream = lambda: spark.readStream.schema(DDL).parquet(landed)
    seen = []
    frame(spark, detection(minute=5, frp=1.0), detection(time="1000")).write.parquet(landed)
    incremental_ingest(stream(), table, state, after_batch=lambda rows, n: seen.append((n, rows.count())))
    # The same key again, later and earlier, and one new key.
    frame(
        spark, detection(minute=9, frp=2.0), detection(minute=1, frp=3.0), detection(time="1100")
    ).write.mode("append").parquet(landed)
    for _ in range(2):
        incremental_ingest(stream(), table, state, after_batch=lambda rows, n: seen.append((n, rows.count())))
    got = staged_rows(spark, table).collect()
    assert sorted((r.acq_time, r.frp) for r in got) == [("1000", 1.0), ("1100", 1.0), ("930", 2.0)]
    assert seen == [(0, 2), (1, 3)]


def test_stream_in_parts_keeps_whole_days(spark, tmp_path):
    """A later part of a day must not push out the facts of an earlier part."""
    landed, root, state = (str(tmp_path / n) for n in ("landed", "warehouse", "state"))

    def run():
        ingest_into_warehouse(
            spark.readStream.schema(DDL).parquet(landed), root, state,
            places(spark, ("1.0", "100.0")), lambda batch, number: batch,
        )
        facts_now = spark.read.parquet(f"{root}/fact_detection")
        assert facts_now.select("id").distinct().count() == facts_now.count()
        return facts_now.count()

    frame(spark, detection(), detection(date="2024-01-06"), detection(lat="7.7")).write.parquet(landed)
    assert run() == 2
    frame(spark, detection(time="1000"), detection(minute=3)).write.mode("append").parquet(landed)
    assert run() == 3
    assert run() == 3


def test_loaded_warehouse_answers_questions(spark, tmp_path):
    root = str(tmp_path)
    answers = spark.createDataFrame(
        [("1.0", "100.0", '{"adm4": "1", "provinsi": "Riau", "kotkab": "Siak", "kecamatan": "Tualang", "desa": "Perawang"}'),
         ("2.0", "100.0", '{"adm4": "2", "provinsi": "Riau", "kecamatan": null, "desa": "Laut"}'),
         ("3.0", "101.0", '{"adm4": "3", "provinsi": "Aceh", "kotkab": "Pidie", "kecamatan": "Sigli", "desa": "Blok"}')],
        "latitude string, longitude string, response string",
    )
    feed = frame(
        spark, detection(), detection(time="1000", confidence="10"), detection(lat="2.0"),
        detection(lat="3.0", lon="101.0", date="2024-01-06", satellite="N", instrument="VIIRS", confidence="h"),
    ).drop("batch_id", "ingested_at")
    for number, day in enumerate(("2024-01-05", "2024-01-06", "2024-01-05")):
        verdict = daily.load_day(
            spark, root, {"MODIS_NRT": feed}, answers, day, f"b{number}", f"2024-02-01 00:0{number}:00", ["frp"]
        )
    # No weather was loaded: six of the nine tables exist, all with rows.
    assert tuple(verdict.first()) == (6, 9, 66.7, "PARTIAL")
    islands = spark.createDataFrame([("Riau", "Sumatera"), ("Aceh", "Sumatera")], "province_name string, pulau string")
    star = warehouse_star(tables.stored_tables(spark, root, *WAREHOUSE_TABLES), islands)

    def ask(dimension, **params):
        return {tuple(r) for r in questions.ask(star, dimension, params).collect()}

    assert ask("location") == {("Sumatera", 3)}
    assert ask("location", tipe="provinsi", pulau="Sumatera") == {("Riau", 2), ("Aceh", 1)}
    assert ask("location", tipe="kota", confidence="high", tahun="2024", bulan="Januari") == {("Siak", 1), ("Pidie", 1)}
    assert ask("confidence") == {("high", 2), ("low", 1)}
    assert ask("satelite", provinsi="Riau") == {("Aqua", 2)}
    assert ask("time", tahun="2024", semester="1", kuartal="Q1") == {("Januari", 1)}
    rows = questions.detections(star, {"selectedDate": "2024-01-06"})
    assert [(r.provinsi, r.satelit, r.confidence, r.lat) for r in rows.collect()] == [("Aceh", "N", "high", 3.0)]
    dated = questions.ask(star, "location", {"tahun": "2024", "bulan": "Januari", "minggu": "1"})
    plan = dated._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date_value" in plan
    with pytest.raises(ValueError):
        questions.ask(star, "weather")


def test_batch_status_and_scorecard(spark):
    one, none = frame(spark, detection()), frame(spark, detection()).limit(0)
    status = quality.batch_status({"staging_detection": one, "staging_weather": none}, "b1").first()
    assert tuple(status) == ("b1", 1, 0, 1)
    for full, verdict in ((9, "SUCCESS"), (8, "SUCCESS"), (7, "PARTIAL"), (5, "PARTIAL"), (4, "FAILED")):
        card = quality.quality_scorecard({str(i): one if i < full else none for i in range(9)})
        assert (card.first().checks_passed, card.first().status) == (full, verdict)


@pytest.mark.parametrize(
    "rows, valid, low",
    [
        ([(0.0, 100.0)] * 20, True, True),
        ([(0.0, 100.0)] * 18 + [(50.0, 100.0)] * 2, True, True),
        ([(0.0, 100.0)] * 17 + [(50.0, 100.0)] * 3, False, True),
        ([(None, 100.0)] + [(0.0, 100.0)] * 600, False, True),
        ([(float("nan"), 100.0)] + [(0.0, 100.0)] * 600, False, True),
    ],
)
def test_backfill_validation(spark, rows, valid, low):
    df = spark.createDataFrame(rows, "lat double, lon double")
    got = quality.validate_backfill(df, 2020).first()
    assert (got.valid, got.low_count) == (valid, low)
    assert quality.validate_backfill(df, 2015).first().low_count is (len(rows) < 500)


def test_no_machine_folder_on_a_cluster(spark):
    from thermalcube.session import scratch_path, shared_folder

    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first != second and first.startswith(shared_folder(spark))


def test_sources_name_nothing_local():
    root = pathlib.Path(__file__).resolve().parent.parent / "thermalcube"
    text = "\n".join(p.read_text() for p in root.rglob("*.py"))
    assert "localCheckpoint" not in text and "crossJoin" not in text


def test_counted_staging_is_stored_once(spark, monkeypatch):
    """Staging goes straight into the warehouse whose footers are counted, in month folders."""
    from thermalcube.checks import warehouse

    stored = []
    write = tables.write_partitioned

    def watched(df, path, *rest):
        stored.append(path)
        write(df, path, *rest)

    monkeypatch.setattr(tables, "write_partitioned", watched)
    counts = {r["table_name"]: r["row_count"] for r in warehouse.counts_from_footers(spark, "/root/testdata/sf0.001").collect()}
    assert sorted(p.rsplit("/", 1)[1] for p in stored) == ["staging_detection", "staging_weather"]
    for path in stored:
        kept = spark.read.parquet(path)
        assert tables.MONTH in kept.columns and kept.count() == counts[path.rsplit("/", 1)[1]] > 0


def test_only_kept_weather_answers_are_parsed(spark):
    """The newest answer of a key is chosen before the texts are parsed, and is what parsing all of them gives."""
    from thermalcube.checks import warehouse
    from thermalcube.checks.staging import weather
    from thermalcube.operators import dedup, shaping
    from thermalcube.schemas import WEATHER_KEYS

    sf = "/root/testdata/sf0.001"
    got = warehouse.staged_weather(spark, sf)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 and plan.index("from_json") < plan.index("Window [")
    want = shaping.narrow_weather_types(dedup.latest_by_key(weather(spark, sf), WEATHER_KEYS, [F.col("event_id")]))
    assert got.schema == want.schema and got.count() == want.count() and got.exceptAll(want).isEmpty()
