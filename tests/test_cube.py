"""Cube, ranking and star properties."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from thermalcube.checks.views import feature_star, features
from thermalcube.operators import ranking
from thermalcube.plans import cube, dashboard, table_view
from thermalcube.plans.query import CubeQuery
from thermalcube.plans.star import Star

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


def small_features(spark, rows):
    return spark.createDataFrame(rows, "id int, tanggal date")


def test_children_add_up_to_their_parent(spark):
    star = feature_star(spark, SF)
    for parent in cube.count_by_level(star, "pulau").collect():
        children = cube.drill_down(star, {"pulau": parent.label}).agg(F.sum("total")).first()[0]
        assert children == parent.total
    rolled = cube.roll_up(star)
    by_depth = rolled.groupBy("grouping_level").agg(F.sum("total")).collect()
    assert len(by_depth) == 6 and len({r[1] for r in by_depth}) == 1


@pytest.mark.parametrize(
    "question",
    [
        lambda s: cube.count_by_level(s, "kota", {"confidence": "high", "tahun": 1997}),
        lambda s: cube.roll_up(s, {"satelite": "aqua"}),
        lambda s: cube.choropleth_counts(s, "provinsi"),
        lambda s: cube.time_members(s, "bulan", {"pulau": "ASIA", "tahun": "1996"}),
        lambda s: dashboard.kpis(s),
        lambda s: dashboard.kpis_on(s, "1997-05-28"),
        lambda s: dashboard.top_island(s),
        lambda s: dashboard.latest_detections(s, 5, "id", "detected_at", "kota"),
        lambda s: table_view.accumulate_star(s),
    ],
)
def test_both_plans_of_a_star_agree(spark, question):
    """A place table within the broadcast limit and one beyond it give the same rows."""
    star = feature_star(spark, SF)
    assert star.small_places
    assert rows_of(question(star)) == rows_of(question(Star(star.facts, star.places, False)))


def test_size_check_follows_the_threshold(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for limit, small in (("10MB", True), ("100", False), ("-1", False)):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            assert feature_star(spark, SF).small_places is small
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_unplaced_detections_count_in_the_kpis_only(spark):
    facts = spark.createDataFrame(
        [(1, 1, "high", 1), (2, 1, "low", 1), (3, 9, "high", 1), (4, 2, "low", 1)],
        "id int, place_key int, confidence string, detections bigint",
    )
    places = spark.createDataFrame([(1, "A", "a"), (2, "", "")], "place_key int, pulau string, provinsi string")
    for small in (True, False):
        star = Star(facts, places, small)
        assert tuple(dashboard.kpis(star).first()) == (4, 2, 1)
        assert rows_of(dashboard.top_island(star)) == [("A", 2)]
        assert rows_of(cube.count_by_level(star, "provinsi")) == [("", 1), ("a", 2)]


def test_accumulated_rows_take_one_shuffle(spark):
    star = feature_star(spark, SF)
    plan = table_view.accumulate_star(star)._jdf.queryExecution().executedPlan().toString()
    assert star.small_places and plan.count("Exchange hashpartitioning") == 1


def test_lookups_are_joined_only_where_used(spark):
    facts = spark.createDataFrame([(1, 1, "s1", 1)], "id int, place_key int, satellite_id string, detections bigint")
    places = spark.createDataFrame([(1, "A")], "place_key int, pulau string")
    satellites = spark.createDataFrame([("s1", "Aqua")], "satellite_id string, satelit string")
    star = Star(facts, places, True, (("satellite_id", satellites),))
    plain = cube.count_by_level(star, "pulau")
    diced = cube.count_by_level(star, "pulau", {"satelite": "AQUA"})
    assert "satelit" not in plain._jdf.queryExecution().optimizedPlan().toString()
    assert rows_of(plain) == rows_of(diced) == [("A", 1)]
    assert star.flat("id", "satelit").first() == (1, "Aqua")


@pytest.mark.parametrize(
    "values, breaks",
    [
        ([5], (5.0, 5.0, 6.0, 7.0)),
        ([1, 3], (1.0, 3.0, 2.0, 3.0)),
        ([1, 4], (1.0, 4.0, 2.0, 3.0)),
        ([0, 10, 40], (10.0, 40.0, 20.0, 30.0)),
        ([0], (0.0, 1.0, 1.0, 2.0)),
        ([], (0.0, 1.0, 1.0, 2.0)),
    ],
)
def test_threshold_breaks(spark, values, breaks):
    counts = spark.createDataFrame([(str(v), v) for v in values], "label string, total bigint")
    assert tuple(cube.threshold_breaks(counts).first()) == breaks


def test_classes_at_the_breaks(spark):
    counts = spark.createDataFrame([(str(v), v) for v in (10, 19, 20, 29, 30, 40)], "label string, total bigint")
    got = {r.total: (r.map_class, r.colour) for r in cube.classify_counts(counts).collect()}
    low, middle, high = ("rendah", "#FFCDD2"), ("sedang", "#EF5350"), ("tinggi", "#B71C1C")
    assert got == {10: low, 19: low, 20: middle, 29: middle, 30: high, 40: high}


def test_class_breaks_reuse_the_counting_shuffle(spark):
    df = cube.classify_counts(cube.count_by_level(feature_star(spark, SF), "kota"))
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_period_with_a_year_is_a_pushed_range(spark):
    df = features(spark, SF, "id", "tanggal").filter(CubeQuery(tahun=1996, kuartal="Q2").predicate())
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(o_orderdate,1996-04-01" in plan
    assert "LessThan(o_orderdate,1996-07-01" in plan


@pytest.mark.parametrize(
    "query",
    [
        dict(tahun="1997"), dict(tahun="1997", semester="2"), dict(tahun=1996, bulan="Februari"),
        dict(tahun=1996, bulan="Februari", minggu=5), dict(tahun=1997, bulan=2, minggu=5),
        dict(tahun=1997, kuartal="Q2", minggu="3"), dict(semester=1, kuartal=3), dict(bulan="June"),
        dict(tahun="x"), dict(kuartal="Q5"), dict(kuartal=2, hari="senin"), dict(minggu=9),
        dict(tahun=1997, semester=2, bulan="Juli", minggu=1, hari="Rabu"), dict(tahun=1997, minggu=6),
        dict(tahun=0), dict(tahun="20240", bulan=2),
    ],
)
def test_period_filters_by_brute_force(spark, query):
    days = [dt.date(1996, 1, 1) + dt.timedelta(days=i) for i in range(1000)]
    df = small_features(spark, list(enumerate(days)))
    names = ("januari februari maret april mei juni juli agustus september oktober november desember").split()
    week = "senin selasa rabu kamis jumat sabtu minggu".split()

    def keep(d):
        months = {"bulan": query.get("bulan")}
        month = months["bulan"]
        if month is not None and not str(month).isdigit():
            month = names.index(month.lower()) + 1 if month.lower() in names else None
        return all(
            [
                str(query.get("tahun", d.year)) == str(d.year),
                str(query.get("semester", -(-d.month // 6))) == str(-(-d.month // 6)),
                str(query.get("kuartal", -(-d.month // 3))).strip("Q") == str(-(-d.month // 3)),
                month is None or int(month) == d.month,
                str(query.get("minggu", -(-d.day // 7))) == str(-(-d.day // 7)),
                query.get("hari", week[d.weekday()]).lower() == week[d.weekday()],
            ]
        )

    got = {r.tanggal for r in df.filter(CubeQuery(**query).predicate()).collect()}
    assert got == {d for d in days if keep(d)}


def test_query_parameters():
    query = CubeQuery.from_params({"pulau": "Jawa", "kota": "", "tipe": "kota", "lat": 1, "selectedDate": "2024-01-01"})
    assert query == CubeQuery(pulau="Jawa", date="2024-01-01")
    both = {"tahun": "2024", "selectedDate": "2024-01-01"}
    assert CubeQuery.from_params({**both, "filterMode": "date"}) == CubeQuery(date="2024-01-01")
    assert CubeQuery.from_params({**both, "filterMode": "period"}) == CubeQuery(tahun="2024")
    for wrong in (both, {"planet": "Mars"}):
        with pytest.raises(ValueError):
            CubeQuery.from_params(wrong)


def test_order_of_time_members(spark):
    df = spark.createDataFrame([("Oktober",), ("Januari",), ("April",)], "value string")
    assert [r.value for r in ranking.time_member_order(df, "bulan").collect()] == ["Januari", "April", "Oktober"]
    df = spark.createDataFrame([("10",), ("9",)], "value string")
    assert [r.value for r in ranking.time_member_order(df, "minggu").collect()] == ["9", "10"]


def test_sort_orders(spark):
    df = spark.createDataFrame([(1, "b", 10), (2, "A", 9), (3, "a", 9), (4, None, 100)], "id int, kota string, jumlah bigint")
    ids = lambda column, order: [r.id for r in ranking.sort_table(df, column, order, ["id"]).collect()]
    assert ids("kota", "asc") == [2, 3, 1, 4]
    assert ids("jumlah", "desc") == [4, 1, 2, 3]


def test_far_pages_equal_near_pages(spark, monkeypatch):
    # Half of the rows share one sort value.
    df = spark.range(5000).selectExpr("id", "if(id % 2 = 0, 7, id % 100) AS jumlah")
    df = df.withColumn("jumlah", F.expr("if(id % 11 = 0, NULL, jumlah)")).withColumn("tie", F.expr("if(id % 5 = 0, NULL, id)"))
    monkeypatch.setattr(ranking, "SAMPLED_KEYS", 200)
    for order in ("asc", "desc"):
        for ties in (["id"], ["tie", "id"]):
            pages = (1, 80, 150, 167, 400)
            near = [ranking.page(df, "jumlah", order, ties, n, 30).collect() for n in pages]
            far = [ranking.page(df, "jumlah", order, ties, n, 30, top_rows=90).collect() for n in pages]
            assert near == far and len(near[3]) == 20 and near[4] == []


def test_newest_rows_put_missing_times_last(spark):
    df = spark.createDataFrame(
        [(1, None), (2, dt.datetime(2024, 1, 1)), (3, dt.datetime(2024, 1, 2)), (4, None)],
        "id int, detected_at timestamp",
    )
    assert [r.id for r in ranking.latest_n(df, 3).collect()] == [3, 2, 1]


def test_special_province_stays_on_the_map(spark):
    bounds = spark.createDataFrame(
        [("provinsi", "Jawa Barat", "Jawa"), ("provinsi", "Banten", "Jawa"), ("provinsi", "Aceh", "Sumatera"),
         ("provinsi", "Daerah Istimewa Yogyakarta", "Lainnya"), ("kota", "Bogor", "Jawa Barat")],
        "level string, name string, parent_name string",
    )
    counts = spark.createDataFrame([("JAWA BARAT", 4), ("ACEH", 2)], "region string, total bigint")
    shown = cube.attach_counts_to_boundaries(bounds, counts, "provinsi", "JAWA")
    assert {(r.name, r.total) for r in shown.collect()} == {("Jawa Barat", 4), ("Daerah Istimewa Yogyakarta", 0)}
    everywhere = cube.attach_counts_to_boundaries(bounds, counts, "provinsi")
    assert {r.name for r in everywhere.collect()} == {"Jawa Barat", "Aceh", "Daerah Istimewa Yogyakarta"}
    elsewhere = cube.attach_counts_to_boundaries(bounds, counts, "provinsi", "Sumatera")
    assert {r.name for r in elsewhere.collect()} == {"Aceh"}
