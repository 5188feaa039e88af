"""Cube, dashboard and table queries over feature rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from thermalcube.checks.registry import query
from thermalcube.checks.views import feature_star, features, place_list
from thermalcube.operators import filters, lookups, ranking
from thermalcube.operators.dedup import distinct_satellites
from thermalcube.operators.shaping import nested_path, union_vertical
from thermalcube.plans import cube, dashboard, name_index, quality, questions, table_view
from thermalcube.plans.query import dice as dice_rows, filter_period as period_rows, predicate_from_params as predicate
from thermalcube.schemas import TIME_LEVELS
from thermalcube.session import scratch_path
from thermalcube.sources.geojson import nest_features

# ---------------------------------------------------------------- filters


@query("SELECT id, confidence FROM feat WHERE lower(confidence) = 'high'")
def slice_confidence(spark, sf):
    return filters.slice_by(features(spark, sf, "id", "confidence"), confidence="HIGH")


@query("SELECT id, satelit FROM feat WHERE lower(satelit) = 'aqua'")
def slice_satellite(spark, sf):
    return filters.slice_by(features(spark, sf, "id", "satelit"), satelite="aqua")


@query(
    """SELECT id, tanggal, satelit, confidence, pulau FROM feat
WHERE pulau = 'ASIA' AND lower(confidence) = 'high' AND lower(satelit) = 'terra'
  AND year(tanggal) = 1996 AND quarter(tanggal) = 2"""
)
def dice(spark, sf):
    rows = features(spark, sf, "id", "tanggal", "satelit", "confidence", "pulau")
    return dice_rows(rows, pulau="ASIA", confidence="high", satelite="Terra", tahun="1996", kuartal="Q2")


@query("SELECT id, tanggal FROM feat WHERE tanggal = date '1997-05-28'")
def filter_date(spark, sf):
    return filters.filter_date(features(spark, sf, "id", "tanggal"), "1997-05-28")


@query(
    """SELECT id, tanggal FROM feat WHERE year(tanggal) = 1998 AND month(tanggal) > 6
  AND month(tanggal) = 8 AND ceil(day(tanggal) / 7.0) = 2"""
)
def filter_period(spark, sf):
    rows = features(spark, sf, "id", "tanggal")
    return period_rows(rows, tahun="1998", semester="2", bulan="Agustus", minggu="2")


@query(
    """SELECT id, tanggal FROM feat WHERE quarter(tanggal) = 3 AND ceil(day(tanggal) / 7.0) = 5"""
)
def filter_period_without_year(spark, sf):
    return period_rows(features(spark, sf, "id", "tanggal"), kuartal=3, minggu=5)


@query("SELECT id, provinsi, kota FROM feat WHERE provinsi = 'NATION_3'")
def within_parent(spark, sf):
    return filters.within_parent(features(spark, sf, "id", "provinsi", "kota"), "kota", "NATION_3")


@query(
    """SELECT id, tanggal, satelit, provinsi FROM feat WHERE provinsi = 'NATION_7'
  AND lower(satelit) = 'snpp' AND month(tanggal) <= 6 AND dayname(tanggal) = 'Sunday'"""
)
def predicate_from_params(spark, sf):
    params = {
        "provinsi": "NATION_7", "kota": "", "desa": None, "satelite": "snpp", "semester": "1",
        "hari": "Minggu", "lat": -2.5, "lng": 118, "dimension": "location", "tipe": "kota",
    }
    return features(spark, sf, "id", "tanggal", "satelit", "provinsi", "kota", "desa").filter(
        predicate(params)
    ).select("id", "tanggal", "satelit", "provinsi")


@query(
    """SELECT id, kota, desa FROM feat WHERE contains(lower(desa), 'machinery')
  OR contains(lower(kecamatan), 'machinery') OR contains(lower(kota), 'machinery')
  OR contains(lower(provinsi), 'machinery') OR contains(lower(pulau), 'machinery')"""
)
def search_location(spark, sf):
    rows = features(spark, sf, "id", "pulau", "provinsi", "kota", "kecamatan", "desa")
    return filters.search_location(rows, "Machinery").select("id", "kota", "desa")


@query("SELECT id, tanggal FROM feat WHERE tanggal IN (date '1996-02-29', date '1999-12-31')")
def in_dates(spark, sf):
    return filters.in_dates(features(spark, sf, "id", "tanggal"), ["1996-02-29", "1999-12-31"])


@query(
    "SELECT id, confidence, satelit FROM feat WHERE confidence IN ('high', 'medium') AND satelit IN ('Aqua')"
)
def in_values(spark, sf):
    rows = features(spark, sf, "id", "confidence", "satelit")
    return filters.in_values(rows, ["high", "medium"], ["Aqua"])


@query("SELECT id, lat, lon FROM feat WHERE tanggal = date '1998-10-03' AND id % 5 <> 0")
def points_on_date(spark, sf):
    rows = features(spark, sf, "id", "tanggal", "lat", "lon")
    pair = F.when(F.col("id") % 5 != 0, F.array("lon", "lat")).otherwise(F.array("lon"))
    return filters.points_on_date(rows.withColumn("coordinates", pair), "1998-10-03").select(
        "id", "lat", "lon"
    )


@query("SELECT id, tanggal FROM feat WHERE tanggal = date '2000-01-15'")
def on_day(spark, sf):
    return filters.on_day(features(spark, sf, "id", "tanggal"), "2000-01-15")


@query(
    "SELECT count(*) AS total FROM feat WHERE tanggal BETWEEN date '1996-01-01' AND date '1999-06-30'"
)
def between_dates(spark, sf):
    return dashboard.recent_total(features(spark, sf, "tanggal"), "1999-06-30", "1996-01-01")


@query("SELECT id, lat, lon FROM feat WHERE lon BETWEEN 95 AND 141 AND lat BETWEEN -11 AND 6")
def in_bbox(spark, sf):
    return filters.in_bbox(features(spark, sf, "id", "lat", "lon"))


@query("SELECT cast(id AS varchar) AS id, satelit AS satellite, provinsi FROM feat")
def nested_fields(spark, sf):
    rows = features(spark, sf).withColumn("minggu", F.lit(""))
    nested = nest_features(rows)
    return nested.select(
        nested_path("properties.id").alias("id"),
        nested_path("properties.satellite").alias("satellite"),
        nested_path("properties.location.provinsi").alias("provinsi"),
    )


# ---------------------------------------------------------------- cube


@query("SELECT pulau AS label, cast(sum(detections) AS bigint) AS total FROM feat GROUP BY pulau")
def count_by_level(spark, sf):
    return cube.count_by_level(feature_star(spark, sf), "pulau")


@query(
    """SELECT kecamatan AS label, cast(sum(detections) AS bigint) AS total FROM feat
WHERE confidence = 'high' AND year(tanggal) = 1997 GROUP BY kecamatan"""
)
def count_by_level_diced(spark, sf):
    params = {"confidence": "High", "tahun": "1997", "filterMode": "period"}
    return cube.count_by_level(feature_star(spark, sf), "kecamatan", params)


@query(
    """SELECT kota AS label, cast(sum(detections) AS bigint) AS total FROM feat
WHERE pulau = 'EUROPE' AND provinsi = 'NATION_3' AND lower(satelit) = 'aqua' GROUP BY kota"""
)
def drill_down(spark, sf):
    return cube.drill_down(
        feature_star(spark, sf), {"pulau": "EUROPE", "provinsi": "NATION_3"}, {"satelite": "AQUA"}
    )


@query(
    """SELECT pulau, provinsi, kota, kecamatan, desa, cast(sum(detections) AS bigint) AS total,
  cast(grouping_id(pulau, provinsi, kota, kecamatan, desa) AS integer) AS grouping_level
FROM feat GROUP BY ROLLUP (pulau, provinsi, kota, kecamatan, desa)"""
)
def roll_up(spark, sf):
    return cube.roll_up(feature_star(spark, sf))


@query(
    """SELECT provinsi AS label, cast(sum(detections) AS bigint) AS total FROM feat
WHERE pulau = 'EUROPE' GROUP BY provinsi"""
)
def roll_up_one_step(spark, sf):
    return cube.parent_result(feature_star(spark, sf), {"pulau": "EUROPE", "provinsi": "NATION_3"})


@query(
    "SELECT confidence AS label, cast(sum(detections) AS bigint) AS total FROM feat GROUP BY confidence"
)
def count_by_confidence(spark, sf):
    return cube.count_by_confidence(features(spark, sf, "confidence", "detections"))


@query("SELECT satelit AS label, cast(sum(detections) AS bigint) AS total FROM feat GROUP BY satelit")
def count_by_satellite(spark, sf):
    return cube.count_by_satellite(features(spark, sf, "satelit", "detections"))


@query(
    """SELECT DISTINCT monthname(tanggal) AS month_en,
  cast(month(tanggal) AS integer) AS ordinal FROM feat
WHERE pulau = 'AFRICA' AND year(tanggal) = 2001 AND month(tanggal) <= 6"""
)
def time_members(spark, sf):
    star = feature_star(spark, sf)
    months = cube.time_members(star, "bulan", {"pulau": "AFRICA", "tahun": "2001", "semester": "1"})
    first_day = F.make_date(F.lit(2001), F.col("ordinal"), F.lit(1))
    return months.select(F.date_format(first_day, "MMMM").alias("month_en"), "ordinal")


@query(
    """SELECT 'tahun' AS level, cast(year(tanggal) AS varchar) AS value, cast(year(tanggal) AS integer) AS ordinal FROM feat
UNION SELECT 'semester', CASE WHEN month(tanggal) <= 6 THEN '1' ELSE '2' END, CASE WHEN month(tanggal) <= 6 THEN 1 ELSE 2 END FROM feat
UNION SELECT 'kuartal', concat('Q', cast(quarter(tanggal) AS varchar)), cast(quarter(tanggal) AS integer) FROM feat
UNION SELECT 'bulan', ['Januari','Februari','Maret','April','Mei','Juni','Juli','Agustus','September','Oktober','November','Desember'][month(tanggal)], cast(month(tanggal) AS integer) FROM feat
UNION SELECT 'minggu', cast(cast(ceil(day(tanggal) / 7.0) AS integer) AS varchar), cast(ceil(day(tanggal) / 7.0) AS integer) FROM feat"""
)
def time_member_order(spark, sf):
    star = feature_star(spark, sf)
    frames = [
        cube.time_members(star, level).select(F.lit(level).alias("level"), "value", "ordinal")
        for level in TIME_LEVELS
    ]
    return union_vertical(*frames)


REGION_SQL = """
WITH named AS (
  SELECT *, CASE WHEN n_regionkey = 2 THEN 'Jawa' ELSE pulau END AS island,
    CASE WHEN n_nationkey % 12 = 2 THEN concat('DI Yogyakarta ', provinsi) ELSE provinsi END AS province,
    CASE n_nationkey % 4 WHEN 0 THEN concat('Kabupaten ', kota) WHEN 1 THEN concat('KOTA ', kota)
      WHEN 2 THEN concat(' kabupaten ', kota) ELSE concat(kota, '  ') END AS city
  FROM feat)
"""


@query(
    REGION_SQL
    + """SELECT CASE n_nationkey % 4 WHEN 0 THEN upper(kota) ELSE upper(trim(city)) END AS region,
  cast(sum(detections) AS bigint) AS total FROM named WHERE lower(confidence) = 'low' GROUP BY 1"""
)
def choropleth_counts(spark, sf):
    return cube.choropleth_counts(feature_star(spark, sf, java=True), "kota", {"confidence": "low"})


@query(
    REGION_SQL
    + """SELECT CASE WHEN n_nationkey % 12 = 2 THEN 'DAERAH ISTIMEWA YOGYAKARTA' ELSE upper(province) END AS region,
  cast(sum(detections) AS bigint) AS total FROM named GROUP BY 1"""
)
def merge_counts(spark, sf):
    """Several provinces carry the special name and must add up."""
    star = feature_star(spark, sf, java=True)
    return cube.merge_counts(cube.count_by_level(star, "provinsi"))


@query(
    REGION_SQL
    + """, bounds AS (SELECT DISTINCT province AS name, island AS parent_name FROM named),
counts AS (SELECT CASE WHEN n_nationkey % 12 = 2 THEN 'DAERAH ISTIMEWA YOGYAKARTA' ELSE upper(province) END AS region,
    sum(detections) AS total FROM named WHERE satelit = 'Terra' AND island = 'Jawa' GROUP BY 1),
inside AS (SELECT * FROM bounds WHERE upper(trim(parent_name)) = 'JAWA'),
extra AS (SELECT * FROM bounds WHERE contains(upper(name), 'YOGYAKARTA')
    AND NOT EXISTS (SELECT 1 FROM inside WHERE contains(upper(name), 'YOGYAKARTA')) ORDER BY name LIMIT 1)
SELECT name, parent_name, cast(coalesce(total, 0) AS bigint) AS total
FROM (SELECT * FROM inside UNION ALL SELECT * FROM extra) b
LEFT JOIN counts ON region = CASE WHEN contains(upper(name), 'YOGYAKARTA') THEN 'DAERAH ISTIMEWA YOGYAKARTA' ELSE upper(name) END
WHERE coalesce(total, 0) > 0 OR contains(upper(name), 'YOGYAKARTA')"""
)
def attach_counts_to_boundaries(spark, sf):
    star = feature_star(spark, sf, java=True)
    bounds = star.places.select(
        F.lit("provinsi").alias("level"), F.col("provinsi").alias("name"), F.col("pulau").alias("parent_name")
    ).distinct()
    named = cube.merge_counts(
        cube.count_by_level(star, "provinsi", {"satelite": "Terra", "pulau": "Jawa"})
    )
    shown = cube.attach_counts_to_boundaries(bounds, named, "provinsi", "jawa ")
    return shown.select("name", "parent_name", "total")


@query(
    REGION_SQL
    + """, counts AS (SELECT CASE WHEN n_nationkey % 12 = 2 THEN 'DAERAH ISTIMEWA YOGYAKARTA' ELSE upper(province) END AS region,
    sum(detections) AS total FROM named WHERE satelit = 'Aqua' GROUP BY 1)
SELECT name, cast(total AS bigint) AS total FROM (SELECT DISTINCT province AS name FROM named)
JOIN counts ON region = CASE WHEN contains(upper(name), 'YOGYAKARTA') THEN 'DAERAH ISTIMEWA YOGYAKARTA' ELSE upper(name) END"""
)
def boundaries_from_choropleth(spark, sf):
    """Counts by map name meet the boundaries, the special province too."""
    star = feature_star(spark, sf, java=True)
    bounds = star.places.select(
        F.lit("provinsi").alias("level"), F.col("provinsi").alias("name"), F.col("pulau").alias("parent_name")
    ).dropDuplicates(["name"])
    counts = cube.choropleth_counts(star, "provinsi", {"satelite": "Aqua"})
    return cube.attach_counts_to_boundaries(bounds, counts, "provinsi").select("name", "total")


@query("SELECT DISTINCT kota AS name, provinsi AS parent_name FROM feat WHERE provinsi = 'NATION_4'")
def boundaries_of_parent(spark, sf):
    star = feature_star(spark, sf)
    bounds = star.places.select(F.col("kota").alias("name"), F.col("provinsi").alias("parent_name"))
    return filters.boundaries_of_parent(bounds.distinct(), "kota", " nation_4 ")


BREAKS_SQL = """
cells AS (SELECT {level} AS label, cast(sum(detections) AS bigint) AS total FROM feat GROUP BY 1),
limits AS (SELECT cast(min(total) AS double) AS lo, cast(max(total) AS double) AS hi FROM cells WHERE total > 0),
breaks AS (SELECT lo, hi,
    CASE WHEN hi - lo < 3 THEN lo + greatest(ceil((hi - lo) / 3), 1) ELSE lo + (hi - lo) / 3 END AS t1,
    CASE WHEN hi - lo < 3 THEN lo + greatest(ceil((hi - lo) / 3), 1) * 2 ELSE lo + (hi - lo) * 2 / 3 END AS t2
  FROM limits)
"""


@query(
    "WITH "
    + BREAKS_SQL.format(level="provinsi").strip()
    + "\nSELECT lo AS min_value, hi AS max_value, t1 AS threshold1, t2 AS threshold2 FROM breaks"
)
def threshold_breaks(spark, sf):
    return cube.threshold_breaks(cube.count_by_level(feature_star(spark, sf), "provinsi"))


@query(
    "WITH "
    + BREAKS_SQL.format(level="desa").strip()
    + """
SELECT label, total, CASE WHEN total < t1 THEN 'rendah' WHEN total < t2 THEN 'sedang' ELSE 'tinggi' END AS map_class,
  CASE WHEN total < t1 THEN '#FFCDD2' WHEN total < t2 THEN '#EF5350' ELSE '#B71C1C' END AS colour
FROM cells, breaks"""
)
def classify_counts(spark, sf):
    return cube.classify_counts(cube.count_by_level(feature_star(spark, sf), "desa"))


PLACES_SQL = """places AS (SELECT c_custkey AS id, r_name AS pulau, n_name AS provinsi,
    concat(n_name, ' ', c_mktsegment) AS kota,
    cast(-11 + (c_custkey % 18) AS double) + cast(c_custkey % 4 AS double) * 0.25::double AS lat,
    cast(95 + (c_custkey % 46) AS double) + cast(c_custkey % 8 AS double) * 0.125::double AS lng
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@query(
    f"""WITH {PLACES_SQL},
cells AS (SELECT kota AS label, cast(sum(detections) AS bigint) AS total FROM feat WHERE provinsi = 'NATION_9' GROUP BY 1)
SELECT label, total, arg_min(lat, id) AS lat, arg_min(lng, id) AS lng
FROM cells LEFT JOIN places ON kota = label GROUP BY label, total"""
)
def attach_label_coordinates(spark, sf):
    cells = cube.drill_down(feature_star(spark, sf), {"provinsi": "NATION_9"})
    return lookups.attach_label_coordinates(cells, place_list(spark, sf), "kota")


@query(f"WITH {PLACES_SQL} SELECT id, pulau, provinsi, lat, lng FROM places WHERE provinsi = 'NATION_11'")
def match_any_level(spark, sf):
    return filters.match_any_level(place_list(spark, sf), "NATION_11").select(
        "id", "pulau", "provinsi", "lat", "lng"
    )


@query(
    f"""WITH {PLACES_SQL} SELECT avg(lat) AS lat, avg(lng) AS lng, count(*) AS matches FROM places
WHERE pulau = 'ASIA'"""
)
def centroid(spark, sf):
    return cube.centroid(place_list(spark, sf), "ASIA", (-2.5, 118.0))


@query(f"WITH {PLACES_SQL} SELECT -2.5::double AS lat, 118::double AS lng, count(*) AS matches FROM places WHERE pulau = 'ATLANTIS'")
def centroid_fallback(spark, sf):
    return cube.centroid(place_list(spark, sf), "ATLANTIS", (-2.5, 118.0))


# ---------------------------------------------------------------- dashboard


@query(
    """SELECT coalesce(cast(CASE WHEN id % 211 <> 0 THEN tanggal END AS varchar), 'Unknown') AS tanggal,
  count(*) AS total FROM feat GROUP BY 1"""
)
def count_by_date(spark, sf):
    rows = features(spark, sf, "id", "tanggal")
    return dashboard.count_by_date(
        rows.withColumn("tanggal", F.when(F.col("id") % 211 != 0, F.col("tanggal")))
    )


@query(
    """SELECT cast(year(tanggal) AS integer) AS tahun, cast(month(tanggal) AS integer) AS bulan,
  count(*) AS total, count(*) FILTER (WHERE confidence = 'high') AS high_confidence,
  concat(['Januari','Februari','Maret','April','Mei','Juni','Juli','Agustus','September','Oktober','November','Desember'][month(tanggal)],
    ' ', cast(year(tanggal) AS varchar)) AS label FROM feat GROUP BY year(tanggal), month(tanggal)"""
)
def monthly_trend(spark, sf):
    return dashboard.monthly_trend(features(spark, sf, "tanggal", "confidence"))


@query(
    """SELECT count(*) AS total, count(*) FILTER (WHERE confidence = 'high') AS high_confidence,
  count(DISTINCT provinsi) AS provinces FROM feat"""
)
def kpis(spark, sf):
    return dashboard.kpis(feature_star(spark, sf))


@query(
    """SELECT count(*) AS total, count(*) FILTER (WHERE confidence = 'high') AS high_confidence,
  count(DISTINCT provinsi) AS provinces FROM feat WHERE tanggal = date '1999-03-14'"""
)
def kpis_on(spark, sf):
    return dashboard.kpis_on(feature_star(spark, sf), "1999-03-14")


@query("SELECT pulau, count(*) AS total FROM feat GROUP BY pulau ORDER BY total DESC, pulau LIMIT 1")
def top_island(spark, sf):
    return dashboard.top_island(feature_star(spark, sf))


GRID_SQL = """SELECT cast(floor((lon + 180) / 360 * 256 * {scale} / 50) AS bigint) AS cell_x,
  cast(floor((0.5 - asinh(tan(radians(lat))) / (2 * pi())) * 256 * {scale} / 50) AS bigint) AS cell_y,
  count(*) AS total, avg(lat) AS lat, avg(lon) AS lon FROM feat GROUP BY 1, 2"""


@query(
    f"""SELECT *, CASE WHEN total > 100 THEN 'large' WHEN total > 20 THEN 'medium' ELSE 'small' END AS size_class
FROM ({GRID_SQL.format(scale=32)})"""
)
def cluster_points(spark, sf):
    return dashboard.cluster_points(features(spark, sf, "id", "lat", "lon"), 5)


PYRAMID_SQL = " UNION ALL ".join(f"SELECT {z} AS zoom, * FROM ({GRID_SQL.format(scale=2**z)})" for z in range(13))


@query(
    """SELECT id, kota, desa FROM feat WHERE lower(pulau) LIKE '%achin%' OR lower(provinsi) LIKE '%achin%'
  OR lower(kota) LIKE '%achin%' OR lower(kecamatan) LIKE '%achin%' OR lower(desa) LIKE '%achin%'"""
)
def search_by_name_index(spark, sf):
    """The rows of a substring search, found through the letters of place names."""
    star, root = feature_star(spark, sf), scratch_path(spark, "names")
    name_index.write_name_index(star.places, root)
    return name_index.search_star(star, spark, root, "aCHIn").flat("id", "kota", "desa")


@query("SELECT c_custkey AS place_key FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_11'")
def match_by_name_index(spark, sf):
    root = scratch_path(spark, "names")
    name_index.write_name_index(feature_star(spark, sf).places, root)
    return name_index.places_called(spark, root, "NATION_11")


@query(
    f"""SELECT *, CASE WHEN total > 100 THEN 'large' WHEN total > 20 THEN 'medium' ELSE 'small' END AS size_class
FROM ({PYRAMID_SQL})"""
)
def cluster_pyramid(spark, sf):
    return dashboard.cluster_pyramid(features(spark, sf, "lat", "lon"))


@query("SELECT id, lat, lon, cast(1 AS bigint) AS total FROM feat")
def cluster_points_close(spark, sf):
    return dashboard.cluster_points(features(spark, sf, "id", "lat", "lon"), 13)


@query(
    """SELECT row_count, missing_coordinates, out_of_bounds, row_count < 500 AS low_count,
  missing_coordinates = 0 AND NOT out_of_bounds > row_count * 0.1 AS valid FROM (
  SELECT count(*) AS row_count,
    count(*) FILTER (WHERE lat IS NULL) + count(*) FILTER (WHERE lon IS NULL) AS missing_coordinates,
    count(*) FILTER (WHERE lat < -11 OR lat > 6 OR lon < 95 OR lon > 141) AS out_of_bounds
  FROM feat WHERE year(tanggal) = 1997)"""
)
def validate_backfill(spark, sf):
    rows = period_rows(features(spark, sf, "tanggal", "lat", "lon"), tahun=1997)
    return quality.validate_backfill(rows, 1997)


# ---------------------------------------------------------------- table and ranking


@query(
    """SELECT id, tanggal, satelit, confidence, kota FROM feat
WHERE tanggal IN (date '1996-02-29', date '1999-12-31', date '2000-07-04') AND confidence IN ('low', 'high')
  AND contains(lower(concat_ws('|', pulau, provinsi, kota, kecamatan, desa)), 'nation_1')"""
)
def filter_table(spark, sf):
    rows = features(spark, sf)
    return table_view.filter_table(
        rows, "Nation_1", ["1996-02-29", "1999-12-31", "2000-07-04"], ["low", "high"]
    ).select("id", "tanggal", "satelit", "confidence", "kota")


ACCUMULATED_SQL = """SELECT tanggal, satelit, confidence, provinsi, kota,
  cast(sum(detections) AS bigint) AS jumlah FROM feat GROUP BY ALL"""


@query(ACCUMULATED_SQL)
def accumulate(spark, sf):
    return table_view.accumulate_star(feature_star(spark, sf))


@query("SELECT DISTINCT satelit FROM feat")
def distinct_satellite_names(spark, sf):
    return distinct_satellites(features(spark, sf, "satelit"))


@query(ACCUMULATED_SQL)
def sort_table(spark, sf):
    rows = table_view.accumulate_star(feature_star(spark, sf))
    return ranking.sort_table(rows, "jumlah", "desc", table_view.ACCUMULATED_KEYS)


@query(
    f"""SELECT * FROM ({ACCUMULATED_SQL})
ORDER BY tanggal DESC, satelit, confidence, provinsi, kota LIMIT 10 OFFSET 20"""
)
def page(spark, sf):
    rows = table_view.accumulate_star(feature_star(spark, sf))
    column, direction = table_view.DEFAULT_SORT
    return ranking.page(rows, column, direction, table_view.ACCUMULATED_KEYS, 3)


@query("SELECT id, tanggal, kota, lat FROM feat ORDER BY lower(kota) DESC NULLS LAST, id LIMIT 25 OFFSET 1000")
def page_far(spark, sf):
    """A page behind more rows than one top-k is meant to hold."""
    rows = features(spark, sf, "id", "tanggal", "kota", "lat")
    return ranking.page(rows, "kota", "desc", ["id"], 41, 25, top_rows=400)


@query(
    f"SELECT count(*) AS total_rows, cast(ceil(count(*) / 10.0) AS bigint) AS total_pages FROM ({ACCUMULATED_SQL})"
)
def total_pages(spark, sf):
    return ranking.total_pages(table_view.accumulate_star(feature_star(spark, sf)))


@query(
    """SELECT id, detected_at, provinsi, confidence FROM feat
ORDER BY detected_at DESC NULLS LAST, id LIMIT 5"""
)
def latest_n(spark, sf):
    columns = ("id", "detected_at", "provinsi", "confidence")
    return dashboard.latest_detections(feature_star(spark, sf), 5, *columns)


@query(
    """SELECT arg_max(tanggal, detected_at) AS newest_date, max(tanggal) AS largest_date FROM feat"""
)
def latest_date(spark, sf):
    return ranking.latest_date(features(spark, sf, "tanggal", "detected_at"))


@query(
    """SELECT CASE WHEN min(tanggal) = max(tanggal) THEN cast(min(tanggal) AS varchar)
  ELSE concat(cast(min(tanggal) AS varchar), '_to_', cast(max(tanggal) AS varchar)) END AS label
FROM feat WHERE satelit = 'Aqua' AND confidence = 'high'"""
)
def export_label(spark, sf):
    rows = filters.in_values(features(spark, sf, "tanggal", "satelit", "confidence"), ["high"], ["Aqua"])
    return table_view.export_label(rows, "2024-01-31")


# ---------------------------------------------------------------- the app's requests


@query(
    """SELECT provinsi AS label, cast(sum(detections) AS bigint) AS total FROM feat
WHERE pulau = 'AMERICA' AND confidence = 'high' AND tanggal BETWEEN date '1998-01-01' AND date '1998-06-30' GROUP BY 1"""
)
def ask_location(spark, sf):
    params = {"dimension": "location", "tipe": "provinsi", "pulau": "AMERICA", "confidence": "high",
              "tahun": "1998", "semester": "1"}
    return questions.ask(feature_star(spark, sf), "location", params)


@query(
    """SELECT confidence AS label, cast(sum(detections) AS bigint) AS total FROM feat
WHERE kota = 'NATION_5 BUILDING' GROUP BY 1"""
)
def ask_confidence(spark, sf):
    return questions.ask(feature_star(spark, sf), "confidence", {"kota": "NATION_5 BUILDING"})


@query(
    """SELECT satelit AS label, cast(sum(detections) AS bigint) AS total FROM feat
WHERE lower(confidence) = 'low' AND quarter(tanggal) = 1 GROUP BY 1"""
)
def ask_satellite(spark, sf):
    return questions.ask(feature_star(spark, sf), "satelite", {"confidence": "LOW", "kuartal": "Q1"})


@query(
    """SELECT DISTINCT concat('Q', cast(quarter(tanggal) AS varchar)) AS value, cast(quarter(tanggal) AS integer) AS ordinal
FROM feat WHERE provinsi = 'NATION_5' AND year(tanggal) = 1999 AND month(tanggal) > 6"""
)
def ask_time(spark, sf):
    params = {"dimension": "time", "provinsi": "NATION_5", "tahun": "1999", "semester": "2"}
    return questions.ask(feature_star(spark, sf), "time", params)


@query(
    """SELECT id, tanggal, detected_at, satelit, confidence, pulau, provinsi, kota, kecamatan, desa, detections, lat, lon,
  cast(cast(ceil(day(tanggal) / 7.0) AS integer) AS varchar) AS minggu
FROM feat WHERE pulau = 'ASIA' AND tanggal = date '1995-03-20'"""
)
def ask_detections(spark, sf):
    params = {"selectedDate": "1995-03-20", "pulau": "ASIA", "lat": -2.5, "lng": 118}
    return questions.detections(feature_star(spark, sf), params)
