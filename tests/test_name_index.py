"""Name search by letter groups finds what a scan of all places finds."""

import pytest
from pyspark.sql import functions as F

from thermalcube.operators import filters
from thermalcube.plans import name_index

NAMES = [
    ("Sumatera", "Riau", "Siak", "Tualang", "Perawang"), ("Sumatera", "Riau", "Siak", "Tualang", "Pinang Sebatang"),
    ("Jawa", "DI Yogyakarta", "Kota Yogyakarta", "Gondokusuman", "Terban"), ("Jawa", "Banten", None, "", "A"),
    ("Kalimantan", "Riau", "riau 50%_x", "Äöß Straße", "İzmir"), (None, None, None, None, None),
] * 2


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("names"))
    places = spark.createDataFrame(
        [(i, *names) for i, names in enumerate(NAMES)],
        "place_key long, pulau string, provinsi string, kota string, kecamatan string, desa string",
    )
    for _ in range(2):
        name_index.write_name_index(places, root)
    return root, places.cache()


@pytest.mark.parametrize("text", ["yogya", "RIAU", "a", "an", "ang", "siak", "50%_", "%", "ß", "äö", "nowhere", "i", "pinang sebatang", "anan", "xyz"])
def test_same_places_as_a_scan(spark, index, text):
    root, places = index
    want = sorted(r.place_key for r in filters.search_location(places, text).collect())
    assert sorted(r.place_key for r in name_index.find_places(spark, root, text).collect()) == want


@pytest.mark.parametrize("name", ["Riau", "riau", "Kota Yogyakarta", "A", "", "nowhere", "İzmir"])
def test_exact_names(spark, index, name):
    root, places = index
    want = sorted(r.place_key for r in filters.match_any_level(places, name).collect())
    assert sorted(r.place_key for r in name_index.places_called(spark, root, name).collect()) == want


def test_only_folders_of_the_letters_are_read(spark, index):
    root, _ = index
    for text, most in (("yogya", 3), ("yo", 1)):
        found = name_index.find_names(spark, root, text)
        assert "PartitionFilters: [bucket" in found._jdf.queryExecution().executedPlan().toString().replace("isnotnull(", "").replace("(bucket", "bucket")
        scan = spark.read.parquet(f"{root}/{name_index.LETTERS}")
        folders = name_index._values(spark, F.array_distinct(F.array(*[name_index._bucket(F.lit(g)) for g in name_index._groups(text)])))
        assert len(folders) <= most < scan.select(name_index.BUCKET).distinct().count()
    places = name_index.find_places(spark, root, "perawang")
    assert "dynamicpruning" in places._jdf.queryExecution().executedPlan().toString()
