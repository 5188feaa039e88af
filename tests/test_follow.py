"""Facts follow staging by day digests; compaction survives a lost driver."""

import pathlib

import pytest
from pyspark.sql import functions as F

from test_warehouse import DDL, detection, frame, places
from thermalcube.operators.digests import day_digests
from thermalcube.plans import backfill, daily, follow
from thermalcube.schemas import DETECTION_KEYS
from thermalcube.sources import tables

HERE = ("1.0", "100.0")


def stage(spark, root, *rows):
    daily.load_staging(spark, root, {"staging_detection": frame(spark, *rows)})


def follow_all(spark, root, run, known=HERE):
    verdict = follow.follow_staging(spark, root, follow.days_to_follow(spark, root), places(spark, known), run)
    return sorted((str(r.date_value), r.staged_rows, r.fact_rows, r.rebuilt) for r in verdict.collect())


def files(root, name="fact_detection"):
    return {str(p.relative_to(root)) for p in (pathlib.Path(root) / name).rglob("*.parquet")}


def facts_of(spark, root):
    return sorted((str(r.date_value), r.frp) for r in spark.read.parquet(f"{root}/fact_detection").collect())


def test_only_days_that_differ_are_rewritten(spark, tmp_path):
    root = str(tmp_path / "w")
    stage(spark, root, detection(), detection(time="1000"), detection(date="2024-01-06"), detection(lat="7.7"))
    assert follow_all(spark, root, "a") == [("2024-01-05", 2, 0, True), ("2024-01-06", 1, 0, True)]
    before = files(root)
    assert follow_all(spark, root, "b") == [("2024-01-05", 2, 2, False), ("2024-01-06", 1, 1, False)]
    assert files(root) == before
    # A newer row of a known key changes a measure, not a count.
    stage(spark, root, detection(minute=3, frp=8.0))
    assert follow_all(spark, root, "c") == [("2024-01-05", 2, 2, True), ("2024-01-06", 1, 1, False)]
    kept = {f for f in before if "2024-01-06" in f}
    assert kept <= files(root) and not (before - kept) & files(root)
    assert facts_of(spark, root) == [("2024-01-05", 1.0), ("2024-01-05", 8.0), ("2024-01-06", 1.0)]


def test_a_new_confidence_or_damaged_facts_are_noticed(spark, tmp_path):
    root = str(tmp_path / "w")
    stage(spark, root, detection(), detection(time="1000"))
    follow_all(spark, root, "a")
    stage(spark, root, detection(minute=1, confidence="10"))
    assert follow_all(spark, root, "b") == [("2024-01-05", 2, 2, True)]
    whole = spark.read.parquet(f"{root}/fact_detection").collect()
    schema = spark.read.parquet(f"{root}/fact_detection").schema
    tables.replace_days(spark.createDataFrame(whole[:1] * 2, schema), f"{root}/fact_detection", "date_value", ["id"])
    assert follow_all(spark, root, "c") == [("2024-01-05", 2, 2, True)]
    assert sorted(map(str, spark.read.parquet(f"{root}/fact_detection").collect())) == sorted(map(str, whole))


def test_a_backfill_takes_no_fact_away(spark, tmp_path):
    """Three feeds loaded, one of them again by a backfill that knows one place only, then an older one."""
    root = str(tmp_path / "w")
    feeds = {
        "MODIS_NRT": frame(spark, detection(), detection(time="1000", lat="2.0")),
        "VIIRS_SNPP_NRT": frame(spark, detection(time="1100", instrument="VIIRS", satellite="N", confidence="h")),
    }
    feeds = {name: df.drop("batch_id", "ingested_at") for name, df in feeds.items()}
    requests = spark.createDataFrame([(2024, 1, 1)], "year int, start_month int, end_month int")
    both = places(spark, HERE, ("2.0", "100.0"))
    backfill.load_backfill(spark, root, requests, feeds, both, "one", "2024-02-01 00:00:00", ["frp"])
    assert len(facts_of(spark, root)) == 3
    tables.append_table(both, f"{root}/dim_location", both.columns)
    one = {"VIIRS_SNPP_NRT": feeds["VIIRS_SNPP_NRT"]}
    for batch, at in (("two", "2024-02-02 00:00:00"), ("three", "2024-01-31 00:00:00")):
        backfill.load_backfill(spark, root, requests, one, places(spark, HERE), batch, at, ["frp"])
        assert len(facts_of(spark, root)) == 3


def test_weather_of_a_backfill(spark, tmp_path):
    root = str(tmp_path / "w")
    feed = {"MODIS_NRT": frame(spark, detection()).drop("batch_id", "ingested_at")}
    answers = [("1.0", "100.0", "2024-01-05 09:00:00", 30.0), ("1.0", "100.0", "2024-01-20 09:00:00", 20.0),
               ("1.0", "100.0", "2024-05-05 09:00:00", 10.0), ("7.0", "100.0", "2024-01-05 09:00:00", 0.0)]
    kinds = "latitude string, longitude string, datetime string, temperature double"
    from thermalcube.schemas import FACT_WEATHER_COLUMNS, WEATHER_COLUMNS

    wet = spark.createDataFrame(answers, kinds)
    wet = wet.withColumns({c: F.lit(None).cast("string") for c in WEATHER_COLUMNS if c not in wet.columns})
    requests = spark.createDataFrame([(2024, 1, 2)], "year int, start_month int, end_month int")
    backfill.load_backfill(spark, root, requests, feed, places(spark, HERE), "b", "2024-02-01 00:00:00", ["frp"], wet)
    got = spark.read.parquet(f"{root}/fact_weather").select(*FACT_WEATHER_COLUMNS).collect()
    assert sorted((str(r.date_value), r.temperature) for r in got) == [("2024-01-05", 30), ("2024-01-20", 20)]


def test_digests_ignore_order_and_see_every_change(spark):
    rows = [(1, "a", 1.0), (1, "b", 2.0), (1, "b", 2.0), (2, "c", None)]
    kinds = "day int, k string, v double"

    def digest(data):
        return sorted(map(tuple, day_digests(spark.createDataFrame(data, kinds), "day", ["k", "v"]).collect()))

    assert digest(rows) == digest(rows[::-1])
    # Exclusive or alone would not see a pair come or go, a sum alone not all changes that cancel.
    for changed in (rows[:1] + rows[3:], rows + rows[1:3], [(1, "a", 1.5)] + rows[1:]):
        assert digest(changed) != digest(rows)


def test_day_folders_are_pruned_by_the_join(spark, tmp_path):
    root = str(tmp_path / "w")
    stage(spark, root, *[detection(date=f"2024-01-{d:02d}") for d in range(1, 10)])
    days = spark.createDataFrame([("2024-01-05",), (None,)], "d string").select(F.col("d").cast("date"))
    found = tables.of_days(spark.read.parquet(f"{root}/staging_detection"), tables.STAGED_DAY, days)
    assert found.count() == 1
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()


def test_a_lost_driver_loses_no_staged_row(spark, tmp_path, monkeypatch):
    root = tmp_path / "w"
    path = str(root / "staging_detection")
    stage(spark, str(root), detection(), detection(time="1000"), detection(date="2024-01-06"))
    put = tables._overwrite_days

    def lost(spark_, folder, target, partition):
        for day in root.glob("staging_detection/ym=*/staged_day=2024-01-05"):
            tables.remove(spark_, str(day))
        raise RuntimeError("the driver is gone")

    monkeypatch.setattr(tables, "_overwrite_days", lost)
    with pytest.raises(RuntimeError):
        stage(spark, str(root), detection(time="1100"))
    monkeypatch.setattr(tables, "_overwrite_days", put)
    assert spark.read.parquet(path).count() == 1
    tables.recover(spark, path)
    assert sorted(r.acq_time for r in spark.read.parquet(path).collect()) == ["1000", "1100", "930", "930"]
    assert not (root / "staging_detection__pending").exists()


def test_an_unfinished_copy_is_thrown_away(spark, tmp_path):
    root = str(tmp_path / "w")
    stage(spark, root, detection())
    half = tmp_path / "w" / "staging_detection__pending" / "x" / "ym=202401" / "staged_day=2024-01-05"
    half.mkdir(parents=True)
    (half / "part-0.parquet").write_bytes(b"half a file")
    stage(spark, root, detection(time="1000"))
    assert spark.read.parquet(f"{root}/staging_detection").count() == 2
    assert not (tmp_path / "w" / "staging_detection__pending").exists()


def test_a_batch_is_computed_once_and_leaves_no_scratch(spark, tmp_path):
    from thermalcube.session import shared_folder

    root, seen = str(tmp_path / "w"), spark.sparkContext.accumulator(0)

    def count(rows):
        for row in rows:
            seen.add(1)
            yield row

    for number, time in enumerate(("930", "1000")):
        rows = frame(spark, detection(time=time), detection(time=time, date="2024-01-06"))
        counted = spark.createDataFrame(rows.rdd.mapPartitions(count), DDL)
        before = set(pathlib.Path(shared_folder(spark).removeprefix("file:")).glob("*"))
        tables.append_and_compact(spark, counted, f"{root}/s", "acq_date", DETECTION_KEYS, ["frp"])
        assert set(pathlib.Path(shared_folder(spark).removeprefix("file:")).glob("*")) <= before
        assert seen.value == 2 * (number + 1)


def test_counts_come_from_footers(spark, tmp_path):
    from thermalcube.plans import quality

    root = str(tmp_path / "w")
    stage(spark, root, *[detection(date=f"2024-01-{d:02d}") for d in range(1, 6)])
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    held = tables.counted_tables(spark, root, "staging_detection", "fact_weather")
    assert list(held) == ["staging_detection"] and spark.conf.get("spark.sql.sources.useV1SourceList") == before
    counts = quality.table_counts(held)
    assert [tuple(r) for r in counts.collect()] == [("staging_detection", 5)]
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)]" in plan and "latitude" not in plan
