"""Stored answers that expire."""

import os

from thermalcube.sources import answer_cache as cache

HOUR = 3600
DDL = "k string, cached_at timestamp, name string, code int"


def store(spark, path, *rows):
    frame = spark.createDataFrame(list(rows), "k string, at string, name string, code int")
    cache.store_answers(frame.selectExpr("k", "cast(at AS timestamp) AS cached_at", "name", "code"), path, ["k"])


def ask(spark, path, as_of, ttl=24 * HOUR, keys=("a", "b", "c")):
    frame = spark.createDataFrame([(k,) for k in keys], "k string")
    got = cache.ask_cache(frame, path, DDL, ["k"], ttl, as_of).collect()
    return {r.k: (r.name, r.is_hit) for r in got}


def folders(path):
    return sorted(f for f in os.listdir(path) if f.startswith("cached_hour"))


def test_newest_living_answer_counts(spark, tmp_path):
    path = str(tmp_path / "answers")
    assert ask(spark, path, "2024-01-02 00:00:00") == {k: (None, False) for k in "abc"}
    store(spark, path, ("a", "2024-01-01 10:00:00", "old", 1), ("a", "2024-01-01 10:30:00", "new", 1), ("b", "2024-01-01 23:00:00", "b", None))
    # Without a value, a key or a time: nothing to keep.
    store(spark, path, ("c", "2024-01-01 23:00:00", None, None), (None, "2024-01-01 23:00:00", "x", 1), ("c", None, "x", 1))
    first = {"a": ("new", True), "b": ("b", True), "c": (None, False)}
    assert ask(spark, path, "2024-01-02 10:29:59") == first
    # The same again, as a repeated run does.
    store(spark, path, ("a", "2024-01-01 10:30:00", "new", 1))
    assert ask(spark, path, "2024-01-02 10:29:59") == first
    assert ask(spark, path, "2024-01-02 10:30:00") == {"a": (None, False), "b": ("b", True), "c": (None, False)}
    store(spark, path, ("a", "2024-01-02 11:00:00", "newer", 2))
    assert ask(spark, path, "2024-01-02 12:00:00")["a"] == ("newer", True)


def test_expiry_drops_whole_folders_and_changes_no_answer(spark, tmp_path):
    path = str(tmp_path / "answers")
    assert cache.expire(spark, path, HOUR, "2024-01-02 00:00:00") == 0
    store(spark, path, ("a", "2024-01-01 10:00:00", "a", 1), ("b", "2024-01-01 10:59:59", "b", 1), ("c", "2024-01-01 11:00:00", "c", 1))
    assert len(folders(path)) == 2
    for as_of, left in (("2024-01-02 10:59:58", 2), ("2024-01-02 10:59:59", 2), ("2024-01-02 11:00:00", 1), ("2024-01-02 12:00:00", 0)):
        before = ask(spark, path, as_of)
        cache.expire(spark, path, 24 * HOUR, as_of)
        assert len(folders(path)) == left
        assert ask(spark, path, as_of) == before
    assert ask(spark, path, "2024-01-02 12:00:00") == {k: (None, False) for k in "abc"}


def test_expired_folders_are_not_read(spark, tmp_path):
    path = str(tmp_path / "answers")
    store(spark, path, ("a", "2024-01-01 10:00:00", "a", 1), ("b", "2024-01-05 10:59:59", "b", 1))
    living = cache.living_answers(spark, path, DDL, ["k"], HOUR, "2024-01-05 11:00:00")
    plan = living._jdf.queryExecution().executedPlan().toString()
    assert "cached_hour" in plan.split("PartitionFilters:")[1].split("]")[0]


def test_a_store_writes_a_file_per_hour_not_per_task_and_hour(spark, tmp_path):
    path = tmp_path / "answers"
    rows = spark.range(0, 4000, 1, 8).selectExpr(
        "cast(id AS string) AS k", "timestamp_seconds(1704067200 + (id % 24) * 3600) AS cached_at", "'x' AS name", "1 AS code"
    )
    cache.store_answers(rows, str(path), ["k"])
    assert len(list(path.rglob("*.parquet"))) == 24
    assert spark.read.parquet(str(path)).count() == 4000
