"""Landed files taken in once each."""

import os

import pytest

from thermalcube.session import remove, shared_folder
from thermalcube.sources import landing

HEADER = "latitude,longitude,acq_date,acq_time,confidence"


def land(folder, name, text, moved=0):
    path = folder / "landed" / name
    path.parent.mkdir(exist_ok=True)
    path.write_text(text)
    os.utime(path, (1_700_000_000 + moved, 1_700_000_000 + moved))


def take(spark, folder):
    got = landing.take_landed(spark, str(folder / "landed"), str(folder / "root")).collect()
    return {r.source_file.rsplit("/", 1)[1]: (r.reason, r.lines, r.intake) for r in got}


def rows(spark, folder):
    got = landing.landed_detections(spark, str(folder / "root"))
    return sorted((r.latitude, r.acq_time, r.frp) for r in got.collect())


@pytest.fixture
def scans(monkeypatch):
    """The files handed to the reader of lines, one entry for each scan."""
    seen, real = [], landing.file_lines
    monkeypatch.setattr(landing, "file_lines", lambda spark, paths: seen.append(sorted(p.rsplit("/", 1)[1] for p in paths)) or real(spark, paths))
    return seen


def test_each_version_is_scanned_once(spark, tmp_path, scans):
    land(tmp_path, "a.csv", f"{HEADER}\n1,2,2024-01-05,5,h\n2,2,2024-01-05,5,l\n")
    land(tmp_path, "b.csv", "frp,acq_time,acq_date,longitude,latitude\n9.5,7,2024-01-06,4,3\n")
    land(tmp_path, "c.csv", "Error: quota\n")
    # Spark lists no empty files.
    land(tmp_path, "d.csv", "")
    assert take(spark, tmp_path) == {
        "a.csv": (None, 3, 1), "b.csv": (None, 2, 1), "c.csv": ("error mark", 1, 1),
    }
    first = [("1", "5", None), ("2", "5", None), ("3", "7", "9.5")]
    assert rows(spark, tmp_path) == first
    assert take(spark, tmp_path) == {}
    # A file more and a corrected one; the others are not looked at.
    land(tmp_path, "e [1]{x}.csv", f"{HEADER}\n5,2,2024-01-05,9,h\n")
    land(tmp_path, "a.csv", f"{HEADER}\n1,2,2024-01-05,6,h\n", moved=60)
    assert set(take(spark, tmp_path)) == {"a.csv", "e%20%5B1%5D%7Bx%7D.csv"}
    assert rows(spark, tmp_path) == [("1", "6", None), ("3", "7", "9.5"), ("5", "9", None)]
    assert scans == [["a.csv", "b.csv", "c.csv"], ["a.csv", "e \\[1\\]\\{x\\}.csv"]]


def test_refused_version_takes_its_rows_away(spark, tmp_path):
    land(tmp_path, "a.csv", f"{HEADER}\n1,2,2024-01-05,5,h\n")
    land(tmp_path, "b.csv", f"{HEADER}\n2,2,2024-01-05,5,h\n")
    take(spark, tmp_path)
    land(tmp_path, "a.csv", "Invalid key\n", moved=60)
    assert take(spark, tmp_path) == {"a.csv": ("error mark", 1, 2)}
    assert rows(spark, tmp_path) == [("2", "5", None)]


def test_intake_without_verdicts_is_not_read_and_done_again(spark, tmp_path):
    land(tmp_path, "a.csv", f"{HEADER}\n1,2,2024-01-05,5,h\n")
    take(spark, tmp_path)
    # What a driver leaves that is lost before the verdicts are written.
    lost = landing.landed_detections(spark, str(tmp_path / "root"))
    lost.write.parquet(str(tmp_path / "root" / landing.ROWS / "intake=2"))
    assert rows(spark, tmp_path) == [("1", "5", None)]
    land(tmp_path, "b.csv", f"{HEADER}\n2,2,2024-01-05,5,h\n")
    take(spark, tmp_path)
    assert rows(spark, tmp_path) == [("1", "5", None), ("2", "5", None)]


def test_nothing_landed_and_nothing_left(spark, tmp_path):
    (tmp_path / "landed").mkdir()
    assert rows(spark, tmp_path) == []
    assert take(spark, tmp_path) == {}
    land(tmp_path, "a.csv", f"{HEADER}\n1,2,2024-01-05,5,h\n")
    before = set(os.listdir(shared_folder(spark).removeprefix("file:")))
    take(spark, tmp_path)
    assert set(os.listdir(shared_folder(spark).removeprefix("file:"))) == before
    # Rows stay when the landing folder is emptied.
    remove(spark, str(tmp_path / "landed" / "a.csv"))
    assert rows(spark, tmp_path) == [("1", "5", None)]


def test_replaced_versions_are_held_against_without_a_shuffle_of_rows(spark, tmp_path):
    land(tmp_path, "a.csv", f"{HEADER}\n1,2,2024-01-05,5,h\n")
    take(spark, tmp_path)
    plan = landing.landed_detections(spark, str(tmp_path / "root"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
