"""Landed detection files, each scanned, judged and parsed once, with its verdict kept.

Under a root there are two tables. ``landed_files`` has a row per file and version (path, size, time of
change): its header, why it is refused, if it is, and the number of the intake that took it in.
``landed_detections`` has the rows of accepted files, one folder per intake. The verdicts are written
last and so commit an intake: rows of an intake without verdicts were left by a lost driver, are
not read, and are overwritten by the next intake.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from thermalcube.schemas import DETECTION_COLUMNS
from thermalcube.session import scratch
from thermalcube.sources.detections import file_lines, judged, parse_lines
from thermalcube.sources.tables import exists

FILES, ROWS = "landed_files", "landed_detections"
INTAKE = "intake"
VERSION = "source_file string, length long, modified timestamp"
VERDICT = f"{VERSION}, header string, reason string, lines long, {INTAKE} long"
ROW = ", ".join(f"{c} string" for c in (*DETECTION_COLUMNS, "source_file"))
NO_LINES = "required column missing"


def file_verdicts(spark: SparkSession, root: str) -> DataFrame:
    """All verdicts so far: (source_file, length, modified, header, reason, lines, intake)."""
    path = f"{root}/{FILES}"
    return spark.read.schema(VERDICT).parquet(path) if exists(spark, path) else spark.createDataFrame([], VERDICT)


def new_files(spark: SparkSession, path: str, root: str) -> DataFrame:
    """Landed files (location, source_file, length, modified) without a verdict on this version.

    Only the listing is read, no content; empty files are not listed.
    """
    listed = spark.read.format("binaryFile").load(path).select(
        F.col("path").alias("location"),
        F.col("_metadata.file_path").alias("source_file"),
        F.col("length"),
        F.col("modificationTime").alias("modified"),
    )
    known = file_verdicts(spark, root).select("source_file", "length", "modified")
    return listed.join(known, ["source_file", "length", "modified"], "left_anti").select(
        "location", "source_file", "length", "modified"
    )


def take_landed(spark: SparkSession, path: str, root: str) -> DataFrame:
    """Take in the landed files that are new or changed; returns their verdicts.

    Each of them is scanned once, into a scratch folder that is gone afterwards; judging and parsing
    read that copy. The driver holds names of new files, as Spark's own listing of them does. Without new
    files nothing is written. Files may leave the landing folder afterwards: their rows stay.
    """
    found = new_files(spark, path, root).collect()
    if not found:
        return spark.createDataFrame([], VERDICT)
    number = (file_verdicts(spark, root).agg(F.max(INTAKE)).first()[0] or 0) + 1
    versions = spark.createDataFrame([tuple(r)[1:] for r in found], VERSION)
    with scratch(spark, "landed-lines") as copy, scratch(spark, "landed-verdicts") as judgement:
        file_lines(spark, [_literal(r["location"]) for r in found]).write.parquet(copy)
        lines = spark.read.schema("value string, source_file string").parquet(copy)
        counted = lines.groupBy("source_file").agg(F.count(F.lit(1)).alias("lines"))
        seen = judged(lines).join(counted, "source_file")
        reason = F.when(F.col("lines").isNull(), F.lit(NO_LINES)).otherwise(F.col("reason"))
        versions.join(seen, "source_file", "left").select(
            "source_file", "length", "modified", "header", reason.alias("reason"),
            F.coalesce("lines", F.lit(0)).alias("lines"), F.lit(number).cast("long").alias(INTAKE),
        ).write.parquet(judgement)
        verdicts = spark.read.schema(VERDICT).parquet(judgement)
        accepted = verdicts.filter(F.col("reason").isNull()).select("source_file", "header")
        parse_lines(lines, accepted).write.mode("overwrite").parquet(f"{root}/{ROWS}/{INTAKE}={number}")
        verdicts.write.mode("append").parquet(f"{root}/{FILES}")
    return file_verdicts(spark, root).filter(F.col(INTAKE) == number)


def landed_detections(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the newest version of every accepted file, every column as text.

    A refused newer version takes the file's earlier rows away. Only folders of committed intakes are
    read; the list of replaced versions, mostly empty, is what rows are held against.
    """
    verdicts = file_verdicts(spark, root)
    rows = spark.createDataFrame([], f"{ROW}, {INTAKE} long")
    if exists(spark, f"{root}/{ROWS}"):
        rows = spark.read.schema(f"{ROW}, {INTAKE} long").parquet(f"{root}/{ROWS}")
    newest = verdicts.groupBy("source_file").agg(F.max(INTAKE).alias("newest"))
    replaced = verdicts.join(newest, "source_file").filter(F.col(INTAKE) < F.col("newest"))
    committed = rows.join(verdicts.select(INTAKE).distinct(), INTAKE, "left_semi")
    kept = committed.join(replaced.select("source_file", INTAKE), ["source_file", INTAKE], "left_anti")
    return kept.select(*DETECTION_COLUMNS, "source_file")


def _literal(path: str) -> str:
    """A path whose characters stand for themselves, not for patterns."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)
