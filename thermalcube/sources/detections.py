"""Landed detection files and spooled staging files."""

from __future__ import annotations

import csv
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from thermalcube.schemas import BATCH_COLUMNS, DETECTION_COLUMNS, REQUIRED_DETECTION_COLUMNS
from thermalcube.session import scratch_path

# Texts that mark a landed file as an error answer instead of data.
ERROR_MARKS = ("Invalid", "Error")
NULL_TOKEN = r"\N"
# Spooled timestamps carry three or six fraction digits.
READ_TIMESTAMP = "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]"


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """Detections of landed CSV files, every column as text, missing columns null.

    Files may differ in their columns. A file is left out as a whole if it holds an error mark or
    its header lacks a required column; a header alone yields no rows. ``source_file`` names the
    file a row came from.
    """
    lines = file_lines(spark, path)
    found = judged(lines).filter(F.col("reason").isNull()).select("source_file", "header")
    # Stored, so the join below knows its true size: small lists are broadcast, and the lines are
    # shuffled only if the list of files itself is large.
    listing = scratch_path(spark, "landed-files")
    found.write.parquet(listing)
    return parse_lines(lines, spark.read.schema("source_file string, header string").parquet(listing))


def parse_lines(lines: DataFrame, files: DataFrame) -> DataFrame:
    """The data lines of the listed files (source_file, header) as columns of text."""
    # Feeds share a handful of layouts, so this is the size of a schema inference.
    headers = [r["header"] for r in files.select("header").distinct().collect()]
    usable = {h: _columns(h) for h in headers}
    if not usable:
        empty = ", ".join(f"{c} string" for c in (*DETECTION_COLUMNS, "source_file"))
        return lines.sparkSession.createDataFrame([], empty)
    is_header = _looks_like_header(F.col("value"), REQUIRED_DETECTION_COLUMNS[0])
    known = lines.filter(~is_header & (F.col("value") != "")).join(files, "source_file")
    # One struct per layout, null for lines of other layouts; each line is parsed once.
    layouts = [(f"__layout{i}", h, columns) for i, (h, columns) in enumerate(usable.items())]
    parsed = known.select(
        "source_file",
        *[
            F.when(F.col("header") == h, F.from_csv(F.col("value"), _ddl(columns))).alias(name)
            for name, h, columns in layouts
        ],
    )
    return parsed.select(*[_field(c, layouts) for c in DETECTION_COLUMNS], "source_file")


def refused_detections(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, reason) of the landed files that ``read_detections`` leaves out."""
    return judged(file_lines(spark, path)).filter(F.col("reason").isNotNull()).select("source_file", "reason")


def file_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source_file"))


def judged(lines: DataFrame) -> DataFrame:
    """One row per landed file: its header, and why it is refused, if it is."""
    is_header = _looks_like_header(F.col("value"), REQUIRED_DETECTION_COLUMNS[0])
    has_error = F.col("value").contains(ERROR_MARKS[0]) | F.col("value").contains(ERROR_MARKS[1])
    files = lines.groupBy("source_file").agg(
        F.max(F.when(is_header, F.col("value"))).alias("header"), F.count_if(has_error).alias("errors")
    )
    complete = reduce(and_, [_looks_like_header(F.col("header"), c) for c in REQUIRED_DETECTION_COLUMNS])
    reason = F.when(F.col("errors") > 0, F.lit("error mark")).when(
        ~F.coalesce(complete, F.lit(False)), F.lit("required column missing")
    )
    return files.withColumn("reason", reason)


def _looks_like_header(line: Column, name: str) -> Column:
    return F.lower(F.translate(line, '"', "")).rlike(rf"(^|,)\s*{name}\s*(,|$)")


def _columns(header: str) -> list[str]:
    return [c.strip().lower() for c in next(csv.reader([header]))]


def _ddl(columns: list[str]) -> str:
    return ", ".join(f"`{c}` string" for c in columns)


def _field(name: str, layouts: list[tuple[str, str, list[str]]]) -> Column:
    """A column from whichever layout of the line has it."""
    found = [F.col(layout).getField(name) for layout, _, columns in layouts if name in columns]
    return (F.coalesce(*found) if found else F.lit(None).cast("string")).alias(name)


def staging_ddl() -> str:
    return ", ".join(f"{n} {t}" for n, t in {**BATCH_COLUMNS, **DETECTION_COLUMNS}.items())


def read_staging(
    spark: SparkSession, path: str, ddl: str | None = None, batch_id: str | None = None
) -> DataFrame:
    """Staged rows from CSV with typed columns; the null token stands for null."""
    rows = (
        spark.read.schema(ddl or staging_ddl())
        .option("header", True)
        .option("enforceSchema", False)
        .option("nullValue", NULL_TOKEN)
        .option("timestampFormat", READ_TIMESTAMP)
        .option("escape", '"')
        .csv(path)
    )
    return rows.filter(F.col("batch_id") == batch_id) if batch_id else rows
