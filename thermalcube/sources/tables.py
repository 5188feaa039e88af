"""Stored tables: Parquet folders partitioned by month and day, and CSV hand-offs."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from thermalcube.operators.dedup import first_per_key, latest_by_key
from thermalcube.operators.lookups import new_rows
from thermalcube.session import remove, scratch
from thermalcube.sources.detections import NULL_TOKEN

MONTH = "ym"
STAGED_DAY = "staged_day"
WRITTEN_TIMESTAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"
# Dimensions in loading order, with the key that decides what is new.
DIMENSION_ORDER = (
    ("dim_period", ("id",)),
    ("dim_location", ("latitude", "longitude")),
    ("dim_satellite", ("id",)),
    ("dim_confidence", ("id",)),
    ("dim_weather_condition", ("id",)),
    ("dim_area", ("id",)),
)


def append_table(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Append by name: columns are put in the stored order, extra ones are left out."""
    df.select(*columns).write.mode("append").parquet(path)


def spool_csv(df: DataFrame, path: str, null_token: str = NULL_TOKEN) -> None:
    """Always-quoted CSV hand-off with a header."""
    writer = df.write.mode("overwrite").option("header", True).option("quoteAll", True)
    writer = writer.option("timestampFormat", WRITTEN_TIMESTAMP).option("escape", '"')
    writer.option("nullValue", null_token).csv(path)


def export_csv(df: DataFrame, path: str) -> None:
    """Quoted CSV export with a header."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def _spread(df: DataFrame, partition: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows gathered by partition value and sorted by the lookup key.

    ``rebalance`` lets AQE split a partition value that holds much of the data over many tasks
    and merge small ones, so one hot month or day is not one task or one file.
    """
    gathered = df.hint("rebalance", *[F.col(c) for c in partition])
    return gathered.sortWithinPartitions(*partition, *order)


def write_partitioned(
    df: DataFrame, path: str, date_column: str, order: Sequence[str], mode: str = "overwrite"
) -> None:
    """Month partitions, rows sorted by the lookup key so row groups can be skipped."""
    rows = df.withColumn(MONTH, F.date_format(F.col(date_column).try_cast("date"), "yyyyMM"))
    _spread(rows, [MONTH], order).write.mode(mode).partitionBy(MONTH).parquet(path)


def replace_days_frame(facts: DataFrame, batch: DataFrame, date_column: str) -> DataFrame:
    """The fact table after a batch: days in the batch are replaced, other days stay."""
    # Distinct calendar days: a few thousand rows for a decade.
    days = F.broadcast(batch.select(date_column).distinct())
    return facts.join(days, date_column, "left_anti").unionByName(batch)


def replace_days(batch: DataFrame, path: str, date_column: str, order: Sequence[str]) -> None:
    """Store a batch in place of the days it covers; a second run changes nothing.

    Facts are partitioned by day, so only the batch is written and other days are not read.
    """
    rows = _spread(batch, [date_column], order)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        date_column
    ).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def insert_new_dims(spark: SparkSession, dims: dict[str, DataFrame], root: str) -> None:
    """Append the unknown rows of each dimension, in loading order: one row per id, none without.

    A dimension is computed once, for its write; one that brings nothing new adds an empty file.
    """
    for name, keys in DIMENSION_ORDER:
        if name not in dims:
            continue
        path = f"{root}/{name}"
        rows = dims[name].filter(F.col("id").isNotNull())
        rows = first_per_key(rows, keys, [F.col(c) for c in rows.columns if c not in keys])
        if exists(spark, path):
            rows = new_rows(rows, spark.read.parquet(path), keys)
        append_table(rows, path, dims[name].columns)


def of_days(df: DataFrame, column: str, days: DataFrame) -> DataFrame:
    """Rows of the days in the first column of ``days``, a calendar's worth at most.

    ``column`` is a folder partition: joined to a filtered side, its folders are pruned when the join
    runs, however many days there are.
    """
    known = days.select(F.col(days.columns[0]).cast("date").alias("__day")).distinct()
    known = known.filter(F.col("__day") >= F.lit("0001-01-01").cast("date"))
    return df.join(F.broadcast(known), F.col(column) == F.col("__day"), "left_semi")


def _pending(path: str) -> str:
    return f"{path.rstrip('/')}__pending"


def _overwrite_days(spark: SparkSession, folder: str, path: str, partition: Sequence[str]) -> None:
    rows = spark.read.parquet(folder)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def recover(spark: SparkSession, path: str, partition: Sequence[str] = (MONTH, STAGED_DAY)) -> None:
    """Finish what a lost driver has left of a compaction: days written completely are put in place."""
    folder = _pending(path)
    if not exists(spark, folder):
        return
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    children = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
    for child in children:
        name = child.getPath().toString()
        if exists(spark, f"{name}/_SUCCESS"):
            _overwrite_days(spark, name, path, partition)
    remove(spark, folder)


def append_and_compact(
    spark: SparkSession,
    batch: DataFrame,
    path: str,
    date_column: str,
    keys: Sequence[str],
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """Add a staging batch and keep the newest row per key; returns the stored row count.

    Staging is partitioned by month and day. A key holds its date, so rows of other days cannot
    collide: only the days the batch touches are read and rewritten. The batch is computed once, into
    a scratch folder from which its days are read. The new content of the touched days is written
    beside the table and kept until it is in place, so that a driver lost meanwhile loses no row:
    the next load (or ``recover``) puts it in place.
    """
    day = F.col(date_column).try_cast("date")
    partition = [MONTH, STAGED_DAY]
    recover(spark, path)
    rows = batch.withColumns({MONTH: F.date_format(day, "yyyyMM"), STAGED_DAY: day})
    with scratch(spark, "incoming") as folder:
        if exists(spark, path):
            rows.write.parquet(folder)
            rows = spark.read.schema(rows.schema).parquet(folder)
            stored = spark.read.schema(rows.schema).parquet(path)
            days = rows.select(STAGED_DAY).distinct()
            # Undated rows share one folder, read only if the batch has some.
            undated = days.filter(F.col(STAGED_DAY).isNull()).select(F.lit(1).alias("__one"))
            without = stored.filter(F.col(STAGED_DAY).isNull()).join(F.broadcast(undated), F.col("__one") == F.lit(1), "left_semi")
            rows = of_days(stored, STAGED_DAY, days).unionByName(without).unionByName(rows)
        newest = latest_by_key(rows, keys, [F.col(c) for c in tie_break])
        target = f"{_pending(path)}/{uuid.uuid4().hex}"
        _spread(newest, partition, keys).write.partitionBy(*partition).parquet(target)
    _overwrite_days(spark, target, path, partition)
    remove(spark, _pending(path))
    return spark.read.schema(rows.schema).parquet(path).agg(F.count(F.lit(1)).alias("row_count"))


def stored_tables(spark: SparkSession, root: str, *names: str) -> dict[str, DataFrame]:
    """The named tables that exist under a warehouse folder."""
    return {n: spark.read.parquet(f"{root}/{n}") for n in names if exists(spark, f"{root}/{n}")}


def counted_tables(spark: SparkSession, root: str, *names: str) -> dict[str, DataFrame]:
    """The named tables that exist, read so that a count of all rows comes from file footers.

    The second version of the Parquet source takes an aggregate into its scan; which version reads a
    table is settled when it is opened.
    """
    setting = "spark.sql.sources.useV1SourceList"
    before = spark.conf.get(setting)
    spark.conf.set(setting, ",".join(s for s in before.split(",") if s.strip() != "parquet"))
    try:
        return stored_tables(spark, root, *names)
    finally:
        spark.conf.set(setting, before)
