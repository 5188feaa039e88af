"""Stored answers of place and weather services that expire.

Entries lie in one folder per hour of their ``cached_at``. Storing appends, and the newest entry of
a key counts when reading, so that a repeated run changes no answer. What has expired is dropped
by whole folders, and reading opens only folders that may hold living entries.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from thermalcube.session import remove
from thermalcube.sources.tables import exists

HOUR = "cached_hour"
CACHED_AT = "cached_at"


def _hour(at: Column) -> Column:
    return F.floor(F.unix_timestamp(at) / 3600).cast("long")


def store_answers(answers: DataFrame, path: str, on: Sequence[str]) -> None:
    """Add answers: keys ``on``, ``cached_at``, and the answer in all other columns.

    An answer without any value, a null key or a null time is not kept.
    """
    found = [F.col(c).isNotNull() for c in answers.columns if c not in (*on, CACHED_AT)]
    kept = answers.dropna(subset=[*on, CACHED_AT]).filter(reduce(or_, found, F.lit(False)))
    # Gathered by hour, or every task would write a file into every folder; a hot hour is split by AQE.
    stamped = kept.withColumn(HOUR, _hour(F.col(CACHED_AT))).hint("rebalance", F.col(HOUR))
    stamped.write.mode("append").partitionBy(HOUR).parquet(path)


def living_answers(
    spark: SparkSession, path: str, ddl: str, on: Sequence[str], ttl_seconds: int, as_of: str
) -> DataFrame:
    """The newest entry of each key among those that have not expired; equal times: the greatest.

    ``ddl`` names the stored columns: keys, ``cached_at`` and the answer. A cache without any is empty.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], ddl)
    oldest = F.lit(as_of).cast("timestamp") - F.expr(f"interval {int(ttl_seconds)} seconds")
    rows = spark.read.schema(f"{ddl}, {HOUR} long").parquet(path)
    rows = rows.filter((F.col(HOUR) >= _hour(oldest)) & (F.col(CACHED_AT) > oldest)).drop(HOUR)
    others = [F.col(c).desc() for c in rows.columns if c not in (*on, CACHED_AT)]
    newest = F.row_number().over(W.partitionBy(*on).orderBy(F.col(CACHED_AT).desc(), *others))
    return rows.withColumn("__place", newest).filter("__place = 1").drop("__place")


def ask_cache(keys: DataFrame, path: str, ddl: str, on: Sequence[str], ttl_seconds: int, as_of: str) -> DataFrame:
    """Each row of ``keys`` with the living answer, if there is one, and ``is_hit``."""
    living = living_answers(keys.sparkSession, path, ddl, on, ttl_seconds, as_of).withColumn("__hit", F.lit(True))
    joined = keys.join(living, list(on), "left")
    return joined.withColumn("is_hit", F.coalesce("__hit", F.lit(False))).drop("__hit")


def expire(spark: SparkSession, path: str, ttl_seconds: int, as_of: str) -> int:
    """Drop the folders whose last possible entry has expired; returns how many. No file is read."""
    if not exists(spark, path):
        return 0
    # An entry lives while it is later than this moment, so one of a folder's last second decides.
    limit = spark.range(1).select(F.unix_timestamp(F.lit(as_of).cast("timestamp")) - int(ttl_seconds)).first()[0]
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [c.getPath().getName() for c in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)]
    hours = [int(n.split("=")[1]) for n in names if n.startswith(f"{HOUR}=") and n.split("=")[1].lstrip("-").isdigit()]
    gone = [h for h in hours if (h + 1) * 3600 <= limit]
    for hour in gone:
        remove(spark, f"{path}/{HOUR}={hour}")
    return len(gone)
