"""Incremental ingestion: new files become staging rows, the newest row of a key wins.

Each micro-batch is written to its own folder partition, named by the batch number, in overwrite
mode. A replayed batch therefore rewrites what it wrote before, and history is never rewritten;
``staged_rows`` resolves repeated and late rows when reading.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from thermalcube.operators.dedup import latest_by_key
from thermalcube.plans.daily import load_staging
from thermalcube.plans.follow import follow_staging
from thermalcube.schemas import DETECTION_KEYS
from thermalcube.session import scratch

INGEST = "ingest"


def incremental_ingest(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    shape: Callable[[DataFrame], DataFrame] = lambda df: df,
    after_batch: Callable[[DataFrame, int], None] | None = None,
):
    """Stage everything that is new since the last run, then stop; returns the finished query."""

    def store(batch: DataFrame, number: int) -> None:
        rows = shape(batch).withColumn(INGEST, F.lit(number))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            INGEST
        ).parquet(path)
        if after_batch is not None:
            spark = batch.sparkSession
            after_batch(spark.read.parquet(path).filter(F.col(INGEST) == number), number)

    query = (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(store)
        .start()
    )
    query.awaitTermination()
    return query


def staged_rows(
    spark: SparkSession,
    path: str,
    keys: Sequence[str] = DETECTION_KEYS,
    tie_break: Sequence[Column] = (),
) -> DataFrame:
    """Stored rows, newest per key."""
    return latest_by_key(spark.read.parquet(path).drop(INGEST), keys, tie_break)


def ingest_into_warehouse(
    stream: DataFrame,
    root: str,
    checkpoint: str,
    places: DataFrame,
    shape: Callable[[DataFrame, int], DataFrame],
):
    """Load everything new since the last run into staging, dimensions and facts, then stop.

    ``shape`` turns a micro-batch into staged detections. Staging keeps the newest row per key and
    the touched days whose facts differ are rebuilt, so a replayed micro-batch changes nothing.
    """

    def load(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # The micro-batch is computed once; everything after reads the stored copy.
        with scratch(spark, "micro-batch") as path:
            shape(batch, number).write.parquet(path)
            rows = spark.read.parquet(path)
            if rows.isEmpty():
                return
            load_staging(spark, root, {"staging_detection": rows})
            follow_staging(spark, root, rows.select(F.col("acq_date").try_cast("date")), places, f"stream-{number}")

    query = (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(load)
        .start()
    )
    query.awaitTermination()
    return query
