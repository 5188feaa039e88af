"""Deduplication: one row per key.

``row_number() = 1`` is planned with a group limit before the shuffle, so that of a hot key only
one row per input task is shuffled and no task sorts the whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from thermalcube.schemas import COORDINATE, DETECTION_DEDUP_KEYS, DETECTION_KEYS

_POSITION = "__position"
_HASH = "__key_hash"


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key; ``order`` must end in a unique tie-break."""
    kinds = dict(df.dtypes)
    parts = list(keys)
    if not any(kinds[k] in ("float", "double") for k in keys):
        # Sorting compares the first column most; a hash of the key settles nearly every
        # comparison at once, where long runs of equal text prefixes would not.
        df = df.withColumn(_HASH, F.xxhash64(*keys))
        parts = [_HASH, *keys]
    window = Window.partitionBy(*parts).orderBy(*order)
    ranked = df.withColumn(_POSITION, F.row_number().over(window))
    return ranked.filter(F.col(_POSITION) == 1).drop(_POSITION, _HASH)


def dedup_detections(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Keep the first of equal detections, if at least four of the six key columns exist."""
    keys = [c for c in DETECTION_DEDUP_KEYS if c in df.columns]
    return first_per_key(df, keys, order) if len(keys) >= 4 else df


def dedup_weather(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    keys = [c for c in (*COORDINATE, "datetime") if c in df.columns]
    return first_per_key(df, keys, order) if len(keys) >= 2 else df


def latest_by_key(
    df: DataFrame, keys: Sequence[str] = DETECTION_KEYS, tie_break: Sequence[Column] = ()
) -> DataFrame:
    """Newest ingested row of each key."""
    return first_per_key(df, keys, [F.col("ingested_at").desc(), *tie_break])


def distinct_coordinates(df: DataFrame, *also: str) -> DataFrame:
    return df.select(*COORDINATE, *also).distinct()


def distinct_satellites(df: DataFrame) -> DataFrame:
    return df.select("satelit").distinct()
