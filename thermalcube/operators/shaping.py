"""Projections: tags, alignment to a stored schema, casts, defaults, unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from thermalcube.schemas import (
    BATCH_COLUMNS,
    DETECTION_COLUMNS,
    FACT_MEASURES,
    OPTIONAL_MEASURES,
    WEATHER_COLUMNS,
)


def tag_source(df: DataFrame, source: str) -> DataFrame:
    return df.withColumn("source_api", F.lit(source))


def tag_batch(df: DataFrame, batch_id: str, ingested_at: str) -> DataFrame:
    """Batch id and ingestion time to the millisecond."""
    instant = F.date_trunc("millisecond", F.lit(ingested_at).cast("timestamp"))
    return df.withColumns({"batch_id": F.lit(batch_id), "ingested_at": instant})


def all_to_string(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def union_diagonal(*frames: DataFrame) -> DataFrame:
    """Rows of all frames; columns are matched by name, a missing one is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_vertical(*frames: DataFrame) -> DataFrame:
    """Rows of frames that share one schema."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def align_detections(df: DataFrame) -> DataFrame:
    """Known columns in stored order, typed; measures a source lacks become null."""
    present = set(df.columns)
    wanted = {**BATCH_COLUMNS, **DETECTION_COLUMNS}
    out = []
    for name, kind in wanted.items():
        if name in present:
            out.append(F.col(name).try_cast(kind).alias(name))
        elif name in OPTIONAL_MEASURES:
            out.append(F.lit(None).cast(kind).alias(name))
    return df.select(*out)


def align_weather(df: DataFrame) -> DataFrame:
    """Ordered subset of the staged weather columns."""
    present = set(df.columns)
    return df.select(*[c for c in WEATHER_COLUMNS if c in present])


def _narrow(name: str) -> Column:
    kind, limits = WEATHER_COLUMNS[name]
    if limits is None:
        return F.col(name).try_cast(kind).alias(name)
    # Integers drop their fraction; a value outside the stored range becomes null.
    whole = F.col(name).try_cast("bigint")
    return F.when(whole.between(*limits), whole).cast(kind).alias(name)


def narrow_weather_types(df: DataFrame) -> DataFrame:
    """Stored integer and float types; unreadable or out-of-range values become null."""
    measures = {c for c, (kind, _) in WEATHER_COLUMNS.items() if kind not in ("string", "timestamp")}
    return df.select(*[_narrow(c) if c in measures else F.col(c) for c in df.columns])


def measure_casts(df: DataFrame) -> DataFrame:
    measures = [c for c in FACT_MEASURES if c in df.columns]
    return df.withColumns({c: F.col(c).try_cast("float") for c in measures})


def apply_defaults(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Null numbers become 0 and null texts become empty, as the stored tables have no nulls."""
    return df.fillna(0, subset=columns).fillna("", subset=columns)


def nested_path(path: str) -> Column:
    """Field by dotted path, such as ``properties.location.provinsi``."""
    head, *rest = path.split(".")
    return reduce(lambda column, name: column.getField(name), rest, F.col(head))
