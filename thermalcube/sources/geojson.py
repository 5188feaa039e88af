"""GeoJSON features, region boundaries and binary points.

A document is either a whole FeatureCollection or a single Feature per line; the second form is
the one to land at scale, since a line is the unit Spark can split a file at.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from thermalcube.functions.geo import lat_of, lon_of, wkb_point
from thermalcube.schemas import BOUNDARY_NAME_FIELDS, FEATURE_TYPE, PLACE_LEVELS


def _documents(spark, path: str, feature: T.StructType, multi_line: bool) -> DataFrame:
    schema = T.StructType(
        [T.StructField("features", T.ArrayType(feature)), *feature.fields]
    )
    docs = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    single = F.array(F.struct(*[F.col(f.name) for f in feature.fields]))
    whole = F.when(F.col("features").isNotNull(), F.col("features")).otherwise(single)
    return docs.select(F.explode(whole).alias("feature")).select("feature.*")


def _renamed(feature: T.StructType, fields: Mapping[str, str]) -> T.StructType:
    """The feature type with properties under the names that the documents use for them."""
    known = feature["properties"].dataType
    properties = T.StructType([T.StructField(fields.get(f.name, f.name), f.dataType) for f in known])
    return T.StructType(
        [T.StructField(f.name, properties if f.name == "properties" else f.dataType) for f in feature]
    )


def read_features(
    spark: SparkSession, path: str, multi_line: bool = False, fields: Mapping[str, str] | None = None
) -> DataFrame:
    """Nested feature rows: geometry and properties.

    ``fields`` says which property of the documents holds ``detected_at``, ``detections`` or any
    other property, where its name differs.
    """
    return _documents(spark, path, _renamed(FEATURE_TYPE, fields or {}), multi_line).select(
        "type", "geometry", F.col("properties").cast(FEATURE_TYPE["properties"].dataType).alias("properties")
    )


def write_features(rows: DataFrame, path: str, fields: Mapping[str, str] | None = None) -> None:
    """Flat rows as one feature per line, with properties named as ``fields`` says."""
    nested = nest_features(rows)
    kind = _renamed(nested.schema, fields or {})
    nested.select("type", "geometry", F.col("properties").cast(kind["properties"].dataType).alias("properties")).write.json(path)


def flatten_features(features: DataFrame) -> DataFrame:
    """Flat feature rows with the column names of the cube."""
    p, place = "properties", "properties.location"
    coordinates = F.col("geometry.coordinates")
    return features.select(
        F.col(f"{p}.id").alias("id"),
        F.substring_index(F.col(f"{p}.time"), "T", 1).try_cast("date").alias("tanggal"),
        F.col(f"{p}.detected_at").try_cast("timestamp").alias("detected_at"),
        F.col(f"{p}.satellite").alias("satelit"),
        F.col(f"{p}.confidence").alias("confidence"),
        F.col(f"{p}.minggu").alias("minggu"),
        F.col(f"{place}.pulau").alias("pulau"),
        F.col(f"{place}.provinsi").alias("provinsi"),
        F.col(f"{place}.kab_kota").alias("kota"),
        F.col(f"{place}.kecamatan").alias("kecamatan"),
        F.col(f"{place}.desa").alias("desa"),
        F.coalesce(f"{p}.detections", F.lit(0).cast("bigint")).alias("detections"),
        lat_of(coordinates).alias("lat"),
        lon_of(coordinates).alias("lon"),
    )


def nest_features(rows: DataFrame) -> DataFrame:
    """Flat rows as features, the inverse of ``flatten_features``."""
    location = F.struct(
        "pulau", "provinsi", F.col("kota").alias("kab_kota"), "kecamatan", "desa"
    ).alias("location")
    return rows.select(
        F.lit("Feature").alias("type"),
        F.struct(
            F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")
        ).alias("geometry"),
        F.struct(
            F.col("id").cast("string").alias("id"),
            "minggu",
            "confidence",
            F.col("satelit").alias("satellite"),
            F.date_format("tanggal", "yyyy-MM-dd'T'00:00:00").alias("time"),
            F.date_format("detected_at", "yyyy-MM-dd'T'HH:mm:ss").alias("detected_at"),
            "detections",
            location,
        ).alias("properties"),
    )


def read_boundaries(
    spark: SparkSession, paths: Mapping[str, str], multi_line: bool = False
) -> DataFrame:
    """Region boundaries of all level files: level, name, parent name, geometry as JSON text."""
    names = [T.StructField(f, T.StringType()) for f in BOUNDARY_NAME_FIELDS.values()]
    feature = T.StructType(
        [
            # A string field keeps the geometry as the JSON text it was written in.
            T.StructField("geometry", T.StringType()),
            T.StructField("properties", T.StructType(names)),
        ]
    )
    frames = []
    for level, path in paths.items():
        position = PLACE_LEVELS.index(level)
        parent = (
            F.col(f"properties.{BOUNDARY_NAME_FIELDS[PLACE_LEVELS[position - 1]]}")
            if position
            else F.lit(None).cast("string")
        )
        frames.append(
            _documents(spark, path, feature, multi_line).select(
                F.lit(level).alias("level"),
                F.col(f"properties.{BOUNDARY_NAME_FIELDS[level]}").alias("name"),
                parent.alias("parent_name"),
                "geometry",
            )
        )
    return reduce(lambda a, b: a.unionByName(b), frames)


def decode_points(df: DataFrame, column: str) -> DataFrame:
    """Latitude and longitude of hex points; rows that hold no readable point are dropped."""
    # Out of a generator a point is decoded once for the filter and both columns.
    point = df.withColumn("__point", F.explode(F.array(wkb_point(F.col(column))))).filter(F.col("__point").isNotNull())
    return point.withColumns({"lat": F.col("__point.lat"), "lng": F.col("__point.lng")}).drop("__point")
