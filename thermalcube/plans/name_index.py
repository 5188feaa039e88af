"""Search of place names by their letters: posting lists of short letter groups over distinct names.

Two tables under one root, both in folders by a hash of their key, so that a search reads the folders
of its own letters only: ``name_letters`` (every group of one, two or three neighbouring letters of a
name, and the name in lower case) and ``name_places`` (name, its lower case, place).
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from thermalcube.plans.star import PLACE_KEY, Star
from thermalcube.schemas import PLACE_LEVELS

LETTERS = "name_letters"
PLACES = "name_places"
BUCKET = "bucket"
BUCKETS = 64
LONGEST = 3


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def letter_groups(name: Column) -> Column:
    """The distinct groups of one to three neighbouring letters of a text."""
    length = F.char_length(name)

    def of(size: int) -> Column:
        starts = F.when(length >= size, F.sequence(F.lit(1), length - (size - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substr(name, i, F.lit(size)))

    return F.array_distinct(F.concat(*[of(size) for size in range(1, LONGEST + 1)]))


def write_name_index(places: DataFrame, root: str) -> None:
    """Store the index of places (``place_key`` and the five level names); a second run replaces it.

    A name that many places share is one row per letter group; its places are rows of their own.
    """
    levels = F.array_distinct(F.array(*PLACE_LEVELS))
    named = places.select(PLACE_KEY, F.explode(levels).alias("name")).filter(F.col("name").isNotNull())
    rows = named.select("name", F.lower("name").alias("folded"), PLACE_KEY)
    _store(rows.withColumn(BUCKET, _bucket(F.col("folded"))), f"{root}/{PLACES}", "folded")
    folded = rows.select("folded").distinct()
    letters = folded.select(F.explode(letter_groups(F.col("folded"))).alias("letters"), "folded")
    _store(letters.withColumn(BUCKET, _bucket(F.col("letters"))), f"{root}/{LETTERS}", "letters")


def _store(rows: DataFrame, path: str, key: str) -> None:
    gathered = rows.hint("rebalance", F.col(BUCKET)).sortWithinPartitions(BUCKET, key)
    gathered.write.mode("overwrite").partitionBy(BUCKET).parquet(path)


def _folded(spark: SparkSession, text: str) -> str:
    """Lower case as the stored names have it; evaluated by the optimizer, without a job."""
    return spark.sql("SELECT lower(:text) AS folded", args={"text": text}).first()[0]


def _groups(text: str) -> list[str]:
    size = min(LONGEST, len(text))
    return sorted({text[i : i + size] for i in range(len(text) - size + 1)})


def find_names(spark: SparkSession, root: str, text: str) -> DataFrame:
    """Distinct names, in lower case, that contain the text, whatever its case.

    A short text is a posting list of its own. For a longer one the lists of all its letter groups are
    intersected, and names that are in all of them are verified.
    """
    folded = _folded(spark, text)
    groups = _groups(folded)
    buckets = F.array_distinct(F.array(*[_bucket(F.lit(g)) for g in groups]))
    postings = spark.read.parquet(f"{root}/{LETTERS}")
    # Foldable, so folders are chosen when the query is planned.
    met = postings.filter(F.col(BUCKET).isin(_values(spark, buckets)) & F.col("letters").isin(groups))
    if len(groups) == 1:
        return met.filter(F.contains("folded", F.lit(folded))).select("folded").distinct()
    counted = met.groupBy("folded").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter((F.col("n") == len(groups)) & F.contains("folded", F.lit(folded))).select("folded")


def _values(spark: SparkSession, array: Column) -> list[int]:
    """A constant array, evaluated by the optimizer without a job."""
    return spark.sql("SELECT 1").select(array.alias("v")).first()[0]


def find_places(spark: SparkSession, root: str, text: str) -> DataFrame:
    """Keys of the places with a name on any level that contains the text."""
    names = find_names(spark, root, text).withColumn(BUCKET, _bucket(F.col("folded")))
    found = spark.read.parquet(f"{root}/{PLACES}").join(names, [BUCKET, "folded"], "left_semi")
    return found.select(PLACE_KEY).distinct()


def places_called(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Keys of the places with exactly this name on any level; one folder is read."""
    bucket = _values(spark, F.array(_bucket(F.lower(F.lit(name)))))
    rows = spark.read.parquet(f"{root}/{PLACES}").filter(F.col(BUCKET).isin(bucket))
    return rows.filter((F.col("folded") == _folded(spark, name)) & (F.col("name") == name)).select(PLACE_KEY).distinct()


def search_star(star: Star, spark: SparkSession, root: str, text: str) -> Star:
    """The star of the detections whose place has a name that contains the text; an empty text keeps all.

    Detections are reduced by place key, before any name is joined.
    """
    if not text:
        return star
    keys = find_places(spark, root, text)
    return replace(
        star, facts=star.facts.join(keys, PLACE_KEY, "left_semi"), places=star.places.join(keys, PLACE_KEY, "left_semi"), kept=None
    )
