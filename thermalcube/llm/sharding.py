"""Weighted rendezvous hashing of record keys over shards, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermalcube.llm.common import crc32_of, rank_in_group, stored


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the highest score of the key; shard s has the weight ``weights[s]``.

    A shard's score is -weight / ln(u), u in (0, 1) from the XXH64 of the key's hash and the shard.
    Scores of other shards do not depend on a shard, so a new last shard only takes keys into itself,
    a removed one only gives away its own, and a shard holds keys in proportion to its weight.
    A null key is a key like any other. Equal scores go to the smaller shard.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above zero")
    table = F.array(*[F.struct(F.lit(s).cast("long").alias("s"), F.lit(float(w)).alias("w")) for s, w in enumerate(weights)])

    def score(shard: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, shard["s"]), 11)
        u = (bits.cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
        return F.struct((-shard["w"] / F.log(u)).alias("score"), (-shard["s"]).alias("s"))

    return (-F.array_max(F.transform(table, score))["s"]).cast("int")


def shard_documents(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Put every row into a shard by its key alone, with a gapless slot in the shard.

    Returns key, size (UTF-8 bytes of the text plus 16; a null text has none), text_crc32, law,
    shard, slot and grown_shard (the shard if one more shard of the mean weight joined).
    Null keys share one shard; rows with equal keys share a shard and have slots of their own; an
    empty table gives no rows; further columns are left aside, whatever their names.
    """
    grown = [*weights, sum(weights) / len(weights)]
    rows = docs.select(
        F.col(key),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 16).alias("size"),
        crc32_of(F.col(text)).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col(key), weights).alias("shard"),
        rendezvous(F.col(key), grown).alias("grown_shard"),
    )
    ranked = rank_in_group(stored(rows, "shards"), ["shard"], [key, "text_crc32", "size"], "slot")
    return ranked.select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
