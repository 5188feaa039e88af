"""Five stages from documents to packed sequences; each reads what the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermalcube.llm import mixing, packing, simhash, toxicity, unit_dedup
from thermalcube.llm.common import ready, stored, table, whole_row
from thermalcube.llm.words import tokenizer_path

TOXIC = 0.5
NEAR = simhash.SimHash.for_similarity(0.8, words=5)


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose most toxic sentence scores below one half; the model learns from labelled ones.

    Null and empty texts stay, as do repeated rows; further columns are kept, whatever their names.
    """
    ready(spark)
    labels = table(spark, sf_dir, "labels").filter(~toxicity.held_out(F.col("doc_id")))
    rows = docs.select(whole_row(docs), "text")
    scored = toxicity.score_documents(rows, toxicity.fit_on(docs, labels))
    return scored.filter(F.col("score") < TOXIC).select("row.*")


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with five-word shingles of similarity 0.8 or more.

    Of texts without a word one stays, of repeated rows one; further columns are kept, whatever their names.
    """
    ready(spark)
    return simhash.keep_one(docs, NEAR)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document holds; documents of which nothing is left go.

    Null and empty texts stay. ``n_chars`` of a shortened text is counted anew; further columns are kept,
    whatever their names.
    """
    ready(spark)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    cleaned = unit_dedup.remove_repeats(docs, carry=tuple(others))
    kept = cleaned.filter((F.size("removed") == 0) | F.col("text").rlike(r"\S"))
    shortened = F.when(F.size("removed") == 0, F.col("n_chars")).otherwise(F.char_length("text").cast("long"))
    return kept.withColumn("n_chars", shortened).select(*docs.columns)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; rows equal in id, text and source are one document.

    Null and empty texts, of size 0, are taken with their whole source. Further columns are kept, whatever
    their names.
    """
    ready(spark)
    marked = docs.select(
        whole_row(docs), "doc_id", "source", "text",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("_id"), F.xxhash64("text", "source").alias("_mark"),
    )
    mixed = mixing.mix_sources(marked.drop("row"), carry=("_id", "_mark"))
    copies = mixed.groupBy("_id", "_mark").agg(F.sum("copies").alias("_copies"))
    taken = stored(copies.filter("_copies > 0"), "copies")
    often = marked.select("row", "_id", "_mark").dropDuplicates(["_id", "_mark"]).join(taken, ["_id", "_mark"])
    return often.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens.

    A null or empty text is its end id alone; repeated rows are packed each; further columns are left aside.
    """
    ready(spark)
    return packing.pack_documents(docs, tokenizer_path(), end_id=2)


STAGES = [
    ("toxicity", remove_toxic),
    ("near_dedup", remove_near_copies),
    ("substring_dedup", remove_repeats),
    ("mixing", mix_to_weights),
    ("packing", pack),
]

#: Fingerprints, the fitted mix and the tokenizer are beyond SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written as Parquet and read again."""
    ready(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
