"""Held-out accuracy of the toxicity model, and the pipeline's stages on planted documents."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from thermalcube.llm import toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    known = labels.filter(~toxicity.held_out(F.col("doc_id")))
    unseen = docs.join(labels.filter(toxicity.held_out(F.col("doc_id"))), "doc_id")
    return toxicity.score_documents(unseen, toxicity.fit_on(docs, known)).select("toxic", "score").toPandas()


def test_held_out_accuracy(scored):
    """With some 350 toxic documents to learn from; README gives the figures for 1,500."""
    hit = scored.score >= 0.5
    assert ((scored.toxic == 1) == hit).mean() > 0.93
    assert hit[scored.toxic == 1].mean() > 0.5
    assert hit[scored.toxic == 0].mean() < 0.01
    ranks = scored.score.rank()
    n = (scored.toxic == 1).sum()
    auc = (ranks[scored.toxic == 1].sum() - n * (n + 1) / 2) / (n * (len(scored) - n))
    assert auc > 0.88


def test_copies_and_passages_go_and_the_rest_stays(spark):
    source = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    clean = [t for t in source.text.drop_duplicates() if 150 < len(t.split()) < 700][:120]
    rng, rows = random.Random(5), []
    for i, text in enumerate(clean):
        rows.append((i, text, "en", "s1", len(text)))
    for i in range(30):
        rows.append((1000 + i, clean[i], "en", "s2", len(clean[i])))
        words = clean[30 + i].split(" ")
        words[rng.randrange(len(words))] = "changed"
        near = " ".join(words)
        rows.append((2000 + i, near, "en", "s2", len(near)))
    passages = [" ".join(clean[80 + i].split()[20:90]) for i in range(20)]
    for i, passage in enumerate(passages):
        for k in range(2):
            host = " ".join(rng.sample(clean[110].split(), 60)) + " " + passage + " " + " ".join(rng.sample(clean[111].split(), 60))
            rows.append((3000 + 2 * i + k, host, "en", "s3", len(host)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    unique = corpus_pipeline.remove_near_copies(spark, docs, SF)
    kept = {r.doc_id for r in unique.collect()}
    assert not any(1000 <= d < 3000 for d in kept)
    alone = corpus_pipeline.remove_near_copies(spark, docs.filter("doc_id < 120"), SF)
    assert {d for d in kept if d < 120} == {r.doc_id for r in alone.collect()}
    left = {r.doc_id: r for r in corpus_pipeline.remove_repeats(spark, unique, SF).collect()}
    texts = {i: t for i, t, *_ in rows}
    parts = [(len(texts[d]) - len(left[d].text)) / len(passages[(d - 3000) // 2]) for d in kept if d >= 3000]
    assert len(parts) == 40 and min(parts) > 0 and sum(parts) / len(parts) > 0.7
    assert all(left[d].n_chars == len(left[d].text) for d in kept)
