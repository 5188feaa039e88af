"""Ranked search against scores computed document by document, and its edges."""

import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermalcube.llm import lexical_search

WORD = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")


def brute(docs, items, k):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parsed = [(i, collections.Counter(WORD.findall((t or "").translate(lower)))) for i, t in docs]
    parsed = [(i, c) for i, c in parsed if c]
    n_docs, n_terms = len(parsed), sum(sum(c.values()) for _, c in parsed)
    df = collections.Counter(t for _, c in parsed for t in c)
    asked = collections.defaultdict(set)
    for item, text in items:
        asked[item] |= set(WORD.findall((text or "").translate(lower)))
    out = []
    for item, terms in asked.items():
        scored = []
        for doc, counts in parsed:
            m = 50 + 50 * sum(counts.values()) * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 20 * m))
                for t in terms if t in counts
            )
            if score > 0:
                scored.append((-score, doc is None, doc))
        out += [(item, rank + 1, doc, -s) for rank, (s, _, doc) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, k, **more):
    left = spark.createDataFrame(docs, "doc_id long, text string")
    right = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in lexical_search.search(left, right, k, **more).collect()), key=str)


def made(rng, words, n, length):
    return [" ".join(rng.choice(words, size=rng.integers(0, length))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in rng.zipf(1.3, 3000) % 400])
    docs = list(enumerate(made(rng, words, 700, 60)))
    return docs + docs[:50], list(enumerate(made(rng, words, 25, 30)))


@pytest.mark.parametrize("k", [1, 5, 50, 2000])
def test_against_scores_of_every_document(spark, corpus, k):
    assert found(spark, *corpus, k) == brute(*corpus, k)


def test_small_blocks_and_batches_give_the_same(spark, corpus, monkeypatch):
    monkeypatch.setattr(lexical_search, "BATCH_TERMS", 40)
    assert found(spark, *corpus, 7) == brute(*corpus, 7)


def test_accumulators_stop_and_scores_stay_exact(corpus):
    """The frequent terms of an item open no accumulators once the rare ones have filled the top."""
    docs, items = corpus
    terms = sorted({t for _, text in docs for t in lexical_search.terms_of(text)})
    numbers = {t: i for i, t in enumerate(terms)}

    class Held:
        value = numbers

    import pyarrow as pa

    batch = pa.record_batch([pa.array([i for i, _ in docs], pa.int64()), pa.array([t for _, t in docs])], names=["i", "t"])
    (row,) = [r for b in lexical_search._indexer(Held)(iter([batch])) for r in b.to_pylist()]
    block = lexical_search.Postings(row, row["n_docs"], row["n_terms"])
    df = dict(zip(np.frombuffer(row["terms"], "<i4").tolist(), np.frombuffer(row["counts"], "<i4").tolist()))
    fewer = 0
    for _, text in items:
        weighted = [(lexical_search.weight(row["n_docs"], df[numbers[t]]), numbers[t]) for t in set(lexical_search.terms_of(text)) if t in numbers]
        scores = np.zeros(len(block.ids), dtype=np.int64)
        for w, t in weighted:
            rows, parts, _ = block.list_of(t)
            scores[rows] += w * parts
        got, own = lexical_search.search_block(block, weighted, 3)
        want = sorted(np.flatnonzero(scores), key=lambda i: (-scores[i], block.ids[i]))[:3]
        assert [block.ids[i] for i in got] == [block.ids[i] for i in want] and own.tolist() == scores[want].tolist()
        opened = np.zeros(len(scores), dtype=bool)
        rest = sum(w * block.list_of(t)[2] for w, t in weighted)
        partial = np.zeros_like(scores)
        for w, t in sorted(weighted, reverse=True):
            rows, parts, most = block.list_of(t)
            if rest < np.sort(partial)[-3]:
                break
            opened[rows] = True
            partial[rows] += w * parts
            rest -= w * most
        fewer += opened.sum() < (scores > 0).sum()
    assert fewer > 0


ROWS = [
    (1, "One two THREE"), (1, "One two THREE"), (2, None), (3, ""), (4, " ,.; "), (None, "two é2 İ"), (None, "two é2 İ"),
    (5, "two " * 200_000 + "rare"), (6, "x_y one-two"),
]


def test_edges(spark):
    items = [(1, "three TWO two"), (2, None), (3, ""), (None, "É2 é2 İ one"), (4, "nowhere"), (5, "rare one"), (5, "x"), (5, "x")]
    assert found(spark, ROWS, items, 3) == brute(ROWS, items, 3)
    assert found(spark, [], items, 3) == [] and found(spark, ROWS, [], 3) == [] and found(spark, [(1, None)], items, 3) == []


def test_clashing_names(spark):
    clash = {c: F.lit("x") for c in ("rank", "score", "terms", "ids", "n_docs", "item", "df")}
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns(clash).withColumn("item_id", F.lit("x"))
    items = spark.createDataFrame([(1, "two one")], "item_id long, text string").withColumns(clash).withColumn("doc_id", F.lit("x"))
    got = sorted((tuple(r) for r in lexical_search.search(docs, items, 4).collect()), key=str)
    assert got == brute(ROWS, [(1, "two one")], 4)
