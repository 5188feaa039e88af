"""Ranked lexical search, one term at a time, with a limited set of accumulators."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from thermalcube.llm.common import stored

#: A term: the longest run of digits, letters and characters beyond ASCII.
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Documents and postings after which a block of the index is closed.
BLOCK_ROWS = 16_384
BLOCK_POSTINGS = 1 << 21
#: Distinct terms and terms in all of the items that are answered in one pass over the index.
BATCH_TERMS = 1 << 17
BATCH_REFERENCES = 1 << 20
SCALE = 1_000_000_000

INDEX = "n_docs long, n_terms long, terms binary, counts binary, rows binary, tfs binary, lengths binary, ids array<long>"


def terms_of(text: str | None) -> list[str]:
    return TERM.findall(text.translate(LOWER)) if text else []


def _indexer(vocabulary):
    """Blocks of documents: for every query term in a block, the rows that hold it and how often."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, int] = vocabulary.value
        ids: list[int | None] = []
        lengths: list[int] = []
        terms, rows, tfs = [], [], []

        def block() -> pa.RecordBatch:
            which, row, tf = (np.array(x, dtype="<i8") for x in (terms, rows, tfs))
            order = np.lexsort((row, which))
            names, counts = np.unique(which, return_counts=True)
            parts = (names.astype("<i4"), counts.astype("<i4"), row[order].astype("<i4"), tf[order], np.array(lengths, dtype="<i8"))
            out = pa.record_batch(
                [
                    pa.array([len(ids)], pa.int64()), pa.array([sum(lengths)], pa.int64()),
                    *(pa.array([part.tobytes()], pa.binary()) for part in parts), pa.array([ids], pa.list_(pa.int64())),
                ],
                names=[c.split()[0] for c in INDEX.split(", ")],
            )
            for held in (ids, lengths, terms, rows, tfs):
                held.clear()
            return out

        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = terms_of(value.as_py())
                if not found:
                    continue
                for term, tf in Counter(found).items():
                    number = numbers.get(term)
                    if number is not None:
                        terms.append(number)
                        rows.append(len(ids))
                        tfs.append(tf)
                ids.append(doc)
                lengths.append(len(found))
                if len(ids) >= BLOCK_ROWS or len(terms) >= BLOCK_POSTINGS:
                    yield block()
        if ids:
            yield block()

    return index


class Postings:
    """The lists of one block with what each posting adds for a term of weight 1."""

    def __init__(self, block: dict, n_docs: int, n_terms: int):
        self.terms = {t: i for i, t in enumerate(np.frombuffer(block["terms"], dtype="<i4").tolist())}
        self.starts = np.concatenate([[0], np.cumsum(np.frombuffer(block["counts"], dtype="<i4"), dtype=np.int64)])
        self.rows = np.frombuffer(block["rows"], dtype="<i4")
        self.ids = block["ids"]
        lengths = np.frombuffer(block["lengths"], dtype="<i8")
        wide = lengths if lengths.max(initial=0) * n_docs < 2**57 else lengths.astype(object)
        norms = (50 + 50 * wide * n_docs // n_terms).astype(np.int64)
        tfs = np.frombuffer(block["tfs"], dtype="<i8")
        self.parts = SCALE * tfs // (1000 * tfs + 20 * norms[self.rows])
        self.most = np.maximum.reduceat(self.parts, self.starts[:-1]) if len(self.parts) else self.parts
        keys = np.array([2**63 - 1 if i is None else i for i in self.ids], dtype=np.int64)
        self.places = np.lexsort((np.array([i is None for i in self.ids], dtype=bool), keys))
        self.order = np.empty(len(keys), dtype=np.int64)
        self.order[self.places] = np.arange(len(keys))

    def list_of(self, term: int) -> tuple[np.ndarray, np.ndarray, int] | None:
        at = self.terms.get(term)
        if at is None:
            return None
        span = slice(self.starts[at], self.starts[at + 1])
        return self.rows[span], self.parts[span], int(self.most[at])


def search_block(block: Postings, weighted: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of the k best documents of a block; ``weighted`` holds (weight, term).

    Terms are taken rarest first. A document gets an accumulator when one of its terms is read, until
    the most that the terms still unread can add is less than the k-th partial score: a document
    without an accumulator can't qualify then, nor tie. Accumulators that exist are added to until the
    last term, so their scores are exact.
    """
    lists = [(w, *found) for w, term in sorted(weighted, reverse=True) if w > 0 and (found := block.list_of(term)) is not None]
    scores = np.zeros(len(block.ids), dtype=np.int64)
    rest = sum(w * most for w, _, _, most in lists)
    opening = True
    for w, rows, parts, most in lists:
        if opening:
            kth = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else 0
            opening = not (kth > 0 and rest < kth)
        if opening:
            scores[rows] += w * parts
        else:
            held = scores[rows] > 0
            scores[rows[held]] += w * parts[held]
        rest -= w * most
    best = np.flatnonzero(scores > 0)
    if len(best) > k:
        kth = np.partition(scores[best], len(best) - k)[len(best) - k]
        best = best[scores[best] >= kth]
    best = best[np.lexsort((block.order[best], -scores[best]))][:k]
    return best, scores[best]


def _searcher(items, weights: dict[int, int], n_docs: int, n_terms: int, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Postings(row, n_docs, n_terms)
                out: list[list] = [[], [], []]
                for item, terms in items.value:
                    rows, scores = search_block(block, [(weights[t], t) for t in terms if t in weights], k)
                    out[0] += [item] * len(rows)
                    out[1] += [block.ids[i] for i in rows.tolist()]
                    out[2] += scores.tolist()
                yield pa.record_batch([pa.array(c, pa.int64()) for c in out], names=["item_id", "doc_id", "score"])

    return search


def _batches(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[int | None, list[str]]]]:
    """Items with their distinct terms, a bounded number of terms at a time; rows of one id are one item.

    Only one batch is held by the driver. A single item with more terms than the bound is cut into parts
    nowhere: it is a batch of its own.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms_of(value.as_py()))) for value in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["item_id", "terms"])

    each = items.select(F.col(key).cast("long"), F.col(text)).mapInArrow(split, "item_id long, terms array<string>")
    merged = each.groupBy("item_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms"))
    batch, distinct, references = [], set(), 0
    for row in merged.filter(F.size("terms") > 0).orderBy("item_id").toLocalIterator():
        batch.append((row["item_id"], row["terms"]))
        distinct.update(row["terms"])
        references += len(row["terms"])
        if len(distinct) >= BATCH_TERMS or references >= BATCH_REFERENCES:
            yield batch
            batch, distinct, references = [], set(), 0
    if batch:
        yield batch


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _answer(spark: SparkSession, docs: DataFrame, batch: list[tuple[int | None, list[str]]], k: int) -> DataFrame:
    names = sorted({term for _, terms in batch for term in terms})
    numbers = {term: i for i, term in enumerate(names)}
    index = stored(docs.mapInArrow(_indexer(spark.sparkContext.broadcast(numbers)), INDEX), "postings")
    n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    if not n_docs:
        return spark.createDataFrame([], "item_id long, doc_id long, score long")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(names), dtype=np.int64)
        for part in batches:
            for terms, counts in zip(part.column(0), part.column(1)):
                total[np.frombuffer(terms.as_py(), dtype="<i4")] += np.frombuffer(counts.as_py(), dtype="<i4")
        met = np.flatnonzero(total)
        yield pa.record_batch([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], names=["term", "df"])

    counts = index.select("terms", "counts").mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weights = {row["term"]: weight(n_docs, row["df"]) for row in counts.toLocalIterator()}
    items = spark.sparkContext.broadcast([(item, [numbers[t] for t in terms]) for item, terms in batch])
    found = index.mapInArrow(_searcher(items, weights, n_docs, n_terms, k), "item_id long, doc_id long, score long")
    return stored(found, "answers")


def search(
    docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of every item.

    One pass over the documents makes blocks of postings for the terms of a batch of items and counts
    documents and terms; a second one answers every item block by block and Spark merges the blocks'
    best. A block's accumulators are 16,384 numbers; of a block and item at most k rows leave a task.

    Rows of one item id are one item with the terms of all its rows; items without a term have no rows;
    a null item id is an id. Null texts and those without a term are no documents. Repeated document
    rows are documents each, a null doc_id comes last among equals. Empty tables give no rows. Further
    columns are left aside, whatever their names.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long"), F.col(text))
    parts = [_answer(spark, rows, batch, k) for batch in _batches(items, item_key, item_text)]
    empty = spark.createDataFrame([], "item_id long, doc_id long, score long")
    found = reduce(DataFrame.unionByName, parts, empty)
    best = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
