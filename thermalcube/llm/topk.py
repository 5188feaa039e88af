"""Exact top-k inner products by sorted lists read in order, without random access."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from thermalcube.llm.common import stored

BLOCK_ROWS = 2048
QUERY_ROWS = 256
#: Blocks that a task of the search goes through, and query blocks that it holds.
TASK_BLOCKS = 32
TASK_QUERY_BLOCKS = 32
#: Parts of the lists read before the bounds are looked at again.
DEPTHS = (1 / 8, 1 / 2, 1.0)
#: By kind of number, the integers up to which each is held as it is.
EXACT = {np.float32: 2**24, np.float64: 2**53}
#: The floor of a query that has not found k rows yet.
NO_FLOOR = -(2**63)


def _packer(size: int):
    """Rows of a task as blocks of ids and 64-bit components, each block of one dimension."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, rows = TaskContext.get().partitionId(), 0, {}, 0

        def block(d):
            nonlocal number, rows
            ids, parts = held.pop(d)
            out = pa.record_batch(
                [
                    pa.array([part << 32 | number], pa.int64()), pa.array([d], pa.int32()),
                    pa.array([np.array(ids, dtype="<i8").tobytes()], pa.binary()),
                    pa.array([np.array(parts, dtype="<i8").tobytes()], pa.binary()),
                ],
                names=["block", "d", "ids", "parts"],
            )
            number, rows = number + 1, rows - len(ids)
            return out

        for batch in batches:
            for key, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, parts = held.setdefault(len(vector), ([], []))
                ids.append(key)
                parts.append(vector)
                rows += 1
                if len(ids) == size:
                    yield block(len(vector))
                elif rows == 4 * size:  # of many dimensions
                    yield block(max(held, key=lambda d: len(held[d][0])))
        for d in sorted(held):
            yield block(d)

    return pack


class SortedLists:
    """One list per component of a block of vectors, sorted by it; read from the top for positive
    weights and from the bottom for negative ones."""

    def __init__(self, vectors: np.ndarray, kind: type = np.float64):
        self.vectors, self.kind = vectors.astype(kind), kind
        self.order = np.sort(self.vectors, axis=0)
        # Equal components share a place, so that what a reader has seen depends on the value alone.
        self.worst, self.best = self.order[0], self.order[-1]

    def bounds(self, up: np.ndarray, down: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all scores (rows by queries) after ``depth`` places of each list.

        A component seen counts as it is. One unseen lies between the end of its list and the place
        reached. ``up`` and ``down`` hold the positive and negative weights of the queries.
        """
        x, reached_up, reached_down = self.vectors, self.order[len(self.vectors) - depth], self.order[depth - 1]
        lower = np.where(x >= reached_up, x, self.worst) @ up + np.where(x <= reached_down, x, self.best) @ down
        return lower, self.upper_bounds(up, down, depth)

    def upper_bounds(self, up: np.ndarray, down: np.ndarray, depth: int) -> np.ndarray:
        """The upper bounds alone: a component unseen counts as the place reached."""
        reached_up, reached_down = self.order[len(self.vectors) - depth], self.order[depth - 1]
        return np.maximum(self.vectors, reached_up) @ up + np.minimum(self.vectors, reached_down) @ down


def _kth_highest(values: np.ndarray, k: int) -> np.ndarray:
    n = len(values)
    ordered = np.sort(values, axis=0) if values.dtype == object else np.partition(values, n - k, axis=0)
    return ordered[n - k]


def _highest(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], dtype=np.int64)
    return np.lexsort((ids, -scores))[:k]


def _widest(vectors: np.ndarray) -> float:
    return float(np.abs(vectors.astype(np.float64)).max(initial=0.0))


def _to_reach(floors: np.ndarray, kind: type) -> np.ndarray:
    """Floors as numbers of a kind; those beyond the exact integers of a kind lie beyond its scores as well."""
    if kind is object:
        return np.array([-np.inf if f == NO_FLOOR else f for f in floors.tolist()], dtype=object)
    reach = np.clip(floors, -EXACT[kind], EXACT[kind]).astype(kind)
    reach[floors == NO_FLOOR] = -np.inf
    return reach


def top_scores(
    lists: SortedLists, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, floors: np.ndarray | None = None
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores) of the k best rows of a block for each query, ties to smaller ids.

    The lists are read in steps. After a step, a query's k-th highest lower bound is what an outsider
    has to reach; once at most a quarter of the rows can, their scores are resolved and the reading stops for
    that query. ``floors`` has the k-th best score that each query found in other blocks: rows below it are
    left out, and where every query has one, upper bounds do until the lists are read. Scores are integers
    that ``queries`` hold exactly with all bounds (see ``_kind``), so bounds and scores are exact.
    """
    open_queries = np.arange(len(queries))
    n = len(ids)
    floors = np.full(len(queries), NO_FLOOR) if floors is None else floors
    reach, floored = _to_reach(floors, lists.kind), bool((floors != NO_FLOOR).all())
    for part in DEPTHS:
        depth = max(1, int(n * part))
        weights = queries[open_queries].T
        up, down = np.maximum(weights, 0), np.minimum(weights, 0)
        own = ids[:, None] == query_ids[open_queries][None, :]
        need = reach[open_queries]
        if floored and depth < n:
            upper = lists.upper_bounds(up, down, depth)
        else:
            lower, upper = lists.bounds(up, down, depth)
            lower[own] = -np.inf
            if n > k:
                need = np.maximum(need, _kth_highest(lower, k))
        inside = (upper >= need) & ~own
        counts = inside.sum(axis=0)
        few = counts <= max(4 * k, n // 4) if depth < n else np.ones(len(open_queries), dtype=bool)
        for at in np.flatnonzero(few & (counts > 0)).tolist():
            query, rows = int(open_queries[at]), np.flatnonzero(inside[:, at])
            scores = lists.vectors[rows] @ queries[query]
            reached = scores >= need[at]
            rows, scores = rows[reached], scores[reached]
            if len(rows):
                best = _highest(ids[rows], scores, k)
                yield query, ids[rows[best]], scores[best]
        open_queries = open_queries[~few]
        if not len(open_queries):
            return


def _kind(widest: float) -> type:
    """The smallest numbers that hold every sum of products up to ``widest`` exactly; beyond doubles, Python's integers."""
    return next((kind for kind, most in EXACT.items() if widest < most / 2), object)


class _Best:
    """The k best rows of the queries of a block over all blocks seen, by score within 64 bits, then id."""

    def __init__(self, query_ids: np.ndarray, k: int):
        self.query_ids, self.k = query_ids.copy(), k
        self.ids, self.scores = [[np.empty(0, dtype=np.int64)] * len(query_ids) for _ in range(2)]
        self.floors = np.full(len(query_ids), NO_FLOOR)

    def add(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        longs = np.array([min(max(int(x), -(2**63)), 2**63 - 1) for x in scores.tolist()], dtype=np.int64)
        ids, longs = np.concatenate([self.ids[query], ids]), np.concatenate([self.scores[query], longs])
        # ~x is -1 - x, which no long leaves.
        best = np.lexsort((ids, ~longs))[: self.k]
        self.ids[query], self.scores[query] = ids[best], longs[best]
        if len(best) == self.k:
            self.floors[query] = longs[best[-1]]

    def rows(self) -> pa.RecordBatch:
        counts = [len(x) for x in self.ids]
        columns = np.repeat(self.query_ids, counts), np.concatenate(self.ids), np.concatenate(self.scores)
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])


def _numbers(batch: pa.RecordBatch, column: str, at: int) -> np.ndarray:
    return np.frombuffer(batch.column(column)[at].as_buffer(), dtype="<i8")


def _searcher(k: int):
    """The k best rows of each query among the pairs of blocks and query blocks of a task."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lists, found = None, None, {}
        for batch in batches:
            blocks, packs = batch.column("block").to_pylist(), batch.column("pack").to_pylist()
            for at, (block, pack) in enumerate(zip(blocks, packs)):
                if held != block:
                    ids = _numbers(batch, "ids", at).copy()
                    vectors = _numbers(batch, "parts", at).reshape(len(ids), -1).copy()
                    held, lists, widest = block, {}, _widest(vectors) * vectors.shape[1]
                query_ids = _numbers(batch, "query_ids", at)
                queries = _numbers(batch, "query_parts", at).reshape(len(query_ids), -1)
                kind = _kind(widest * _widest(queries))
                if kind not in lists:
                    lists[kind] = SortedLists(vectors, kind)
                if pack not in found:
                    found[pack] = _Best(query_ids, k)
                best = found[pack]
                for query, rows, scores in top_scores(lists[kind], ids, queries.astype(kind), query_ids, k, best.floors.copy()):
                    best.add(query, rows, scores)
        for best in found.values():
            yield best.rows()

    return search


def integer_components(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, held at the ends of a long."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def _shares(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id and score of the k highest integer inner products of each query.

    Vectors are compared with queries of their own dimension. Null vectors, those with null or
    non-finite components and null keys take no part. A row is never a candidate of a query with its
    key; scores beyond 64 bits are given as the nearest long and ranked by it across blocks; rows repeated are candidates each; of queries with one key the smallest vector asks. Queries
    meet all rows block by block: vectors and queries are packed once, in blocks of one dimension, and
    each task searches some of the blocks for some of the query blocks. Neither side is broadcast or
    copied per block, so that the driver holds nothing and what is shuffled grows with the rows.
    """
    x = F.col(vector)
    usable = x.isNotNull() & F.col(key).isNotNull() & (F.size(x) > 0) & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    )
    rows = vectors.filter(usable).select(
        F.col(key).cast("long").alias("vec_id"), integer_components(x, scale).alias("parts"), is_query.alias("asks")
    )
    asked = rows.filter("asks").groupBy("vec_id").agg(F.min("parts").alias("parts"))
    schema = "block long, d int, ids binary, parts binary"
    blocks = stored(rows.select("vec_id", "parts").mapInArrow(_packer(BLOCK_ROWS), schema), "vectors")
    own = stored(asked, "queries")
    asking = own.count()
    # The queries of a part lie in one block, also where a few more were dealt to it than the others have.
    packs = own.repartition(_shares(asking, QUERY_ROWS), "vec_id").mapInArrow(_packer(2 * QUERY_ROWS), schema).select(
        F.col("block").alias("pack"), "d", F.col("ids").alias("query_ids"), F.col("parts").alias("query_parts")
    ).repartition(_shares(asking, QUERY_ROWS * TASK_QUERY_BLOCKS))
    tasks = max(vectors.sparkSession.sparkContext.defaultParallelism, _shares(blocks.count(), TASK_BLOCKS))
    # By the hint a task joins a part of the blocks with a part of the query blocks; by dimension alone, one task would have all.
    pairs = blocks.repartition(tasks, "block").join(packs.hint("shuffle_replicate_nl"), "d")
    found = pairs.drop("d").mapInArrow(_searcher(k), "query_id long, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
