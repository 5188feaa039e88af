import collections

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from thermalcube.llm import topk


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _vectors(n: int, top: int, d: int = 6) -> list[tuple[int, list[float]]]:
    rng = np.random.default_rng(5)
    return [(int(i), (rng.integers(-top, top, d) / 256).tolist()) for i in rng.permutation(n)]


def _best(rows: list[tuple[int, list[float]]], k: int = 5) -> list[tuple[int, int, int, int]]:
    parts = {i: [round(256 * c) for c in v] for i, v in rows}
    want = []
    for query in sorted(i for i in parts if i % 50 == 0):
        scores = sorted((-sum(a * b for a, b in zip(parts[query], p)), i) for i, p in parts.items() if i != query)
        want += [(query, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return want


def test_neither_side_passes_through_the_driver(spark):
    frame = spark.createDataFrame(_vectors(200, 9), "vec_id long, embedding array<float>")
    plan = _plan(topk.top_k(frame, F.col("vec_id") % 50 == 0))
    assert "CartesianProduct" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("top", [3, 2000, 300_000])
def test_rows_of_many_blocks(spark, monkeypatch, top):
    """Ties, and components whose sums need single or double precision, over blocks, query blocks and tasks."""
    for name, size in (("BLOCK_ROWS", 8), ("QUERY_ROWS", 2), ("TASK_BLOCKS", 3), ("TASK_QUERY_BLOCKS", 2)):
        monkeypatch.setattr(topk, name, size)
    rows = _vectors(700, top)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = topk.top_k(frame, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == _best(rows)


def test_vectors_of_many_dimensions(spark, monkeypatch):
    for name, size in (("BLOCK_ROWS", 4), ("QUERY_ROWS", 2), ("TASK_BLOCKS", 3), ("TASK_QUERY_BLOCKS", 2)):
        monkeypatch.setattr(topk, name, size)
    rows = [(i, v[: 1 + i % 23]) for i, v in _vectors(600, 9, 23)]
    rows += [(i, v) for i, v in _vectors(1200, 9, 2) if i >= 600]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()
    want = []
    for d in range(1, 24):
        want += _best([(i, v) for i, v in rows if len(v) == d])
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


@pytest.mark.parametrize("order", [1, -1])
def test_a_task_hands_out_k_rows_a_query(order):
    """Blocks of rising or of falling scores, of numbers of three kinds, and clamped ones at both ends."""
    ids, query_ids = np.arange(120)[::order], np.array([0, 50])
    scores = [*range(1, 41), *[x << 24 for x in range(1, 41)], *[min(x << 59, 2**62) for x in range(1, 41)]]
    vectors = np.array([[s, -1] for s in scores], dtype="<i8")
    queries = np.array([[1, 7], [-8, 0]], dtype="<i8")
    blocks = [(b, ids[b * 10 : b * 10 + 10]) for b in range(12)]
    batch = pa.record_batch(
        {
            "block": [b for b, _ in blocks], "ids": [i.astype("<i8").tobytes() for _, i in blocks],
            "parts": [vectors[i].tobytes() for _, i in blocks], "pack": [3] * 12,
            "query_ids": [query_ids.astype("<i8").tobytes()] * 12, "query_parts": [queries.tobytes()] * 12,
        }
    )
    got = collections.defaultdict(list)
    for out in topk._searcher(5)(iter([batch.slice(0, 7), batch.slice(7)])):
        for query, i, score in zip(*[c.to_pylist() for c in out.columns]):
            got[query].append((i, score))
    for query, weights in zip((0, 50), queries.tolist()):
        exact = [(sum(a * b for a, b in zip(weights, vectors[i].tolist())), i) for i in range(120) if i != query]
        best = sorted((-min(max(s, -(2**63)), 2**63 - 1), i) for s, i in exact)[:5]
        assert got[query] == [(i, -s) for s, i in best]
