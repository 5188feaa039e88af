"""Document fingerprints of improbable features: rare byte windows in chained Bloom filters."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermalcube.llm.common import partitions

WINDOW = 64
CLASSES = 1001
#: Windows of less entropy (in thousandths of the most) say little and come last.
LEAST_CLASS = 100
POPULAR = 16
FILTER_BITS = 2048
FILTER_FEATURES = 160
HASHES = 5
#: Overlap up to this part of the way from chance to full counts as none.
CUT = 0.3
BUFFER_BYTES = 1 << 18
UNRANKED = 1 << 10

_TERMS = np.array([0] + [round(c * np.log2(c) * 1000) for c in range(1, WINDOW + 1)], dtype=np.int32)


def entropy_classes(data: np.ndarray) -> np.ndarray:
    """The entropy of each byte window, in thousandths of the most, rounded down.

    The first window is counted; each further one changes by the byte that leaves and the one that
    enters, whose counts come from comparing the bytes at each distance below the window's length.
    """
    n = len(data) - WINDOW + 1
    if n < 1:
        return np.zeros(0, dtype=np.int32)
    later = np.ones(len(data), dtype=np.uint8)
    earlier = np.ones(len(data), dtype=np.uint8)
    for lag in range(1, WINDOW):
        equal = (data[:-lag] == data[lag:]).view(np.uint8)
        later[:-lag] += equal
        earlier[lag:] += equal
    leaving = later[: n - 1]
    entering = earlier[WINDOW:]
    change = (_TERMS[leaving - 1] - _TERMS[leaving]) + (_TERMS[entering] - _TERMS[entering - 1])
    first = int(_TERMS[np.bincount(data[:WINDOW], minlength=256)].sum())
    sums = np.concatenate(([first], change)).cumsum(dtype=np.int64)
    # The most is log2 of the window; the terms hold thousandths of a bit per byte of the window.
    most = int(_TERMS[WINDOW])
    return ((most - sums) * (CLASSES - 1) // most).clip(0, CLASSES - 1).astype(np.int32)


def _joined(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts one behind the other, their starts and lengths, and which windows lie in one text."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    inside = np.zeros(len(data) + 1, dtype=np.int32)
    has = lengths >= WINDOW
    np.add.at(inside, starts[has], 1)
    np.add.at(inside, starts[has] + lengths[has] - WINDOW + 1, -1)
    return data, starts, lengths, inside.cumsum()[: max(0, len(data) - WINDOW + 1)] > 0


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(CLASSES, dtype=np.int64)
    for batch in batches:
        for texts in _buffers(t.as_py() for t in batch.column(0)):
            data, _, _, inside = _joined(texts)
            counts += np.bincount(entropy_classes(data)[inside], minlength=CLASSES)
    kinds = np.flatnonzero(counts)
    yield pa.record_batch([pa.array(kinds.astype(np.int32)), pa.array(counts[kinds])], names=["kind", "n"])


def _buffers(texts: Iterator[str | None]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for text in texts:
        held.append((text or "").encode())
        size += len(held[-1])
        if size >= BUFFER_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def rarity_ranks(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Rank of each entropy class by its count over all windows of all texts, the rarest first."""
    counts = docs.select(text).mapInArrow(_class_counts, "kind int, n long").groupBy("kind").agg(F.sum("n").alias("n"))
    found = np.zeros(CLASSES, dtype=np.int64)
    for row in counts.collect():  # CLASSES rows at most
        found[row["kind"]] = row["n"]
    order = sorted(range(CLASSES), key=lambda c: (c < LEAST_CLASS, found[c] == 0, found[c], c))
    ranks = np.zeros(CLASSES, dtype=np.uint32)
    ranks[order] = np.arange(CLASSES, dtype=np.uint32)
    return ranks


def _features(data: np.ndarray, inside: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """How often each window is the rarest (leftmost) of the ``WINDOW`` windows from some place on."""
    n = len(inside)
    rank = np.where(inside, ranks[entropy_classes(data)], UNRANKED)
    rank = np.concatenate((rank, np.full(WINDOW, UNRANKED))).astype(np.uint64)
    least = rank << np.uint64(40) | np.arange(len(rank), dtype=np.uint64)
    width = 1
    while width < WINDOW:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    places = (least[:n] & np.uint64((1 << 40) - 1)).astype(np.int64)[inside]
    return np.bincount(places, minlength=n)


def digests(texts: Sequence[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """Each text's filters, (filters, bytes): 160 distinct features each, in order of place.

    A text shorter than a window is one feature, the empty text too; one without a popular window has
    its rarest as the only feature.
    """
    import xxhash

    data, starts, lengths, inside = _joined(texts)
    popular = _features(data, inside, ranks) if len(inside) else np.zeros(0, dtype=np.int64)
    chosen = np.flatnonzero(popular >= POPULAR)
    low, high = np.searchsorted(chosen, starts), np.searchsorted(chosen, starts + lengths)
    digest, out = xxhash.xxh3_64_intdigest, []
    for text, start, a, b in zip(texts, starts.tolist(), low.tolist(), high.tolist()):
        if len(text) < WINDOW:
            hashes = [digest(text)]
        else:
            places = (chosen[a:b] - start).tolist() or [int(popular[start : start + len(text) - WINDOW + 1].argmax())]
            hashes = list(dict.fromkeys(digest(text[p : p + WINDOW]) for p in places))
        h = np.array(hashes, dtype=np.uint64)
        filters = np.zeros((-(-len(h) // FILTER_FEATURES), FILTER_BITS), dtype=np.uint8)
        row = np.arange(len(h)) // FILTER_FEATURES
        for k in range(HASHES):
            filters[row, (h >> np.uint64(11 * k) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = 1
        out.append(np.packbits(filters, axis=1))
    return out


def likeness(left: np.ndarray, right: np.ndarray) -> float:
    """Bit overlap of two chains, 0 to 1: each filter of the shorter against its best of the longer.

    The overlap of two filters is counted from a cut between chance and the fullest overlap.
    """
    if len(left) > len(right):
        left, right = right, left
    a, b = left.view(np.uint64), right.view(np.uint64)
    ones_a = np.bitwise_count(a).sum(axis=1, dtype=np.int64)[:, None]
    ones_b = np.bitwise_count(b).sum(axis=1, dtype=np.int64)[None, :]
    best = np.zeros(len(a))
    for i in range(len(a)):
        both = np.bitwise_count(a[i][None, :] & b).sum(axis=1, dtype=np.int64)
        most = np.minimum(ones_a[i], ones_b[0])
        chance = ones_a[i] * ones_b[0] / FILTER_BITS
        cut = chance + CUT * (most - chance)
        best[i] = np.clip((both - cut) / np.maximum(most - cut, 1e-9), 0, 1).max()
    return float(best.mean())


def encoded(filters: np.ndarray) -> str:
    return base64.b64encode(filters.tobytes()).decode()


def decoded(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), dtype=np.uint8).reshape(-1, FILTER_BITS // 8)


def fingerprints(docs: DataFrame, ranks: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fingerprint of every row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints: list[str] = []
            for texts in _buffers(t.as_py() for t in batch.column(1)):
                prints += map(encoded, digests(texts, ranks))
            yield pa.record_batch([batch.column(0), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col(key).cast("long"), text).mapInArrow(run, "doc_id long, fingerprint string")


def in_order_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (tail, doc_id, text) by ascending key in each partition, ending with the next one's first row.

    Key ranges come from quantiles of the keys, so only keys are read before the one shuffle. The
    first document of a range is sent to the range before it as well (that of the first range to the
    last), marked as tail. Null keys come first; equal keys are ordered by text.
    """
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    quantiles = rows.select("doc_id").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    borders = np.array(sorted({int(q) for q in quantiles}), dtype=np.int64)

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = np.zeros(len(ids), dtype=np.int32)
        out[known] = np.searchsorted(borders, ids[known].to_numpy(dtype=np.int64), side="right")
        return pd.Series(out)

    firsts = rows.select("doc_id", part_of("doc_id").alias("part")).groupBy("part").agg(
        F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("unknown")
    )
    heads = sorted((r["part"], None if r["unknown"] else r["low"]) for r in firsts.collect())  # one row per range
    target = {low: heads[i - 1][0] for i, (_, low) in enumerate(heads)}
    table = spark.createDataFrame(list(target.items()), "low long, part int") if target else spark.createDataFrame([], "low long, part int")
    main = rows.select(part_of("doc_id").alias("part"), F.lit(0).alias("tail"), "doc_id", "text")
    tails = rows.join(F.broadcast(table), rows["doc_id"].eqNullSafe(table["low"])).select("part", F.lit(1).alias("tail"), "doc_id", "text")
    dealt = main.union(tails).repartitionById(len(borders) + 1, "part")
    return dealt.sortWithinPartitions("tail", "doc_id", "text").drop("part")


EDITED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def compare_with_edited(docs: DataFrame, ranks: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness.

    Edited: the last floor(n / 2) code points give way to as many of the first of the next document
    by ascending key, or to all it has; after the last comes the first. A null text is empty. An
    empty table gives no rows; repeated rows are documents each.
    """

    def compare(group: list[tuple[int | None, str]]) -> pa.RecordBatch:
        texts = [t for _, t in group]
        edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, texts[1:])]
        raw, raw_edited = [t.encode() for t in texts], [t.encode() for t in edited]
        both = digests(raw + raw_edited, ranks)
        own, other = both[: len(raw)], both[len(raw) :]
        n = len(edited)
        return pa.record_batch(
            [
                pa.array([d for d, _ in group[:n]], pa.int64()),
                pa.array([len(t) for t in texts[:n]], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in raw_edited], pa.string()),
                pa.array([encoded(f) for f in own[:n]], pa.string()),
                pa.array([encoded(f) for f in other], pa.string()),
                pa.array([likeness(f, g) for f, g in zip(own, other)], pa.float64()),
                pa.array([likeness(f, g) for f, g in zip(own, own[1:])], pa.float64()),
            ],
            names=[c.split()[0] for c in EDITED.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []
        size, ended = 0, False
        for batch in batches:
            for tail, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if ended:
                    continue
                held.append((doc, text.as_py()))
                size += len(held[-1][1])
                ended = bool(tail)
                if (size >= BUFFER_BYTES or ended) and len(held) > 1:
                    yield compare(held)
                    held, size = held[-1:], 0

    return in_order_with_next(docs, key, text).mapInArrow(run, EDITED)
