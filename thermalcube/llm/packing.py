"""Packing of documents into sequences, shortest pack first over the histogram of lengths."""

from __future__ import annotations

import zlib
from bisect import insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermalcube.llm.common import make_room, rank_in_group, stored
from thermalcube.llm.words import encoder

PIECES = "doc_id long, doc_row long, start long, length long, ids_crc32 long, doc_tokens long"


def _cutter(path: str, end_id: int, length: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        encode = encoder(path).ids
        for batch in batches:
            out: list[list[int]] = [[], [], [], [], [], []]
            for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                ids = encode(text.as_py()) + end
                total = len(ids) // 4
                for start in range(0, total, length):
                    part = ids[4 * start : 4 * (start + length)]
                    for column, value in zip(out, (doc, row, start, len(part) // 4, zlib.crc32(part), total)):
                        column.append(value)
            yield pa.record_batch([pa.array(c, pa.int64()) for c in out], names=[c.split()[0] for c in PIECES.split(", ")])

    return cut


def plan_packs(histogram: dict[int, int], length: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Packing patterns as (packs, ((piece length, pieces), ...)) for a histogram of lengths.

    Lengths are placed longest first. All pieces of a length go into the open packs with the most
    room (the shortest packs), one per pack; packs of one pattern move on together, so a step costs
    one pattern at most. What fits nowhere opens new packs.
    """
    open_packs: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = defaultdict(list)
    rooms: list[int] = []

    def put(room: int, count: int, pattern: tuple[tuple[int, int], ...]) -> None:
        if not open_packs[room]:
            insort(rooms, room)
        open_packs[room].append((count, pattern))

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            if rooms and rooms[-1] >= size:
                room = rooms[-1]
                count, pattern = open_packs[room].pop()
                if not open_packs[room]:
                    rooms.pop()
                # As many of the length as the shortest pack takes before another pack is shorter.
                other = rooms[-1] if rooms else -1
                each = max(1, min(room // size, (room - max(other, 0)) // size if other >= 0 else left // count or 1))
                if left < count:
                    put(room, count - left, pattern)
                    count, each = left, 1
                each = min(each, left // count)
                if pattern and pattern[-1][0] == size:
                    pattern = (*pattern[:-1], (size, pattern[-1][1] + each))
                else:
                    pattern = (*pattern, (size, each))
                put(room - size * each, count, pattern)
                left -= count * each
            else:
                put(length - size, left, ((size, 1),))
                left = 0
    merged: Counter = Counter()
    for packs in open_packs.values():
        for count, pattern in packs:
            merged[pattern] += count
    return [(n, pattern) for pattern, n in sorted(merged.items(), reverse=True)]


def _placer(plan: list[tuple[int, tuple[tuple[int, int], ...]]]):
    """Sequence and offset of a piece from its length and its rank among the pieces of that length."""
    slots = defaultdict(list)
    taken: Counter = Counter()
    sequence = 0
    for packs, pattern in plan:
        at = 0
        for size, each in pattern:
            slots[size].append((taken[size], sequence, at, each))
            taken[size] += packs * each
            at += size * each
        sequence += packs
    tables = {size: np.array(rows, dtype=np.int64) for size, rows in slots.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("length").to_numpy()
            ranks = batch.column("_rank").to_numpy()
            sequences, offsets = np.zeros_like(sizes), np.zeros_like(sizes)
            order = np.argsort(sizes, kind="stable")
            distinct, first = np.unique(sizes[order], return_index=True)
            for size, rows in zip(distinct.tolist(), np.split(order, first[1:])):
                table = tables[size]
                slot = table[np.searchsorted(table[:, 0], ranks[rows], side="right") - 1]
                within = ranks[rows] - slot[:, 0]
                sequences[rows] = slot[:, 1] + within // slot[:, 3]
                offsets[rows] = slot[:, 2] + within % slot[:, 3] * size
            kept = batch.drop_columns(["_rank"])
            yield kept.append_column("sequence_id", pa.array(sequences)).append_column("offset", pa.array(offsets))

    return place


def pack_documents(
    docs: DataFrame, path: str, end_id: int, length: int = 4096, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Place every id of every document in exactly one piece, and pieces in sequences of ``length``.

    A document is its ids and ``end_id`` (a null or empty text: that id alone). Documents are cut
    every ``length`` ids; the histogram of piece lengths, at most ``length`` counts, is packed on the
    driver, and the patterns are joined back to the pieces by their rank in their length. Returns
    doc_id, start, length, ids_crc32, doc_tokens, sequence_id (gapless from 0), offset. Rows repeated
    are packed each for itself; an empty table gives no rows.
    """
    rows = docs.select(F.col(key).cast("long"), F.monotonically_increasing_id(), F.col(text))
    pieces = stored(rows.mapInArrow(_cutter(path, end_id, length), PIECES), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = ["doc_id", "start", "ids_crc32", "doc_tokens", "doc_row"]
    ranked = rank_in_group(pieces, ["length"], order, "_rank").drop("doc_row")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked.mapInArrow(_placer(plan_packs(histogram, length)), schema)
