"""Removal of repeated lines, paragraphs and passages by hashing normalised units of text.

A unit is a line, or a part of one: lines are cut where the hash of two neighbouring words is the
smallest among seven such, every six or seven words on average. The cut depends on the words around
it alone, so a passage copied into the middle of a line is cut alike wherever it stands, but for its
first and last few words, and a paragraph is a run of units. A whole line is hashed besides its
parts, as cuts near its ends hang on the lines around it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermalcube.llm.common import lookup, make_room, stored, text_runs
from thermalcube.llm.simhash import mixed

#: A run of repeated parts of lines shorter than this stays: few words recur by chance. Whole lines go at any length.
RUN_WORDS = 20
#: Neighbouring hashes on either side that a cut's has to be the smallest of.
REACH = 3
#: Kinds of hashed rows: a part of a line, a line that is one unit, a line beside its several units.
PART, SINGLE, LINE = 0, 1, 2
LONGEST_UNIT = 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTES[SPACE] = 0


def units(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, byte ends and word counts of the units of a text in lower case."""
    data = np.frombuffer(raw, dtype=np.uint8)
    space = SPACE[data]
    inner = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = inner[::2], inner[1::2]
    none = np.zeros(0, dtype=np.int64)
    if not len(starts):
        return none, none, none
    words = np.add.reduceat(_BYTES[data], starts)
    n = len(starts)
    cut = np.ones(n, dtype=bool)
    lines = np.cumsum(data == 0x0A)
    pairs = np.full(n - 1 + 2 * REACH, np.iinfo(np.uint64).max, dtype=np.uint64)
    pairs[REACH : REACH + n - 1] = mixed(words[:-1] + words[1:] * np.uint64(3)) >> np.uint64(1)
    own = pairs[REACH : REACH + n - 1]
    before = np.minimum.reduce([pairs[k : k + n - 1] for k in range(REACH)])
    after = np.minimum.reduce([pairs[REACH + 1 + k : REACH + k + n] for k in range(REACH)])
    cut[:-1] = (lines[starts[1:]] > lines[ends[:-1] - 1]) | ((own < before) & (own <= after))
    last = np.flatnonzero(cut)
    counts = np.diff(np.concatenate(([-1], last)))
    if (counts > LONGEST_UNIT).any():
        place = np.arange(n) - np.repeat(last - counts + 1, counts)
        cut |= place % LONGEST_UNIT == LONGEST_UNIT - 1
        last = np.flatnonzero(cut)
        counts = np.diff(np.concatenate(([-1], last)))
    return starts[last - counts + 1], ends[last], counts


def line_edges(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each line with words the first of its units and the one after its last."""
    lines = np.cumsum(np.frombuffer(raw, dtype=np.uint8) == 0x0A)
    fresh = np.ones(len(starts), dtype=bool)
    fresh[1:] = lines[starts[1:]] > lines[ends[:-1] - 1]
    first = np.flatnonzero(fresh)
    return first, np.append(first[1:], len(starts))


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    make_room()
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        keys, places, kinds, hashes = [], [], [], []
        docs, marks = batch.column(0), batch.column(1)

        def flush():
            rows = np.repeat(np.array(keys, dtype=np.int64), [len(p) for p in places])
            return pa.record_batch(
                [
                    docs.take(pa.array(rows)), marks.take(pa.array(rows)),
                    pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.concatenate(kinds).astype(np.int8)),
                    pa.array(np.array(hashes, dtype=np.uint64).view(np.int64)),
                ],
                names=["doc_id", "mark", "unit", "kind", "digest"],
            )

        for i, text in enumerate(batch.column(2)):
            raw = (text.as_py() or "").encode().lower()
            starts, ends, _ = units(raw)
            if len(starts):
                first, last = line_edges(raw, starts, ends)
                several = last - first > 1
                kind = np.full(len(starts), PART)
                kind[first[~several]] = SINGLE
                first, last = first[several], last[several]
                keys.append(i)
                places.append(np.concatenate((np.arange(len(starts)), first)))
                kinds.append(np.concatenate((kind, np.full(len(first), LINE))))
                spans = zip([*starts.tolist(), *starts[first].tolist()], [*ends.tolist(), *ends[last - 1].tolist()])
                hashes += [digest(b" ".join(raw[a:b].split())) for a, b in spans]
            if len(hashes) > 100_000:
                yield flush()
                keys, places, kinds, hashes = [], [], [], []
        if hashes:
            yield flush()


CLEANED = "text string, removed array<struct<start:int,end:int>>, n_units int, n_repeated int"


def _cut(run_words: int, carried: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in text_runs(batches, carried):
            texts, removed, totals, repeats = [], [], [], []
            found = (batch.column(i).to_pylist() for i in (carried + 1, carried + 2))
            for value, again, lines in zip(batch.column(carried), *found):
                text = value.as_py()
                if not again and not lines:
                    texts.append(text)
                    removed.append([])
                    totals.append(len(units((text or "").encode().lower())[0]))
                    repeats.append(0)
                    continue
                raw = text.encode()
                starts, ends, counts = units(raw.lower())
                marked = np.zeros(len(starts) + 2, dtype=np.int8)
                marked[np.array(again, dtype=np.int64) + 1] = 1
                gone = np.zeros(len(starts) + 2, dtype=np.int8)
                for a, b in zip(*line_edges(raw, starts, ends)) if lines else ():
                    if a in lines:
                        gone[a + 1 : b + 1] = 1
                marked |= gone
                edges = np.flatnonzero(np.diff(marked))
                sums = np.concatenate(([0], np.cumsum(counts)))
                for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                    if sums[b] - sums[a] >= run_words:
                        gone[a + 1 : b + 1] = 1
                edges = np.flatnonzero(np.diff(gone))
                points = np.concatenate(([0], np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)))
                spans, kept, at = [], [], 0
                for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                    start, end = int(points[starts[a]]), int(points[ends[b - 1]])
                    kept.append(text[at:start])
                    spans.append({"start": start, "end": end})
                    at = end
                kept.append(text[at:])
                texts.append("".join(kept))
                removed.append(spans)
                totals.append(len(starts))
                repeats.append(int(marked.sum()))
            own = [batch.column(i) for i in range(carried)]
            own += [pa.array(texts, pa.string()), pa.array(removed, kind), pa.array(totals, pa.int32()), pa.array(repeats, pa.int32())]
            yield pa.record_batch(own, names=[*batch.schema.names[:carried], "text", "removed", "n_units", "n_repeated"])

    return cut


def remove_repeats(docs: DataFrame, run_words: int = RUN_WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every row with its text less what an earlier document, or the text itself earlier on, holds.

    The earliest occurrence of a line or unit, by doc_id, text hash and place, stays. Every later whole
    line goes, whatever its length; of parts of lines, runs of neighbouring repeated units with
    ``run_words`` words or more go. Returns doc_id, the ``carry`` columns,
    text (what is left; null stays null), removed (spans in code points of the original text), n_units
    and n_repeated. Case of A-Z and the kind and length of white space do not count. Rows equal in id
    and text are one document and fare alike; a null id comes first. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id"), F.xxhash64("text").alias("mark"), F.col("text"))
    found = rows.select(F.col("doc_id").cast("long"), "mark", "text").mapInArrow(
        _unit_rows, "doc_id long, mark long, unit int, kind byte, digest long"
    )
    found = stored(found, "units")
    # Counts alone are shuffled for every unit; only those of digests that recur travel on.
    several = found.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest")
    recurring = stored(found.join(several, "digest"), "recurring")
    place = F.struct("doc_id", "mark", "unit")
    firsts = recurring.groupBy("digest").agg(
        F.min(F.when(F.col("kind") != LINE, place)).alias("part"), F.min(F.when(F.col("kind") != PART, place)).alias("line")
    )
    later = recurring.join(firsts, "digest").select(
        "doc_id", "mark", "unit", ((F.col("kind") != LINE) & ~place.eqNullSafe(F.col("part"))).alias("part"),
        ((F.col("kind") != PART) & ~place.eqNullSafe(F.col("line"))).alias("line"),
    )
    again = later.filter("part OR line").groupBy("doc_id", "mark").agg(
        F.array_sort(F.collect_set(F.when(F.col("part"), F.col("unit")))).alias("again"),
        F.array_sort(F.collect_set(F.when(F.col("line"), F.col("unit")))).alias("lines"),
    )
    carried = ["doc_id", *[f"carry_{c}" for c in carry]]
    whole = docs.select("doc_id", *[F.col(c).alias(f"carry_{c}") for c in carry], F.xxhash64("text").alias("mark"), "text")
    joined = lookup(whole, again, ["doc_id", "mark"], "left").select(*carried, "text", "again", "lines")
    kinds = dict(joined.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carried) + ", " + CLEANED
    out = joined.mapInArrow(_cut(run_words, len(carried)), schema)
    return out.select("doc_id", *[F.col(f"carry_{c}").alias(c) for c in carry], "text", "removed", "n_units", "n_repeated")
