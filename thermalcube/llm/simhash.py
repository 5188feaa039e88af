"""SimHash near-duplicates: fingerprints, bit-sliced comparison in buckets, components of links."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from thermalcube.llm.common import lookup, make_room, stored, whole_row
from thermalcube.llm.components import connected_components

SHINGLES_AT_ONCE = 1 << 16
BUCKET_ROWS = 512
PRINTS_AT_ONCE = 1 << 13
#: Shingles of a block of texts that are compared exactly.
BLOCK_SHINGLES = 1 << 19
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Stands for a null id, after all others.
NO_ID = 2**63 - 1


@dataclass(frozen=True)
class SimHash:
    """words: of a shingle; bits: of a fingerprint, a multiple of 64; radius: differing bits allowed.

    Where two fingerprints are compared: without ``anchors`` if they agree in one of radius + 1 bands,
    which loses no link; with ``anchors`` if the texts agree in one of so many minima of permuted
    shingle hashes, which texts of similarity s miss with the chance (1 - s) ** anchors. With a
    ``similarity`` pairs within the radius are candidates only, linked if the Jaccard similarity of
    their distinct shingles is that or more.
    """

    words: int = 3
    bits: int = 64
    radius: int = 2
    anchors: int = 0
    similarity: float = 0.0

    @staticmethod
    def for_similarity(similarity: float = 0.8, words: int = 5, bits: int = 1024, anchors: int = 6) -> SimHash:
        """Candidates by fingerprints, links by the Jaccard similarity of distinct shingles.

        Sets of like size with similarity s have the cosine 2 s / (1 + s), and a bit differs with the
        chance arccos / pi; sets of few shingles, whose majorities tie, with more. The radius is the
        largest such mean plus six standard deviations.
        """
        chance = max(math.acos(2 * similarity / (1 + similarity)) / math.pi, _few_differ(similarity))
        radius = math.floor(bits * chance + 6 * math.sqrt(bits * chance * (1 - chance)))
        return SimHash(words, bits, min(radius, bits - 1), anchors, similarity)


def _few_differ(similarity: float, most: int = 24) -> float:
    """The greatest chance that a bit differs between sets of up to ``most`` shingles in all with that similarity."""
    def ones(n: int) -> list[float]:
        return [math.comb(n, k) / 2**n for k in range(n + 1)]

    worst = 0.0
    for total in range(1, most + 1):
        for shared in range(math.ceil(similarity * total - 1e-9), total):
            for own in range((total - shared) // 2 + 1):
                other = total - shared - own
                chance = sum(
                    p * q * r
                    for i, p in enumerate(ones(shared)) for j, q in enumerate(ones(own)) for k, r in enumerate(ones(other))
                    if (2 * (i + j) > shared + own) != (2 * (i + k) > shared + other)
                )
                worst = max(worst, chance)
    return worst


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def bit_sums(h: np.ndarray) -> np.ndarray:
    """How many of the 64-bit integers of each row have each bit, lowest first.

    Every eighth bit is masked out into a byte of its own, so eight counters are summed by one addition
    and hold up to 255 integers.
    """
    rows, n = h.shape
    padded = np.zeros((rows, -(-n // 255) * 255), dtype=np.uint64)
    padded[:, :n] = h
    padded = padded.reshape(rows, -1, 255)
    out = np.empty((rows, 8, 8), dtype=np.int64)
    for k in range(8):
        eight = ((padded >> np.uint64(k)) & np.uint64(0x0101010101010101)).sum(axis=2, dtype=np.uint64)
        out[:, :, k] = eight.view(np.uint8).reshape(rows, -1, 8).sum(axis=1, dtype=np.int64)
    return out.reshape(rows, 64)


def shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the word shingles of a text, in blocks; A-Z count as a-z."""
    import xxhash

    digest, left, rest = xxhash.xxh64_intdigest, [], (text or "").encode().lower()
    first = True
    while rest:
        parts = rest.split(None, SHINGLES_AT_ONCE)
        rest = parts.pop() if len(parts) > SHINGLES_AT_ONCE else b""
        row = left + parts
        if len(row) < words:
            left = row
            continue
        joined = b" ".join(row)
        ends = np.cumsum([len(w) + 1 for w in row])
        starts = np.concatenate(([0], ends[:-1])).tolist()
        stops = (ends - 1).tolist()
        yield np.array([digest(joined[a:b], 42) for a, b in zip(starts, stops[words - 1 :])], dtype=np.uint64)
        left, first = row[len(row) - words + 1 :], False
    if first and left:
        yield np.array([digest(b" ".join(left), 42)], dtype=np.uint64)


def fingerprint(blocks: Iterator[np.ndarray], how: SimHash) -> tuple[np.ndarray, list[int]]:
    """The fingerprint as 64-bit words, first bits first, and the keys of its buckets."""
    lanes, total = how.bits // 64, 0
    sums = np.zeros((lanes, 64), dtype=np.int64)
    minima = np.full(how.anchors, ONES, dtype=np.uint64)
    further = np.arange(1, lanes, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    orders = np.arange(how.anchors, dtype=np.uint64)[:, None]
    for h in blocks:
        total += len(h)
        sums += bit_sums(np.concatenate((h[None, :], mixed(h + further))))
        if how.anchors:
            minima = np.minimum(minima, mixed(h * (2 * orders + np.uint64(3)) + orders).min(axis=1))
    bits = (2 * sums > total).astype(np.uint8)
    value = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).reshape(-1)
    if how.anchors:
        keys = mixed(minima + np.arange(how.anchors, dtype=np.uint64)).view(np.int64).tolist()
    else:
        whole, n = int.from_bytes(value.tobytes(), "little"), how.radius + 1
        edges = [how.bits * i // n for i in range(n + 1)]
        keys = []
        for i, (a, b) in enumerate(zip(edges, edges[1:])):
            band = (whole >> a) & ((1 << (b - a)) - 1)
            keys.append(band * n + i if b - a < 60 else int(mixed(np.array([band % (1 << 64)], dtype=np.uint64))[0]) >> 1)
    return value, keys


def _of_set(text: str | None, how: SimHash) -> tuple[bytes, list[int]]:
    """Fingerprint of the distinct shingles with a digest of them, so equal only for equal sets, and bucket keys."""
    import xxhash

    shingles = shingle_set(text, how.words)
    blocks = (shingles[i : i + SHINGLES_AT_ONCE] for i in range(0, len(shingles), SHINGLES_AT_ONCE))
    value, keys = fingerprint(blocks, how)
    return value[::-1].astype(">u8").tobytes() + xxhash.xxh3_128_digest(shingles.tobytes()), keys


def _fingerprints(how: SimHash, carried: int = 1):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for batch in batches:
            prints, keys = [], []
            for text in batch.column(carried):
                if how.similarity:
                    value, own = _of_set(text.as_py(), how)
                else:
                    value, own = fingerprint(shingle_hashes(text.as_py(), how.words), how)
                    value = value[::-1].astype(">u8").tobytes()
                prints.append(value)
                keys.append(own)
            own = [batch.column(i) for i in range(carried)]
            yield pa.record_batch(
                [*own, pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=[*batch.schema.names[:carried], "print", "keys"],
            )

    return run


def close_pairs(prints: np.ndarray, starts: np.ndarray, splits: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), j < i, of rows of one bucket within ``radius`` differing bits.

    ``prints``: (rows, 64-bit words); row i is compared with rows starts[i] to splits[i] - 1. Bit
    planes are stored vertically: one word holds one bit of 64 rows. A row and such a word of rows
    are one lane; 64 distances of a lane are summed at once by bit-sliced counters, two planes to a
    carry-save step, that begin so high that a distance beyond the radius overflows. Lanes whose 64
    distances all did are abandoned.
    """
    n, words = prints.shape
    padded = np.zeros((-(-n // 64) * 64, words), dtype=np.uint64)
    padded[:n] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(len(padded), -1), axis=1, bitorder="little")
    planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)
    low, high = starts // 64, np.maximum(splits - 1, starts) // 64
    spans = np.where(splits > starts, high - low + 1, 0)
    rows = np.repeat(np.arange(n), spans)
    blocks = np.arange(len(rows)) - np.repeat(np.cumsum(spans) - spans, spans) + low[rows]
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for begin in range(0, len(rows), 1 << 16):
        r, b = rows[begin : begin + (1 << 16)], blocks[begin : begin + (1 << 16)]
        size = radius.bit_length()
        start = (1 << size) - 1 - radius
        counters = [np.full(len(r), ONES if start >> k & 1 else np.uint64(0), dtype=np.uint64) for k in range(size)]
        lane = np.arange(64, dtype=np.int64)
        place = b[:, None] * 64 + lane
        valid = (place >= starts[r][:, None]) & (place < splits[r][:, None])
        over = ~np.packbits(valid, axis=1, bitorder="little").view(np.uint64).reshape(-1)
        own = bits[r] if len(r) < n else bits[:n][r]
        for plane in range(0, 64 * words, 2):
            x = planes[plane][b] ^ (np.uint64(0) - own[:, plane].astype(np.uint64))
            y = planes[plane + 1][b] ^ (np.uint64(0) - own[:, plane + 1].astype(np.uint64))
            if size:
                half = counters[0] ^ x
                carry = (counters[0] & x) | (half & y)
                counters[0] = half ^ y
                for k in range(1, size):
                    counters[k], carry = counters[k] ^ carry, counters[k] & carry
                over |= carry
            else:
                over |= x | y
            if plane % 16 == 14:
                alive = over != ONES
                if alive.sum() < 0.75 * len(alive):
                    r, b, over, own = r[alive], b[alive], over[alive], own[alive]
                    counters = [c[alive] for c in counters]
                    if not len(r):
                        break
        if len(r):
            hit = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
            which, bit = np.nonzero(hit)
            out.append((r[which], b[which] * 64 + bit))
    if not out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row reachable from each row by the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        while (jumped := new[new] != new).any():
            new = np.where(jumped, new[new], new)
        if (new == root).all():
            return root
        root = new


def _sizes(lists: pa.ListArray) -> np.ndarray:
    return np.diff(lists.offsets.to_numpy())


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of blocks in steps of some ``PRINTS_AT_ONCE`` fingerprints, so that large buckets take no more memory."""
    for batch in batches:
        step = np.cumsum(_sizes(batch.column(0)) + _sizes(batch.column(1))) // PRINTS_AT_ONCE
        edges = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), batch.num_rows]
        for begin, end in zip(edges, edges[1:]):
            if end > begin:
                yield batch.slice(begin, end - begin)


def _firsts(names: list[bytes]) -> np.ndarray:
    """The first row of the same name of each row."""
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(name, k) for k, name in enumerate(names)], dtype=np.int64)


def _named(root: np.ndarray, first: np.ndarray, names: list[bytes]) -> pa.RecordBatch:
    """Links (a, b) from each name but the first of a component to the first one."""
    linked = np.flatnonzero((first == np.arange(len(first))) & (root != first))
    return pa.record_batch(
        [pa.array([names[k] for k in root[linked].tolist()], pa.binary()), pa.array([names[k] for k in linked.tolist()], pa.binary())],
        names=["a", "b"],
    )


def _linker(how: SimHash):
    """Of lists x and y of fingerprints links of their names; names are their known roots, if given, or themselves."""
    words = how.bits // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            first, second = batch.column(0), batch.column(1)
            sizes = [_sizes(x) for x in (first, second)]
            total = sizes[0] + sizes[1]
            begin = np.cumsum(total) - total
            rows = [a + b for a, b in zip(first.to_pylist(), second.to_pylist())]
            flat = [p for row in rows for p in row]
            if not flat:
                continue
            bits = b"".join(flat) if not how.similarity else b"".join(p[: 8 * words] for p in flat)
            prints = np.frombuffer(bits, dtype=">u8").astype(np.uint64).reshape(-1, words)
            starts = np.repeat(begin, total)
            place = np.arange(len(flat))
            # A bucket in one block is compared with itself, one of two blocks across them.
            crossed = np.repeat(sizes[1] > 0, total)
            border = np.repeat(begin + sizes[0], total)
            splits = np.where(crossed, np.where(place >= border, border, starts), place)
            names = flat
            if batch.num_columns > 2:
                names = [r for pair in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()) for side in pair for r in side]
            first = _firsts(names)
            i, j = close_pairs(prints, starts, splits, how.radius)
            yield _named(_roots(len(flat), np.concatenate((i, place)), np.concatenate((j, first))), first, names)

    return run


def links(nodes: DataFrame, how: SimHash) -> DataFrame:
    """Links (a, b) that connect the fingerprints of the buckets as all their close pairs do.

    ``nodes``: distinct (print, keys).
    """
    rows = nodes.select(F.explode(F.array_distinct("keys")).alias("key"), F.struct("print").alias("node"))
    return _joined(rows, lambda x: x["print"], F.lit(0), _linker(how))


def _blocks_of(weight: Column) -> Column:
    """In how many blocks rows are cut, by their number and their shingles."""
    return F.ceil(F.sum(weight) / BLOCK_SHINGLES + F.count(F.lit(1)) / BUCKET_ROWS)


def _alone(blocks: DataFrame) -> DataFrame:
    """Blocks that are compared with themselves."""
    return blocks.filter(F.size("x") > 1).select("x", F.slice("x", 1, 0).alias("y"))


def _joined(rows: DataFrame, view: Callable[[Column], Column], weight: Column, linker: Callable) -> DataFrame:
    """Links (a, b) that connect the nodes of each key as all pairs that ``linker`` finds do.

    ``rows``: (key, node), node with its print; ``view``: what the linker sees of a list of nodes;
    ``weight``: shingles of a node. Keys beyond ``BUCKET_ROWS`` rows are cut into blocks by a hash of the
    fingerprint. Blocks are compared with themselves first. What is connected then is not compared
    again: of each component one node, another each time, is compared in blocks of such nodes, as long
    as that halves the components; the nodes that are left beside the largest component of a key
    are compared with it and with each other. So a group of like texts takes comparisons and links in
    proportion to its size, and nodes that are unlike are compared pair by pair.
    """
    def compared(pairs: DataFrame, known: bool = True) -> DataFrame:
        lists = [view(F.col(c)["node"] if known else F.col(c)).alias(c) for c in "xy"]
        roots = [F.col(c)["root"].alias(f"{c}_roots") for c in "xy" if known]
        return pairs.select(*lists, *roots).mapInArrow(linker, "a binary, b binary")

    def cut(rows: DataFrame, x: Column, spread: Column) -> DataFrame:
        sizes = rows.groupBy("key").agg(_blocks_of(weight).alias("blocks"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
        part = F.pmod(spread, F.col("blocks")).alias("part")
        return rows.join(sizes.select("key", "blocks"), "key").groupBy("key", "blocks", part).agg(F.collect_list(x).alias("x"))

    place = F.xxhash64("node.print")
    blocks = stored(cut(rows, F.col("node"), place), "blocks")
    within = stored(compared(_alone(blocks), known=False), "links")
    nodes = blocks.filter("blocks > 1").select("key", F.explode("x").alias("node")).withColumn("print", F.col("node.print"))
    if not nodes.take(1):
        return within
    roots = connected_components(within)
    found = roots.select(F.col("root").alias("a"), F.col("node").alias("b"))
    tags = nodes.select("key", "print").join(roots.withColumnRenamed("node", "print"), "print", "left")
    tags = tags.select("key", "print", F.coalesce("root", "print").alias("root"))
    seed, before = 0, 0
    while True:
        several = tags.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
        tags = stored(tags.join(several.select("key"), "key"), "tags")
        left = tags.select("key", "root").distinct().count()
        if not left:
            return found
        if seed and 2 * left > before:
            break
        spread = F.xxhash64("print", F.lit(seed))
        heads = tags.groupBy("key", "root").agg(F.min_by("print", spread).alias("print"))
        more = stored(compared(_alone(cut(nodes.join(heads, ["key", "print"]), F.struct("root", "node"), spread))), "links")
        found = found.union(more)
        merged = connected_components(more).select(F.col("node").alias("root"), F.col("root").alias("low"))
        tags = tags.join(merged, "root", "left").select("key", "print", F.coalesce("low", "root").alias("root"))
        seed, before = seed + 1, left
    largest = tags.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("key")
    largest = largest.agg(F.max_by("root", F.struct("n", "root")).alias("largest"))
    sides = nodes.join(tags, ["key", "print"]).join(largest, "key").withColumn("rest", F.col("root") != F.col("largest"))
    sizes = sides.groupBy("key", "rest").agg(_blocks_of(weight).alias("n")).groupBy("key")
    sizes = sizes.agg(F.sum(F.when(~F.col("rest"), F.col("n"))).alias("first"), F.sum("n").alias("blocks"))
    part = F.when(F.col("rest"), F.col("first") + F.pmod(place, F.col("blocks") - F.col("first"))).otherwise(F.pmod(place, F.col("first")))
    rest = sides.join(sizes, "key").groupBy("key", "first", "blocks", part.alias("part"))
    rest = stored(rest.agg(F.collect_list(F.struct("root", "node")).alias("x")), "rest")
    pairs = rest.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = pairs.filter("other <> part AND greatest(part, other) >= first").select(
        "key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "x"
    )
    two = pairs.groupBy("key", "low", "high").agg(F.sort_array(F.collect_list(F.struct("part", "x"))).alias("two")).filter(F.size("two") == 2)
    crossed = two.select(F.col("two")[0]["x"].alias("x"), F.col("two")[1]["x"].alias("y"))
    return found.union(compared(_alone(rest.filter("part >= first")).union(crossed)))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingle hashes of a text, in order."""
    return np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *shingle_hashes(text, words)]))


def _similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets, as arrays in order, have that Jaccard similarity."""
    few, many = sorted((len(a), len(b)))
    if few < similarity * many - 1e-9:
        return False
    both = np.concatenate((a, b))
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= similarity * (few + many - shared) - 1e-9


def _confirmed(i: np.ndarray, j: np.ndarray, sets: list[np.ndarray], similarity: float, root: np.ndarray) -> np.ndarray:
    """The smallest row reachable from each row by pairs that are similar; pairs already connected are not looked at.

    ``root``: the smallest row that is known to be reachable from each.
    """
    while True:
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
        if not len(i):
            return root
        first = np.unique(i, return_index=True)[1]
        good = [k for k in first.tolist() if _similar(sets[i[k]], sets[j[k]], similarity)]
        if good:
            root = _roots(len(sets), np.concatenate((np.arange(len(sets)), i[good])), np.concatenate((root, j[good])))
        rest = np.ones(len(i), dtype=bool)
        rest[first] = False
        i, j = i[rest], j[rest]


def _shingle_sets(how: SimHash):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text.as_py(), how.words).tobytes() for text in batch.column(2)]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(sets, pa.binary()), pa.array([len(x) // 8 for x in sets], pa.int64())],
                names=["root", "print", "shingles", "n"],
            )

    return run


def _exact_linker(how: SimHash):
    lanes = how.bits // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                x, y = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                flat = [r["print"] for r in x + y]
                sets = [np.frombuffer(r["shingles"], dtype=np.uint64) for r in x + y]
                prints = np.frombuffer(b"".join(p[: how.bits // 8] for p in flat), dtype=">u8").astype(np.uint64).reshape(-1, lanes)
                place = np.arange(len(flat))
                splits = np.where(place >= len(x), len(x), 0) if y else place
                i, j = close_pairs(prints, np.zeros_like(place), splits, how.radius)
                names = flat if batch.num_columns == 2 else batch.column(2)[at].as_py() + batch.column(3)[at].as_py()
                first = _firsts(names)
                yield _named(_confirmed(i, j, sets, how.similarity, first), first, names)

    return run


def exact_links(rows: DataFrame, nodes: DataFrame, roots: DataFrame, how: SimHash) -> DataFrame:
    """Links (a, b) that connect the nodes of each component of candidates as all its similar pairs do.

    ``rows``: (_id, _mark, text); ``nodes``: (print, low), low the row whose text stands for the node;
    ``roots``: (print, root) of nodes with a candidate. Only their texts are read.
    """
    asked = nodes.join(roots, "print").select("low.*", "root", "print")
    texts = rows.join(asked, ["_id", "_mark"]).dropDuplicates(["_id", "_mark", "print"]).select("root", "print", "text")
    sets = stored(texts.mapInArrow(_shingle_sets(how), "root binary, print binary, shingles binary, n long"), "shingles")
    rows = sets.select(F.col("root").alias("key"), F.struct("print", "shingles").alias("node"))
    return _joined(rows, lambda x: x, F.octet_length("node.shingles") / 8, _exact_linker(how))


def near_duplicates(docs: DataFrame, how: SimHash = SimHash(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (hex) and component_id (smallest doc_id reachable by links) of every row.

    Equal fingerprints are one node, so copies of a text cost one row each and no comparison. Texts
    without words, null ones included, have the fingerprint zero. A null doc_id has a fingerprint and
    is in a component, but is never its smallest id (null if the component has no other). Repeated
    rows give repeated rows; an empty table gives none; further columns are left aside.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if how.similarity:
        prints, placed = _placed(rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.xxhash64("text").alias("_mark"), "text"), how)
        known = F.min(F.when(F.col("low._id") < NO_ID, F.col("low._id"))).alias("component_id")
        groups = placed.join(placed.groupBy("root").agg(known), "root").select("print", "component_id")
        own = F.when(F.col("_id") < NO_ID, F.col("_id")).alias("doc_id")
        shown = F.lower(F.hex(F.substring("print", 1, how.bits // 8))).alias("fingerprint")
        return prints.join(groups, "print").select(own, shown, "component_id")
    prints = stored(rows.mapInArrow(_fingerprints(how), "doc_id long, print binary, keys array<long>"), "prints")
    nodes = stored(prints.groupBy("print").agg(F.min("doc_id").alias("low"), F.min("keys").alias("keys")), "nodes")
    roots = connected_components(links(nodes, how))
    placed = lookup(nodes.select("print", "low"), roots.withColumnRenamed("node", "print"), ["print"], "left")
    placed = placed.select("print", "low", F.coalesce("root", "print").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    groups = placed.join(lowest, "root").select("print", "component_id")
    return prints.join(groups, "print").select("doc_id", F.lower(F.hex("print")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, how: SimHash) -> DataFrame:
    """One document of each group of near-duplicates with all its columns: that of the smallest doc_id.

    Of equal ids the smallest text hash stays, of rows equal in id and text any one; a null id stays
    only where its group has no other. Null and empty texts are texts without shingles, of which one
    stays. An empty table stays empty. Further columns are kept as they are, whatever their names.
    """
    id_key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    marked = docs.select(whole_row(docs), id_key.alias("_id"), F.xxhash64("text").alias("_mark"), "text")
    kept = _kept(marked.select("_id", "_mark", "text"), how)
    alike = W.partitionBy("_id", "_mark").orderBy("text")
    only = marked.join(kept, ["_id", "_mark"]).withColumn("_row", F.row_number().over(alike))
    return only.filter("_row = 1").select("row.*")


def _kept(rows: DataFrame, how: SimHash) -> DataFrame:
    """(_id, _mark) of the first row of each component."""
    return _placed(rows, how)[1].groupBy("root").agg(F.min("low").alias("low")).select("low.*")


def _placed(rows: DataFrame, how: SimHash) -> tuple[DataFrame, DataFrame]:
    """Of rows (_id, _mark, text) the fingerprints, and (print, low, root) of each: its first row, its component's print.

    With a similarity, texts of equal shingle sets are one node, otherwise those of equal fingerprints.
    """
    prints = stored(rows.mapInArrow(_fingerprints(how, 2), "_id long, _mark long, print binary, keys array<long>"), "prints")
    nodes = stored(prints.groupBy("print").agg(F.min(F.struct("_id", "_mark")).alias("low"), F.min("keys").alias("keys")), "nodes")
    roots = connected_components(links(nodes, how)).withColumnRenamed("node", "print")
    if how.similarity:
        exact = exact_links(rows, nodes.select("print", "low"), stored(roots, "candidates"), how)
        roots = connected_components(exact).withColumnRenamed("node", "print")
    placed = nodes.select("print", "low").join(roots, "print", "left").withColumn("root", F.coalesce("root", "print"))
    return prints, placed
