"""Token-id files: fixed-size blocks of ids, transposed into bit or byte planes, zstandard each.

A file holds one row per block: the file's number, the block's number, the file's count of ids
before it, its documents (start of the document in the file, id, ids in the block), the compressed
bytes of each plane (the chunk index) and the planes one behind the other. Any block can be decoded
alone. Files are written by Spark's own writer, so a lost executor leaves no half file behind.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from thermalcube.llm.common import partitions
from thermalcube.llm.words import encoder

BLOCK_IDS = 65_536
BLOCKS = (
    "shard int, block long, first_id long, n_ids int, doc_starts array<long>, doc_ids array<long>, "
    "doc_counts array<int>, plane_bytes array<int>, planes binary"
)
PIECES = "shard int, doc_start long, doc_id long, at long, n long, crc long"


def to_planes(ids: np.ndarray, kind: str = "byte", level: int = 3) -> tuple[list[int], bytes]:
    """Planes of unsigned 32-bit ids, lowest first, without the all-zero planes at the top.

    Byte planes are the default: of these vocabularies they compress to a seventh less than bit
    planes and take a quarter of the time to transpose.
    """
    import zstandard

    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    top = int(ids.max(initial=0)).bit_length()
    if kind == "byte":
        planes = np.ascontiguousarray(raw[:, : (top + 7) // 8].T)
    else:
        bits = np.unpackbits(raw, axis=1, count=top, bitorder="little") if top else raw[:, :0]
        planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    compressor = zstandard.ZstdCompressor(level=level)
    chunks = [compressor.compress(p.tobytes()) for p in planes]
    return [len(c) for c in chunks], b"".join(chunks)


def from_planes(sizes: list[int], data: bytes, n: int, kind: str = "byte") -> np.ndarray:
    import zstandard

    expand, at, planes = zstandard.ZstdDecompressor(), 0, []
    for size in sizes:
        planes.append(np.frombuffer(expand.decompress(data[at : at + size]), dtype=np.uint8))
        at += size
    raw = np.zeros((n, 4), dtype=np.uint8)
    if planes and kind == "byte":
        raw[:, : len(planes)] = np.stack(planes, axis=1)
    elif planes:
        bits = np.unpackbits(np.stack(planes), axis=1, count=n, bitorder="little")
        packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
        raw[:, : packed.shape[1]] = packed
    return raw.reshape(-1).view("<u4")


def _writer(path: str, end_id: int, kind: str, block_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = encoder(path).runs, TaskContext.get().partitionId()
        number, first, total = 0, 0, 0
        # What is not written yet: ids, and per document its start in the file, its id, and its first and last place here.
        ids = np.empty(0, dtype="<u4")
        starts = begins = ends = np.empty(0, dtype=np.int64)
        docs = pa.array([], pa.int64())

        def block(low: int, high: int) -> pa.RecordBatch:
            nonlocal number, first
            sizes, planes = to_planes(ids[low:high], kind)
            i, j = np.searchsorted(ends, low, side="right"), np.searchsorted(begins, high)
            counts = np.minimum(ends[i:j], high) - np.maximum(begins[i:j], low)
            out = pa.record_batch(
                [
                    pa.array([shard], pa.int32()), pa.array([number], pa.int64()), pa.array([first], pa.int64()),
                    pa.array([high - low], pa.int32()), _one_list(pa.array(starts[i:j])), _one_list(docs.slice(i, j - i)),
                    _one_list(pa.array(counts.astype(np.int32))), pa.array([sizes], pa.list_(pa.int32())),
                    pa.array([planes], pa.binary()),
                ],
                names=["shard", "block", "first_id", "n_ids", "doc_starts", "doc_ids", "doc_counts", "plane_bytes", "planes"],
            )
            number, first = number + 1, first + high - low
            return out

        for batch in batches:
            done = 0
            for found, counts in encode(batch.column(1)):
                closed = np.insert(found, np.cumsum(counts), np.uint32(end_id))
                stop = np.cumsum(counts + 1)
                begin = stop - (counts + 1)
                starts = np.concatenate([starts, total + begin])
                begins, ends = np.concatenate([begins, len(ids) + begin]), np.concatenate([ends, len(ids) + stop])
                docs = pa.concat_arrays([docs, batch.column(0).slice(done, len(counts))])
                ids, total, done = np.concatenate([ids, closed]), total + len(closed), done + len(counts)
                full = len(ids) - len(ids) % block_ids
                for low in range(0, full, block_ids):
                    yield block(low, low + block_ids)
                left = int(np.searchsorted(ends, full, side="right"))
                ids, docs, starts = ids[full:].copy(), docs.slice(left), starts[left:]
                begins, ends = np.maximum(begins[left:] - full, 0), ends[left:] - full
        if len(ids):
            yield block(0, len(ids))

    return write


def _one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def write_tokens(
    docs: DataFrame, folder: str, path: str, end_id: int, kind: str = "byte", block_ids: int = BLOCK_IDS,
    key: str = "doc_id", text: str = "text",
) -> None:
    """Encode whole texts, add ``end_id`` to each and write them in ascending key order.

    One range of keys becomes one file; null keys come first, equal keys are ordered by text. A null
    or empty text is the end id alone. An empty table gives a folder without blocks.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    dealt = rows.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(_writer(path, end_id, kind, block_ids), BLOCKS).write.parquet(folder)


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(folder)


def _reader(kind: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                raw = from_planes(block["plane_bytes"], block["planes"], block["n_ids"], kind).tobytes()
                ends = np.cumsum(np.array(block["doc_counts"], dtype=np.int64))
                begins = ends - block["doc_counts"]
                starts = np.array(block["doc_starts"], dtype=np.int64)
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.record_batch(
                    [
                        pa.array([block["shard"]] * len(crc), pa.int32()), pa.array(starts),
                        pa.array(block["doc_ids"], pa.int64()), pa.array(block["first_id"] + begins - starts),
                        pa.array(ends - begins), pa.array(crc, pa.int64()),
                    ],
                    names=["shard", "doc_start", "doc_id", "at", "n", "crc"],
                )

    return read


def joined_crc32(first: int, second: int, length: int) -> int:
    """CRC-32 of two byte strings one behind the other, from theirs and the second's length.

    Appending zero bytes is linear over GF(2): the matrix of one zero bit is squared up to the
    powers of two that make up the length.
    """
    matrix = [0xEDB88320] + [1 << i for i in range(31)]

    def apply(m: list[int], v: int) -> int:
        out, i = 0, 0
        while v:
            if v & 1:
                out ^= m[i]
            v, i = v >> 1, i + 1
        return out

    bits = 8 * length
    while bits:
        if bits & 1:
            first = apply(matrix, first)
        matrix = [apply(matrix, row) for row in matrix]
        bits >>= 1
    return first ^ second


def _joined_parts(parts: pd.Series) -> pd.Series:
    def one(pieces) -> int:
        crc = pieces[0]["crc"]
        for piece in pieces[1:]:
            crc = joined_crc32(crc, piece["crc"], 4 * piece["n"])
        return crc

    return parts.map(one)


def read_documents(spark: SparkSession, folder: str, kind: str = "byte") -> DataFrame:
    """Per document from its files: doc_id, start, n_tokens, ids_crc32."""
    blocks = read_blocks(spark, folder)
    pieces = blocks.mapInArrow(_reader(kind), PIECES)
    docs = pieces.groupBy("shard", "doc_start", "doc_id").agg(
        F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("at", "n", "crc"))).alias("parts")
    )
    joined = F.pandas_udf(_joined_parts, "long")
    whole = F.when(F.size("parts") == 1, F.col("parts")[0]["crc"])
    cut = docs.filter(F.size("parts") > 1).withColumn("ids_crc32", joined("parts"))
    docs = docs.filter(F.size("parts") == 1).withColumn("ids_crc32", whole).unionByName(cut)
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    files = blocks.groupBy("shard").agg(F.sum(F.col("n_ids").cast("long")).alias("ids"))
    # One row per file, and files are as many as the shuffle has partitions.
    offsets = files.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("offset"))
    return docs.join(F.broadcast(offsets), "shard").select(
        "doc_id", (F.col("offset") + F.col("doc_start")).alias("start"), "n_tokens", "ids_crc32"
    )
