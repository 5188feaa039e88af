"""Helpers shared by the operators: stored tables, words, exact ranks without one task per group."""

from __future__ import annotations

import ctypes
import pathlib
import tempfile
import zipfile
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from thermalcube.session import scratch_path, tune

#: A word: the longest run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a task turns into Python objects at once.
TEXT_BYTES = 1 << 21
#: By operator, what empties its stores in this Python worker.
STORES: dict[str, Callable[[], None]] = {}


def ready(spark: SparkSession) -> SparkSession:
    """Session settings, and the package sent to the Python workers, which may not have it installed."""
    context = spark.sparkContext
    if not getattr(context, "_thermalcube_sent", False):
        root = pathlib.Path(__file__).resolve().parents[1]
        target = pathlib.Path(tempfile.mkdtemp(prefix="thermalcube-")) / "thermalcube.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
            for file in sorted(root.rglob("*.py")):
                archive.write(file, file.relative_to(root.parent))
        context.addPyFile(str(target))
        context._thermalcube_sent = True
    return tune(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, lost by no executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def make_room() -> None:
    """Empty the stores that other operators keep in this Python worker, and hand their memory back.

    Spark gives the workers of one stage to the next, whatever they hold. Stores are filled anew when
    they are needed, so no result hangs on them. Freed memory stays with the C library until trimmed.
    """
    if not STORES:
        return
    while STORES:
        STORES.popitem()[1]()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_runs(batches: Iterator[pa.RecordBatch], column: int, run_bytes: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that hold, beside their first text in ``column``, ``run_bytes`` of text at most."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        step = np.cumsum(sizes, dtype=np.int64) // run_bytes
        edges = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), batch.num_rows]
        for begin, end in zip(edges, edges[1:]):
            yield batch.slice(begin, end - begin)


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one named ``row``, out of the way of an operator's own columns."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc32_of(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; of a null text, that of no bytes (0)."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    """Null-safe equality of columns of the same name on two sides."""
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in columns])


def lookup(left: DataFrame, right: DataFrame, columns: Sequence[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join that keeps the key columns of the left side only."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in columns else F.col(c) for c in right.columns])
    on = reduce(lambda a, b: a & b, [left[c].eqNullSafe(renamed[f"_r_{c}"]) for c in columns])
    return left.join(renamed, on, how).drop(*[f"_r_{c}" for c in columns])


def rank_in_group(df: DataFrame, groups: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Ranks 0, 1, ... of the rows of each group, by hash of ``order``, then ``order``.

    No group is ordered by one task: a group of n rows is cut into about sqrt(n) ranges of the hash,
    the ranges are counted, and rows are numbered within a range from the count of those before it.
    ``df`` is read three times, so hand in a stored table. Null groups are groups. Rows equal in
    ``order`` share a range and are numbered in any order.
    """
    sizes = df.groupBy(*groups).agg(F.ceil(F.sqrt(F.count(F.lit(1)))).alias("_ranges"))
    width = F.col("_ranges").cast("double") / F.lit(2.0**52)
    top = F.shiftrightunsigned(F.xxhash64(*order), 12).alias("_hash")
    dealt = lookup(df.withColumn("_hash", top), sizes, groups).withColumn(
        "_range", F.least(F.floor(F.col("_hash") * width), F.col("_ranges") - 1)
    ).drop("_ranges")
    keys = [*groups, "_range"]
    counts = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*groups).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(W.partitionBy(*keys).orderBy("_hash", *order))
    ranked = dealt.withColumn("_row", within)
    return lookup(ranked, offsets, keys).withColumn(out, F.col("_before") + F.col("_row") - 1).drop(
        "_hash", "_range", "_row", "_before"
    )
