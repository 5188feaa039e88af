"""Sort orders, pages and newest rows.

Every order ends in a unique tie-break: it makes results repeatable and lets the range shuffle
split a run of equal values over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from thermalcube.functions.time import month_index

DATE_COLUMNS = ("tanggal", "properties.time")
NUMBER_COLUMNS = ("jumlah", "detections", "properties.detections")
# Pages that end beyond this row are narrowed to a range of rows before they are sorted.
TOP_K_ROWS = 100_000
# Ranges that one pass counts, and sort keys that their borders are drawn from.
RANGES = 16
SAMPLED_KEYS = 4096


def _lead(column: str) -> Column:
    """Dates as time, counts as numbers, everything else as lower-case text."""
    value = F.col(column)
    if column in DATE_COLUMNS:
        return value.try_cast("timestamp")
    if column in NUMBER_COLUMNS:
        return value.try_cast("double")
    return F.lower(value.cast("string"))


def table_order(column: str, order: str, tie_break: Sequence[str]) -> list[Column]:
    """The column's order, rows without a value last, then the tie-break."""
    value = _lead(column)
    lead = value.desc_nulls_last() if order == "desc" else value.asc_nulls_last()
    return [lead, *[F.col(c).asc() for c in tie_break]]


def sort_table(df: DataFrame, column: str, order: str, tie_break: Sequence[str]) -> DataFrame:
    return df.orderBy(*table_order(column, order, tie_break))


def page(
    df: DataFrame, column: str, order: str, tie_break: Sequence[str], number: int, size: int = 10,
    top_rows: int = TOP_K_ROWS,
) -> DataFrame:
    """Rows of page ``number`` (from 1) in table order.

    A page that ends within ``top_rows`` is one top-k. For a far one the range of rows it lies in is
    narrowed first: a bounded sample of sort keys gives borders, one pass counts the rows before each,
    and only the rows between the two borders around the page are sorted. Nothing is stored.
    """
    if number < 1 or size < 1:
        raise ValueError("pages and their size count from 1")
    skip = (number - 1) * size
    while skip + size > top_rows:
        narrowed = _narrowed(df, column, order, tie_break, skip, size)
        if narrowed is None:
            break
        df, skip = narrowed
    return df.orderBy(*table_order(column, order, tie_break)).offset(skip).limit(size)


def _before(column: str, order: str, tie_break: Sequence[str], border: Sequence[object]) -> Column:
    """Whether a row comes before a row with the sort key ``border``."""
    values = [_lead(column), *[F.col(c) for c in tie_break]]
    found, equal = F.lit(False), F.lit(True)
    for place, (value, limit) in enumerate(zip(values, border)):
        # Rows without a lead come last, those without a tie-break value first.
        if limit is None:
            earlier = value.isNotNull() if place == 0 else F.lit(False)
        elif place == 0:
            earlier = value > F.lit(limit) if order == "desc" else value < F.lit(limit)
        else:
            earlier = value.isNull() | (value < F.lit(limit))
        found = found | (equal & F.coalesce(earlier, F.lit(False)))
        equal = equal & value.eqNullSafe(F.lit(limit))
    return found


def _narrowed(
    df: DataFrame, column: str, order: str, tie_break: Sequence[str], skip: int, size: int
) -> tuple[DataFrame, int] | None:
    """The rows between two sampled borders around the page, and how many of them come before it."""
    keys = [_lead(column).alias("__lead"), *tie_break]
    sample = df.select(*keys).orderBy(F.xxhash64("__lead", *tie_break)).limit(SAMPLED_KEYS)
    lead = F.col("__lead").desc_nulls_last() if order == "desc" else F.col("__lead").asc_nulls_last()
    drawn = sample.orderBy(lead, *[F.col(c).asc() for c in tie_break]).collect()
    borders = [tuple(drawn[i]) for i in sorted({len(drawn) * k // RANGES for k in range(1, RANGES)}) if i < len(drawn)]
    if not borders:
        return None
    tests = [_before(column, order, tie_break, b) for b in borders]
    counts = list(df.agg(F.count(F.lit(1)), *[F.count_if(t) for t in tests]).first())
    total, counts = counts[0], counts[1:]
    low = max((i for i, n in enumerate(counts) if n <= skip), default=None)
    high = min((i for i, n in enumerate(counts) if n >= skip + size), default=None)
    kept, first = df, 0
    if low is not None:
        kept, first = kept.filter(~tests[low]), counts[low]
    if high is not None:
        kept = kept.filter(tests[high])
    last = counts[high] if high is not None else total
    # Borders no longer part the rows: what is left is sorted as it is.
    return (kept, skip - first) if last - first < total else None


def total_pages(df: DataFrame, size: int = 10) -> DataFrame:
    """One row: number of rows and of pages."""
    rows = F.count(F.lit(1))
    return df.agg(rows.alias("total_rows"), F.ceil(rows / size).cast("bigint").alias("total_pages"))


def latest_n(df: DataFrame, n: int = 5, tie_break: str = "id") -> DataFrame:
    """Newest detections first; rows without a time come last."""
    return df.orderBy(F.col("detected_at").desc_nulls_last(), F.col(tie_break)).limit(n)


def latest_date(df: DataFrame) -> DataFrame:
    """Date of the newest detection, and the largest date on record; unknown dates are ignored."""
    newest = F.max_by("tanggal", F.struct("detected_at", "tanggal"))
    return df.agg(newest.alias("newest_date"), F.max("tanggal").alias("largest_date"))


def time_member_ordinal(level: str, member: Column) -> Column:
    """Sort position of a time member: calendar order for months, Q1 to Q4, else the number."""
    if level == "kuartal":
        return F.substring(F.upper(member), 2, 1).try_cast("int")
    if level == "bulan":
        return month_index(member)
    return member.try_cast("int")


def time_member_order(df: DataFrame, level: str, column: str = "value") -> DataFrame:
    ordinal = time_member_ordinal(level, F.col(column))
    return df.withColumn("ordinal", ordinal).orderBy("ordinal", column)
