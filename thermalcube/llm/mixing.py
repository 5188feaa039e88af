"""Mixing sources to target weights by fitting document lengths to each source's budget."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from thermalcube.llm.common import lookup, rank_in_group, stored, word_count

#: Words left for the exact fit after the proportional part: its bit sets have this many bits at most.
FIT_WORDS = 1 << 16
SEED = 42


def source_targets(sources: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """Add weight and target to (source, source_size): shares of the total by weight, none above cap sizes.

    Sources in code point order, null last, take the weights in turn. The shares that would pass
    ``cap`` times their source stop there; the rest share what is left by weight. That is the level L
    with sum(min(weight * L, cap * size)) = total: in the order of cap * size / weight, the sources
    before the first that its level does not reach are full.
    """
    place = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    table = F.array(*[F.lit(float(w)) for w in weights])
    rows = sources.withColumn("weight", F.element_at(table, (place % len(weights) + 1).cast("int")))
    rows = rows.withColumn("full", F.col("source_size") * F.lit(float(cap)))
    every = W.partitionBy()
    steps = W.orderBy(F.col("full") / F.col("weight"), F.col("source").isNull(), "source")
    before = steps.rowsBetween(W.unboundedPreceding, -1)
    after = steps.rowsBetween(W.currentRow, W.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    rows = rows.withColumn("level", level)
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("full"), F.col("level"))).over(every)
    level = F.coalesce(level, F.max("level").over(every))
    return rows.withColumn("target", F.least(F.col("weight") * level, F.col("full"))).select(
        "source", "source_size", "weight", "target"
    )


def fit_lengths(counts: dict[int, int], budget: int, seed: int = SEED, fit_words: int = FIT_WORDS) -> dict[int, int]:
    """Documents to take of each length so that their lengths sum to ``budget``, or to the nearest sum.

    Every length first gives its proportional part, rounded down. What is left is filled with single
    lengths in a seeded order while it exceeds ``fit_words``, then fitted exactly: a bounded knapsack
    over the remaining counts, whose reachable sums are the bits of one integer per step.
    """
    total = sum(n * c for n, c in counts.items())
    if budget >= total:
        return dict(counts)
    taken = {n: c * budget // total for n, c in counts.items() if n > 0}
    rest = budget - sum(n * c for n, c in taken.items())
    mix = lambda n: (n * 0x9E3779B97F4A7C15 + seed * 0xBF58476D1CE4E5B9) % (1 << 64) >> 20
    order = sorted(taken, key=lambda n: (mix(n), n))
    while rest > fit_words:
        before = rest
        for n in order:
            # One pass takes at most the part of a length that keeps the other lengths in the mix.
            more = min(counts[n] - taken[n], max(1, (counts[n] - taken[n]) // 2), (rest - fit_words // 2) // n)
            if more > 0:
                taken[n] += more
                rest -= n * more
            if rest <= fit_words:
                break
        if rest == before:
            break
    top = 2 * rest + 1
    rest_bits = (1 << (top + 1)) - 1
    reach, steps = 1, []
    for n in sorted(order):
        left, chunk = counts[n] - taken[n], 1
        while left > 0 and n * min(chunk, left) <= top:
            use = min(chunk, left)
            grown = (reach | reach << (n * use)) & rest_bits
            if grown != reach:
                steps.append((n, use, reach))
                reach = grown
            left -= use
            chunk *= 2
        if reach == rest_bits:
            break
    below = (reach & ((1 << (rest + 1)) - 1)).bit_length() - 1
    above = reach >> (rest + 1)
    above = rest + (above & -above).bit_length() if above else top + rest
    at = above if above - rest < rest - below else below
    for n, use, before in reversed(steps):
        if not before >> at & 1:
            taken[n] += use
            at -= n * use
    return taken


def _fit(frame: pd.DataFrame) -> pd.DataFrame:
    size, target = int(frame["source_size"].iloc[0]), float(frame["target"].iloc[0])
    whole = int(target // size) if size else 0
    counts = dict(zip(frame["size"].tolist(), frame["n"].tolist()))
    taken = fit_lengths(counts, round(target - whole * size)) if size else {}
    frame["whole"] = whole
    frame["extra"] = [taken.get(n, 0) for n in frame["size"].tolist()]
    return frame[["source", "size", "n", "source_size", "target", "whole", "extra"]]


FIT = "source string, size long, n long, source_size long, target double, whole long, extra long"


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3, size: Column | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, copies, taken.

    A source is taken whole as often as its target holds it; the rest of the target is fitted by the
    histogram of its lengths (one task per source sees one count per distinct length), and of each
    length the documents with the smallest seeded hash are taken once more. So no document is taken
    more than ``ceil(cap)`` times, and a rerun takes the same. Size: words unless given. Null sources
    are one source, the last; a null text has size 0 and is taken only with its whole source. Equal
    rows are documents each; an empty table gives no rows. ``carry`` names further columns to keep.
    """
    size = word_count(F.col("text")) if size is None else size
    mark = F.xxhash64(F.lit(SEED), F.col("doc_id"), F.col("text")).alias("mark")
    rows = docs.select("doc_id", "source", size.cast("long").alias("size"), mark, *[F.col(c).alias(f"carry_{c}") for c in carry])
    rows = stored(rows, "lengths")
    counts = stored(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "histogram")
    sources = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = source_targets(sources, weights, cap)
    plan = stored(lookup(counts, targets, ["source"]).drop("weight").groupBy("source").applyInPandas(_fit, FIT), "fit")
    # Only lengths of which some documents but not all are taken once more need ranks.
    some = plan.filter("extra > 0 and extra < n").drop("n")
    ranked = rank_in_group(stored(lookup(rows, some, ["source", "size"]), "some"), ["source", "size"], ["mark", "doc_id"], "rank")
    chosen = ranked.withColumn("more", (F.col("rank") < F.col("extra")).cast("long")).drop("rank", "extra")
    sure = plan.filter("extra <= 0 or extra >= n").withColumn("more", (F.col("extra") > 0).cast("long")).drop("n", "extra")
    marked = chosen.unionByName(lookup(rows, sure, ["source", "size"]))
    copies = F.col("whole") + F.col("more")
    return marked.select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
        (copies * F.col("size")).alias("taken"), *[F.col(f"carry_{c}").alias(c) for c in carry],
    )
