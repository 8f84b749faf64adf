"""Mixing sources to target weights by subset-sum budget fitting.

A document's size is its number of words.  Each source gets a target; a target
beyond the source's size takes every document once and fits the rest.  The fit
is a bounded knapsack over the histogram of sizes: the same part of every size
first, then long documents while the rest is large, then dynamic programming
over sums for what is left.  Which documents of a size are taken is decided by
a seeded hash, so reruns agree.

Nulls: a null text has size 0, a null source is a source of its own that sorts
last, a null id is an id.  Documents of size 0 are never taken.  Repeated rows
count each for itself.  An empty table gives an empty mix.

Bounds: a source's histogram goes to one task.  ``k`` different sizes need at
least ``k * (k + 1) / 2`` words, so 10**13 words have fewer than 4.5 million of
them.  The driver sees one row for each source.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echograph.llm.rows import unused, with_row
from echograph.llm.words import WORD
from echograph.sources.tables import stored

#: Words over which sums are searched one by one.
EXACT_WORDS = 65_536
#: Buckets of the seeded order; ranks are needed in one of them only.
BUCKET_BITS = 12

_CHOSEN = "key string, size long, base long, extra long"


def size_of(text: Column) -> Column:
    """Words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycled_weights(n: int, cycle: tuple[float, ...] = (3, 1, 2)) -> list[float]:
    return [cycle[i % len(cycle)] for i in range(n)]


def fill_targets(sizes: list[int], weights: list[float], share: float, most: float = 2.0) -> list[float]:
    """Budget ``share * sum(sizes)`` by weight; none above ``most`` times its size, the excess reshared by weight."""
    budget = share * sum(sizes)
    targets = [0.0] * len(sizes)
    open_ = set(range(len(sizes)))
    while open_:
        weight = sum(weights[i] for i in open_)
        full = {i for i in open_ if weight <= 0 or budget * weights[i] / weight > most * sizes[i]}
        if not full:
            for i in open_:
                targets[i] = budget * weights[i] / weight
            break
        for i in full:
            targets[i] = float(most * sizes[i])
            budget -= targets[i]
        open_ -= full
    return targets


def fit(lengths: np.ndarray, counts: np.ndarray, budget: float, exact_words: int = EXACT_WORDS) -> np.ndarray:
    """How many documents of each length to take, so that their words come nearest to ``budget``.

    ``lengths`` are distinct and positive.
    """
    order = np.argsort(lengths)
    lengths, counts = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    total = int((lengths * counts).sum())
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    if budget >= total:
        return counts[back]
    taken = np.floor(counts * (budget / total)).astype(np.int64)
    rest = max(0, round(budget - int((taken * lengths).sum())))
    left = counts - taken
    exact = max(exact_words, int(lengths[-1]))
    for i in range(len(lengths) - 1, -1, -1):
        if rest <= exact:
            break
        k = min(int(left[i]), rest // int(lengths[i]))
        taken[i] += k
        left[i] -= k
        rest -= k * int(lengths[i])
    taken += _nearest_sum(lengths, left, rest)
    return taken[back]


def _nearest_sum(lengths: np.ndarray, left: np.ndarray, rest: int) -> np.ndarray:
    """Bounded knapsack: reachable sums as bits of one integer, and which length first reached each."""
    taken = np.zeros(len(lengths), np.int64)
    if rest <= 0:
        return taken
    most = 2 * rest  # the empty sum is as near as that
    mask = (1 << (most + 1)) - 1
    first = np.full(most + 1, -1, np.int32)
    reached = 1
    for i in range(len(lengths) - 1, -1, -1):
        length = int(lengths[i])
        copies = min(int(left[i]), most // length)
        grown, step = reached, 1
        while copies > 0:
            k = min(step, copies)
            grown |= (grown << (k * length)) & mask
            copies -= k
            step *= 2
        if grown != reached:
            fresh = (grown & ~reached).to_bytes(most // 8 + 1, "little")
            first[np.flatnonzero(np.unpackbits(np.frombuffer(fresh, np.uint8), bitorder="little")[: most + 1])] = i
            reached = grown
        if reached >> rest & 1:
            break
    sums = np.flatnonzero(first >= 0)
    sums = np.append(sums, 0)
    at = int(sums[np.argmin(np.abs(sums - rest) * 2 + (sums > rest))])
    while at > 0:
        i = first[at]
        while at > 0 and first[at] == i:
            at -= int(lengths[i])
            taken[i] += 1
    return taken


def _by_source(targets: dict[str, float], sizes: dict[str, int], exact_words: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def choose(histogram: pd.DataFrame) -> pd.DataFrame:
        key = histogram["key"].iloc[0]
        base = int(targets[key] // sizes[key]) if sizes[key] else 0
        extra = fit(histogram["size"].to_numpy(), histogram["n"].to_numpy(), targets[key] - base * sizes[key], exact_words)
        return pd.DataFrame({"key": histogram["key"], "size": histogram["size"], "base": base, "extra": extra})

    return choose


def mix_sizes(
    sized: DataFrame,
    share: float = 1.5,
    most: float = 2.0,
    weigh: Callable[[int], list[float]] = cycled_weights,
    seed: int = 17,
    exact_words: int = EXACT_WORDS,
) -> DataFrame:
    """Adds ``source_size``, ``target``, ``copies`` and ``taken`` to rows of (row, doc, source, size).

    ``sized`` is read several times: pass a stored table.  ``doc`` and
    ``row`` seed the order in which documents of a size are taken, so rows of one id are dealt like others;
    ``weigh`` gives the weights of that many sources in order.
    """
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    h = F.xxhash64(F.lit(seed), "doc", "row")
    keyed = sized.withColumns({"key": key, "h": h, "bucket": F.shiftrightunsigned(h, 64 - BUCKET_BITS)})

    found = keyed.groupBy("key").agg(F.sum("size").alias("size")).collect()  # one row for each source
    names = sorted((r["key"] for r in found), key=lambda k: (k[0] == "n", k))
    sizes = {r["key"]: int(r["size"]) for r in found}
    targets = dict(zip(names, fill_targets([sizes[k] for k in names], weigh(len(names)), share, most), strict=True))
    of_source = sized.sparkSession.createDataFrame(
        [(k, sizes[k], targets[k]) for k in names], "key string, source_size long, target double"
    )

    buckets = keyed.filter("size > 0").groupBy("key", "size", "bucket").agg(F.count("*").alias("n"))
    chosen = (
        buckets.groupBy("key", "size")
        .agg(F.sum("n").alias("n"))
        .groupBy("key")
        .applyInPandas(_by_source(targets, sizes, exact_words), _CHOSEN)
    )
    before = Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    room = F.greatest(F.lit(0), F.least("n", F.col("extra") - F.coalesce(F.sum("n").over(before), F.lit(0))))
    cuts = buckets.join(chosen, ["key", "size"]).withColumn("room", room).select("key", "size", "bucket", "base", "room")
    within = Window.partitionBy("key", "size", "bucket").orderBy("h", "row")
    copies = F.coalesce(F.col("base") + (F.row_number().over(within) <= F.col("room")).cast("long"), F.lit(0))
    return (
        keyed.join(cuts, ["key", "size", "bucket"], "left")
        .withColumn("copies", copies)
        .join(of_source, "key")
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("key", "h", "bucket", "base", "room")
    )


def sized_documents(docs: DataFrame, row: str = "doc_id", doc: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(row, doc, source, size) of each document, stored."""
    named = [F.col(row).alias("row"), F.col(doc).alias("doc"), F.col(source).cast("string").alias("source")]
    return stored(docs.select(*named, size_of(F.col(text)).alias("size")), "sized")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix, each as often as it is taken; columns as in ``docs``.

    Equal rows stay apart.
    """
    row, copy = unused(docs, "__row"), unused(docs, "__copy")
    numbered = with_row(docs, row)
    chosen = mix_sizes(sized_documents(numbered, row=row), **how).filter("copies > 0")
    copies = chosen.select(F.col("row").alias(row), F.sequence(F.lit(1).cast("long"), "copies").alias(copy))
    return numbered.join(copies, row).withColumn(copy, F.explode(copy)).select(*docs.columns)
