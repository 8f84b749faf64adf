"""Interaction of five document filters: what each removes at each place of every order.

A document's text fails any of five conditions: A, under ``FEWEST`` words; B,
under 65 % distinct words; C, over 5 % capitals; D, a sign of ``[#$%&*|]``; E,
its text is that of a smaller id anywhere in the table.  Documents are counted
by part, the five outcomes and their labels; a part's counts are a tensor of
2 x 2 x 2 x 2 x 2.  Contracting an axis with "passes", "fails" or "either"
gives every number of every step of all 120 orders.

Texts are told apart by their SHA-256 and never shuffled.  Copies of one text
are added up before and after the shuffle by digest, so a text that a third of all
rows share is a few rows a task.  A part's group has at most 128 rows.

Null texts are empty, null sources the part ``''``.  A document without an id
never fails E and makes no other fail it; rows of one id and text do not fail
each other.  Several label rows of one id count as one that has what any of them
has.  An empty table gives no rows.  Other columns are not looked at.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echograph.sources.tables import stored

FILTERS = "ABCDE"
FEWEST = 50

_GAP = r"[\x20\x09-\x0D]+"
_COUNTS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"

#: Rows pass, fail and either of a contraction, by outcome (0: passes, 1: fails).
PASS, FAIL, EITHER = range(3)
_CHOOSE = np.array([[1, 0], [0, 1], [1, 1]], np.int64)


def _failures(text: Column) -> Column:
    """The outcomes of A to D as bits 0 to 3: they follow from the text alone."""
    words = F.array_remove(F.split(text, _GAP), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [n < FEWEST, 100 * distinct < 65 * n, 100 * capitals > 5 * F.length(text), text.rlike("[#$%&*|]")]
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def _labelled(docs: DataFrame, labels: DataFrame, id_column: str, part: str) -> DataFrame:
    """(digest, part, bits, id, n, good, toxic): rows of one id, part and text are one."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select(
        F.col(id_column).cast("long").alias("id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        _failures(text).alias("bits"),
    )
    counted = stored(narrow.groupBy("digest", "part", "bits", "id").agg(F.count(F.lit(1)).alias("n")), "texts")
    known = labels.select(F.col(id_column).cast("long").alias("id"), F.col("quality") == 1, F.col("toxic") == 1).toDF("id", "good", "toxic")
    known = known.filter("id IS NOT NULL").groupBy("id").agg(*[F.coalesce(F.max(c), F.lit(False)).alias(c) for c in ("good", "toxic")])
    joined = counted.filter("id IS NOT NULL").join(known, "id", "left").na.fill(False, ["good", "toxic"])
    unknown = counted.filter("id IS NULL").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    return joined.unionByName(unknown)


def outcomes(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", part: str = "source") -> DataFrame:
    """(part, bits, good, toxic, n): documents by outcome; bit 4 is E."""
    cell = ["digest", "part", "bits", "good", "toxic"]
    rows = _labelled(docs, labels, id_column, part)
    cells = rows.groupBy(*cell, F.col("id").isNull().alias("unknown")).agg(
        F.sum("n").alias("n"), F.min("id").alias("least"), F.min_by("n", "id").alias("n_least")
    )
    first = F.min("least").over(Window.partitionBy("digest"))
    cells = cells.withColumn("first", first)
    originals = F.when(F.col("unknown"), F.col("n")).when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    split = F.array(F.struct(F.lit(0).alias("copy"), originals.alias("n")), F.struct(F.lit(16).alias("copy"), (F.col("n") - originals).alias("n")))
    each = cells.select("part", "bits", "good", "toxic", F.inline(split)).filter("n > 0")
    return each.groupBy("part", (F.col("bits") + F.col("copy")).alias("bits"), "good", "toxic").agg(F.sum("n").alias("n"))


def contracted(tensor: np.ndarray) -> np.ndarray:
    """All 3**5 contractions of a 2x2x2x2x2 tensor: [PASS, FAIL or EITHER on each axis]."""
    return np.einsum("abcde,va,wb,xc,yd,ze->vwxyz", tensor, *[_CHOOSE] * 5, optimize=["einsum_path", (0, 1), (0, 4), (0, 3), (0, 2), (0, 1)])


def _tensor(bits: np.ndarray, n: np.ndarray) -> np.ndarray:
    flat = np.zeros(32, np.int64)
    np.add.at(flat, bits, n)
    return flat.reshape((2,) * 5).transpose()  # bit 0 is the last axis of the reshaped array


def audited_part(bits: np.ndarray, good: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    """600 rows of one part: every order and step."""
    every, of_good, of_toxic = (contracted(_tensor(bits, n * of)) for of in (np.ones_like(n), good.astype(np.int64), toxic.astype(np.int64)))
    rows, shapley = [], dict.fromkeys(range(5), 0)
    for order in permutations(range(5)):
        at = [EITHER] * 5
        for step, axis in enumerate(order, 1):
            alone = [PASS] * 5
            alone[axis] = FAIL
            at[axis] = FAIL
            here = tuple(at)
            fails = [EITHER] * 5
            fails[axis] = FAIL
            at[axis] = PASS
            removed = int(every[here])
            shapley[axis] += removed
            rows.append(
                ("".join(FILTERS[a] for a in order), step, axis, int(every[tuple(at)]), removed, int(every[tuple(fails)]) - removed, int(every[tuple(alone)]), int(of_good[here]), int(of_toxic[here]))
            )
    out = pd.DataFrame(rows, columns=["filter_order", "step", "axis", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"])
    out["shapley"] = out.pop("axis").map(shapley)
    return out


def _audit(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    found = audited_part(*(group[c].to_numpy() for c in ("bits", "good", "toxic", "n")))
    found.insert(0, "part", key[0])
    return found


def audited(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", part: str = "source") -> DataFrame:
    """One row for each part, order of the five filters and step."""
    return outcomes(docs, labels, id_column, part).groupBy("part").applyInPandas(_audit, _COUNTS)


ORACLE = r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
known AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [
           len(words) < 50,
           100 * len(list_distinct(words)) < 65 * len(words),
           100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text),
           regexp_matches(text, '[#$%&*|]'),
           coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails
  FROM docs LEFT JOIN known USING (doc_id)),
letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS f),
orders AS (
  SELECT [a.f, b.f, c.f, d.f, e.f] AS ord FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT ord, array_to_string([substr('ABCDE', x, 1) for x in ord], '') AS filter_order, s.f AS step, ord[s.f] AS axis FROM orders, letters s),
cells AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS t FROM flags GROUP BY part, fails),
parts AS (SELECT DISTINCT part FROM cells),
tried AS (
  SELECT part, filter_order, step, axis, n, g, t, fails[axis] AS failing,
         len([x for x in ord[:step - 1] if fails[x]]) > 0 AS gone,
         len([x for x in fails if x]) = 1 AS once
  FROM cells, steps),
counts AS (
  SELECT part, filter_order, step, axis,
         sum(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN NOT gone AND failing THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN gone AND failing THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN once AND failing THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN NOT gone AND failing THEN g ELSE 0 END) AS good_lost,
         sum(CASE WHEN NOT gone AND failing THEN t ELSE 0 END) AS toxic_lost
  FROM tried GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, axis) AS BIGINT) AS shapley
FROM counts
"""
