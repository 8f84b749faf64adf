"""Chat formatting: logged snapshots of growing conversations collapse to the longest ones.

A log holds the same conversation after each turn.  Rolling hashes of turn
prefixes tell which conversations are the beginning of a longer one; an
anti-join keeps the maximal ones, which are then rendered.  DataFrame functions
only.

Turns are ordered by turn number, null first, then by the digest of role and
text; an exactly repeated row counts once.  Only role and text of the turns
are compared, not their numbers.  Of equal conversations the smallest id
stays; a null id is one conversation and goes last.  A null role is shown as
``unknown``, a null text as empty; null and empty texts differ.  An empty table
gives no rows.

Turns are numbered in blocks of turn numbers, so one long conversation is
spread over tasks; only its rendering, one string, is in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echograph.sources.tables import stored

#: Turn numbers in a block.
BLOCK_TURNS = 256

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _digest() -> Column:
    role, text = F.col("role"), F.col("text")
    return F.md5(
        F.concat(
            F.coalesce(F.length(role).cast("string"), F.lit("-")),
            F.lit(":"),
            F.coalesce(role, F.lit("")),
            F.coalesce(F.concat(F.lit("+"), text), F.lit("-")),
        )
    )


def rendered_turn() -> Column:
    return F.concat(
        F.lit(OPEN), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(CLOSE + "\n")
    )


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, k, p1, p2, n): hash pair of the first ``k`` turns of each conversation, which has ``n``.

    The hash of a prefix is the exclusive or of hashes of (place, turn), so
    blocks of turns are summed apart and put together.
    """
    narrow = turns.select("conv_id", "turn", _digest().alias("digest")).distinct()
    blocked = narrow.withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS))
    in_block = Window.partitionBy("conv_id", "block").orderBy("turn", "digest")
    numbered = blocked.withColumn("at", F.row_number().over(in_block).cast("long"))
    sizes = numbered.groupBy("conv_id", "block").agg(F.max("at").alias("size"))
    earlier = Window.partitionBy("conv_id").orderBy("block")
    before = earlier.rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns(
        {"before": F.coalesce(F.sum("size").over(before), F.lit(0)), "n": F.sum("size").over(Window.partitionBy("conv_id"))}
    )
    same = [F.col("l.conv_id").eqNullSafe(F.col("r.conv_id")), F.col("l.block").eqNullSafe(F.col("r.block"))]
    placed = numbered.alias("l").join(sizes.alias("r"), same).select("l.*", (F.col("before") + F.col("at")).alias("k"), "n")
    hashed = placed.withColumns({f"h{s}": F.xxhash64(F.lit(s), "k", "digest") for s in (1, 2)})
    upto = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hashed = hashed.withColumns({f"q{s}": F.bit_xor(f"h{s}").over(upto) for s in (1, 2)})
    whole = hashed.groupBy("conv_id", "block").agg(*(F.bit_xor(f"h{s}").alias(f"b{s}") for s in (1, 2)))
    whole = whole.withColumns({f"e{s}": F.coalesce(F.bit_xor(f"b{s}").over(before), F.lit(0)) for s in (1, 2)})
    rolled = hashed.alias("l").join(whole.alias("r"), same)
    return rolled.select("l.conv_id", "k", "n", *(F.col(f"q{s}").bitwiseXOR(F.col(f"e{s}")).alias(f"p{s}") for s in (1, 2)))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that no longer one begins with; one of each group of copies."""
    rolled = stored(prefixes(turns), "prefixes")
    proper = rolled.filter("k < n").select("k", "p1", "p2").distinct()
    # One row for each different conversation: copies never meet in the join.
    whole = rolled.filter("k = n").groupBy("k", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    return whole.join(proper, ["k", "p1", "p2"], "left_anti").select("conv_id", F.col("k").alias("n_turns"), "n_copies")


def rendered(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, text): maximal conversations as one text each."""
    turns = conversations.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    kept = maximal(turns)
    joined = turns.alias("l").join(kept.alias("r"), F.col("l.conv_id").eqNullSafe(F.col("r.conv_id")))
    lines = joined.select("r.conv_id", "n_turns", "n_copies", F.struct("turn", _digest().alias("digest"), rendered_turn().alias("line")).alias("t"))
    texts = lines.groupBy("conv_id", "n_turns", "n_copies").agg(F.array_sort(F.collect_set("t")).alias("ts"))
    return texts.select("conv_id", "n_turns", "n_copies", F.array_join(F.col("ts.line"), "").alias("text"))


#: The query's columns in SQL.
ORACLE = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
d AS (SELECT conv_id, turn,
    md5(concat(coalesce(length(role)::VARCHAR, '-'), ':', coalesce(role, ''), coalesce('+' || text, '-'))) AS digest,
    concat('{OPEN}', coalesce(role, 'unknown'), chr(10), coalesce(text, ''), '{CLOSE}', chr(10)) AS line FROM t),
c AS (SELECT conv_id, count(*) AS n, list(digest ORDER BY turn NULLS FIRST, digest) AS ds,
    string_agg(line, '' ORDER BY turn NULLS FIRST, digest) AS text FROM d GROUP BY conv_id),
g AS (SELECT ds, n, min(conv_id) AS conv_id, count(*) AS n_copies, min(text) AS text FROM c GROUP BY ds, n),
k AS (SELECT ds, unnest(range(1, n)) AS k FROM g),
p AS (SELECT DISTINCT ds[1:k] AS ds FROM k)
SELECT conv_id, n AS n_turns, n_copies, text FROM g ANTI JOIN p USING (ds)
"""
