"""Merkle fixity audit of archived web records: replicas are compared from their roots down.

Records are dealt to shards by hash and laid out in each by id, so each has an
offset.  A leaf is the hash of a record's offset, length and digest; a node is
the hash of up to 16 children in order and so stands for a range of offsets.
The audit compares the roots of two replicas and goes down only into branches
that differ, to the records that are corrupt, missing or extra.  DataFrame
functions only.

Exactly repeated records are stored once with their number, as a revisit is.
Null fields leave their header line out, so they differ from empty ones.  Two
empty archives agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echograph.sources.tables import stored

#: Records in a shard, on average; hashing deals them evenly.
SHARD_RECORDS = 4096
#: Children of a node, as bits, and bits of a place within a shard.
FAN_BITS, PLACE_BITS = 4, 20


def record_text(page_id: Column, url: Column, html: Column) -> Column:
    """A response record: header lines, the page, two line ends."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Record-ID: <urn:page:"), page_id.cast("string"), F.lit(">\r\n")), F.lit("")),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), url, F.lit("\r\n")), F.lit("")),
        F.when(html.isNull(), F.lit("")).otherwise(F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n"))),
        F.lit("\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def laid_out(records: DataFrame, shard_records: int = SHARD_RECORDS) -> DataFrame:
    """(leaf, offset, length, digest, copies, page_id) of records (page_id, digest, length), stored."""
    records = stored(records, "records")  # narrow: digests, no pages
    shards = max(1, -(-records.count() // shard_records))
    single = records.groupBy("page_id", "digest", "length").agg(F.count("*").alias("copies"))
    dealt = single.withColumn("shard", F.pmod(F.xxhash64("page_id", "digest"), F.lit(shards)))
    order = Window.partitionBy("shard").orderBy("page_id", "digest")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumns(
        {
            "leaf": F.shiftleft(F.col("shard"), PLACE_BITS) + F.row_number().over(order) - 1,
            "offset": F.coalesce(F.sum("length").over(before), F.lit(0)),
        }
    )
    return stored(placed.select("leaf", "offset", "length", "digest", "copies", "page_id"), "layout")


def leaf_hash() -> Column:
    return F.sha2(F.concat_ws("|", "offset", "length", "copies", "digest"), 256)


def tree(leaves: DataFrame) -> list[DataFrame]:
    """Levels of the trees of replicas, from the leaves (replica, node, hash) to the roots; each is stored."""
    levels = [stored(leaves, "level0")]
    while True:
        top = levels[-1].agg(F.max("node")).first()[0]
        if not top:
            return levels
        child = F.struct("node", "hash")
        grouped = levels[-1].groupBy("replica", F.shiftright("node", FAN_BITS).alias("node")).agg(F.array_sort(F.collect_list(child)).alias("c"))
        named = F.transform("c", lambda x: F.concat_ws(":", x["node"], x["hash"]))
        levels.append(stored(grouped.select("replica", "node", F.sha2(F.array_join(named, ","), 256).alias("hash")), f"level{len(levels)}"))


def differing(levels: list[DataFrame], left: str, right: str) -> DataFrame:
    """(node, left_hash, right_hash) of leaves that differ, reached through differing nodes only."""
    found = None
    for level in reversed(levels):
        if found is not None:
            parents = found.select(F.col("node").alias("parent"))
            level = level.join(parents, F.shiftright(level["node"], FAN_BITS) == F.col("parent"), "left_semi")
        sides = level.groupBy("node").agg(
            F.max(F.when(F.col("replica") == left, F.col("hash"))).alias("left_hash"),
            F.max(F.when(F.col("replica") == right, F.col("hash"))).alias("right_hash"),
        )
        found = sides.filter(~F.col("left_hash").eqNullSafe(F.col("right_hash")))
    return found


def audited(layout: DataFrame, replica: DataFrame) -> DataFrame:
    """Damaged records: (page_id, status, offset, length, expected, found).

    ``replica`` has (leaf, offset, length, digest, copies, page_id) as read from
    the copy at the places of ``layout``.
    """
    both = layout.withColumn("replica", F.lit("left")).unionByName(replica.withColumn("replica", F.lit("right")))
    leaves = both.select("replica", F.col("leaf").alias("node"), leaf_hash().alias("hash"))
    bad = differing(tree(leaves), "left", "right").select(F.col("node").alias("leaf"))
    here = both.join(bad, "leaf", "left_semi")
    pick = lambda side, column: F.max(F.when(F.col("replica") == side, F.col(column)))
    sides = here.groupBy("leaf").agg(
        F.max("page_id").alias("page_id"),
        F.max("offset").alias("offset"),
        F.coalesce(pick("left", "length"), pick("right", "length")).alias("length"),
        F.max(F.when(F.col("replica") == "left", F.lit(True))).alias("in_left"),
        F.max(F.when(F.col("replica") == "right", F.lit(True))).alias("in_right"),
        pick("left", "digest").alias("expected"),
        pick("right", "digest").alias("found"),
    )
    status = F.when(F.col("in_right").isNull(), "missing").when(F.col("in_left").isNull(), "extra").otherwise("corrupt")
    return sides.select("page_id", status.alias("status"), "offset", "length", "expected", "found")


#: The query's second replica: by the first two hex digits of the id's digest, one byte differs or the record is gone.
ROT = "md5(cast(page_id AS string)) < '06'"
LOST = "md5(cast(page_id AS string)) between '06' and '09'"


def decayed(record: Column) -> Column:
    """The record with its middle character changed."""
    half = F.floor(F.length(record) / 2).cast("int")
    swap = F.when(F.substr(record, half, F.lit(1)) == "#", "*").otherwise("#")
    return F.concat(F.substr(record, F.lit(1), half - 1), swap, F.substr(record, half + 1, F.length(record)))


def two_replicas(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The archive of ``pages``, and a copy of it with decay derived from the ids."""
    record = record_text(F.col("page_id"), F.col("url").cast("string"), F.col("html").cast("string"))
    damaged = F.when(F.expr(ROT), decayed(F.col("record"))).otherwise(F.col("record"))
    read = pages.select("page_id", record.alias("record")).select(
        "page_id", F.sha2("record", 256).alias("digest"), F.octet_length("record").cast("long").alias("length"),
        F.sha2(damaged, 256).alias("read"), F.octet_length(damaged).cast("long").alias("read_length"),
    )
    read = stored(read, "digests")
    layout = laid_out(read.select("page_id", "digest", "length"))
    seen = read.select("page_id", "digest", "read", "read_length").distinct()
    same = F.col("l.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("l.digest") == F.col("r.digest"))
    copy = layout.alias("l").join(seen.alias("r"), same).filter(F.expr(f"NOT coalesce({LOST.replace('page_id', 'l.page_id')}, false)"))
    return layout, copy.select("leaf", "offset", F.col("read_length").alias("length"), F.col("read").alias("digest"), "copies", "l.page_id")


#: The query's columns in SQL.
ORACLE = """
WITH r AS (SELECT DISTINCT page_id, concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10),
    coalesce('WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10), ''),
    coalesce('WARC-Target-URI: ' || url || chr(13) || chr(10), ''),
    CASE WHEN html IS NULL THEN '' ELSE 'Content-Length: ' || strlen(html) || chr(13) || chr(10) END,
    chr(13), chr(10), coalesce(html, ''), chr(13), chr(10), chr(13), chr(10)) AS rec FROM pages),
h AS (SELECT page_id, rec, (length(rec) // 2)::INT AS half, md5(page_id::VARCHAR) AS m FROM r)
SELECT page_id, CASE WHEN m < '06' THEN 'corrupt' ELSE 'missing' END AS status, strlen(rec)::BIGINT AS length,
  sha256(rec) AS expected,
  CASE WHEN m < '06' THEN sha256(concat(rec[1:half - 1], CASE WHEN rec[half:half] = '#' THEN '*' ELSE '#' END, rec[half + 1:])) END AS found
FROM h WHERE m <= '09'
"""
