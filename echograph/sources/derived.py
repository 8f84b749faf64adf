"""Posts and trade graphs derived from the given event and order tables.

The tables hold no social posts, so every event becomes one: clicks reshare,
views quote and signups reply to an earlier event (every tenth signup quotes it
as well), and the text is that of a document.  Only equi-joins on near-unique
keys are used, so the work spreads and grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echograph.schema import AUTHOR, FLAT, POST, QUOTED, REFERENCE, RESHARED, USER

ACCOUNT_CREATED = "Fri Jan 01 00:00:00 +0000 2021"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by the key that they are joined by next: the join finds them so."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _authored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event with what it says about itself, without its text."""
    number = F.get_json_object("props", "$.k").cast("long")
    handle = F.concat(
        F.lit("u"),
        F.col("user_id").cast("string"),
        F.when(F.dayofmonth("ts") >= 16, F.lit("_b")).otherwise(F.lit("")),
    )
    refers = F.col("event_type").isin("click", "view", "signup")
    parent = F.col("event_id") - 1 - F.col("event_id") % 97
    return table(spark, sf_dir, "events").select(
        "event_id",
        "event_type",
        "value",
        number.alias("k"),
        # Negative keys match nothing and, unlike nulls, do not all hash alike.
        F.when(refers, parent).otherwise(-1 - F.col("event_id")).alias("parent_id"),
        F.col("event_id").cast("string").alias("id_str"),
        F.concat(
            F.date_format("ts", "EEE MMM dd HH:mm:ss"), F.lit(" +0000 "), F.date_format("ts", "yyyy")
        ).alias("created_at"),
        F.to_date("ts").alias("day"),
        F.col("user_id").cast("string").alias("author"),
        handle.alias("handle"),
    )


def _reshares() -> Column:
    return F.col("event_type") == "click"


def _quotes() -> Column:
    return (F.col("event_type") == "view") | ((F.col("event_type") == "signup") & (F.col("event_id") % 10 == 0))


def _embeds() -> Column:
    """Whether an event embeds the earlier one, if there is that."""
    return _reshares() | _quotes()


def _referring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the ids of the earlier event each of them refers to."""
    events = _authored(spark, sf_dir)
    target = events.select(
        F.col("event_id").alias("parent_id"),
        F.col("id_str").alias("ref_id"),
        F.col("created_at").alias("ref_time"),
        F.col("author").alias("ref_author"),
        F.col("handle").alias("ref_handle"),
    )
    return spread(events, "parent_id").join(target, "parent_id", "left").select(
        "*",
        _reshares().alias("reshares"),
        _quotes().alias("quotes"),
        (F.col("event_type") == "signup").alias("replies"),
    )


def _if(flag: str, column: str) -> Column:
    return F.when(F.col(flag), F.col(column))


def _texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Texts by document number, and how many there are."""
    documents = table(spark, sf_dir, "documents")
    return documents.select(F.col("doc_id").alias("text_key"), "text", "lang"), documents.count()


def _with_text(events: DataFrame, texts: DataFrame, key: Column, prefix: str = "") -> DataFrame:
    named = texts.select("text_key", F.col("text").alias(prefix + "text"), F.col("lang").alias(prefix + "lang"))
    return events.withColumn("text_key", key).join(named, "text_key", "left").drop("text_key")


#: Posts that a file of a day should hold at least, where all days share the partitions.
FILE_POSTS = 1000


def _places(events: DataFrame, days_apart: bool) -> tuple[DataFrame | None, int]:
    """``day, first, parts``: the parts a day's rows are dealt over, by its share of all rows, and how many parts there are.

    Where days need not lie apart, any part may hold rows of any day.
    """
    spark = events.sparkSession
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    days = events.filter(F.col("day").isNotNull()).groupBy("day").agg(F.count(F.lit(1)).alias("n")).orderBy("day").collect()
    total = sum(day["n"] for day in days)
    if not days_apart:
        return None, max(1, min(wanted, total // (FILE_POSTS * max(1, len(days)))))
    places, first = [], 0
    for day in days:
        parts = max(1, round(wanted * day["n"] / total))
        places.append((day["day"], first, parts))
        first += parts
    return spark.createDataFrame(places, "day date, first int, parts int"), max(first, 1)


def _placed(rows: DataFrame, places: DataFrame | None, parts: int) -> DataFrame:
    """Rows with their part in ``at``, by the text they need in ``own_key`` and, if there are ``places``, by day."""
    if places is None:
        return rows.withColumn("at", F.pmod(F.hash("own_key"), F.lit(parts)))
    part = F.col("first") + F.pmod(F.hash("own_key"), F.col("parts"))
    named = rows.join(F.broadcast(places), "day", "left")
    return named.withColumn("at", F.coalesce(part, F.lit(0))).drop("first", "parts")


def _with_texts(rows: DataFrame, wanted: DataFrame, texts: DataFrame, places: DataFrame | None, parts: int) -> DataFrame:
    """Rows with the texts of ``own_key`` and, prefixed by ``p_``, of ``parent_key``, in partitions of one day each if there are ``places``.

    Rows and texts meet in their parts.  A text goes once to each part
    where ``wanted`` (``at, text_key``) asks for it, and no row moves once it has one.
    """
    found = wanted.distinct().join(texts, "text_key").select(
        "at",
        F.col("text_key").alias("own_key"),
        F.col("text_key").alias("parent_key"),
        F.struct("text", "lang").alias("found"),
    )
    met = _placed(rows, places, parts).unionByName(found, allowMissingColumns=True).repartitionById(parts, F.col("at"))

    def of(key: str) -> Column:
        texts_first = Window.partitionBy("at", key).orderBy(F.col("found").isNull())
        return F.collect_list("found").over(texts_first.rowsBetween(Window.unboundedPreceding, Window.currentRow))

    named = met.withColumn("p_found", of("parent_key")).withColumn("own_found", of("own_key")).filter(F.col("found").isNull())
    for name in ("p_found", "own_found"):  # a text key that repeats gives a row for each text, an absent one none
        named = named.withColumn(name, F.explode_outer(name))
    return named.select(
        *rows.columns,
        F.col("own_found.text").alias("text"),
        F.col("own_found.lang").alias("lang"),
        F.col("p_found.text").alias("p_text"),
        F.col("p_found.lang").alias("p_lang"),
    )


def flat_posts(spark: SparkSession, sf_dir: str, text: bool = True) -> DataFrame:
    """Top-level posts in flat form with ``day``: ``flatten_posts(posts(..))``
    without building, or joining for, the embedded posts.

    ``text=False`` leaves text and language out for jobs on references only.
    """
    events = _referring(spark, sf_dir)
    if text:
        texts, n = _texts(spark, sf_dir)
        events = _with_text(events, texts, F.col("event_id") % F.lit(n))
    else:
        events = events.select("*", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("lang"))
    flat = dict(
        created_at=F.col("created_at"),
        id_str=F.col("id_str"),
        user_id_str=F.col("author"),
        user_twitter_handle=F.col("handle"),
        in_reply_to_status_id_str=_if("replies", "ref_id"),
        in_reply_to_user_id_str=_if("replies", "ref_author"),
        in_reply_to_screen_name=_if("replies", "ref_handle"),
        text=F.col("text"),
        hashtags=F.array("event_type", "lang"),
        quoted_time=_if("quotes", "ref_time"),
        quoted_original_tweet_id_str=_if("quotes", "ref_id"),
        quoted_original_user_id_str=_if("quotes", "ref_author"),
        quoted_original_user_twitter_handle=_if("quotes", "ref_handle"),
        retweeted_time=_if("reshares", "ref_time"),
        retweeted_original_tweet_id_str=_if("reshares", "ref_id"),
        retweeted_original_user_id_str=_if("reshares", "ref_author"),
        retweeted_original_user_twitter_handle=_if("reshares", "ref_handle"),
    )
    return events.select(*[flat[name].alias(name) for name in FLAT.names], "day")


def own_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested posts without references or text: what profiles and counters need."""
    return _authored(spark, sf_dir).select(*_identity(), _user().alias("user"), *_counters(), "day")


def _identity() -> list[Column]:
    return [F.col("created_at"), F.col("id_str")]


def _user() -> Column:
    fields = dict(
        id_str=F.col("author"),
        screen_name=F.col("handle"),
        verified=F.col("author").cast("long") % 10 == 0,
        followers_count=F.floor(F.col("value") * 10).cast("long"),
        friends_count=F.col("k"),
        favourites_count=3 * F.col("k"),
        statuses_count=F.col("event_id"),
        created_at=F.lit(ACCOUNT_CREATED),
    )
    return F.struct(*[fields[name].alias(name) for name in USER.names])


def _counters() -> list[Column]:
    return [
        (F.col("k") % 3).alias("quote_count"),
        (F.col("k") % 5).alias("reply_count"),
        (F.col("k") % 7).alias("retweet_count"),
        F.col("k").alias("favorite_count"),
    ]


def _author(user_id: str, handle: str) -> Column:
    return F.struct(F.col(user_id).alias("id_str"), F.col(handle).alias("screen_name")).cast(AUTHOR)


def _body(prefix: str = "") -> list[Column]:
    """Fields any post has, raw or embedded, in schema order."""

    def at(name: str) -> Column:
        return F.col(prefix + name)

    tags = F.transform(F.array(at("event_type"), at("lang")), lambda tag: F.struct(tag.alias("text")))
    return [
        at("created_at").alias("created_at"),
        at("id_str").alias("id_str"),
        F.when(at("replies"), at("ref_id")).alias("in_reply_to_status_id_str"),
        F.when(at("replies"), at("ref_author")).alias("in_reply_to_user_id_str"),
        F.when(at("replies"), at("ref_handle")).alias("in_reply_to_screen_name"),
        at("text").alias("text"),
        F.struct(tags.alias("hashtags")).alias("entities"),
    ]


def _joined(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """Events with the earlier one they refer to, prefixed by ``p_``, and the numbers of the documents with their texts.

    Only an event that embeds the earlier one needs the text of that; others have a ``parent_key`` that no document has.
    """
    events = _referring(spark, sf_dir)
    embedded = [
        "id_str", "created_at", "author", "handle", "event_type",
        "replies", "quotes", "ref_id", "ref_time", "ref_author", "ref_handle",
    ]
    parent = events.select(F.col("event_id").alias("parent_id"), *[F.col(c).alias("p_" + c) for c in embedded])
    embeds = F.col("p_id_str").isNotNull() & _embeds()
    joined = events.join(parent, "parent_id", "left").withColumn("own_key", F.col("event_id") % F.lit(n))
    parent_key = F.when(embeds, F.col("parent_id") % F.lit(n)).otherwise(-1 - F.col("event_id"))
    return joined.withColumn("parent_key", parent_key)


def posts(spark: SparkSession, sf_dir: str, days_apart: bool = True) -> DataFrame:
    """Full nested posts with their embedded posts, and ``day``.

    Events meet on narrow rows; texts come last.  A partition holds posts of one
    day only (those without a day are added to one), so that ``write_days`` gives
    one file for each.  A text then goes to every day that has it; without
    ``days_apart`` the posts of one text lie together, whatever their days, and
    only texts of embedded posts go to several partitions.
    """
    texts, n = _texts(spark, sf_dir)
    authored = _authored(spark, sf_dir).withColumn("own_key", F.col("event_id") % F.lit(n))
    places, parts = _places(authored, days_apart)
    keys = F.explode(F.array("own_key", F.when(_embeds() & (F.col("parent_id") >= 0), F.col("parent_id") % F.lit(n))))
    wanted = _placed(authored, places, parts).select("at", keys.alias("text_key"))
    return _nested(_with_texts(_joined(spark, sf_dir, n), wanted, texts, places, parts))


def keyed_posts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``posts`` with keys in all their ``text`` fields, and the texts by ``text_key``.

    For operators that make a row of each embedded post: a row has one text, so
    that a text moves once to all rows that have it, and no post carries two.
    The key is a 256-bit digest, and equal texts have one.
    """
    texts, n = _texts(spark, sf_dir)
    key = F.base64(F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    keys = texts.withColumn("text", key)
    joined = _with_text(_joined(spark, sf_dir, n), keys, F.col("parent_key"), "p_")
    once = texts.filter(F.col("text").isNotNull()).groupBy(key.alias("text_key")).agg(F.first("text").alias("text"))
    return _nested(_with_text(joined, keys, F.col("own_key"))), once


def _nested(joined: DataFrame) -> DataFrame:
    """Posts of events that have their texts."""
    parent_author = _author("p_author", "p_handle").alias("user")
    parent_quote = F.when(
        F.col("p_quotes") & F.col("p_ref_id").isNotNull(),
        F.struct(
            F.col("p_ref_time").alias("created_at"),
            F.col("p_ref_id").alias("id_str"),
            _author("p_ref_author", "p_ref_handle").alias("user"),
        ).cast(REFERENCE),
    )
    has_parent = F.col("p_id_str").isNotNull()
    reshared = F.struct(*_body("p_"), parent_author, parent_quote.alias("quoted_status")).cast(RESHARED)
    quoted = F.struct(*_body("p_"), parent_author).cast(QUOTED)
    nested = joined.select(
        *_body(),
        _user().alias("user"),
        *_counters(),
        F.when(F.col("reshares") & has_parent, reshared).alias("retweeted_status"),
        F.when(F.col("quotes") & has_parent, quoted).alias("quoted_status"),
        "day",
    )
    return nested.select(*POST.names, "day")


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer to supplier order lines: a dense bipartite pair table."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_suppkey")
        .join(orders, "l_orderkey")
        .groupBy("o_custkey", "l_suppkey")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("from_user"),
            F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("to_user"),
            "n",
        )
    )


def nation_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer nation to supplier nation order lines, self-loops included."""
    by_customer = (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_suppkey")
        .join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
        .groupBy("o_custkey", "l_suppkey")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return (
        by_customer.join(customers, "o_custkey")
        .join(suppliers, "l_suppkey")
        .groupBy("c_nationkey", "s_nationkey")
        .agg(F.sum("n").alias("n"))
        .select(
            F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("from_user"),
            F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("to_user"),
            "n",
        )
    )


def handle_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of customers and suppliers as a handle table for ``trade``."""
    customers = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("user_id_str"),
        F.col("c_name").alias("user_twitter_handle"),
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("user_id_str"),
        F.col("s_name").alias("user_twitter_handle"),
    )
    return customers.unionByName(suppliers)
