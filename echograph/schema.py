"""Explicit schemas: only the fields some operator reads.

JSON is parsed whole and nested fields are not pruned from it, so a field left
out here is a field never materialised.  The names are the ones archived posts
and the files between stages carry.
"""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


S, L = T.StringType(), T.LongType()

AUTHOR = _struct(id_str=S, screen_name=S)

USER = _struct(
    id_str=S,
    screen_name=S,
    verified=T.BooleanType(),
    followers_count=L,
    friends_count=L,
    favourites_count=L,
    statuses_count=L,
    created_at=S,
)

ENTITIES = _struct(hashtags=T.ArrayType(_struct(text=S)))

#: What a reshared post needs to say about the post it quotes itself.
REFERENCE = _struct(created_at=S, id_str=S, user=AUTHOR)

_BODY = dict(
    created_at=S,
    id_str=S,
    in_reply_to_status_id_str=S,
    in_reply_to_user_id_str=S,
    in_reply_to_screen_name=S,
    text=S,
    entities=ENTITIES,
)

QUOTED = _struct(**_BODY, user=AUTHOR)
RESHARED = _struct(**_BODY, user=AUTHOR, quoted_status=REFERENCE)

#: One archived post, as found in a day folder.
POST = _struct(
    **_BODY,
    user=USER,
    quote_count=L,
    reply_count=L,
    retweet_count=L,
    favorite_count=L,
    retweeted_status=RESHARED,
    quoted_status=QUOTED,
)

#: The flat post: 17 columns, strings but for the hashtags.
FLAT = _struct(
    created_at=S,
    id_str=S,
    user_id_str=S,
    user_twitter_handle=S,
    in_reply_to_status_id_str=S,
    in_reply_to_user_id_str=S,
    in_reply_to_screen_name=S,
    text=S,
    hashtags=T.ArrayType(S),
    quoted_time=S,
    quoted_original_tweet_id_str=S,
    quoted_original_user_id_str=S,
    quoted_original_user_twitter_handle=S,
    retweeted_time=S,
    retweeted_original_tweet_id_str=S,
    retweeted_original_user_id_str=S,
    retweeted_original_user_twitter_handle=S,
)

#: Columns dropped once the handle dictionary holds the handles.
HANDLE_COLUMNS = [
    "user_twitter_handle",
    "in_reply_to_screen_name",
    "quoted_original_user_twitter_handle",
    "retweeted_original_user_twitter_handle",
]

#: Original posts as stored between stages (JSON).
ORIGINAL_ROW = T.StructType(
    [f for f in FLAT if f.name not in HANDLE_COLUMNS + ["hashtags"]]
    + [T.StructField("text_hashtag", S, True)]
)

#: Interaction rows as stored between stages (JSON).
INTERACTION_ROW = T.StructType(
    ORIGINAL_ROW.fields + [T.StructField("connected_user_single", S, True)]
)

PAIR = _struct(from_user=S, to_user=S, n=L)
USER_COUNT = _struct(user_id_str=S, n=L)
HANDLE = _struct(user_id_str=S, user_twitter_handle=S)
RANKED = _struct(users=S, rank=T.DoubleType(), user_twitter_handle=S)
CANDIDATE = _struct(user_id_str=S)

#: Columns of a user's profile at the time of one post.
PROFILE_COLUMNS = [
    "user_id_str",
    "user_twitter_handle",
    "verified",
    "followers_count",
    "friends_count",
    "favourites_count",
    "statuses_count",
    "created_at",
    "tweet_created_at",
]
