"""The queries again, as plain SQL over the given tables, for checking.

Written against DuckDB.  Iterations are unrolled into one CTE per step.
"""

from __future__ import annotations

from echograph.plans.queries import BOOSTERS, CANDIDATES, LEXICON, NEGATIONS, TERMS, TOP, TOPIC

PATTERN = "(?i)" + "|".join(TERMS)
TOPIC_PATTERN = "(?i)" + "|".join(TOPIC)


def _with(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


# -- posts ------------------------------------------------------------------------

EV = """ev AS (
  SELECT event_id, event_type, value, ts,
         CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k,
         CAST(event_id AS VARCHAR) AS id_str,
         strftime(ts, '%a %b %d %H:%M:%S +0000 %Y') AS created_at,
         strftime(ts, '%Y-%m-%d') AS day,
         CAST(user_id AS VARCHAR) AS author,
         'u' || CAST(user_id AS VARCHAR) || CASE WHEN day(ts) >= 16 THEN '_b' ELSE '' END AS handle,
         event_id - 1 - event_id % 97 AS parent_id,
         event_type = 'click' AS reshares,
         event_type = 'view' OR (event_type = 'signup' AND event_id % 10 = 0) AS quotes,
         event_type = 'signup' AS replies
  FROM events)"""

RF = """rf AS (
  SELECT e.*, p.event_id AS ref_event, p.id_str AS ref_id, p.created_at AS ref_time,
         p.author AS ref_author, p.handle AS ref_handle
  FROM ev e LEFT JOIN ev p
    ON p.event_id = e.parent_id AND e.event_type IN ('click', 'view', 'signup'))"""

TX = """tx AS (
  SELECT r.*, d.text, d.lang, r.event_type || ',' || d.lang AS tags
  FROM rf r LEFT JOIN documents d ON d.doc_id = r.event_id % (SELECT count(*) FROM documents))"""


def _flat_columns(p: str, handle: bool, quotes: bool, reshares: bool, text: bool = True) -> str:
    def when(flag: str, column: str, on: bool = True) -> str:
        return f"CASE WHEN {p}.{flag} THEN {p}.{column} END" if on else "CAST(NULL AS VARCHAR)"

    columns = {
        "created_at": f"{p}.created_at",
        "id_str": f"{p}.id_str",
        "user_id_str": f"{p}.author",
        "user_twitter_handle": f"{p}.handle" if handle else "CAST(NULL AS VARCHAR)",
        "in_reply_to_status_id_str": when("replies", "ref_id"),
        "in_reply_to_user_id_str": when("replies", "ref_author"),
        "in_reply_to_screen_name": when("replies", "ref_handle"),
        "quoted_time": when("quotes", "ref_time", quotes),
        "quoted_original_tweet_id_str": when("quotes", "ref_id", quotes),
        "quoted_original_user_id_str": when("quotes", "ref_author", quotes),
        "quoted_original_user_twitter_handle": when("quotes", "ref_handle", quotes),
        "retweeted_time": when("reshares", "ref_time", reshares),
        "retweeted_original_tweet_id_str": when("reshares", "ref_id", reshares),
        "retweeted_original_user_id_str": when("reshares", "ref_author", reshares),
        "retweeted_original_user_twitter_handle": when("reshares", "ref_handle", reshares),
    }
    if text:
        columns["text"] = f"{p}.text"
        columns["hashtags"] = f"{p}.tags"
    return ", ".join(f"{expression} AS {name}" for name, expression in columns.items())


FLAT_COLUMNS = (
    "created_at, id_str, user_id_str, user_twitter_handle, in_reply_to_status_id_str, "
    "in_reply_to_user_id_str, in_reply_to_screen_name, text, hashtags, quoted_time, "
    "quoted_original_tweet_id_str, quoted_original_user_id_str, quoted_original_user_twitter_handle, "
    "retweeted_time, retweeted_original_tweet_id_str, retweeted_original_user_id_str, "
    "retweeted_original_user_twitter_handle"
)

FLAT = [EV, RF, TX, f"flat AS (SELECT {_flat_columns('t', True, True, True)}, t.day FROM tx t)"]

# The same without text and language, for queries on references only.
BARE = [EV, RF, f"flat AS (SELECT {_flat_columns('t', True, True, True, text=False)}, t.day FROM rf t)"]

UNNESTED = [
    EV,
    RF,
    TX,
    f"""un AS (
  SELECT {_flat_columns('t', True, True, True)}, 'raw' AS origin, t.day FROM tx t
  UNION ALL
  SELECT {_flat_columns('p', True, True, False)}, 'reshared' AS origin, t.day
  FROM tx t JOIN tx p ON p.event_id = t.ref_event WHERE t.reshares
  UNION ALL
  SELECT {_flat_columns('p', False, False, False)}, 'quoted' AS origin, t.day
  FROM tx t JOIN tx p ON p.event_id = t.ref_event WHERE t.quotes)""",
]

MATCHED = UNNESTED + [
    f"""hit AS (
  SELECT *, hashtags AS text_hashtag FROM un
  WHERE regexp_matches(text, '{PATTERN}') OR regexp_matches(hashtags, '{PATTERN}'))"""
]

#: How many parts of a post are not known.
MISSING = " + ".join(f"CAST({c.strip()} IS NULL AS INT)" for c in FLAT_COLUMNS.split(","))

REFERENCES = "quoted_original_user_id_str, in_reply_to_user_id_str, retweeted_original_user_id_str"

INTAKE_COUNTS = [
    f"kept AS MATERIALIZED (SELECT DISTINCT {FLAT_COLUMNS}, day FROM hit)",
    f"""per_day AS (
  SELECT day, count(*) FILTER (origin = 'raw') AS "read", count(*) AS unnested,
         (SELECT count(*) FROM hit WHERE hit.day = un.day) AS matched,
         (SELECT count(*) FROM kept WHERE kept.day = un.day) AS kept,
         (SELECT count(*) FROM kept WHERE kept.day = un.day AND coalesce({REFERENCES}) IS NOT NULL) AS connected,
         (SELECT count(*) FROM kept WHERE kept.day = un.day AND coalesce({REFERENCES}) IS NULL) AS original
  FROM un GROUP BY day)""",
    """counts AS (UNPIVOT (SELECT * FROM per_day) ON "read", unnested, matched, kept, connected, original
  INTO NAME stage VALUE n)""",
]

ROWS = """inter AS (
  SELECT * FROM (
    SELECT flat.*, quoted_original_user_id_str AS connected_user_single FROM flat
    UNION ALL SELECT flat.*, in_reply_to_user_id_str FROM flat
    UNION ALL SELECT flat.*, retweeted_original_user_id_str FROM flat)
  WHERE connected_user_single IS NOT NULL)"""

PAIRS = """pairs AS MATERIALIZED (
  SELECT user_id_str AS from_user, connected_user_single AS to_user, count(*) AS n
  FROM inter GROUP BY ALL)"""

EDGES = """edges AS MATERIALIZED (
  SELECT from_user, to_user, CAST(n AS DOUBLE) / CAST(total AS DOUBLE) AS weight
  FROM (SELECT *, sum(n) OVER (PARTITION BY from_user) AS total FROM pairs)
  WHERE from_user <> to_user)"""

COUNT_EDGES = """edges AS MATERIALIZED (
  SELECT from_user, to_user, CAST(n AS DOUBLE) AS weight FROM pairs WHERE from_user <> to_user)"""

TRADE = """pairs AS MATERIALIZED (
  SELECT 'C' || CAST(o_custkey AS VARCHAR) AS from_user, 'S' || CAST(l_suppkey AS VARCHAR) AS to_user,
         count(*) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""

TRADE_HANDLES = """handles AS (
  SELECT 'C' || CAST(c_custkey AS VARCHAR) AS user_id_str, c_name AS user_twitter_handle FROM customer
  UNION ALL
  SELECT 'S' || CAST(s_suppkey AS VARCHAR), s_name FROM supplier)"""

HANDLES = """handles AS (
  SELECT DISTINCT user_id_str, user_twitter_handle FROM (
    SELECT user_id_str, user_twitter_handle FROM flat
    UNION ALL SELECT in_reply_to_user_id_str, in_reply_to_screen_name FROM flat)
  WHERE user_id_str IS NOT NULL AND user_twitter_handle IS NOT NULL)"""

TOPIC_ROWS = f"""topic AS (
  SELECT DISTINCT created_at, id_str, user_id_str, in_reply_to_status_id_str, in_reply_to_user_id_str, text,
         quoted_time, quoted_original_tweet_id_str, quoted_original_user_id_str, retweeted_time,
         retweeted_original_tweet_id_str, retweeted_original_user_id_str, hashtags, connected_user_single
  FROM inter WHERE regexp_matches(text, '{TOPIC_PATTERN}') OR regexp_matches(hashtags, '{TOPIC_PATTERN}'))"""

TOPIC_PAIRS = """pairs AS (
  SELECT user_id_str AS from_user, connected_user_single AS to_user, count(*) AS n FROM topic GROUP BY ALL)"""

GRAPH = BARE + [ROWS, PAIRS]
TOPIC_GRAPH = FLAT + [ROWS, TOPIC_ROWS, TOPIC_PAIRS, COUNT_EDGES]

# -- iterations -------------------------------------------------------------------


def _influence(rounds: int = 10) -> list[str]:
    ctes = [
        """node AS MATERIALIZED (
  SELECT users, sum(weight) AS s FROM (
    SELECT from_user AS users, 0.0::DOUBLE AS weight FROM edges UNION ALL SELECT to_user, weight FROM edges)
  GROUP BY users)""",
        "r0 AS MATERIALIZED (SELECT users, s, 1.0::DOUBLE / count(*) OVER () AS rank FROM node)",
    ]
    for i in range(rounds):
        ctes.append(
            f"x{i} AS MATERIALIZED (SELECT users, s, 0.85::DOUBLE * s * rank + 0.15::DOUBLE / count(*) OVER () AS x FROM r{i})"
        )
        ctes.append(f"r{i + 1} AS MATERIALIZED (SELECT users, s, x / sum(x) OVER () AS rank FROM x{i})")
    return ctes + [f"ranking AS (SELECT users, rank FROM r{rounds})"]


def _pagerank(rounds: int = 10) -> list[str]:
    ctes = [
        "node AS MATERIALIZED (SELECT from_user AS users FROM edges UNION SELECT to_user FROM edges)",
        "r0 AS MATERIALIZED (SELECT users, 1.0::DOUBLE / count(*) OVER () AS rank FROM node)",
    ]
    for i in range(rounds):
        ctes.append(
            f"""x{i} AS MATERIALIZED (
  SELECT n.users, 0.15::DOUBLE / (SELECT count(*) FROM node) + 0.85::DOUBLE * coalesce(c.x, 0) AS x
  FROM node n LEFT JOIN (
    SELECT to_user, sum(weight * rank) AS x FROM edges JOIN r{i} ON from_user = users GROUP BY to_user) c
  ON c.to_user = n.users)"""
        )
        ctes.append(f"r{i + 1} AS MATERIALIZED (SELECT users, x / sum(x) OVER () AS rank FROM x{i})")
    return ctes + [f"ranking AS (SELECT users, rank FROM r{rounds})"]


def _hits(rounds: int, norm: str) -> list[str]:
    def total(column: str) -> str:
        return f"sum({column}) OVER ()" if norm == "l1" else f"sqrt(sum({column} * {column}) OVER ())"

    ctes = ["h0 AS MATERIALIZED (SELECT DISTINCT from_user AS node, 1.0::DOUBLE AS score FROM edges)"]
    for i in range(1, rounds + 1):
        ctes.append(
            f"""a{i} AS MATERIALIZED (SELECT node, a / {total('a')} AS score FROM (
  SELECT to_user AS node, sum(weight * score) AS a FROM edges JOIN h{i - 1} ON from_user = node GROUP BY to_user))"""
        )
        ctes.append(
            f"""h{i} AS MATERIALIZED (SELECT node, h / {total('h')} AS score FROM (
  SELECT from_user AS node, sum(weight * score) AS h FROM edges JOIN a{i} ON to_user = node GROUP BY from_user))"""
        )
    return ctes + [f"auth AS (SELECT * FROM a{rounds})", f"hub AS (SELECT * FROM h{rounds})"]


BOTH_SCORES = """SELECT 'auth' AS kind, node, round(score, 9) AS score FROM auth
UNION ALL SELECT 'hub', node, round(score, 9) FROM hub"""


def _top_nodes(table: str) -> str:
    return f"""SELECT node, round(score, 9) AS score, user_twitter_handle
FROM (SELECT DISTINCT node, score, user_twitter_handle FROM {table} JOIN handles ON user_id_str = node) t
ORDER BY t.score DESC, node, user_twitter_handle LIMIT 200"""


TOP_RANKS = f"top AS (SELECT users, rank FROM ranking ORDER BY rank DESC, users LIMIT {TOP})"

CAND = f"""cand AS MATERIALIZED (
  SELECT to_user AS user_id_str FROM pairs GROUP BY to_user ORDER BY sum(n) DESC, to_user LIMIT {CANDIDATES})"""

# -- profiles ---------------------------------------------------------------------

PROFILE_COLUMNS = (
    "user_id_str, user_twitter_handle, verified, followers_count, friends_count, favourites_count, "
    "statuses_count, created_at, tweet_created_at"
)

PROFILES = """prof AS (
  SELECT author AS user_id_str, handle AS user_twitter_handle, CAST(author AS BIGINT) % 10 = 0 AS verified,
         CAST(floor(value * 10) AS BIGINT) AS followers_count, k AS friends_count, 3 * k AS favourites_count,
         event_id AS statuses_count, 'Fri Jan 01 00:00:00 +0000 2021' AS created_at,
         created_at AS tweet_created_at, date_trunc('second', ts) AS posted, day, id_str,
         k % 3 AS quote_count, k % 5 AS reply_count, k % 7 AS retweet_count, k AS favorite_count
  FROM ev)"""

PROF = [EV, PROFILES]
PROF_CAND = [EV, PROFILES, RF, BARE[2], ROWS, PAIRS, CAND]
OF_CAND = "SELECT * FROM prof WHERE user_id_str IN (SELECT user_id_str FROM cand)"


def _ranked(order: str, partition: str = "user_id_str", source: str = "prof") -> str:
    return f"(SELECT *, rank() OVER (PARTITION BY {partition} ORDER BY {order} DESC) AS create_rank FROM {source})"


def _rates(keys: str, order: str, source: str) -> list[str]:
    on = " AND ".join(f"l.{k.strip()} = s.{k.strip()}" for k in (keys + ", user_twitter_handle").split(","))
    return [
        f"src AS ({source})",
        f"""sums AS (SELECT {keys}, user_twitter_handle, CAST(sum(retweet_count) AS BIGINT) AS retweets_count
  FROM src GROUP BY {keys}, user_twitter_handle)""",
        f"""rates AS (
  SELECT l.*, s.retweets_count,
         CASE WHEN l.followers_count <> 0
              THEN round(CAST(s.retweets_count + l.favourites_count AS DOUBLE) / l.followers_count, 9) END AS ier
  FROM {_ranked(order, source='src')} l JOIN sums s ON {on} WHERE l.create_rank = 1)""",
    ]


def _interactions(source: str, keys: str) -> str:
    return f"""(SELECT * FROM (
  SELECT {keys}, max(quote_count) + max(reply_count) + max(retweet_count) AS interact_cnt
  FROM ({source}) GROUP BY {keys}) WHERE interact_cnt > 0)"""


# -- sentiment --------------------------------------------------------------------

LEX = "lex(token, valence) AS (VALUES " + ", ".join(f"('{t}', {v}::DOUBLE)" for t, v in LEXICON) + ")"


PLAIN_SUMS = [
    """tok AS (
  SELECT rid, lower(word) AS token FROM (SELECT rid, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM base))""",
    """sums AS (
  SELECT rid, sum(v) AS total, sum(CASE WHEN v > 0 THEN v + 1 ELSE 0 END) AS pos,
         sum(CASE WHEN v < 0 THEN 1 - v ELSE 0 END) AS neg, sum(CASE WHEN v = 0 THEN 1 ELSE 0 END) AS neu
  FROM (SELECT rid, coalesce(valence, 0.0::DOUBLE) AS v FROM tok LEFT JOIN lex USING (token)) GROUP BY rid)""",
]

_BOOSTS = "CASE lower(word) " + " ".join(f"WHEN '{w}' THEN {v}::DOUBLE" for w, v in BOOSTERS.items()) + " ELSE 0 END"
_DENIED = "lower(word) IN (" + ", ".join(f"'{w}'" for w in NEGATIONS) + ")"
_ORDER = "OVER (PARTITION BY rid ORDER BY i)"

RULED_SUMS = [
    """tok AS (
  SELECT rid, regexp_matches(text, '[a-z]') AS mixed, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word,
         unnest(range(len(regexp_extract_all(text, '[A-Za-z]+')))) AS i FROM base)""",
    f"""near AS (
  SELECT *, lower(word) AS token,
         coalesce(lag({_BOOSTS}, 1) {_ORDER}, 0) + 0.95 * coalesce(lag({_BOOSTS}, 2) {_ORDER}, 0)
           + 0.9 * coalesce(lag({_BOOSTS}, 3) {_ORDER}, 0)
           + CASE WHEN mixed AND length(word) > 1 AND word = upper(word) THEN 0.733 ELSE 0 END AS more,
         coalesce(lag({_DENIED}, 1) {_ORDER}, false) OR coalesce(lag({_DENIED}, 2) {_ORDER}, false)
           OR coalesce(lag({_DENIED}, 3) {_ORDER}, false) AS denied
  FROM tok)""",
    """val AS (
  SELECT rid, CASE WHEN denied THEN -0.74::DOUBLE ELSE 1.0::DOUBLE END
    * (coalesce(valence, 0.0::DOUBLE) + sign(coalesce(valence, 0.0::DOUBLE)) * more::DOUBLE) AS v
  FROM near LEFT JOIN lex USING (token))""",
    """plain AS (
  SELECT rid, sum(v) AS total, sum(CASE WHEN v > 0 THEN v + 1 ELSE 0 END) AS pos,
         sum(CASE WHEN v < 0 THEN 1 - v ELSE 0 END) AS neg, sum(CASE WHEN v = 0 THEN 1 ELSE 0 END) AS neu
  FROM val GROUP BY rid)""",
    """sums AS (
  SELECT rid, total + sign(total) * marks AS total, pos + CASE WHEN pos > neg THEN marks ELSE 0 END AS pos,
         neg + CASE WHEN neg > pos THEN marks ELSE 0 END AS neg, neu
  FROM (SELECT plain.*, least(len(regexp_extract_all(text, '!')), 4) * 0.292::DOUBLE AS marks
        FROM plain JOIN base USING (rid)))""",
]


def _scored(source: str, columns: str, sums: list[str] = PLAIN_SUMS) -> list[str]:
    return [
        LEX,
        f"base AS MATERIALIZED (SELECT row_number() OVER () AS rid, {columns}, text FROM {source})",
        *sums,
        f"""scored AS (
  SELECT {columns},
         CASE WHEN pos + neg + neu > 0 THEN neg / (pos + neg + neu) ELSE text_known END AS sentiment_neg,
         CASE WHEN pos + neg + neu > 0 THEN neu / (pos + neg + neu) ELSE text_known END AS sentiment_neu,
         CASE WHEN pos + neg + neu > 0 THEN pos / (pos + neg + neu) ELSE text_known END AS sentiment_pos,
         compound AS sentiment_compound,
         CAST(coalesce(compound >= 0, false) AS BIGINT) AS sentiment_compound_pos_ind
  FROM (SELECT b.*, pos, neg, neu, CASE WHEN text IS NOT NULL THEN 0.0::DOUBLE END AS text_known,
               CASE WHEN text IS NOT NULL
                    THEN coalesce(total, 0.0::DOUBLE) / sqrt(coalesce(total, 0.0::DOUBLE) ** 2 + 15.0) END AS compound
        FROM base b LEFT JOIN sums USING (rid)))""",
    ]


def _sentiment_by(source: str, key: str, suffix: str) -> str:
    return _with(
        *FLAT,
        ROWS,
        *_scored(source, key),
        select=f"""SELECT {key}, count(*) AS num_original_tweets{suffix},
  CAST(sum(sentiment_compound_pos_ind) AS BIGINT) AS num_pos_tweets{suffix},
  round(avg(sentiment_compound), 9) AS avg_sentiment_compound{suffix}
FROM scored GROUP BY {key}""",
    )


TURN_COLUMNS = """SELECT conv_id, turn, round(sentiment_neg, 9) AS sentiment_neg, round(sentiment_neu, 9) AS sentiment_neu,
  round(sentiment_pos, 9) AS sentiment_pos, round(sentiment_compound, 9) AS sentiment_compound,
  sentiment_compound_pos_ind FROM scored"""
TURN_SCORES = _with(*_scored("conversations", "conv_id, turn"), select=TURN_COLUMNS)

ORACLE: dict[str, str] = {
    "archive_influencers": _with(
        *MATCHED,
        f"flat AS (SELECT DISTINCT {FLAT_COLUMNS}, day FROM hit)",
        ROWS,
        PAIRS,
        EDGES,
        HANDLES,
        *_influence(),
        TOP_RANKS,
        select="""SELECT users, round(rank, 9) AS rank, user_twitter_handle
FROM top LEFT JOIN handles ON user_id_str = users""",
    ),
    "read_posts": _with(*FLAT, select="SELECT id_str, user_id_str, created_at, text FROM flat"),
    "read_days": _with(EV, select="SELECT day, count(*) AS n_posts FROM ev GROUP BY day"),
    "day_slice": _with(
        EV, select="SELECT day, count(*) AS n_posts FROM ev GROUP BY day ORDER BY day DESC LIMIT 3 OFFSET 1"
    ),
    "intake_report": _with(
        *MATCHED,
        *INTAKE_COUNTS,
        select="""SELECT * FROM counts
UNION ALL SELECT day, 'broken', count(*) FROM ev WHERE event_id % 100 = 0 GROUP BY day
UNION ALL SELECT '2999-01-01', 'skipped', 1""",
    ),
    "posts_json_roundtrip": _with(
        *FLAT,
        ROWS,
        select=f"""SELECT id_str, user_id_str, hashtags AS text_hashtag, CAST(NULL AS VARCHAR) AS connected_user_single
FROM flat WHERE coalesce({REFERENCES}) IS NULL
UNION ALL SELECT id_str, user_id_str, hashtags, connected_user_single FROM inter""",
    ),
    "flatten_posts": _with(*FLAT, select=f"SELECT {FLAT_COLUMNS}, day FROM flat"),
    "unnest_embedded": _with(*UNNESTED, select=f"SELECT {FLAT_COLUMNS}, origin, day FROM un"),
    "keyword_filter": _with(*MATCHED, select="SELECT id_str, origin, text_hashtag, day FROM hit"),
    "dedup_posts": _with(*UNNESTED, select=f"SELECT DISTINCT {FLAT_COLUMNS}, day FROM un"),
    "dedup_posts_by_id": _with(
        *UNNESTED,
        select=f"""SELECT {FLAT_COLUMNS}, day FROM (
  SELECT *, row_number() OVER (
    PARTITION BY id_str
    ORDER BY CASE origin WHEN 'raw' THEN 1 WHEN 'reshared' THEN 2 ELSE 3 END, day, {MISSING}) AS nth
  FROM un) WHERE nth = 1""",
    ),
    "intake": _with(*MATCHED, select=f"SELECT DISTINCT {FLAT_COLUMNS}, text_hashtag, day FROM hit"),
    "intake_counts": _with(*MATCHED, *INTAKE_COUNTS, select="SELECT * FROM counts"),
    "handle_dictionary": _with(*BARE, HANDLES, select="SELECT * FROM handles"),
    "connected_users": _with(
        *BARE,
        select=f"""SELECT id_str, user_id_str, concat_ws(',', {REFERENCES}) AS connected,
  CAST(quoted_original_user_id_str IS NOT NULL AS BIGINT) + CAST(in_reply_to_user_id_str IS NOT NULL AS BIGINT)
  + CAST(retweeted_original_user_id_str IS NOT NULL AS BIGINT) AS n_connected
FROM flat""",
    ),
    "interaction_rows": _with(*BARE, ROWS, select="SELECT id_str, user_id_str, connected_user_single FROM inter"),
    "original_posts": _with(
        *BARE, select=f"SELECT id_str, user_id_str FROM flat WHERE coalesce({REFERENCES}) IS NULL"
    ),
    "interactions_per_user": _with(
        *BARE, ROWS, select="SELECT user_id_str, count(*) AS n FROM inter GROUP BY user_id_str"
    ),
    "interactions_per_pair": _with(*GRAPH, select="SELECT from_user, to_user, n FROM pairs"),
    "edge_weights": _with(
        *GRAPH, EDGES, select="SELECT from_user, to_user, round(weight, 9) AS weight FROM edges"
    ),
    "nation_edge_weights": _with(
        """pairs AS (
  SELECT 'N' || CAST(c_nationkey AS VARCHAR) AS from_user, 'N' || CAST(s_nationkey AS VARCHAR) AS to_user,
         count(*) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey
  JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL)""",
        EDGES,
        select="SELECT from_user, to_user, round(weight, 9) AS weight FROM edges",
    ),
    "topic_edges": _with(*TOPIC_GRAPH, select="SELECT from_user, to_user, weight FROM edges"),
    "graph_nodes": _with(
        *GRAPH, EDGES, select="SELECT from_user AS users FROM edges UNION SELECT to_user FROM edges"
    ),
    "strongest_edges": _with(
        TRADE,
        COUNT_EDGES,
        select=f"""SELECT from_user, to_user, weight FROM edges
ORDER BY weight DESC, from_user, to_user LIMIT {TOP}""",
    ),
    "edges_csv_roundtrip": _with(*GRAPH, select="SELECT from_user, to_user, n FROM pairs"),
    "influence_rank": _with(
        *GRAPH, EDGES, *_influence(), select="SELECT users, round(rank, 9) AS rank FROM ranking"
    ),
    "pagerank": _with(*GRAPH, EDGES, *_pagerank(), select="SELECT users, round(rank, 9) AS rank FROM ranking"),
    "hits_l1": _with(*GRAPH, COUNT_EDGES, *_hits(5, "l1"), select=BOTH_SCORES),
    "hits_l2": _with(TRADE, COUNT_EDGES, *_hits(10, "l2"), select=BOTH_SCORES),
    "topic_hits": _with(*TOPIC_GRAPH, *_hits(10, "l2"), select=BOTH_SCORES),
    "top_influencers": _with(
        *GRAPH,
        EDGES,
        HANDLES,
        *_influence(),
        TOP_RANKS,
        select="""SELECT users, round(rank, 9) AS rank, user_twitter_handle
FROM top LEFT JOIN handles ON user_id_str = users""",
    ),
    "top_influencers_one_handle": _with(
        *GRAPH,
        EDGES,
        HANDLES,
        *_influence(),
        TOP_RANKS,
        select="""SELECT users, round(rank, 9) AS rank,
  (SELECT min(user_twitter_handle) FROM handles WHERE user_id_str = users) AS user_twitter_handle FROM top""",
    ),
    "top_authorities": _with(TRADE, COUNT_EDGES, TRADE_HANDLES, *_hits(10, "l2"), select=_top_nodes("auth")),
    "top_hubs": _with(TRADE, COUNT_EDGES, TRADE_HANDLES, *_hits(10, "l2"), select=_top_nodes("hub")),
    "candidates": _with(
        *GRAPH, EDGES, *_influence(), TOP_RANKS, select="SELECT users AS user_id_str FROM top"
    ),
    "candidate_count": _with(
        *PROF_CAND, select=f"SELECT count(DISTINCT user_id_str) AS n_candidates FROM ({OF_CAND})"
    ),
    "posts_per_user": _with(
        EV, select="SELECT author AS user_id_str, count(*) AS n_posts FROM ev GROUP BY author"
    ),
    "latest_profile": _with(
        *PROF, select=f"SELECT {PROFILE_COLUMNS}, create_rank FROM {_ranked('day DESC, tweet_created_at')} WHERE create_rank = 1"
    ),
    "latest_profile_by_time": _with(
        *PROF, select=f"SELECT {PROFILE_COLUMNS}, create_rank FROM {_ranked('posted')} WHERE create_rank = 1"
    ),
    "user_history": _with(
        *PROF, select=f"SELECT {PROFILE_COLUMNS}, create_rank FROM {_ranked('day DESC, tweet_created_at')}"
    ),
    "user_history_one": _with(
        *PROF_CAND,
        select=f"""SELECT {PROFILE_COLUMNS}, create_rank FROM {_ranked('day DESC, tweet_created_at')}
WHERE user_id_str = (SELECT to_user FROM pairs GROUP BY to_user ORDER BY sum(n) DESC, to_user LIMIT 1)""",
    ),
    "user_history_by_time": _with(*PROF, select=f"SELECT {PROFILE_COLUMNS}, create_rank FROM {_ranked('posted')}"),
    "candidate_profiles": _with(
        *PROF_CAND,
        select=f"""SELECT {PROFILE_COLUMNS} FROM {_ranked('day DESC, tweet_created_at')}
WHERE create_rank = 1 AND user_id_str IN (SELECT user_id_str FROM cand)""",
    ),
    "missing_candidates": _with(
        *GRAPH,
        select="""SELECT DISTINCT to_user AS user_id_str FROM pairs
WHERE to_user NOT IN (SELECT author FROM ev WHERE day = (SELECT max(day) FROM ev))""",
    ),
    "backfill_profiles": _with(
        *PROF_CAND,
        f"mine AS ({OF_CAND})",
        select=f"""SELECT day, {PROFILE_COLUMNS}
FROM {_ranked('day DESC, tweet_created_at', source='mine')} WHERE create_rank = 1""",
    ),
    "backfill_profiles_none": _with(*PROF, select=f"SELECT day, {PROFILE_COLUMNS} FROM prof WHERE false"),
    "daily_profile_panel": _with(
        *PROF_CAND,
        f"mine AS ({OF_CAND})",
        select=f"""SELECT day, {PROFILE_COLUMNS}
FROM {_ranked('tweet_created_at', 'day, user_id_str', 'mine')} WHERE create_rank = 1""",
    ),
    "engagement_rate": _with(
        *PROF,
        *_rates("user_id_str", "day DESC, tweet_created_at", "SELECT * FROM prof"),
        select=f"SELECT {PROFILE_COLUMNS}, retweets_count, ier FROM rates",
    ),
    "backfill_engagement_rate": _with(
        *PROF_CAND,
        *_rates("day, user_id_str", "day DESC, tweet_created_at", OF_CAND),
        select=f"SELECT day, {PROFILE_COLUMNS}, retweets_count, ier FROM rates",
    ),
    "engagement_rate_one": _with(
        *PROF_CAND,
        select="""SELECT CAST(sum(retweet_count) AS BIGINT) AS retweets, CAST(sum(favorite_count) AS BIGINT) AS favorites,
  max(followers_count) AS followers,
  round(CAST(sum(retweet_count) + sum(favorite_count) AS DOUBLE) / max(followers_count), 9) AS ier
FROM prof WHERE user_id_str = (SELECT to_user FROM pairs GROUP BY to_user ORDER BY sum(n) DESC, to_user LIMIT 1)""",
    ),
    "post_interactions": _with(*PROF, select="SELECT * FROM " + _interactions("SELECT * FROM prof", "user_id_str, id_str")),
    "counter_maxima": _with(
        *PROF,
        select="""SELECT max(quote_count) AS max_quotes, max(reply_count) AS max_replies,
  max(retweet_count) AS max_retweets FROM prof""",
    ),
    "candidate_post_interactions": _with(
        *PROF_CAND, select="SELECT * FROM " + _interactions(OF_CAND, "user_id_str, id_str")
    ),
    "total_interactions": _with(
        *PROF_CAND,
        select=f"""SELECT user_id_str, CAST(sum(best) AS BIGINT) AS interact_cnt FROM (
  SELECT user_id_str, id_str, max(interact_cnt) AS best
  FROM {_interactions(OF_CAND, 'user_id_str, id_str, day')} GROUP BY user_id_str, id_str) GROUP BY user_id_str""",
    ),
    "received_interactions": _with(
        *GRAPH,
        CAND,
        select="""SELECT to_user AS user_id_str, CAST(sum(n) AS BIGINT) AS re_cnt FROM pairs
WHERE to_user IN (SELECT user_id_str FROM cand) GROUP BY to_user""",
    ),
    "sent_and_original": _with(
        *GRAPH,
        CAND,
        select=f"""SELECT user_id_str, cnt, ori_cnt
FROM (SELECT user_id_str, count(*) AS cnt FROM inter GROUP BY user_id_str)
JOIN (SELECT user_id_str, count(*) AS ori_cnt FROM flat WHERE coalesce({REFERENCES}) IS NULL GROUP BY user_id_str)
USING (user_id_str) WHERE user_id_str IN (SELECT user_id_str FROM cand)""",
    ),
    "sentiment_scores": TURN_SCORES,
    "sentiment_scores_joined": TURN_SCORES,
    "sentiment_scores_rules": _with(*_scored("conversations", "conv_id, turn", RULED_SUMS), select=TURN_COLUMNS),
    "sentiment_by_author": _sentiment_by(
        f"(SELECT * FROM flat WHERE coalesce({REFERENCES}) IS NULL)", "user_id_str", ""
    ),
    "sentiment_by_target": _sentiment_by("inter", "connected_user_single", "_interacting"),
}
