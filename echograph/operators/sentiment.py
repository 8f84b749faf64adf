"""Lexicon-based sentiment of a text column.

The lexicon is a table ``(token, valence)``.  Per text, with ``total`` the sum of
the valences of its words: ``compound = total / sqrt(total^2 + alpha)``; ``pos``
sums ``v + 1`` over positive words, ``neg`` sums ``|v| + 1`` over negative ones,
``neu`` counts the rest, each as a share of the three.  This is the core of the
VADER method (Hutto & Gilbert 2014).  ``Rules`` adds its boosters, negations,
capitals and exclamation marks.

Valences are taken to nine decimals and added as whole numbers, so a sum does not
depend on the order of its terms: both forms give the same scores, bit for bit.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echograph.functions.text import letter_runs, words
from echograph.operators.skew import balanced_join, heavy_keys, row_counts
from echograph.sources.tables import stored

#: Entries that a lexicon written into the query may have.
LEXICON_IN_QUERY = 50_000

#: Valences are whole numbers of this part of one.
UNIT = 10**9

SCORES = [
    "sentiment_neg",
    "sentiment_neu",
    "sentiment_pos",
    "sentiment_compound",
    "sentiment_compound_pos_ind",
]


# Fixed values of the published method: increments and words.
BOOST, CAPITALS, EXCLAMATION, NEGATED, MOST_MARKS = 0.293, 0.733, 0.292, -0.74, 4
#: What is left of a booster one, two and three words before.
FADING = [1.0, 0.95, 0.9]
MORE = ["absolutely", "completely", "extremely", "highly", "incredibly", "more", "most", "really", "so", "totally", "very"]
LESS = ["almost", "barely", "hardly", "less", "little", "partly", "scarcely", "slightly", "somewhat"]
NOT = ["aint", "cannot", "neither", "never", "none", "nor", "not", "nothing", "nowhere", "rarely", "seldom", "without"]


@dataclass(frozen=True)
class Rules:
    """Changes to a word's valence by the three words before it, by its capitals, and by the text's marks."""

    boosters: Mapping[str, float] = field(default_factory=lambda: dict.fromkeys(MORE, BOOST) | dict.fromkeys(LESS, -BOOST))
    negations: Sequence[str] = tuple(NOT)


def _entries(lex: DataFrame) -> DataFrame:
    """``token, valence, other, unknown`` of each lower-cased token: its least and greatest valence, and entries without one."""
    entries = lex.select(F.lower("token").alias("token"), F.col("valence").cast("double").alias("valence"))
    return entries.groupBy("token").agg(F.min("valence").alias("valence"), F.max("valence").alias("other"), F.count_if(F.col("valence").isNull()).alias("unknown"))


#: What makes an entry wrong, in SQL.
_WRONG = "token IS NULL OR unknown > 0 OR valence != other"


def _refused(tokens: list[str | None]) -> None:
    if tokens:
        raise ValueError(f"lexicon entries without one valence: {tokens[:5]}")


def checked_lexicon(lex: DataFrame) -> DataFrame:
    """``(token, valence)`` with lower-cased tokens, each once.

    A missing token or valence, or two valences for one token, is an error.
    """
    each = stored(_entries(lex), "lexicon")
    _refused([r["token"] for r in each.filter(_WRONG).orderBy("token").limit(5).collect()])
    return each.select("token", "valence")


def _slot(token: Column, slots: int) -> Column:
    return F.pmod(F.hash(token), F.lit(slots))


def _units(valence: Column) -> Column:
    return F.round(valence * F.lit(UNIT)).cast("long")


@dataclass(frozen=True)
class _Lexicon:
    """The lexicon as a constant array of small maps, found by a token's hash.

    A map is searched entry by entry, so one large map would cost its whole
    length per word; here a word costs one array access and about one compare.
    """

    table: list[dict[str, float]]

    @classmethod
    def of(cls, lex: DataFrame) -> _Lexicon:
        """Checked, in one job that brings no more than ``LEXICON_IN_QUERY`` entries and one."""
        rows = _entries(lex).select("token", "valence", F.expr(_WRONG).alias("wrong"), F.hash("token").alias("h")).limit(LEXICON_IN_QUERY + 1).collect()
        _refused([r["token"] for r in rows if r["wrong"]])
        if len(rows) > LEXICON_IN_QUERY:
            raise ValueError(f"more than {LEXICON_IN_QUERY} lexicon entries: use form='join'")
        table: list[dict[str, float]] = [{} for _ in range(max(1, len(rows)))]
        for r in rows:
            table[r["h"] % len(table)][r["token"]] = r["valence"]
        return cls(table)

    def valence(self, token: Column) -> Column:
        column = F.from_json(F.lit(json.dumps(self.table)), "array<map<string,double>>")
        return F.coalesce(F.try_element_at(F.get(column, _slot(token, len(self.table))), token), F.lit(0.0))

    def units(self, token: Column) -> Column:
        """Valence of a token in units; null if it is not in the lexicon."""
        table = [{t: round(v * UNIT) for t, v in part.items()} for part in self.table]
        column = F.from_json(F.lit(json.dumps(table)), "array<map<string,bigint>>")
        return F.try_element_at(F.get(column, _slot(token, len(self.table))), token)


SUMS = ["total", "pos", "neg", "neu"]


def _parts(v: Column) -> dict[str, Column]:
    """What a word of valence ``v`` adds to each sum."""
    zero = F.lit(0.0)
    return {
        "total": v,
        "pos": F.when(v > 0, v + 1).otherwise(zero),
        "neg": F.when(v < 0, 1 - v).otherwise(zero),
        "neu": F.when(v == 0, F.lit(1.0)).otherwise(zero),
    }


#: Exact sums: units of positive and of negative valences, words of either kind, all words.
COUNTS = ["pos_units", "neg_units", "n_pos", "n_neg", "n_words"]


def _count_parts(v: Column, n: Column) -> dict[str, Column]:
    """What ``n`` words of ``v`` units add to each count."""
    zero = F.lit(0).cast("long")
    return {
        "pos_units": F.when(v > 0, n * v).otherwise(zero),
        "neg_units": F.when(v < 0, n * -v).otherwise(zero),
        "n_pos": F.when(v > 0, n).otherwise(zero),
        "n_neg": F.when(v < 0, n).otherwise(zero),
        "n_words": n,
    }


def _of_counts(count: Callable[[str], Column]) -> dict[str, Column]:
    """The sums of exact counts."""
    unit = F.lit(float(UNIT))
    return {
        "total": (count("pos_units") - count("neg_units")) / unit,
        "pos": count("pos_units") / unit + count("n_pos"),
        "neg": count("neg_units") / unit + count("n_neg"),
        "neu": (count("n_words") - count("n_pos") - count("n_neg")).cast("double"),
    }


def _counts(apart: Column, lexicon: _Lexicon) -> Column:
    """All counts of a text's ``letter_runs`` as a struct.

    Words are looked up first; only those of the lexicon are added.
    """
    one = F.lit(1).cast("long")
    names = COUNTS[:-1]
    start = F.struct(*[F.lit(0).cast("long").alias(name) for name in names])

    def add(counts: Column, v: Column) -> Column:
        parts = _count_parts(v, one)
        return F.struct(*[(counts[name] + parts[name]).alias(name) for name in names])

    known = F.filter(apart, lambda word: lexicon.units(word).isNotNull())
    sums = F.aggregate(F.transform(known, lexicon.units), start, add)
    edges = (F.element_at(apart, 1) == "").cast("int") + ((F.size(apart) > 1) & (F.element_at(apart, -1) == "")).cast("int")
    return F.struct(sums.alias("sums"), (F.size(apart) - edges).cast("long").alias("n_words"))


def _ruled_sums(text: Column, lexicon: _Lexicon, rules: Rules) -> Column:
    """The sums with ``rules``, in one pass that remembers the three words before."""
    boosts = F.create_map(*[F.lit(x) for pair in rules.boosters.items() for x in pair])
    negations = F.array(*map(F.lit, rules.negations))
    mixed = text.rlike("[a-z]")
    before = ["b1", "b2", "b3"]
    denied = ["g1", "g2", "g3"]
    zero = {name: F.lit(0.0) for name in SUMS + before} | {name: F.lit(False) for name in denied}

    def add(state: Column, word: Column) -> Column:
        token = F.lower(word)
        v = lexicon.valence(token)
        loud = F.when(mixed & (F.length(word) > 1) & (word == F.upper(word)), F.lit(CAPITALS)).otherwise(F.lit(0.0))
        more = sum((state[b] * F.lit(part) for b, part in zip(before, FADING, strict=True)), loud)
        turned = F.when(state["g1"] | state["g2"] | state["g3"], F.lit(NEGATED)).otherwise(F.lit(1.0))
        parts = _parts((v + F.signum(v) * more) * turned)
        new = {name: state[name] + part for name, part in parts.items()}
        new |= {"b1": F.coalesce(F.try_element_at(boosts, token), F.lit(0.0)), "b2": state["b1"], "b3": state["b2"]}
        new |= {"g1": F.array_contains(negations, token), "g2": state["g1"], "g3": state["g2"]}
        return F.struct(*[new[name].alias(name) for name in zero])

    def finish(state: Column) -> Column:
        marks = F.least(F.regexp_count(text, F.lit("!")), F.lit(MOST_MARKS)) * F.lit(EXCLAMATION)
        out = {
            "total": state["total"] + F.signum(state["total"]) * marks,
            "pos": state["pos"] + F.when(state["pos"] > state["neg"], marks).otherwise(F.lit(0.0)),
            "neg": state["neg"] + F.when(state["neg"] > state["pos"], marks).otherwise(F.lit(0.0)),
            "neu": state["neu"],
        }
        return F.struct(*[out[name].alias(name) for name in SUMS])

    start = F.struct(*[value.alias(name) for name, value in zero.items()])
    return F.aggregate(F.regexp_extract_all(text, F.lit("([A-Za-z]+)"), 1), start, add, finish)


def _scores(alpha: float) -> list[Column]:
    """Score columns of the sums, as ``scored_total`` and so on; null sums give null scores."""
    total, pos, neg, neu = (F.col(f"scored_{name}") for name in SUMS)
    weight = pos + neg + neu

    def share(part: Column) -> Column:
        return F.when(weight > 0, part / weight).when(weight == 0, F.lit(0.0))

    compound = total / F.sqrt(total * total + F.lit(float(alpha)))
    return [
        share(neg).alias("sentiment_neg"),
        share(neu).alias("sentiment_neu"),
        share(pos).alias("sentiment_pos"),
        compound.alias("sentiment_compound"),
        F.when(compound >= 0, 1).otherwise(0).alias("sentiment_compound_pos_ind"),
    ]


def with_scores(
    df: DataFrame, text: str, lex: DataFrame, alpha: float = 15.0, rules: Rules | None = None
) -> DataFrame:
    """``df`` without ``text`` and with the five score columns; rows are scored where they are.

    For posts that several rows are made of: score first, then explode.
    """
    lexicon = _Lexicon.of(lex)
    others = [c for c in df.columns if c != text]
    if rules is None:
        # A column of its own, since it is used more than once.
        parted = df.select(*others, letter_runs(F.col(text)).alias("scored_words"))
        counted = parted.select(*others, _counts(F.col("scored_words"), lexicon).alias("scored_counts"), F.col("scored_words").isNotNull().alias("scored_known"))
        counts = lambda name: F.col("scored_counts")[name] if name == "n_words" else F.col("scored_counts")["sums"][name]
        sums = {name: F.when(F.col("scored_known"), value) for name, value in _of_counts(counts).items()}
    else:
        counted = df.select(*others, _ruled_sums(F.col(text), lexicon, rules).alias("scored_counts"))
        sums = {name: F.col("scored_counts")[name] for name in SUMS}
    return counted.select(*others, *[value.alias(f"scored_{name}") for name, value in sums.items()]).select(*others, *_scores(alpha))


def sentiment_scores(
    df: DataFrame,
    id: str | list[str],
    text: str,
    lex: DataFrame,
    alpha: float = 15.0,
    form: str = "query",
    rules: Rules | None = None,
) -> DataFrame:
    """``id`` columns and five scores per row of ``df``.

    Neutral text counts as positive; text without words scores 0; a null text
    has null scores and flag 0.  ``id`` need not be unique.  ``form`` is the
    caller's choice and changes no score: ``query`` writes the lexicon into the
    query, so rows are scored where they are, and refuses more than
    ``LEXICON_IN_QUERY`` entries; ``join`` joins it word by word, whatever its size.
    ``rules`` need the words in order and so go with ``query`` only.
    """
    ids = [id] if isinstance(id, str) else list(id)
    if form not in ("query", "join"):
        raise ValueError(f"unknown form {form!r}")
    if rules is not None and form != "query":
        raise ValueError("rules need form='query'")
    if form == "join":
        return _joined_sums(df, ids, text, checked_lexicon(lex)).select(*ids, *_scores(alpha))
    return with_scores(df.select(*ids, F.col(text).alias("scored_text")), "scored_text", lex, alpha, rules)


def _joined_sums(df: DataFrame, ids: list[str], text: str, lex: DataFrame) -> DataFrame:
    """Sums per row by a join of its distinct words; frequent words are split.

    Rows get a key of their own, which is written before it is used.
    """
    keyed = stored(df.select(*ids, F.col(text).alias("scored_text"), F.expr("uuid()").alias("row_key")), "texts")
    row = ["row_key", *ids]
    token = F.explode_outer(words(F.col("scored_text"))).alias("token")
    counted = stored(
        keyed.select(*row, token, F.col("scored_text").isNull().alias("absent"))
        .groupBy(*row, "absent", "token")
        .agg(F.count("token").alias("n")),
        "words",
    )
    valences = lex.select("token", _units(F.col("valence")).alias("v"))
    heavy = heavy_keys(stored(row_counts(counted, "token"), "token-counts"), "token")
    joined = balanced_join(counted, valences, "token", "row_key", heavy, "left")
    parts = _count_parts(F.coalesce(F.col("v"), F.lit(0).cast("long")), F.col("n"))
    counts = joined.groupBy(*row, "absent").agg(*[F.sum(part).alias(name) for name, part in parts.items()])
    sums = _of_counts(F.col)
    return counts.select(*ids, *[F.when(~F.col("absent"), value).alias(f"scored_{name}") for name, value in sums.items()])


def sentiment_by(scored: DataFrame, key: str) -> DataFrame:
    """Rows, positive rows and mean compound score per ``key``.

    By ``user_id_str``: what authors write themselves.  By
    ``connected_user_single``: what those referring to a user write.
    """
    suffix = "_interacting" if key == "connected_user_single" else ""
    return scored.groupBy(key).agg(
        F.count(F.lit(1)).alias(f"num_original_tweets{suffix}"),
        F.sum("sentiment_compound_pos_ind").alias(f"num_pos_tweets{suffix}"),
        F.avg("sentiment_compound").alias(f"avg_sentiment_compound{suffix}"),
    )
