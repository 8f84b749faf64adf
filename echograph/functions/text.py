"""Column functions on post text and dates; all stay in the JVM."""

from __future__ import annotations

import re
import string
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


_ASCII_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def term_pattern(terms: Sequence[str], unicode_case: bool = False) -> str:
    """One case-insensitive alternation over literal terms.

    Java folds ASCII only under ``(?i)``; ``unicode_case`` also folds accented
    letters, so that an upper-case accented term is found.

    The pattern tells whether any term occurs, no more, so a term that contains
    another one is left out, and a look at one character comes before the terms.
    """
    if not terms or "" in terms:
        raise ValueError("at least one term is needed, and none may be empty")
    folded = list(dict.fromkeys(term.translate(_ASCII_LOWER) for term in terms))
    needed = [t for t in folded if not any(other != t and other in t for other in folded)]
    first = "".join(dict.fromkeys(re.escape(t[0]) for t in needed))
    flags = "(?iu)" if unicode_case else "(?i)"
    return f"{flags}(?=[{first}])(?:{'|'.join(map(re.escape, needed))})"


def mentions(text: Column, tags: Column, terms: Sequence[str], unicode_case: bool = False) -> Column:
    """True when the text or the joined hashtags hold one of the terms.

    The OR is three-valued: a null text with a matching hashtag is kept.  Hashtags
    are short and come first; a text is only searched where they hold no term.
    """
    pattern = term_pattern(terms, unicode_case)
    return tags.rlike(pattern) | text.rlike(pattern)


def joined_tags(tags: Column) -> Column:
    """Hashtags as one string; a null array gives the empty string."""
    return F.concat_ws(",", tags)


def words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z]+)"), 1), F.lower)


#: Beyond ASCII, the only characters whose small form holds a letter of a-z.
_SMALL_ASCII = "\u0130\u212a"


def letter_runs(text: Column) -> Column:
    """``words`` by generated code: lower-cased runs of ASCII letters, with ``''`` before or after where the text has other signs there."""
    odd = F.contains(text, F.lit(_SMALL_ASCII[0])) | F.contains(text, F.lit(_SMALL_ASCII[1]))
    return F.split(F.lower(F.when(odd, F.translate(text, _SMALL_ASCII, "  ")).otherwise(text)), "[^a-z]+")


def post_time(created_at: Column) -> Column:
    """Timestamp of a text date such as ``Tue Feb 15 01:02:03 +0000 2022``.

    The weekday is cut off first, as it cannot be parsed; bad text gives null.
    """
    return F.try_to_timestamp(F.substring(created_at, 5, 30), F.lit("MMM dd HH:mm:ss Z yyyy"))
