"""Line-first cleaning: rules on each line, then on what is left of the document.

A line is what lies between newlines; only lines with a word are judged.  A
line fails if it is navigation, if its punctuation is not that of prose, if it
is boilerplate, or if it repeats an earlier line of the document.  A line that
does not end like a sentence, as those of verse and of text wrapped at a width, is
navigation or filling only with another sign of it: few words, separators or
symbols, capitals at most words, or words said twice over.  Failing lines are removed.  A document is rejected if its whole text fails the base
rules (too few words, too much repetition) or if less than ``keep_percent`` of
its words are left.

Null and empty texts have no words and are rejected.  Every row is judged for
itself, so repeated rows get equal verdicts; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echograph.llm import words as W
from echograph.llm.rows import unused

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

#: A line fails with this percentage of separators, symbols or marks to words, and at least that many.
SEPARATOR_PERCENT, SEPARATORS = 20, 2
SYMBOL_PERCENT, SYMBOL_COUNT = 30, 2
MARK_PERCENT, MARKS = 50, 3
#: A line without an end of a sentence fails with fewer words, or with this percentage of symbols, of words with a capital
#: or of words that are the one before again.
FEW_WORDS, UNENDED_SYMBOL_PERCENT, CAPITAL_PERCENT, AGAIN_PERCENT = 5, 10, 60, 25
#: A document needs this part of its words in lines that pass.
KEEP_PERCENT = 50

#: Characters that may end a line of prose: marks of Latin, Chinese and Japanese, Indic, Arabic, Ethiopic, Armenian, Burmese and Khmer script.
ENDS = ".!?:;\"')]}…”’»。！？」』）》．｡।॥؟۔؛።፧፨։။។"

#: A line with one of these, in any case of A-Z, is boilerplate.
BOILERPLATE = [
    "all rights reserved",
    "accept cookies",
    "cookie policy",
    "enable javascript",
    "licensed under the",
    "lorem ipsum",
    "privacy policy",
    "terms of service",
    "terms of use",
]

RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines long, n_lines_kept long, n_words_kept long"
)

_ENDS = [c.encode() for c in ENDS]


def _chars(text: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(text.encode())] = True
    return table


_SYMBOL, _MARK, _SEPARATOR = _chars(SYMBOLS), _chars("!?"), _chars("|")
_CAPITAL = _chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _sums(flags: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int32 if len(flags) < 1 << 31 else np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums


def _repeated(hashes: np.ndarray) -> np.ndarray:
    """True for values that are there twice or more."""
    ordered = np.sort(hashes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(hashes), bool)
    at = np.searchsorted(twice, hashes)
    return twice[np.minimum(at, len(twice) - 1)] == hashes


def _repeat_words(hashes: np.ndarray, word_row: np.ndarray, rows: int) -> np.ndarray:
    """Per row, words inside windows that its text has twice or more."""
    windows = W.window_hashes(hashes, WINDOW)
    whole = word_row[: len(windows)] == word_row[WINDOW - 1 :] if len(windows) else np.empty(0, bool)
    at = np.flatnonzero(whole)
    windows = W.mix(windows[at] ^ W.mix(word_row[at].astype(np.uint64) + np.uint64(1)))
    at = at[_repeated(windows)]
    inside = np.zeros(len(hashes), bool)
    for k in range(WINDOW):
        inside[at + k] = True
    return np.bincount(word_row[inside], minlength=rows)


def _line_ends_well(data: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether the character that ends at byte ``last`` may end a line of prose."""
    good = np.zeros(len(last), bool)
    for mark in _ENDS:
        fits = last >= len(mark) - 1
        for k, byte in enumerate(reversed(mark)):
            fits &= data[np.maximum(last - k, 0)] == byte
        good |= fits
    return good


def _holds(folded: bytes, phrase: bytes, starts: np.ndarray, held: np.ndarray) -> None:
    at = folded.find(phrase)
    while at >= 0:
        held[np.searchsorted(starts, at, "right") - 1] = True
        at = folded.find(phrase, at + 1)


def judge(data: np.ndarray, offsets: np.ndarray, keep_percent: int = KEEP_PERCENT) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Counts and verdict of each row, and of each line: its row, bytes, words and whether it passes."""
    rows = len(offsets) - 1
    starts, ends = W.runs(W.PLAIN[data], offsets)
    word_row = W.owner(starts, offsets)
    n_words = np.bincount(word_row, minlength=rows)
    lead = _sums((data & 0xC0) != 0x80)
    word_chars = np.bincount(word_row, lead[ends] - lead[starts], rows).astype(np.int64)
    symbols, marks, separators = _sums(_SYMBOL[data]), _sums(_MARK[data]), _sums(_SEPARATOR[data])
    hashes = W.span_hashes(data, starts, ends)

    line_starts, line_ends = W.runs(data != 0x0A, offsets)  # lines with no character have no word either
    words_before = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
    full = words_before[1] > words_before[0]
    line_starts, line_ends = line_starts[full], line_ends[full]
    line_words = (words_before[1] - words_before[0])[full]
    last = ends[words_before[1][full] - 1] - 1 if len(line_starts) else np.empty(0, np.int64)
    line_row = W.owner(line_starts, offsets)
    capitals = _sums(_CAPITAL[data[starts]])
    line_capitals = (capitals[words_before[1]] - capitals[words_before[0]])[full]
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[words_before[0][full]] = False
    same = _sums(same)
    line_again = (same[words_before[1]] - same[words_before[0]])[full]

    def percent(sums: np.ndarray, most: int, least: int) -> np.ndarray:
        n = sums[line_ends] - sums[line_starts]
        return (n >= least) & (100 * n > most * line_words)

    whole = W.mix(W.span_hashes(data, line_starts, line_ends) ^ W.mix(line_row.astype(np.uint64) + np.uint64(1)))
    again = np.ones(len(whole), bool)
    again[np.unique(whole, return_index=True)[1]] = False
    held = np.zeros(len(line_starts), bool)
    if len(line_starts):
        folded = W.FOLD[data].tobytes()
        for phrase in BOILERPLATE:
            _holds(folded, phrase.encode(), line_starts, held)
    unended = ~_line_ends_well(data, last) & (
        (line_words < FEW_WORDS)
        | percent(symbols, UNENDED_SYMBOL_PERCENT, 1)
        | (100 * line_capitals >= CAPITAL_PERCENT * line_words)
        | (100 * line_again >= AGAIN_PERCENT * line_words)
    )
    passes = ~(
        again
        | held
        | percent(separators, SEPARATOR_PERCENT, SEPARATORS)
        | percent(symbols, SYMBOL_PERCENT, SYMBOL_COUNT)
        | percent(marks, MARK_PERCENT, MARKS)
        | unended
    )
    n_repeat = _repeat_words(hashes, word_row, rows)
    words_kept = np.bincount(line_row[passes], line_words[passes], rows).astype(np.int64)
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
    verdict = {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": np.bincount(line_row[again], minlength=rows),
        "n_repeat_words": n_repeat,
        "base_failed": failed,
        "kept": ~failed & (100 * words_kept >= keep_percent * n_words),
        "n_lines": np.bincount(line_row, minlength=rows),
        "n_lines_kept": np.bincount(line_row[passes], minlength=rows),
        "n_words_kept": words_kept,
    }
    return verdict, {"row": line_row, "start": line_starts, "end": line_ends, "passes": passes}


def _arrays(verdict: dict[str, np.ndarray]) -> dict[str, pa.Array]:
    return {k: pa.array(v, pa.bool_() if v.dtype == bool else pa.int64()) for k, v in verdict.items()}


def _scan(batches: Iterator[pa.RecordBatch], id_column: str, keep_percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in W.chunks(batch):
            verdict, _ = judge(data, offsets, keep_percent)
            yield pa.RecordBatch.from_pydict({id_column: batch.column(id_column)[i:j], **_arrays(verdict)})


def judged(docs: DataFrame, id_column: str = "doc_id", text: str = "text", keep_percent: int = KEEP_PERCENT) -> DataFrame:
    """One row for each document: its id, the counts and the verdict."""
    narrow = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))
    found = narrow.mapInArrow(partial(_scan, id_column="id", keep_percent=keep_percent), f"id {narrow.schema['id'].dataType.simpleString()}, {RESULT}")
    return found.withColumnRenamed("id", id_column)


def _clean(batches: Iterator[pa.RecordBatch], text: str, keep_percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in W.chunks(batch, text):
            verdict, lines = judge(data, offsets, keep_percent)
            kept = np.flatnonzero(verdict["kept"])
            first = np.searchsorted(lines["row"], np.arange(j - i + 1))
            body = data.tobytes()
            texts = []
            for row in kept:
                a, b = first[row], first[row + 1]
                if lines["passes"][a:b].all():
                    texts.append(body[offsets[row] : offsets[row + 1]].decode())
                    continue
                spans = zip(lines["start"][a:b], lines["end"][a:b], lines["passes"][a:b], strict=True)
                texts.append("\n".join(body[s:e].decode() for s, e, ok in spans if ok))
            rest = batch.drop_columns([text]).slice(i, j - i).take(pa.array(kept))
            yield rest.append_column(text, pa.array(texts, pa.string()))


def cleaned(docs: DataFrame, keep_percent: int = KEEP_PERCENT) -> DataFrame:
    """The documents kept, with failing lines removed and ``n_chars`` brought up to date; columns as in ``docs``.

    A text all of whose lines pass stays as it is.  Other columns are passed on.
    """
    text = unused(docs, "__text")
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    narrow = docs.select(*others, F.col("text").cast("string").alias(text))
    found = narrow.mapInArrow(partial(_clean, text=text, keep_percent=keep_percent), narrow.schema)
    found = found.withColumn("text", F.col(text))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


_SQL_ENDS = re.escape(ENDS).replace("'", "''")

#: The query's columns in SQL.
ORACLE = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
pos AS (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW} + 2)) AS p FROM w WHERE len(ws) >= {WINDOW}),
win AS (SELECT r, p, count(*) OVER (PARTITION BY r, ws[p:p + {WINDOW} - 1]) AS c FROM pos),
rep AS (SELECT r, count(DISTINCT p + k) AS n FROM win, (SELECT unnest(range(0, {WINDOW})) AS k) WHERE c > 1 GROUP BY r),
cut AS (SELECT r, string_split(text, chr(10)) AS ls FROM t),
ln AS (SELECT r, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM cut),
lw AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lws, len(lws) AS nw, row_number() OVER (PARTITION BY r, line ORDER BY i) AS k FROM ln),
lj AS (
  SELECT r, nw, k > 1 AS again, NOT (
    k > 1
    OR (len(regexp_extract_all(line, '[|]')) >= {SEPARATORS} AND 100 * len(regexp_extract_all(line, '[|]')) > {SEPARATOR_PERCENT} * nw)
    OR (len(regexp_extract_all(line, '[#*$%&|<>]')) >= {SYMBOL_COUNT} AND 100 * len(regexp_extract_all(line, '[#*$%&|<>]')) > {SYMBOL_PERCENT} * nw)
    OR (len(regexp_extract_all(line, '[!?]')) >= {MARKS} AND 100 * len(regexp_extract_all(line, '[!?]')) > {MARK_PERCENT} * nw)
    OR regexp_matches(line, '(?i)({"|".join(BOILERPLATE)})')
    OR (NOT regexp_matches(line, '[{_SQL_ENDS}][\x20\x09-\x0D]*$') AND (
      nw < {FEW_WORDS}
      OR 100 * len(regexp_extract_all(line, '[#*$%&|<>]')) > {UNENDED_SYMBOL_PERCENT} * nw
      OR 100 * len(regexp_extract_all(line, '(?:^|[\x20\x09-\x0D])[A-Z]')) >= {CAPITAL_PERCENT} * nw
      OR 100 * len([x for x in range(2, nw + 1) if lws[x] = lws[x - 1]]) >= {AGAIN_PERCENT} * nw))
  ) AS passes FROM lw WHERE nw > 0),
lr AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (again) AS n_dup_lines, count(*) FILTER (passes) AS n_lines_kept,
    coalesce(sum(nw) FILTER (passes), 0)::BIGINT AS n_words_kept FROM lj GROUP BY r),
b AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(list_aggregate(ws, 'string_agg', ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines,
    coalesce(n_lines_kept, 0)::BIGINT AS n_lines_kept, coalesce(n_words_kept, 0)::BIGINT AS n_words_kept
  FROM w LEFT JOIN rep USING (r) LEFT JOIN lr USING (r))
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
    AND 100 * n_words_kept >= {KEEP_PERCENT} * n_words AS kept,
  n_lines, n_lines_kept, n_words_kept
FROM b
"""
