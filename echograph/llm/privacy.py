"""Personal data: base patterns, and a linear-chain CRF over word shapes that adds to them.

The base finds emails, IP addresses, card and phone numbers by fixed patterns.
The CRF labels words from the shapes of a word and its neighbours; it is
trained from a small labelled table and decoded by Viterbi in numpy batches.
Its spans are added where they do not touch a base span and pass the check of
their kind, so it finds what the patterns write differently: numbers without a
plus sign, in brackets, with dots.

Null and empty texts have no spans.  Places are code points.  Every row is
judged for itself and nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echograph.llm import words as W
from echograph.llm.crf import Chain, train
from echograph.llm.sampling import sample_lines

# Fixed values of the base: kinds in order, and their patterns.
KINDS = ["email", "ip", "card", "phone"]
_LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")  # a later digit of the same run would fail alike
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Documents whose lines may become training rows, lines taken from them, and words of a row.
TRAIN_DOCS, TRAIN_LINES, TRAIN_WORDS = 400, 800, 30
#: The CRF's phone numbers have this many digits.
PHONE_DIGITS = (9, 15)

Span = tuple[int, int, int]  # start, end, kind

RESULT = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    """As the pattern ``[A-Za-z0-9._%+-]+@domain`` finds them, in time linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done, 0
        else:
            done = max(done, at + 1)  # no match can reach back over this sign
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Base spans by start, then kind."""
    found = list(_emails(text)) if "@" in text else []
    for m in _IP.finditer(text):
        if all(int(p) <= 255 for p in m[0].split(".") if len(p.lstrip("0")) <= 3) and all(len(p.lstrip("0")) <= 3 for p in m[0].split(".")):
            found.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _digits(m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                found.append((m.start(), m.end(), 3))
    return sorted(found, key=lambda s: (s[0], s[2]))


def _plausible(text: str, kind: int) -> bool:
    digits = _digits(text)
    if kind == 0:
        return re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@]+", text) is not None
    if kind == 1:
        parts = re.split(r"[.:]", text)
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and int(p) <= 255 for p in parts)
    if any(c.isalpha() for c in text):
        return False
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    return PHONE_DIGITS[0] <= len(digits) <= PHONE_DIGITS[1] and re.fullmatch(r"\+?[\d ().\-/]+", text) is not None


_EDGE = "\"'.,;:!?|#*$%&<>=[]{}"


def added_spans(text: str, labelled: list[Span], base: list[Span]) -> list[Span]:
    """The CRF's spans, without signs around them, that pass their check and touch no base span; ``base`` is sorted."""
    out = []
    starts = [s for s, _, _ in base]
    reach = list(accumulate((e for _, e, _ in base), max))  # the furthest end of the first spans
    for start, end, kind in labelled:
        while start < end and text[start] in _EDGE:
            start += 1
        while end > start and text[end - 1] in _EDGE:
            end -= 1
        before = bisect_left(starts, end)
        clear = not before or reach[before - 1] <= start
        if start < end and clear and _plausible(text[start:end], kind):
            out.append((start, end, kind))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda s: (s[0], s[2])))


# The labelled table ---------------------------------------------------------


def _written(rng: np.random.Generator) -> tuple[str, int]:
    """A number as people write it, with its label (0 none, else kind + 1)."""
    d = lambda n: "".join(str(x) for x in rng.integers(0, 10, n))
    pick = lambda *options: options[rng.integers(len(options))]
    which = rng.integers(9)
    if which == 0:
        return pick(f"{d(3)}-{d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"({d(3)}) {d(3)} {d(4)}"), 4
    if which == 1:
        return f"+{rng.integers(1, 99)} ({d(3)}) {d(3)}-{d(4)}", 4
    if which == 2:
        body = pick("4", "5", "6") + d(14)
        card = next(body + str(c) for c in range(10) if luhn(body + str(c)))
        sep = pick("", " ", "-")
        return sep.join(card[i : i + 4] for i in range(0, 16, 4)), 3
    if which == 3:
        return ".".join(str(x) for x in rng.integers(0, 256, 4)), 2
    if which == 4:
        return f"{pick('jo', 'ann', 'info', 'm.lee')}{pick('', d(2))}@{pick('mail', 'host', 'a-b')}.{pick('org', 'com', 'co.uk')}", 1
    plain = (
        f"{rng.integers(1900, 2100)}",
        f"{d(4)}-{d(2)}-{d(2)}",
        f"{d(2)}/{d(2)}/{d(4)}",
        f"{d(2)}.{d(2)}.{d(4)}",
        f"{d(2)}:{d(2)}",
        f"{rng.integers(1, 999)},{d(3)},{d(3)}.{d(2)}",
        f"{rng.integers(0, 99)}.{d(rng.integers(1, 6))}",
        f"v{rng.integers(9)}.{rng.integers(9)}.{rng.integers(9)}",
        f"#{d(5)}",
        f"${d(2)}.{d(2)}",
        f"{d(2)}%",
        f"{d(3)}-{d(3)}",
        f"{d(3)} {d(3)}",
        d(rng.integers(1, 11)),
        rng.bytes(20).hex(),
        "-".join(rng.bytes(n).hex() for n in (4, 2, 2, 2, 6)),
        f"@{pick('user', 'all')}{d(2)}",
    )
    return plain[rng.integers(len(plain))], 0


def labelled_rows(lines: list[str], seed: int = 5) -> list[tuple[list[str], list[int]]]:
    """(words, labels) rows: lines labelled by the base, and the same lines with a written number put in."""
    rng = np.random.default_rng(seed)
    rows = []
    for line in lines:
        words = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\x20\x09-\x0D]+", line)]
        spans = base_spans(line)
        labels = [next((k + 1 for s, e, k in spans if s < b and a < e), 0) for a, b, _ in words]
        begin = int(rng.integers(0, max(1, len(words) - TRAIN_WORDS + 1)))
        own = [w for _, _, w in words][begin : begin + TRAIN_WORDS]
        marks = labels[begin : begin + TRAIN_WORDS]
        rows.append((own, marks))
        item, kind = _written(rng)
        parts = item.split(" ")
        if rng.random() < 0.3:
            parts[-1] += rng.choice([".", ",", "!", "%%%", ";"])
        at = int(rng.integers(0, len(own) + 1))
        rows.append((own[:at] + parts + own[at:], marks[:at] + [kind] * len(parts) + marks[at:]))
    return [r for r in rows if r[0]]


def trained(docs: DataFrame, id_column: str = "doc_id") -> Chain:
    return train(labelled_rows(sample_lines(docs, id_column, TRAIN_DOCS, TRAIN_LINES, seed=11)), labels=len(KINDS) + 1)


# Finding --------------------------------------------------------------------


def _label_spans(chain: Chain, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[Span]]:
    """Runs of one label, as byte spans in the chunk, by row."""
    starts, ends = W.runs(W.PLAIN[data], offsets)
    broken = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 0x0A, out=broken[1:])
    row = W.owner(starts, offsets)
    line = broken[starts] + row  # both only grow, so lines of rows differ
    labels = chain.decode(data, starts, ends, line)
    at = np.flatnonzero(labels)
    if not len(at):
        return {}
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (labels[at[1:]] != labels[at[:-1]]) | (line[at[1:]] != line[at[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    out: dict[int, list[Span]] = {}
    for a, b in zip(at[first], at[last], strict=True):
        out.setdefault(int(row[a]), []).append((int(starts[a]), int(ends[b]), int(labels[a]) - 1))
    return out


_HINT = np.zeros(256, bool)
_HINT[[*range(0x30, 0x3A), 0x40]] = True


def find(chain: Chain | None, data: np.ndarray, offsets: np.ndarray) -> list[tuple[list[Span], list[Span]]]:
    """(base, added) spans of each row of a chunk, in code points."""
    marked = _label_spans(chain, data, offsets) if chain is not None else {}
    hints = W.counts_by_row(_HINT[data], offsets)  # every kind has a digit or an at sign
    out: list[tuple[list[Span], list[Span]]] = []
    for row, hint in enumerate(hints.tolist()):
        if not hint:
            out.append(([], []))
            continue
        body = data[offsets[row] : offsets[row + 1]].tobytes()
        text = body.decode()
        base = base_spans(text)
        own = []
        if row in marked:
            lead = np.concatenate([[0], np.cumsum((np.frombuffer(body, np.uint8) & 0xC0) != 0x80)])
            own = [(int(lead[s - offsets[row]]), int(lead[e - offsets[row]]), k) for s, e, k in marked[row]]
        out.append((base, added_spans(text, own, base)))
    return out


def _scan(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    chain = model.value
    for batch in batches:
        for i, j, data, offsets in W.chunks(batch):
            found = find(chain, data, offsets)
            counts = {f"n_{kind}": pa.array([sum(s[2] == k for s in base) for base, _ in found], pa.int64()) for k, kind in enumerate(KINDS)}
            yield pa.RecordBatch.from_pydict(
                {
                    "id": batch.column("id")[i:j],
                    **counts,
                    "base_sha256": [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found],
                    "spans": [joined(base + own) for base, own in found],
                }
            )


def personal_data(docs: DataFrame, id_column: str = "doc_id", chain: Chain | None = None) -> DataFrame:
    """One row for each document: base counts and digest, and all spans.  Trains on ``docs`` unless given a model."""
    model = docs.sparkSession.sparkContext.broadcast(chain or trained(docs, id_column))  # a table of fixed size
    narrow = docs.select(F.col(id_column).alias("id"), F.col("text").cast("string").alias("text"))
    found = narrow.mapInArrow(partial(_scan, model=model), f"id {narrow.schema['id'].dataType.simpleString()}, {RESULT}")
    return found.withColumnRenamed("id", id_column)
