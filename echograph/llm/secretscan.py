"""Secret scan: candidates by form, false positives removed by a random forest.

A candidate is a run of at least 16 letters, digits and ``+/_=-`` that has a
digit, or that stands in quotes behind ``=`` or ``:``; a value of at least six
characters without white space behind a name like ``password`` and ``=`` or ``:``;
or the password of a login in a URL.  Of nested candidates the widest counts.  The
forest judges each by its length, the transitions of its characters, how much of it common words of
the corpus cover, the path of its document and the neighbouring words.  It is
trained by Spark from a small table of labelled findings.

The dictionary is counted over all documents: words of 3 to ``LONGEST`` letters that
make up at least one part in ``SHARE`` of all of them, so it never has more than
``SHARE`` entries.

Null and empty texts have no candidates; a null path has no path words.  Every
row is judged for itself, so repeated rows give repeated findings.  An empty
table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echograph.llm import words as W
from echograph.llm.sampling import sample_lines
from echograph.sources.tables import stored

SHARE = 20_000
LONGEST = 40
#: Bounds of the labelled table: context lines taken from the corpus, findings per line.
TRAIN_DOCS, TRAIN_LINES = 200, 1200
NEAR = 40  # characters on each side in which neighbouring words count
THRESHOLD = 0.5

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_DIGIT = re.compile(r"[0-9]")
_ASSIGNED = re.compile(r"[=:]\s{0,3}[\"']\Z")
#: A name that says that a secret follows, at the end of what stands before ``=`` or ``:``; names are looked for this far back.
_NAMED = re.compile(r"(?i)(key|token|secret|passw(or)?d|passphrase|pwd|auth|credentials?)[A-Za-z0-9_]{0,16}[\"']?\s{0,3}\Z")
BACK = 48
_VALUE = re.compile(r"\s{0,3}(?:\"([^\"\s]{6,})\"|'([^'\s]{6,})'|([^\s\"',;<>()]{6,}))")
_LOGIN = re.compile(r"[^\s/:@]+:([^\s/@]+)@")
_LOGIN_BEFORE = re.compile(r"://[^\s/:@]+:\Z")
_SECRET_WORD = re.compile(r"(?i)(key|token|secret|passw|pwd|auth|bearer|credential|private)")
_OTHER_WORD = re.compile(r"(?i)(sha|md5|hash|digest|checksum|commit|uuid|guid|etag|build|revision|example|sample|dummy|placeholder|isbn|order)")
_PATH_TEST = re.compile(r"(?i)(test|example|sample|fixture|mock|doc)")
_PATH_CONFIG = re.compile(r"(?i)(\.env|config|settings|deploy|secret|credential|\.ya?ml|\.ini|\.pem)")
_PREFIX = re.compile(r"^(AKIA|ASIA|gh[pousr]_|xox[abp]-|sk-|sk_live_|AIza|eyJ)")

_FINDING = "start long, end long, features array<double>"


# Dictionary -----------------------------------------------------------------

_LETTERS = W._table([*range(0x41, 0x5B), *range(0x61, 0x7B)], inside=True)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in W.chunks(batch):
            starts, ends = W.runs(_LETTERS[data], offsets)
            long_enough = (ends - starts >= 3) & (ends - starts <= LONGEST)
            starts, ends = starts[long_enough], ends[long_enough]
            _, first, n = np.unique(W.span_hashes(data, starts, ends, fold=True), return_index=True, return_counts=True)
            body = W.FOLD[data].tobytes()
            own = [body[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"word": pa.array(own, pa.binary()).cast(pa.string()), "n": pa.array(n, pa.int64())})


def dictionary(docs: DataFrame, share: int = SHARE) -> dict[str, int]:
    """Common words of ASCII letters with their counts over all documents; at most ``share`` of them."""
    narrow = docs.select(F.col("text").cast("string").alias("text"))
    counts = stored(narrow.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "word_counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return {r["word"]: r["n"] for r in counts.filter(F.col("n") * share >= total).orderBy("word").collect()}


class Language:
    """What common words look like: the words, and how likely one letter follows another."""

    def __init__(self, common: dict[str, int]) -> None:
        self.words = frozenset(common)
        self.begin = frozenset(word[:k] for word in common for k in range(3, len(word) + 1))
        pairs, singles = Counter(), Counter()
        for word, n in common.items():
            for a, b in zip(word, word[1:], strict=False):
                pairs[a + b] += n
                singles[a] += n
        self.follows = {p: math.log((n + 1) / (singles[p[0]] + 26)) for p, n in pairs.items()}
        self.unseen = math.log(1 / 2000)

    def likely(self, text: str) -> float:
        """Mean log-likelihood of its letter pairs; other pairs count as unseen."""
        low = text.lower()
        return sum(self.follows.get(low[i : i + 2], self.unseen) for i in range(len(low) - 1)) / max(1, len(low) - 1)

    def covered(self, text: str) -> float:
        """Part of the text that dictionary words cover, longest first from the left."""
        low, at, inside = text.lower(), 0, 0
        while at < len(low):
            size, k = 0, 3
            while at + k <= len(low) and low[at : at + k] in self.begin:  # no further than a word goes on
                if low[at : at + k] in self.words:
                    size = k
                k += 1
            inside += size
            at += size or 1
        return inside / max(1, len(low))


# Findings -------------------------------------------------------------------


def features(language: Language, text: str, start: int, end: int, path: str | None) -> list[float]:
    """What the forest knows of a candidate."""
    own, before, after = text[start:end], text[max(0, start - NEAR) : start], text[end : end + NEAR]
    kind = [0 if "0" <= c <= "9" else 1 if c.islower() else 2 if c.isupper() else 3 for c in own]
    n = len(own)
    counts = Counter(own)
    entropy = -sum(v / n * math.log2(v / n) for v in counts.values())
    path = path or ""
    return [
        float(n),
        kind.count(0) / n,
        kind.count(2) / n,
        kind.count(3) / n,
        sum(a != b for a, b in zip(kind, kind[1:], strict=False)) / max(1, n - 1),
        entropy,
        float(max(counts.values())) / n,
        float(re.fullmatch(r"[0-9a-fA-F]+", own) is not None),
        float(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", own) is not None),
        float(_PREFIX.match(own) is not None),
        language.likely(own),
        language.covered(own),
        float(_ASSIGNED.search(before) is not None),
        float(_SECRET_WORD.search(before) is not None),
        float(_OTHER_WORD.search(before) is not None),
        float(_SECRET_WORD.search(after) is not None),
        float(_SECRET_WORD.search(own) is not None or _OTHER_WORD.search(own) is not None),
        float(_named(text, start)),
        float(after.startswith("@") and _LOGIN_BEFORE.search(text, max(0, start - 4 * NEAR), start) is not None),
        float(own.startswith(("$", "{", "<", "%", "*")) or own.endswith(("}", ")", ">", "%", "*"))),
        float(_PATH_TEST.search(path) is not None),
        float(_PATH_CONFIG.search(path) is not None),
    ]


def _named(text: str, start: int) -> bool:
    """Whether a value at ``start`` stands behind a secret's name and ``=`` or ``:``."""
    at = start - 1
    while at >= max(0, start - 5) and (text[at].isspace() or text[at] in "\"'"):
        at -= 1
    return at >= 0 and text[at] in "=:" and _NAMED.search(text, max(0, at - BACK), at) is not None


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of candidates, in code points, in order; none within another."""
    found = []
    for m in CANDIDATE.finditer(text):
        if _DIGIT.search(m[0]) or _ASSIGNED.search(text, max(0, m.start() - 6), m.start()):
            found.append(m.span())
    for m in _GIVES.finditer(text):
        if _NAMED.search(text, max(0, m.start() - BACK), m.start()):
            value = _VALUE.match(text, m.end())
            if value:
                found.append(value.span(value.lastindex))
    at = text.find("://")
    while at >= 0:
        login = _LOGIN.match(text, at + 3)
        if login:
            found.append(login.span(1))
        at = text.find("://", at + 3)
    out: list[tuple[int, int]] = []
    for start, end in sorted(set(found), key=lambda s: (s[0], -s[1])):
        if not out or end > out[-1][1]:
            out.append((start, end))
    return out


_GIVES = re.compile("[=:]")
_CLASS = W._table([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *b"+/_=-"], inside=True)
_GIVING = W._table([*b"=:"], inside=True)


def _rows_to_search(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Only these can hold a candidate: a long run, or ``=`` or ``:``."""
    starts, ends = W.runs(_CLASS[data], offsets)
    long = W.owner(starts[ends - starts >= 16], offsets)
    return np.unique(np.concatenate([long, W.owner(np.flatnonzero(_GIVING[data]), offsets)]))


def _scan(batches: Iterator[pa.RecordBatch], language) -> Iterator[pa.RecordBatch]:
    language = language.value
    for batch in batches:
        paths = batch.column("path")
        for i, _, data, offsets in W.chunks(batch):
            rows, found = [], []
            for row in _rows_to_search(data, offsets).tolist():
                text = data[offsets[row] : offsets[row + 1]].tobytes().decode()
                for start, end in candidates(text):
                    rows.append(i + row)
                    found.append((start, end, features(language, text, start, end, paths[i + row].as_py())))
            yield pa.RecordBatch.from_pydict(
                {
                    "id": batch.column("id").take(pa.array(rows, pa.int64())),
                    "start": pa.array([f[0] for f in found], pa.int64()),
                    "end": pa.array([f[1] for f in found], pa.int64()),
                    "features": pa.array([f[2] for f in found], pa.list_(pa.float64())),
                }
            )


# The labelled table ---------------------------------------------------------


def written_finding(rng: np.random.Generator) -> tuple[str, str, str, int]:
    """(words before, finding, words after, 1 for a secret) as found in code and logs."""
    pick = lambda *options: options[rng.integers(len(options))]
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    text = lambda n, of=signs: "".join(of[i] for i in rng.integers(0, len(of), n))
    name = pick("token", "api_key", "secret", "password", "auth_token", "client_secret", "access_key", "PRIVATE_KEY")
    give = pick(' = "', "='", ': "', "=", ": ", " = ")
    close = '"' if give.endswith('"') else "'" if give.endswith("'") else ""
    if rng.random() < 0.5:
        value = pick(
            rng.bytes(int(pick(16, 20, 32))).hex(),
            text(int(rng.integers(20, 64))),
            text(40, signs + "+/"),
            "AKIA" + text(16, signs[:26] + signs[52:]),
            "ghp_" + text(36),
            "sk_live_" + text(24),
        )
        kind = rng.random()
        if kind < 0.25:  # passwords as people choose them
            signs_too = signs + "!@#$%&*?.-_+"
            word = "".join(pick(*signs[26:52]) for _ in range(int(rng.integers(3, 8))))
            value = pick(text(int(rng.integers(8, 16)), signs_too).replace("@", "!"), word.capitalize() + text(int(rng.integers(2, 5)), signs[52:]) + pick("!", "&", "#", "$", ""))
            return name + give, value, close, 1
        if kind < 0.35:
            return pick("postgres", "https", "mysql", "amqp", "ftp") + "://" + text(int(rng.integers(3, 9)), signs[26:52]) + ":", text(int(rng.integers(6, 20)), signs + "!$%-_."), "@" + pick("db.host", "10.0.0.3:5432", "example.org") + "/x", 1
        if kind < 0.42:
            return name + give, text(int(rng.integers(16, 40)), signs[:52]), close, 1
        return (name + give if rng.random() < 0.9 else pick("Bearer ", "curl -u ", "")), value, close, 1
    which = rng.integers(11)
    if which >= 8:  # what stands behind such a name and is none
        word = "".join(pick(*signs[26:52]) for _ in range(int(rng.integers(6, 11))))
        value = pick("required", "optional", "string", "enabled", "undefined", "password", "changeme", "your_password", "example", "********", "xxxxxxxx", "${DB_PASSWORD}", "{{secret}}", "process.env.TOKEN", "get_token()", "os.environ", "None,None", "http://host/auth", word, word.capitalize())
        return name + give, value, close, 0
    if which == 0:
        return pick("sha256 ", "commit ", "md5: ", "checksum = ", "etag: "), rng.bytes(int(pick(16, 20, 32))).hex(), "", 0
    if which == 1:
        return pick("id ", "uuid = ", "request ", ""), "-".join(rng.bytes(n).hex() for n in (4, 2, 2, 2, 6)), "", 0
    if which == 2:
        return name + give, pick("your-api-key-goes-here-1", "xxxxxxxxxxxxxxxxxxxx1", "EXAMPLE_KEY_0000000000", "changeme-changeme-1234", "0000000000000000000000"), close, 0
    if which == 3:
        return pick("order ", "card ", "number ", ""), text(int(rng.integers(16, 20)), signs[52:]), "", 0
    if which == 4:
        return pick("see ", "open ", ""), "/".join(pick("usr", "lib", "data", "images", "2021", "part", "index") for _ in range(6)) + "/1", "", 0
    if which == 5:
        return pick("", "call "), "_".join(pick("get", "user", "name", "list", "from", "cache", "v2") for _ in range(5)) + "_1", "()", 0
    if which == 6:
        return "", pick("----------------------1", "=====================2", "20210512-104530-000123"), "", 0
    return pick('class = "', 'title: "'), "-".join(pick("button", "primary", "large", "wide", "col") for _ in range(4)), '"', 0


def labelled_findings(lines: list[str], language: Language, seed: int = 9) -> list[tuple[list[float], int]]:
    """(features, label) of written findings put into lines of the corpus, in paths of several kinds."""
    rng = np.random.default_rng(seed)
    paths = [None, "src0", "app/config.yml", "deploy/.env", "tests/test_login.py", "docs/example.md", "lib/main.c"]
    out = []
    for line in lines:
        words = line.split(" ")
        at = int(rng.integers(0, len(words) + 1))
        head = " ".join(words[:at]) + " " * bool(at)
        before, finding, after, label = written_finding(rng)
        text = head + before + finding + after + " " + " ".join(words[at:])
        start = len(head) + len(before)
        path = paths[rng.integers(len(paths))]
        out.append((features(language, text, start, start + len(finding), path), label))
    return out


def train(spark: SparkSession, findings: list[tuple[list[float], int]], trees: int = 40, depth: int = 8, seed: int = 3) -> RandomForestClassificationModel:
    """A forest from labelled findings, a bounded table."""
    table = spark.createDataFrame(findings, "features array<double>, label int").coalesce(1)
    table = table.select(array_to_vector("features").alias("vector"), F.col("label").cast("double").alias("label"))
    return RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed).fit(table)


def scored(docs: DataFrame, id_column: str = "doc_id", path_column: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """(id, start, end, score, is_secret) of every candidate; trains on written findings in lines of ``docs``."""
    spark = docs.sparkSession
    language = Language(dictionary(docs))
    narrow = docs.select(
        F.col(id_column).alias("id"), F.col("text").cast("string").alias("text"), F.col(path_column).cast("string").alias("path")
    )
    id_type = narrow.schema["id"].dataType.simpleString()
    found = narrow.mapInArrow(partial(_scan, language=spark.sparkContext.broadcast(language)), f"id {id_type}, {_FINDING}")
    lines = sample_lines(docs, id_column, TRAIN_DOCS, TRAIN_LINES, seed=13) or ["a"]
    model = train(spark, labelled_findings((lines * (TRAIN_LINES // len(lines) + 1))[:TRAIN_LINES], language))
    judged = model.transform(found.withColumn("vector", array_to_vector("features")))
    score = F.round(vector_to_array("probability")[1], 9)
    return judged.select(F.col("id").alias(id_column), "start", "end", score.alias("score"), (score >= threshold).alias("is_secret"))
