"""Phrases whose words stand together more often than their parts suggest, for each language.

Every word begins a window: its language, it, and the words that follow in its
piece, five words at most.  A shard's windows are sorted and become a weighted
acyclic automaton for each range of prefixes.  The automata of a range, from all
shards, are united and their weights summed; the weight of a prefix is the number
of its occurrences, and that of the language alone the number of its words.
Ranges are cut by windows of a sample in the order of whole windows, so a word or
pair of words that a third of all windows begin with is cut too; the sample
decides that layout and no count.  What is a prefix of a cut is summed over ranges.

Each cut of a frequent phrase asks the range of its rest for its count: the
phrases asked for are composed with the automaton of counts there.

Words are those of texts with A-Z in lower case, between blanks and tabs; pieces
end at ``[.,;:!?]`` and line ends.  Null texts are empty, null languages ``und``.
Rows of one id are documents of their own.  An empty table gives no rows.  Scores are
exact.  Other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echograph.llm import words as W
from echograph.llm.automaton import DEPTH, Automaton, Counts, first_at_least, fresh_prefixes, sorted_alphabet, summed, union
from echograph.operators.skew import partitions
from echograph.sources.tables import stored

LEAST = 100
TOP = 2000
#: Words of a shard, bytes of text of a range (what a worker of half a GB can unite), windows of the sample for each range.
SHARD_WORDS = 1 << 20
RANGE_BYTES = 6 << 20
SAMPLE = 16
#: Paths united at a time; questions to one range that one task answers.
UNITED = 1 << 20
QUESTIONS = 1 << 18

_SEPARATES = W._table([0x20, 0x09, 0x2E, 0x2C, 0x3B, 0x3A, 0x21, 0x3F, 0x0A, 0x0B, 0x0C, 0x0D], inside=True)
_ENDS_PIECE = _SEPARATES.copy()
_ENDS_PIECE[[0x20, 0x09]] = False

_PIECES = "slice int, body binary"
_COUNTED = "slice int, lang string, phrase string, k int, f long, cut boolean"
_ASKED = "slice int, lang string, phrase string, at int, a long, l long, n long, rest string"
_SCORED = "lang string, phrase string, at int, a long, l long, r long, n long, score long, inside boolean"

Cut = tuple[bytes, ...]


def _words(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, list[bytes]]]:
    """Words of a chunk, the piece and the row of each, and the rows' languages."""
    langs = batch.column("lang").to_pylist()
    for i, j, data, offsets in W.chunks(batch):
        inside = ~_SEPARATES[data]
        starts, ends = W.runs(inside, offsets)
        places = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(W.FOLD[data[inside]])])
        rows = W.owner(starts, offsets)
        closed = np.cumsum(_ENDS_PIECE[data])
        yield found, (closed[starts] if len(starts) else starts) + rows, rows, [x.encode() for x in langs[i:j]]


def _windows(parts: list[tuple[pa.Array, np.ndarray, np.ndarray, list[bytes]]]) -> tuple[pa.Array, np.ndarray]:
    """Alphabet, and the path of every word's window."""
    langs = sorted({x for part in parts for x in part[3]})
    place = {x: i for i, x in enumerate(langs)}
    alphabet, labels = sorted_alphabet(pa.concat_arrays([pa.array(langs, pa.binary()), *[part[0] for part in parts]]))
    own, labels = labels[: len(langs)], labels[len(langs) :]
    of_row = [np.array([place[x] for x in part[3]], np.int64)[part[2]] for part in parts]
    piece, before = [], 0
    for part in parts:
        piece.append(part[1] + before)
        before += int(part[1][-1]) + 1 if len(part[1]) else 0
    piece = np.concatenate(piece)
    paths = np.zeros((DEPTH, len(labels)), np.int32)
    paths[0] = own[np.concatenate(of_row)]
    paths[1] = labels
    for k in range(1, min(DEPTH - 1, len(labels))):
        paths[1 + k, :-k] = np.where(piece[k:] == piece[:-k], labels[k:], 0)
    return alphabet, paths


def _sample(batches: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    rng = np.random.default_rng(TaskContext.get().partitionId())
    for batch in batches:
        for part in _words(batch):
            alphabet, paths = _windows([part])
            chosen = paths[:, rng.random(paths.shape[1]) < share]
            names = [b"", *alphabet.to_pylist()]
            yield pa.RecordBatch.from_pydict({"path": pa.array([[names[x] for x in p] for p in chosen.T.tolist()], pa.list_(pa.binary()))})


def cuts(texts: DataFrame, range_bytes: int = RANGE_BYTES) -> list[Cut]:
    """Windows that part the ranges, sorted: one for every ``range_bytes`` of text or so.

    The driver receives ``SAMPLE`` windows a range.
    """
    n_docs, n_bytes = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    ranges = n_bytes // range_bytes
    if not ranges:
        return []
    docs = max(0.01, min(1.0, 4096 / n_docs))
    share = SAMPLE * ranges * 6 / (docs * n_bytes)  # of words of six bytes
    sampled = texts.sample(docs, seed=1).mapInArrow(partial(_sample, share=share), "path array<binary>")
    found = sorted({tuple(bytes(x) for x in r["path"]) for r in sampled.toLocalIterator()})
    return sorted(set(found[SAMPLE - 1 :: SAMPLE]))


def _local(cut_list: list[Cut], alphabet: pa.Array) -> np.ndarray:
    """The cuts as paths of ``alphabet``: where a word is not in it, the next one that is, and nothing after."""
    names = alphabet.to_pylist()
    place = {x: i + 1 for i, x in enumerate(names)}
    out = np.zeros((DEPTH, len(cut_list)), np.int64)
    for i, cut in enumerate(cut_list):
        for j, word in enumerate(cut):
            if j and not word:
                break
            out[j, i] = place.get(word) or bisect_right(names, word) + 1
            if word not in place:
                break
    return out


def _shards(batches: Iterator[pa.RecordBatch], cut_list: list[Cut], shard_words: int) -> Iterator[pa.RecordBatch]:
    held: list = []
    n = 0

    def flush() -> pa.RecordBatch:
        alphabet, paths = _windows(held)
        paths, weights = summed(paths, np.ones(paths.shape[1], np.int64), len(alphabet))
        at = first_at_least(paths, len(alphabet) + 1, _local(cut_list, alphabet))
        edges = [0, *at.tolist(), paths.shape[1]]
        slices, bodies = [], []
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if a < b:
                part = paths[:, a:b]
                seen = np.zeros(len(alphabet) + 1, bool)
                for row in part:
                    seen[row] = True
                seen[0] = False
                used = np.flatnonzero(seen)
                label = np.zeros(len(seen), np.int32)
                label[used] = np.arange(1, len(used) + 1)
                slices.append(k)
                bodies.append(Automaton.built(alphabet.take(pa.array(used - 1)), label[part], weights[a:b]).to_bytes())
        return pa.RecordBatch.from_pydict({"slice": pa.array(slices, pa.int32()), "body": pa.array(bodies, pa.binary())})

    for batch in batches:
        for part in _words(batch):
            if len(part[0]):
                held.append(part)
                n += len(part[0])
            if n >= shard_words:
                yield flush()
                held.clear()
                n = 0
    if held:
        yield flush()


def _by_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """Runs of rows of one slice, each to be read before the next."""
    rest: list[pa.RecordBatch] = []

    def fetch() -> bool:
        while not rest:
            batch = next(batches, None)
            if batch is None:
                return False
            if batch.num_rows:
                rest.append(batch)
        return True

    def run(k: int) -> Iterator[pa.RecordBatch]:
        while fetch():
            batch = rest[0]
            slices = batch.column("slice").to_numpy()
            n = int(np.searchsorted(slices, k, "right"))
            if n:
                yield batch.slice(0, n)
            if n < len(slices):
                rest[0] = batch.slice(n)
                return
            rest.clear()

    while fetch():
        k = rest[0].column("slice")[0].as_py()
        yield k, run(k)


def _united(batches: Iterator[pa.RecordBatch], cut_list: list[Cut], least: int) -> Iterator[pa.RecordBatch]:
    for k, run in _by_slice(batches):
        held: list[Automaton] = []
        n = 0
        for batch in run:
            for body in batch.column("body"):
                held.append(Automaton.from_bytes(body.as_py()))
                n += len(held[-1].levels[-1][1])
                if n >= UNITED:
                    held, n = [Automaton.built(*union(held))], 0
        alphabet, paths, weights = union(held)
        names = [b"", *alphabet.to_pylist()]
        sides = [cut_list[k - 1] if k else None, cut_list[k] if k < len(cut_list) else None]
        out: list[list] = [[] for _ in range(5)]
        for j, begins in enumerate(fresh_prefixes(paths)):
            f = np.add.reduceat(weights, begins)
            ends = paths[j, begins] == 0 if j else np.zeros(len(begins), bool)
            keep = f >= least
            parted = np.zeros(len(begins), bool)
            if j == 0:
                parted[:] = True
            for place, side in zip((0, -1), sides, strict=True):  # only the first prefix can begin the lower cut, the last the upper one
                if side and all(names[paths[i, begins[place]]] == side[i] for i in range(j + 1)):
                    parted[place] = True
            chosen = np.flatnonzero((keep | parted) & ~ends)
            for i, p in zip(chosen.tolist(), paths[: j + 1, begins[chosen]].T.tolist(), strict=True):
                for column, value in zip(out, (names[p[0]].decode(), b" ".join(names[x] for x in p[1:]).decode(), j, int(f[i]), bool(parted[i])), strict=True):
                    column.append(value)
        types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.bool_()]
        columns = {c: pa.array(v, t) for c, v, t in zip(("lang", "phrase", "k", "f", "cut"), out, types, strict=True)}
        yield pa.RecordBatch.from_pydict({"slice": pa.array([k] * len(out[0]), pa.int32())} | columns)


def _path(lang: str, phrase: str) -> Cut:
    words = phrase.encode().split(b" ") if phrase else []
    return (lang.encode(), *words, *[b""] * (DEPTH - 1 - len(words)))


def counted(docs: DataFrame, least: int = LEAST, range_bytes: int = RANGE_BYTES, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, list[Cut]]:
    """Stored (slice, lang, phrase, k, f) of all phrases of at most five words with ``least`` occurrences, and the cuts.

    The phrase of no words has the number of the language's words.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    cut_list = cuts(texts, range_bytes)
    pieces = texts.mapInArrow(partial(_shards, cut_list=cut_list, shard_words=shard_words), _PIECES)
    dealt = pieces.repartition("slice").sortWithinPartitions("slice")
    found = stored(dealt.mapInArrow(partial(_united, cut_list=cut_list, least=least), _COUNTED), "counted")
    # At most six for each cut and language: what is a prefix of a cut, and the languages.
    parted = found.filter("cut").groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f")).collect()
    rows = [(bisect_right(cut_list, _path(r["lang"], r["phrase"])), *r) for r in parted if r["f"] >= least or not r["k"]]
    whole = spark.createDataFrame(rows, "slice int, lang string, phrase string, k int, f long")
    return stored(found.filter("NOT cut").drop("cut").unionByName(whole), "counts"), cut_list


def _lookup(batches: list[pa.RecordBatch]) -> Counts:
    table = pa.Table.from_batches(batches)
    sequences = [
        (lang.encode(), *(phrase.encode().split(b" ") if phrase else [])) for lang, phrase in zip(table["lang"].to_pylist(), table["phrase"].to_pylist(), strict=True)
    ]
    return Counts(sequences, table["f"].to_numpy())


def _composed(counts: Counts, langs: list[str], phrases: list[str]) -> np.ndarray:
    sequences = [[x.encode(), *p.encode().split(b" ")] for x, p in zip(langs, phrases, strict=True)]
    return counts.composed(pa.array([w for s in sequences for w in s], pa.binary()), np.array([len(s) for s in sequences], np.int64))


def _ask(batches: Iterator[pa.RecordBatch], cut_list: list[Cut], known: dict[tuple[str, str], int]) -> Iterator[pa.RecordBatch]:
    """For each cut of a phrase: the count of its first part, and its rest with the slice that knows it."""
    for _, run in _by_slice(batches):
        rows = list(run)
        counts = _lookup(rows)
        for batch in rows:
            out: list[list] = [[] for _ in range(7)]
            for lang, phrase, k, f in zip(*[batch.column(c).to_pylist() for c in ("lang", "phrase", "k", "f")], strict=True):
                if k > 1:
                    words = phrase.split(" ")
                    for at in range(1, k):
                        for column, value in zip(out, (lang, phrase, at, f, known[lang, ""], " ".join(words[:at]), " ".join(words[at:])), strict=True):
                            column.append(value)
            lang, phrase, at, a, n, first, rest = out
            firsts = _composed(counts, lang, first).tolist()
            firsts = [known.get((x, p), f) for x, p, f in zip(lang, first, firsts, strict=True)]
            slices = [bisect_right(cut_list, _path(x, p)) for x, p in zip(lang, rest, strict=True)]
            types = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            columns = zip(("slice", "lang", "phrase", "at", "a", "l", "n", "rest"), (slices, lang, phrase, at, a, firsts, n, rest), types, strict=True)
            yield pa.RecordBatch.from_pydict({c: pa.array(v, t) for c, v, t in columns})


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores of cuts; and parts of a phrase that occur nowhere else, with ``inside``.

    Rows of a slice: first its counts (``rest`` is null), then what is asked of it.
    """
    for _, run in _by_slice(batches):
        own: list[pa.RecordBatch] = []
        counts = None
        for batch in run:
            mine = batch.filter(batch.column("rest").is_null())
            if mine.num_rows:
                own.append(mine.select(["lang", "phrase", "a"]).rename_columns(["lang", "phrase", "f"]))
            asked = batch.filter(batch.column("rest").is_valid())
            if not asked.num_rows:
                continue
            counts = counts or _lookup(own)
            columns = [asked.column(c).to_pylist() for c in ("lang", "phrase", "at", "a", "l", "n", "rest")]
            r = _composed(counts, columns[0], columns[-1]).tolist()
            scored, inside = [], []
            for lang, phrase, at, a, left, n, rest, right in zip(*columns, r, strict=True):
                scored.append((lang, phrase, at, a, left, right, n, 1000 * a * n // (left * right), False))
                words = phrase.split(" ")
                if len(words) > 2 and at == 1 and a >= right:
                    inside.append((lang, rest))
                if len(words) > 2 and at == len(words) - 1 and a >= left:
                    inside.append((lang, " ".join(words[:-1])))
            rows = scored + [(*x, None, None, None, None, None, None, True) for x in inside]
            types = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 5, pa.bool_()]
            names = ("lang", "phrase", "at", "a", "l", "r", "n", "score", "inside")
            yield pa.RecordBatch.from_pydict({c: pa.array(v, t) for c, v, t in zip(names, zip(*rows, strict=True), types, strict=True)})


def scored_cuts(counts: DataFrame, cut_list: list[Cut], questions: int = QUESTIONS) -> DataFrame:
    """(lang, phrase, at, a, l, r, n, score, inside): every cut of every frequent phrase of two words and more."""
    # Again at most six for each cut and language.
    known = {(r["lang"], r["phrase"]): r["f"] for r in _parted(counts, cut_list)}
    dealt = counts.repartition("slice").sortWithinPartitions("slice")
    asked = stored(dealt.mapInArrow(partial(_ask, cut_list=cut_list, known=known), _ASKED), "asked")
    shares = F.ceil(F.col("count") / questions).cast("int")
    busy = {r["slice"]: r["n"] for r in asked.groupBy("slice").count().filter(F.col("count") > questions).select("slice", shares.alias("n")).collect()}
    part = F.lit(0)
    for k, n in busy.items():
        part = F.when(F.col("slice") == k, F.pmod(F.hash("phrase", "at"), F.lit(n))).otherwise(part)
    every = F.array(F.lit(0))
    for k, n in busy.items():
        every = F.when(F.col("slice") == k, F.sequence(F.lit(0), F.lit(n - 1))).otherwise(every)
    own = counts.select("slice", "lang", "phrase", F.col("f").alias("a"), F.explode(every).alias("part"))
    both = asked.withColumn("part", part).unionByName(own, allowMissingColumns=True)
    both = both.repartition("slice", "part").sortWithinPartitions("slice", "part", F.col("rest").isNotNull())
    return both.mapInArrow(_answer, _SCORED)


def _parted(counts: DataFrame, cut_list: list[Cut]) -> list:
    """Rows of languages and of prefixes of cuts."""
    prefixes = {(c[0].decode(), b" ".join(w for w in c[1 : j + 1] if w).decode()) for c in cut_list for j in range(1, DEPTH)}
    spark = counts.sparkSession
    wanted = spark.createDataFrame(sorted(prefixes), "lang string, phrase string")
    langs = counts.filter("k = 0").select("lang", "phrase", "f")
    return langs.unionByName(counts.filter("k > 0").join(wanted, ["lang", "phrase"], "left_semi").select("lang", "phrase", "f")).collect()


def collocations(
    docs: DataFrame, least: int = LEAST, top: int = TOP, range_bytes: int = RANGE_BYTES, shard_words: int = SHARD_WORDS, questions: int = QUESTIONS
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases.

    A phrase goes if its words lie in a longer one that occurs as often: then
    also in one that has one word more, which is one of its own cuts.
    """
    counts, cut_list = counted(docs, least, range_bytes, shard_words)
    every = scored_cuts(counts, cut_list, questions)
    lowest = F.min(F.when(~F.col("inside"), F.struct("score", "at", "a", "l", "r", "n"))).alias("best")
    phrases = every.groupBy("lang", "phrase").agg(lowest, F.max("inside").alias("inside")).filter("NOT inside AND best IS NOT NULL")
    order = [F.desc("best.score"), F.desc("best.a"), F.col("phrase")]
    # First within parts, so that no task sorts all phrases of a language.
    part = F.pmod(F.hash("phrase"), F.lit(partitions(docs)))
    near = phrases.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).filter(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *[F.col(f"best.{c}").alias(c) for c in ("a", "l", "r", "n", "score")])


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
lengths AS (SELECT unnest(range(1, 6)) AS k),
freq AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM starts, lengths WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100),
parts AS (
  SELECT lang, k, phrase, f AS a, c, array_to_string(string_split(phrase, ' ')[:c], ' ') AS head, array_to_string(string_split(phrase, ' ')[c + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS c FROM freq WHERE k > 1)),
scored AS (
  SELECT p.lang, p.k, p.phrase, p.a, h.f AS l, r.f AS r, n, CAST(1000::HUGEINT * p.a * n // (h.f::HUGEINT * r.f) AS BIGINT) AS score, c
  FROM parts p JOIN freq h ON h.lang = p.lang AND h.phrase = head JOIN freq r ON r.lang = p.lang AND r.phrase = rest JOIN totals t ON t.lang = p.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM freq d WHERE d.lang = b.lang AND d.k > b.k AND 100 * d.f >= 100 * b.a AND contains(' ' || d.phrase || ' ', ' ' || b.phrase || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
