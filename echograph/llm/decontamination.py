"""Benchmark decontamination: each training shard is indexed, the benchmark's phrases are searched in it.

A shard is a chunk of whole documents in one task.  Its words become an
FM-index; every benchmark window is searched backward through wavelet ranks,
its occurrences are located from sampled suffix positions, and the word spans
they cover are merged.  Documents are never shuffled.

A window is ``window`` consecutive words of an item; an item of fewer words is
one window, an item without words none.  Null texts have no words.  Repeated
documents are judged each for itself; repeated item ids are one item, a null
item id counts as the empty string.  An empty benchmark finds nothing.

The benchmark is the stated query set.  Spark makes its distinct windows and the
items that have each, and deals these pairs by hash into blocks of about
``block_words`` words (8 bytes each).  The driver and a worker hold one block at
a time.  With more than one, each is searched over numbered documents, and the
spans of all blocks are merged before anything is cut, so results do not depend
on the blocks.  Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echograph.llm import words as W
from echograph.llm.fmindex import FMIndex
from echograph.llm.rows import unused
from echograph.sources.tables import stored

WINDOW = 10
BLOCK_WORDS = 2_000_000
#: Bytes of a training shard: whole documents.
SHARD_BYTES = W.CHUNK_BYTES

_FOUND = "n_words long, spans array<struct<start: long, end: long>>, items array<string>"


@dataclass
class Phrases:
    """Distinct windows of a block: places in ``words``, and the items that have each."""

    vocabulary: np.ndarray  # hashes of different words
    words: np.ndarray  # as places in the vocabulary
    starts: np.ndarray
    lengths: np.ndarray
    item_from: np.ndarray  # items of window i: item_of[item_from[i] : item_from[i + 1]]
    item_of: np.ndarray
    names: list[str]


def _hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends = W.runs(W.ALNUM[data], offsets)
    return W.span_hashes(data, starts, ends, fold=True), starts, ends


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(item, window) of every place of every text, a window as the bytes of its words' hashes."""
    names: list = []
    phrases: list[bytes] = []

    def batch_of() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(phrases, pa.binary())], ["item", "phrase"])
        names.clear()
        phrases.clear()
        return made

    for batch in batches:
        for i, j, data, offsets in W.chunks(batch, "text", SHARD_BYTES):
            hashes, starts, _ = _hashed(data, offsets)
            first = np.cumsum([0, *np.bincount(W.owner(starts, offsets), minlength=j - i)])
            for name, (a, b) in zip(batch.column("item")[i:j].to_pylist(), pairwise(first.tolist()), strict=True):
                size = min(window, b - a)
                for at in range(a, b - size + 1 if size else a):
                    names.append(name)
                    phrases.append(hashes[at : at + size].tobytes())
                    if len(names) == 1 << 16:
                        yield batch_of()
    yield batch_of()


def phrases_of(pairs: pa.Table) -> Phrases:
    """Windows of distinct (item, window) pairs."""
    pairs = pairs.sort_by([("phrase", "ascending"), ("item", "ascending")]).combine_chunks()
    phrase, item = (pa.concat_arrays(pairs.column(c).chunks) if len(pairs) else pa.array([], t) for c, t in (("phrase", pa.binary()), ("item", pa.string())))
    new = np.ones(len(phrase), bool)
    new[1:] = pc.not_equal(phrase[1:], phrase[:-1]).to_numpy(zero_copy_only=False)
    head = np.flatnonzero(new)
    kept, encoded = phrase.take(pa.array(head)), item.dictionary_encode()
    lengths = pc.binary_length(kept).to_numpy().astype(np.int64) // 8
    vocabulary, words = np.unique(np.frombuffer(b"".join(kept.to_pylist()), np.uint64), return_inverse=True)
    return Phrases(
        vocabulary,
        words.astype(np.int32),
        np.cumsum(lengths) - lengths,
        lengths,
        np.append(head, len(phrase)),
        encoded.indices.to_numpy().astype(np.int64),
        encoded.dictionary.to_pylist(),
    )


class Blocks:
    """The benchmark's distinct (item, window) pairs, stored and dealt by hash.

    An item or a window that many pairs have is dealt like any other, so a block
    differs from the mean by chance only.
    """

    def __init__(self, benchmark: DataFrame, window: int, block_words: int) -> None:
        items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))
        pairs = items.mapInArrow(partial(_windows, window=window), "item string, phrase binary")
        self.pairs = stored(pairs.distinct(), "phrases")
        size = self.pairs.agg(F.sum(F.octet_length("phrase") + F.octet_length("item"))).first()[0] or 0
        self.number = max(1, -(-size // (8 * block_words)))

    def broadcast(self, block: int) -> Broadcast:
        """One block, for tasks."""
        own = self.pairs.filter(F.pmod(F.xxhash64("item", "phrase"), F.lit(self.number)) == block)
        return self.pairs.sparkSession.sparkContext.broadcast(phrases_of(own.toArrow()))


@dataclass
class Shard:
    """What was found in one chunk of documents."""

    n_words: np.ndarray
    first_word: np.ndarray  # of each row, in the chunk's words
    word_starts: np.ndarray
    word_ends: np.ndarray
    hit: np.ndarray  # by word
    row_items: np.ndarray  # sorted distinct (row, item) pairs


def search(data: np.ndarray, offsets: np.ndarray, phrases: Phrases) -> Shard:
    """Index the chunk's words and find all windows in them."""
    rows = len(offsets) - 1
    hashes, starts, ends = _hashed(data, offsets)
    row = W.owner(starts, offsets)
    n_words = np.bincount(row, minlength=rows)
    first_word = np.concatenate([[0], np.cumsum(n_words)])
    shard = Shard(n_words, first_word, starts, ends, np.zeros(len(starts), bool), np.empty((0, 2), np.int64))
    if not len(starts) or not len(phrases.starts):
        return shard

    vocabulary, symbols = np.unique(hashes, return_inverse=True)
    at = np.searchsorted(vocabulary, phrases.vocabulary)
    at[at == len(vocabulary)] = 0
    known = vocabulary[at] == phrases.vocabulary
    unknown = np.concatenate([[0], np.cumsum(~known[phrases.words])])
    possible = np.flatnonzero(unknown[phrases.starts + phrases.lengths] == unknown[phrases.starts])
    if not len(possible):
        return shard

    text = np.ones(len(symbols) + rows, np.int64)  # 1 after each document
    text[np.arange(len(symbols)) + row] = symbols + 2
    index = FMIndex(text)
    low, high = index.search((at + 2)[phrases.words], phrases.starts[possible], phrases.lengths[possible])
    count = np.maximum(high - low, 0)
    window = np.repeat(possible, count)
    occurrence = np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count)
    place = index.locate(np.repeat(low, count) + occurrence)
    owner = np.searchsorted(first_word + np.arange(rows + 1), place, "right") - 1
    word = place - owner

    edge = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(edge, word, 1)
    np.add.at(edge, word + phrases.lengths[window], -1)
    shard.hit = np.cumsum(edge)[:-1] > 0
    pairs = np.unique(np.stack([owner, window], axis=1), axis=0)
    many = phrases.item_from[pairs[:, 1] + 1] - phrases.item_from[pairs[:, 1]]
    which = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(phrases.item_from[pairs[:, 1]], many)
    shard.row_items = np.unique(np.stack([np.repeat(pairs[:, 0], many), phrases.item_of[which]], axis=1), axis=0)
    return shard


def _spans(shard: Shard, row: int) -> list[tuple[int, int]]:
    """Runs of hit words of a row, as word places in its text."""
    a, b = shard.first_word[row], shard.first_word[row + 1]
    starts, ends = W.runs(shard.hit[a:b], np.array([0]))
    return list(zip(starts.tolist(), ends.tolist(), strict=True))


def _scan(batches: Iterator[pa.RecordBatch], phrases: Broadcast) -> Iterator[pa.RecordBatch]:
    phrases = phrases.value
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        for i, j, data, offsets in W.chunks(batch, "text", SHARD_BYTES):
            shard = search(data, offsets, phrases)
            spans: list = [[]] * (j - i)
            items: list = [[]] * (j - i)
            for row in np.unique(shard.row_items[:, 0]):
                spans[row] = [{"start": s, "end": e} for s, e in _spans(shard, row)]
                own = shard.row_items[shard.row_items[:, 0] == row, 1]
                items[row] = [phrases.names[k] for k in own]
            yield pa.RecordBatch.from_pydict(
                {
                    "id": batch.column("id")[i:j],
                    "n_words": pa.array(shard.n_words, pa.int64()),
                    "spans": pa.array(spans, spans_type),
                    "items": pa.array(items, pa.list_(pa.string())),
                }
            )


def _merged(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in groups:
        spans = []
        for lists in batch.column("spans").to_pylist():
            out: list[dict] = []
            for span in sorted((s for one in lists for s in one), key=lambda s: s["start"]):
                if out and span["start"] <= out[-1]["end"]:
                    out[-1]["end"] = max(out[-1]["end"], span["end"])
                else:
                    out.append(dict(span))
            spans.append(out)
        at = batch.schema.get_field_index("spans")
        yield batch.set_column(at, "spans", pa.array(spans, batch.schema.field(at).type.value_type))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [sorted(set(x)) for x in batch.column("items").to_pylist()]
        spans = batch.column("spans").to_pylist()
        hit = [sum(s["end"] - s["start"] for s in x) for x in spans]
        yield pa.RecordBatch.from_pydict(
            {
                "id": batch.column("id"),
                "n_words": batch.column("n_words"),
                "n_hit": pa.array(hit, pa.int64()),
                "n_items": pa.array([len(x) for x in names], pa.int64()),
                "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names],
                "contaminated": [h > 0 for h in hit],
            }
        )


def _by_block(numbered: DataFrame, blocks: Blocks) -> DataFrame:
    """What all blocks find in (id, text), ids distinct: a row each in the first block's table, then only rows with hits."""
    id_type = numbered.schema["id"].dataType.simpleString()
    each = []
    for k in range(blocks.number):
        phrases = blocks.broadcast(k)
        rows = numbered.mapInArrow(partial(_scan, phrases=phrases), f"id {id_type}, {_FOUND}")
        each.append(stored(rows.filter(F.size("spans") > 0) if k else rows, "found"))
        phrases.destroy()
    together = reduce(DataFrame.union, each).groupBy("id").agg(
        F.max("n_words").alias("n_words"), F.collect_list("spans").alias("spans"), F.flatten(F.collect_list("items")).alias("items")
    )
    return together.mapInArrow(_merged, f"id {id_type}, {_FOUND}")


def found(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, n_words, spans of hit words, items) of each document; ``docs`` needs the id and ``text``."""
    narrow = docs.select(F.col(id_column).alias("id"), F.col("text").cast("string").alias("text"))
    blocks = Blocks(benchmark, window, block_words)
    if blocks.number == 1:
        id_type = narrow.schema["id"].dataType.simpleString()
        return narrow.mapInArrow(partial(_scan, phrases=blocks.broadcast(0)), f"id {id_type}, {_FOUND}")
    numbered = stored(narrow.select(F.struct(F.monotonically_increasing_id().alias("row"), "id").alias("id"), "text"), "numbered")
    return _by_block(numbered, blocks).withColumn("id", F.col("id.id"))


def judged(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", **how) -> DataFrame:
    """One row for each document: words, hit words, items and their digest."""
    all_ = found(docs, benchmark, id_column, **how)
    id_type = all_.schema["id"].dataType.simpleString()
    result = f"id {id_type}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    return all_.mapInArrow(_digest, result).withColumnRenamed("id", id_column)


def cut(text: bytes, spans: list[tuple[int, int]], word_starts: np.ndarray, word_ends: np.ndarray) -> bytes:
    """The text without the spans of words; a line break stands for each."""
    out, at = [], 0
    for start, end in spans:
        out.append(text[at : word_starts[start]])
        at = word_ends[end - 1]
    out.append(text[at:])
    return b"\n".join(out)


def _with_texts(part: pa.RecordBatch, text_column: str, texts: dict[int, bytes]) -> pa.RecordBatch:
    """Rows with new texts; those of texts without a word go."""
    if not texts:
        return part
    column = part.column(text_column).to_pylist()
    for k, text in texts.items():
        column[k] = text.decode()
    part = part.set_column(part.schema.get_field_index(text_column), text_column, pa.array(column, pa.string()))
    empty = [k for k, text in texts.items() if not W.ALNUM[np.frombuffer(text, np.uint8)].any()]
    return part.take(pa.array(np.setdiff1d(np.arange(len(part)), empty)))


def _cut_all(batches: Iterator[pa.RecordBatch], text_column: str, phrases: Broadcast) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in W.chunks(batch, text_column, SHARD_BYTES):
            texts: dict[int, bytes] = {}
            todo = np.arange(j - i)
            while len(todo):  # what a cut joins is searched again
                shard = search(data, offsets, phrases.value)
                rows = np.unique(shard.row_items[:, 0])
                for k in rows:
                    own = slice(shard.first_word[k], shard.first_word[k + 1])
                    text = data[offsets[k] : offsets[k + 1]].tobytes()
                    texts[int(todo[k])] = cut(text, _spans(shard, k), shard.word_starts[own] - offsets[k], shard.word_ends[own] - offsets[k])
                todo = todo[rows]
                data = np.frombuffer(b"".join(texts[k] for k in todo), np.uint8)
                offsets = np.cumsum([0, *(len(texts[k]) for k in todo)])
            yield _with_texts(batch.slice(i, j - i), text_column, texts)


def _cut_spans(batches: Iterator[pa.RecordBatch], text_column: str, spans_column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in W.chunks(batch, text_column, SHARD_BYTES):
            starts, ends = W.runs(W.ALNUM[data], offsets)
            first = np.cumsum([0, *np.bincount(W.owner(starts, offsets), minlength=j - i)])
            part = batch.slice(i, j - i)
            texts = {}
            for k, spans in enumerate(part.column(spans_column).to_pylist()):
                own = slice(first[k], first[k + 1])
                text = data[offsets[k] : offsets[k + 1]].tobytes()
                texts[k] = cut(text, [(s["start"], s["end"]) for s in spans], starts[own] - offsets[k], ends[own] - offsets[k])
            yield _with_texts(part, text_column, texts)


def _cut_by_block(narrow: DataFrame, text: str, blocks: Blocks) -> DataFrame:
    """Turns over documents that still change: search by all blocks, then one cut of the merged spans."""
    row, spans = unused(narrow, "__cut_row"), unused(narrow, "__cut_spans")
    open_ = stored(narrow.withColumn(row, F.monotonically_increasing_id()), "numbered")
    done = []
    while True:
        seen = _by_block(open_.select(F.col(row).alias("id"), F.col(text).alias("text")), blocks)
        hits = stored(seen.filter(F.size("spans") > 0).select(F.col("id").alias(row), F.col("spans").alias(spans)), "hits")
        done.append(open_.join(hits, row, "left_anti").drop(row))
        if hits.isEmpty():
            return reduce(DataFrame.unionByName, done)
        changing = open_.join(hits, row)
        open_ = stored(changing.mapInArrow(partial(_cut_spans, text_column=text, spans_column=spans), changing.schema).drop(spans), "cut")


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without benchmark passages; columns as in ``docs``.

    A hit span is cut from its first word to its last.  A document of nothing
    else goes; ``n_chars`` of the others is brought up to date.  What a cut joins
    is searched again, until nothing is found.
    """
    text = unused(docs, "__text")
    others = [c for c in docs.columns if c != "text"]
    narrow = docs.select(*others, F.col("text").cast("string").alias(text))
    blocks = Blocks(benchmark, window, block_words)
    if blocks.number == 1:
        out = narrow.mapInArrow(partial(_cut_all, text_column=text, phrases=blocks.broadcast(0)), narrow.schema)
    else:
        out = _cut_by_block(narrow, text, blocks)
    out = out.withColumn("text", F.col(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(*docs.columns)


#: The query's columns in SQL.
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (SELECT item, least({WINDOW}, len(ws)) AS n, ws, unnest(range(1, len(ws) - least({WINDOW}, len(ws)) + 2)) AS p FROM i WHERE len(ws) > 0),
ik AS (SELECT DISTINCT item, n, array_to_string(ws[p:p + n - 1], ' ') AS k FROM iw),
dp AS (SELECT r, n, ws, unnest(range(1, len(ws) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM ik) WHERE len(ws) >= n),
hit AS (SELECT r, p, dp.n, item FROM dp JOIN ik ON dp.n = ik.n AND array_to_string(ws[p:p + dp.n - 1], ' ') = k),
hw AS (SELECT r, count(DISTINCT p + q) AS n_hit FROM hit, (SELECT unnest(range(0, {WINDOW})) AS q) WHERE q < n GROUP BY r),
hi AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
"""
