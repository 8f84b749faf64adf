"""Language-model scoring with a sharded Elias-Fano n-gram trie.

The model is a bigram model with absolute discounting: a seen pair gets
``(n - D) / n(context)``, an unseen one ``D * followers / n(context)`` times the
add-one unigram probability, which is also that of a word after an unknown
context.  Each context's probabilities sum to at most 1; quantising rounds
down, by less than 0.0005 in log10, on one scale for all shards.  So the number of
shards, and which contexts are dealt over several, change scores by no more than
the rounding of sums.

Pairs are dealt to shards by their context.  The task of a shard counts the
training pairs, writes its trie to a file, maps it into memory and scores every
pair of every document by successor search.  An unseen pair is sent on to the
shard of its word for the unigram.  Heavy contexts are dealt over several
shards by their word; their totals, one row each, are put in at the end.  No
task sees more than its shard, and texts are read once.

Documents are numbered by (chunk, place), so null or repeated ids do no harm.
Null and empty texts are one end token.  A document without an id is not held
out.  With no training documents every token is unseen.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echograph.llm import words as W
from echograph.llm.eliasfano import Trie
from echograph.sources.tables import stored

DISCOUNT = 0.75
#: Tokens of a shard, on average: what a task holds in memory.
SHARD_TOKENS = 2_000_000
#: Bytes of a chunk: larger ones repeat fewer words in the rows that are dealt out.
CHUNK_BYTES = 4 << 20
#: Pairs looked up at once.
ASKED_AT_ONCE = 1 << 18
#: Documents, about, in which heavy words are looked for, which decides the layout only.
HEAVY_DOCS = 2000
#: Parts of a mean shard that make a context heavy, and bytes of a word for a guess at the number of tokens.
HEAVY_SHARE, TOKEN_BYTES = 0.25, 6
MODULUS, HELD_REMAINDER = 7, 2

START, END = np.uint64(0x53544152540001), np.uint64(0x454E440002)

_ROW = "kind string, shard int, chunk long, code int, id {id}, n long, held boolean, body binary"
_COLUMNS = ["kind", "shard", "chunk", "code", "id", "n", "held", "body"]


def _squeeze(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays by byte planes, which compress well where values are small or sorted."""
    planes = {k: np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"" for k, a in arrays.items()}
    head = ";".join(f"{k},{a.dtype.str},{len(a)}" for k, a in arrays.items()).encode()
    return zstandard.ZstdCompressor(level=1).compress(len(head).to_bytes(4, "little") + head + b"".join(planes.values()))


def _unsqueeze(body: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    size = int.from_bytes(raw[:4], "little")
    at, out = 4 + size, {}
    for part in raw[4 : 4 + size].decode().split(";"):
        name, kind, n = part.split(",")
        dtype, n = np.dtype(kind), int(n)
        planes = np.frombuffer(raw, np.uint8, n * dtype.itemsize, at).reshape(dtype.itemsize, n)
        out[name] = np.ascontiguousarray(planes.T).view(dtype).reshape(n)
        at += n * dtype.itemsize
    return out


@dataclass
class Layout:
    """Where pairs go: shards by context, heavy contexts (sorted) by context and word."""

    shards: int
    heavy: np.ndarray
    fan: np.ndarray

    def heavy_at(self, words: np.ndarray) -> np.ndarray:
        """Place of each word among the heavy ones; -1 for the others."""
        at = np.minimum(np.searchsorted(self.heavy, words), len(self.heavy) - 1)
        return np.where(self.heavy[at] == words, at, -1)

    def shard(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        at = self.heavy_at(context)
        part = np.where(at >= 0, W.mix(word) % self.fan[at].astype(np.uint64), 0).astype(np.uint64)
        return (W.mix(context + part) % np.uint64(self.shards)).astype(np.int64)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of each chunk; every document adds a start and an end."""
    for batch in batches:
        for i, j, data, offsets in W.chunks(batch):
            starts, ends = W.runs(W.PLAIN[data], offsets)
            words, n = np.unique(W.span_hashes(data, starts, ends, fold=True), return_counts=True)
            words, n = np.append(words, [START, END]), np.append(n, [j - i, j - i])
            yield pa.RecordBatch.from_pydict({"word": pa.array(words.view(np.int64)), "n": pa.array(n, pa.int64())})


def layout_for(docs: DataFrame, shard_tokens: int = SHARD_TOKENS) -> Layout:
    """The number of shards from the size of the texts; heavy words from about ``HEAVY_DOCS`` documents.

    Fewer words than ``shards / HEAVY_SHARE`` can be heavy.
    """
    size, count = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    shards = max(1, round(((size or 0) / TOKEN_BYTES + count) / shard_tokens))
    every = max(1, count // HEAVY_DOCS)
    sample = docs.filter(F.pmod(F.xxhash64(F.lit(29), "id"), F.lit(every)) == 0).select("text")
    counts = stored(sample.mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "sampled_words")
    total = max(1, counts.agg(F.sum("n")).first()[0] or 0)
    part = F.col("n") * F.lit(shards / HEAVY_SHARE / total)
    parts = {np.int64(r["word"]).astype(np.uint64): r["part"] for r in counts.select("word", part.alias("part")).filter("part > 1").collect()}
    heavy = sorted({*parts, START, END})
    return Layout(shards, np.array(heavy, np.uint64), np.array([int(parts.get(w, 0)) + 1 for w in heavy]))


def _rows(rows: list[dict], id_type: pa.DataType) -> pa.RecordBatch:
    types = [pa.string(), pa.int32(), pa.int64(), pa.int32(), id_type, pa.int64(), pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in zip(_COLUMNS, types, strict=True)], _COLUMNS)


def _pairs(batches: Iterator[pa.RecordBatch], layout) -> Iterator[pa.RecordBatch]:
    """Pairs of every chunk by shard, and a row for each document."""
    layout = layout.value
    chunk = TaskContext.get().partitionId() << 32
    for batch in batches:
        id_type = batch.schema.field("id").type
        for i, j, data, offsets in W.chunks(batch, max_bytes=CHUNK_BYTES):
            rows = j - i
            held = np.asarray(batch.column("held")[i:j].to_numpy(zero_copy_only=False), bool)
            starts, ends = W.runs(W.PLAIN[data], offsets)
            row = W.owner(starts, offsets)
            n = np.bincount(row, minlength=rows)
            # START w1 w2 ... END for each document, one after the other
            size = n + 2
            first = np.cumsum(size) - size
            text = np.full(int(size.sum()), START)
            text[first + size - 1] = END
            text[np.arange(len(starts)) + 2 * row + 1] = W.span_hashes(data, starts, ends, fold=True)
            names, code = np.unique(text, return_inverse=True)
            at = np.delete(np.arange(len(text)), first + size - 1)
            doc = np.repeat(np.arange(rows), size - 1)
            width, deep = len(names), max(1, rows)
            key, times = np.unique((code[at] * width + code[at + 1]) * deep + doc, return_counts=True)
            pair, doc = np.divmod(key, deep)
            context, word = np.divmod(pair, width)
            shard = layout.shard(names[context], names[word])
            order = np.argsort(shard, kind="stable")
            cut = np.searchsorted(shard[order], np.arange(layout.shards + 1))
            flags = np.packbits(held)
            out = []
            for s in range(layout.shards):
                own = order[cut[s] : cut[s + 1]]
                if not len(own):
                    continue
                used = np.unique(np.concatenate([context[own], word[own]]))
                body = {
                    "names": np.diff(names[used], prepend=np.uint64(0)),
                    "context": np.searchsorted(used, context[own]).astype(np.uint32),
                    "word": np.searchsorted(used, word[own]).astype(np.uint32),
                    "doc": doc[own].astype(np.uint32),
                    "times": times[own].astype(np.uint32),
                    "held": flags,
                }
                out.append({"kind": "pairs", "shard": s, "chunk": chunk, "body": _squeeze(body)})
            yield _rows(out, id_type)
            info = [pa.array(["doc"] * rows), pa.array(np.arange(rows) % layout.shards, pa.int32()), pa.array(np.full(rows, chunk))]
            info += [pa.array(np.arange(rows), pa.int32()), batch.column("id")[i:j], pa.array(n + 1), batch.column("held")[i:j]]
            yield pa.RecordBatch.from_arrays([*info, pa.nulls(rows, pa.binary())], _COLUMNS)
            chunk += 1


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[str, int, bytes]], pa.RecordBatch | None]]:
    """Bodies of each shard of sorted rows as (kind, chunk, body); other rows as they are."""
    shard, held = None, []
    for batch in batches:
        kinds = np.asarray(batch.column("kind").to_pylist())
        plain = np.flatnonzero(kinds == "doc")
        if len(plain):
            yield -1, [], batch.take(pa.array(plain))
        rest = batch.take(pa.array(np.flatnonzero(kinds != "doc")))
        columns = (rest.column(c).to_pylist() for c in ("shard", "kind", "chunk", "body"))
        for s, kind, chunk, body in zip(*columns, strict=True):
            if s != shard and held:
                yield shard, held, None
                held = []
            shard = s
            held.append((kind, chunk, body))
    if held:
        yield shard, held, None


def _mapped(body: bytes) -> tuple[Trie, str]:
    """The trie in a memory-mapped file of this task's own."""
    handle, path = tempfile.mkstemp(suffix=".trie")
    with os.fdopen(handle, "wb") as file:
        file.write(body)
    return Trie(np.memmap(path, np.uint8, "r")), path


def _sums(key: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys, and the values added up for each."""
    names, at = np.unique(key, return_inverse=True)
    return [names, *(np.bincount(at, v, len(names)) for v in values)]


def _chunk_rows(chunks: np.ndarray, chunk: np.ndarray, kind: str, arrays: dict[str, np.ndarray]) -> list[dict]:
    """One row for each chunk of entries sorted by ``chunk``, a place in ``chunks``."""
    cut = np.searchsorted(chunk, np.arange(len(chunks) + 1))
    return [
        {"kind": kind, "chunk": int(c), "shard": -1, "body": _squeeze({k: a[cut[i] : cut[i + 1]] for k, a in arrays.items()})}
        for i, c in enumerate(chunks)
        if cut[i + 1] > cut[i]
    ]


def _score_shard(shard: int, blobs: list[tuple[str, int, bytes]], layout: Layout, discount: float) -> list[dict]:
    """Trains and scores one shard; returns rows of kinds score, heavy, send, trie and total."""
    parts = [_unsqueeze(body) for _, _, body in blobs]
    chunks, of_blob = np.unique(np.array([c for _, c, _ in blobs]), return_inverse=True)
    for p in parts:
        p["names"] = np.cumsum(p["names"])
    words = np.unique(np.concatenate([p["names"] for p in parts]))
    key = np.empty(sum(len(p["doc"]) for p in parts), np.int64)
    doc, times, held = np.empty(len(key), np.int64), np.empty(len(key), np.int32), np.empty(len(key), bool)
    at = 0
    for p, chunk in zip(parts, of_blob.tolist(), strict=True):
        part = slice(at, at := at + len(p["doc"]))
        local = np.searchsorted(words, p.pop("names"))
        key[part] = local[p["context"]] * len(words) + local[p["word"]]
        doc[part] = p["doc"] + np.int64(chunk << 32)
        times[part] = p["times"]
        held[part] = np.unpackbits(p["held"])[p["doc"]]
        p.clear()  # one copy of the pairs at a time

    order = np.argsort(key)
    key, doc, times, held = key[order], doc[order], times[order], held[order]
    del order
    new = np.append(True, key[1:] != key[:-1])
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    pair_context, pair_word = np.divmod(key[first], len(words))
    del key
    trained = np.add.reduceat(np.where(held, 0, times), first)
    kept = trained > 0
    known_words = np.unique(np.concatenate([pair_context[kept], pair_word[kept]]))
    body = Trie.build(
        words[known_words],
        np.searchsorted(known_words, pair_context[kept]),
        np.searchsorted(known_words, pair_word[kept]),
        trained[kept],
        discount,
    )
    heavy = layout.heavy_at(words)

    trie, path = _mapped(body)
    try:
        own = np.flatnonzero(np.append(True, pair_context[1:] != pair_context[:-1]))
        contexts = pair_context[own]
        place, known = trie.context(words[contexts])
        count = trie.count(words[contexts])
        follow = np.zeros(len(contexts), np.int64)
        follow[known] = trie.followers(place[known])
        which = np.cumsum(np.append(True, pair_context[1:] != pair_context[:-1])) - 1 if len(pair_context) else own
        share, seen = np.empty(len(which)), np.empty(len(which), bool)
        for i in range(0, len(which), ASKED_AT_ONCE):
            some = slice(i, i + ASKED_AT_ONCE)
            share[some], seen[some] = trie.bigram(place[which[some]], known[which[some]], words[pair_word[some]])
    finally:
        os.unlink(path)  # the mapping stays until the trie is dropped

    # Light contexts are whole here. Of heavy ones, only what does not need their totals.
    is_heavy = heavy[pair_context] >= 0
    log_count = np.log10(np.maximum(count, 1))
    back = np.where(known, np.log10(np.maximum(discount * follow, 1e-9)) - log_count, 0.0)[which]
    part_of = log_count[which]
    gain = np.where(seen, share + np.where(is_heavy, part_of, 0.0), np.where(is_heavy, 0.0, back))
    base = np.where(is_heavy, 0.0, np.log10(count + 1.0)[which])
    is_known = np.where(is_heavy, 0, (count > 0)[which])

    rows: list[dict] = []
    docs, score, plain, n_known = _sums(doc, times * gain[group], times * base[group], times * is_known[group])
    arrays = {"doc": (docs & 0xFFFFFFFF).astype(np.uint32), "score": score, "base": plain, "known": n_known.astype(np.uint32)}
    rows += _chunk_rows(chunks, docs >> 32, "score", arrays)

    entry = np.flatnonzero(is_heavy[group])
    heavies = len(layout.heavy)
    for kind, entries, name in (
        ("heavy", entry, heavy[pair_context]),
        ("single", np.flatnonzero(~seen[group] & (heavy[pair_word] >= 0)[group]), heavy[pair_word]),
    ):
        hit = seen[group[entries]]
        keys, yes, no = _sums(doc[entries] * heavies + name[group[entries]], times[entries] * hit, times[entries] * ~hit)
        docs = keys // heavies
        arrays = {"doc": (docs & 0xFFFFFFFF).astype(np.uint32), "word": (keys % heavies).astype(np.uint32)}
        arrays |= {"seen": yes.astype(np.uint32), "unseen": no.astype(np.uint32)}
        rows += _chunk_rows(chunks, docs >> 32, kind, arrays)

    away = np.flatnonzero(~seen[group] & (heavy[pair_word] < 0)[group])
    if len(away):
        asked = pair_word[group[away]]
        goal = layout.shard(words[asked], words[asked])
        order = np.argsort(goal, kind="stable")
        away, asked, goal = away[order], asked[order], goal[order]
        for at in np.split(np.arange(len(away)), np.flatnonzero(np.diff(goal)) + 1):
            used, code = np.unique(asked[at], return_inverse=True)
            body_of = {"names": words[used], "word": code.astype(np.uint32), "chunks": chunks.astype(np.int64)}
            body_of |= {"doc": doc[away[at]], "times": times[away[at]].astype(np.uint32)}
            rows.append({"kind": "send", "shard": int(goal[at[0]]), "chunk": -1, "body": _squeeze(body_of)})

    rows.append({"kind": "trie", "shard": shard, "chunk": -1, "body": body})
    light = (heavy[contexts] < 0) & (count > 0)
    # Totals: tokens in n, different words or followers in chunk.
    rows.append({"kind": "total", "shard": shard, "chunk": int(light.sum()), "code": -1, "n": int(count[light].sum())})
    for at in np.flatnonzero((heavy[contexts] >= 0) & (count > 0)):
        rows.append({"kind": "total", "shard": shard, "chunk": int(follow[at]), "code": int(heavy[contexts[at]]), "n": int(count[at])})
    return rows


def _score(batches: Iterator[pa.RecordBatch], layout, discount: float) -> Iterator[pa.RecordBatch]:
    layout = layout.value
    id_type = None

    def typed() -> Iterator[pa.RecordBatch]:
        nonlocal id_type
        for batch in batches:
            id_type = batch.schema.field("id").type
            yield batch

    for shard, blobs, rest in _by_shard(typed()):
        yield rest if rest is not None else _rows(_score_shard(shard, blobs, layout, discount), id_type)


def _unigrams(batches: Iterator[pa.RecordBatch], total: float) -> Iterator[pa.RecordBatch]:
    """The unigrams of all words sent to a shard, added up by document: rows sorted by shard, its trie among them."""
    for _, blobs, _ in _by_shard(batches):
        sent = [_unsqueeze(body) for kind, _, body in blobs if kind == "send"]
        if not sent:
            continue
        tries = [body for kind, _, body in blobs if kind == "trie"]
        trie, path = _mapped(tries[0]) if tries else (None, None)
        try:
            counts = [trie.count(s["names"]) if trie else np.zeros(len(s["names"]), np.int64) for s in sent]
        finally:
            if path:
                os.unlink(path)
        chunks = np.unique(np.concatenate([s["chunks"] for s in sent]))
        doc = [(np.searchsorted(chunks, s["chunks"])[s["doc"] >> 32] << 32) + (s["doc"] & 0xFFFFFFFF) for s in sent]
        gain = [s["times"] * (np.log10(c + 1.0) - total)[s["word"]] for s, c in zip(sent, counts, strict=True)]
        docs, score = _sums(np.concatenate(doc), np.concatenate(gain))
        arrays = {"doc": (docs & 0xFFFFFFFF).astype(np.uint32), "score": score}
        zeros = {"base": np.zeros(len(docs)), "known": np.zeros(len(docs), np.uint32)}
        yield _rows(_chunk_rows(chunks, docs >> 32, "score", arrays | zeros), pa.int64())


def _final(batches: Iterator[pa.RecordBatch], totals: dict, discount: float) -> Iterator[pa.RecordBatch]:
    """One row for each document: rows sorted by chunk."""
    n, v, counts, follows, end = totals["n"], totals["v"], totals["counts"], totals["follows"], totals["end"]
    whole = float(np.log10(n + v + 1))
    log = np.log10(np.maximum(counts, 1))
    back = np.where(counts > 0, np.log10(np.maximum(discount * follows, 1e-9)) - log, 0.0)
    plain = np.log10(counts + 1.0)

    def finish(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts)
        kinds = np.asarray(rows.column("kind").to_pylist())
        docs = rows.take(pa.array(np.flatnonzero(kinds == "doc")))
        size = docs.num_rows
        code = docs.column("code").to_numpy()
        score, base, known = np.zeros(size), np.zeros(size), np.zeros(size)
        for at in np.flatnonzero(kinds != "doc"):
            part = _unsqueeze(rows.column("body")[int(at)].as_py())
            doc = part["doc"].astype(np.int64)
            if kinds[at] == "score":
                score += np.bincount(doc, part["score"], size)
                base += np.bincount(doc, part["base"], size)
                known += np.bincount(doc, part["known"], size)
                continue
            word, seen, unseen = part["word"].astype(np.int64), part["seen"].astype(float), part["unseen"].astype(float)
            if kinds[at] == "heavy":
                score += np.bincount(doc, unseen * back[word] - seen * log[word], size)
                token = totals["token"][word]
                base += np.bincount(doc, (seen + unseen) * plain[word] * token, size)
                known += np.bincount(doc, (seen + unseen) * (counts[word] > 0) * token, size)
            else:
                score += np.bincount(doc, unseen * (plain[word] - whole), size)
        base += plain[end]  # every document ends once
        known += counts[end] > 0
        tokens = docs.column("n").to_numpy()
        return pa.RecordBatch.from_pydict(
            {
                "id": docs.column("id").combine_chunks(),
                "held_out": docs.column("held").combine_chunks(),
                "n_tokens": pa.array(tokens, pa.int64()),
                "n_known": pa.array(known[code].round().astype(np.int64)),
                "train_tokens": pa.array(np.full(size, n), pa.int64()),
                "base_score": pa.array(base[code] - tokens * whole),
                "score": pa.array(score[code]),
            }
        )

    chunk, parts = None, []
    for batch in batches:
        own = batch.column("chunk").to_numpy()
        cut = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if b > a:
                if own[a] != chunk and parts:
                    yield finish(parts)
                    parts = []
                chunk = own[a]
                parts.append(batch.slice(a, b - a))
    if parts:
        yield finish(parts)


def _totals(scored: DataFrame, layout: Layout) -> dict:
    """Token and word totals, and those of the heavy contexts; at most one row for each shard and heavy word comes back."""
    trained = scored.filter("kind = 'doc' and not held").agg(F.count("*")).first()[0]
    heavies = len(layout.heavy)
    counts, follows = np.zeros(heavies, np.int64), np.zeros(heavies, np.int64)
    n = v = 0
    for r in scored.filter("kind = 'total'").groupBy("code").agg(F.sum("n").alias("n"), F.sum("chunk").alias("k")).collect():
        if r["code"] < 0:
            n, v = int(r["n"]), int(r["k"])
        else:
            counts[r["code"]], follows[r["code"]] = r["n"], r["k"]
    end = int(np.searchsorted(layout.heavy, END))
    start = int(np.searchsorted(layout.heavy, START))
    token = np.ones(heavies)
    token[start] = 0
    counts[end] = trained
    as_token = np.where(token > 0, counts, 0)
    n, v = n + int(as_token.sum()), v + int((as_token > 0).sum())
    return {"n": n, "v": v, "counts": counts, "follows": follows, "end": end, "token": token}


def scored(
    docs: DataFrame,
    id_column: str = "doc_id",
    held_out: Callable | None = None,
    discount: float = DISCOUNT,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each document.

    ``held_out`` turns the id column into a flag; such documents are scored but
    not learned from.
    """
    if held_out is None:
        held_out = lambda c: F.crc32(c.cast("string").cast("binary")) % MODULUS == HELD_REMAINDER
    narrow = docs.select(F.col(id_column).alias("id"), F.col("text").cast("string").alias("text"))
    layout = layout_for(narrow, shard_tokens)
    spread = docs.sparkSession.sparkContext.broadcast(layout)  # heavy words only
    row = _ROW.format(id=narrow.schema["id"].dataType.simpleString())
    flagged = narrow.withColumn("held", F.coalesce(held_out(F.col("id")), F.lit(False)))
    pairs = flagged.mapInArrow(partial(_pairs, layout=spread), row)
    dealt = pairs.repartitionById(layout.shards, "shard").sortWithinPartitions("shard", "chunk")
    first = stored(dealt.mapInArrow(partial(_score, layout=spread, discount=discount), row), "scored")
    totals = _totals(first, layout)

    # The second exchange has long ids in its rows; none of them is a document's.
    plain = _ROW.format(id="long")
    sends = first.filter("kind in ('send', 'trie')").withColumn("id", F.lit(None).cast("long"))
    by_word = sends.repartitionById(layout.shards, "shard").sortWithinPartitions("shard", "kind")
    whole = float(np.log10(totals["n"] + totals["v"] + 1))
    singles = by_word.mapInArrow(partial(_unigrams, total=whole), plain).withColumn("id", F.lit(None).cast(narrow.schema["id"].dataType))

    of_docs = first.filter("kind in ('doc', 'score', 'heavy', 'single')").unionByName(singles)
    by_chunk = of_docs.repartition("chunk").sortWithinPartitions("chunk")
    result = f"id {narrow.schema['id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return by_chunk.mapInArrow(partial(_final, totals=totals, discount=discount), result).withColumnRenamed("id", id_column)
