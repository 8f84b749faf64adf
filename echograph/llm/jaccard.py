"""N-gram Jaccard join by universe partition and pigeonhole (Deng, Li, Wen, Feng, PVLDB 2015).

A text's set is that of its distinct word shingles.  Sets of size s and t with
Jaccard similarity of at least 0.9 differ in at most (s + t) / 19 shingles.
For each band of sizes the universe of shingles is hashed into segments, more
of them than a pair may have differences, so some segment must be equal; or
fewer, and some must be equal up to one shingle.  Which of the two is indexed
where, is decided by cost: an equal segment costs one signature, a one-deletion
neighbourhood one for each shingle, and small segments meet by chance.

    units = most differences in the band + 1
    every segment indexed as it is gives one unit, with its deletions two

A document is indexed in its own band and the next, so any two that can be
similar meet.  Equal sets are one node.  Nodes of a bucket are first verified
against its smallest; where a bucket still holds several components, its nodes
outside the largest are compared with all of other components by bit sketches,
which never lose a similar pair, and the rest verified exactly.  Large buckets
are dealt over tasks as pairs of blocks.  So no pair within a component is ever
listed and no link between components is missed.

Null and empty texts have an empty set and are linked with nothing.  Texts of
fewer words than a shingle are one shingle.  Repeated rows are one node.
Nodes are 64-bit digests of sets; two sets with one digest raise an error, and
another ``seed`` parts them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echograph.llm import words as W
from echograph.llm.components import components
from echograph.llm.rows import unused, with_row
from echograph.sources.tables import stored

#: Jaccard similarity of at least TENTHS / 10.
TENTHS = 9
SHINGLE = 3
#: What one node met by chance costs, in signatures: verification moves a whole set.
CHANCE_COST = 1000.0
SKETCH_WORDS = 16
#: Rows compared with others of a group at once.
BLOCK = 256
#: Larger buckets are dealt as pairs of blocks of so many nodes.
DEAL = 2048

_PRINT = "id {id}, size long, a long, b long, sigs binary"


def most_differences(total: int, tenths: int = TENTHS) -> int:
    """Largest symmetric difference of two sets of ``total`` elements together that are similar enough."""
    return total * (10 - tenths) // (10 + tenths)


class Bands:
    """Bands of sizes: whatever is similar to a set of a band lies in that band or a neighbour."""

    def __init__(self, tenths: int = TENTHS) -> None:
        self.tenths = tenths
        #: Smaller sets are similar to equal ones only.
        self.least = next(s for s in range(1, 1000) if 10 * s // tenths > s)
        self.starts = [self.least, self.least + 1]

    def upto(self, size: int) -> None:
        while self.starts[-1] <= size or self.starts[-2] <= size:
            self.starts.append(10 * (self.starts[-1] - 1) // self.tenths + 1)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        self.upto(int(sizes.max(initial=0)))
        return np.searchsorted(self.starts, sizes, "right") - 1

    def largest(self, band: int) -> int:
        while len(self.starts) < band + 2:
            self.upto(self.starts[-1])
        return self.starts[band + 1] - 1


@lru_cache(maxsize=4096)
def allocation(largest: int, tenths: int = TENTHS) -> tuple[int, int]:
    """(segments with deletions, segments as they are) that cost least for sets of up to ``largest``."""
    units = most_differences(2 * largest, tenths) + 1
    best = (float("inf"), 0, 0)
    for twos in range(units // 2 + 1):
        ones = units - 2 * twos
        tokens = largest / (twos + ones)
        chance = CHANCE_COST * 0.5**tokens
        cost = ones * (1 + chance) + twos * (1 + tokens) * (1 + chance)
        best = min(best, (cost, twos, ones))
    return best[1], best[2]


_bands: dict[int, Bands] = {}


def _salted(values: np.ndarray, salt: int) -> np.ndarray:
    return W.mix(values ^ np.uint64((salt * 0x9E3779B97F4A7C15 + 0x1234567) % (1 << 64)))


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each row, rows ascending."""
    starts, ends = W.runs(W.PLAIN[data], offsets)
    row = W.owner(starts, offsets)
    hashes = W.span_hashes(data, starts, ends, fold=True)
    rows = len(offsets) - 1
    count = np.bincount(row, minlength=rows)
    windows = W.window_hashes(hashes, n)
    whole = row[: len(windows)] == row[n - 1 :] if len(windows) else np.empty(0, bool)
    windows, owner = windows[whole], row[: len(whole)][whole]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        first = np.cumsum(count) - count
        one = [W.window_hashes(hashes[first[r] : first[r] + count[r]], int(count[r])) ^ np.uint64(count[r]) for r in short]
        windows, owner = np.concatenate([windows, *one]), np.concatenate([owner, short])
    windows = _salted(windows, seed)
    _, first = np.unique(W.mix(windows + W.mix(owner.astype(np.uint64))), return_index=True)
    first = first[np.argsort(owner[first], kind="stable")] if len(short) else np.sort(first)
    return owner[first], windows[first]


def digests(row: np.ndarray, hashes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two digests of each row's set."""
    size = np.bincount(row, minlength=rows)
    a, b = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
    np.add.at(a, row, _salted(hashes, 1))
    np.add.at(b, row, _salted(hashes, 2))
    return size, W.mix(a + size.astype(np.uint64)), W.mix(b ^ size.astype(np.uint64))


def signatures(row: np.ndarray, hashes: np.ndarray, size: np.ndarray, tenths: int = TENTHS) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of all segments and deletions, in the rows' own bands and the next."""
    bands = _bands.setdefault(tenths, Bands(tenths))
    own = np.where(size >= bands.least, bands.of(size), -1)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for up in (0, 1):
        band = np.where(own >= 0, own + up, -1)
        twos, ones = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for k in np.unique(band[band >= 0]):
            twos[band == k], ones[band == k] = allocation(bands.largest(int(k)), tenths)
        many = twos + ones
        base = np.cumsum(many) - many
        live = many[row] > 0
        r, h = row[live], _salted(hashes[live], 3)
        # A shingle's segment depends on its hash and the band only.
        segment = (W.mix(h + band[r].astype(np.uint64)) % many[r].astype(np.uint64)).astype(np.int64)
        at = base[r] + segment
        content = np.zeros(int(many.sum()), np.uint64)
        np.add.at(content, at, h)
        of = np.repeat(np.arange(len(size)), many)
        place = np.arange(len(of)) - base[of]
        name = W.mix((band[of].astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64))
        parts.append((of, W.mix(content ^ name)))
        double = segment < twos[r]
        parts.append((r[double], W.mix((content[at[double]] - h[double]) ^ name[at[double]])))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _prints(batches: Iterator[pa.RecordBatch], n: int, tenths: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Digests of every document; signatures of the first with each set in a batch."""
    for batch in batches:
        seen: set[int] = set()
        for i, j, data, offsets in W.chunks(batch):
            rows = j - i
            row, hashes = shingles(data, offsets, n, seed)
            size, a, b = digests(row, hashes, rows)
            fresh = np.zeros(rows, bool)
            for k, key in enumerate(a.tolist()):
                if size[k] and key not in seen:
                    seen.add(key)
                    fresh[k] = True
            kept = fresh[row]
            of, sig = signatures(row[kept], hashes[kept], np.where(fresh, size, 0), tenths)
            order = np.argsort(of, kind="stable")
            of, sig = of[order], sig[order]
            cut = np.searchsorted(of, np.arange(rows + 1))
            body = [sig[cut[k] : cut[k + 1]].tobytes() if cut[k + 1] > cut[k] else None for k in range(rows)]
            yield pa.RecordBatch.from_pydict(
                {
                    "id": batch.column("id")[i:j],
                    "size": pa.array(size, pa.int64()),
                    "a": pa.array(a.view(np.int64)),
                    "b": pa.array(b.view(np.int64)),
                    "sigs": pa.array(body, pa.binary()),
                }
            )


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        body = batch.column("sigs")
        sizes = np.array([len(x.as_buffer()) // 8 for x in body], np.int64)
        sig = np.frombuffer(b"".join(x.as_py() for x in body), np.int64)
        node = np.repeat(np.asarray(batch.column("a")), sizes)
        yield pa.RecordBatch.from_pydict({"sig": pa.array(sig), "node": pa.array(node)})


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (sig, node): buckets of several nodes, each node once, with the smallest one."""
    last_sig = last_node = pivot = None
    waiting = False  # the first node of the last bucket, not yet given out
    for batch in batches:
        sig, node = np.asarray(batch.column("sig")), np.asarray(batch.column("node"))
        if not len(sig):
            continue
        new_sig = np.ones(len(sig), bool)
        new_sig[1:] = sig[1:] != sig[:-1]
        new_sig[0] = sig[0] != last_sig
        new = new_sig.copy()
        new[1:] |= node[1:] != node[:-1]
        new[0] |= node[0] != last_node
        sig, node, new_sig = sig[new], node[new], new_sig[new]
        if not len(sig):
            continue
        if not new_sig[0] and waiting:
            sig, node = np.insert(sig, 0, last_sig), np.insert(node, 0, pivot)
            new_sig = np.insert(new_sig, 0, True)
        started = bool(new_sig[0])
        begin = np.flatnonzero(new_sig) if started else np.append(0, np.flatnonzero(new_sig))
        size = np.diff(np.append(begin, len(sig)))
        lead = node[begin].copy()
        if not started:
            lead[0] = pivot
        keep = np.repeat(size > 1, size)
        if not started:
            keep[: size[0]] = True
        waiting = bool(size[-1] == 1 and (started or len(begin) > 1))
        pivot, last_sig, last_node = int(lead[-1]), int(sig[-1]), int(node[-1])
        out = {"sig": pa.array(sig[keep]), "node": pa.array(node[keep]), "pivot": pa.array(np.repeat(lead, size)[keep])}
        yield pa.RecordBatch.from_pydict(out)


def _sets(batches: Iterator[pa.RecordBatch], n: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Sorted shingles of the documents whose set is the one asked for."""
    for batch in batches:
        asked = np.asarray(batch.column("node"))
        for i, j, data, offsets in W.chunks(batch):
            row, hashes = shingles(data, offsets, n, seed)
            size, a, _ = digests(row, hashes, j - i)
            right = np.flatnonzero(a.view(np.int64) == asked[i:j])
            cut = np.searchsorted(row, np.arange(j - i + 1))
            bodies, sketches = [], []
            for k in right:
                own = np.sort(hashes[cut[k] : cut[k + 1]])
                bodies.append(own.tobytes())
                odd = np.bincount((own % np.uint64(64 * SKETCH_WORDS)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
                sketches.append(np.packbits(odd.astype(bool), bitorder="little").tobytes())
            yield pa.RecordBatch.from_pydict(
                {
                    "node": pa.array(asked[i:j][right], pa.int64()),
                    "size": pa.array(size[right], pa.int64()),
                    "body": pa.array(bodies, pa.binary()),
                    "sketch": pa.array(sketches, pa.binary()),
                }
            )


def _verified(batches: Iterator[pa.RecordBatch], tenths: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for k, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 10 * both >= tenths * (len(x) + len(y) - both):
                good.append(k)
        yield batch.select(["u", "v"]).take(pa.array(good, pa.int64()))


def _dealt(mixed: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """Rows (sig, node, part) of mixed buckets with their sketches, dealt so that any two of different parts meet once.

    The rest, all but the bucket's largest part, is cut into ``block`` rows or
    so by digest, and so is the largest.  Group (sig, i, j) holds a block of
    the rest on side 0 and another, or one of the largest part (j < 0), on
    side 1; (sig, i, i) one block alone.  Two nodes of the largest part never
    meet.  A bucket of no more than ``block`` rows is one group.
    """
    of_part = mixed.groupBy("sig", "part").agg(F.count("*").alias("n"))
    of_sig = of_part.groupBy("sig").agg(F.sum("n").alias("n"), F.max(F.struct("n", "part")).alias("top"))
    small = F.col("n") <= block
    mass = F.when(small, 0).otherwise(F.col("top.n"))
    sizes = of_sig.select(
        "sig",
        F.when(~small, F.col("top.part")).alias("top"),
        F.ceil((F.col("n") - mass) / block).cast("int").alias("rests"),
        F.ceil(mass / block).cast("int").alias("masses"),
    )
    in_top = F.coalesce(F.col("part") == F.col("top"), F.lit(False))
    # Digests are uniform; their low bits choose the block.
    own = F.pmod("node", F.when(in_top, F.col("masses")).otherwise(F.col("rests"))).cast("int")
    group = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).cast("int").alias("side"))
    each = lambda n, make: F.transform(F.sequence(F.lit(0), F.col(n) - 1), make)
    of_top = each("rests", lambda k: group(k, -1 - F.col("own"), 1))
    among = each("rests", lambda k: F.when(k < F.col("own"), group(k, F.col("own"), 1)).otherwise(group(F.col("own"), k, 0)))
    with_top = F.when(F.col("masses") > 0, each("masses", lambda k: group(F.col("own"), -1 - k, 0))).otherwise(F.array().cast("array<struct<i:int,j:int,side:int>>"))
    groups = F.when(F.col("in_top"), of_top).otherwise(F.concat(among, with_top))
    placed = mixed.join(sizes, "sig").select("*", in_top.alias("in_top"), own.alias("own")).join(sets.select("node", "size", "sketch"), "node")
    met = placed.withColumn("g", F.explode(groups)).select("sig", "g.i", "g.j", "g.side", "node", "part", "size", "sketch")
    return met.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j", "side", "part")


def _met(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], tenths: int) -> Iterator[pa.RecordBatch]:
    """Pairs of different parts, one of each side, whose sketches allow similarity; both sides sorted by part.

    ``left is right`` gives each pair of one side once.  Rows of the one part
    of a block are left out before sketches are compared.
    """
    for i in range(0, len(left[0]), BLOCK):
        node, part, size, sketch = (c[i : i + BLOCK] for c in left)
        if left is right:
            other = slice(int(np.searchsorted(right[1], part[0], "right")), None)
        elif part[0] == part[-1]:
            other = np.flatnonzero(right[1] != part[0])
        else:
            other = slice(None)
        nodes, parts, sizes, sketches = (c[other] for c in right)
        for j in range(0, len(nodes), 16 * BLOCK):
            some = slice(j, j + 16 * BLOCK)
            apart = np.zeros((len(node), len(nodes[some])), np.int64)
            for word in range(SKETCH_WORDS):
                apart += np.bitwise_count(sketch[:, None, word] ^ sketches[None, some, word])
            near = apart * (10 + tenths) <= (size[:, None] + sizes[None, some]) * (10 - tenths)
            near &= (part[:, None] < parts[None, some]) if left is right else (part[:, None] != parts[None, some])
            x, y = np.nonzero(near)
            x, y = node[x], nodes[some][y]
            yield pa.RecordBatch.from_pydict({"u": pa.array(np.maximum(x, y)), "v": pa.array(np.minimum(x, y))})


def _across(batches: Iterator[pa.RecordBatch], tenths: int) -> Iterator[pa.RecordBatch]:
    """Pairs of different components in one group whose sketches allow similarity; rows as ``_dealt`` sorts them."""
    held: list[tuple[np.ndarray, ...]] = []
    current = None

    def pairs() -> Iterator[pa.RecordBatch]:
        side, *columns = (np.concatenate([h[k] for h in held]) for k in range(5))
        cut = int(np.searchsorted(side, 1))
        left, right = tuple(c[:cut] for c in columns), tuple(c[cut:] for c in columns)
        yield from _met(left, left if current[1] == current[2] else right, tenths)

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("sig", "i", "j")], axis=1)
        columns = tuple(np.asarray(batch.column(c)) for c in ("side", "node", "part", "size"))
        sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(len(key), SKETCH_WORDS)
        begin = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
        for s, e in zip(begin, [*begin[1:], len(key)], strict=True):
            mine = tuple(key[s].tolist())
            if held and mine != current:
                yield from pairs()
                held = []
            current = mine
            held.append((*(c[s:e] for c in columns), sketch[s:e]))
    if held:
        yield from pairs()


class Join:
    """One run of the join over ``docs`` (an id column and ``text``)."""

    def __init__(self, docs: DataFrame, id_column: str = "doc_id", shingle: int = SHINGLE, tenths: int = TENTHS, seed: int = 0, deal: int = DEAL) -> None:
        self.deal = deal
        self.how = {"n": shingle, "seed": seed}
        self.tenths = tenths
        self.docs = docs.select(F.col(id_column).alias("id"), F.col("text").cast("string").alias("text"))
        id_type = self.docs.schema["id"].dataType.simpleString()
        self.prints = stored(self.docs.mapInArrow(partial(_prints, tenths=tenths, **self.how), _PRINT.format(id=id_type)), "prints")
        grouped = self.prints.filter("size > 0").groupBy(F.col("a").alias("node"))
        #: One row for each different set: its digest and smallest document.
        self.nodes = stored(grouped.agg(F.min("id").alias("id"), F.min("b").alias("b"), F.max("b").alias("other")), "nodes")
        if not self.nodes.filter("b != other").isEmpty():
            raise RuntimeError("two different sets have one digest; run the join with another seed")
        self.links = self._links()
        self.parts = components(self.links)

    def _links(self) -> DataFrame:
        """Verified links (u, v) that span all components; stored."""
        sigs = self.prints.filter("sigs is not null").select("a", "sigs").mapInArrow(_exploded, "sig long, node long")
        dealt = sigs.repartition("sig").sortWithinPartitions("sig", "node")
        buckets = stored(dealt.mapInArrow(_buckets, "sig long, node long, pivot long"), "buckets")
        sets = self._sets(buckets.select("node").distinct())
        to_pivot = buckets.filter("node != pivot").select(F.col("node").alias("u"), F.col("pivot").alias("v")).distinct()
        first = stored(self._verify(to_pivot, sets), "links")
        rest = stored(self._verify(self._pairs_across(buckets, sets, components(first)), sets), "links")
        return first.unionByName(rest)

    def _sets(self, nodes: DataFrame) -> DataFrame:
        asked = self.nodes.join(nodes, "node", "left_semi").select("node", F.col("id").alias("asked"))
        texts = self.docs.join(asked, F.col("id").eqNullSafe(F.col("asked"))).select("node", "text")
        found = texts.mapInArrow(partial(_sets, **self.how), "node long, size long, body binary, sketch binary")
        return stored(found.dropDuplicates(["node"]), "sets")

    def _verify(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        x = sets.select(F.col("node").alias("u"), F.col("body").alias("x"))
        y = sets.select(F.col("node").alias("v"), F.col("body").alias("y"))
        both = pairs.join(x, "u").join(y, "v").select("u", "v", "x", "y")
        return both.mapInArrow(partial(_verified, tenths=self.tenths), "u long, v long")

    def _pairs_across(self, buckets: DataFrame, sets: DataFrame, parts: DataFrame) -> DataFrame:
        labelled = buckets.select("sig", "node").join(parts, "node", "left")
        labelled = stored(labelled.select("sig", "node", F.coalesce("component", "node").alias("part")), "labelled")
        mixed = labelled.groupBy("sig").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low != high")
        mine = stored(labelled.join(mixed.select("sig"), "sig", "left_semi"), "mixed")
        dealt = _dealt(mine, sets, self.deal)
        return dealt.mapInArrow(partial(_across, tenths=self.tenths), "u long, v long").distinct()

    def membership(self) -> DataFrame:
        """(id, n_shingles, component_id) of each document."""
        smallest = self.nodes.join(self.parts, "node", "left").select("node", "id", F.coalesce("component", "node").alias("part"))
        of_part = smallest.groupBy("part").agg(F.min("id").alias("component_id"))
        of_node = stored(smallest.select("node", "part").join(of_part, "part").select("node", "component_id"), "membership")
        rows = self.prints.select("id", "size", F.when(F.col("size") > 0, F.col("a")).alias("node")).join(of_node, "node", "left")
        return rows.select("id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def _numbered(docs: DataFrame, id_column: str) -> tuple[DataFrame, str, DataFrame]:
    """``docs`` with a row number, its name, and (key, text): keys ascend by id, null last, and no two rows share one.

    Texts are fetched by key, so ids that are null or repeated cost no more than others.
    """
    row = unused(docs, "__row")
    numbered = with_row(docs, row)
    key = F.struct(F.col(id_column).isNull().alias("unknown"), F.col(id_column).alias("id"), F.col(row).alias("row"))
    return numbered, row, numbered.select(key.alias("key"), "text")


def joined(docs: DataFrame, id_column: str = "doc_id", **how) -> DataFrame:
    """(id, n_shingles, component_id) of each document."""
    _, _, keyed = _numbered(docs, id_column)
    members = Join(keyed, "key", **how).membership()
    return members.select(F.col("id.id").alias(id_column), "n_shingles", F.col("component_id.id").alias("component_id"))


def one_of_each(docs: DataFrame, id_column: str = "doc_id", **how) -> DataFrame:
    """One document of each component, the one with the smallest id; columns as in ``docs``.

    Rows of one id stay apart; of equal rows one stays.  Documents without words
    all stay.
    """
    numbered, row, keyed = _numbered(docs, id_column)
    kept = Join(keyed, "key", **how).membership().filter("id = component_id").select(F.col("id.row").alias(row))
    return numbered.join(kept, row, "left_semi").select(*docs.columns)


#: The query's columns in SQL.
ORACLE = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT r, ws, unnest(range(1, greatest(len(ws) - {SHINGLE} + 1, 1) + 1)) AS i FROM d WHERE len(ws) > 0),
s AS (SELECT DISTINCT r, array_to_string(ws[i:i + {SHINGLE} - 1], ' ') AS g FROM p),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
c AS (SELECT a.r AS x, b.r AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n nx ON x = nx.r JOIN n ny ON y = ny.r WHERE 100 * k >= 10 * {TENTHS} * (nx.n + ny.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach(r, z) AS (SELECT r, r FROM d UNION SELECT reach.r, e.y FROM reach JOIN e ON reach.z = e.x),
m AS (SELECT reach.r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.z GROUP BY reach.r)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id FROM d JOIN m USING (r) LEFT JOIN n USING (r)
"""
