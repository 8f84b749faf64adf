"""Token output: documents encoded, packed into token files in id order, and read back.

The files are the rows of a table in the shared folder: Spark's writer reaches
any store and survives lost executors, which a file opened in a task does not.
``export`` takes one out for ``np.memmap``.

Ids ascend, null first; rows of one id are ordered by a hash of their text.  Null and
empty texts are the end id alone.  A document never crosses files, so a file
holds at least ``file_ids`` ids only if its last document takes it there.  An
empty table gives no file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echograph.llm import words as W
from echograph.llm.encoder import encoder
from echograph.llm.tokenfile import BLOCK, TokenFile, width_of, write
from echograph.sources.tables import stored

END_ID = 2
FILE_IDS = 1 << 21
CHUNK_BYTES = W.CHUNK_BYTES

_FILES = "part int, file int, before long, n_ids long, n_docs long, body binary"
_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _write(batches: Iterator[pa.RecordBatch], path: str, end_id: int, file_ids: int, block: int) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    own = encoder(path, end_id)
    width = width_of(max(own.tokenizer.get_vocab_size(), end_id + 1))
    file = before = held = 0
    docs: list = []
    counts: list[np.ndarray] = []
    ids: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        body = write(docs, np.concatenate(counts), np.concatenate(ids), width, before, block)
        columns = {"part": [part], "file": [file], "before": [before], "n_ids": [held], "n_docs": [len(docs)]}
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_pydict(
            {k: pa.array(v, t) for (k, v), t in zip(columns.items(), types, strict=True)} | {"body": pa.array([body], pa.binary())}
        )

    for batch in batches:
        names = batch.column("id").to_pylist()
        for i, j, data, offsets in W.chunks(batch, "text", CHUNK_BYTES):
            found, n = own.encode(data, offsets)
            ends = np.cumsum(n)
            done = 0
            while done < j - i:  # a file closes with the document that fills it
                taken = int(ends[done - 1]) if done else 0
                until = min(j - i, int(np.searchsorted(ends, taken + file_ids - held)) + 1)
                docs += names[i + done : i + until]
                counts.append(n[done:until])
                ids.append(found[taken : ends[until - 1]])
                held += len(ids[-1])
                done = until
                if held >= file_ids:
                    yield flush()
                    file, before, held, docs, counts, ids = file + 1, before + held, 0, [], [], []
    if docs:
        yield flush()


def token_files(
    docs: DataFrame, tokenizer: str, end_id: int = END_ID, id_column: str = "doc_id", file_ids: int = FILE_IDS, block: int = BLOCK
) -> DataFrame:
    """Stored table of token files, one a row: (part, file) order is id order.

    Texts are dealt by ranges of (id, text); a row number splits equal rows.
    """
    narrow = docs.select(F.col(id_column).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    keyed = narrow.withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange("id", "h", "row").sortWithinPartitions("id", "h").select("id", "text")
    written = ordered.mapInArrow(partial(_write, path=tokenizer, end_id=end_id, file_ids=file_ids, block=block), _FILES)
    return stored(written, "token_files")


def _read(batches: Iterator[pa.RecordBatch], bases: dict[int, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, body in zip(batch.column("part").to_pylist(), batch.column("body"), strict=True):
            file = TokenFile(np.frombuffer(body.as_buffer(), np.uint8))
            ids = file.ids(0, file.n_ids).astype("<u4").tobytes()
            places = file.places.tolist()
            crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(places[:-1], places[1:], strict=True)]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(file.doc_ids, pa.int64(), mask=file.null),
                    "start": pa.array(file.places[:-1] + file.before + bases[part]),
                    "n_tokens": pa.array(np.diff(file.places)),
                    "ids_crc32": pa.array(crc, pa.int64()),
                }
            )


def read_back(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read from the files' bytes.

    The driver adds up one number for each part, of which there are as many as tasks.
    """
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    bases, total = {}, 0
    for r in sizes:
        bases[r["part"]] = total
        total += r["n"]
    return files.select("part", "body").mapInArrow(partial(_read, bases=bases), _READ)


def export(files: DataFrame, folder: str) -> list[str]:
    """Writes the files to a local folder, one at a time, for a loader on this machine."""
    out = []
    Path(folder).mkdir(parents=True, exist_ok=True)
    for row in files.orderBy("part", "file").toLocalIterator():
        path = Path(folder) / f"{row['part']:06d}-{row['file']:06d}.ids"
        path.write_bytes(row["body"])
        out.append(str(path))
    return out
