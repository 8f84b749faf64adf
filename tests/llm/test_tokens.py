from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from echograph.llm import tokens
from echograph.llm import words as W
from echograph.llm.encoder import Encoder
from echograph.llm.tokenfile import TokenFile, pack, unpack, width_of, write

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    return Encoder(PATH, tokens.END_ID)


def whole(encoder, text):
    return [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, tokens.END_ID]


def test_pieces_give_what_whole_texts_give(encoder):
    rng = random.Random(3)
    signs = "aab Bé  \n\t\r\x0b\x1c\x1f\x85\xa0 　'1٣²!—$,.sštLß😀́​中\x00\x7f"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += [None, "", "<|endoftext|> a", "x<|endoftext|>y", "<|endof", "text|>", "it's we'll 'S 's", " '", "  ", " a ", "a "]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    for i, j, data, offsets in W.chunks(batch, "text", 20_000):
        ids, counts = encoder.encode(data, offsets)
        ends = np.cumsum(counts)
        for k in range(i, j):
            assert ids[ends[k - i] - counts[k - i] : ends[k - i]].tolist() == whole(encoder, texts[k]), repr(texts[k])


@given(st.integers(1, 32), st.lists(st.integers(0, (1 << 32) - 1), max_size=300))
def test_packing_is_reversible(width, ids):
    ids = np.array(ids, np.uint64) & np.uint64((1 << width) - 1)
    assert unpack(np.frombuffer(pack(ids, width), np.uint8), width, len(ids)).tolist() == ids.tolist()


def test_widths():
    assert [width_of(n) for n in (1, 2, 3, 256, 257, 50_257, 65_537)] == [1, 1, 2, 8, 9, 16, 17]


@pytest.mark.parametrize("block", [64, 100, 4096])
def test_random_access(block, tmp_path):
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 50_000, 5000).astype(np.uint32)
    body = write([4, None, -9], np.array([0, 4000, 1000]), ids, 17, 77, block)
    (tmp_path / "f.ids").write_bytes(body)
    for file in (TokenFile(np.frombuffer(body, np.uint8)), TokenFile(np.memmap(tmp_path / "f.ids", np.uint8, "r"))):
        assert (file.before, file.n_ids, file.doc_ids[[0, 2]].tolist(), file.null.tolist()) == (77, 5000, [4, -9], [False, True, False])
        for a, b in [(0, 0), (0, 5000), (63, 65), (4095, 4097), (4999, 5000)]:
            assert file.ids(a, b).tolist() == ids[a:b].tolist()
        assert file.document(2).tolist() == ids[4000:].tolist() and not len(file.document(0))
    with pytest.raises(ValueError):
        TokenFile(np.zeros(100, np.uint8))


def check(found, rows, encoder):
    """Rows of one id may come in any order; places must fit without gaps."""
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append(np.array(whole(encoder, t), "<u4"))
    at, last = 0, None
    for r in sorted(found, key=lambda r: r["start"]):
        key = (r["doc_id"] is not None, r["doc_id"] or 0)
        assert r["start"] == at and (last is None or key >= last)
        at, last = at + r["n_tokens"], key
        own = ids[r["doc_id"]]
        k = next(k for k, x in enumerate(own) if (len(x), zlib.crc32(x.tobytes())) == (r["n_tokens"], r["ids_crc32"]))
        own.pop(k)
    assert not any(ids.values())


@pytest.mark.parametrize("file_ids", [1 << 21, 50])
def test_round_trip(odd, encoder, file_ids):
    files = tokens.token_files(odd.repartition(4), PATH, file_ids=file_ids)
    check(tokens.read_back(files).collect(), [(r["doc_id"], r["text"]) for r in odd.collect()], encoder)
    assert (files.count() > 2) == (file_ids == 50)


def test_hot_id_and_empty_table(documents, encoder):
    rows = [(7, "same text")] * 200 + [(i, f"t {i}") for i in range(100)]
    check(tokens.read_back(tokens.token_files(documents(rows), PATH)).collect(), rows, encoder)
    assert tokens.read_back(tokens.token_files(documents([]), PATH)).collect() == []


def test_exported_files_map(documents, encoder, tmp_path):
    rows = [(i, f"text number {i}") for i in range(20)]
    paths = tokens.export(tokens.token_files(documents(rows), PATH, file_ids=30), str(tmp_path))
    seen = [f.document(k).tolist() for f in (TokenFile(np.memmap(p, np.uint8, "r")) for p in paths) for k in range(f.n_docs)]
    assert seen == [whole(encoder, t) for _, t in rows]
