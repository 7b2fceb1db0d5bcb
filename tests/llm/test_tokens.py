from __future__ import annotations

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillbin.llm import packing, token_files
from quillbin.llm.common import fresh_dir
from quillbin.llm.tokens import Encoder, default_path

TEXTS = ["a  b", "", None, " x", "x ", "a\nb c", "a \n b", "l'été it's 1 2 !! ?? <|endoftext|> x", "　a b", "a b c", "Ġ ĠĠ a", ", a", "a, .b", "x_, y", "a., b", "é, b", "ß. c.\nD", "a\x1fb c", "١, x", "日本, x. y", "a\n\nb", ".", ".\n.", "a.\nb. c, d"]


@pytest.fixture(scope="module")
def own():
    """The tokenizer as its file has it, apart from the code under test."""
    return Tokenizer.from_file(default_path())


def whole(own, text):
    return own.encode(text or "", add_special_tokens=False).ids


def test_same_ids_as_whole_texts(own, odd_rows):
    texts = TEXTS + [r[1] for r in odd_rows]
    for cache in (1_000_000, 50):
        e = Encoder(default_path(), cache)
        assert [x.tolist() for x in e.encode(texts)] == [whole(own, t) for t in texts]
        assert [x.tolist() for x in e.encode(texts[::-1])] == [whole(own, t) for t in texts[::-1]]


def test_same_ids_for_random_texts(own):
    """Marks, letters and spaces of all kinds next to each other, and names of added tokens."""
    rng = np.random.default_rng(5)
    signs = ["a", "Bc", "é", "ß", "×", "÷", "ÿ", "Ā", "9", "١", "日", "'s", "'", ",", ".", "!", "-", " ", " ", " ", "\n", "\t", "\x1f", "\x85", "\xa0", "\u1680", "\u180e", "\u2003", "\u2028", "\u202f", "\u205f", "\u3000", "\u200b", "<|endoftext|>", "<|", "\U0001f600"]
    texts = ["".join(signs[k] for k in rng.integers(0, n, rng.integers(0, 30))) for n in (21, 36) for _ in range(1500)]
    e = Encoder(default_path())
    for i in range(0, len(texts), 500):
        assert [x.tolist() for x in e.encode(texts[i : i + 500])] == [whole(own, t) for t in texts[i : i + 500]]


def test_coding_round_trip():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 9, 200)
    v = rng.integers(0, 1 << 32, counts.sum(), np.uint64).astype(np.uint32) >> rng.integers(0, 32, counts.sum()).astype(np.uint32)
    control, data, sizes = token_files.pack(v, counts)
    assert sizes.sum() == len(data)
    assert (token_files.unpack(control, data, counts) == v).all()


def test_files(spark, own, odd_docs, odd_rows, no_docs, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_IDS", 3000)
    manifest, by_rank = token_files.write_token_files(odd_docs, fresh_dir(spark, "t"))
    assert manifest.count() > 1
    got = [(r["doc_id"], r["start"], np.frombuffer(r["ids"], np.uint32).tolist()) for r in token_files.read_token_files(manifest, by_rank).collect()]
    got.sort(key=lambda r: r[1])
    want = sorted(((r[0], [*whole(own, r[1]), 2]) for r in odd_rows), key=lambda r: (r[0] is None, r[0] or 0))
    assert [r[0] for r in got] == [r[0] for r in want]
    assert sorted(repr((r[0], r[2])) for r in got) == sorted(map(repr, want))
    at = 0
    for _, start, ids in got:
        assert start == at
        at += len(ids)
    manifest, by_rank = token_files.write_token_files(no_docs, fresh_dir(spark, "t"))
    assert token_files.read_token_files(manifest, by_rank).count() == 0


def test_packing(own, odd_docs, odd_rows, no_docs):
    rows = packing.packed(odd_docs.where("doc_id is null or doc_id <> 605")).collect()
    want = {r[0]: np.array([*whole(own, r[1]), 1], "<u4") for r in odd_rows if r[0] not in (605, None)}
    pieces, sequences = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        if r["doc_id"] is not None:
            assert zlib.crc32(want[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
            assert r["doc_tokens"] == len(want[r["doc_id"]])
            pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for own_pieces, total in [(v, len(want[k])) for k, v in pieces.items()] + [(v, None) for v in sequences.values()]:
        at = 0
        for start, n in sorted(own_pieces):
            assert start == at and n > 0
            at += n
        assert at == total if total is not None else at <= 2048
    assert set(pieces) == set(want)
    padding = sum(2048 - n for v in sequences.values() for n in [sum(x[1] for x in v)] if n & (n - 1))
    assert padding <= 2048
    assert packing.packed(no_docs).count() == 0


def test_packing_stage(spark, clashing, odd_docs, no_docs):
    """Clashing columns change nothing; repeated rows and ids are packed each for itself."""
    kept = lambda df: sorted(map(repr, ((r["doc_id"], r["start"], r["length"], r["doc_tokens"]) for r in df.where("start = 0").collect())))
    ids = lambda df: sum(r["length"] for r in df.collect())
    a, b = packing.stage(spark, clashing, ""), packing.stage(spark, odd_docs, "")
    assert a.columns == b.columns and ids(a) == ids(b) and len(kept(a)) == len(kept(b)) == odd_docs.count()
    assert packing.stage(spark, no_docs, "").count() == 0


def test_sum_of_squares_choice():
    p = packing.Packer(8)
    for n in (3, 3, 5, 2):
        p.add(packing.Piece(1, 0, np.zeros(n, np.uint32), n))
    # 3 joins 3, since two windows at one level cost more; 5 does not fit; 2 fills the window at 6
    assert p.levels.tolist() == [0, 0, 0, 0, 0, 1, 0, 0, 0]
