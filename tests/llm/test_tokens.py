"""Encoding and packing against the tokenizers library."""

import random

import numpy as np
import pytest
from corpus_fixtures import corpus, make  # noqa: F401

from fareloom.llm import bpe, packing

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["it's they'll WE'VE 'sabc o'r", "a<|endoftext|>b <|STARTOFTEXT|> <|startoftext|><|endoftext|>",
       "a\x1cb\x85c d e　", "J̌ T̈ é İ", "İstanbul ΣΑΣ ß ﬁ",
       "٣4½ ²x 1234567", "日本語テキスト🎉👩‍👩‍👧", "\x00\x01\x7f", "...!!!,,'s", "x" * 3000, "&|<>#*",
       "​zero​width", "don''t 'S 'T", "﻿bom"]


@pytest.fixture(scope="module")
def library():
    own = tokenizers.Tokenizer.from_file(PATH)
    own.no_truncation()
    own.no_padding()
    return own


@pytest.fixture(scope="module")
def texts(corpus):
    return [*corpus, *((500 + i, t) for i, t in enumerate(ODD))]


def test_encode_and_decode_as_the_library(make, texts, library):
    rows = bpe.decode(bpe.encode(make(texts), PATH), PATH).collect()
    expected = []
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected.append((i, ids, library.decode(ids, skip_special_tokens=False)))
    assert sorted((r.doc_id, list(r.ids), r.text) for r in rows) == sorted(expected)


def test_no_rows(make):
    none = make([(1, "a")]).where("false")
    assert bpe.decode(bpe.encode(none, PATH), PATH).collect() == []
    assert packing.pack(packing.token_pieces(none, PATH)).collect() == []


def test_pair_index_is_byte_pair_encoding(library):
    rng = random.Random(5)
    words = ["".join(rng.choice("aabbcdeilnrst") for _ in range(rng.randrange(1, 30)))
             for _ in range(400)] + ["aaaa", "aaaaaaa", "abababab"]
    encoder = bpe.PairIndexEncoder(PATH)
    assert encoder.encode_words([w.encode() for w in words]) == [
        library.encode(w, add_special_tokens=False).ids for w in words]


def test_pieces_hold_all_tokens_once(make, texts, library):
    pieces = packing.token_pieces(make(texts), PATH, capacity=64).collect()
    own = {}
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length <= 64
        own.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, ids))
    expected = {}
    for i, t in texts:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        expected.setdefault((i, len(ids)), []).extend(
            (s, ids[s:s + 64]) for s in range(0, len(ids), 64))
    assert {k: sorted(v) for k, v in own.items()} == {k: sorted(v) for k, v in expected.items()}


@pytest.mark.parametrize("group", [50_000, 7])
def test_packed_places(make, corpus, group, monkeypatch):
    monkeypatch.setattr(packing, "RANK_GROUP", group)
    pieces = packing.token_pieces(make(corpus), PATH, capacity=64).drop("ids")
    rows = packing.pack(pieces, 64).collect()
    assert len(rows) == pieces.count()
    filled = {}
    for r in rows:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(filled) == list(range(len(filled)))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64


def test_shortest_pack_first():
    patterns = packing.shortest_pack_first({10: 3, 6: 2, 4: 3, 1: 1}, 10)
    used = {}
    for pattern, count in patterns:
        assert sum(pattern) <= 10
        for length in pattern:
            used[length] = used.get(length, 0) + count
    assert used == {10: 3, 6: 2, 4: 3, 1: 1}
    # The shortest pack takes the next length: of packs of 6 and 5, a 4 goes to the 5.
    assert dict(packing.shortest_pack_first({6: 1, 5: 1, 4: 1}, 10)) == {(6,): 1, (5, 4): 1}
    assert packing.shortest_pack_first({3: 7}, 10) == [((3, 3, 3), 2), ((3,), 1)]
    with pytest.raises(ValueError):
        packing.shortest_pack_first({11: 1}, 10)


def test_random_histograms_lose_nothing():
    rng = random.Random(1)
    for _ in range(50):
        histogram = {rng.randrange(1, 65): rng.randrange(1, 400) for _ in range(20)}
        used = {}
        for pattern, count in packing.shortest_pack_first(histogram, 64):
            assert sum(pattern) <= 64 and count > 0
            for length in pattern:
                used[length] = used.get(length, 0) + count
        assert used == histogram
