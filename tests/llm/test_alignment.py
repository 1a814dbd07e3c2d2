"""Two tokenizers aligned, against whole texts compared token by token."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from corpus_fixtures import corpus, make  # noqa: F401

from fareloom.llm import alignment

public_tokenizers = pytest.importorskip("public_tokenizers")
pytest.importorskip("tokenizers")
pytest.importorskip("sentencepiece")
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "\n", "a ", "a\n ", " a", "▁", "a▁b c", "a\x00b", "<|endoftext|> <s></s> <unk> <0x41>",
       "x" * 3000, " " * 700, "\n" * 300 + " " * 200 + "a  \n b", "日本語 🎉👩‍👩‍👧 é é", "İ ß ﬁ ٣½"]


@pytest.fixture(scope="module")
def both():
    return alignment.Tokenizers(*PATHS)


def random_texts(n, seed=3):
    rng = random.Random(seed)
    signs = list("ab c  \n\n\t  'sABC12.,-é日本🎉  　\x0b\x1c\x85 ▁\r") + [
        " the", " and", "ing", "  ", "\n\n", "<|endoftext|>", "</s>", "<0x0A>"]
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def tokens_of(both, text):
    return (both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text))


def brute(both, texts):
    found = []
    for text in texts:
        if not text:
            found.append(None)
            continue
        ids_a, ids_b = tokens_of(both, text)
        tokens = [both.bytes_a[i] for i in ids_a], [both.bytes_b[i] for i in ids_b]
        if any(b"".join(t) != (" " + text).encode() for t in tokens):
            found.append(None)
            continue
        # The tokens that hold each byte.
        of = [[k for k, t in enumerate(side) for _ in t] for side in tokens]
        ends = [{k for k in range(1, len(o) + 1) if k == len(o) or o[k] != o[k - 1]} for o in of]
        common, groups, a, b = ends[0] & ends[1], [], [], []
        for at, (x, y) in enumerate(zip(*of), start=1):
            a += [x] if x not in a else []
            b += [y] if y not in b else []
            if at in common:
                groups.append((a, b))
                a, b = [], []
        found.append((ids_a, ids_b, sorted(set(zip(*of))), groups))
    counts = Counter((d[0][x], d[1][y]) for d in found if d for x, y in d[2])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for d in found:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        ids_a, ids_b, links, groups = d
        own = [(counts[ids_a[x], ids_b[y]], best[ids_b[y]]) for x, y in links]
        spelled = ";".join(",".join(str(ids_a[x]) for x in a) + "|" + ",".join(
            str(ids_b[y]) for y in b) for a, b in groups)
        out.append((len(ids_a), len(ids_b), len(groups), len(links),
                    sum(n == m for n, m in own), sum(n for n, _ in own),
                    hashlib.sha256(spelled.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("slice_bytes", [8 << 20, 900])
def test_alignment(make, corpus, both, slice_bytes, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE_BYTES", slice_bytes)
    rows = [*corpus, *((1000 + i, t) for i, t in enumerate(ODD + random_texts(150))), (None, "a b")]
    expected = [(i, *x) for (i, _), x in zip(rows, brute(both, [t for _, t in rows]))]
    found = alignment.align(make(rows), *PATHS)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                             "groups_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)


def test_no_rows(make):
    assert alignment.align(make([(1, "a")]).where("false"), *PATHS).collect() == []
    assert [tuple(r) for r in alignment.align(make([(1, None), (2, "")]), *PATHS).collect()] == [
        (1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_stretches_are_encoded_as_in_their_text(both):
    assert both.cuts
    stretches = alignment.Stretches(True)
    # B takes the sign that stands for a space as one, and such a text has no tokens.
    for text in (t for t in ODD + random_texts(1500, 8) if t and "▁" not in t):
        whole_a, whole_b = tokens_of(both, text)
        a, _, b, _ = both.encode([stretches.texts[n] for n in stretches.numbers(text)])
        assert a.tolist() == whole_a and b.tolist() == whole_b


def test_long_text_of_stretches_is_encoded_as_each(both):
    texts = [t for t in ODD + random_texts(800, 5) if t] + ["fiancée", "ÀÉ ²½x", "don't 'S", "a\tb"]
    a, counts_a, _, counts_b = both.encode(texts)
    assert both.ranked is not None
    expected = [both.a.encode(" " + t, add_special_tokens=False).ids for t in texts]
    assert counts_a.tolist() == [len(e) for e in expected] and len(counts_b) == len(texts)
    assert a.tolist() == [i for e in expected for i in e]


def test_gallop():
    rng = random.Random(4)
    values = np.array(sorted(rng.sample(range(5000), 600)))
    begins = np.array([rng.randrange(0, 600) for _ in range(300)])
    stops = np.array([rng.randrange(b, 601) for b in begins])
    targets = np.array([rng.randrange(0, 5200) for _ in range(300)])
    expected = [next((k for k in range(b, s) if values[k] >= t), s)
                for b, s, t in zip(begins, stops, targets)]
    assert alignment.gallop(values, targets, begins, stops).tolist() == expected


def test_overlaps_of_either_side():
    """Two stretches of nine bytes, the shorter list once A's and once B's."""
    a, b = [2, 5, 9], [1, 5, 7, 8, 9]
    found = alignment.Overlaps(
        np.array(a + [9 + e for e in b]), np.array([3, 5]),
        np.array(b + [9 + e for e in a]), np.array([5, 3]))
    links = [(0, 0), (0, 1), (1, 1), (2, 2), (2, 3), (2, 4)]
    assert sorted(zip(found.a.tolist(), found.b.tolist())) == sorted(
        links + [(3 + y, 5 + x) for x, y in links])
    assert found.groups.tolist() == [2, 2] and found.links.tolist() == [6, 6]
    assert np.nonzero(found.ends_a)[0].tolist() == [1, 2, 4, 7]
    assert np.nonzero(found.ends_b)[0].tolist() == [1, 4, 6, 7]
