"""Recurring passages against a count of all windows."""

import hashlib
import random
from collections import Counter

import pytest
from corpus_fixtures import corpus, make  # noqa: F401

from fareloom.llm import phrase_dedup


def brute(rows, window=35):
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    counts = Counter(tuple(w[k:k + window]) for _, w in texts for k in range(len(w) - window + 1))
    out = []
    for i, words in texts:
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            if counts[tuple(words[k:k + window])] > 1:
                gone[k:k + window] = [True] * window
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(docs, **options):
    rows = phrase_dedup.recurring_passages(docs, **options).collect()
    for r in rows:
        assert r.n_removed == sum(s.stop - s.start for s in r.spans)
        assert all(a.stop < b.start for a, b in zip(r.spans, r.spans[1:]))
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows), key=str)


@pytest.mark.parametrize("slice_bytes, run_words", [(4 << 20, 1 << 20), (3000, 70)])
def test_corpus(make, corpus, slice_bytes, run_words, monkeypatch):
    monkeypatch.setattr(phrase_dedup, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(phrase_dedup, "RUN_WORDS", run_words)
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeﬁ日") for _ in range(rng.randrange(1, 5))) for _ in range(300)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    line, passage, common = prose(20), prose(60), prose(34)
    rows = [*corpus]
    for i in range(60):
        parts = [prose(rng.randrange(40)), line, prose(rng.randrange(40))]
        if i % 3 == 0:
            cut = rng.randrange(30)
            parts += [passage[cut:cut + rng.randrange(20, 60)], prose(5)]
        if i % 4 == 0:
            parts += [common, prose(3)]  # one word short of a window
        if i % 5 == 0:
            parts += [common + ["x"], prose(3)]
        rows.append((1000 + i, rng.choice([" ", "\n", " \t "]).join(w for p in parts for w in p)))
    rows += [(2000, "a " * 34), (2001, "b " * 36), (2002, "c d " * 40), (2003, "e f g\x0b" * 30),
             (2004, " ".join(prose(35))), (None, None), (None, " ".join(passage))]
    expected = brute(rows)
    assert 0 < sum(r[2] for r in expected) < sum(r[1] for r in expected)
    assert found(make(rows)) == expected


def test_copies_go_altogether(make):
    text = " ".join(str(k) for k in range(50))
    rows = [(1, text), (2, text), (3, " ".join(text.split()[:34])), (4, text + " end"), (5, None)]
    out = found(make(rows))
    assert [r[:3] for r in out] == [(1, 50, 50), (2, 50, 50), (3, 34, 0), (4, 51, 50), (5, 0, 0)]
    assert out == brute(rows)


def test_other_windows(make, corpus):
    assert found(make(corpus[:60]), window=12) == brute(corpus[:60], 12)
    with pytest.raises(ValueError):
        phrase_dedup.recurring_passages(make([(1, "a")]), window=5)


def test_no_rows(make):
    assert found(make([(1, "a")]).where("false")) == []
    assert found(make([(1, "")])) == [(1, 0, 0, hashlib.sha256(b"").hexdigest())]


def test_automaton_of_long_passages():
    passage = tuple(range(100_000))
    texts = [list(passage), [7, *passage[50:300], 8], [1] * 5]
    assert list(phrase_dedup.located(texts, {passage, passage[50:300], passage[60:70]})) == [
        [(0, 100_000)], [(1, 251)], []]
    assert list(phrase_dedup.located([[1, 2]], set())) == [[]]
