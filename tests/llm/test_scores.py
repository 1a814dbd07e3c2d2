"""Quality rules, the classifier and the language model."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from corpus_fixtures import corpus, make  # noqa: F401

from fareloom.llm import brown, outliers, quality_fm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows, covered = {}, set()
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i:i + 8]), []).append(i)
    for starts in windows.values():
        for i in starts if len(starts) > 1 else ():
            covered.update(range(i, i + 8))
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(covered))


def test_counts_and_base_rules(make, corpus):
    rows = [*corpus, (200, "a b\n\na b\n \na b c"), (201, "x y " * 30), (202, "#*$ %&|<> " * 20),
            (203, "  \x85 \x1c"), (204, ("q w e r t z u i o " * 2) + "unlike others here")]
    found = outliers.quality_rules(make(rows), least=5).collect()
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
            r.base_failed) for r in found]
    expected = [(i, *c, c[0] < 20 or 100 * c[4] > 30 * c[0])
                for i, t in rows for c in [counts(t)]]
    assert sorted(got) == sorted(expected)
    assert all(not r.kept for r in found if r.base_failed)


def test_outliers_by_language_and_source(make):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randrange(2, 9)))
                  for _ in range(3000)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(80, 240))),
             rng.choice(["en", None]), rng.choice(["a", "b", None])) for i in range(900)]
    for i in range(0, 60, 2):
        rows[i] = (i, rows[i][1].replace(" ", "### ").upper(), *rows[i][2:])
    found = {r.doc_id: r for r in outliers.quality_rules(make(rows), least=50).collect()}
    assert not any(found[i].kept for i in range(0, 60, 2))
    assert sum(not found[i].kept for i in range(60, 900)) <= 4


def test_few_equal_or_no_rows(make):
    assert outliers.quality_rules(make([(1, "a")]).where("false")).collect() == []
    text = " ".join(f"word{i}" for i in range(50))
    found = outliers.quality_rules(make([(i, text) for i in range(5)] + [(None, None)])).collect()
    assert sorted((r.doc_id is None, r.kept) for r in found) == [(False, True)] * 5 + [(True, False)]


def test_chi_square():
    assert outliers.chi2_cdf(3.841458820694124, 1) == pytest.approx(0.95)
    assert outliers.chi2_quantile(0.999, 6) == pytest.approx(22.457744484825323)


def labelled(spark, make):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randrange(2, 9)))
                  for _ in range(500)]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 120))]
        good = rng.random() < 0.6
        rows.append((i, " ".join(words) if good else "!! ".join(words).upper()))
        labels.append((i, int(good), 0))
    return make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_classifier_on_held_out_rows(spark, make):
    docs, labels, known = labelled(spark, make)
    model = quality_fm.fit(docs, labels)
    extra = make([(1000, None), (1001, ""), (1002, "one")])
    scored = {r.doc_id: r for r in quality_fm.score(docs.unionByName(extra), model).collect()}
    assert len(scored) == 403 and all(0 <= r.score <= 1 for r in scored.values())
    held = [(scored[i].predicted, q) for i, q, _ in known if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 60 and np.mean([p == q for p, q in held]) > 0.97
    # The machine's sum of pairs, in the plain quadratic form.
    machine, row = model.stages[-1], model.transform(quality_fm.features(docs)).first()
    x, v = row["features"].toArray(), machine.factors.toArray()
    on = np.nonzero(x)[0]
    z = machine.intercept + machine.linear.toArray() @ x + sum(
        v[i] @ v[j] * x[i] * x[j] for a, i in enumerate(on) for j in on[a + 1:])
    assert row["probability"][1] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_classifier_keeps_rows_and_learns_nothing_held_out(spark, make):
    docs, labels, _ = labelled(spark, make)
    flipped = labels.selectExpr(
        "doc_id", "if(crc32(cast(doc_id as string)) % 4 = 2, 1 - quality, quality) as quality")
    a, b = (quality_fm.score(docs, quality_fm.fit(docs, x)).collect() for x in (labels, flipped))
    assert max(abs(x.score - y.score) for x, y in zip(sorted(a), sorted(b))) < 1e-6
    kept = quality_fm.without_rejected(docs, quality_fm.fit(docs, labels))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in a if r.predicted}


def test_classifier_without_both_labels(spark, make):
    docs = make([(0, "a"), (1, None)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_fm.fit(docs, none) == 0.5
    one = spark.createDataFrame([(0, 1), (1, 1), (3, None)], "doc_id long, quality int")
    model = quality_fm.fit(docs, one)
    assert 0.5 < model < 1
    assert [r.score for r in quality_fm.score(docs, model).collect()] == [model, model]
    assert quality_fm.score(docs.where("false"), model).collect() == []


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def test_language_model(make, corpus):
    rows = [*corpus, (None, "no id")]
    found = brown.class_ngram_scores(make(rows, 4), frequent=60).collect()
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    seen = Counter(w for i, t in rows if not held[i] for w in tokens(t))
    total, kinds = sum(seen.values()), len(seen)
    expected = sorted(((i is None, i or 0), held[i], len(tokens(t)),
                       sum(seen[w] > 0 for w in tokens(t)),
                       round(sum(math.log10((seen[w] + 0.1) / (total + 0.1 * (kinds + 1)))
                                 for w in tokens(t)), 6)) for i, t in rows)
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.held_out, r.n_tokens, r.n_known,
                   round(r.base_score, 6)) for r in found) == expected
    assert {r.train_tokens for r in found} == {total}
    assert all(r.score < 0 for r in found)


def test_language_model_without_training(make):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    found = brown.class_ngram_scores(make([(i, "a b") for i in ids])).collect()
    assert [(r.n_tokens, r.n_known, r.base_score, r.score) for r in found] == [(3, 0, 0, 0)] * 3
    assert brown.class_ngram_scores(make([(1, "a")]).where("false")).collect() == []


def test_probabilities_sum_to_one(make):
    """Texts of one word each, over the whole vocabulary and one unknown word."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(30)))
            for i in range(60) if zlib.crc32(str(i).encode()) % 10]
    probes = [i for i in range(1000, 3000) if zlib.crc32(str(i).encode()) % 10 == 0]
    words = [*"abcdefgh", "unseen"]
    found = {r.doc_id: r for r in brown.class_ngram_scores(make(
        rows + list(zip(probes, words)) + [(probes[9], "")])).collect()}
    # log10 P(w) = log10 P(w END) - log10 P(END | w); the sum over ends is bounded by one.
    assert sum(10 ** found[i].score for i in probes[:9]) + 10 ** found[probes[9]].score <= 1.0001


def test_exchange_separates_alternating_words():
    pairs = [(a, b) for a in (0, 1, 2) for b in (3, 4, 5)] + [(b, a) for a in (0, 1, 2)
                                                             for b in (3, 4, 5)]
    of = brown.exchange(np.array(pairs), np.full(len(pairs), 10.0), 6, 2)
    assert len(set(of[:3])) == 1 and len(set(of[3:])) == 1 and of[0] != of[3]


def test_words_without_frequent_neighbours_are_apart(make):
    """Texts of rare words only are likelier by classes than without, and leave those of frequent
    words nearly as they are."""
    often = [(i, "a b a b a b") for i in range(1, 300) if zlib.crc32(str(i).encode()) % 10]
    rare = [(i, f"r{i} s{i} t{i}") for i in range(300, 310) if zlib.crc32(str(i).encode()) % 10]
    found = {r.doc_id: r for r in brown.class_ngram_scores(make(often + rare), frequent=2).collect()}
    for i, _ in rare:
        assert found[i].score > found[i].base_score
    alone = {r.doc_id: r for r in brown.class_ngram_scores(make(often), frequent=2).collect()}
    for i, _ in often[:3]:
        assert abs(found[i].score - alone[i].score) < 0.1
