"""Exact copies, near copies and repeated strings against brute force."""

import hashlib

import pytest
from corpus_fixtures import corpus, make  # noqa: F401

from fareloom.llm import exact_dedup, lsh_forest, suffix_dedup


def normal(text):
    return (text or "").encode().lower()


def test_exact_copies(make, corpus):
    rows = exact_dedup.exact_dedup(make(corpus), carry=("lang",)).collect()
    groups = {}
    for i, t in corpus:
        groups.setdefault(normal(t), []).append(i)
    expected = sorted((i, max(g), len(g), i == max(g)) for g in groups.values() for i in g)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows) == expected
    assert {r.lang for r in rows} == {"en"}


def test_exact_copies_without_rows_or_ids(make):
    assert exact_dedup.exact_dedup(make([(1, "a")]).where("false")).collect() == []
    rows = exact_dedup.exact_dedup(make([(None, "A"), (5, "a"), (None, "b"), (6, None), (7, "")]))
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(
        [(None, 5, 2, False), (5, 5, 2, True), (None, None, 1, True), (6, 7, 2, False),
         (7, 7, 2, True)], key=str)


def test_drop_copies_keeps_columns(make, corpus):
    docs = make(corpus)
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    assert out.select("text").distinct().count() <= out.count() < docs.count()


def test_map_of_fixed_size_only_saves_work(make, corpus):
    small = exact_dedup.exact_dedup(make(corpus), filter_bits=1, prefix_chars=1).collect()
    assert sorted(map(tuple, small)) == sorted(map(tuple, exact_dedup.exact_dedup(
        make(corpus)).collect()))


def shingles(text, size):
    words = normal(text).split()
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k:k + size]) for k in range(len(words) - size + 1))


def linked(rows, size, share):
    sets = [(i, shingles(t, size)) for i, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= share * len(a | b):
                parent[find(x)] = find(y)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(s), least[find(k)], i == least[find(k)])
                  for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize("size, share", [(3, 85), (5, 80)])
def test_near_copies(make, corpus, size, share):
    rows = lsh_forest.near_duplicates(make(corpus), size=size, share=share).collect()
    assert sorted(map(tuple, rows)) == linked(corpus, size, share)


def test_crowded_regions(make, corpus, monkeypatch):
    """More near copies than a region takes, in regions one value deeper and runs."""
    monkeypatch.setattr(lsh_forest, "CROWD", 4)
    rows = [(i, t) for i, t in corpus if i % 9 in (0, 1, 3)]
    base = rows[0][1].split(" ")
    rows += [(1000 + i, " ".join([*base[:i], f"w{i}", *base[i + 1:]])) for i in range(0, 120, 2)]
    found = lsh_forest.near_duplicates(make(rows), size=3, share=85).collect()
    assert sorted(map(tuple, found)) == linked(rows, 3, 85)


def test_variants_linked_with_their_base_only(make):
    """A star whose rays are not linked with each other, in regions far over CROWD."""
    import random

    rng = random.Random(11)
    base = [f"b{k}" for k in range(400)]
    rows = [(0, " ".join(base))]
    for i in range(1, 1001):
        words = list(base)
        for k in rng.sample(range(1, 100), 10):
            words[4 * k - 2] = f"v{i}x{k}"
        rows.append((i, " ".join(words)))
    sets = [shingles(t, 3) for _, t in rows]
    assert all(100 * len(sets[0] & s) >= 85 * len(sets[0] | s) for s in sets)
    assert sum(100 * len(sets[1] & s) >= 85 * len(sets[1] | s) for s in sets) == 2
    found = lsh_forest.near_duplicates(make(rows), size=3, share=85).collect()
    assert sorted(map(tuple, found)) == [(i, 398, 0, i == 0) for i, _ in rows]


@pytest.mark.parametrize("share, least, most", [(50, 0.5, 0.62), (70, 0.7, 0.8), (85, 0.85, 0.9)])
def test_links_at_each_share(make, share, least, most):
    """Pairs of texts a little above the share, all of them found."""
    import random

    rng = random.Random(share)
    rows, linked_pairs = [], 0
    while linked_pairs < 60:
        words = [f"w{rng.randrange(10 ** 9)}" for _ in range(150)]
        other = list(words)
        for k in rng.sample(range(150), rng.randrange(1, 30)):
            other[k] = f"w{rng.randrange(10 ** 9)}"
        a, b = (shingles(" ".join(t), 3) for t in (words, other))
        if least <= len(a & b) / len(a | b) < most:
            rows += [(2 * linked_pairs, " ".join(words)), (2 * linked_pairs + 1, " ".join(other))]
            linked_pairs += 1
    found = lsh_forest.near_duplicates(make(rows), size=3, share=share).collect()
    assert sum(r.kept for r in found) == linked_pairs


def test_variants_of_a_text_that_is_missing(make):
    """All near each other and to what most of them have; only a few are linked."""
    import random

    rng = random.Random(12)
    base = [f"b{k}" for k in range(200)]
    rows = []
    for i in range(160):
        words = list(base)
        for k in rng.sample(range(200), 3 if i % 4 == 0 else rng.randrange(5, 12)):
            words[k] = f"v{i}x{k}"
        rows.append((i, " ".join(words)))
        if i % 10 == 0:
            rows.append((1000 + i, " ".join([*words[:-1], "end"])))
    found = lsh_forest.near_duplicates(make(rows), size=3, share=85).collect()
    expected = linked(rows, 3, 85)
    assert 10 < sum(e[3] for e in expected) < len(rows) - 16
    assert sorted(map(tuple, found)) == expected


@pytest.mark.parametrize("edges", [7, 100_000])
def test_components_by_stars_of_tasks(spark, monkeypatch, edges):
    """Few edges take one table and no rounds; more than a task takes are joined in rounds."""
    import random

    rng = random.Random(3)
    pairs = [(k, k + 1) for k in range(100, 160)] + [(9, k) for k in range(10, 40)] + [
        (rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    pairs = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in pairs if a != b]
    rng.shuffle(pairs)
    least = {k: k for p in pairs for k in p}
    for _ in least:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    tables, written = [], lsh_forest.written
    monkeypatch.setattr(lsh_forest, "EDGES", edges, raising=False)
    monkeypatch.setattr(lsh_forest, "written", lambda df, purpose: tables.append(purpose) or written(
        df, purpose))
    node = [(a.to_bytes(2, "big"), b.to_bytes(2, "big")) for a, b in pairs]
    table = written(spark.createDataFrame(node, "a binary, b binary").repartition(9), "edges")
    found = lsh_forest.components(table).collect()
    assert sorted((int.from_bytes(r.node, "big"), int.from_bytes(r.root, "big"))
                  for r in found) == sorted(least.items())
    assert (len(tables) == 1) == (edges > len(pairs))
    assert lsh_forest.components(table.where("false")).collect() == []


def test_near_copies_without_rows_or_ids(make):
    assert lsh_forest.near_duplicates(make([(1, "a")]).where("false")).collect() == []
    rows = lsh_forest.near_duplicates(make([(None, "a b c d"), (4, "A b c d"), (5, "")]), size=3)
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(
        [(None, 2, 4, False), (4, 2, 4, True), (5, 0, 5, True)], key=str)


def repeated(rows, window=50):
    first, out = {}, []
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    for i, t in order:
        data = (t or "").encode()
        for p in range(len(data) - window + 1):
            first.setdefault(data[p:p + window], i)
    for i, t in order:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - window + 1):
            if first[data[p:p + window]] != i:
                gone[p:p + window] = b"\1" * window
        starts = [p for p in range(len(data)) if gone[p] and not (p and gone[p - 1])]
        stops = [p + 1 for p in range(len(data)) if gone[p] and not gone[p + 1:p + 2] == b"\1"]
        kept = bytes(c for c, g in zip(data, gone) if not g)
        out.append((i, len(data), list(zip(starts, stops)), hashlib.sha256(kept).hexdigest()))
    return out


def key(row):
    return str(row)


def test_repeated_strings(make, corpus):
    short = [(i, t[:30000] if t else t) for i, t in corpus]
    rows = [(r.doc_id, r.n_bytes, [(s.start, s.stop) for s in r.spans], r.kept_sha256)
            for r in suffix_dedup.repeated_spans(make(short, 5)).collect()]
    assert sorted(rows, key=key) == sorted(repeated(short), key=key)


def test_repeated_strings_of_few_letters(make):
    import random

    rng = random.Random(3)
    blocks = ["ab" * 60, "x" * 200, "".join(rng.choice("ab") for _ in range(150)), "é" * 70]
    rows = [(i, "".join(rng.choice(blocks)[rng.randrange(60):] for _ in range(rng.randrange(4))))
            for i in range(60)]
    rows += [(None, "x" * 80), (60, None), (7, blocks[2])]
    found = [(r.doc_id, r.n_bytes, [(s.start, s.stop) for s in r.spans], r.kept_sha256)
             for r in suffix_dedup.repeated_spans(make(rows, 6)).collect()]
    assert sorted(found, key=key) == sorted(repeated(rows), key=key)


def test_family_merges_equal_sizes():
    import numpy as np

    marks = np.zeros(40, np.uint32)
    family = suffix_dedup.SuffixFamily(3, marks)
    for place in range(8):
        family.add([b"abc" + (9 - place).to_bytes(8, "big") + (place * 32).to_bytes(6, "big"),
                    bytes([100 + place]) * 3 + bytes(8) + (place * 32 + 1).to_bytes(6, "big")])
    assert len(family.levels) <= 3
    family.close()
    assert [int(m) for m in marks[:8]] == [1] * 7 + [0]  # the last has the smallest rank


def test_texts_are_written_once(make, corpus, monkeypatch):
    tables, written = {}, suffix_dedup.written

    def noted(df, purpose):
        tables[purpose] = df.columns
        return written(df, purpose)

    monkeypatch.setattr(suffix_dedup, "written", noted)
    found = suffix_dedup.repeated_spans(make(corpus)).collect()
    assert [(r.doc_id, r.kept_sha256) for r in sorted(found, key=lambda r: r.doc_id)] == [
        (r[0], r[3]) for r in repeated(corpus)]
    assert [t for t, columns in tables.items() if "body" in columns] == ["suffix-slices"]


def test_steps_of_sorted_numbers():
    import numpy as np

    numbers = np.sort(np.random.default_rng(5).integers(0, 1 << 48, 60000).astype(np.uint64))
    data = suffix_dedup._planes(numbers, 6)
    assert (suffix_dedup._from_planes(data, 6) == numbers).all()
    as_they_are = numbers.view(np.uint8).reshape(-1, 8)[:, :6].T
    assert len(data) < 0.95 * len(suffix_dedup._pressed(np.ascontiguousarray(as_they_are)))


def test_no_rows_no_spans(make):
    assert suffix_dedup.repeated_spans(make([(1, "a")]).where("false")).collect() == []
