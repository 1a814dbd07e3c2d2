"""Extendible hashing: every shard fits, and none was split without need."""

from collections import defaultdict

import pytest
from corpus_fixtures import corpus, make  # noqa: F401

from fareloom.llm import sharding


def expected(rows, limit):
    """Buckets split one bit at a time, from one for all."""
    out = {}

    def split(keys, prefix):
        total = sum(n for _, n in keys)
        if total <= limit or len({h for h, _ in keys}) == 1 and total > limit:
            for h, _ in keys:
                out[h] = (prefix if total <= limit else None, total)
            return
        for bit in "01":
            split([k for k in keys if format(k[0] & (1 << 64) - 1, "064b")[len(prefix)] == bit],
                  prefix + bit)

    split([(r.hash, r.n_bytes) for r in rows], "")
    return out


@pytest.mark.parametrize("limit", [1, 700, 5_000, 60_000, 10**9])
def test_shards(make, corpus, limit, monkeypatch):
    monkeypatch.setattr(sharding, "ABOVE", 64)  # from one bucket, as ``expected`` does
    monkeypatch.setattr(sharding, "BELOW", 2)
    monkeypatch.setattr(sharding, "MORE", 3)
    rows = sharding.shards(make(corpus), limit).collect()
    assert sorted((r.doc_id, r.n_bytes) for r in rows) == sorted(
        (i, len((t or "").encode())) for i, t in corpus)
    sums = defaultdict(int)
    for r in rows:
        sums[r.shard] += r.n_bytes
        assert format(r.hash & (1 << 64) - 1, "064b").startswith(r.shard)
        assert r.depth == len(r.shard)
    assert all(r.shard_bytes == sums[r.shard] for r in rows)
    names = sorted(sums)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    for r in rows:
        shard, total = expected(rows, limit)[r.hash]
        # A text over the limit is alone; how deep its shard lies is left open.
        assert total == r.shard_bytes and shard in (None, r.shard)


def test_files_hold_the_rows(spark, make, corpus, tmp_path):
    docs = make(corpus).select("doc_id", "text", "lang")
    sharding.write_shards(docs, f"{tmp_path}/out", 60_000)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(str, back.select("doc_id", "text", "lang").collect())) == sorted(
        map(str, docs.collect()))


def test_no_rows(make):
    assert sharding.shards(make([(1, "a")]).where("false"), 10).collect() == []
    with pytest.raises(ValueError):
        sharding.shards(make([(1, "a")]), 0)
