"""Hard negatives against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from fareloom.llm import hard_negatives

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("label", T.IntegerType()),
    *(T.StructField(n, T.StringType()) for n in ("id", "uid", "q", "class", "score", "piece"))])


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, *["x"] * 6) for r in rows], SCHEMA).repartition(parts)


def brute(rows, positives=5, negatives=5):
    good = []
    for i, v, label in rows:
        if label is not None and v is not None and all(c is not None and math.isfinite(c) for c in v):
            good.append((i, [math.floor(256 * float(np.float32(c))) for c in v], label))
    first = lambda i: -(1 << 63) if i is None else i
    out = []
    for k, (anchor, q, label) in enumerate(good):
        if anchor is None or anchor % 100:
            continue
        scores = [(-sum(a * b for a, b in zip(q, v)), first(i), i, other == label)
                  for j, (i, v, other) in enumerate(good) if j != k]
        for s, _, i, same in sorted((x for x in scores if x[3]), key=lambda x: x[:2])[:positives]:
            fitting = sorted((x for x in scores if not x[3] and 80 * -s <= 100 * -x[0] <= 100 * -s),
                             key=lambda x: x[:2])
            out += [(anchor, i, r, n, -s, -t) for r, (t, _, n, _) in enumerate(
                fitting[:negatives], start=1)]
    return sorted(out, key=str)


def found(spark, rows, **options):
    out = hard_negatives.mine(table(spark, rows), F.col("vec_id") % 100 == 0, **options)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                           "negative_score"]
    return sorted(map(tuple, out.collect()), key=str)


def vectors(n, d, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    rows = []
    for i in range(n):
        v = centres[i % 6] + spread * rng.normal(size=d)
        rows.append((i, (v / np.linalg.norm(v) * rng.choice([0.3, 1, 1, 4])).tolist(),
                     int(rng.integers(3))))
    return rows


@pytest.mark.parametrize("spread, seed", [(1.0, 1), (0.05, 2)])
def test_all_pairs(spark, spread, seed, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BUCKET", 40)
    monkeypatch.setattr(hard_negatives, "BLOCK", 3)
    monkeypatch.setattr(hard_negatives, "PER_TASK", 2)
    rows = vectors(700, 8, seed, spread)
    expected = brute(rows)
    assert len(expected) > 20 and found(spark, rows) == expected


def test_ties_and_one_vector_in_a_third(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BUCKET", 50)
    rows = vectors(300, 4, 5)
    rows = [(i, [0.5, 0.5, 0.25, 0.0] if i % 3 == 0 else v, label) for i, v, label in rows]
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = vectors(120, 3, 6, 0.3)
    rows += [(200, None, 1), (300, [1.0, None, 0.0], 1), (400, [float("nan"), 0.0, 1.0], 1),
             (500, [float("inf"), 0.0, 1.0], 0), (600, [1.0, 0.5, 0.2], None), (700, [], 1),
             (800, [0.0, 0.0, 0.0], 2), (900, [1.0, 0.5], 1), (1000, [0.5, 0.5, 0.5, 9.0], 1),
             (None, [0.9, 0.5, 0.2], 1), (None, [0.8, 0.5, 0.2], 0), (1100, [-1.0, -0.3, 0.2], 7)]
    assert found(spark, rows) == brute(rows)


def test_repeated_rows_are_rows(spark):
    rows = [(100, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (1, [1.0, 0.0], 2), (1, [1.0, 0.0], 2)]
    assert found(spark, rows) == brute(rows)
    assert len(found(spark, rows)) == 4


def test_large_numbers_are_exact(spark):
    big = float(1 << 20)
    rows = [(100, [big, 3.0], 1), (1, [big, 5.0], 1), (2, [big, 4.0], 2), (3, [big, 5.0], 2)]
    assert found(spark, rows) == brute(rows)
    rows = [(i, [c * (1 << 25) for c in v], label) for i, v, label in rows]
    assert len(found(spark, rows)) > 0


def test_no_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0], 1)]) == []
    assert found(spark, [(100, [1.0], 1)]) == []


def test_query_equals_its_sql(spark):
    import duckdb
    from conftest import TESTDATA
    from fareloom.llm import oracle, queries

    with duckdb.connect() as con:
        con.execute(f"create view embeddings as from '{TESTDATA}/embeddings.parquet'")
        expected = con.execute(oracle.all_sql()["op13_hard_negatives"])
        columns, expected = [d[0] for d in expected.description], sorted(expected.fetchall())
    out = queries.op13_hard_negatives(spark, TESTDATA)
    assert sorted(map(tuple, out.select(columns).collect())) == expected and expected


def test_candidates_miss_nothing():
    rng = np.random.default_rng(3)
    pruned = 0
    for trial in range(60):
        d = int(rng.integers(1, 6))
        values = np.floor(256 * rng.normal(size=(80, d)) * rng.choice([0.2, 1, 5])).astype(np.int64)
        order = np.argsort(hard_negatives.unit_rows(values)[0], axis=0, kind="stable").T
        bucket = hard_negatives.Bucket({
            "ids": np.arange(80).tobytes(), "labels": np.zeros(80, np.int64).tobytes(),
            "uids": np.arange(80).tobytes(), "rows": values.tobytes(),
            "coordinates": np.ascontiguousarray(order, np.int32).tobytes()})
        anchor = values[trial]
        scores = values @ anchor
        for least in np.percentile(scores, [50, 90, 99, 100]):
            kept = bucket.candidates(anchor, float(np.sqrt(anchor @ anchor)), least)
            if kept is not None:
                pruned += 1
                assert set(np.nonzero(scores >= least)[0]) <= set(kept.tolist())
    assert pruned > 30
