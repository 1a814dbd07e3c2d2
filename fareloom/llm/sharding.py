"""Shards under a byte limit by extendible hashing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from fareloom.llm.texts import text_of
from fareloom.session import written

#: Bits behind the expected depth that sums are first taken at, and those before it at which
#: splitting starts; a bucket there holds many times the limit unless the table is small.
BELOW, ABOVE = 5, 6
#: Bits added where a cell is still too large.
MORE = 8
HASH_BITS = 64


def _prefix(h: Column, depth: int) -> Column:
    """The first ``depth`` bits, of at most 63."""
    return F.shiftrightunsigned(h, HASH_BITS - depth) if depth else F.lit(0).cast("long")


def _leaves(keys: DataFrame, limit: int, total: int) -> list[tuple[int, DataFrame]]:
    """For each depth that cells were needed at, the bucket (depth, prefix, bytes) of each cell.

    A bucket is the shortest prefix whose bytes are within the limit.
    """
    expected = max(0, math.ceil(math.log2(max(1, total) / limit)))
    top, depth = max(0, expected - ABOVE), min(expected + BELOW, HASH_BITS - 1)
    found, first = [], True
    while True:
        cells = written(keys.groupBy(_prefix(F.col("h"), depth).alias("cell")).agg(
            F.sum("bytes").alias("bytes"), F.min("h").alias("low"), F.max("h").alias("high")),
            f"shard-cells-{depth}")
        # Sums of every bucket from the cells up; each cell is a row per depth.
        levels = cells.select("cell", "bytes", F.explode(
            F.sequence(F.lit(top), F.lit(depth))).alias("depth")).withColumn(
            "prefix", F.expr(f"shiftright(cell, {depth} - depth)"))
        sums = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("sum"))
        fitting = levels.join(sums.where(F.col("sum") <= limit), ["depth", "prefix"]).groupBy(
            "cell").agg(F.min(F.struct("depth", "prefix", "sum")).alias("leaf"))
        single = (F.col("low") == F.col("high")) | F.lit(depth == HASH_BITS - 1)
        placed = written(cells.join(fitting, "cell", "left").select(
            "cell", F.when(F.col("leaf").isNull() & single, F.struct(
                F.lit(depth).alias("depth"), F.col("cell").alias("prefix"),
                F.col("bytes").alias("sum"))).otherwise(F.col("leaf")).alias("leaf")),
            f"shard-leaves-{depth}")
        found.append((depth, placed.where("leaf IS NOT NULL")))
        open_ = placed.where("leaf IS NULL").select("cell")
        if open_.isEmpty():
            return found
        keys = written(keys.withColumn("cell", _prefix(F.col("h"), depth)).join(
            open_, "cell", "left_semi").select("h", "bytes"), f"shard-keys-{depth}")
        top, depth = depth + 1, min(depth + MORE, HASH_BITS - 1)


def shards(docs: DataFrame, limit_bytes: int, carry: tuple[str, ...] = (),
           text: str = "text") -> DataFrame:
    """For each row doc_id, n_bytes, hash, shard, depth, shard_bytes, and the ``carry`` columns.

    A shard is a prefix of the hash of id and text, written as bits ('' where all rows fit one). As
    in extendible hashing only buckets over ``limit_bytes`` of UTF-8 text are split, on one more
    bit, until each fits; the directory from prefixes to shards stays a table. A text over the
    limit is alone in its shard, or with others of its hash: only such shards exceed it.

    Byte counts are summed per cell, a few dozen to a shard, and only rows of cells that are still
    too large are looked at again; hashes spread a hot source over all cells. Splitting starts at
    a depth at which a bucket holds 64 times the limit on average, at none for small tables.

    A missing text counts as empty; missing ids are hashed as a value. Rows equal in id and text
    share a shard. An empty table gives an empty result; other columns are ignored.
    """
    if limit_bytes < 1:
        raise ValueError("the limit must be at least one byte")
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    row = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("string")
    source = docs.select(
        "doc_id", F.octet_length(text_of(text)).cast("long").alias("bytes"),
        F.xxhash64(ident, text_of(text)).alias("h"), row.alias("_row"))
    keys = written(source.select("h", "bytes"), "shard-keys")
    total = keys.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    out, left = None, source
    for depth, leaves in _leaves(keys, limit_bytes, total):
        here = left.withColumn("cell", _prefix(F.col("h"), depth)).join(leaves, "cell")
        left = left.withColumn("cell", _prefix(F.col("h"), depth)).join(
            leaves, "cell", "left_anti").drop("cell")
        out = here if out is None else out.unionByName(here)
    bits = F.when(F.col("leaf.depth") == 0, "").otherwise(
        F.lpad(F.bin("leaf.prefix"), F.col("leaf.depth"), F.lit("0")))
    return out.select(
        "doc_id", F.col("bytes").alias("n_bytes"), F.col("h").alias("hash"), bits.alias("shard"),
        F.col("leaf.depth").alias("depth"), F.col("leaf.sum").alias("shard_bytes"),
        *[F.col("_row").getField(c).alias(c) for c in carry])


def write_shards(docs: DataFrame, path: str, limit_bytes: int) -> None:
    """The rows of ``docs`` as Parquet, a folder ``shard=b...`` for each shard.

    ``docs`` may have no column ``shard`` and none with the name of one of the operator's.
    """
    others = tuple(c for c in docs.columns if c != "doc_id")
    placed = shards(docs, limit_bytes, others).select(
        "doc_id", *others, F.concat(F.lit("b"), "shard").alias("shard"))
    placed.repartition("shard").write.partitionBy("shard").parquet(path)
