"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fareloom.llm.texts import ascii_lower, text_of
from fareloom.session import written

#: Bits of one bitmap row of ``bitmap_construct_agg``.
ROW_BITS = 32768


def _bit_set(bitmap: Column, position: Column) -> Column:
    """Whether the bit at ``position`` (0 to 32767) of a 4,096-byte bitmap is set."""
    byte = F.conv(F.hex(F.substring(bitmap, (F.shiftright(position, 3) + 1).cast("int"), 1)),
                  16, 10).cast("int")
    return F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), position % 8).cast("int")) != 0,
                      F.lit(False))


def exact_dedup(docs: DataFrame, carry: tuple[str, ...] = (), text: str = "text",
                prefix_chars: int = 64, filter_bits: int = 1 << 25) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, and the ``carry`` columns.

    Texts are equal when identical after lower-casing A-Z; of equal texts the row with the largest
    ``doc_id`` stays. Each step looks only at what the one before could not tell apart:

    1. byte length: groups of one are done;
    2. length and a hash of the first ``prefix_chars`` characters: groups of one are done;
    3. SHA-256 of the whole normalised text, computed for the rows whose group is left.

    Step 3 finds its rows by a bitmap of ``filter_bits`` bits (4 MB) over the hashes of the groups
    left, so that texts are neither shuffled nor joined to find them. The bitmap has a fixed size
    whatever the input, and a false hit only costs a hash. Rows are summed to one per length and
    prefix hash before they are shuffled, and the join back to the rows of a group is one that
    adaptive execution can split.

    Missing texts count as empty, and all empty texts are equal. Rows that repeat a ``doc_id``
    with an equal text are one document: all are kept or none, and each counts in ``group_size``.
    A missing ``doc_id`` is smaller than any other. An empty table gives an empty result; other
    columns are ignored unless carried, whatever their names.
    """
    body = text_of(text)
    source = docs.select(
        F.col("doc_id"), F.struct(*[F.col(c) for c in carry]).alias("_carry") if carry
        else F.lit(None).cast("string").alias("_carry"),
        body.alias("_text"))
    length = F.octet_length("_text").alias("_length")
    head = F.xxhash64(F.octet_length("_text"), ascii_lower(
        F.substring(F.col("_text"), 1, prefix_chars))).alias("_head")

    cells = written(source.groupBy(length, head).agg(F.count("*").alias("_n")), "exact-cells")
    lengths = cells.groupBy("_length").agg(F.sum("_n").alias("_rows")).where("_rows > 1")
    left = cells.where("_n > 1").join(lengths, "_length", "left_semi")
    buckets = max(1, filter_bits // ROW_BITS)
    spread = F.pmod(F.col("_head"), F.lit(buckets * ROW_BITS))
    bitmap = written(left.groupBy(F.floor(spread / ROW_BITS).alias("_bucket")).agg(
        F.bitmap_construct_agg((spread % ROW_BITS)).alias("_bits")), "exact-bitmap")

    hashed = written(
        source.select("*", length, head)
        .withColumns({"_bucket": F.floor(spread / ROW_BITS), "_at": spread % ROW_BITS})
        .join(F.broadcast(bitmap), "_bucket", "left")
        .select("doc_id", "_carry", F.when(
            _bit_set(F.col("_bits"), F.col("_at")),
            F.sha2(ascii_lower(F.col("_text")), 256)).alias("_full")), "exact-hashed")
    groups = written(
        hashed.where("_full is not null").groupBy("_full").agg(
            F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")
        ).where("group_size > 1"), "exact-groups")
    shared = hashed.where("_full is not null").join(groups, "_full", "left").select(
        "doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(
            F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "_carry")
    alone = hashed.where("_full is null").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        "_carry")
    return shared.unionByName(alone).select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        *[F.col("_carry").getField(c).alias(c) for c in carry])


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns."""
    names = tuple(docs.columns)
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = names.index("doc_id"), names.index(options.get("text", "text"))
    keyed = inner.withColumns({"doc_id": F.col(f"c{at[0]}"), "text": F.col(f"c{at[1]}")})
    kept = exact_dedup(keyed, carry=tuple(inner.columns),
                       **{k: v for k, v in options.items() if k != "text"}).where("kept")
    return kept.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
