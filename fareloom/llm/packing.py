"""Packing by shortest-pack-first over the histogram of lengths."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from fareloom.llm.bpe import WordEncoder, preparation, slices
from fareloom.llm.texts import text_of
from fareloom.session import written

#: Rows of one length are ranked in groups of about so many.
RANK_GROUP = 50_000

_ENCODERS: dict[str, WordEncoder] = {}


def _library_encoder(path: str) -> WordEncoder:
    """Distinct words by the tokenizers library, one encoder for each worker process and file."""
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.no_truncation()
        own.no_padding()

        suffix = json.loads(own.to_str())["model"].get("end_of_word_suffix") or "\0"
        last = np.zeros(own.get_vocab_size(), bool)
        last[[i for t, i in own.get_vocab().items() if t.endswith(suffix)]] = True

        def encode_words(words: list[bytes]) -> list[list[int]]:
            """Words of letters alone are encoded as one text: each is one run of tokens, up to
            one that ends a word. All others go one by one."""
            texts = [w.decode("utf-8", "replace") for w in words]
            out: list = [None] * len(texts)
            plain = [k for k, t in enumerate(texts) if t.isalpha() and "\u0130" not in t]
            joined = own.encode_batch_fast([" ".join([texts[k] for k in plain])],
                                           add_special_tokens=False)[0].ids
            ends = (np.nonzero(last[joined])[0] + 1).tolist() if joined else []
            if len(ends) == len(plain):
                for k, a, b in zip(plain, [0, *ends], ends):
                    out[k] = joined[a:b]
            rest = [k for k, ids in enumerate(out) if ids is None]
            for k, e in zip(rest, own.encode_batch_fast([texts[k] for k in rest],
                                                        add_special_tokens=False)):
                out[k] = e.ids
            return out

        _ENCODERS[path] = WordEncoder(encode_words, preparation(path))
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1,
                 text: str = "text") -> DataFrame:
    """The tokens of each document, ``end_id`` behind them, cut into pieces of at most ``capacity``.

    Columns: doc_id, start, length, doc_tokens, and ``ids``, the piece's ids as little-endian
    unsigned 32-bit numbers. ``path`` is a tokenizer file that drops white space and is present on
    every executor. A missing or empty text has the one id ``end_id``. Repeated rows are documents
    of their own; other columns are ignored.
    """
    wanted = docs.select("doc_id", text_of(text).alias("text"))
    schema = T.StructType([wanted.schema["doc_id"], *(
        T.StructField(n, T.LongType(), False) for n in ("start", "length", "doc_tokens")),
        T.StructField("ids", T.BinaryType(), False)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _library_encoder(path)
        for batch in batches:
            for a, texts in slices(batch.column(1)):
                n = len(texts)
                ids, ends = encoder.encode(texts)
                ids = np.insert(ids, ends, end_id).astype("<u4")
                ends = ends + np.arange(1, n + 1)
                begins = np.concatenate([[0], ends[:-1]])
                sizes = ends - begins
                pieces = -(-sizes // capacity)
                row = np.repeat(np.arange(n), pieces)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = nth * capacity
                length = np.minimum(capacity, sizes[row] - start)
                offsets = np.concatenate([begins[row] + start, ends[-1:]]) * 4
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, n).take(pa.array(row)), pa.array(start),
                    pa.array(length), pa.array(sizes[row]),
                    pa.Array.from_buffers(pa.binary(), len(row), [
                        None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids)])],
                    names=[f.name for f in schema.fields])

    return wanted.mapInArrow(run, schema)


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns, as the lengths in each and how often it is used.

    Lengths are placed longest first, each into the pack that is shortest so far if it fits there,
    else into a new one, which then takes as many more of that length as it holds. Whole groups of
    equal packs move at once, so the work depends on the number of lengths, not of documents.
    """
    packs: dict[int, list[list]] = {}  # length so far -> [pattern, how often]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 0 < length <= capacity:
            raise ValueError(f"a length of {length} does not fit {capacity}")
        while left:
            shortest = min((total for total in packs if total + length <= capacity), default=0)
            if not shortest:
                for each in (capacity // length, left % (capacity // length)):
                    if each and left >= each:
                        packs.setdefault(each * length, []).append(
                            [(length,) * each, left // each])
                        left %= each
                break
            group = packs[shortest]
            pattern, count = group[-1]
            used = min(left, count)
            if used == count:
                group.pop()
                if not group:
                    del packs[shortest]
            else:
                group[-1][1] -= used
            packs.setdefault(shortest + length, []).append([(*pattern, length), used])
            left -= used
    return [(pattern, count) for group in packs.values() for pattern, count in group]


def pack(pieces: DataFrame, capacity: int = 2048, length: str = "length",
         order: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: where each lies.

    Only the histogram, of at most ``capacity`` rows, reaches the driver. Patterns are joined back
    by rank: the n-th piece of a length takes the n-th place that the patterns have for it. Ranks
    are counted in groups that a hash of ``order`` makes, a few ten thousand rows each, and shifted
    by the sizes of the groups before, so no length meets in one task. Pieces that agree in
    ``order`` and length take their places in any order. Null keys are a value; an empty table
    gives an empty result.
    """
    source = written(pieces, "pack-pieces")
    histogram = {r[0]: r[1] for r in source.groupBy(length).count().collect()}
    patterns = shortest_pack_first(histogram, capacity)
    # For each length: the first rank of each run of places, its first sequence and the offset.
    keys, sequences, offsets = [], [], []
    taken: dict[int, int] = {}
    sequence = 0
    for pattern, count in patterns:
        offset = 0
        for size in pattern:
            keys.append(size << 44 | taken.get(size, 0))
            sequences.append(sequence)
            offsets.append(offset)
            taken[size] = taken.get(size, 0) + count
            offset += size
        sequence += count
    by_key = np.argsort(np.array(keys, np.int64), kind="stable")
    first = np.array(keys, np.int64)[by_key]
    base, shift = np.array(sequences, np.int64)[by_key], np.array(offsets, np.int64)[by_key]

    groups = max(1, sum(histogram.values()) // RANK_GROUP)
    salted = source.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(groups)))
    before = written(salted.groupBy(length, "_salt").agg(F.count("*").alias("_n")).select(
        length, "_salt", (F.sum("_n").over(Window.partitionBy(length).orderBy("_salt")) -
                          F.col("_n")).alias("_before")), "pack-ranks")
    ranked = salted.withColumn("_rank", F.row_number().over(
        Window.partitionBy(length, "_salt").orderBy(*order)) - 1).join(
        before, [length, "_salt"]).withColumn(
        "_key", F.shiftleft(F.col(length).cast("long"), 44) + F.col("_before") + F.col("_rank"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(key: pd.Series) -> pd.DataFrame:
        run = np.searchsorted(first, key.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": base[run] + (key.to_numpy() - first[run]),
                             "offset": shift[run]})

    return ranked.withColumn("_place", place("_key")).select(
        *source.columns, "_place.sequence_id", "_place.offset")
