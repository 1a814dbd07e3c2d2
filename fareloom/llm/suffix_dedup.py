"""Removal of repeated byte strings by a logarithmic family of suffix arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fareloom.llm.texts import text_of
from fareloom.session import written

#: Texts are read in slices of about so many bytes, and hashed in chunks that fit a cache.
SLICE_BYTES, CHUNK_BYTES = 8 << 20, 192 << 10
#: Windows of one entry at most; their marks are bits of a number.
RUN = 32
#: A missing id is smaller than any other.
NO_ID = -(1 << 63)
EMPTY = hashlib.sha256(b"").digest()
#: Of zstd; texts take a fifth less than at level 1, at 10 to 20 CPU seconds a GB more.
LEVEL = 6

_A, _B, _C = (np.uint64(c) for c in (
    0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    y = a * _C
    y ^= y >> np.uint64(29)
    y += b
    y *= _B
    y ^= y >> np.uint64(32)
    return y


def _hashes(x: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` bytes, put together from powers of two."""
    h = (x.astype(np.uint64) + np.uint64(1)) * _A
    h ^= h >> np.uint64(32)
    out, done, step = None, 0, 1
    while True:
        if length & step:
            if out is None:
                out = h
            else:
                n = min(len(out), len(h) - done)
                out = _mixed(out[:n], h[done:done + n])
            done += step
        step *= 2
        if step > length:
            return out
        half = step // 2
        h = _mixed(h[:-half], h[half:])


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n, step = len(h) - width + 1, 1
    while step * 2 <= width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    return np.minimum(h[:n], h[width - step:width - step + n])


def entries(x: np.ndarray, sizes: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """The runs of windows that the same sampled suffix stands for.

    Each window of ``window`` bytes is put down to the least hash of its half-length strings, so
    equal windows are put down to the same, wherever they are. Neighbouring windows mostly share
    it. Gives for each run its text's number, its first byte, its number of windows and the hash.
    """
    width = window // 2
    found = []
    starts = np.cumsum(sizes) - sizes
    first = 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + CHUNK_BYTES)))
        low, high = int(starts[first]), int(starts[last - 1] + sizes[last - 1])
        if high - low >= window:
            least = _least(_hashes(x[low:high], window - width + 1), width)
            text = np.repeat(np.arange(first, last), sizes[first:last])[:len(least)]
            ends = np.repeat((starts + sizes)[first:last], sizes[first:last])[:len(least)]
            inside = np.arange(low, low + len(least)) + window <= ends
            turn = np.ones(len(least), bool)
            turn[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
            at = np.nonzero(turn & inside)[0]
            # A run ends where the next begins or where windows would leave their text.
            stop = np.minimum(np.append(np.nonzero(turn)[0], len(least))[
                np.searchsorted(np.nonzero(turn)[0], at, side="right")],
                ends[at] - low - window + 1)
            pieces = -(-(stop - at) // RUN)
            row = np.repeat(np.arange(len(at)), pieces)
            begin = at[row] + RUN * (np.arange(len(row)) - np.repeat(
                np.cumsum(pieces) - pieces, pieces))
            found.append((text[at][row], begin + low, np.minimum(stop[row] - begin, RUN),
                          least[at][row]))
        first = last
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),)
    text, begin, count, h = (np.concatenate(c) for c in zip(*found))
    h = (h ^ (h >> np.uint64(31))) * _A  # least hashes are small; spread them again
    return text, begin, count, h ^ (h >> np.uint64(33))


def _pressed(data: bytes | np.ndarray) -> bytes:
    data = data if isinstance(data, bytes) else np.ascontiguousarray(data).tobytes()
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", LEVEL).compress(data, asbytes=True)


def _freed(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _planes(values: np.ndarray, width: int) -> bytes:
    """Sorted numbers as their steps, byte by byte, which compresses."""
    steps = np.diff(values.astype("<u8"), prepend=np.uint64(0))
    return _pressed(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width].T))


def _from_planes(data: bytes, width: int) -> np.ndarray:
    parts = np.frombuffer(_freed(data), np.uint8).reshape(width, -1)
    out = np.zeros((parts.shape[1], 8), np.uint8)
    out[:, :width] = parts.T
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(len(batch)):
            yield {c: batch.column(c)[k].as_py() for c in batch.schema.names}


def _record(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


class SuffixFamily:
    """Sorted arrays of windows whose sizes fall geometrically, with matches found on merging.

    An element is a window's bytes, its document's rank and the place to mark. Where two arrays
    merge, equal windows meet: those of larger documents are marked and leave the family.
    """

    def __init__(self, window: int, marks: np.ndarray):
        self.window, self.marks = window, marks
        self.levels: list[list[bytes]] = []

    def add(self, batch: list[bytes]) -> None:
        batch.sort()
        carry = self._matched(batch)
        while self.levels and len(self.levels[-1]) <= 2 * len(carry):
            carry = self._merged(self.levels.pop(), carry)
        self.levels.append(carry)

    def close(self) -> None:
        while len(self.levels) > 1:
            self.levels.append(self._merged(self.levels.pop(), self.levels.pop()))

    def _merged(self, a: list[bytes], b: list[bytes]) -> list[bytes]:
        both = a + b
        both.sort()  # two sorted runs: a merge
        return self._matched(both)

    def _matched(self, items: list[bytes]) -> list[bytes]:
        n, marks = self.window, self.marks
        kept, string, rank = [], None, None
        for item in items:
            if item[:n] != string:
                string, rank = item[:n], item[n:n + 8]
                kept.append(item)
            elif item[n:n + 8] == rank:
                kept.append(item)
            else:
                place = int.from_bytes(item[n + 8:], "big")
                marks[place // RUN] |= 1 << place % RUN
        return kept


def repeated_spans(docs: DataFrame, text: str = "text", window: int = 50) -> DataFrame:
    """For each row doc_id, n_bytes, ``spans`` and ``kept_sha256``.

    ``spans`` are the maximal runs (start, stop) of bytes of the UTF-8 text that lie in a string of
    ``window`` bytes which also starts in a text with a smaller doc_id; ``kept_sha256`` is of the
    bytes between them. Windows are compared byte by byte; hashes only choose what is compared.

    Texts are read once, into slices that are written. Each window is put down to a sampled
    suffix, about one in twelve positions. The hashes of these go to blocks, which tell each slice
    those that occur in more than one text. Only for them the windows travel: once per distinct
    string and slice, with the smallest doc_id, to the block of their hash, where each slice's
    come as a sorted suffix array, join a family of arrays whose equal sizes merge, and are
    matched as arrays merge. The marks go back to the slices. A string that a third of all texts
    share is one entry per slice, and copies of whole texts are told by their digest. What has to be
    shuffled is compressed, and texts are written only once, as slices.

    A missing text counts as empty; texts under ``window`` bytes keep all. A missing id counts as
    smaller than any. Rows that repeat an id don't match each other. An empty table gives an empty
    result; other columns are ignored.
    """
    slice_schema = T._parse_datatype_string(
        "slice long, ids array<long>, sizes array<long>, digests array<binary>, body binary")
    slice_arrow = to_arrow_schema(slice_schema)

    def slice_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 24
        ids, texts, total = [], [], 0

        def full() -> pa.RecordBatch:
            return _record(slice_arrow, [(
                base, ids, [len(t) for t in texts], [hashlib.sha256(t).digest() for t in texts],
                _pressed(b"".join(texts)))])

        for batch in batches:
            numbers, column = batch.column(0), batch.column(1).cast(pa.binary())
            for k in range(len(batch)):
                ids.append(NO_ID if (i := numbers[k].as_py()) is None else i)
                texts.append(column[k].as_py())
                total += len(texts[-1])
                if total >= SLICE_BYTES:
                    yield full()
                    base, ids, texts, total = base + 1, [], [], 0
        if ids:
            yield full()

    slices = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(text))
                     .mapInArrow(slice_up, slice_schema), "suffix-slices")
    blocks = max(2, slices.count())

    # Sampled hashes of each slice, in blocks: which occur in more than one text?
    hash_arrow = to_arrow_schema(T._parse_datatype_string(
        "block int, slice long, hashes binary, several binary"))

    def parts_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order by block and hash, and the edges of the blocks in it."""
        block = (h % np.uint64(blocks)).astype(np.int64)
        order = np.lexsort((h, block))
        return order, np.searchsorted(block[order], np.arange(blocks + 1))

    def sample(x: np.ndarray, sizes: np.ndarray):
        """Runs, and the distinct hashes in the order of blocks with what each run has."""
        text, begin, count, h = entries(x, sizes, window)
        h &= np.uint64((1 << 48) - 1)
        order, _ = parts_of(h)
        sorted_h = h[order]
        turn = np.ones(len(h), bool)
        turn[1:] = sorted_h[1:] != sorted_h[:-1]
        number = np.empty(len(h), np.int64)
        number[order] = np.cumsum(turn) - 1
        return text, begin, count, sorted_h[turn], number

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            sizes = np.array(row["sizes"], np.int64)
            text, _, _, distinct, number = sample(np.frombuffer(_freed(row["body"]), np.uint8),
                                                  sizes)
            several = np.zeros(len(distinct), bool)
            order = np.lexsort((text, number))
            n, t = number[order], text[order]
            several[n[1:][(n[1:] == n[:-1]) & (t[1:] != t[:-1])]] = True
            _, edges = parts_of(distinct)
            made = [(b, row["slice"], _planes(distinct[x:y], 6), _pressed(np.packbits(several[x:y])))
                    for b, (x, y) in enumerate(zip(edges, edges[1:])) if y > x]
            yield _record(hash_arrow, made)

    mask_schema = "block int, slice long, mask binary"
    mask_arrow = to_arrow_schema(T._parse_datatype_string(mask_schema))

    def shared(key: tuple[pa.Scalar, ...],
               batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for row in _rows(batches):
            h = _from_planes(row["hashes"], 6)
            rows.append((row["slice"], h, np.unpackbits(np.frombuffer(
                _freed(row["several"]), np.uint8))[:len(h)].astype(bool)))
        found, times = np.unique(np.concatenate([h for _, h, _ in rows]), return_counts=True)
        often = times > 1
        often[np.searchsorted(found, np.concatenate([h[s] for _, h, s in rows]))] = True
        for slice_, h, _ in rows:
            yield _record(mask_arrow, [(key[0].as_py(), slice_, np.packbits(
                often[np.searchsorted(found, h)]).tobytes())])

    masks = written(slices.select("slice", "sizes", "body").mapInArrow(
        hashed, "block int, slice long, hashes binary, several binary")
        .groupBy("block").applyInArrow(shared, mask_schema), "suffix-masks")

    # Copies of whole texts: all but those with the smallest id are removed as they are.
    whole = slices.select("slice", F.posexplode(F.arrays_zip("ids", "digests", "sizes")).alias(
        "at", "d")).where(F.col("d.sizes") >= window).select(
        "slice", "at", "d.ids", "d.digests")
    firsts = written(whole.groupBy("digests").agg(
        F.min("ids").alias("first"), F.max("ids").alias("_last")).where("first < _last").select(
        "digests", "first"), "suffix-firsts")
    copies = whole.join(firsts, "digests").where("ids > first").groupBy("slice").agg(
        F.sort_array(F.collect_list("at")).alias("at"))
    told = masks.select("slice", "block", "mask", F.lit(None).cast("array<int>").alias("at")) \
        .unionByName(copies.select("slice", F.lit(-1).alias("block"), F.lit(None).cast(
            "binary").alias("mask"), "at"))

    # Entries for the blocks, and what the slice needs to read the answer.
    out_schema = ("block int, slice long, strings binary, lengths binary, ranks binary, hashes binary, "
                  "places binary, whole array<boolean>")
    out_arrow = to_arrow_schema(T._parse_datatype_string(out_schema))

    def part(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {c: left.column(c)[0].as_py() for c in left.column_names}
        sizes, ids = np.array(row["sizes"], np.int64), np.array(row["ids"], np.int64)
        body = _freed(row["body"])
        text, begin, count, distinct, number = sample(np.frombuffer(body, np.uint8), sizes)
        _, edges = parts_of(distinct)
        often, copy = np.zeros(len(distinct), bool), np.zeros(len(sizes), bool)
        for r in right.to_pylist():
            if r["block"] < 0:
                copy[r["at"]] = True
            else:
                x, y = edges[r["block"]], edges[r["block"] + 1]
                often[x:y] = np.unpackbits(np.frombuffer(r["mask"], np.uint8))[:y - x]
        take = np.nonzero(often[number] & ~copy[text])[0]
        take = take[np.argsort(number[take], kind="stable")]
        text, begin, count, number = text[take], begin[take], count[take], number[take]
        # One entry per distinct string, with the smallest id that has it.
        known: dict[bytes, int] = {}
        strings: list[bytes] = []
        entry = np.empty(len(take), np.int64)
        for k, (a, n) in enumerate(zip(begin.tolist(), (count + window - 1).tolist())):
            s = body[a:a + n]
            if (e := known.get(s)) is None:
                e = known[s] = len(strings)
                strings.append(s)
            entry[k] = e
        least = np.full(len(strings), np.iinfo(np.int64).max)
        np.minimum.at(least, entry, ids[text])
        of_entry = np.zeros(len(strings), np.uint64)
        of_entry[entry] = distinct[number]
        of_block = np.zeros(len(strings), np.int64)
        of_block[entry] = np.searchsorted(edges, number, side="right") - 1
        order = np.argsort(of_block, kind="stable")
        cuts = np.searchsorted(of_block[order], np.arange(blocks + 1))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        rows: list[tuple] = []
        for b in range(blocks):
            own = order[cuts[b]:cuts[b + 1]].tolist()
            if own:
                rows.append((b, row["slice"], _pressed(b"".join([strings[e] for e in own])),
                             _pressed(np.array([len(strings[e]) for e in own], np.uint8)),
                             _pressed(least[own]), _planes(of_entry[own], 6), None, None))
        # Where each run of a text that may lose something is looked up, as planes of bytes.
        smaller = ids[text] > least[entry]
        order = np.argsort(begin)
        places = np.stack([np.diff(begin[order], prepend=0), count[order], place[entry][order],
                           smaller[order]]).astype("<i4")
        rows.append((None, row["slice"], None, None, None, None, _pressed(
            places.view(np.uint8).reshape(4, -1, 4).transpose(0, 2, 1)), copy.tolist()))
        return pa.Table.from_batches([_record(out_arrow, rows)])

    parts = written(slices.groupBy("slice").cogroup(told.groupBy("slice")).applyInArrow(
        part, out_schema), "suffix-entries")

    mark_schema = "block int, slice long, marks binary"
    mark_arrow = to_arrow_schema(T._parse_datatype_string(mark_schema))

    def matched(key: tuple[pa.Scalar, ...],
                batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        best: list[int] = []
        suffix: list[int] = []  # the sampled suffix of each string
        strings_of: dict[int, int] = {}
        rows = []
        for row in _rows(batches):
            hashes = _from_planes(row["hashes"], 6).tolist()
            joined = _freed(row["strings"])
            ends = np.cumsum(np.frombuffer(_freed(row["lengths"]), np.uint8).astype(np.int64))
            ranks = np.frombuffer(_freed(row["ranks"]), np.int64)
            numbers = np.empty(len(ends), np.int64)
            for k, (a, b, rank, h) in enumerate(zip(
                    [0, *ends.tolist()], ends.tolist(), ranks.tolist(), hashes)):
                s = joined[a:b]
                if (e := known.get(s)) is None:
                    e = known[s] = len(best)
                    best.append(rank)
                    suffix.append(h)
                    strings_of[h] = strings_of.get(h, 0) + 1
                elif rank < best[e]:
                    best[e] = rank
                numbers[k] = e
            rows.append((row["slice"], numbers, ranks))
        marks = np.zeros(len(best), np.uint32)
        family, batch, size = SuffixFamily(window, marks), [], 0
        todo = iter(known.items())
        for _, numbers, _ in rows:  # the strings that each slice was first to bring
            top = int(numbers.max()) + 1
            while size < top:
                s, e = next(todo)
                size += 1
                if strings_of[suffix[e]] == 1:
                    continue  # whoever has one of its windows has all of it
                tail, base = (best[e] + (1 << 63)).to_bytes(8, "big"), e * RUN
                batch += [s[j:j + window] + tail + (base + j).to_bytes(6, "big")
                          for j in range(len(s) - window + 1)]
            if len(batch) >= 4096:
                family.add(batch)
                batch = []
        family.add(batch)
        family.close()
        least = np.array(best, np.int64)
        for slice_, numbers, ranks in rows:
            out = np.where(ranks > least[numbers], np.uint32(0xFFFFFFFF), marks[numbers])
            yield _record(mark_arrow, [(key[0].as_py(), slice_, _pressed(out))])

    marks = written(parts.where("block is not null").select(
        "block", "slice", "strings", "lengths", "ranks", "hashes").groupBy("block").applyInArrow(
        matched, mark_schema), "suffix-marks")

    result_schema = ("doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, "
                     "kept_sha256 string")
    result_arrow = to_arrow_schema(T._parse_datatype_string(result_schema))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {c: left.column(c)[0].as_py() for c in left.column_names}
        told = right.to_pylist()
        looked_up = next(r for r in told if r["block"] is None)
        answers = sorted((r["block"], r["marks"]) for r in told if r["block"] is not None)
        bits = np.concatenate([np.frombuffer(_freed(m), np.uint32) for _, m in answers]) \
            if answers else np.zeros(0, np.uint32)
        planes = np.frombuffer(_freed(looked_up["places"]), np.uint8).reshape(4, 4, -1)
        places = np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<i4")[:, :, 0].T.astype(
            np.int64)
        places[:, 0] = np.cumsum(places[:, 0])
        body = _freed(row["body"])
        ends = np.cumsum(np.array(row["sizes"], np.int64))
        cuts = [0, *np.searchsorted(places[:, 0], ends).tolist()]
        rows = []
        for t, (n, i, copy) in enumerate(zip(row["sizes"], row["ids"], looked_up["whole"])):
            spans, digest = [], row["digests"][t]
            own = places[cuts[t]:cuts[t + 1]]
            if copy:
                spans, digest = [(0, n)], EMPTY
            elif len(own):
                at = int(ends[t]) - n
                data = body[at:at + n]
                mask = np.where(own[:, 3] > 0, 0xFFFFFFFF, bits[own[:, 2]]).astype(np.uint32)
                hit = (mask[:, None] >> np.arange(RUN, dtype=np.uint32)) & 1 > 0
                hit &= np.arange(RUN) < own[:, 1:2]
                begins = (own[:, :1] - at + np.arange(RUN))[hit]
                if len(begins):
                    change = np.zeros(n + 1, np.int64)
                    np.add.at(change, begins, 1)
                    np.add.at(change, begins + window, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    edges = np.nonzero(np.diff(gone, prepend=False, append=False))[0]
                    spans = [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])]
                    digest = hashlib.sha256(np.frombuffer(data, np.uint8)[~gone]).digest()
            rows.append((None if i == NO_ID else i, n,
                         [{"start": a, "stop": b} for a, b in spans], digest.hex()))
        return pa.Table.from_batches([_record(result_arrow, rows)])

    answers = parts.where("block is null").select("slice", "block", "places", "whole") \
        .unionByName(marks, allowMissingColumns=True)
    return slices.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(
        finish, result_schema)
