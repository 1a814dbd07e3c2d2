"""Removal of passages that recur anywhere, found by automata of the recurring phrases."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fareloom.llm.bpe import _Numbers
from fareloom.llm.suffix_dedup import _freed, _hashes, _least, _pressed, _record, _rows
from fareloom.llm.texts import text_of
from fareloom.session import written

#: Texts are read in slices of about so many bytes, and windows looked at in runs of so many.
SLICE_BYTES, RUN_WORDS = 4 << 20, 1 << 20
#: Words of the phrases that windows are put down to, and bits that tell a phrase's place in a run.
PHRASE, PLACE_BITS = 12, 21

_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of a slice's texts, numbered, and the windows of ``window`` words in them."""

    def __init__(self, texts: list[bytes], window: int):
        self.window = window
        numbers = _Numbers()
        self.texts = [t.split() for t in texts]
        self.numbers = [[numbers[w] for w in words] for words in self.texts]
        self.lengths = np.array([len(w) for w in self.texts], np.int64)
        self.ends = np.cumsum(self.lengths)
        both = b"".join(xxhash.xxh3_128_digest(w) for w in numbers)
        halves = np.frombuffer(both, np.uint64).reshape(-1, 2)
        flat = np.fromiter((x for n in self.numbers for x in n), np.int64, int(self.lengths.sum()))
        self.hashes = tuple(np.ascontiguousarray(halves[flat, k]) for k in (0, 1))
        size = len(flat)
        self.digests = tuple(_hashes(h, window) if size >= window else np.zeros(0, np.uint64)
                             for h in self.hashes)
        if size >= window:
            stops = np.repeat(self.ends, self.lengths)[:size - window + 1]
            self.inside = np.arange(len(stops)) + window <= stops
        else:
            self.inside = np.zeros(0, bool)

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of windows put down to one phrase: the first window, their number, and its hash.

        A window is put down to the phrase of least hash in it, the leftmost of several. Equal
        windows are put down to equal phrases, and each place of a phrase has a run of its own.
        """
        width = self.window - PHRASE + 1
        found = []
        for a in range(0, len(self.inside), RUN_WORDS):
            h = _hashes(self.hashes[0][a:a + RUN_WORDS + self.window - 1], PHRASE) * _SPREAD
            place = np.uint64(PLACE_BITS)
            key = _least((h >> place << place) | np.arange(len(h), dtype=np.uint64), width)
            at = np.nonzero(self.inside[a:a + RUN_WORDS])[0]
            key = key[at]
            turn = np.ones(len(at), bool)
            turn[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1)
            first = np.nonzero(turn)[0]
            found.append((at[first] + a, np.diff(np.append(first, len(at))),
                          (key[first] >> place).astype(np.int64)))
        if not found:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        return tuple(np.concatenate(c) for c in zip(*found))

    def passages(self, recurs: np.ndarray) -> set[tuple[int, ...]]:
        """The longest passages all of whose windows recur, each once, as words' numbers."""
        edges = np.nonzero(np.diff(recurs, prepend=False, append=False))[0]
        first, stop = edges[::2], edges[1::2]
        # Windows of two texts may follow on each other without one that spans them.
        text = np.searchsorted(self.ends, first, side="right")
        begins = self.ends - self.lengths
        return {tuple(self.numbers[t][a:b]) for t, a, b in zip(
            text.tolist(), (first - begins[text]).tolist(),
            (stop - begins[text] + self.window - 1).tolist())}


def _signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)


def _distinct(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows, and how often each occurs."""
    order = np.lexsort(columns[::-1])
    ordered = [c[order] for c in columns]
    turn = np.ones(len(order), bool)
    turn[1:] = np.any([c[1:] != c[:-1] for c in ordered], axis=0)
    return [c[turn] for c in ordered], np.diff(np.append(np.nonzero(turn)[0], len(order)))


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The place of each value in ``known``, which ascends; -1 for those not there."""
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return np.where(known[at] == values, at, -1) if len(known) else np.full(len(values), -1)


def recurring_passages(docs: DataFrame, text: str = "text", window: int = 35) -> DataFrame:
    """For each row doc_id, n_words, n_removed, ``spans`` and ``kept_sha256``.

    Words are runs of what is not a space or a control from tab to carriage return. ``spans`` are
    the maximal runs (start, stop) of words that lie in a window of ``window`` words whose sequence
    also starts anywhere else, in the same text or another; the hash is of the words between them,
    joined by spaces. Windows are judged on the text as it is, so that all copies go.

    Every window is put down to a phrase of twelve words in it, chosen by content, about one place
    in twelve. Phrases that occur once leave. Of the others, those whose surroundings are the same
    wherever they occur are confirmed as they are; the windows around the rest are counted one by
    one, by hashes of 128 bits. The longest passages of confirmed windows are then compiled into
    Aho-Corasick automata, one for the passages of each slice of about 4 MB of texts, and every
    text of the slice is streamed through its automaton, which finds all places of all passages,
    word by word. A slice needs no other slice's passages: where a window of another's recurs in
    it, that window belongs to one of its own.

    Counts are summed by Spark for each phrase or window and slice, so that a passage of a third of
    all texts is a row per slice. A missing text has no words; texts with fewer words than a window
    keep all. Rows that repeat an id are texts of their own, a missing id stays missing. An empty
    table gives an empty result; other columns are ignored.
    """
    if window < PHRASE:
        raise ValueError(f"windows have at least {PHRASE} words")
    slice_schema = T._parse_datatype_string("slice long, ids array<long>, sizes array<int>, body binary")
    slice_arrow = to_arrow_schema(slice_schema)

    def slice_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, total = TaskContext.get().partitionId() << 24, [], [], 0

        def full() -> pa.RecordBatch:
            return _record(slice_arrow, [(number, ids, [len(t) for t in texts],
                                          _pressed(b"".join(texts)))])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                ids.append(i)
                texts.append(t.as_py())
                total += len(texts[-1])
                if total >= SLICE_BYTES:
                    yield full()
                    number, ids, texts, total = number + 1, [], [], 0
        if ids:
            yield full()

    def words_of(row: dict) -> Words:
        body, ends = _freed(row["body"]), np.cumsum([0, *row["sizes"]]).tolist()
        return Words([body[a:b] for a, b in zip(ends, ends[1:])], window)

    slices = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(text))
                     .mapInArrow(slice_up, slice_schema), "phrases-slices")

    phrase_schema = "slice long, phrase long, low long, high long, n long"
    phrase_arrow = to_arrow_schema(T._parse_datatype_string(phrase_schema))

    def sample(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            words = words_of(row)
            first, count, phrase = words.phrases()
            # What surrounds a phrase in its windows: the first, the last and their number.
            around = [_signed(d[first] * _SPREAD + d[first + count - 1] + count.astype(np.uint64))
                      for d in words.digests] if len(first) else [phrase, phrase]
            (phrase, low, high), n = _distinct(phrase, *around)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (
                    np.full(len(n), row["slice"]), phrase, low, high, n)], schema=phrase_arrow)

    phrases = written(slices.select("slice", "sizes", "body").mapInArrow(sample, phrase_schema),
                      "phrases-sampled")
    states = phrases.groupBy("phrase").agg(
        F.sum("n").alias("n"),
        ((F.min("low") == F.max("low")) & (F.min("high") == F.max("high"))).alias("alike")
    ).where("n > 1").select("phrase", "alike")
    known = written(phrases.select("slice", "phrase").join(states, "phrase").select(
        "slice", "phrase", "alike"), "phrases-known")

    def places(words: Words, right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The windows of phrases that are alike everywhere, and those of the others."""
        first, count, phrase = words.phrases()
        given = right.column("phrase").to_numpy()
        ordered = np.argsort(given, kind="stable")
        alike = right.column("alike").to_numpy(zero_copy_only=False)[ordered]
        at = _among(phrase, given[ordered])
        state = np.full(len(words.inside), -1)
        state[words.inside] = np.repeat(np.where(at < 0, -1, alike[at] if len(alike) else 0), count)
        return state == 1, state == 0

    window_schema = "slice long, low long, high long, n long"
    window_arrow = to_arrow_schema(T._parse_datatype_string(window_schema))

    def around(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {c: left.column(c)[0].as_py() for c in left.column_names}
        words = words_of(row)
        _, open_ = places(words, right)
        (low, high), n = _distinct(*(_signed(d[open_]) for d in words.digests))
        return pa.table([np.full(len(n), row["slice"], np.int64), low, high, n.astype(np.int64)],
                        schema=window_arrow)

    bodies = slices.select("slice", "sizes", "body").groupBy("slice")
    windows = written(bodies.cogroup(known.groupBy("slice")).applyInArrow(around, window_schema),
                      "phrases-windows")
    often = windows.groupBy("low", "high").agg(F.sum("n").alias("n")).where("n > 1")
    told = known.select("slice", "phrase", "alike", F.lit(None).cast("long").alias("low"),
                        F.lit(None).cast("long").alias("high")).unionByName(
        windows.select("slice", "low", "high").join(often.select("low", "high"), ["low", "high"])
        .select("slice", F.lit(None).cast("long").alias("phrase"),
                F.lit(None).cast("boolean").alias("alike"), "low", "high"))

    result_schema = ("doc_id long, n_words long, n_removed long, "
                     "spans array<struct<start:long,stop:long>>, kept_sha256 string")
    result_arrow = to_arrow_schema(T._parse_datatype_string(result_schema))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {c: left.column(c)[0].as_py() for c in left.column_names}
        words = words_of(row)
        counted = pc.is_valid(right.column("low"))
        recurs, open_ = places(words, right.filter(pc.invert(counted)))
        given = right.filter(counted)
        low, high = (given.column(c).to_numpy() for c in ("low", "high"))
        order = np.argsort(low, kind="stable")
        # Hashes of which the lower halves are equal are too rare to matter for speed.
        pairs = set(zip(low.tolist(), high.tolist()))
        at = np.nonzero(open_)[0]
        at = at[_among(_signed(words.digests[0][at]), low[order]) >= 0]
        both = zip(*(_signed(d[at]).tolist() for d in words.digests))
        recurs[at] = np.fromiter((p in pairs for p in both), bool, len(at))
        rows = [(i, len(w), sum(b - a for a, b in spans),
                 [{"start": a, "stop": b} for a, b in spans], _without(w, spans))
                for i, w, spans in zip(row["ids"], words.texts, located(
                    words.numbers, words.passages(recurs)))]
        return pa.Table.from_batches([_record(result_arrow, rows)])

    return slices.groupBy("slice").cogroup(told.groupBy("slice")).applyInArrow(
        finish, result_schema)


def located(texts: Iterable[list[int]],
            passages: set[tuple[int, ...]]) -> Iterator[list[tuple[int, int]]]:
    """For each text the maximal runs of words that some occurrence of a passage covers."""
    import ahocorasick

    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
    for passage in passages:
        automaton.add_word(passage)
    automaton.make_automaton()
    for text in texts:
        spans: list[tuple[int, int]] = []
        for last, length in automaton.iter(tuple(text)) if passages else ():
            start = last + 1 - length
            while spans and spans[-1][1] >= start:
                start = min(start, spans.pop()[0])
            spans.append((start, last + 1))
        yield spans


def _without(words: list[bytes], spans: list[tuple[int, int]]) -> str:
    kept, at = [], 0
    for start, stop in spans:
        kept += words[at:start]
        at = stop
    return hashlib.sha256(b" ".join(kept + words[at:])).hexdigest()
