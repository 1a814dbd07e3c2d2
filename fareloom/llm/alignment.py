"""Alignment of two tokenizers by galloping intersection of their token ends."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fareloom.llm.bpe import byte_alphabet
from fareloom.llm.texts import text_of
from fareloom.session import written

#: Texts are aligned in slices of about so many bytes, which bounds memory.
SLICE_BYTES = 8 << 20

#: Signs whose kind no Unicode version has changed since these letters were added.
PLAIN = re.compile("[\\t\\n\\r -~\\u00a1-\\u024f]*")


def gallop(values: np.ndarray, targets: np.ndarray, begins: np.ndarray,
           stops: np.ndarray) -> np.ndarray:
    """For each target the first index from its begin on whose value is at least the target, or its
    stop: steps that double until they pass it, then a binary search in the last step.

    All targets take their steps together; those that have arrived leave.
    """
    low, high = begins.copy(), begins.copy()
    left, step = np.nonzero(begins < stops)[0], 1
    while len(left):
        left = left[values[high[left]] < targets[left]]
        low[left] = high[left] + 1
        high[left] = np.minimum(high[left] + step, stops[left])
        left, step = left[high[left] < stops[left]], step * 2
    left = np.nonzero(low < high)[0]
    while len(left):
        middle = (low[left] + high[left]) // 2
        less = values[middle] < targets[left]
        low[left[less]] = middle[less] + 1
        high[left[~less]] = middle[~less]
        left = left[low[left] < high[left]]
    return low


class Overlaps:
    """Which tokens of A and B overlap, for many stretches of text at once.

    ``ends_a`` and ``ends_b`` are the places at which tokens end, ascending over all stretches, of
    which each stretch has so many; the last of a stretch is the same in both. In each stretch the
    shorter list gallops through the longer. The ranks that its ends get there say which tokens
    each of its own overlaps: from the first that ends behind its begin to the first that ends at
    its end or later.
    """

    def __init__(self, ends_a: np.ndarray, counts_a: np.ndarray, ends_b: np.ndarray,
                 counts_b: np.ndarray):
        first_a, first_b = (np.cumsum(c) - c for c in (counts_a, counts_b))
        swap = counts_a > counts_b
        values = np.concatenate([ends_a, ends_b])
        short = np.where(swap, counts_b, counts_a)
        stretch = np.repeat(np.arange(len(short)), short)
        begins = np.where(swap, first_a, first_b + len(ends_a))
        stops = begins + np.where(swap, counts_a, counts_b)
        inner = np.arange(len(stretch)) - np.repeat(np.cumsum(short) - short, short)
        own = inner + np.where(swap, first_b + len(ends_a), first_a)[stretch]
        ranks = gallop(values, values[own], begins[stretch], stops[stretch])
        common = values[ranks] == values[own]
        low = np.where(inner == 0, begins[stretch], np.append(0, (ranks + common)[:-1])[:len(ranks)])
        times = ranks - low + 1
        there = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(
            np.cumsum(times) - times, times)
        here, turned = np.repeat(own, times), np.repeat(swap[stretch], times)
        #: The tokens of each link, and the links of each stretch.
        self.a = np.where(turned, there, here)
        self.b = np.where(turned, here, there) - len(ends_a)
        self.links = np.bincount(stretch, times, len(short)).astype(np.int64)
        #: Whether a group ends with a token, and the groups of each stretch.
        ends = np.zeros(len(values), bool)
        ends[own[common]] = ends[ranks[common]] = True
        self.ends_a, self.ends_b = ends[:len(ends_a)], ends[len(ends_a):]
        self.groups = np.bincount(stretch[common], minlength=len(short))


class Tokenizers:
    """The two tokenizers and the bytes of their entries."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = {s: b for b, s in byte_alphabet().items()}
        self.bytes_a = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for entry, i in self.a.get_vocab(with_added_tokens=True).items():
            self.bytes_a[i] = (bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry)
                               else entry.encode())
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else
                        p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        #: Whether both always end before a space that follows another sign: A's pattern lets a
        #: space only begin a part, and no piece of B has a space behind another sign.
        self.cuts = (
            type(self.a.pre_tokenizer) is ByteLevel and self.a.pre_tokenizer.use_regex
            and not self.a.pre_tokenizer.add_prefix_space and self.a.normalizer is None
            and not any("▁" in p.lstrip("▁") for p in pieces))

        self.sizes_a, self.sizes_b = (np.array([len(e) for e in entries], np.int64)
                                      for entries in (self.bytes_a, self.bytes_b))
        self.ranked = self._ranked(path_a) if self.cuts else None
        #: How ids are written inside and at the end of their part of a group.
        self.signs = [f"{i}{sign}" for n, last in ((len(self.bytes_a), "|"), (len(pieces), ";"))
                      for i in range(n) for sign in (",", last)]

    def _ranked(self, path: str):
        """The same vocabulary as tiktoken has it, by ranks, where ids ascend as merges do."""
        import public_tokenizers
        import tiktoken

        model = json.loads(open(path, encoding="utf-8").read())["model"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"]["".join(m)] for m in merges]
        entries = self.bytes_a[:len(model["vocab"])]
        if made != list(range(256, 256 + len(made))) or any(len(e) != 1 for e in entries[:256]):
            return None
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                 mergeable_ranks={e: i for i, e in enumerate(entries[:256 + len(made)])})

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A for a space and each text, and their numbers; ids of B for each text, to which
        B adds the space, and their numbers.

        Texts that end before a cut, and have plain signs only, are one long text for A.
        """
        joined = [self.ranked is not None and t != "" and not t[-1].isspace()
                  and PLAIN.fullmatch(t) is not None for t in texts]
        plain = [" " + t for t, j in zip(texts, joined) if j]
        ids = np.array(self.ranked.encode_ordinary("".join(plain)) if plain else (), np.int64)
        ends = np.searchsorted(np.cumsum(self.sizes_a[ids]), np.cumsum(
            np.fromiter((len(t.encode()) for t in plain), np.int64, len(plain))), side="right")
        counts = np.zeros(len(texts), np.int64)
        counts[joined] = np.diff(ends, prepend=0)
        odd = [k for k, j in enumerate(joined) if not j]
        others = [e.ids for e in self.a.encode_batch_fast(
            [" " + texts[k] for k in odd], add_special_tokens=False)]
        counts[odd] = [len(x) for x in others]
        flat = np.empty(int(counts.sum()), np.int64)
        of_joined = np.repeat(np.array(joined, bool), counts)
        flat[of_joined] = ids
        flat[~of_joined] = _flat(others)
        pieces = self.b.encode(texts, num_threads=1)
        return flat, counts, _flat(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))


class Stretches(dict):
    """Numbers the stretches of texts, between which both tokenizers always have a common end.

    A stretch is what lies between two spaces, with further spaces and whatever white space there
    is before it, so that it can be aligned without its neighbours, and once for all its
    occurrences. As keys, words that need what follows them have the number -1.
    """

    def __init__(self, cuts: bool):
        super().__init__()
        self.cuts, self.texts, self.joined = cuts, [], {}

    def __missing__(self, word: str) -> int:
        number = -1
        if word and not word[-1].isspace():
            number = len(self.texts)
            self.texts.append(word)
        self[word] = number
        return number

    def _whole(self, text: str) -> int:
        number = self.joined.get(text)
        if number is None:
            number = self.joined[text] = len(self.texts)
            self.texts.append(text)
        return number

    def numbers(self, text: str) -> list[int]:
        if not self.cuts:
            return [self._whole(text)]
        words = text.split(" ")
        numbers = list(map(self.__getitem__, words))
        if min(numbers) >= 0:
            return numbers
        out: list[int] = []
        parts: list[str] = []
        for word, number in zip(words, numbers):
            if number < 0:
                parts.append(word)
            elif parts:
                out.append(self._whole(" ".join([*parts, word])))
                parts = []
            else:
                out.append(number)
        if parts:  # white space at the end belongs to the stretch before
            before = [self.texts[out.pop()]] if out else []
            out.append(self._whole(" ".join([*before, *parts])))
        return out


class Aligned:
    """Stretches encoded by both tokenizers and aligned; none of a stretch whose tokens don't spell
    it."""

    def __init__(self, both: Tokenizers, stretches: list[str]):
        parts = [both.encode(stretches[k:k + 16384]) for k in range(0, len(stretches), 16384)]
        ids_a, counts_a, ids_b, counts_b = (
            np.concatenate([np.zeros(0, np.int64), *c]) for c in (zip(*parts) if parts else [()] * 4))
        bodies = [(" " + s).encode() for s in stretches]
        good = (_spelled(ids_a, counts_a, both.bytes_a, both.sizes_a, bodies)
                & _spelled(ids_b, counts_b, both.bytes_b, both.sizes_b, bodies))
        self.counts_a, self.counts_b = (np.where(good, c, 0) for c in (counts_a, counts_b))
        self.a, self.b = (ids[np.repeat(good, c)] for ids, c in (
            (ids_a, counts_a), (ids_b, counts_b)))
        ends = np.cumsum(both.sizes_a[self.a]), np.cumsum(both.sizes_b[self.b])
        found = Overlaps(ends[0], self.counts_a, ends[1], self.counts_b)
        self.groups, self.links = found.groups, found.links
        #: A's id times 2**32 plus B's, of all links in the order of stretches.
        self.pairs = self.a[found.a] << 32 | self.b[found.b]
        self.spelled = self._spell(found, both)

    def _spell(self, found: Overlaps, both: Tokenizers) -> list[str]:
        """The groups of each stretch, ids of A before those of B."""
        written_a = np.nonzero(found.ends_a)[0] + 1
        written_b = np.append(0, np.nonzero(found.ends_b)[0] + 1)
        group_a = np.cumsum(found.ends_a) - found.ends_a
        group_b = np.cumsum(found.ends_b) - found.ends_b
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        codes[np.arange(len(self.a)) + written_b[group_a]] = 2 * self.a + found.ends_a
        codes[np.arange(len(self.b)) + written_a[group_b]] = (
            2 * (len(both.bytes_a) + self.b) + found.ends_b)
        parts = list(map(both.signs.__getitem__, codes.tolist()))
        stops = np.cumsum(self.counts_a + self.counts_b).tolist()
        return ["".join(parts[x:y])[:-1] for x, y in zip([0, *stops], stops)]


def _spelled(ids: np.ndarray, counts: np.ndarray, entries: list[bytes], sizes: np.ndarray,
             bodies: list[bytes]) -> np.ndarray:
    """Whether the bytes of each stretch's tokens are the stretch."""
    lengths = np.fromiter(map(len, bodies), np.int64, len(bodies))
    tokens = list(map(entries.__getitem__, ids.tolist()))
    good = _sums(sizes[ids], counts) == lengths
    if good.all() and b"".join(tokens) == b"".join(bodies):
        return good
    stops = np.cumsum(counts).tolist()
    return np.fromiter((b"".join(tokens[x:y]) == body for x, y, body in zip(
        [0, *stops], stops, bodies)), bool, len(bodies))


def _flat(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.int64, sum(map(len, lists)))


def _pressed(values: np.ndarray) -> bytes:
    data = np.ascontiguousarray(values).tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _freed(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(
        data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), kind)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of ``values``; runs may be empty."""
    total = np.append(0, np.cumsum(values))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """For each row doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    ``path_a`` is a byte-level BPE file of the tokenizers library, applied to a space and the text;
    ``path_b`` is a sentencepiece model, which adds that space itself. Byte offsets at which tokens
    of both end cut them into groups; tokens whose byte ranges overlap are linked. A pair of ids
    counts as often as it is linked in all texts; ``count_sum`` adds the counts of a text's links,
    ``n_best`` is the number of those whose count is the highest of their id of B.
    ``groups_sha256`` is of ``a1,a2|b1;a3|b2,b3``: the ids of A and B of the groups in order.

    Each text is cut before spaces, where both tokenizers always end, and a stretch that occurs
    again in a slice of texts is aligned once. The shorter list of ends gallops through the longer.
    Each slice sends a row per pair of ids that it links, and gets its count back; texts are read once.

    A text that is missing or empty, or whose tokens don't spell it, has no tokens: zeros, and ''
    for the hash. Rows that repeat an id are texts of their own. A missing id stays missing. An
    empty table gives an empty result; other columns are ignored.
    """
    schema = T._parse_datatype_string(
        "slice long, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, "
        "n_links array<long>, groups array<string>, counts array<int>, stretches binary, "
        "link_counts binary, links binary, pairs binary, times binary")
    target = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Tokenizers(path_a, path_b)
        base, ids, texts, total = TaskContext.get().partitionId() << 24, [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(i)
                texts.append(t.as_py())
                total += len(texts[-1])
                if total >= SLICE_BYTES:
                    yield _slice(both, base, ids, texts, target)
                    base, ids, texts, total = base + 1, [], [], 0
        if ids:
            yield _slice(both, base, ids, texts, target)

    slices = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(text))
                     .mapInArrow(run, schema), "alignment-slices")

    pair_schema = "slice long, a int, b int, n long"
    pair_target = to_arrow_schema(T._parse_datatype_string(pair_schema))

    def unfold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                pairs = _freed(batch.column(1)[k].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(pairs), batch.column(0)[k].as_py(), np.int64)),
                    pa.array((pairs >> 32).astype(np.int32)), pa.array(pairs.astype(np.int32)),
                    pa.array(_freed(batch.column(2)[k].as_py(), np.int64))], schema=pair_target)

    linked = slices.select("slice", "pairs", "times").mapInArrow(unfold, pair_schema)
    totals = written(linked.groupBy("a", "b").agg(F.sum("n").alias("total")), "alignment-pairs")
    highest = written(totals.groupBy("b").agg(F.max("total").alias("highest")), "alignment-best")
    known = totals.join(highest, "b").select(
        "a", "b", "total", (F.col("total") == F.col("highest")).alias("best"))
    back = linked.select("slice", "a", "b").join(known, ["a", "b"])

    out_schema = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
                  "count_sum long, groups_sha256 string")
    out_target = to_arrow_schema(T._parse_datatype_string(out_schema))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {c: left.column(c)[0].as_py() for c in left.column_names}
        pairs = _freed(row["pairs"], np.int64)
        a, b = (right.column(c).to_numpy().astype(np.int64) for c in ("a", "b"))
        order = np.argsort(a << 32 | b, kind="stable")
        total = right.column("total").to_numpy()[order]
        best = right.column("best").to_numpy(zero_copy_only=False)[order]
        assert len(order) == len(pairs)
        links = _freed(row["links"], np.int32)
        per = _freed(row["link_counts"], np.int32)
        at = _freed(row["stretches"], np.int32)
        counts = np.array(row["counts"], np.int64)
        return pa.table([
            row["ids"], row["n_a"], row["n_b"], row["n_groups"], row["n_links"],
            _sums(_sums(best[links].astype(np.int64), per)[at], counts),
            _sums(_sums(total[links], per)[at], counts), row["groups"]], schema=out_target)

    return slices.select(
        "slice", "ids", "n_a", "n_b", "n_groups", "n_links", "groups", "counts", "stretches",
        "link_counts", "links", "pairs").groupBy("slice").cogroup(
        back.groupBy("slice")).applyInArrow(finish, out_schema)


def _slice(both: Tokenizers, number: int, ids: list, texts: list[str],
           target: pa.Schema) -> pa.RecordBatch:
    """One row for all texts of a slice, with each pair of ids that they link."""
    stretches = Stretches(both.cuts)
    found = [stretches.numbers(t) if t else [] for t in texts]
    counts, flat = np.fromiter(map(len, found), np.int64, len(found)), _flat(found)
    aligned = Aligned(both, stretches.texts)
    # A text with a stretch that its tokens don't spell has none.
    text = np.repeat(np.arange(len(found)), counts)
    wrong = np.bincount(text[aligned.counts_a[flat] == 0], minlength=len(found)) > 0
    flat, counts = flat[~wrong[text]], np.where(wrong, 0, counts)
    per_text = [_sums(column[flat], counts) for column in (
        aligned.counts_a, aligned.counts_b, aligned.groups, aligned.links)]
    digests, at, stops = [], flat.tolist(), np.cumsum(counts).tolist()
    for a, b in zip([0, *stops], stops):
        spelled = ";".join(map(aligned.spelled.__getitem__, at[a:b]))
        digests.append(hashlib.sha256(spelled.encode()).hexdigest() if b > a else "")
    # Stretches of texts that have no tokens link nothing.
    often = np.repeat(np.bincount(flat, minlength=len(stretches.texts)), aligned.links)
    pairs, link = np.unique(aligned.pairs, return_inverse=True)
    times = np.zeros(len(pairs), np.int64)
    np.add.at(times, link, often)
    row = [number, ids, *(p.tolist() for p in per_text), digests, counts.tolist(),
           _pressed(flat.astype(np.int32)), _pressed(aligned.links.astype(np.int32)),
           _pressed(link.astype(np.int32)), _pressed(pairs), _pressed(times)]
    return pa.RecordBatch.from_arrays(
        [pa.array([v], f.type) for v, f in zip(row, target)], schema=target)
