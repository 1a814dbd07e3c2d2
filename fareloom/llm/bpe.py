"""Byte-pair encoding with an index from each pair to all its positions in a partition."""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from fareloom.llm.texts import text_of

#: Text is encoded in slices of about so many bytes, words in groups of so many, and so many
#: words are remembered; all three only bound memory.
SLICE_BYTES, WORD_GROUP, REMEMBERED = 1 << 19, 8_000, 200_000


#: Signs that runs of Latin letters don't have; other signs go through the library.
ODD = re.compile(r"[^!-~\u00a1-\u024f]")


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte: itself if visible in Latin-1, else the next free sign
    from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class PairIndexEncoder:
    """Encodes many words at once under the merges of a tokenizer file.

    For a group of words, every pair of neighbouring symbols that has a rank is indexed with all
    its positions. Ranks are then applied in ascending order, each to all its positions from left
    to right, and only the lists of pairs beside a merged position are updated.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        if model["type"] != "BPE" or model.get("unk_token") or model.get("byte_fallback"):
            raise ValueError("a BPE file without an unknown token or byte fallback is needed")
        added = spec["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or
               re.search(r"\s", t["content"]) for t in added):
            raise ValueError("added tokens must match exactly and hold no white space")
        own = Tokenizer.from_file(path)
        self.normalize, self.split = own.normalizer.normalize_str, own.pre_tokenizer.pre_tokenize_str
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()} | {t["id"]: t["content"] for t in added}
        self.added = {t["content"]: t["id"] for t in added}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) \
            if added else None
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks: dict[int, tuple[int, int]] = {
            self.vocab[a] << 32 | self.vocab[b]: (rank, self.vocab[a + b])
            for rank, (a, b) in enumerate(pairs)}
        signs = byte_alphabet()
        self.inner = [self.vocab[signs[b]] for b in range(256)]
        self.final = [self.vocab[signs[b] + self.suffix] for b in range(256)]
        self.back = {sign: b for b, sign in signs.items()}
        pattern = next(s["pattern"]["Regex"] for s in spec["pre_tokenizer"]["pretokenizers"]
                       if s["type"] == "Split")
        self.plain = regex.compile(pattern)
        self.known: dict[bytes, list[int]] = {}

    def pre_tokens(self, words: list[bytes]) -> list[list[bytes | int]]:
        """What the file's normaliser and splitter make of runs without ASCII white space.

        An added token comes as its id. Runs of plain Latin letters and signs are normalised
        together, with spaces between, and split by the file's pattern; all others go one by one
        through the library.
        """
        texts = [w.decode("utf-8", "replace") for w in words]
        latin = [k for k, t in enumerate(texts) if not ODD.search(t) and not (
            self.cut and self.cut.search(t))]
        lowered = self.normalize(" ".join([texts[k] for k in latin])).split(" ")
        out: list[list[bytes | int]] = [[]] * len(words)
        for k, t in zip(latin, lowered, strict=True):
            out[k] = [t.encode()] if t.isalpha() else [m.encode() for m in self.plain.findall(t)]
        for k in sorted(set(range(len(words))).difference(latin)):
            out[k], at = [], 0
            t = texts[k]
            for m in self.cut.finditer(t) if self.cut else ():
                out[k] += [*self._library(t[at:m.start()]), self.added[m[0]]]
                at = m.end()
            out[k] += self._library(t[at:])
        return out

    def _library(self, text: str) -> list[bytes]:
        return [bytes([self.back[c] for c in p]) for p, _ in self.split(self.normalize(text))]

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each pre-token, by the pair index over all of them."""
        symbols, starts, before, after = [], [], [], []
        inner, final = self.inner, self.final
        for piece in pieces:
            starts.append(at := len(symbols))
            symbols += [inner[b] for b in piece]
            symbols[-1] = final[piece[-1]]
            before.append(-1)
            before += range(at, len(symbols) - 1)
            after += range(at + 1, len(symbols))
            after.append(-1)
        starts.append(len(symbols))

        ranks = self.ranks
        index: dict[int, list[int]] = {}
        flat = np.array(symbols, np.int64)
        codes = (flat[:-1] << 32) | flat[1:]
        where = np.nonzero(np.array(after[:-1], np.int64) >= 0)[0]
        order = where[np.argsort(codes[where], kind="stable")]
        edges = np.nonzero(np.diff(codes[order], prepend=-1))[0]
        for code, positions in zip(codes[order][edges].tolist(), np.split(order, edges[1:])):
            if code in ranks:
                index[code] = positions.tolist()
        active = [(ranks[code][0], code) for code in index]
        heapq.heapify(active)
        while active:
            _, code = heapq.heappop(active)
            positions = index.pop(code, None)
            if positions is None:
                continue
            left, right = code >> 32, code & 0xFFFFFFFF
            merged = ranks[code][1]
            positions.sort()
            for p in positions:
                q = after[p]
                if q < 0 or symbols[p] != left or symbols[q] != right:
                    continue  # a merge to its left took one of the two
                symbols[p], symbols[q] = merged, -1
                r, o = after[q], before[p]
                after[p], after[q] = r, -1
                if r >= 0:
                    before[r] = p
                    new = merged << 32 | symbols[r]
                    if new in ranks:
                        if new in index:
                            index[new].append(p)
                        else:
                            index[new] = [p]
                            heapq.heappush(active, (ranks[new][0], new))
                if o >= 0:
                    new = symbols[o] << 32 | merged
                    if new in ranks:
                        if new in index:
                            index[new].append(o)
                        else:
                            index[new] = [o]
                            heapq.heappush(active, (ranks[new][0], new))
        return [[s for s in symbols[a:b] if s >= 0] for a, b in zip(starts, starts[1:])]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        split = self.pre_tokens(words)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list({p for row in split for p in row if isinstance(p, bytes)} - self.known.keys())
        self.known.update(zip(new, self.encode_pieces(new)))
        return [self.known[row[0]] if len(row) == 1 and isinstance(row[0], bytes) else
                [i for p in row for i in ([p] if isinstance(p, int) else self.known[p])]
                for row in split]


# Fixed value: the splitting pattern of files of the kind that ``fold`` knows.
FOLDING = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BOUNDARY = re.compile(rb"(?<=[a-z])(?=[!-/:-@\[-`{-~])")


def fold(data: bytes) -> bytes:
    """Fewer distinct runs with the same tokens, for files that lower-case and split words from
    signs: A-Z lower-cased, and a space where signs follow a letter.

    Not where an added token may be, nor a mark that could combine with the small letter only.
    """
    if b"<|" in data or b"\xcc" in data or b"\xcd" in data:
        return data
    return _BOUNDARY.sub(b" ", data.lower())


def preparation(path: str) -> Callable[[bytes], bytes]:
    spec = json.loads(open(path, encoding="utf-8").read())
    kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    patterns = [s["pattern"]["Regex"] for s in spec["pre_tokenizer"].get("pretokenizers", [])
                if s["type"] == "Split"]
    folds = kinds == ["NFC", "Replace", "Lowercase"] and patterns == [FOLDING] and all(
        t["content"].startswith("<|") for t in spec["added_tokens"])
    return fold if folds else bytes


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class WordEncoder:
    """Encodes texts by encoding each distinct run without white space once.

    White space never reaches a token here, so a text's ids are those of its runs in order.
    ``encode_words`` gives the ids of a list of new words; ``prepare`` may rewrite a text into one
    with the same tokens.
    """

    def __init__(self, encode_words: Callable[[list[bytes]], list[list[int]]],
                 prepare: Callable[[bytes], bytes] = bytes):
        self.encode_words, self.prepare = encode_words, prepare
        self.forget()

    def forget(self) -> None:
        self.numbers = _Numbers()
        self.flat, self.ends = array("i"), array("q", [0])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts on end, and the position behind each text's last."""
        if len(self.numbers) > REMEMBERED:
            self.forget()
        known = len(self.numbers)
        number = self.numbers.__getitem__
        rows = [np.array([number(w) for w in self.prepare(t).split()], np.int32) for t in texts]
        new = list(self.numbers)[known:] if len(self.numbers) > known else []
        for k in range(0, len(new), WORD_GROUP):
            for ids in self.encode_words(new[k:k + WORD_GROUP]):
                self.flat.extend(ids)
                self.ends.append(len(self.flat))
        flat, ends = np.array(self.flat, np.int32), np.array(self.ends, np.int64)
        words = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        lengths = (ends[1:] - ends[:-1])[words]
        upto = np.cumsum(lengths)
        first = np.repeat(ends[words] - (upto - lengths), lengths)
        ids = flat[first + np.arange(len(first))]
        counts = np.cumsum([len(r) for r in rows]) if rows else np.zeros(0, np.int64)
        return ids, np.concatenate([[0], upto])[counts]


def binary(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def slices(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """The texts in ranges of about ``SLICE_BYTES``: where each begins, and its texts."""
    upto = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(column):
        before = upto[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, before + SLICE_BYTES, side="right")))
        yield start, binary(column.slice(start, stop - start))
        start = stop


_ENCODERS: dict[tuple[str, str], WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """One for each worker process and file."""
    if ("pairs", path) not in _ENCODERS:
        _ENCODERS["pairs", path] = WordEncoder(
            PairIndexEncoder(path).encode_words, preparation(path))
    return _ENCODERS["pairs", path]


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id and ``ids``, the tokens of each row's whole text under the tokenizer file ``path``.

    No special tokens are added, but their strings in a text are tokens, as the file says. ``path``
    must hold the file on every executor. A missing or empty text, or one of white space alone,
    has no ids. Repeated rows are encoded each; an empty table gives an empty result; other
    columns are ignored.
    """
    wanted = docs.select("doc_id", text_of(text).alias("text"))
    schema = T.StructType([wanted.schema["doc_id"],
                           T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        for batch in batches:
            for a, texts in slices(batch.column(1)):
                ids, ends = encoder.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, len(texts)), pa.ListArray.from_arrays(
                        pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids))],
                    names=["doc_id", "ids"])

    return wanted.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ``ids`` and ``text``: the tokens' strings, special ones too, with spaces between.

    The files that ``encode`` takes name no decoder, and then this is what decoding is. Missing
    ids give an empty text; an id that the vocabulary lacks is left out.
    """
    wanted = encoded.select("doc_id", F.coalesce(
        "ids", F.array().cast("array<int>")).alias("ids"))
    schema = T.StructType([*wanted.schema.fields, T.StructField("text", T.StringType(), False)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec = json.loads(open(path, encoding="utf-8").read())
        if spec.get("decoder"):
            raise ValueError("a file without a decoder is needed")
        names = {i: t for t, i in spec["model"]["vocab"].items()} | {
            t["id"]: t["content"] for t in spec["added_tokens"]}
        table = np.array([names.get(i) for i in range(max(names) + 1)], dtype=object)
        for batch in batches:
            lists = batch.column(1)
            step = max(1, int(len(batch) * SLICE_BYTES / max(1, 4 * len(lists.flatten()))))
            for a in range(0, len(batch), step):
                part = lists.slice(a, step)
                ids = part.flatten().to_numpy()
                tokens = table[ids] if not len(ids) or ids.max() < len(table) else np.array(
                    [names.get(i) for i in ids.tolist()], dtype=object)
                tokens = tokens.tolist()
                ends = np.cumsum(part.value_lengths().to_numpy(zero_copy_only=False)).tolist()
                texts = [" ".join([t for t in tokens[x:y] if t is not None])
                         for x, y in zip([0, *ends], ends)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, step), part, pa.array(texts, pa.string())],
                    names=["doc_id", "ids", "text"])

    return wanted.mapInArrow(run, schema)
