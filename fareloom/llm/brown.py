"""Scoring by a class-based bigram model whose classes come from exchange clustering."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fareloom.llm.bpe import _Numbers, binary
from fareloom.llm.texts import text_of
from fareloom.session import written

#: Texts are encoded in slices of about so many bytes, each with a vocabulary of its own.
SLICE_BYTES = 8 << 20
#: The token behind each text; no word is empty.
END = b""
#: Classes that exchange forms; behind them come the class of END, that of unknown words, and that
#: of words which never stand beside a frequent one.
CLASSES = 64
END_CLASS, UNKNOWN, APART = CLASSES, CLASSES + 1, CLASSES + 2
ALL = CLASSES + 3
#: What each class's transitions are smoothed by, in tokens.
PRIOR = 50.0


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text is divisible by 10; not so for a missing id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 10 == 0, F.lit(False))


def _squeeze(values: np.ndarray) -> bytes:
    """Small numbers take little room: four planes of bytes, compressed."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return np.uint32(len(values)).tobytes() + pa.compress(
        pa.py_buffer(planes), codec="zstd", asbytes=True)


def _unsqueeze(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data[:4], "<u4")[0])
    planes = np.frombuffer(pa.decompress(data[4:], 4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()


def _slices(docs: DataFrame, text: str) -> DataFrame:
    """A row for each slice: its words, most frequent first, and its texts as numbers of them."""
    ids = docs.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("slice", T.LongType(), False),
        T.StructField("doc_ids", T.ArrayType(ids), False),
        T.StructField("held", T.ArrayType(T.BooleanType()), False),
        *(T.StructField(n, T.BinaryType(), False) for n in ("sizes", "words", "counts", "codes"))])

    def rows(held: list[bool], sizes: list[int], numbers: _Numbers, codes: list[np.ndarray]):
        all_codes = np.concatenate(codes)
        train = np.repeat(~np.array(held), sizes)
        n = np.bincount(all_codes[train], minlength=len(numbers))
        order = np.argsort(-n, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        words = list(numbers)
        return (_squeeze(np.array(sizes)), b"\n".join([words[i] for i in order.tolist()]),
                _squeeze(n[order]), _squeeze(place[all_codes]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 24
        numbers, doc_ids, held, sizes, codes, total = _Numbers(), [], [], [], [], 0

        def full() -> pa.RecordBatch:
            blobs = rows(held, sizes, numbers, codes)
            return pa.RecordBatch.from_arrays(
                [pa.array([base], pa.int64()),
                 pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()),
                                          pa.concat_arrays(doc_ids)),
                 pa.array([held], pa.list_(pa.bool_())),
                 *(pa.array([b], pa.binary()) for b in blobs)],
                names=[f.name for f in schema.fields])

        for batch in batches:
            flags = batch.column(1).to_pylist()
            for k, data in enumerate(binary(batch.column(2))):
                tokens = [*data.lower().split(), END]
                codes.append(np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens)))
                doc_ids.append(batch.column(0).slice(k, 1))
                held.append(flags[k])
                sizes.append(len(tokens))
                total += len(data)
                if total >= SLICE_BYTES:
                    yield full()
                    base += 1
                    numbers, doc_ids, held, sizes, codes, total = _Numbers(), [], [], [], [], 0
        if held:
            yield full()

    return docs.select("doc_id", held_out().alias("held"), text_of(text).alias("text")
                       ).mapInArrow(run, schema)


def _train_pairs(row: dict, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of neighbours in the training texts; a text's first token follows an END (-1)."""
    sizes = _unsqueeze(row["sizes"]).astype(np.int64)
    before = np.empty(len(codes), np.int64)
    before[1:] = codes[:-1]
    before[np.cumsum(sizes) - sizes] = -1
    train = np.repeat(~np.array(row["held"], bool), sizes)
    return before[train], codes[train]


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(codes, return_counts=True)


def _each(frame: DataFrame, schema: T.StructType | str, make, columns: list[str]) -> DataFrame:
    """``make`` gives columns of rows for each row of ``frame``, one row in memory at a time."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(schema)
        for batch in batches:
            for k in range(len(batch)):
                made = make({c: batch.column(c)[k].as_py() for c in batch.schema.names})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(made[f.name], f.type) for f in target], schema=target)

    return frame.select(*columns).mapInArrow(run, schema)


def exchange(pairs: np.ndarray, counts: np.ndarray, words: int, classes: int,
             rounds: int = 6) -> np.ndarray:
    """Classes of the frequent words by the exchange algorithm.

    ``pairs`` are (left, right) numbers of neighbouring words, ``counts`` how often. Word by word
    moves to the class that raises the likelihood of the class bigrams most, until a round moves
    none. Words start in classes by turns of frequency.
    """

    def f(x):
        return x * np.log(np.maximum(x, 1.0))

    classes = max(1, min(classes, words))
    of = np.arange(words) % classes
    by_left = np.argsort(pairs[:, 0], kind="stable")
    by_right = np.argsort(pairs[:, 1], kind="stable")
    left_at = np.searchsorted(pairs[by_left, 0], np.arange(words + 1))
    right_at = np.searchsorted(pairs[by_right, 1], np.arange(words + 1))
    table = np.zeros((classes, classes))
    np.add.at(table, (of[pairs[:, 0]], of[pairs[:, 1]]), counts)
    for _ in range(rounds):
        moved = 0
        for w in range(words):
            after = by_left[left_at[w]:left_at[w + 1]]
            ahead = by_right[right_at[w]:right_at[w + 1]]
            own = pairs[after, 1] == w
            self_pairs = counts[after][own].sum()
            out = np.bincount(of[pairs[after[~own], 1]], counts[after][~own], classes)
            own = pairs[ahead, 0] == w
            into = np.bincount(of[pairs[ahead[~own], 0]], counts[ahead][~own], classes)
            old = of[w]
            table[old, :] -= out
            table[:, old] -= into
            table[old, old] -= self_pairs
            # Whatever its class, the word adds to the rows before it and the columns behind.
            rows, columns = table.sum(axis=1) + into, table.sum(axis=0) + out
            gain = (f(table + out[None, :]) - f(table)).sum(axis=1)
            gain += (f(table + into[:, None]) - f(table)).sum(axis=0)
            diagonal = np.diagonal(table)
            gain += (f(diagonal + out + into + self_pairs) - f(diagonal + out)
                     - f(diagonal + into) + f(diagonal))
            gain -= f(rows + out.sum() + self_pairs) - f(rows)
            gain -= f(columns + into.sum() + self_pairs) - f(columns)
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                new = old
            moved += new != old
            of[w] = new
            table[new, :] += out
            table[:, new] += into
            table[new, new] += self_pairs
        if not moved:
            break
    return of


def class_ngram_scores(docs: DataFrame, text: str = "text", frequent: int = 2048) -> DataFrame:
    """For each row doc_id, held_out, n_tokens, n_known, train_tokens, base_score and ``score``.

    Tokens are the words of the text, A-Z lower-cased, and one END. The model learns from the rows
    that aren't held out: P(w | v) = P(class of w | class of v) P(w | class of w), the transitions
    smoothed towards the classes' own shares, the emissions additively as in ``base_score``, so
    that the probabilities of all words and one unknown word sum to 1. Both scores are sums of
    log10.

    The exchange runs over the bigrams of the ``frequent`` most frequent words, a table whose size
    has a bound; then each other word, however rare, takes the class under which its neighbours
    among them are likeliest, which is one exchange step for all words at once. Words without such
    neighbours share a class of their own. Words, counts and contexts come from all training texts.

    The texts are encoded once, in slices with vocabularies of their own, and written. What is
    shuffled is one entry per word and slice, in blocks by a hash of the word: contexts on the way
    to the class, class and count on the way back. A common word has one entry per slice. No
    vocabulary is collected or broadcast but the ``frequent`` words.

    A missing or empty text is a single END. A missing id isn't held out. Without training rows
    every token is unknown and both scores are 0.
    """
    ids = docs.schema["doc_id"].dataType
    slices = written(_slices(docs, text), "brown-slices")

    # Counts of words.
    def words_of_slice(row):
        words, counts = row["words"].split(b"\n"), _unsqueeze(row["counts"]).astype(np.int64)
        known = int((counts > 0).sum())  # the most frequent come first
        return {"word": words[:known], "n": counts[:known]}

    counts = written(_each(slices, "word binary, n long", words_of_slice, ["words", "counts"])
                     .groupBy("word").agg(F.sum("n").alias("n")), "brown-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = [bytes(r[0]) for r in counts.where(F.length("word") > 0).orderBy(
        F.desc("n"), "word").select("word").limit(frequent).collect()]
    rank = {w: i for i, w in enumerate(top)}
    k = len(top)

    # Bigrams of the frequent words; at most ``frequent`` squared of them.
    def ranks_in(row) -> np.ndarray:
        return np.array([rank.get(w, -1) for w in row["words"].split(b"\n")], np.int64)

    def frequent_pairs(row):
        left, right = _train_pairs(row, _unsqueeze(row["codes"]).astype(np.int64))
        of = np.append(ranks_in(row), -1)  # the last is for the start of a text
        a, b = of[left], of[right]
        both = (a >= 0) & (b >= 0)
        pair, n = _counted(a[both] * k + b[both])
        return {"pair": pair, "n": n}

    seen = _each(slices, "pair long, n long", frequent_pairs,
                 ["sizes", "held", "words", "codes"]).groupBy("pair").agg(
        F.sum("n").alias("n")).toArrow().sort_by("pair")
    pair, n = (seen.column(c).to_numpy() for c in ("pair", "n"))
    top_class = exchange(np.stack([pair // max(k, 1), pair % max(k, 1)], axis=1), n, k, CLASSES)
    class_pairs = np.zeros((CLASSES, CLASSES))
    np.add.at(class_pairs, (top_class[pair // max(k, 1)], top_class[pair % max(k, 1)]), n)
    smooth = class_pairs + 0.5
    follow = np.log(smooth / smooth.sum(axis=1, keepdims=True))  # [class before, class]
    share = np.log(smooth.sum(axis=0) / smooth.sum())
    # What a neighbour's class says for each class of a word: one behind the word, one before it.
    given = np.concatenate([follow.T, follow - share])  # [2 * CLASSES, CLASSES]

    # An entry for each word and slice, in blocks by a hash of the word.
    blocks = max(4, slices.count() // 2)
    block_schema = "block int, slice long, words binary, counts binary, entry binary, context binary, times binary"

    def contexts(row):
        words = row["words"].split(b"\n")
        counts = _unsqueeze(row["counts"])
        left, right = _train_pairs(row, _unsqueeze(row["codes"]).astype(np.int64))
        ranks = ranks_in(row)
        of = np.append(np.where(ranks >= 0, top_class[ranks] if k else -1, -1), -1)
        rare = np.append(ranks < 0, False)
        ahead = rare[left] & (of[right] >= 0)
        behind = rare[right] & (of[left] >= 0)
        seen, times = _counted(np.concatenate([
            left[ahead] * (2 * CLASSES) + of[right][ahead],
            right[behind] * (2 * CLASSES) + CLASSES + of[left][behind]]))
        block = np.array([zlib.crc32(w) % blocks for w in words], np.int64)
        order = np.argsort(block, kind="stable")
        edges = np.searchsorted(block[order], np.arange(blocks + 1))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        entry, context = place[seen // (2 * CLASSES)], seen % (2 * CLASSES)
        by_place = np.argsort(entry, kind="stable")
        entry, context, times = entry[by_place], context[by_place], times[by_place]
        cuts = np.searchsorted(entry, edges)
        made = []
        for b in range(blocks):
            own, (x, y) = order[edges[b]:edges[b + 1]], cuts[b:b + 2]
            if len(own):
                made.append((b, row["slice"], b"\n".join([words[i] for i in own.tolist()]),
                             _squeeze(counts[own]), _squeeze(entry[x:y] - edges[b]),
                             _squeeze(context[x:y]), _squeeze(times[x:y])))
        return dict(zip(["block", "slice", "words", "counts", "entry", "context", "times"],
                        zip(*made)))

    routed_schema = "block int, slice long, classes binary, counts binary, weight array<double>"

    def classify(key: tuple[pa.Scalar, ...],
                 batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, parts, total_counts = _Numbers(), [], np.zeros(0, np.int64)
        summed: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        pending: list[tuple[np.ndarray, np.ndarray]] = []

        def fold():
            nonlocal summed, pending
            code = np.concatenate([summed[0], *(p[0] for p in pending)])
            times = np.concatenate([summed[1], *(p[1] for p in pending)])
            unique, at = np.unique(code, return_inverse=True)
            summed, pending = (unique, np.bincount(at, times, len(unique)).astype(np.int64)), []

        for batch in batches:
            for k in range(len(batch)):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                words = row["words"].split(b"\n")
                here = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
                if len(total_counts) < len(numbers):
                    total_counts = np.append(total_counts, np.zeros(
                        max(len(numbers) - len(total_counts), len(total_counts)), np.int64))
                total_counts[here] += _unsqueeze(row["counts"])
                parts.append((row["slice"], here.astype(np.int32)))
                pending.append((here[_unsqueeze(row["entry"]).astype(np.int64)] * (2 * CLASSES)
                                + _unsqueeze(row["context"]), _unsqueeze(row["times"]).astype(np.int64)))
                if len(pending) == 64:
                    fold()
        fold()
        of = np.full(len(numbers), APART, np.uint8)
        word, context = summed[0] // (2 * CLASSES), summed[0] % (2 * CLASSES)
        starts = np.nonzero(np.diff(word, prepend=-1))[0]
        for a in range(0, len(starts), 4096):
            part = starts[a:a + 4096]
            stop = starts[a + 4096] if a + 4096 < len(starts) else len(word)
            gains = np.add.reduceat(given[context[part[0]:stop]] *
                                    summed[1][part[0]:stop, None], part - part[0], axis=0)
            of[word[part]] = np.argmax(gains, axis=1)
        held = total_counts[:len(numbers)]
        for w, number in numbers.items():
            if w in rank:
                of[number] = top_class[rank[w]]
        if END in numbers:
            of[numbers[END]] = END_CLASS
        of[held == 0] = UNKNOWN
        weight = np.bincount(of, held + 0.1 * (held > 0), ALL)
        for part, (slice_, here) in enumerate(parts):
            yield pa.RecordBatch.from_arrays([
                pa.array([key[0].as_py()], pa.int32()), pa.array([slice_], pa.int64()),
                pa.array([of[here].tobytes()], pa.binary()),
                pa.array([_squeeze(np.minimum(held[here], 2**32 - 1))], pa.binary()),
                pa.array([weight.tolist() if part == 0 else None], pa.list_(pa.float64()))],
                names=["block", "slice", "classes", "counts", "weight"])

    entries = _each(slices, block_schema, contexts,
                    ["slice", "sizes", "held", "words", "counts", "codes"])
    routed = written(entries.groupBy("block").applyInArrow(classify, routed_schema),
                     "brown-classes")
    weights = np.zeros(ALL)
    for row in routed.where("weight is not null").select(F.posexplode("weight").alias("c", "w")) \
            .groupBy("c").agg(F.sum("w").alias("w")).collect():
        weights[row["c"]] = row["w"]
    weights[UNKNOWN] = 0.1
    mass = total + 0.1 * (distinct + 1)

    # Each text as classes, with the sums that don't depend on its order.
    doc_type = "slice long, sizes binary, held array<boolean>, classes binary, " \
        "known array<long>, base array<double>, emitted array<double>"
    doc_schema = to_arrow_schema(T._parse_datatype_string(doc_type))

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {c: left.column(c)[0].as_py() for c in left.column_names}
        words = row["words"].split(b"\n")
        block = np.array([zlib.crc32(w) % blocks for w in words], np.int64)
        order = np.argsort(block, kind="stable")
        right = right.sort_by("block")
        of, held = np.empty(len(words), np.uint8), np.empty(len(words), np.float64)
        of[order] = np.frombuffer(b"".join(right.column("classes").to_pylist()), np.uint8)
        held[order] = np.concatenate([_unsqueeze(c) for c in right.column("counts").to_pylist()])
        codes, sizes = _unsqueeze(row["codes"]), _unsqueeze(row["sizes"]).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        base = np.log10((held + 0.1) / mass)
        emitted = np.where(of == UNKNOWN, 0.0, np.log10((held + 0.1) / weights[of]))
        made = {
            "slice": row["slice"], "sizes": row["sizes"], "held": row["held"],
            "classes": of[codes].tobytes(),
            "known": np.add.reduceat((held > 0)[codes].astype(np.int64), starts),
            "base": np.add.reduceat(base[codes], starts),
            "emitted": np.add.reduceat(emitted[codes], starts)}
        return pa.Table.from_arrays([pa.array([made[f.name]], f.type) for f in doc_schema],
                                    schema=doc_schema)

    encoded = written(slices.select("slice", "held", "sizes", "words", "codes")
                      .groupBy("slice").cogroup(routed.drop("weight").groupBy("slice"))
                      .applyInArrow(join, doc_type), "brown-texts")

    # Transitions over all training texts, at most ALL squared of them.
    def steps(row):
        left, right = _train_pairs(row, np.frombuffer(row["classes"], np.uint8).astype(np.int64))
        step, n = _counted(np.where(left < 0, END_CLASS, left) * ALL + right)
        return {"step": step, "n": n}

    table = np.zeros(ALL * ALL)
    for step, n in _each(encoded, "step long, n long", steps, ["sizes", "held", "classes"]) \
            .groupBy("step").agg(F.sum("n")).collect():
        table[step] = n
    table = table.reshape(ALL, ALL)
    shares = weights / weights.sum() if total else np.eye(ALL)[UNKNOWN]
    moves = np.log10(np.maximum(
        (table + PRIOR * shares) / (table.sum(axis=1, keepdims=True) + PRIOR), 1e-300))

    def finish(row):
        sizes = _unsqueeze(row["sizes"]).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        of = np.frombuffer(row["classes"], np.uint8).astype(np.int64)
        before = np.empty(len(of), np.int64)
        before[1:] = of[:-1]
        before[starts] = END_CLASS
        return {
            "doc_id": row["doc_ids"], "held_out": row["held"], "n_tokens": sizes,
            "n_known": row["known"], "base_score": row["base"],
            "score": np.add.reduceat(moves[before, of], starts) + np.array(row["emitted"])}

    result = T.StructType([
        docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
        T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    named = encoded.join(slices.select("slice", "doc_ids"), "slice")
    return _each(named, result, finish, named.columns).withColumn(
        "train_tokens", F.lit(total).cast("long"))
