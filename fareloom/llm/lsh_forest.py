"""Near duplicates by an LSH forest over MinHash signatures, links confirmed on full sets."""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fareloom.llm.bpe import _Numbers, slices
from fareloom.llm.texts import text_of
from fareloom.session import written

#: Trees of the forest, and the MinHash values that each orders its signatures by.
TREES, DEPTH = 32, 8
#: A region of a tree with more sets than this is looked at one value deeper.
CROWD = 32
#: Signs of the one-bit sketch.
SKETCH = 128
#: Words of 64 bits of a map of a set's differences.
WORDS = 8
#: Edges that one task joins to stars, 16 MB of nodes.
EDGES = 500_000
#: Bits of the map of sets to confirm, 4 MB.
MAP_ROWS, ROW_BITS = 1024, 32768

_RANDOM = np.random.default_rng(20240)
_FACTORS = (_RANDOM.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32) | np.uint32(1))
_SHIFTS = _RANDOM.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def least_depth(share: int, missed: float = 1e-5) -> int:
    """The longest prefix that two sets of that similarity share in some tree, but for ``missed``
    of cases; one value is left to go deeper. Seven for 85 per cent, five for 80."""
    depths = [d for d in range(1, DEPTH) if (1 - (share / 100) ** d) ** TREES <= missed]
    return max(depths, default=1)


def least_agreement(share: int, missed: float = 1e-7) -> int:
    """How many signs of the sketches of two sets of that similarity agree, but for ``missed`` of
    cases. Each sign does where the MinHash values do, and in half of the other cases."""
    p, total = (1 + share / 100) / 2, 0.0
    for k in range(SKETCH + 1):
        total += math.comb(SKETCH, k) * p ** k * (1 - p) ** (SKETCH - k)
        if total > missed:
            return k
    return SKETCH


def _mix(h: np.ndarray) -> np.ndarray:
    h = h * _A
    h = (h ^ (h >> np.uint64(32))) * _B
    return h ^ (h >> np.uint64(29))


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text's word shingles, on end, and where each text's stop.

    A-Z is lower-cased. A text with fewer than ``size`` words has the whole sequence as its one
    shingle, and none without words.
    """
    numbers = _Numbers()
    words = [np.array([numbers[w] for w in t.lower().split()], np.int64) for t in texts]
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in numbers], np.uint64)
    lengths = np.array([len(w) for w in words], np.int64)
    h = hashes[np.concatenate(words)] if len(hashes) else np.zeros(0, np.uint64)
    text = np.repeat(np.arange(len(texts)), lengths)
    ends = np.cumsum(lengths)
    combined = h.copy()
    short = lengths < size
    for k in range(1, size):
        # Words behind a text's end add nothing, which only short texts see.
        follows = np.arange(len(h)) + k < np.repeat(ends, lengths)
        step = np.where(follows, np.roll(h, -k), np.uint64(0))
        combined = _mix(combined) + step
    combined = _mix(combined)
    place = np.arange(len(h)) - np.repeat(ends - lengths, lengths)
    good = np.where(short[text], place == 0, place <= lengths[text] - size)
    text, combined = text[good], combined[good]
    order = np.lexsort((combined, text))
    text, combined = text[order], combined[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (combined[1:] != combined[:-1])
    text, combined = text[new], combined[new]
    return combined, np.searchsorted(text, np.arange(len(texts)), side="right")


def digests(sets: np.ndarray, ends: np.ndarray) -> list[bytes | None]:
    """128 bits that tell sets apart; nothing for an empty set."""
    sums = np.append(np.uint64(0), np.cumsum(_mix(sets ^ _B)))
    folds = np.append(np.uint64(0), np.cumsum(_mix(sets + _A)))
    begins = np.append(0, ends[:-1])
    pairs = np.stack([sums[ends] - sums[begins], folds[ends] - folds[begins]], axis=1)
    return [p.tobytes() if n else None for p, n in zip(pairs, (ends - begins).tolist())]


def signatures(sets: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each set 16 bits of each MinHash value, and the one-bit sketch packed."""
    begins = np.append(0, ends[:-1])
    full = np.nonzero(ends > begins)[0]
    values = np.zeros((len(ends), TREES * DEPTH), np.uint32)
    x = (sets >> np.uint64(16)).astype(np.uint32)
    for i in range(TREES * DEPTH if len(full) else 0):
        values[full, i] = np.minimum.reduceat(x * _FACTORS[i] + _SHIFTS[i], begins[full])
    mixed = _mix(values.astype(np.uint64))
    bits = ((mixed[:, ::TREES * DEPTH // SKETCH] >> np.uint64(40)) & np.uint64(1)).astype(np.uint8)
    return (mixed & np.uint64(0xFFFF)).astype(np.uint16), np.packbits(bits, axis=1)


def _sketches(docs: DataFrame, text: str, size: int) -> DataFrame:
    """doc_id, n_shingles, ``node`` (the set's digest), its signature and sketch."""
    wanted = docs.select("doc_id", text_of(text).alias("text"))
    schema = T.StructType([
        wanted.schema["doc_id"], T.StructField("n_shingles", T.LongType()),
        *(T.StructField(n, T.BinaryType()) for n in ("node", "signature", "sketch"))])
    target = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in slices(batch.column(1)):
                sets, ends = shingle_sets(texts, size)
                values, bits = signatures(sets, ends)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, len(texts)),
                    pa.array(np.diff(ends, prepend=0), pa.int64()),
                    pa.array(digests(sets, ends), pa.binary()),
                    pa.array([v.tobytes() for v in values], pa.binary()),
                    pa.array([b.tobytes() for b in bits], pa.binary())], schema=target)

    return wanted.mapInArrow(run, schema)


def _forest(nodes: DataFrame, depth: int) -> DataFrame:
    """A row for each set and tree: the prefixes that tell its regions."""
    target = to_arrow_schema(schema := T._parse_datatype_string(
        "tree int, prefix long, deeper long, turn int, node binary, n long, sketch binary"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), 1024):
                batch = whole.slice(a, 1024)
                values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(
                    len(batch), TREES, DEPTH).astype(np.uint64)
                for t in range(TREES):
                    prefix = np.full(len(batch), t, np.uint64)
                    for d in range(depth):
                        prefix = _mix(prefix + values[:, t, d])
                    deeper = _mix(prefix + values[:, t, depth])
                    n = len(batch)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(n, t, np.int32)), pa.array(prefix.view(np.int64)),
                        pa.array(deeper.view(np.int64)),
                        pa.array(values[:, (t + 1) % TREES, 0].astype(np.int32)),
                        batch.column(0), batch.column(2), batch.column(3)], schema=target)

    return nodes.select("node", "signature", "n", "sketch").mapInArrow(run, schema)


def _alike(left: str, right: str, share: int) -> Column:
    """Whether sizes and sketches of two sets allow the similarity of ``share`` per cent."""
    sizes = (F.least(f"{left}.n", f"{right}.n") * 100
             >= F.greatest(f"{left}.n", f"{right}.n") * share)
    differing = F.lit(0)
    for a in (1, 9):
        half = [F.conv(F.hex(F.substring(F.col(f"{s}.sketch"), a, 8)), 16, -10).cast("long")
                for s in (left, right)]
        differing = differing + F.bit_count(half[0].bitwiseXOR(half[1]))
    return sizes & (differing <= SKETCH - least_agreement(share))


def _confirmed(edges: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The edges (a, b) whose sets have 100 * intersection >= ``share`` * union."""
    first = edges.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = first.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    target = to_arrow_schema(schema := T._parse_datatype_string("a binary, b binary"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for k in range(len(batch)):
                x, y = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint8).reshape(
                    -1, 6) for c in (2, 3))
                x, y = (np.pad(v, ((0, 0), (0, 2))).view("<u8").ravel() for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(100 * common >= share * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).filter(pa.array(kept, pa.bool_())) for c in (0, 1)],
                schema=target)

    return both.select("a", "b", "x", "y").mapInArrow(run, schema)


def _stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each node of the edges (a, b) the smallest that they link it with, as ``b``."""
    batches = list(batches)
    if not batches:
        return
    ends = pa.concat_arrays([b.column(c) for c in (0, 1) for b in batches])
    nodes = ends.unique()
    nodes = nodes.take(pc.sort_indices(nodes))
    x, y = pc.index_in(ends, nodes).to_numpy(zero_copy_only=False).reshape(2, -1)
    root = np.arange(len(nodes), dtype=np.int32)
    while True:
        # Each tree is a star here. It is hung under the smallest root that an edge leads to.
        a, b = root[x], root[y]
        apart = a != b
        if not apart.any():
            break
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            above = root[root]
            if (above == root).all():
                break
            root = above
    yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(root))], names=["a", "b"])


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """node and ``root``, the smallest node that it is linked with, for the nodes of ``edges``.

    ``edges`` are read from written tables. Each task first replaces about ``EDGES`` of them by
    stars, one edge a node. If there are no more than that, these are the components. Else alternating stars
    join those of all tasks: each node's larger neighbours, then its smaller ones, are linked with
    the smallest of them, until nothing changes; the number of rounds grows with the logarithm of
    the longest path. No node's neighbours are gathered there, only their least.
    """
    tasks = -(-edges.count() // EDGES) or 1
    stars = written(edges.select("a", "b").coalesce(tasks).mapInArrow(
        _stars, edges.select("a", "b").schema), f"{purpose}-stars")
    if tasks == 1:
        return stars.toDF("node", "root")
    current, before, turn = stars.distinct(), None, 0
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        both = both.where("a <> b")
        # Written, so that the join can be split where a node has very many neighbours.
        low = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")),
                      f"{purpose}-low-{turn}")
        large = both.join(low, "a").where("b > a").select(
            F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a <> b").distinct(), f"{purpose}-large-{turn}")
        # Now b < a throughout.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where(
            "a <> b").unionByName(low.select("a", F.col("m").alias("b")))
        current = written(small.distinct(), f"{purpose}-small-{turn}")
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, turn = now, turn + 1
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return written(roots.unionByName(roots.select(
        F.col("root").alias("node"), "root").distinct()), f"{purpose}-roots")


def _has(bits: dict[int, bytes], node: bytes) -> bool:
    spread = xxhash.xxh64_intdigest(node, seed=42) % (MAP_ROWS * ROW_BITS)
    row = bits.get(spread // ROW_BITS)
    return row is not None and bool(row[spread % ROW_BITS >> 3] >> (spread & 7) & 1)


def _in_map(node: Column) -> tuple[Column, Column]:
    spread = F.pmod(F.xxhash64(node), F.lit(MAP_ROWS * ROW_BITS))
    return F.floor(spread / ROW_BITS), spread % ROW_BITS


def near_duplicates(docs: DataFrame, text: str = "text", size: int = 5,
                    share: int = 80) -> DataFrame:
    """For each row doc_id, n_shingles, component_id and ``kept``.

    A document's set is its distinct ``size``-word shingles; documents are linked when 100 times
    the intersection is at least ``share`` times the union, and a component is what links reach.
    ``component_id`` is its smallest doc_id, whose row is ``kept``.

    Documents of one set are one node. A forest of ``TREES`` sorted orders of MinHash signatures
    gives candidates: sets with a common prefix of ``least_depth`` values, or of one more where a
    region holds more than ``CROWD``. In each region every set is compared with the first and with
    its neighbour in the order. Regions that the links found leave in several components are put
    together over all trees to groups, and a set is described by what it has beyond the consensus of
    its group (``_around_consensus``): sets far from it meet where they share one of their rarest
    shingles, and none of those that most variants of one text have; sets near it are compared with
    the one nearest to it, and those that are still apart where they share one of the rarest
    differences from the consensus (``_pairs_near_consensus``). Sizes and one-bit sketches rule pairs out, and the full sets of 48-bit hashes
    confirm them. Neither pairs of a group nor its members are gathered; a group of copies is one
    node.

    A missing text, or one without words, has an empty set and is linked with nothing; shorter
    ones than ``size`` words have one shingle. Rows that repeat an id get the same component if
    their texts are linked. An empty table gives an empty result; other columns are ignored.
    """
    sketched = written(_sketches(docs, text, size), "forest-sketches")
    nodes = written(sketched.where("node is not null").groupBy("node").agg(
        F.any_value("n_shingles").alias("n"), F.any_value("signature").alias("signature"),
        F.any_value("sketch").alias("sketch")), "forest-nodes")
    trees = _forest(nodes, least_depth(share)).withColumn("many", F.count("*").over(
        Window.partitionBy("tree", "prefix"))).where("many > 1")
    # ``region`` is what is compared within: a crowded one one value deeper.
    deeper = Window.partitionBy("tree", "prefix", "deeper")
    order = Window.partitionBy("tree", "region").orderBy("turn", "node")
    units = written(
        trees.withColumn("fine", F.count("*").over(deeper))
        .withColumn("region", F.when(F.col("many") > CROWD, F.col("deeper")).otherwise(
            F.col("prefix")))
        .where((F.col("many") <= CROWD) | (F.col("fine") > 1))
        .withColumn("me", F.struct("node", "n", "sketch"))
        .withColumns({"lead": F.first("me").over(order), "last": F.lag("me").over(order)})
        .select("tree", "region", "me", "lead", "last"), "forest-units")

    def pairs(found: DataFrame, left: str, right: str) -> DataFrame:
        a, b = F.col(f"{left}.node"), F.col(f"{right}.node")
        return found.where((a != b) & _alike(left, right, share)).select(
            F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))

    def joined(roots: DataFrame, links: DataFrame, purpose: str) -> DataFrame:
        return components(roots.toDF("a", "b").unionByName(links), purpose)

    candidates = written(pairs(units, "lead", "me").unionByName(
        pairs(units.where("last is not null"), "last", "me")).distinct(), "forest-candidates")

    # The full sets of the nodes in any region, found by a map of fixed size.
    bucket, at = _in_map(F.col("node"))
    bitmap = written(units.select("me.node").distinct().select(
        bucket.alias("bucket"), at.alias("at")).groupBy("bucket").agg(
        F.bitmap_construct_agg("at").alias("bits")), "forest-map")
    sets = written(_sets_of(docs, text, size, bitmap), "forest-sets")

    links = written(_confirmed(candidates, sets, share), "forest-links-1")
    roots = components(links, "forest-roots-1")
    # Regions whose members are still apart, over all trees one group where they share a set.
    rooted = units.select("tree", "region", "lead", "me", F.col("me.node").alias("node")).join(
        roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = rooted.groupBy("tree", "region").agg(
        F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    open_ = written(rooted.join(apart.select("tree", "region"), ["tree", "region"]), "forest-open")
    if not open_.isEmpty():
        groups = components(open_.where("lead.node <> node").select(
            F.least("lead.node", "node").alias("a"), F.greatest("lead.node", "node").alias("b")),
            "forest-groups").toDF("node", "group")
        members = written(
            open_.select("node", "me.n", "me.sketch", "root").distinct().join(groups, "node")
            .withColumn("group", F.xxhash64("group")), "forest-members")
        entries, near, often, elements = _around_consensus(members, sets, share)
        far = _pairs_of(entries, ["group", "h"], share, F.col("x.far") | F.col("y.far"))
        hubs = near.select("group", F.struct("node", "n", "sketch", "root").alias("y")).join(
            near.groupBy("group").agg(F.max_by(F.struct("node", "n", "sketch", "root"), F.struct(
                "slack", "node")).alias("x")), "group").where(
            (F.col("x.root") != F.col("y.root")) & _alike("x", "y", share)).select(
            F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
        more = far.unionByName(hubs).distinct().join(candidates, ["a", "b"], "left_anti")
        links = written(_confirmed(written(more, "forest-candidates-2"), sets, share),
                        "forest-links-2")
        roots = joined(roots, links, "forest-roots-2")
        close = _pairs_near_consensus(near.drop("root").join(roots, "node", "left").withColumn(
            "root", F.coalesce("root", "node")), often, elements, share)
        later = written(_confirmed(written(close.distinct(), "forest-candidates-3"), sets, share),
                        "forest-links-3")
        if not later.isEmpty():
            roots = joined(roots, later, "forest-roots-3")

    placed = sketched.select("doc_id", "n_shingles", "node").join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    full = written(placed, "forest-placed")
    least = written(full.where("root is not null").groupBy("root").agg(
        F.min("doc_id").alias("component_id")), "forest-least")
    linked = full.where("root is not null").join(least, "root").select(
        "doc_id", "n_shingles", "component_id")
    alone = full.where("root is null").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _pairs_of(entries: DataFrame, keys: list[str], share: int, also: Column) -> DataFrame:
    """The pairs (a, b) of sets of different roots with an entry of the same keys."""
    sides = [entries.select(*keys, F.struct("node", "n", "sketch", "root", "far").alias(side))
             for side in ("x", "y")]
    return sides[0].join(sides[1], keys).where(
        (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & also
        & _alike("x", "y", share)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def _around_consensus(members: DataFrame, sets: DataFrame,
                      share: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What sets of a group have beyond what most of them have.

    The consensus of a group is the shingles that more than half of its sets have. Two sets have at
    most as many of those in common as the smaller number that either has. A set is far if that is
    too few for any partner; it then shares, with each set that it is linked with, so many of its
    other shingles, and with the rarest of them as prefix at least one. Gives the ``entries`` of
    these prefixes, for far sets, and all other shingles of the near ones, but for those that no
    second root has; the ``near`` sets with their ``slack``, which is largest for the one that
    differs least from the consensus; how often a group has each shingle; and all shingles.
    """
    target = to_arrow_schema(schema := T._parse_datatype_string("group long, node binary, h long"))

    def unfold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                low = np.frombuffer(batch.column(2)[k].as_buffer(), np.uint8).reshape(-1, 6)
                h = np.pad(low, ((0, 0), (0, 2))).view("<i8").ravel()
                yield pa.RecordBatch.from_arrays([
                    pa.repeat(batch.column(0)[k], len(h)), pa.repeat(batch.column(1)[k], len(h)),
                    pa.array(h)], schema=target)

    elements = written(members.select("group", "node").join(sets, "node").select(
        "group", "node", "shingles").mapInArrow(unfold, schema), "forest-elements")
    sizes = members.groupBy("group").agg(F.count("*").alias("sets"))
    often = written(elements.groupBy("group", "h").agg(F.count("*").alias("f")).join(
        sizes, "group").withColumn("common", 2 * F.col("f") > F.col("sets")), "forest-often")
    consensus = often.where("common").groupBy("group").agg(F.count("*").alias("p"))
    marked = elements.join(often.select("group", "h", "f", "common"), ["group", "h"])
    counts = marked.groupBy("node").agg(F.count_if("common").alias("k"))
    known = written(
        members.join(counts, "node").join(consensus, "group", "left")
        .withColumn("lacks", F.ceil(F.col("n") * share / 100.0 - 1e-9) - F.col("k"))
        .withColumn("far", F.col("lacks") >= 1)
        # Shingles of the prefix that are not in the consensus.
        .withColumn("prefix", F.col("n") - F.col("k") + 1 - F.greatest("lacks", F.lit(1)))
        .withColumn("slack", F.col("n") * ((100 - share) / (100 + share)) - (
            F.col("n") + F.coalesce("p", F.lit(0)) - 2 * F.col("k"))), "forest-known")
    rarest = Window.partitionBy("node").orderBy("f", "h")
    own = marked.where("not common").withColumn("turn", F.row_number().over(rarest)).where("f > 1")
    prefixes = written(own.join(known, ["group", "node"]).where("turn <= prefix").select(
        "group", "h", "node", "n", "sketch", "root", "far"), "forest-prefixes")
    mixed = prefixes.groupBy("group", "h").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.max("far").alias("any")).where(
        "low <> high and any").select("group", "h")
    return prefixes.join(mixed, ["group", "h"]), known.where("not far"), often, elements


def _pairs_near_consensus(near: DataFrame, often: DataFrame, elements: DataFrame,
                          share: int) -> DataFrame:
    """The pairs (a, b) of different roots among sets near the consensus of their group.

    Two sets x and y differ in as many shingles as their differences D from the consensus do, and
    may differ in (100 - share) / (100 + share) of the sum of their sizes. A set's ``slack`` is its
    part of that less the size of its D. If the slacks of a pair add up to 0 or more it is linked,
    and either set is also linked with the one of the largest slack, which all have been compared
    with. Otherwise the two D share at least half of what is lacking, so that both have one of
    the rarest shingles of their D in common, of which those behind what is lacking at least, if
    the other set had the largest slack, may be left out. How many of all of D they share is
    bounded by maps of 512 bits.
    """
    had = elements.join(near.select("node"), "node", "left_semi").join(
        often.select("group", "h", "common"), ["group", "h"])
    missed = near.select("group", "node").join(often.where("common").select("group", "h"), "group") \
        .join(had.where("common").select("node", "h"), ["node", "h"], "left_anti")
    different = written(had.where("not common").select("group", "node", "h").unionByName(
        missed.select("group", "node", "h")), "forest-differences")
    best = near.groupBy("group").agg(F.max("slack").alias("best"))
    lacking = F.ceil(-(F.col("slack") + F.col("best")) / 2 - 1e-9)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("h", F.lit(64)).cast("int"))
    word = F.pmod(F.shiftright("h", 6), F.lit(WORDS))
    sizes = different.groupBy("node").agg(F.count("*").alias("size"), F.array(*[
        F.coalesce(F.bit_or(F.when(word == w, bit)), F.lit(0).cast("long"))
        for w in range(WORDS)]).alias("map"))
    known = near.join(best, "group").join(sizes, "node").withColumn(
        "prefix", F.col("size") + 1 - F.greatest(lacking, F.lit(1)))
    rarity = different.groupBy("group", "h").agg(F.count("*").alias("f"))
    rarest = Window.partitionBy("node").orderBy("f", "h")
    prefixes = written(
        different.join(rarity, ["group", "h"]).withColumn("turn", F.row_number().over(rarest))
        .where("f > 1").join(known, ["group", "node"]).where("turn <= prefix")
        .select("group", "h", F.struct("node", "n", "sketch", "root", "slack", "size", "map")
                .alias("me")), "forest-near-prefixes")
    mixed = prefixes.groupBy("group", "h").agg(
        F.min("me.root").alias("low"), F.max("me.root").alias("high")).where("low <> high")
    mixed = prefixes.join(mixed.select("group", "h"), ["group", "h"])

    def bits(*maps: str) -> Column:
        """Bits that are set in all of the maps."""
        words = [[F.get(f"{m}.map", F.lit(w)) for m in maps] for w in range(WORDS)]
        return functools.reduce(operator.add, [F.bit_count(
            functools.reduce(Column.bitwiseAND, own)) for own in words])

    # As many as they may share: common bits, and what may hide behind bits of its own set.
    common = bits("x", "y") + F.least(
        F.col("x.size") - bits("x"), F.col("y.size") - bits("y"))
    lacking = -(F.col("x.slack") + F.col("y.slack")) / 2 - 1e-9
    return mixed.withColumnRenamed("me", "x").join(mixed.withColumnRenamed("me", "y"), [
        "group", "h"]).where(
        (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root"))
        & (common >= lacking) & _alike("x", "y", share)).select(
        F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def _sets_of(docs: DataFrame, text: str, size: int, bitmap: DataFrame) -> DataFrame:
    """node and its shingles' hashes, six bytes each, for the nodes whose bit in the map is set.

    The map goes to every task as a broadcast of at most ``MAP_ROWS`` rows of 4 KB. Which node a
    text has is computed again beside its set; copies give one row.
    """
    rows = {r["bucket"]: bytes(r["bits"]) for r in bitmap.collect()}
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    target = to_arrow_schema(schema := T._parse_datatype_string("node binary, shingles binary"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for _, texts in slices(batch.column(0)):
                sets, ends = shingle_sets(texts, size)
                nodes = digests(sets, ends)
                low = np.ascontiguousarray(sets.view(np.uint8).reshape(-1, 8)[:, :6])
                made = []
                for k, (node, a, b) in enumerate(zip(nodes, [0, *ends[:-1].tolist()],
                                                     ends.tolist())):
                    if node is not None and _has(bits, node):
                        made.append((node, low[a:b].tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([m[c] for m in made], pa.binary()) for c in (0, 1)], schema=target)

    return docs.select(text_of(text).alias("text")).mapInArrow(run, schema).groupBy("node").agg(
        F.any_value("shingles").alias("shingles"))
