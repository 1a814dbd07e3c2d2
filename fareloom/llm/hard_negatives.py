"""Hard negatives by coordinate pruning in length buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fareloom.session import written

#: Rows of a bucket and anchors of a block, about; a task takes so many of each.
BUCKET, BLOCK, PER_TASK = 4096, 1024, 32
#: Length classes for each doubling of the squared length; coordinates that an anchor looks at.
CLASSES, FOCUS = 4, 4
#: A missing id is smaller than any other.
NO_ID = -(1 << 63)
#: Widens ranges against rounding of unit vectors.
SLACK = 1e-9


class Bucket:
    """Rows of about one length: their whole numbers, and for each coordinate of their unit vectors
    the rows in ascending order."""

    def __init__(self, record: dict):
        self.ids, self.labels, self.uids = (
            np.frombuffer(record[c], np.int64) for c in ("ids", "labels", "uids"))
        n = len(self.ids)
        self.values = np.frombuffer(record["rows"], np.int64).reshape(n, -1)
        self.order = np.frombuffer(record["coordinates"], np.int32).reshape(-1, n)
        self.unit, lengths = unit_rows(self.values)
        self.longest = float(lengths.max())
        self.largest = float(np.abs(self.values.astype(float)).max(initial=0.0))
        self._sorted: dict[int, np.ndarray] = {}
        self._of_label: dict[int, np.ndarray] = {}

    def sorted(self, coordinate: int) -> np.ndarray:
        if coordinate not in self._sorted:
            self._sorted[coordinate] = self.unit[self.order[coordinate], coordinate]
        return self._sorted[coordinate]

    def of_label(self, label: int) -> np.ndarray:
        if label not in self._of_label:
            self._of_label[label] = self.labels == label
        return self._of_label[label]

    def candidates(self, anchor: np.ndarray, length: float, least: float) -> np.ndarray | None:
        """The rows that may have an inner product of ``least`` or more with the anchor; None for
        all.

        Of two unit vectors whose cosine is t or more, no coordinate differs by more than the
        angle of t, each coordinate taken as a cosine. That gives a range of values for each
        coordinate that the anchor is large in; the rows of the narrowest are looked up in its
        sorted list, and those outside another range are left out.
        """
        if least <= 0 or length == 0 or self.longest == 0:
            return None
        cosine = least / (length * self.longest)
        if cosine > 1 + SLACK:
            return np.zeros(0, np.int64)
        d = min(len(anchor), len(self.order))
        unit = anchor[:d] / length
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        middle, width = np.arccos(np.clip(unit[focus], -1, 1)), np.arccos(min(cosine, 1.0))
        low = np.where(middle + width >= np.pi, -1, np.cos(np.minimum(middle + width, np.pi))) - SLACK
        high = np.where(middle <= width, 1, np.cos(np.maximum(middle - width, 0))) + SLACK
        ends = [(np.searchsorted(s := self.sorted(f), a), np.searchsorted(s, b, side="right"))
                for f, a, b in zip(focus.tolist(), low, high)]
        narrow = min(range(len(ends)), key=lambda k: ends[k][1] - ends[k][0], default=None)
        if narrow is None or 2 * (ends[narrow][1] - ends[narrow][0]) > len(self.ids):
            return None
        found = self.order[focus[narrow]][ends[narrow][0]:ends[narrow][1]]
        for k, f in enumerate(focus.tolist()):
            if k != narrow:
                x = self.unit[found, f]
                found = found[(x >= low[k]) & (x <= high[k])]
        return found


def unit_rows(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row over its length, and the lengths; rows of length 0 stay."""
    real = values.astype(float)
    lengths = np.sqrt((real * real).sum(axis=1))
    return real / np.where(lengths > 0, lengths, 1)[:, None], lengths


def products(rows: np.ndarray, anchors: np.ndarray, largest: float) -> np.ndarray:
    """Exact inner products of whole numbers, a row for each anchor. What is beyond a long counts
    as its largest or smallest value."""
    d = min(rows.shape[1], anchors.shape[1])
    rows, anchors = rows[:, :d], anchors[:, :d]
    if largest * float(np.abs(anchors.astype(float)).max(initial=0.0)) * d < 2.0 ** 53:
        return (anchors.astype(float) @ rows.astype(float).T).astype(np.int64)
    exact = anchors.astype(object) @ rows.astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def best_of(scores: np.ndarray, ids: np.ndarray, uids: np.ndarray, n: int) -> list[tuple]:
    """The first ``n`` as (minus score, id, uid): highest score first, then smallest id."""
    if len(scores) > n:
        least = np.partition(scores, len(scores) - n)[len(scores) - n]
        kept = scores >= least
        scores, ids, uids = scores[kept], ids[kept], uids[kept]
    order = np.lexsort((uids, ids, -scores))[:n]
    return [(-s, i, u) for s, i, u in zip(
        scores[order].tolist(), ids[order].tolist(), uids[order].tolist())]


class Anchors:
    """A block of anchors with what is known of their positives."""

    def __init__(self, record: dict):
        self.ids, self.labels, self.uids = (
            np.frombuffer(record[c], np.int64) for c in ("ids", "labels", "uids"))
        self.values = np.frombuffer(record["rows"], np.int64).reshape(len(self.ids), -1)
        self.lengths = unit_rows(self.values)[1]


def scored(bucket: Bucket, anchors: Anchors, least: list[float],
           same: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each anchor, its place, rows of its own or of other labels, and their scores.

    Rows that can't reach the anchor's ``least`` may be left out. Anchors that pruning leaves more
    than half of a bucket are multiplied with it together.
    """
    whole: dict[int, list[int]] = {}
    for k, label in enumerate(anchors.labels.tolist()):
        found = bucket.candidates(anchors.values[k], anchors.lengths[k], least[k])
        if found is None:
            whole.setdefault(label, []).append(k)
        elif len(found):
            rows = found[bucket.of_label(label)[found] == same]
            yield k, rows, products(bucket.values[rows], anchors.values[k:k + 1], bucket.largest)[0]
    for label, places in whole.items():
        rows = np.nonzero(bucket.of_label(label) == same)[0]
        own = bucket.values[rows]
        for a in range(0, len(places), 64):
            yield from zip(places[a:a + 64], [rows] * 64, products(
                own, anchors.values[places[a:a + 64]], bucket.largest))


def nearest_positives(bucket: Bucket, anchors: Anchors, found: list[list[tuple]], n: int) -> None:
    """Merges a bucket's rows into each anchor's first ``n`` of its label."""
    least = [-f[-1][0] if len(f) == n else -np.inf for f in found]
    for k, rows, scores in scored(bucket, anchors, least, same=True):
        good = (scores >= least[k]) & (bucket.uids[rows] != anchors.uids[k])
        if good.any():
            rows = rows[good]
            found[k] = sorted(found[k] + best_of(
                scores[good], bucket.ids[rows], bucket.uids[rows], n))[:n]


def nearest_negatives(bucket: Bucket, anchors: Anchors, positives: list[list[int]],
                      found: list[list[list[tuple]]], n: int, lower: int) -> None:
    """Merges a bucket's rows into the first ``n`` of other labels below each positive's score."""
    def floor(k: int) -> float:
        return min((max(-(-lower * p // 100), -f[-1][0] if len(f) == n else -np.inf)
                    for p, f in zip(positives[k], found[k]) if p >= 0), default=np.inf)

    least = [floor(k) for k in range(len(found))]
    for k, rows, scores in scored(bucket, anchors, least, same=False):
        good = scores >= least[k]
        if good.any():
            rows, scores = rows[good], scores[good]
            for at, p in enumerate(positives[k]):
                inside = (scores >= -(-lower * p // 100)) & (scores <= p)
                if inside.any():
                    own = rows[inside]
                    found[k][at] = sorted(found[k][at] + best_of(
                        scores[inside], bucket.ids[own], bucket.uids[own], n))[:n]


def _blocks(rows: DataFrame, keys: list[str], coordinates: bool) -> DataFrame:
    """The rows of each group in one record."""
    schema = ", ".join([*(f"{k} long" for k in keys), "ids binary", "labels binary", "uids binary",
                        "rows binary", "coordinates binary"])
    target = to_arrow_schema(T._parse_datatype_string(schema))

    def gather(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lists = table.column("q").combine_chunks()
        counts = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy()
        values = np.zeros((len(counts), int(counts.max())), np.int64)
        values[np.arange(values.shape[1]) < counts[:, None]] = flat
        order = np.argsort(unit_rows(values)[0], axis=0, kind="stable").T if coordinates else ()
        parts = [table.column(c).to_numpy().astype(np.int64).tobytes() for c in ("id", "label", "uid")]
        return pa.table([
            *([k.as_py()] for k in key), *([p] for p in parts), [values.tobytes()],
            [np.ascontiguousarray(order, np.int32).tobytes()]], schema=target)

    return rows.groupBy(*keys).applyInArrow(gather, schema)


def _dealt(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """With a ``piece`` that deals the rows of each key into groups of about ``size``."""
    pieces = rows.groupBy(*keys).agg(F.ceil(F.count("*") / size).alias("_pieces"))
    return rows.join(pieces, keys).withColumn(
        "piece", F.pmod(F.xxhash64("uid"), F.col("_pieces"))).drop("_pieces")


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def mine(vectors: DataFrame, anchors: Column, id: str = "vec_id", vector: str = "embedding",
         label: str = "label", positives: int = 5, negatives: int = 5, lower: int = 80,
         scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Each component x becomes floor(``scale`` * x); scores are inner products of those. Rows where
    ``anchors`` holds are anchors; an anchor's positives are its first ``positives`` other rows of
    its label, highest score first, ties by smaller id. For each positive, the first ``negatives``
    rows of other labels follow whose score is at most the positive's and at least ``lower`` per
    cent of it.

    All rows are dealt into buckets of about one length, each with its rows in the order of every
    coordinate. An anchor skips the buckets that are too short for the score it needs; in others,
    ranges that its largest coordinates allow leave candidates, whose scores are computed exactly.
    What an anchor needs rises with what it has found. Tasks take groups of buckets and of anchors;
    each sends at most ``positives``, then ``negatives`` rows for each anchor and positive.

    Rows with a missing label or vector, or a component that is missing or not finite, take no
    part. The shorter of two vectors counts as filled up with zeros. A missing id is smaller than
    any other; rows that repeat an id, or all of a row, are rows of their own. A negative positive
    score has no negatives. Scores beyond a long count as its ends. An empty table gives an empty
    result; other columns are ignored.
    """
    spark = vectors.sparkSession
    x = F.col(vector)
    usable = F.col(label).isNotNull() & x.isNotNull() & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != float("inf")))
    q = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    squared = F.aggregate("q", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    rows = written(
        vectors.where(usable).select(
            F.coalesce(F.col(id).cast("long"), F.lit(NO_ID)).alias("id"),
            F.col(label).cast("long").alias("label"), q.alias("q"),
            F.coalesce(anchors, F.lit(False)).alias("anchor"))
        .withColumns({"uid": F.monotonically_increasing_id(), "class": F.when(
            squared == 0, -1).otherwise(F.floor(F.log2(squared) * CLASSES)).cast("long")}),
        "negatives-rows")
    buckets = written(_blocks(_dealt(rows, ["class"], BUCKET), ["class", "piece"], True),
                      "negatives-buckets")
    own = written(_dealt(rows.where("anchor").withColumn("class", F.lit(0)), ["class"], BLOCK),
                  "negatives-own")
    blocks = written(_blocks(own, ["piece"], False), "negatives-anchors")
    n_buckets, n_blocks = max(1, buckets.count()), max(1, blocks.count())
    across = max(-(-n_buckets // PER_TASK),
                 min(n_buckets, 2 * spark.sparkContext.defaultParallelism))
    down = -(-n_blocks // PER_TASK)
    of_bucket = buckets.select(
        F.pmod(F.xxhash64("class", "piece"), F.lit(across)).alias("across"),
        F.explode(_numbers(down)).alias("down"),
        *buckets.columns[2:])

    def of_block(table: DataFrame) -> DataFrame:
        return table.select(
            F.explode(_numbers(across)).alias("across"),
            F.pmod(F.col("piece"), F.lit(down)).alias("down"), *table.columns[1:])

    first_schema = "anchor long, anchor_id long, score long, id long, uid long"
    first_target = to_arrow_schema(T._parse_datatype_string(first_schema))

    def first(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        for record in right.select(["ids", "labels", "uids", "rows"]).to_pylist():
            own = Anchors(record)
            found.append((own, [[] for _ in own.ids]))
        for k in range(len(left)):
            bucket = Bucket(left.slice(k, 1).to_pylist()[0])
            for own, lists in found:
                nearest_positives(bucket, own, lists, positives)
        return pa.Table.from_pylist([
            {"anchor": a, "anchor_id": i, "score": -s, "id": o, "uid": u}
            for own, lists in found
            for a, i, f in zip(own.uids.tolist(), own.ids.tolist(), lists) for s, o, u in f],
            schema=first_target)

    ranked = Window.partitionBy("anchor").orderBy(F.desc("score"), "id", "uid")
    chosen = written(
        of_bucket.groupBy("across", "down").cogroup(of_block(blocks).groupBy("across", "down"))
        .applyInArrow(first, first_schema).withColumn("place", F.row_number().over(ranked))
        .where(F.col("place") <= positives), "negatives-positives")
    # With each block the positives of its anchors, a few for each.
    lists = chosen.groupBy("anchor").agg(F.sort_array(F.collect_list(
        F.struct("place", "score"))).getField("score").alias("scores"))
    placed = own.select("piece", F.col("uid").alias("anchor")).join(lists, "anchor").groupBy(
        "piece").agg(F.sort_array(F.collect_list(F.struct("anchor", "scores"))).alias("known"))
    armed = written(blocks.join(placed, "piece").select(*blocks.columns, "known"),
                    "negatives-armed")

    second_schema = "anchor long, place int, score long, id long, uid long"
    second_target = to_arrow_schema(T._parse_datatype_string(second_schema))

    def second(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        for record in right.to_pylist():
            own, known = Anchors(record), {k["anchor"]: k["scores"] for k in record["known"]}
            scores = [known.get(u, []) for u in own.uids.tolist()]
            found.append((own, scores, [[[] for _ in s] for s in scores]))
        for k in range(len(left)):
            bucket = Bucket(left.slice(k, 1).to_pylist()[0])
            for own, scores, lists in found:
                nearest_negatives(bucket, own, scores, lists, negatives, lower)
        return pa.Table.from_pylist([
            {"anchor": a, "place": at, "score": -s, "id": o, "uid": u}
            for own, _, lists in found for a, per in zip(own.uids.tolist(), lists)
            for at, f in enumerate(per, start=1) for s, o, u in f], schema=second_target)

    ranked = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "_id", "uid")

    def shown(column: str) -> Column:
        return F.when(F.col(column) != NO_ID, F.col(column))

    return (
        of_bucket.groupBy("across", "down").cogroup(of_block(armed).groupBy("across", "down"))
        .applyInArrow(second, second_schema)
        .select("anchor", "place", "uid", F.col("score").alias("negative_score"),
                F.col("id").alias("_id"))
        .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= negatives)
        .join(chosen.select("anchor", "place", "anchor_id", F.col("score").alias("positive_score"),
                            F.col("id").alias("positive_id")), ["anchor", "place"])
        .select(shown("anchor_id").alias("anchor_id"), shown("positive_id").alias("positive_id"),
                "rank", shown("_id").alias("negative_id"), "positive_score", "negative_score"))
