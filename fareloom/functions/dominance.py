"""Sums over all points that lie below a probe in two coordinates, without pairs.

A point lies below a probe if both its coordinates are smaller. Sums over rectangles, and counts of
the rectangles that hold a point, are a few such sums with signs. First coordinates become ranks;
a point belongs to one node of 2**level neighbouring ranks per level, of which only the left one of
two is kept, and the ranks below a probe's are one node for each bit that is set. In a node the
second coordinate is a prefix sum.

``dominance_sums`` answers many probes at once and builds what it needs for them. A
``DominanceIndex`` keeps it in a folder, takes in further points level by level, and reads for a few
probes only the parts that they look up.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fareloom.functions.ordered import sums_before
from fareloom.session import written

#: Bits of a digit in tables that are looked up: a lookup sums at most 255 rows.
DIGIT_BITS = 8
#: Rows of a part of such a table, about, and how many parts a batch may name; beyond them it is
#: no small batch, and the table is read as a whole.
PART_ROWS, MOST_PARTS = 1 << 18, 4096


def _in_nodes(df: DataFrame, height: Column) -> DataFrame:
    """The points, once for each node that they are added to: the left ones of two."""
    return df.withColumn("level", F.explode(F.sequence(F.lit(0), height))).withColumn(
        "node", F.expr("shiftright(rank_u, level)")).where("node % 2 = 0")


def _nodes_below(df: DataFrame, height: Column) -> DataFrame:
    """The probes, once for each of the nodes that together hold all smaller ranks."""
    return df.withColumn("level", F.explode(F.sequence(F.lit(0), height))).withColumn(
        "node", F.expr("shiftright(rank_u, level) - 1")).where("node % 2 = 0 AND node >= 0")


def _added(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Sums of the measures in the types that they have."""
    types = {f.name: f.dataType for f in df.schema}
    return df.groupBy(*keys).agg(*[F.sum(m).cast(types[m]).alias(m) for m in measures])


def dominance_sums(points: DataFrame, probes: DataFrame, measures: Sequence[str],
                   folder: str | None = None, purpose: str = "below") -> DataFrame:
    """For each distinct probe (u, v), the sums of the measures of the points below it.

    A probe without any has sums of 0 or no row. Coordinates are integers and not missing.
    """
    asked = written(probes.select("u", "v").distinct(), f"{purpose}-probes", folder)

    def rank_table(side: str) -> DataFrame:
        known = points.select(side).distinct().withColumn("one", F.lit(1).cast("bigint"))
        both = points.select(side).union(asked.select(side))
        return written(sums_before(known, both, side, ["one"]).select(
            side, F.col("before_one").alias(f"rank_{side}")), f"{purpose}-ranks-{side}", folder)

    ranks, places = rank_table("u"), rank_table("v")
    height = points.select("u").distinct().agg(
        F.ceil(F.log2(F.count("*") + 1)).cast("int").alias("height"))
    tree = _added(_in_nodes(points.join(ranks, "u").join(places, "v"), height.scalar()),
                  ["level", "node", "rank_v"], measures)
    ends = _nodes_below(asked.join(ranks, "u").join(places, "v").where(
        "rank_u > 0 AND rank_v > 0"), height.scalar())
    # Places are numbers of distinct values: two digits hold 2**44 of them.
    prefix = sums_before(tree, ends, "rank_v", measures, ["level", "node"], levels=2)
    return ends.join(prefix, ["level", "node", "rank_v"]).groupBy("u", "v").agg(
        *[F.sum(f"before_{m}").alias(m) for m in measures])


class DigitTable:
    """Sums of measures by the digits of a code, in parts of a table that a lookup can name.

    For each tier, a row says what the points add up to that share all higher digits (``block``)
    and have this digit. The sum before a code is, in each tier, that of the smaller digits of
    its block. All rows of a block are in one part, whose number is computed from the keys.
    """

    def __init__(self, rows: DataFrame, keys: Sequence[str], code: str, measures: Sequence[str],
                 tiers: int, size: int, path: str):
        self.keys, self.code, self.measures, self.tiers = list(keys), code, list(measures), tiers
        self.parts = max(1, -(-size * tiers // PART_ROWS))
        table = _added(self._with_digits(rows.select(*keys, code, *measures)),
                       [*keys, "tier", "block", "digit"], measures)
        table.withColumn("part", self._part()).repartition("part").write.mode(
            "overwrite").partitionBy("part").parquet(path)
        self.table = rows.sparkSession.read.schema(
            table.withColumn("part", self._part()).schema).parquet(path)

    def _with_digits(self, df: DataFrame) -> DataFrame:
        return df.select("*", F.inline(F.array(*[
            F.struct(
                F.lit(t).alias("tier"),
                (F.shiftright(F.col(self.code), DIGIT_BITS * (t + 1)) if t < self.tiers - 1
                 else F.lit(0).cast("bigint")).alias("block"),
                F.shiftright(F.col(self.code), DIGIT_BITS * t).alias("digit"))
            for t in range(self.tiers)])))

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys, "tier", "block"), F.lit(self.parts)).cast("int")

    def of_parts(self, parts: list[int] | None) -> DataFrame:
        """The rows of these parts, found by their folders; None for all."""
        return self.table if parts is None else self.table.where(F.col("part").isin(parts))

    def before(self, probes: DataFrame, folder: str, purpose: str) -> DataFrame:
        """For each distinct probe (keys, code) with points before it, ``before_<m>``."""
        asked = written(self._with_digits(probes.select(*self.keys, self.code).distinct())
                        .withColumn("part", self._part()), purpose, folder)
        named = [r.part for r in asked.select("part").distinct().limit(MOST_PARTS + 1).collect()]
        rows = self.of_parts(named if len(named) <= MOST_PARTS else None)
        block = [*self.keys, "tier", "block", "part"]
        found = asked.withColumnRenamed("digit", "_digit").join(
            rows.select(*block, "digit", *self.measures), block).where("digit < _digit")
        return found.groupBy(*self.keys, self.code).agg(
            *[F.sum(m).alias(f"before_{m}") for m in self.measures])


class _Level:
    """A set of points, with its ranks and nodes."""

    def __init__(self, points: DataFrame, measures: Sequence[str], folder: str):
        self.points = written(points, "points", folder)
        self.size = self.points.count()
        self.measures, self.folder = list(measures), folder
        ranked, self.ranks = self.points, {}
        distinct = {}
        for side in ("u", "v"):
            known = written(self.points.select(side).distinct().withColumn(
                "one", F.lit(1).cast("bigint")), f"known-{side}", folder)
            distinct[side] = known.count()
            self.ranks[side] = DigitTable(known, (), side, ["one"], 8, distinct[side],
                                          f"{folder}/ranks-{side}")
            ranked = ranked.join(sums_before(known, known, side, ["one"]).withColumnRenamed(
                "before_one", f"rank_{side}"), side)
        self.height = distinct["u"].bit_length()
        nodes = _added(_in_nodes(ranked, F.lit(self.height)), ["level", "node", "rank_v"],
                       measures)
        tiers = max(1, -(-distinct["v"].bit_length() // DIGIT_BITS))
        self.tree = DigitTable(nodes, ("level", "node"), "rank_v", measures, tiers,
                               self.size * (self.height // 2 + 1), f"{folder}/tree")

    def sums(self, asked: DataFrame, folder: str) -> DataFrame:
        probes = asked
        for side in ("u", "v"):
            ranks = self.ranks[side].before(asked, folder, f"asked-{side}")
            probes = probes.join(ranks.withColumnRenamed("before_one", f"rank_{side}"), side)
        ends = written(_nodes_below(probes, F.lit(self.height)), "ends", folder)
        found = self.tree.before(ends, folder, "asked-nodes")
        return ends.join(found, ["level", "node", "rank_v"]).groupBy("u", "v").agg(
            *[F.sum(f"before_{m}").alias(m) for m in self.measures])


class DominanceIndex:
    """Points in levels whose sizes fall geometrically, each of them searched for itself.

    ``append`` writes new points as a level of their own, and as long as the level before is at
    most twice as large, the two become one; a point is so written anew a number of times that
    grows with the logarithm of all points. ``sums`` reads for a few probes, in each level, the
    parts of the tables that hold what they look up, and never the points.

    The folder is one that all executors see. What merged levels leave there is not removed.
    """

    def __init__(self, spark: SparkSession, folder: str, measures: Sequence[str]):
        self.spark, self.folder, self.measures = spark, folder, list(measures)
        self.levels: list[_Level] = []

    def append(self, points: DataFrame) -> None:
        """Adds points (u, v, measures); those of the same coordinates are summed."""
        fresh = _added(points.select("u", "v", *self.measures), ["u", "v"], self.measures)
        level = self._level(fresh)
        while self.levels and self.levels[-1].size <= 2 * level.size:
            level = self._level(_added(self.levels.pop().points.unionByName(level.points),
                                       ["u", "v"], self.measures))
        if level.size:
            self.levels.append(level)

    def _level(self, points: DataFrame) -> _Level:
        return _Level(points, self.measures, f"{self.folder}/level-{uuid.uuid4().hex}")

    def sums(self, probes: DataFrame, folder: str) -> DataFrame | None:
        """As ``dominance_sums``; None without points.

        ``folder`` takes what the lookups write; the next call may write it over.
        """
        asked = written(probes.select("u", "v").distinct(), "probes", folder)
        found = None
        for k, level in enumerate(self.levels):
            own = level.sums(asked, f"{folder}/{k}")
            found = own if found is None else found.unionByName(own)
        return None if found is None else found.groupBy("u", "v").agg(
            *[F.sum(m).alias(m) for m in self.measures])
