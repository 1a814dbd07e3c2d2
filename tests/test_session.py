"""Stages that a report shares."""

import os

from pyspark.sql import functions as F

from fareloom import session
from fareloom.plans import catalog
from fareloom.session import checkpoint_root, shared_stages, written
from conftest import TESTDATA


def test_a_plan_is_written_once_inside_only(spark, tmp_path):
    numbers = lambda n: spark.range(n).select((F.col("id") * 2).alias("x"))
    paths = lambda t: t.inputFiles()[0].rsplit("/", 1)[0]
    with shared_stages():
        first, again, other = (written(numbers(n), "t") for n in (5, 5, 6))
        assert paths(first) == paths(again) != paths(other)
        assert sorted(r.x for r in again.collect()) == [0, 2, 4, 6, 8]
        # A folder of the caller's is written each time.
        assert paths(written(numbers(5), "t", str(tmp_path))) != paths(first)
    assert paths(written(numbers(5), "t")) != paths(first)
    assert session._KNOWN.get() is None


def test_a_decision_sums_the_points_of_the_past_once(spark):
    root = f"{checkpoint_root(spark).removeprefix('file:')}/fareloom/{spark.sparkContext.applicationId}"
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    rows = catalog.all_queries()["dispatch_decision"](spark, TESTDATA).count()
    purposes = [n.rsplit("-", 1)[0] for n in set(os.listdir(root)) - before]
    assert rows == 1000 and purposes.count("band-points") + purposes.count("points") == 1
    assert purposes.count("daily-supply") == 1 and purposes.count("bands") == 1
