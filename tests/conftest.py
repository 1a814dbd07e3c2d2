import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fareloom.session import build_session, checkpoint_root  # noqa: E402

TESTDATA = os.environ.get("FARELOOM_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("local[8]", 4, app="tests", **{
        "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.python.sql.dataFrameDebugging.enabled": "false"})
    if not checkpoint_root(session):
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    """Builds small tables: tables.bookings([...]) and so on, missing columns NULL."""
    from fareloom.sources import schema as S

    class Tables:
        @staticmethod
        def make(rows, schema):
            names = schema.fieldNames()
            return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)

        def bookings(self, *rows):
            return self.make(rows, S.BOOKINGS)

        def auctions(self, *rows):
            return self.make(rows, S.AUCTIONS)

        def shifts(self, *rows):
            return self.make(rows, S.SHIFTS)

    return Tables()
