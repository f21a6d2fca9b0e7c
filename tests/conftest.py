import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cellwright.session import build_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", shuffle_partitions=4)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def grid(spark):
    """A cube from {ts: 2-D list} with the given axes; None is missing."""
    def make(lats, lons, granules, flags=None):
        rows = []
        for ts, values in granules.items():
            for i, lat in enumerate(lats):
                for j, lon in enumerate(lons):
                    flag = flags[ts][i][j] if flags else 0
                    rows.append(("C", f"g{ts}", ts, i, j, float(lat), float(lon), values[i][j], flag))
        schema = "collection string, granule_id string, ts string, i int, j int, lat double, lon double, value double, qa_flag int"
        df = spark.createDataFrame(rows, schema)
        return df.withColumn("ts", df["ts"].cast("timestamp"))

    return make
