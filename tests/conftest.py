import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from deltapath.session import local_session  # noqa: E402

EDGE_SCHEMA = "src bigint, dst bigint, weight double"
UPDATE_SCHEMA = "src bigint, dst bigint, weight double, seq bigint"


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores="*", shuffle_partitions=4, app="deltapath-tests")
    yield s


@pytest.fixture
def edges(spark):
    def make(rows):
        return spark.createDataFrame([(int(a), int(b), float(w)) for a, b, w in rows], EDGE_SCHEMA)

    return make


@pytest.fixture
def updates(spark):
    def make(rows):
        return spark.createDataFrame([(int(a), int(b), float(w), int(q)) for a, b, w, q in rows], UPDATE_SCHEMA)

    return make


def as_dict(df, key="v", value="d"):
    return {r[key]: r[value] for r in df.collect()}
