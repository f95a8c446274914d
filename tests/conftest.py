import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from feedline.session import build_session

    existing = SparkSession.getActiveSession()
    if existing is None:
        # tests set their own checkpoint folder (a cluster names a shared one)
        s = build_session("local[4]", "feedline-tests", shuffle_partitions=4,
                          extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="feedline-test-ckpt-")})
    else:
        s = existing
    yield s


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="feedline-test-")


def rows(df, *cols):
    cols = cols or tuple(df.columns)
    return [tuple(r[c] for c in cols) for r in df.collect()]


def one(df):
    r = df.collect()
    assert len(r) == 1
    return r[0]
