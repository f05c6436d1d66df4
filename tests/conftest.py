import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tallyspark.session import get_spark
    s = get_spark("local[*]", 8, extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="tallyspark-test-ckpt-")})
    yield s


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="tallyspark-test-")


def rows_of(df, *cols):
    rows = [tuple(r[c] for c in cols) for r in df.collect()]
    return sorted(rows, key=lambda t: tuple((True, 0) if x is None else (False, x) for x in t))
