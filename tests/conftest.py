import datetime as dt
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from telemill.schema import LOG_SCHEMA, SENSORS  # noqa: E402
from telemill.session import build_session, checkpoint_dir  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", shuffle_partitions=8)
    checkpoint_dir(s, fallback=tempfile.mkdtemp(prefix="telemill-ckpt-"))
    yield s


@pytest.fixture()
def two_partitions(spark):
    """For tests of many small jobs, whose time goes by the number of tasks."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="telemill-test-")


T0 = dt.datetime(2025, 1, 1, 0, 0, 0)


def at(hours=0.0, minutes=0.0, seconds=0.0):
    return T0 + dt.timedelta(hours=hours, minutes=minutes, seconds=seconds)


def make_logs(spark, rows):
    """Rows are dicts; unstated sensors are NULL, unstated strings ''."""
    out = []
    for i, r in enumerate(rows):
        rec = []
        for f in LOG_SCHEMA.fields:
            if f.name == "event_id":
                rec.append(r.get("event_id", i))
            elif f.name in SENSORS or f.name == "timestamp":
                rec.append(r.get(f.name))
            else:
                rec.append(r.get(f.name, "" if f.name != "machine_id" else "A"))
        out.append(tuple(rec))
    return spark.createDataFrame(out, LOG_SCHEMA)
