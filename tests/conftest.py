import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidewater.session import checkpoint_root, get_spark  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = get_spark("tidewater-tests", {
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
    }, master="local[4]")
    s.sparkContext.setLogLevel("ERROR")
    checkpoint_root(s)  # sets a private folder only when none is configured
    yield s


@pytest.fixture(scope="session")
def sf_small():
    return SF_SMALL
