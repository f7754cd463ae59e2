import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from barloom.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions=8, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="8g",
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


def bars_frame(spark, rows, symbol="A"):
    """rows of (minute offset, close) as hourly-named bars with open = high = low = close."""
    import datetime as dt

    start = dt.datetime(2024, 1, 1)
    data = [(symbol, start + dt.timedelta(minutes=m), float(c), float(c), float(c), float(c), 1.0) for m, c in rows]
    return spark.createDataFrame(
        data, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
    )
