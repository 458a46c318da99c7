from __future__ import annotations

import os
import sys
from datetime import datetime, timedelta

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from rowassay.session import local_session

    session = local_session(8, "8g")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def synthetic(spark):
    """1,000 rows with a column for every injector."""
    start = datetime(2024, 1, 1)
    rows = [
        (
            i, 1.0 + (i * 7919 % 9900) / 100, i % 6 + 1, f"row-{i}", 1 + i * 31 % 499,
            start + timedelta(minutes=i), start + timedelta(minutes=i + 1 + i % 119),
            float(i % 50), float(i % 7), float(i % 50) + float(i % 7),
        )
        for i in range(1000)
    ]
    return spark.createDataFrame(
        rows,
        "_row_id bigint, amount double, code int, text string, fk bigint, start timestamp_ntz, end timestamp_ntz, "
        "a double, b double, total double",
    ).cache()
