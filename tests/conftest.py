from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
for folder in (ROOT, ROOT / "tests"):
    if str(folder) not in sys.path:
        sys.path.insert(0, str(folder))

from tutorspark.session import local_session  # noqa: E402

SMOKE_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(8, app="tutorspark-tests")


@pytest.fixture(scope="session")
def table(spark):
    """Build a small table from rows and a schema string."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def plan_of():
    """Executed plan of a frame as text."""
    return lambda df: df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return [tuple(r) for r in df.collect()]


def one(df):
    found = df.collect()
    assert len(found) == 1
    return found[0].asDict(recursive=True)
