from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
for folder in (ROOT, ROOT / "tests"):
    sys.path.insert(0, str(folder))


@pytest.fixture(scope="session")
def spark():
    import compare

    session = compare.session(4)
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session


@pytest.fixture(scope="session")
def frame(spark):
    """Rows to DataFrame; one call per literal table."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
