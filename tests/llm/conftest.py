import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from messy_docs import CLASHES, COLUMNS, messy_rows  # noqa: E402


@pytest.fixture(scope="session")
def rows():
    return messy_rows()


@pytest.fixture(scope="session")
def messy(spark, rows):
    extra = tuple("x" for _ in range(14))
    return spark.createDataFrame([(*r, 5, *extra) for r in rows], COLUMNS + CLASHES).repartition(3)


@pytest.fixture(scope="session")
def empty(messy):
    return messy.limit(0)


@pytest.fixture(scope="session")
def pairs(rows):
    return [(r[0], r[1]) for r in rows]
