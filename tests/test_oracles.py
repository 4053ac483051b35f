"""Every registered query against its SQL on the smallest test tables."""

import os

import pytest

FOLDER = "/root/testdata/sf0.001"
SAMPLES = "/root/testdata/sf0.01"  # large enough that a sample leaves rows out
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")

from granary.catalog import ORACLES, QUERIES  # noqa: E402
from verify import ROWS_ONLY, compare, connect  # noqa: E402


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, name, FOLDER, QUERIES, ORACLES).startswith("rows-only" if name in ROWS_ONLY else "ok")


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.startswith(("smp_", "pip_sample"))))
def test_sampling_query(spark, name):
    assert compare(spark, connect(SAMPLES), name, SAMPLES, QUERIES, ORACLES).startswith("ok")


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
