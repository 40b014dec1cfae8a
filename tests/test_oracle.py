"""Every query with SQL gives the same rows as the SQL."""

import pytest

from albumloom.plans import load_all
from tests.harness import compare, duck

SF = "/root/testdata/sf0.001"
ENTRIES = load_all()
# these need more rows than the smallest tables hold to give any result
MAY_BE_EMPTY = {"best_split", "eligible_themes", "similar_segment_pairs", "upload_complete_stream", "still_present"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", [n for n, e in ENTRIES.items() if e.sql])
def test_query(spark, con, name):
    found = compare(spark, con, ENTRIES[name], SF)
    assert found is None or (found == "EMPTY RESULT" and name in MAY_BE_EMPTY), found


@pytest.mark.parametrize("name", [n for n, e in ENTRIES.items() if not e.sql])
def test_rows(spark, name):
    assert ENTRIES[name].run(spark, SF).count() > 0


def test_names():
    assert not [n for n in ENTRIES if n.startswith("op") and n[2:3].isdigit()]
