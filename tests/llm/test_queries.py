"""The registered queries of this package: names, and results against SQL where they have it."""

import pytest
from verify import compare, connect

from granary.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) == {"op3_line_rules", "op5_near_dups", "op7_substring_dedup", "op11_spelling", "op12_prefix_trie"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    assert compare(spark, connect(FOLDER), name, FOLDER, QUERIES, ORACLES).startswith("ok")


def test_entry_has_them_all():
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())
