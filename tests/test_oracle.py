"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

from oracle_harness import compare, duck

SF = "/root/testdata/sf0.001"


def _names():
    from catalign.queries import all_queries
    return sorted(all_queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, con, name):
    from catalign.queries import all_oracles, all_queries
    res = compare(spark, name, all_queries()[name], all_oracles()[name], con, SF)
    assert res["status"] == "ok", res


def test_entry_runs(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.columns == ["dataset", "item", "target", "match", "score", "match_rank"]
    assert df.count() > 0
