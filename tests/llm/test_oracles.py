"""The text queries that SQL can express equal their DuckDB oracles."""

import pytest

from outletlens.llm.registry import ORACLE, QUERIES

from ..conftest import SF0001
from ..oracle_compare import compare


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, name):
    ok, msg = compare(spark, SF0001, name, QUERIES[name], ORACLE[name])
    assert ok, msg


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
