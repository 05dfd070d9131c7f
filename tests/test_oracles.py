"""Every query of the analytics engine against its DuckDB SQL; those without one must run and have rows."""

from __future__ import annotations

import pytest

from inkwell.plans import registry
from tests.comparing import oracle, rows

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()
#: Queries whose result may be empty on a small table.
MAY_BE_EMPTY: set[str] = set()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    got = QUERIES[name](spark, data).toPandas()
    if name in ORACLE:
        want = oracle(ORACLE[name], data)
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)
