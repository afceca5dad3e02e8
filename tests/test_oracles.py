"""Every registered query with an oracle, against DuckDB on the same tables."""

import pytest
from .conftest import SF, rows_of, rows_of_sql

from tidelake.plans import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    cols, got = rows_of(QUERIES[name](spark, SF))
    assert len(cols) == len(set(cols))
    if name in ORACLES:
        want_cols, want = rows_of_sql(duck, ORACLES[name])
        assert cols == want_cols
        assert got == want
        assert want, "an oracle without rows shows nothing"
