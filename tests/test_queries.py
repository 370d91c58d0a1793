"""Every registered query against its SQL in DuckDB; those without SQL are run."""

from __future__ import annotations

import pytest

from sitegrid.queries import oracle_sql, queries
from tests.conftest import same


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(name, spark, sf_dir, duck):
    df = queries()[name](spark, sf_dir)
    if name in oracle_sql():
        same(df, duck, oracle_sql()[name])
    else:
        assert df.count() > 0
