"""Every registered query of the fact-graph operators, against its SQL where there is one."""

from __future__ import annotations

import pytest

from tests.conftest import SMALL, same_rows
from threadloom.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    if name in SQL:
        same_rows(df, duck, SQL[name])
    else:
        assert df.count() >= 0
