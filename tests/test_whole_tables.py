"""Queries over all rows, against their SQL twins."""

import pytest

from tests import test_queries


@pytest.mark.parametrize("name", ["novel_rows_by_date", "reversal_candidates", "reversal_candidates_all"])
def test_query_equals_sql(spark, name):
    test_queries.test_query_equals_sql(spark, name)
