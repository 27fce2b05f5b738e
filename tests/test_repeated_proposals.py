"""Proposals of pages whose URL repeats, row by row against the SQL: none is multiplied by the URL's other rows."""

import pytest
from test_repeated_urls import test_query_equals_sql as equals_sql
from test_repeated_urls import twice  # noqa: F401


@pytest.mark.parametrize("name", ["rem10b_add_only_rows", "rem15_buckets", "rem15b_bucket_rows"])
def test_proposals_equal_sql(spark, twice, name):  # noqa: F811
    equals_sql(spark, twice, name)
