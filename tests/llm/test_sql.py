"""Registered queries of the package against their SQL."""

import pytest
from compare import differences, sql_connection

from tutorspark.llm.oracles import llm_oracles
from tutorspark.llm.queries import llm_queries

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(llm_oracles()))
def test_query_matches_sql(spark, name):
    assert differences(llm_queries()[name](spark, SF_DIR), sql_connection(SF_DIR), llm_oracles()[name]) is None
