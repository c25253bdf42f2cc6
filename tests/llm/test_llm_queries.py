"""Queries with SQL equal it; all give rows of the columns the data's description fixes."""

import pytest

from sparkloom.llm import registry

SMALL = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()
COLUMNS = {
    "p1_found": [("path", "string")], "p2_found": [("path", "string")], "p3_found": [("query_id", "bigint"), ("result_id", "bigint")], "p5_found": [("qualified_name", "string")], "p6_found": [("item_kind", "string"), ("item_key", "string")],
    "p8_ids": [("doc_id", "bigint"), ("ids", "array<int>")], "p10_found": [("doc_id", "bigint")],
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, same):
    same(registry.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_distinct_rows(name, spark):
    df = registry.queries()[name](spark, SMALL)
    assert df.dtypes == COLUMNS[name]
    n = df.count()
    assert n and n == df.distinct().count()


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL) - set(COLUMNS)))
def test_gives_rows(name, spark):
    assert registry.queries()[name](spark, SMALL).count() > 0
