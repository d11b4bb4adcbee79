"""Every named query of the retrieval engine against its SQL."""

import pytest

from findloom.plans.queries import QUERIES
from findloom.plans.sql import ORACLE_SQL


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, same, name):
    same(QUERIES[name](spark, sf_dir), ORACLE_SQL[name])


def test_every_query_has_sql_but_the_splitter():
    assert set(QUERIES) - set(ORACLE_SQL) == {"recursive_split", "lateral_chunks"}


def test_the_splitter_as_a_table_function(spark, sf_dir):
    rows = [sorted(map(tuple, QUERIES[name](spark, sf_dir).collect())) for name in ("lateral_chunks", "recursive_split")]
    assert rows[0] == rows[1]


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark)
    assert rows.columns == ["no", "content", "embed_id", "source", "distance", "score", "key_words"]
    assert rows.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
