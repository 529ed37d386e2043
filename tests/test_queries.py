import pytest

from lumenloom import catalog
from tests.compare import DATA, connect, duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, name):
    cols, rows = spark_rows(catalog.QUERIES[name](spark, DATA))
    if name in catalog.ORACLE_SQL:
        want_cols, want = duck_rows(connect(), catalog.ORACLE_SQL[name])
        assert cols == want_cols
        assert rows == want
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())
