import pytest
from oracle import SF, connection, plain, same

from codestrata.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    same(QUERIES[name](spark, SF), connection(), ORACLE_SQL[name])


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 5


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_gives_the_same_twice(name):
    """At a size where sort keys tie: rows do not hang on the order in which ties come."""
    rows = []
    for threads in (8, 3):
        con = connection(SF.replace("0.001", "0.01"))
        con.execute(f"SET threads = {threads}")
        got = con.execute(ORACLE_SQL[name])
        columns = sorted(range(len(got.description)), key=lambda i: got.description[i][0])
        rows.append(sorted(repr([plain(r[i]) for i in columns]) for r in got.fetchall()))
    assert rows[0] == rows[1]
