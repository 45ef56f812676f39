"""Every core query on the smallest tables, against its SQL where it has one."""

import math
from pathlib import Path

import duckdb
import pytest
from conftest import SF

from tundra import queries as Q

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return [columns[i] for i in order], sorted(tuple(one(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, db, name):
    df = Q.QUERIES[name](spark, SF)
    got = df.collect()
    if name in Q.SQL:
        want = db.execute(Q.SQL[name])
        columns = [c[0] for c in want.description]
        assert plain(df.columns, got) == plain(columns, want.fetchall())
    else:
        assert got
