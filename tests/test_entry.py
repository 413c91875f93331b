import duckdb
import pytest

import __spark_entry__ as entry
from vespera import queries as core

SF = "/root/testdata/sf0.001"


def normal(rows):
    def one(v):
        return round(v, 5) + 0.0 if isinstance(v, float) else v

    return sorted((tuple(one(r[k]) for k in sorted(r)) for r in rows), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() == 10


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query_equals_its_sql(spark, name):
    got = [r.asDict() for r in core.QUERIES[name](spark, SF).collect()]
    if name not in core.SQL:
        return
    con = duckdb.connect()
    for t in ("embeddings", "documents", "part", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    out = con.sql(core.SQL[name])
    want = [dict(zip(out.columns, r)) for r in out.fetchall()]
    assert normal(got) == normal(want)
