import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    names = [k for k in entry.queries() if k.startswith("op")]
    assert sorted(int(k[2:].split("_")[0]) for k in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", ["op4_warc", "op5_exact_dedup", "op12_hard_negatives"])
def test_through_the_entry(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(want.columns)
    mine, theirs = sorted(map(repr, map(tuple, got.select(*want.columns).collect()))), sorted(map(repr, want.fetchall()))
    assert mine == theirs and mine
